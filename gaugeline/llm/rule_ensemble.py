"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on a bounded sample of labelled texts, every path from a root becomes a conjunctive rule, a
lasso logistic regression weighs rules and plain statistics and drops most of them, and what is left is compiled into
one column expression. Scoring is a projection: no join, no shuffle, no Python.

Fitting: at most `SAMPLE` labelled texts (those first in the order of a hash of their id). Labels, language, source and
id are never inputs. With labels of one class only (or none) the score is that class' share (0.5 without labels).
A null text counts as empty and gets a score too. Several label rows of an id count as their mean, rounded; repeated
rows of a text are scored each; extra columns pass through unless they have an output's name."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import SPACE, packed, unpacked, words
from gaugeline.llm.quality_rules import count_of
from gaugeline.session import durable

SAMPLE = 20_000            # most labelled texts that a fit reads
TREES, DEPTH, LASSO, SEED = 24, 3, 0.0008, 11
THRESHOLD = 0.3
FEATURES = ("log_words", "word_length", "symbols", "loud", "upper", "digits", "stops", "distinct", "dup_lines", "line_length", "again", "short")


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: ((feature, '<=' or '>', value), ...)."""

    bounds: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        c = F.lit(True)
        for name, op, x in self.bounds:
            c = c & ((F.col(name) <= x) if op == "<=" else (F.col(name) > x))
        return c.cast("double")


@dataclass
class Model:
    constant: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    linear: list[tuple[str, float, float, float, float, float]] = field(default_factory=list)   # name, low, high, mean, sd, weight

    def score(self) -> Column:
        z = F.lit(self.constant)
        for r, w in self.rules:
            z = z + r.column() * w
        for name, low, high, mean, sd, w in self.linear:
            z = z + _scaled(name, low, high, mean, sd) * w
        return 1 / (1 + F.exp(-z))


def _scaled(name: str, low: float, high: float, mean: float, sd: float) -> Column:
    return (F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high)) - mean) / sd


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Append the features of every text, whole."""
    t = F.col("_t")
    df = df.drop(*FEATURES).withColumn("_t", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumn("_w", words(t)).withColumn("_l", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    df = df.withColumns({"_n": F.greatest(F.size("_w"), F.lit(1)), "_c": F.greatest(F.length(F.translate(t, " \t\n\x0b\x0c\r", "")), F.lit(1)),
                         "_k": F.greatest(F.size("_l"), F.lit(1))})
    share = lambda chars: count_of(t, chars) / F.col("_c")
    return df.withColumns({
        "log_words": F.log1p(F.size("_w").cast("double")), "word_length": F.col("_c") / F.col("_n"),
        "symbols": share("#*$%&|<>"), "loud": share("!?"), "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share("0123456789"), "stops": share(".,;"),
        "distinct": F.size(F.array_distinct("_w")) / F.col("_n"), "dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))) / F.col("_k"),
        "line_length": F.log1p(F.col("_c") / F.col("_k")),
        "again": F.expr("size(filter(_w, (x, i) -> i > 0 and x = _w[i - 1]))") / F.col("_n"),
        "short": F.size(F.filter("_w", lambda x: F.length(x) <= 3)) / F.col("_n"),
    }).drop("_t", "_w", "_l", "_n", "_c", "_k")


def tree_rules(debug: str) -> list[Rule]:
    """The paths of a printed tree, inner nodes' too, with one bound per feature and direction (the tightest)."""
    out, path = [], []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.Ee+]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, FEATURES[int(m[2])], m[3], float(m[4]))]
        tight: dict[tuple[str, str], float] = {}
        for _, name, op, x in path:
            k = (name, op)
            tight[k] = x if k not in tight else (min if op == "<=" else max)(tight[k], x)
        out.append(Rule(tuple((n, op, x) for (n, op), x in sorted(tight.items()))))
    return out


def fit(stats: DataFrame, label: str = "label") -> Model:
    """`stats`: a written table of the sample with FEATURES and a 0/1 label. It has at most SAMPLE rows, so the moments
    and weights that come to the driver do not grow with the corpus."""
    n, ones = stats.agg(F.count("*"), F.sum(label)).first()
    if not n or ones in (0, n):
        share = (ones / n) if n else 0.5
        return Model(math.log(max(share, 1e-3) / max(1 - share, 1e-3)) if share != 0.5 else 0.0)
    vec = stats.select(array_to_vector(F.array(*(F.col(f).cast("double") for f in FEATURES))).alias("features"), F.col(label).cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=10, seed=SEED).fit(vec)
    rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString)}, key=lambda r: r.bounds)
    row = stats.agg(*(x for f in FEATURES for x in (F.expr(f"percentile({f}, array(0.025, 0.975))").alias(f"{f}_p"),))).first()
    clip = {f: row[f"{f}_p"] for f in FEATURES}
    clipped = {f: F.least(F.greatest(F.col(f), F.lit(clip[f][0])), F.lit(clip[f][1])) for f in FEATURES}
    row = stats.agg(*(x for f in FEATURES for x in (F.avg(clipped[f]).alias(f"{f}_m"), F.stddev_pop(clipped[f]).alias(f"{f}_s")))).first()
    lines = [(f, *clip[f], row[f"{f}_m"], row[f"{f}_s"]) for f in FEATURES if row[f"{f}_s"] > 1e-9]
    terms = [r.column() for r in rules] + [_scaled(*x) * 0.4 for x in lines]        # 0.4: the spread of a balanced rule
    design = stats.select(array_to_vector(F.array(*terms)).alias("features"), F.col(label).cast("double").alias("label"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(design)
    w = lasso.coefficients.toArray()
    return Model(float(lasso.intercept), [(r, float(x)) for r, x in zip(rules, w) if abs(x) > 1e-6],
                 [(*x, 0.4 * float(c)) for x, c in zip(lines, w[len(rules):]) if abs(c) > 1e-6])


def held_out(doc_id: Column) -> Column:
    """Ids whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on labelled texts of `docs` outside the held-out part. The sample of labels has at most SAMPLE rows, which
    bounds its broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(F.col(id))).groupBy(id).agg(F.round(F.avg(label)).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64(id), id).limit(SAMPLE)
    own = docs.select(F.col(id), F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), id)
    stats = statistics(own).groupBy(id).agg(F.min(F.struct("label", *FEATURES)).alias("s")).select(id, "s.*")
    return fit(durable(stats.repartition(6, id).sortWithinPartitions(id), "labelled"))


def apply(model: Model, docs: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
    """Append the score. It leaves through a one-element generator: a filter on it then stays above, where it reads the
    number, and is not pushed below with every feature written out again in every rule."""
    kept = [c for c in docs.columns if c != score]
    scored = statistics(packed(docs, kept, text=F.col(f"`{text}`"))).select("_row", F.explode(F.array(model.score())).alias("_s"))
    return unpacked(scored, kept, **{score: F.col("_s")})
