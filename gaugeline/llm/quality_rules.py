"""Quality rules whose thresholds follow the data.

Every text gets base counts and ratios. For each ratio a mergeable quantile sketch is kept per language and source:
counts in logarithmic buckets (relative error below 1 %), which add up in any order, so the result is the same however
the rows are dealt out. Sketches of sources add up to those of a language and of everything; a source with fewer than
`ENOUGH` texts takes its language's quantiles, a rare language those of everything. A text is kept when all its ratios
lie inside the fences (quartiles and a multiple of their distance) of its own group.

All of it is DataFrame functions. Rows are reduced to bucket counts before any shuffle, so a source with a third of
all rows costs no more than another; the join with the fences is one that Spark may split by rows.

A null or empty text has no words and fails the base rule. Null languages and sources are groups like others.
Repeated rows are judged (and counted) each; extra columns pass through unless they have an output's name."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import SPACE, packed, unpacked, words
from gaugeline.session import durable

SYMBOLS, LOUD = "#*$%&|<>", "!?"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
GAMMA = 1.02                       # ratio of neighbouring bucket bounds
TINY = 1e-6                        # ratios up to this count as zero
ENOUGH, REACH = 400, 3.0
#: ratio -> least quartile distance that is taken as spread, so that a ratio which is mostly zero has a fence too
SPREAD = {"symbol_ratio": 0.008, "loud_ratio": 0.008, "upper_ratio": 0.03, "dup_line_ratio": 0.12, "repeat_ratio": 0.12, "word_length": 0.4}
TWO_SIDED = ("word_length",)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(w: str) -> str:
    """Words inside a three-word window that occurs at least twice. Windows are hashed; a first sort of plain longs
    (hash bits above, position below) finds windows that may have a partner, and only those are compared in full."""
    windows = f"transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2]))"
    keys = "sort_array(transform(h, (x, i) -> (x & ~1048575L) | (i & 1048575)))"
    maybe = f"transform(array({keys}), s -> filter(s, (k, j) -> (j > 0 and (k & ~1048575L) = (s[j - 1] & ~1048575L)) or (j < size(s) - 1 and (k & ~1048575L) = (s[j + 1] & ~1048575L))))[0]"
    few = f"array_sort(transform({maybe}, k -> struct(h[cast(k & 1048575 as int)] as x, cast(k & 1048575 as int) as i)))"
    every = "array_sort(transform(h, (x, i) -> struct(x as x, i as i)))"       # beyond the positions that the short key holds
    twice = ("transform(array(if(size(h) < 1048576, {few}, {every})), s -> filter(s, (v, j) -> (j > 0 and v.x = s[j - 1].x) or (j < size(s) - 1 and v.x = s[j + 1].x)))[0]"
             .format(few=few, every=every))
    covered = f"cast(size(array_distinct(flatten(transform({twice}, v -> array(v.i, v.i + 1, v.i + 2))))) as bigint)"
    return (f"if(size({w}) < 3, 0L, transform(array({windows}), h -> if(size(array_distinct(h)) = size(h), 0L, {covered}))[0])")


def signals(df: DataFrame, text: str = "text") -> DataFrame:
    """Append the base counts and the ratios."""
    t = F.col("_t")
    df = df.drop(*BASE, *SPREAD).withColumn("_t", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumn("_w", words(t)).withColumn("_l", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": count_of(t, SYMBOLS),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.expr(_repeat_words("_w")),
        "_loud": count_of(t, LOUD),
        "_upper": count_of(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊËÎÏÔÙÛÁÍÑÓÚ"),
        "_lines": F.size("_l"),
    })
    some = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return df.withColumns({
        "symbol_ratio": some("n_symbols", "word_chars"), "loud_ratio": some("_loud", "word_chars"), "upper_ratio": some("_upper", "word_chars"),
        "dup_line_ratio": some("n_dup_lines", "_lines"), "repeat_ratio": some("n_repeat_words", "n_words"), "word_length": some("word_chars", "n_words"),
    }).drop("_t", "_w", "_l", "_loud", "_upper", "_lines")


def sketch(df: DataFrame, keys: list[str], ratios: tuple[str, ...] = tuple(SPREAD)) -> DataFrame:
    """One row per key, ratio and bucket: the mergeable state."""
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), F.col(r).alias("x")) for r in ratios))).alias("v"))
    bucket = F.when(F.col("v.x") <= TINY, F.lit(None)).otherwise(F.ceil(F.log("v.x") / math.log(GAMMA)))
    return long.groupBy(*keys, F.col("v.ratio").alias("ratio"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(state: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: counts add up."""
    return state.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quartiles(state: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and ratio: rows, first and third quartile. A window holds one sketch, some hundred buckets at most."""
    part = ", ".join([*(f"`{k}`" for k in keys), "ratio"])
    run = state.selectExpr("*", f"sum(n) over (partition by {part} order by bucket nulls first) as upto", f"sum(n) over (partition by {part}) as total")
    value = F.coalesce(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (1 + GAMMA)), F.lit(0.0))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, value))
    return run.groupBy(*keys, "ratio").agg(F.max("total").alias("total"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def fences(df: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Per language and source: a row with lower and upper bound of each ratio, from the finest group with enough rows."""
    own = sketch(df, [lang, source])
    by_lang, by_all = merge(own, [lang]), merge(own, [])
    fine = quartiles(own, [lang, source])
    mid = quartiles(by_lang, [lang]).select(F.col(lang).alias("_lang"), F.col("ratio").alias("_r1"), F.struct("total", "q1", "q3").alias("mid"))
    all_ = quartiles(by_all, []).select(F.col("ratio").alias("_r2"), F.struct("total", "q1", "q3").alias("all"))
    q = (fine.join(mid, F.col(lang).eqNullSafe(F.col("_lang")) & (F.col("ratio") == F.col("_r1"))).join(all_, F.col("ratio") == F.col("_r2"))
         .withColumn("use", F.when(F.col("total") >= ENOUGH, F.struct("total", "q1", "q3")).when(F.col("mid.total") >= ENOUGH, F.col("mid")).otherwise(F.col("all"))))
    least = F.create_map(*(x for r, s in SPREAD.items() for x in (F.lit(r), F.lit(s))))[F.col("ratio")]
    reach = F.greatest(F.col("use.q3") - F.col("use.q1"), least) * REACH
    q = q.select(lang, source, "ratio", (F.col("use.q1") - reach).alias("low"), (F.col("use.q3") + reach).alias("high"))
    pick = lambda r, c: F.max(F.when(F.col("ratio") == r, F.col(c)))
    return q.groupBy(lang, source).agg(*(pick(r, c).alias(f"{r}_{c}") for r in SPREAD for c in ("low", "high")))


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Append base counts, ratios, `base_failed`, `method_kept` and `kept`. The counts are written once and read twice
    (for the sketches and for the verdicts), as they cost far more than reading them back; texts are not written. The
    text column is not returned."""
    new = [*BASE, *SPREAD, "base_failed", "method_kept", "kept"]
    kept = [c for c in df.columns if c not in (*new, text)]
    own = packed(df, kept, text=F.col(f"`{text}`"), lang=F.col(f"`{lang}`"), source=F.col(f"`{source}`"))
    counted, lang, source = durable(signals(own).drop("text"), "signals"), "lang", "source"
    f = fences(counted, lang, source).select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), *(F.col(f"{r}_{c}") for r in SPREAD for c in ("low", "high")))
    joined = counted.join(f, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for r in SPREAD:
        inside = inside & (F.col(r) <= F.col(f"{r}_high"))
        if r in TWO_SIDED:
            inside = inside & (F.col(r) >= F.col(f"{r}_low"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = joined.withColumn("base_failed", failed).withColumn("method_kept", F.coalesce(inside, F.lit(True))).withColumn("kept", ~F.col("base_failed") & F.col("method_kept"))
    return unpacked(judged, kept, **{c: F.col(c) for c in new})
