"""Address filter: rules on host and path first, a classifier of the words in the address for the rest.

Names in addresses run words together. Each name is split by the Viterbi path under a unigram model of the words in the
pages' own text; a multinomial naive Bayes model, learnt from the addresses that a rule decides, then scores the words
of host and path of every other address.

Nothing grows on the driver: word counts, substrings of names and class counts meet in joins. Hosts and paths are
reduced to distinct word lists first, so an address, host or path with a third of all rows is scored once.

A null address, or one without `://`, has empty host and path; it has no words and is allowed. Rules only apply where
host and path match them. Without decided addresses of both kinds all others are allowed. Repeated rows get the same
verdict; extra columns pass through unless they have an output's name."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import ascii_lower, packed, unpacked
from gaugeline.session import durable

LONGEST = 20               # letters of the longest word of the unigram model


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one. A rule is (verdict, 'host/path')."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def letters(c: Column) -> Column:
    """The runs of letters, lower-cased, one blank between."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}]+", " "))


def unigrams(pages: DataFrame, html: str) -> DataFrame:
    """(word, n): every word of the pages' text, marks taken out."""
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"<[^<>]*+>", " ")
    w = pages.select(F.explode(F.split(letters(text), " ")).alias("word"))
    return w.where(f"word <> '' and length(word) <= {LONGEST}").groupBy("word").agg(F.count("*").alias("n"))


def viterbi(name: str, known: list[tuple[int, int, int]], total: int) -> list[str]:
    """Most likely split of a name. known: (start, length, count) of its substrings that are words; any other substring
    has probability 10 / (total * 10**length)."""
    score = {(a, k): math.log(n / total) for a, k, n in known}
    best, back = [0.0], [0]
    for j in range(1, len(name) + 1):
        options = [(best[i] + score.get((i, j - i), math.log(10 / total) - (j - i) * math.log(10)), -i) for i in range(max(0, j - LONGEST), j)]
        s, i = max(options)
        best.append(s)
        back.append(-i)
    out, j = [], len(name)
    while j:
        out.append(name[back[j]:j])
        j = back[j]
    return out[::-1]


def segment(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, parts) of distinct names. Substrings meet the counts in a join; a name's substrings are at most LONGEST
    per letter."""
    total = words.agg(F.sum("n")).first()[0] or 1
    names = names.withColumn("nid", F.md5("name"))          # the many substrings carry a short key, not the name
    at = names.select("nid", "name", F.explode(F.expr("sequence(1, length(name))")).alias("i")).selectExpr("nid", "i - 1 as a", f"substring(name, i, {LONGEST}) as w")
    subs = at.select("nid", "a", "w", F.explode(F.expr("sequence(1, length(w))")).alias("k")).selectExpr("nid", "a", "k", "substring(w, 1, k) as word")
    known = subs.join(words, "word").groupBy("nid").agg(F.collect_list(F.struct("a", "k", "n")).alias("known"))
    rows = names.join(known, "nid", "left").select("name", "known")

    def run(batches):
        for b in batches:
            parts = [viterbi(n, [(x["a"], x["k"], x["n"]) for x in ks or []], total) for n, ks in zip(b.column("name").to_pylist(), b.column("known").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(parts, pa.list_(pa.string()))], names=["name", "parts"])

    return rows.mapInArrow(run, "name string, parts array<string>")


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", html: str = "html") -> DataFrame:
    """Append host, path, rule and verdict (without the page text)."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", html)]
    p = packed(pages, kept, host=host_of(F.col(f"`{url}`")), path=path_of(F.col(f"`{url}`")))
    done = lambda df, verdict: unpacked(df, kept, host=F.col("host"), path=F.col("path"), rule=F.col("rule"), verdict=verdict)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "_v": verdict, "_h": letters(F.col("host")), "_p": letters(F.col("path"))})
    fields = p.select(F.explode(F.array(F.struct(F.lit("h").alias("kind"), F.col("_h").alias("field"), "_v"), F.struct(F.lit("p").alias("kind"), F.col("_p").alias("field"), "_v"))).alias("f"))
    weight = lambda v: F.count(F.when(F.col("f._v") == v, 1))
    fields = durable(fields.groupBy("f.kind", "f.field").agg(weight("block").alias("block"), weight("allow").alias("allow")), "fields")
    named = fields.where("field <> ''").select("kind", "field", "block", "allow", F.explode(F.split("field", " ")).alias("name"))
    parts = segment(named.select("name").distinct(), unigrams(pages, html))
    tokens = durable(named.join(parts, "name").select("kind", "field", "block", "allow", F.explode("parts").alias("token")), "tokens")
    counts = tokens.groupBy("token").agg(F.sum("block").alias("b"), F.sum("allow").alias("a"))
    all_b, all_a, v = counts.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    decided = fields.where("kind = 'h'").agg(F.sum("block"), F.sum("allow")).first()
    if not all_b or not all_a:
        return done(p, F.coalesce("_v", F.lit("allow")))
    # Millionths of the log ratio as whole numbers: sums are the same in any order.
    ratio = F.round(1e6 * (F.log((F.col("b") + 1) / (all_b + v)) - F.log((F.col("a") + 1) / (all_a + v)))).cast("long")
    scores = tokens.join(counts.select("token", ratio.alias("r")), "token").groupBy("kind", "field").agg(F.sum("r").alias("score"))
    prior = round(1e6 * (math.log(decided[0]) - math.log(decided[1])))
    host = scores.where("kind = 'h'").select(F.col("field").alias("_h"), F.col("score").alias("_hs"))
    path = scores.where("kind = 'p'").select(F.col("field").alias("_p"), F.col("score").alias("_ps"))
    out = p.join(host, "_h", "left").join(path, "_p", "left")
    score = F.coalesce("_hs", F.lit(0)) + F.coalesce("_ps", F.lit(0)) + prior
    method = F.when((F.col("_hs").isNotNull() | F.col("_ps").isNotNull()) & (score > 0), "block").otherwise("allow")
    return done(out, F.coalesce("_v", method))
