"""Registered queries of the corpus operators, each over its whole table, and their SQL where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import bpe, decontaminate, ngram_join, passage_dedup, period_runs, pii, quality_rules, ranked_search, rule_ensemble, shard_shuffle, token_store, url_filter, warc
from gaugeline.llm.common import table, words
from gaugeline.session import scratch_path

QUERIES: dict[str, callable] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


PAGE = "urn:page:"


@query
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    urn = lambda c: F.concat(F.lit(PAGE), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    records = warc.mark_revisits(pages, "page_id", "payload").select(
        urn("page_id").alias("record_id"), "record_type", F.col("url").alias("target_uri"), F.lit(None).cast("string").alias("date"), "payload_digest",
        F.when(F.col("refers_to").isNotNull(), urn("refers_to")).alias("refers_to"), "payload_bytes", "payload")
    path = scratch_path(spark, "warc")
    warc.write(records, path)
    back = warc.read(spark, path)
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(PAGE) + 1}) as bigint)")
    stored = F.col("record_type") == "response"
    return back.select(page("record_id").alias("page_id"), F.when(stored, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                       F.when(stored, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


SQL["op1_warc"] = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, octet_length(encode(body)) as payload_bytes, sha1(body) as payload_digest, body from p),
g as (select body, max(page_id) as main from d where payload_bytes >= 1000 group by body having count(*) > 1)
select d.page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when main is null or main = d.page_id then 'response' else 'revisit' end as record_type,
  case when main is null or main = d.page_id then null else main end as refers_to
from d left join g on d.body = g.body"""

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url", "html"), RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passage_dedup.repeated(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.judge(docs).select("doc_id", *quality_rules.BASE, "base_failed", "kept")


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    return decontaminate.matches(docs, items).drop("dprint")


END_ID = 2


@query
def op6_token_output(spark: SparkSession, folder: str) -> DataFrame:
    docs, store = table(spark, folder, "documents").select("doc_id", "text"), scratch_path(spark, "tokens")
    token_store.write(docs, store, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_store.read(docs, store).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


@query
def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.classify(table(spark, folder, "documents").select("doc_id", "text"))


SQL["op7_ngram_jaccard"] = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
l as (select x.doc_id as a, y.doc_id as b from s x join s y on x.g = y.g and x.doc_id <> y.doc_id join n nx on nx.doc_id = x.doc_id join n ny on ny.doc_id = y.doc_id
      group by x.doc_id, y.doc_id, nx.n, ny.n having 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
r as (select doc_id as a, doc_id as b from d union select r.a, l.b from r join l on r.b = l.a)
select d.doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, min(r.b) as component_id from d left join n on n.doc_id = d.doc_id join r on r.a = d.doc_id group by d.doc_id"""


@query
def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    count = [F.size(F.filter("spans", pii.is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *count, F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@query
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), ranks, pattern).drop("text")
    back = bpe.decode(ids, ranks, pattern)
    return back.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = rule_ensemble.train(docs, table(spark, folder, "labels"))
    return rule_ensemble.apply(model, docs).select(
        "doc_id", rule_ensemble.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= rule_ensemble.THRESHOLD).cast("int").alias("predicted"))


@query
def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    done = shard_shuffle.write(spark, f"{folder}/documents.parquet", scratch_path(spark, "shards"), shards=16, columns=["doc_id", "text"])
    body = F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


SQL["op12_ranked_search"] = r"""
with a as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
d as (select doc_id, w, len(w) as n from a where len(w) > 0),
s as (select count(*) as docs, sum(n)::bigint as total from d),
q as (select item_id, t, count(*) as c from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark) group by all),
p as (select doc_id, n, t, count(*) as tf from (select doc_id, n, unnest(w) as t from d) where t in (select t from q) group by all),
f as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from (select t, count(*) as df from p group by t), s),
x as (select item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::bigint as score from q join p using (t) join f using (t), s group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from x where score > 0 qualify rank <= 10"""


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = table(spark, folder, "documents").select("doc_id", words("text").alias("w"), h.alias("h"), F.floor(h / 10).alias("g"))
    n = F.size("w")
    again = docs.withColumn("a", F.expr("int(g % greatest(size(w), 1))")).withColumn("p", F.expr("int(1 + (size(w) - a) div (3 + g % 8))"))
    # Words of a text that is made periodic are read through their places; other texts stay as they are.
    own = F.when((F.col("h") % 10 == 0) & (n > 0), F.expr("transform(sequence(0, size(w) - 1), i -> w[if(i < a, i, a + (i - a) % p)])")).otherwise(F.col("w"))
    found = period_runs.find(again.select("doc_id", own.alias("w")), words="w").drop("w")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    written = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    top = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("b.before"), F.col("b.length"), -F.col("b.short")
    return top.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
                      F.expr("(1000 * b.length) div (-b.short)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
