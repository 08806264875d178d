"""The corpus pipeline: quality, near duplicates, benchmark text, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; `run` writes each stage's result as
Parquet in the shared folder and reads it back, so a lost executor costs one stage at most. All stages but the last return
the columns of `documents` (and whatever else `docs` had)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import bpe, decontaminate, ngram_join, pii, rule_ensemble
from gaugeline.llm.common import fresh, in_files
from gaugeline.llm.linking import FILE_ROWS
from gaugeline.session import durable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from `labels` and the given documents."""
    model = rule_ensemble.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "_score")
    return rule_ensemble.apply(model, docs, score=score).where(F.col(score) >= rule_ensemble.THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near duplicates one row stays: of its smallest id (null if it has no other), and where that id has several
    rows in the class, the one of the least print. Rows are told apart by id and text, so a text without a near duplicate stays
    whatever its id; so do all rows without words."""
    rows = docs.count()
    classes = durable(in_files(ngram_join.classify(docs.select("doc_id", "text"), detail=True), rows, FILE_ROWS), "classes")
    other = F.col("print").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = classes.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(other).alias("gone"), F.count("print").alias("sets"))
    # Ids of one row, or whose rows all go, are decided by id: whole texts are shuffled once.
    ids = durable(in_files(ids.where("gone > 0 or (rows > 1 and sets > 0)"), rows, FILE_ROWS), "ids")
    own, mark = fresh(docs, "_id"), fresh(docs, "_print")
    same = F.col("doc_id").eqNullSafe(F.col(own))
    kept = docs.join(ids.select(F.col("doc_id").alias(own)), same, "left_anti").select(*docs.columns)
    mixed = ids.where("gone < rows").select(F.col("doc_id").alias(own))
    if mixed.isEmpty():
        return kept
    # Of ids with several rows the texts are looked at again.
    rows = ngram_join.with_print(docs.join(mixed, same, "left_semi"), out=mark)
    first = classes.where(F.col("print").isNotNull() & ~other).groupBy("component").agg(F.min_by(F.struct("doc_id", "print"), "print").alias("s")).select(F.col("s.doc_id").alias(own), F.col("s.print").alias(f"{mark}_"))
    stay = rows.join(first, same & (F.col(mark) == F.col(f"{mark}_")), "left_semi").dropDuplicates(["doc_id", mark])
    return kept.unionByName(rows.where(F.col(mark).isNull()).unionByName(stay).select(*docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to marks; n_chars follows the text."""
    spans = fresh(docs, "_spans")
    done = pii.mask(pii.find(docs, out=spans), spans=spans).drop(spans)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) instead of the text, and whether they decode to it."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    sha, raw = fresh(docs, "_sha"), fresh(docs, "_raw")
    own = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    ids = bpe.encode(own, ranks, pattern).drop("text")
    back = bpe.decode(ids, ranks, pattern, out=raw)
    return back.withColumn("round_trip", F.sha2(raw, 256) == F.col(sha)).drop(raw, sha)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("masked", masked), ("encoded", encoded)]

#: No SQL: the classifier is fitted and the tokenizer has no SQL form. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
