"""The external shuffle: nothing lost, shards equal, the order a Fisher-Yates order of every bucket."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gaugeline.llm import queries, shard_shuffle
from gaugeline.session import scratch_path

DATA = "/root/testdata"


def laid(df, shard="shard", slot="slot"):
    """Rows by shard, in slot order; slots must be 0, 1, 2, ..."""
    out = defaultdict(list)
    for r in df.collect():
        out[r[shard]].append(r)
    for rows in out.values():
        rows.sort(key=lambda r: r[slot])
        assert [r[slot] for r in rows] == list(range(len(rows)))
    return out


def written(spark, df, parts=3):
    path = scratch_path(spark, "source")
    df.repartition(parts).write.parquet(path)
    return path


def test_rows_of_the_table(spark):
    folder = f"{DATA}/sf0.01"
    got = queries.QUERIES["op11_sharding"](spark, folder)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "bigint", "string", "int", "bigint", "int"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    by = laid(got)
    sizes = [len(by[s]) for s in range(16)]
    assert sorted(by) == list(range(16)) and max(sizes) - min(sizes) <= 1
    expected = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for rows in by.values() for r in rows) == expected


def test_odd_rows(spark):
    texts = [(1, None), (None, None), (None, "a"), (2, ""), (2, ""), (3, "x" * 200_000)] + [(7, "copy")] * 500
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    for c in ("shard", "slot", "row", "bucket", "file", "place", "at", "rank", "order", "_shard", "_metadata"):
        df = df.withColumn(c, F.lit("clash"))
    got = shard_shuffle.write(spark, written(spark, df), scratch_path(spark, "t"), shards=7, bucket_bytes=5000)
    by = laid(got)
    assert Counter((r["doc_id"], r["text"]) for rows in by.values() for r in rows) == Counter(texts)
    assert all(r["place"] == r["_metadata"] == r["order"] == "clash" for rows in by.values() for r in rows)
    assert {len(v) for v in by.values()} <= {len(texts) // 7, len(texts) // 7 + 1}
    few = laid(shard_shuffle.shuffled(spark.range(3).toDF("id"), scratch_path(spark, "t"), shards=5))
    assert sorted(r["id"] for rows in few.values() for r in rows) == [0, 1, 2]
    none = shard_shuffle.shuffled(df.limit(0), scratch_path(spark, "t"))
    assert none.collect() == [] and {"doc_id", "text", "shard", "slot"} <= set(none.columns)


def test_same_seed_same_order_and_other_seeds_others(spark):
    path = written(spark, spark.range(4000).withColumn("text", F.lit("t" * 50)), 5)
    order = lambda seed: [r["id"] for _, rows in sorted(laid(shard_shuffle.write(spark, path, scratch_path(spark, "t"), seed=seed, bucket_bytes=20_000)).items()) for r in rows]
    one = order(3)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = order(3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one == again and sorted(one) == list(range(4000))
    other = order(4)
    assert sum(a == b for a, b in zip(one, other)) < 20
    # Neighbours of the input are no neighbours any more, and where a row comes to stand does not depend on where it stood.
    assert sum(abs(a - b) == 1 for a, b in zip(one, one[1:])) < 20
    place = {v: i for i, v in enumerate(one)}
    assert abs(sum((v - 1999.5) * (place[v] - 1999.5) for v in one) / (4000 * 4000 ** 2 / 12)) < 0.08


def test_buckets_follow_the_draws(spark):
    """Replays both passes in Python from the buckets and the orders drawn."""
    path = written(spark, spark.range(900).withColumn("text", F.lit("t" * 92)), 4)
    table = spark.read.parquet(path)
    meta = table.metadataColumn("_metadata")
    buckets, seed, shards = -(-900 * 108 // 9000), 5, 4
    rows = table.select("id", F.xxhash64(meta["file_path"]).alias("f"), meta["row_index"].alias("i"), F.pmod(F.xxhash64(F.lit(seed), F.xxhash64(meta["file_path"]), meta["row_index"]), F.lit(buckets)).alias("b")).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["b"]].append((r["f"], r["i"], r["id"]))
    widest = max(map(len, groups.values()))
    drawn = {r["bucket"]: [x - r["bucket"] * widest for x in r["order"]] for r in shard_shuffle.draws(spark, buckets, widest, seed).collect()}
    assert all(sorted(v) == list(range(widest)) for v in drawn.values()) and len({tuple(v) for v in drawn.values()}) == buckets
    expected = []
    for b in sorted(groups):
        own, order = sorted(groups[b]), [x for x in drawn[b] if x < len(groups[b])]
        placed = [None] * len(own)
        for r, at in zip(own, order):
            placed[at] = r[2]
        expected += placed
    got = laid(shard_shuffle.write(spark, path, scratch_path(spark, "t"), shards=shards, seed=seed, bucket_bytes=9000))
    assert [r["id"] for s in range(shards) for r in got[s]] == expected


def test_no_python_in_the_plan(spark):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        queries.QUERIES["op11_sharding"](spark, f"{DATA}/sf0.001").explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
