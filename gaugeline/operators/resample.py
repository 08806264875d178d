"""Cluster bootstrap of a paired comparison.

Readings are first reduced to sufficient statistics per cluster (n, sums of squared and absolute errors). A replicate
is then a multiset of clusters: the readings are read once and only per-cluster rows are resampled. Draws come from md5 digests: one digest yields four 32-bit draws, the same on any engine.
Draws travel as two-byte offsets to the chunk of clusters that they hit; there they are counted and multiplied with the statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructType

from gaugeline.functions.scalars import clip
from gaugeline.operators import ordered
from gaugeline.session import durable

STATS = ["n", "sse_base", "sse_cand", "sae_base", "sae_cand"]
DRAWS_PER_DIGEST = 4
CHUNK = 1 << 14                # clusters of a chunk; an offset in it fits two bytes
MD5_ADD = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
MD5_TURN = [np.uint32(t) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
RANGE = 1 << 20                # digests of a packed range


def cluster_stats(df: DataFrame, cluster="entity_id", y="y_true", base="base_pred", cand="cand_pred", keys=()) -> DataFrame:
    eb, ec = F.col(base) - F.col(y), F.col(cand) - F.col(y)
    return df.groupBy(*keys, cluster).agg(
        F.count(F.lit(1)).alias("n"), F.sum(eb * eb).alias("sse_base"), F.sum(ec * ec).alias("sse_cand"),
        F.sum(F.abs(eb)).alias("sae_base"), F.sum(F.abs(ec)).alias("sae_cand"))


def _scores(df: DataFrame) -> DataFrame:
    rb, rc = F.sqrt(F.col("sse_base") / F.col("n")), F.sqrt(F.col("sse_cand") / F.col("n"))
    mb, mc = F.col("sae_base") / F.col("n"), F.col("sae_cand") / F.col("n")
    floor = lambda c: F.greatest(c, F.lit(1e-5))
    return (df.withColumn("base_rmse", rb).withColumn("cand_rmse", rc).withColumn("base_mae", mb).withColumn("cand_mae", mc)
            .withColumn("d_rmse", rc - rb).withColumn("d_mae", mc - mb)
            .withColumn("pct_rmse", 100 * (rb - rc) / floor(rb)).withColumn("pct_mae", 100 * (mb - mc) / floor(mb)))


def digests(prefix: str, lo: int, hi: int) -> np.ndarray:
    """Four rows: the md5 digests of prefix + number, for the numbers lo to hi - 1, as 32-bit integers (first digits first). Numbers are
    hashed many at once; the text must fit one block of md5 (55 bytes)."""
    parts, head = [np.empty((DRAWS_PER_DIGEST, 0), np.uint32)], np.frombuffer(prefix.encode(), np.uint8)
    while lo < hi:
        width = len(str(lo))
        k = np.arange(lo, min(hi, lo + 8192, 10**width))
        text = np.zeros((len(k), 64), np.uint8)
        text[:, :len(head)] = head
        for i in range(width):
            text[:, len(head) + width - 1 - i] = 48 + k // 10**i % 10
        text[:, len(head) + width] = 128
        text[:, 56:58] = np.array([8 * (len(head) + width)], "<u2").view(np.uint8)
        m, start = np.ascontiguousarray(text.view("<u4").T), [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        a, b, c, d = (np.full(len(k), x) for x in start)
        for i, (add, turn) in enumerate(zip(MD5_ADD, MD5_TURN)):
            f = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
            f = f + a + m[(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16] + add
            a, d, c, b = d, c, b, b + ((f << turn) | (f >> (np.uint32(32) - turn)))
        parts.append(np.stack([x + y for x, y in zip((a, b, c, d), start)]).byteswap())
        lo = int(k[-1]) + 1
    return np.concatenate(parts, 1)


def packed_draws(sizes: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """(n_keys, chunk, replicate, draws): as many draws per replicate as there are clusters, the positions in each chunk of CHUNK as
    two-byte offsets. `sizes` holds each number of clusters once: draws depend on nothing else, so groups of one size share them."""
    blocks = -(-replicates // DRAWS_PER_DIGEST)
    spark = sizes.sparkSession
    first = F.explode(F.expr(f"sequence(0L, n_keys - 1, {RANGE}L)")).alias("_lo")
    work = sizes.select("n_keys", first).select("n_keys", "_lo", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    # few rows turn into many draws: spread them over every core before multiplying
    work = work.repartition(4 * spark.sparkContext.defaultParallelism, "n_keys", "_lo", "_b")

    def run(batches):
        for n, lo, b in (r for x in batches for r in zip(*[x.column(i).to_pylist() for i in range(3)])):
            drawn = digests(f"{seed}_{b}_", lo, min(lo + RANGE, n)).astype(np.int64) % n
            out = ([], [], [])
            for i in range(min(DRAWS_PER_DIGEST, replicates - b * DRAWS_PER_DIGEST)):
                own = np.sort(drawn[i])
                cuts = np.searchsorted(own, np.arange(0, n + CHUNK, CHUNK))
                for c in np.flatnonzero(np.diff(cuts)):
                    out[0].append(c)
                    out[1].append(b * DRAWS_PER_DIGEST + i + 1)
                    out[2].append((own[cuts[c]:cuts[c + 1]] - c * CHUNK).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out[0]), n), pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())],
                                             ["n_keys", "chunk", "replicate", "draws"])

    return work.select("n_keys", "_lo", "_b").mapInArrow(run, "n_keys bigint, chunk bigint, replicate int, draws binary")


def replicate_sums(stats: DataFrame, replicates: int, keys=(), seed: int = 42) -> DataFrame:
    """(keys, replicate, STATS): the statistics of the drawn clusters, summed. `stats` has hash_rank, n_keys. Clusters and draws meet
    in chunks of positions, so a group holds CHUNK times `replicates` offsets at most, whatever the number of clusters; groups of
    clusters that share their number are dealt into bands of bounded size."""
    keys, cols = list(keys), STATS
    s = stats.dropna(subset=keys) if keys else stats
    per = s.where("hash_rank = 1").groupBy("n_keys").agg(F.expr(f"cast(ceil(count(1) * least(n_keys, {CHUNK}) / {8 * CHUNK}) as bigint)").alias("bands"))
    place = F.col("hash_rank") - 1
    s = s.join(per, "n_keys")
    s = s.select("n_keys", F.pmod(F.xxhash64(*keys) if keys else F.lit(0), "bands").alias("band"), F.floor(place / CHUNK).cast("bigint").alias("chunk"),
                 (place % CHUNK).alias("_at"), *keys, *[F.col(c).cast("double").alias(c) for c in cols])
    d = packed_draws(per.select("n_keys"), replicates, seed).join(per, "n_keys").select("n_keys", F.explode(F.expr("sequence(0L, bands - 1)")).alias("band"), "chunk", "replicate", "draws")
    width = len(cols)
    schema = StructType([s.schema[k] for k in keys]).add("replicate", IntegerType())
    for c in [*cols, *[f"_n_{c}" for c in cols]]:
        schema = schema.add(c, DoubleType())

    def run(drawn, given):
        if not drawn.num_rows or not given.num_rows:
            return pa.Table.from_pylist([], to_arrow_schema(schema))
        at, groups, own, first = given.column("_at").to_numpy(), {}, [], []
        for i, k in enumerate(zip(*[given.column(k).to_pylist() for k in keys]) if keys else [()] * len(at)):
            if k not in groups:
                groups[k] = len(groups)
                first.append(i)
            own.append(groups[k])
        values = np.stack([given.column(c).to_numpy().astype(float) for c in cols], 1)
        known = np.stack([given.column(c).is_valid().to_numpy(zero_copy_only=False) for c in cols], 1)
        size = int(at.max()) + 1
        table = np.zeros((size, len(groups), 2 * width))
        table[at, own] = np.concatenate([np.where(known, values, 0.0), known], 1)
        table = table.reshape(size, -1)
        finite = np.isfinite(table).all()
        reps = drawn.column("replicate").to_numpy()
        order, packed = np.argsort(reps, kind="stable"), drawn.column("draws").to_pylist()
        starts = [0, *(np.flatnonzero(np.diff(reps[order])) + 1), len(order)]
        sums = []
        for lo, hi in zip(starts, starts[1:]):
            times = np.bincount(np.frombuffer(b"".join(packed[i] for i in order[lo:hi]), "<u2"), minlength=size)
            hit = slice(None) if finite else times > 0                 # an infinite value that is not drawn adds nothing
            sums.append(times[hit].astype(float) @ table[hit])
        sums = np.stack(sums).reshape(-1, 2 * width)                  # replicate by replicate, in it group by group
        which = np.tile(np.arange(len(groups)), len(starts) - 1)
        out = [given.column(k).take(pa.array(np.asarray(first)[which])) for k in keys]
        out.append(pa.array(np.repeat(reps[order][starts[:-1]], len(groups)), pa.int32()))
        return pa.table([*out, *[pa.array(sums[:, i]) for i in range(2 * width)]], schema.names)

    parts = d.groupBy("n_keys", "band", "chunk").cogroup(s.groupBy("n_keys", "band", "chunk")).applyInArrow(run, schema)
    return parts.groupBy(*keys, "replicate").agg(*[F.when(F.sum(f"_n_{c}") > 0, F.sum(c)).alias(c) for c in cols]).withColumn("n", F.col("n").cast("bigint"))


def cluster_bootstrap(df: DataFrame, replicates: int = 1000, cluster="entity_id", y="y_true", base="base_pred", cand="cand_pred",
                      keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Observed paired deltas with percentile intervals over resampled clusters and a two-sided p value."""
    keys = list(keys or [])
    stats = cluster_stats(df, cluster, y, base, cand, keys)
    stats = durable(ordered.hash_rank(stats, cluster, str(seed), keys), "clusters")         # one row per cluster, read four times
    reps = replicate_sums(stats, replicates, keys, seed)
    reps = _scores(reps)
    # one row per replicate: bounded by `replicates`, so the built-in exact percentile is safe here
    ci = reps.groupBy(*keys).agg(
        *[F.percentile(c, F.lit(p)).alias(f"{c}_{side}") for c in ("d_rmse", "d_mae", "pct_rmse") for side, p in (("low", .025), ("high", .975))],
        F.avg((F.col("d_rmse") >= 0).cast("double")).alias("_ge"), F.avg((F.col("d_rmse") <= 0).cast("double")).alias("_le"))
    obs = _scores(stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in STATS], F.count(F.lit(1)).alias("clusters")))
    obs = obs.select(*keys, "clusters", F.col("n").alias("observations"), "base_rmse", "cand_rmse", "d_rmse", "pct_rmse",
                     "base_mae", "cand_mae", "d_mae", "pct_mae")
    j = obs.join(ci, keys) if keys else obs.crossJoin(F.broadcast(ci))              # one row each
    p = clip(2 * F.when(F.col("d_rmse") < 0, F.col("_ge")).otherwise(F.col("_le")), 0.001, 1.0)
    return j.withColumn("p_value", p).drop("_ge", "_le")


def paired_effect_summary(per_seed: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over seeds of a bootstrap's point values and interval ends."""
    cols = ["base_rmse", "cand_rmse", "d_rmse", "d_rmse_low", "d_rmse_high", "pct_rmse", "p_value"]
    return per_seed.groupBy(*keys).agg(F.count(F.lit(1)).alias("seeds"), *[F.avg(c).alias(c) for c in cols])
