"""Exact order statistics in one form at every size; no group is gathered in one task.

Rows are first reduced to distinct values with their multiplicity, map-side combined. Rounding to single precision keeps
the order, so it cuts the values of a group into ordered buckets, at most 2**24 per power of two however many rows there
are. Running counts over the buckets say in which one a rank lies and how many rows stand before it; only the values
of that bucket (or, for full ranks, of each bucket on its own) are then put in order. Nothing is sampled or estimated, so
a rank inside the group is always found; one outside it gives null.

Null keys are a group like any other, NaN counts as missing (as null does), ties share their value."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.scalars import col, keyed_text, portable_hash
from gaugeline.session import durable

SEGMENT_ROWS = 1 << 20         # rows of an ordered cut
DIGITS = (13, 13, 13, 13, 12)  # bits of a double that a pass of `column_quantiles` settles


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet; the left key columns stay. Without keys the right side is one row (or one per target
    or bucket list of a single group, whose size is bounded): broadcast."""
    if not keys:
        return left.join(F.broadcast(right), how="cross" if how == "inner" else how)
    named = right.withColumnsRenamed({k: f"_right_{i}" for i, k in enumerate(keys)})
    cond = [left[k].eqNullSafe(named[f"_right_{i}"]) for i, k in enumerate(keys)]
    return left.join(named, cond, how).drop(*[f"_right_{i}" for i in range(len(keys))])


def number(value) -> Column:
    """The value as a double, NaN taken as missing."""
    v = col(value).cast("double")
    return F.when(~F.isnan(v), v)


def value_counts(df: DataFrame, value, keys: list[str]) -> DataFrame:
    """Distinct values with their multiplicity; map-side combined, hashed on (keys, value)."""
    v = number(value)
    return df.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def _coarse(f: Column) -> Column:
    """An order-preserving whole number of a single-precision value: its sign, power of two and the top four bits of its mantissa;
    some ten thousand values at most."""
    size = F.abs(f.cast("double"))
    e = F.floor(F.log2(size))
    place = F.lit(16) * e + F.floor(size / F.pow(F.lit(2.0), e.cast("double")) * 16) + 2984
    return F.when(size == 0, F.lit(0)).when(size == float("inf"), F.signum(f) * 9000).otherwise(F.signum(f) * place).cast("int")


def _buckets(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _f (bucket), _st (rows before it), _c (rows in it), n (rows of the group). Running counts go over coarse buckets first, a
    few thousand a group, and then over the buckets of each coarse one, so no task runs over all buckets of a group."""
    cells = counts.groupBy(*keys, F.col("_v").cast("float").alias("_f")).agg(F.sum("_n").alias("_c")).withColumn("_g", _coarse(F.col("_f")))
    every = Window.partitionBy(*keys)
    upto = Window.unboundedPreceding
    outer = cells.groupBy(*keys, "_g").agg(F.sum("_c").alias("_oc"))
    outer = outer.select(*keys, "_g", F.coalesce(F.sum("_oc").over(every.orderBy("_g").rowsBetween(upto, -1)), F.lit(0)).alias("_ost"), F.sum("_oc").over(every).alias("n"))
    inner = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "_g").orderBy("_f").rowsBetween(upto, -1)), F.lit(0))
    both = null_safe_join(cells.withColumn("_ist", inner), outer, [*keys, "_g"])
    return both.select(*keys, "_f", "_c", (F.col("_ost") + F.col("_ist")).alias("_st"), "n")


def _select(df: DataFrame, value, targets: dict[str, str], keys: list[str]) -> DataFrame:
    """keys, n, and a column per target: the value at the 0-based rank that the SQL over `n` gives."""
    counts = durable(value_counts(df, value, keys), "values")      # read three times; its input may be a long plan
    # The first rank is always there, so every group has a row.
    wanted = F.array(*[F.struct(F.lit(t).alias("_t"), F.expr(r).cast("bigint").alias("_r")) for t, r in {**targets, "": "0"}.items()])
    cells = _buckets(counts, keys)
    at = cells.select(*keys, "_f", "_st", "_c", "n", F.inline(wanted)).where("_r >= _st and _r < _st + _c").drop("_c")
    near = counts.withColumn("_f", F.col("_v").cast("float"))
    found = null_safe_join(near, at, [*keys, "_f"])
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_t").orderBy("_v")) + F.col("_st")
    hit = found.withColumn("_upto", upto).where("_upto - _n <= _r and _r < _upto")
    return hit.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_t") == t, F.col("_v"))).alias(t) for t in targets])


def quantiles(df: DataFrame, value, probs: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, one output column per entry of `probs`; a row per group that has a
    value (without keys: one row, null where there is no value)."""
    keys = list(keys or [])
    targets = {}
    for n, p in probs.items():
        targets[f"{n}:lo"] = f"floor({p!r}d * (n - 1))"
        targets[f"{n}:hi"] = f"ceil({p!r}d * (n - 1))"
    wide = _select(df, value, targets, keys)
    out = []
    for n, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"`{n}:lo`"), F.col(f"`{n}:hi`")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(n))
    return wide.select(*keys, *out)


def many_quantiles(df: DataFrame, wanted: dict[str, tuple], keys: list[str] | None = None) -> DataFrame:
    """Percentiles of several measures in one selection, the measure being a key: wanted maps an output column to (value, probability).
    A row per group that has a value of any measure (without keys: one row)."""
    keys, values = list(keys or []), []
    for v, _ in wanted.values():
        if not any(v is x for x in values):
            values.append(v)
    probs = {f"_q{i}": p for i, p in enumerate(sorted({p for _, p in wanted.values()}))}
    name = {p: n for n, p in probs.items()}
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("_m"), number(v).alias("_x")) for i, v in enumerate(values)])))
    q = quantiles(long, "_x", probs, [*keys, "_m"])
    at = lambda v: next(i for i, x in enumerate(values) if x is v)
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == at(v), F.col(name[p]))).alias(out) for out, (v, p) in wanted.items()])


def _digit_counts(df: DataFrame, cols: list[str], known: list[list[int]], done: int, width: int) -> DataFrame:
    """(column, prefix, cell, n): of the values whose first `done` bits are a known prefix of their column, how many have which next
    `width` bits. Bits are those of the double, turned so that they order as the values do; counted task by task."""
    def run(batches):
        total = [np.zeros((len(own), 1 << width), np.int64) for own in known]
        for b in batches:
            for i, own in enumerate(known):
                v = b.column(i).to_numpy(zero_copy_only=False)
                bits = (v[~np.isnan(v)] + 0.0).view(np.int64)                         # one zero
                bits = (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.uint64) ^ np.uint64(1 << 63)
                cell = ((bits >> np.uint64(64 - done - width)) & np.uint64((1 << width) - 1)).astype(np.int64)
                front = bits >> np.uint64(64 - done) if done else None
                for j, p in enumerate(own):
                    total[i][j] += np.bincount(cell[front == np.uint64(p)] if done else cell, minlength=1 << width)
        rows = [(i, own[j], c, n) for i, own in enumerate(known) for j in range(len(own)) for c, n in zip(np.flatnonzero(total[i][j]).tolist(), total[i][j][total[i][j] > 0].tolist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["column", "prefix", "cell", "n"])

    given = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = given.mapInArrow(run, "column bigint, prefix bigint, cell bigint, n bigint")
    return parts.repartition("column", "prefix").groupBy("column", "prefix", "cell").agg(F.sum("n").alias("n"))      # one shuffle, for the running counts too


def column_quantiles(df: DataFrame, wanted: dict[str, dict[str, float]]) -> dict[str, dict[str, float | None]]:
    """Exact percentiles of many columns of one table, as `quantiles` gives them: by column and name, None for a column without values.
    `wanted` maps a column to the names and probabilities of its percentiles.

    The table is read six times (write it first, if its plan is long) and no value is shuffled: after the counts, each pass settles
    the next bits of every wanted rank, so what leaves a task goes with columns, ranks and cells, whatever the rows and their values."""
    cols = list(wanted)
    size = df.agg(*[F.count(number(F.col(c))).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    pos = {(i, n): p * (size[i] - 1) for i in range(len(cols)) if size[i] for n, p in wanted[cols[i]].items()}
    # (column, rank) -> bits found so far, rows before the values with these bits
    found = {(i, r): (0, 0) for (i, _), x in pos.items() for r in (math.floor(x), math.ceil(x))}
    done = 0
    for width in DIGITS if found else ():
        known = [sorted({found[k][0] for k in found if k[0] == i}) for i in range(len(cols))]
        cells = _digit_counts(df, cols, known, done, width)
        upto = F.sum("n").over(Window.partitionBy("column", "prefix").orderBy("cell"))                 # 2**width rows at most
        ranks = df.sparkSession.createDataFrame([(i, found[i, r][0], r, r - found[i, r][1]) for i, r in found], "column bigint, prefix bigint, rank bigint, place bigint")
        at = cells.withColumn("upto", upto).join(F.broadcast(ranks), ["column", "prefix"]).where("upto - n <= place and place < upto")
        for x in at.select("column", "prefix", "rank", "cell", (F.col("upto") - F.col("n")).alias("before")).collect():     # a row a rank
            found[x["column"], x["rank"]] = (x["prefix"] << width | x["cell"], found[x["column"], x["rank"]][1] + x["before"])
        done += width

    def value(i: int, r: int) -> float:
        b = found[i, r][0]
        return float(np.array([b ^ (1 << 63) if b >> 63 else b ^ (2**64 - 1)], np.uint64).view(np.float64)[0])

    out = {c: dict.fromkeys(wanted[c]) for c in cols}
    for (i, n), x in pos.items():
        lo, hi = np.float64(value(i, math.floor(x))), np.float64(value(i, math.ceil(x)))
        with np.errstate(invalid="ignore"):
            out[cols[i]][n] = float(lo + (hi - lo) * (x - math.floor(x)))
    return out


def value_at_rank(df: DataFrame, value, ranks: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Value at 1-based ranks given as SQL over `n`, the group's count of values, for example "ceil(0.9*(n+1))"; null
    for a rank outside 1..n. The result carries `n`."""
    keys = list(keys or [])
    return _select(df, value, {k: f"({r}) - 1" for k, r in ranks.items()}, keys)


def rank_table(df: DataFrame, value, keys: list[str] | None = None) -> DataFrame:
    """keys, _v, _n, _below (count of smaller values): the base of every rank definition, one row per value."""
    keys = list(keys or [])
    counts = durable(value_counts(df, value, keys), "values")      # read twice; its input may be a long plan
    starts = _buckets(counts, keys).select(*keys, "_f", "_st")
    cut = counts.withColumn("_f", F.col("_v").cast("float"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_f").orderBy("_v"))
    runs = cut.withColumn("_in", upto - F.col("_n"))
    return null_safe_join(runs, starts, [*keys, "_f"]).select(*keys, "_v", "_n", (F.col("_in") + F.col("_st")).alias("_below"))


def average_rank(df: DataFrame, value: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """Add the 1-based rank of `value` inside its group, ties sharing their mean rank; missing values keep null."""
    keys = list(keys or [])
    table = rank_table(df, value, keys).select(*keys, F.col("_v").alias("_rv"), (F.col("_below") + (F.col("_n") + 1) / 2).alias(out))
    return null_safe_join(df.withColumn("_rv", number(value)), table, [*keys, "_rv"], "left").drop("_rv")


def counted_segments(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Cut the rows, in the given order, into ranges of about SEGMENT_ROWS, numbered in `out`: however the values lie, a range holds a
    counted share of the rows. Written, so that the cut stays the same for every later pass."""
    ranges = max(1, -(-df.count() // SEGMENT_ROWS))
    return durable(df.repartitionByRange(ranges, *order).withColumn(out, F.spark_partition_id()), "segments")


def hash_rank(ids: DataFrame, key: str, salt: Column | str, keys: list[str] | None = None,
              out: str = "hash_rank", digits: int = 3) -> DataFrame:
    """Position (1-based) of every key in md5(key_salt) order, plus the group size `n_keys`.

    `ids` holds each key once per group. md5 is uniform, so its first hex digits cut the order into 16**digits even
    buckets: each is sorted alone and offset by a running count over at most 16**digits rows."""
    keys = list(keys or [])
    salt = F.lit(salt) if isinstance(salt, str) else salt
    h = ids.withColumn("_h", portable_hash(keyed_text(key, salt))).withColumn("_b", F.substring("_h", 1, digits))
    cells = h.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_b")
    starts = cells.withColumn("_st", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.withColumn("n_keys", F.sum("_c").over(Window.partitionBy(*keys))).drop("_c")
    ranked = null_safe_join(h, starts, [*keys, "_b"])
    rn = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", key))
    return ranked.withColumn(out, (rn + F.col("_st")).cast("bigint")).drop("_h", "_b", "_st")


def top_k_per_group(df: DataFrame, k: int, order: list, keys: list[str], out: str = "rank") -> DataFrame:
    """First k rows per group. Spark turns `row_number() <= k` into a per-task group limit before the shuffle,
    so a hot group ships at most k rows per task."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, rn).where(F.col(out) <= k)
