"""Column expressions used across operators. All are built-in Spark expressions (no Python in tasks)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DAYS_PER_YEAR = 365.25
EARTH_RADIUS_KM = 6371.0
FOOT_IN_METRES = 0.3048


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo: float, hi: float) -> Column:
    """Bound a value; null stays null."""
    c = col(c)
    return F.when(c < lo, F.lit(float(lo))).when(c > hi, F.lit(float(hi))).otherwise(c)


def finite(c) -> Column:
    """NaN and infinities become null."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def clean_float(c, default: float | None) -> Column:
    """Parse to double; unparsable, null, NaN and infinite values become `default`."""
    return F.coalesce(finite(col(c).try_cast("double")), F.lit(default).cast("double"))


def close_to(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Tolerance comparison: |a-b| <= atol + rtol*|b|."""
    return F.abs(col(a) - col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(col(b))


def to_metres(feet) -> Column:
    return col(feet) * F.lit(FOOT_IN_METRES)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in kilometres."""
    dlat = F.radians(col(lat2) - col(lat1))
    dlon = F.radians(col(lon2) - col(lon1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(col(lat1))) * F.cos(F.radians(col(lat2))) * F.pow(F.sin(dlon / 2), 2)
    h = F.least(h, F.lit(1.0))
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(h))


def haversine_km_atan2(lat1, lon1, lat2, lon2) -> Column:
    """The same distance through atan2, stable for antipodal points."""
    dlat = F.radians(col(lat2) - col(lat1))
    dlon = F.radians(col(lon2) - col(lon1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(col(lat1))) * F.cos(F.radians(col(lat2))) * F.pow(F.sin(dlon / 2), 2)
    h = F.least(h, F.lit(1.0))
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def right_closed_bin(c, edges: list[float], labels: list[str]) -> Column:
    """Label of the interval (edge[i], edge[i+1]] holding the value; null outside all of them."""
    c = col(c)
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((c > lo) & (c <= hi), F.lit(label)).otherwise(out)
    return out


def null_skipping_mean(cols) -> Column:
    """Row-wise mean over the non-null columns; null when all are null."""
    cols = [col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(n > 0, total / n)


def all_present(cols) -> Column:
    """1.0 when every column is non-null, else 0.0."""
    cond = reduce(lambda a, b: a & b, [col(c).isNotNull() for c in cols]) if cols else F.lit(True)
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def portable_hash(text) -> Column:
    """md5 of the text: engine-independent, so a split or sample is repeatable anywhere."""
    return F.md5(col(text).cast("string"))


def hash_bucket(text, buckets: int = 1000) -> Column:
    """First eight hex digits of md5 as a number, modulo `buckets`."""
    return F.conv(F.substring(portable_hash(text), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def keyed_text(key, *salt) -> Column:
    """`key_salt1_salt2` as text, the input of the hash-based choices."""
    parts = [col(key).cast("string")]
    for s in salt:
        parts += [F.lit("_"), s.cast("string") if isinstance(s, Column) else F.lit(str(s))]
    return F.concat(*parts)


def safe_corr(x, y) -> Column:
    """Pearson over complete pairs; null where either side does not vary (the built-in raises there in ANSI mode)."""
    x, y = col(x).cast("double"), col(y).cast("double")
    xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(xs) * F.stddev_pop(ys))
