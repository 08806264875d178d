"""Exact nearest neighbour in great-circle distance without all pairs.

Points are placed on the unit sphere and both sides are cut into the same nested grid of cubes (each level splits an
edge in eight). Going down level by level, a pair of cells survives only when its smallest possible distance does not
exceed the best guaranteed distance of the query cell; both bounds are integer arithmetic on cell coordinates. What
reaches the points is a thin shell of candidates per query cell, so neither a dense cluster nor a far-away region
multiplies out. Sites at one coordinate are reduced to one point first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.scalars import haversine_km
from gaugeline.session import durable

LEVELS = 7            # finest cell edge 2 / 8**7: about six metres
BITS = 3 * LEVELS     # bits per axis of the finest index


def _points(df: DataFrame, lat: str, lon: str, prefix: str) -> DataFrame:
    la, lo = F.radians(lat), F.radians(lon)
    xyz = {"x": F.cos(la) * F.cos(lo), "y": F.cos(la) * F.sin(lo), "z": F.sin(la)}
    top = (1 << BITS) - 1
    cell = {f"{prefix}{a}": F.least(F.floor((v + 1.0) / 2.0 * F.lit(float(1 << BITS))).cast("bigint"), F.lit(top)) for a, v in xyz.items()}
    return df.withColumns({k: F.greatest(v, F.lit(0)) for k, v in cell.items()})


def _level(p: str, lvl: int) -> list:
    return [F.shiftright(F.col(f"{p}{a}"), 3 * (LEVELS - lvl)).alias(f"{p}{a}{lvl}") for a in "xyz"]


def _names(p: str, lvl: int) -> list[str]:
    return [f"{p}{a}{lvl}" for a in "xyz"]


def _children(points: DataFrame, p: str, lvl: int, count: bool) -> DataFrame:
    """Occupied cells of a level with their parent cell."""
    own, parent = _level(p, lvl), _level(p, lvl - 1)
    g = points.groupBy(*own, *parent)
    return g.agg(F.count(F.lit(1)).alias("_n")) if count else g.agg(F.lit(1).alias("_one")).drop("_one")


def nearest_km(queries: DataFrame, targets: DataFrame, key="entity_id", lat="lat", lon="lon", exclude_same: bool = True,
               out="nearest_km") -> DataFrame:
    """(key, distance to the nearest target). With `exclude_same` a target with the query's own key does not count."""
    q = queries.select(key, lat, lon).where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    t = targets.select(key, lat, lon).where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    # one target per coordinate: its smallest and largest key, to tell whether somebody else is there
    spots = t.groupBy(lat, lon).agg(F.min(key).alias("_k0"), F.max(key).alias("_k1"))
    # both sides are read once per level: write them once
    qp, tp = durable(_points(q, lat, lon, "q"), "near-q"), durable(_points(spots, lat, lon, "t"), "near-t")
    pairs = None
    for lvl in range(1, LEVELS + 1):
        qc, tc = _children(qp, "q", lvl, False), _children(tp, "t", lvl, True)
        if pairs is None:      # level 0 is a single cell on both sides
            root = q.sparkSession.range(1).select(*[F.lit(0).cast("bigint").alias(c) for c in _names("q", 0) + _names("t", 0)])
            pairs = F.broadcast(root)
        j = qc.join(pairs, _names("q", lvl - 1)).join(tc, _names("t", lvl - 1))
        d = [F.abs(F.col(f"q{a}{lvl}") - F.col(f"t{a}{lvl}")) for a in "xyz"]
        lo = sum((F.pow(F.greatest(x - 1, F.lit(0)).cast("double"), F.lit(2.0)) for x in d), F.lit(0.0))
        hi = sum((F.pow((x + 1).cast("double"), F.lit(2.0)) for x in d), F.lit(0.0))
        same = (d[0] + d[1] + d[2]) == 0
        # alone in its own cell, a target may be the query itself: no guarantee from that pair
        hi = F.when(same & (F.col("_n") == 1) & F.lit(exclude_same), F.lit(float("inf"))).otherwise(hi)
        best = F.min("_hi").over(Window.partitionBy(*_names("q", lvl)))      # a query cell's candidates: one thin shell
        j = j.select(*_names("q", lvl), *_names("t", lvl), lo.alias("_lo"), hi.alias("_hi")).withColumn("_best", best)
        pairs = j.where(F.col("_lo") <= F.col("_best")).select(*_names("q", lvl), *_names("t", lvl))
    qq = qp.select(key, F.col(lat).alias("_qa"), F.col(lon).alias("_qo"), *_level("q", LEVELS))
    tt = tp.select(F.col(lat).alias("_ta"), F.col(lon).alias("_to"), "_k0", "_k1", *_level("t", LEVELS))
    j = qq.join(pairs, _names("q", LEVELS)).join(tt, _names("t", LEVELS))
    if exclude_same:
        j = j.where((F.col("_k0") != F.col(key)) | (F.col("_k1") != F.col(key)))
    return j.groupBy(key).agg(F.min(haversine_km("_qa", "_qo", "_ta", "_to")).alias(out))
