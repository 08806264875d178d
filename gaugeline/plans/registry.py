"""Registry of queries: each pairs a Spark plan with an equivalent SQL statement in another formulation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.plans.roles import Tables, with_roles

QUERIES: dict[str, callable] = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles (and drop the sign of zero), widen integers, so that both engines print the same values."""
    out = []
    for f in df.schema.fields:
        t, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if t in ("double", "float"):
            c = (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        elif t in ("integer", "short", "byte"):
            c = c.cast("bigint").alias(f.name)
        elif t == "boolean":
            c = c.cast("bigint").alias(f.name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6, extra: dict | None = None):
    """Register a query. `doubles` lists the oracle's double columns, rounded as on the Spark side."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: tidy(fn(Tables(spark, folder)), digits)
        if sql:
            body = sql.strip().rstrip(";")
            if doubles:
                rep = ", ".join(f"round(cast({c} as double), {digits}) + 0e0 as {c}" for c in doubles.split())
                body = f"select * replace ({rep}) from (\n{body}\n)"
            SQL[name] = with_roles(body, extra)
        return fn

    return deco
