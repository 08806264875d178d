"""Corrections, quarantine and observed gates on small odd tables."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from gaugeline.operators import corrections, gates
from gaugeline.session import durable, scratch_path
from gaugeline.sources import readers

D0 = datetime.date(2000, 1, 1)


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) < 1e-7)


def table(df):
    return {(r["entity_id"], r["ts"]): r.asDict() for r in df.collect()}


def test_corrections_equal_a_rebuild(spark):
    r = random.Random(5)
    make = lambda n: [(r.randrange(6), D0 + datetime.timedelta(days=r.randrange(3000)), r.choice([None, r.random() * 50])) for _ in range(n)]
    ddl = "entity_id bigint, ts date, value double"
    old, late, gone, fresh = make(150), make(6), make(6), [(77, D0, 1.0), (77, D0 + datetime.timedelta(days=3), None)]
    only = [(88, D0, 4.0)]                                             # an entity that vanishes
    was, now = spark.createDataFrame(old + gone + only, ddl), spark.createDataFrame(old + late + fresh, ddl)
    state = durable(corrections.day_state(was), "state")
    touched = corrections.touched_days(spark.createDataFrame(late + fresh, ddl), spark.createDataFrame(gone + only + [(None, D0, 1.0), (3, None, 1.0)], ddl))
    got, expected = table(corrections.corrected(state, now, touched)), table(corrections.day_state(now))
    assert set(got) == set(expected) and (88, D0) not in got
    for k, e in expected.items():
        assert all(close(got[k][c], e[c]) for c in e), (k, got[k], e)
    assert table(corrections.corrected(state, was, touched.limit(0))) == table(state)
    empty = spark.createDataFrame([], ddl)
    first = table(corrections.corrected(corrections.day_state(empty), now, corrections.touched_days(now)))
    assert set(first) == set(expected) and all(close(first[k][c], e[c]) for k, e in expected.items() for c in e)


def test_quarantine(spark):
    path = scratch_path(spark, "csv")
    lines = ["id,name,at,v", '1,"a, b",2020-01-01,1.5', "2,x,2020-02-30,2", "3,,,", "4,y", "", "  ", "five,z,2020-01-01,NaN", '6,"say ""hi"", you",2020-01-02,1e3', "7,a,b,c,d", '"id","name","at","v"', "8,  padded ,2020-01-03, 4 "]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    rows, bad = readers.scan_csv_quarantine(spark, path, "id bigint, name string, at date, v double")
    got = sorted((r["id"] is None, r["id"] or 0, r["name"], str(r["at"]), r["v"]) for r in rows.collect() if r["v"] == r["v"])
    assert [(g[1], g[2], g[3], g[4]) for g in got] == [(1, "a, b", "2020-01-01", 1.5), (2, "x", "None", 2.0), (3, None, "None", None), (6, 'say "hi", you', "2020-01-02", 1000.0), (8, "padded", "2020-01-03", 4.0)]
    assert rows.count() == 6
    assert sorted((b["line"].split(",")[0], b["column"] or "", b["cell"] or "", b["reason"]) for b in bad.collect()) == [
        ("2", "at", "2020-02-30", "not a date"), ("4", "", "", "number of fields"), ("7", "", "", "number of fields"), ("five", "id", "five", "not a bigint")]
    assert all(b["file"] for b in bad.collect())


def test_observed_gates_are_the_counted_ones(spark):
    rows = spark.createDataFrame([(1, 5.0, 0, None), (2, -1.0, 1, None), (3, None, 0, 4.0), (4, 2.0, None, 1.0)], "row_id bigint, gap_days double, prior_count bigint, prev_value double")
    checks = [("gap_positive", F.count_if(F.col("gap_days") <= 0).alias("gap_positive")), ("cold", F.count_if((F.col("prior_count") == 0) & F.col("prev_value").isNotNull()).alias("cold"))]
    path = scratch_path(spark, "t")
    seen = {r["gate"]: r["violations"] for r in gates.write_checked(rows, path, checks).collect()}
    assert seen == {r["gate"]: r["violations"] for r in gates.counted(rows, checks).collect()} == {"gap_positive": 1, "cold": 1}
    assert spark.read.parquet(path).count() == 4
    none = gates.write_checked(rows.limit(0), scratch_path(spark, "t"), checks).collect()
    assert {r["gate"]: r["violations"] for r in none} == {"gap_positive": 0, "cold": 0}
