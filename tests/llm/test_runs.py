"""Periodic runs of words against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import period_runs, queries

DATA = "/root/testdata"


def runs_by_brute_force(x, least=12):
    """(start, end, smallest period), by comparing at every distance."""
    n, out = len(x), {}
    code = {}
    a = np.array([code.setdefault(w, len(code)) for w in x], np.int64)
    for q in range(1, n // 2 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], a[:-q] == a[q:], [False]]).astype(np.int8)))
        for l, r in zip(edge[::2], edge[1::2]):
            if r + q - l >= max(least, 2 * q):
                out.setdefault((int(l), int(r) + q), q)
    return sorted((l, e, q) for (l, e), q in out.items())


def answer(words):
    found = runs_by_brute_force(words)
    gone = set()
    for l, e, q in found:
        gone.update(range(l + q, e))
    return sorted((l, e - l, q) for l, e, q in found), " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("seed", range(6))
def test_sequences(seed):
    r = random.Random(seed)
    for _ in range(150):
        n, v = r.randrange(0, 160), r.choice([1, 2, 2, 3, 5, 30])
        x = [r.randrange(v) for _ in range(n)]
        for _ in range(r.randrange(3)):
            if n > 4:
                a, e = r.randrange(n), r.randrange(n)
                p = 1 + r.randrange(max((n - a) // 2, 1))
                for i in range(a, e):
                    x[i] = x[a + (i - a) % p]
        for least in (2, 12):
            got = [tuple(map(int, z)) for z in zip(*period_runs.runs(np.array(x, np.int64), n, least))]
            assert sorted(got) == runs_by_brute_force(x, least), x


def test_words_with_many_runs_and_long_periods():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    for x in (b, [0] * 5000, list(range(701)) * 4 + [5, 6], [i % 1000 for i in range(2999)]):
        got = [tuple(map(int, z)) for z in zip(*period_runs.runs(np.array(x, np.int64), len(x)))]
        assert sorted(got) == runs_by_brute_force(x)


def test_transform_is_exact():
    r = np.random.default_rng(5)
    for size, first, count in ((1, 1, 3), (2, 4, 4), (8, 16, 16), (64, 128, 128)):
        x = np.concatenate([r.integers(0, 3, 300), r.integers(0, 1 << 20, 300), np.arange(40).repeat(30)])
        starts = np.arange(0, len(x) - first - count - size, size)
        b, d = period_runs.zero_mismatches(x, starts, size, first, count)
        expected = {(i, k) for i, s in enumerate(starts) for k in range(first, first + count) if (x[s:s + size] == x[s + k:s + k + size]).all()}
        assert set(zip(b.tolist(), d.tolist())) == expected


def test_every_primes_transform():
    """A product of polynomials through each prime equals the schoolbook one; the roots have the order they should."""
    for p, g in period_runs.PRIMES:
        roots = period_runs._roots(p, g, 16)
        assert pow(int(roots[1]), 8, p) == p - 1
        a, b = np.zeros((1, 16), np.uint64), np.zeros((1, 16), np.uint64)
        a[0, :5], b[0, :7] = [3, 1, 4, 1, 5], [p - 1, 2, 7, 1, 8, 2, 8]
        got = period_runs._backward(period_runs._forward(a, p, roots) * period_runs._forward(b, p, roots) % np.uint64(p), p, roots)[0].tolist()
        expected = [0] * 16
        for i in range(5):
            for j in range(7):
                expected[i + j] = (expected[i + j] + int(a[0, i]) * int(b[0, j])) % p
        assert got == expected


def test_find_on_odd_rows(spark):
    loop = " ".join(["a b c"] * 9)
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "x " * 11), (6, "x " * 12), (7, f"start {loop} end"), (7, f"start {loop} end"), (None, loop), (8, "é　ü " * 20),
             (9, " ".join(["again"] * 40_000)), (10, "w" * 200_000), (11, " ".join(str(i % 900) for i in range(5000))), (12, "x " * 6 + "\x1c " + "x " * 6), (13, "a a a a a b " * 3)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    for c in ("runs", "collapsed", "_words", "start", "period", "w"):
        df = df.withColumn(c, F.lit("clash"))
    got = period_runs.find(df.repartition(3))
    assert sorted(got.columns) == sorted(df.columns)
    rows = got.select("doc_id", "text", "runs", "collapsed", "start").collect()
    assert len(rows) == len(texts) and all(r["start"] == "clash" for r in rows)
    for r in rows:
        found, rest = answer(split(r["text"]))
        assert ([tuple(x) for x in r["runs"]], r["collapsed"]) == (found, rest), r["doc_id"]
    assert period_runs.find(df.limit(0)).collect() == []
    nulls = spark.createDataFrame([([None] * 14 + ["z"],), (None,), ([],)], "w array<string>")
    assert [([tuple(x) for x in r["runs"]], r["collapsed"]) for r in period_runs.find(nulls.coalesce(1), words="w").collect()] == [([(0, 14, 1)], "z"), ([], ""), ([], "")]


def test_query_by_brute_force(spark):
    folder = f"{DATA}/sf0.001"
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        w, h = split(text), zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found, rest = answer(w)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert tuple(got[doc_id]) == (doc_id, len(found), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(rest))
