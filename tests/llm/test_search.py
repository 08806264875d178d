"""Ranked lexical search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_brute_force(docs, items, k=10):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    held = [h for h in held if h[2]]
    n, total, df = len(held), sum(h[2] for h in held), Counter()
    for _, c, _ in held:
        df.update(c.keys())
    out = []
    for item, text in items:
        scores = []
        for d, c, size in held:
            m = 25 + 75 * size * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(terms(text)).items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def frames(spark, docs, items):
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for c in ("n", "terms", "tfs", "query", "print", "score", "rank", "item", "body"):
        d, i = d.withColumn(c, F.lit("clash")), i.withColumn(c, F.lit("clash"))
    return d.repartition(3), i


def prose(r, n, words=400):
    return " ".join(f"w{min(int(r.expovariate(1) * words / 6), words)}" for _ in range(n))


@pytest.mark.parametrize("query_bytes", [1 << 20, 300])
def test_equals_scoring_all(spark, monkeypatch, query_bytes):
    r = random.Random(4)
    docs = [(i, prose(r, r.choice([0, 1, 5, 40, 200]))) for i in range(300)]
    docs += [(1000 + i, "Tie tie TIE-breaker ünïcode É w3") for i in range(30)] + [(5, "repeated id w1 w2"), (5, "repeated id w1 w2"), (None, "no id w7 w8"), (None, None), (600, "_-.\x00"), (601, "x" * 70_000),
                                                                               (602, "w9 " * 30_000), (603, "日本語。w4_w5")]
    items = [(i, prose(r, r.choice([1, 3, 20, 60]))) for i in range(25)]
    items += [(90, "tie"), (91, "TIE ünïcode É"), (91, "TIE ünïcode É"), (None, "w7 no"), (92, None), (93, ""), (94, "--"), (95, "nowhere"), (96, "x" * 70_000), (97, "w9 w9 w9 w1"), (98, "日本語。")]
    d, i = frames(spark, docs, items)
    got = Counter(tuple(x) for x in ranked_search.search(d, i, query_bytes=query_bytes).select("item_id", "rank", "doc_id", "score").collect())
    assert got == by_brute_force(docs, items)


def test_nothing(spark):
    d, i = frames(spark, [(1, "a b")], [(1, "a")])
    for docs, items in ((d.limit(0), i), (d, i.limit(0)), (d, i.where("item_id = 7"))):
        got = ranked_search.search(docs, items)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_blocks(seed):
    """One block and many, with a first k-th score and without: the same documents, and far from all intervals opened."""
    r = np.random.default_rng(seed)
    n, size, k = 600, 50, 10
    counts = (r.poisson(0.08, (n, size)) * (r.random((n, size)) < 0.7)).astype(np.int64)
    lengths = counts.sum(axis=1) + r.integers(5, 60, n)
    weight = r.integers(0, 5000, size)
    asked = [np.unique(r.integers(0, size, 6), return_counts=True) for _ in range(12)]
    m = 25 + 75 * lengths * n // lengths.sum()
    score = np.array([(weight[t] * c * (10**9 * counts[:, t] // (1000 * counts[:, t] + 8 * m[:, None]))).sum(axis=1) for t, c in asked])
    expected = [sorted((-int(s), False, i) for i, s in enumerate(x) if s)[:k] for x in score]
    terms = np.full((12, 6), -1)
    w = np.zeros((12, 6), np.int64)
    for q, (t, c) in enumerate(asked):
        terms[q, :len(t)], w[q, :len(t)] = t, weight[t] * c
    floors = [-e[-1][0] if seed % 2 and len(e) == k else 0 for e in expected]
    best, split, step = [ranked_search.Best(k, f) for f in floors], 0, [600, 100, 7][seed % 3]
    for a in range(0, n, step):
        own = counts[a:a + step]
        rows, cols = np.nonzero(own)
        block = ranked_search.Block(lengths[a:a + step], rows, cols, own[rows, cols], size, n, int(lengths.sum()))
        for t in range(size):                                             # the tables against plain maxima
            lo, hi = block.start[t], block.start[t + 1]
            for x, y in ((lo, hi), (lo, (lo + hi) // 2), ((lo + hi) // 2, hi)):
                value = block.largest(np.array([x]), np.array([y]))[0][0]
                assert value == (block.impact[x:y].max() if y > x else 0)
        split += ranked_search.search_block(block, [*range(a, a + len(own)), None], list(range(12)), terms, w, best)
    assert [b.kept for b in best] == expected
    assert split < (score > 0).sum()
