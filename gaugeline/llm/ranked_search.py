"""Ranked lexical search: the k highest-scoring documents of every query text, exactly, by range-maximum bounds.

Scores. A document's score for a query sums, over the query's terms with repeats, w * ((10^9 * tf) div (1000 * tf + 8 * m)),
where w = floor(1000 * ln((2N + 2) / (2 df + 1))) and m = 25 + (75 * n * N) div L; N documents hold a term at all, L is
the length of all in terms, n of one, df the documents with the term, tf its occurrences in one. Equal scores rank by ascending id.

Method. 1. Documents become index rows: number of terms, and number and frequency of each query term they hold. One aggregate
gives N and L, one count df. 2. Index rows are searched in blocks of documents in id order. Within a block every term has a
posting list in that order with the list's impacts, and a sparse table of the places of range maxima, so the largest impact
in any interval of documents takes two look-ups. The sum of a query's maxima bounds the score of every document of an
interval. Intervals wait in a heap, best bound first; the best one is split at the document of maximum impact for the term
that adds most, this document is scored, and the two intervals left are bounded by the tables anew. A query is done with
a block when the best bound cannot beat its k-th document. The k-th score goes from block to block of a task, and starts from
the k-th best of one document in `FIRST` (which can only be lower), so most intervals are never opened. 3. The best of all
tasks are ranked.

Queries are searched in blocks of `QUERY_BYTES` of text (or one query, where that is longer), each block against all
documents; equal query texts are searched once. Nothing else is held whole; nothing is capped or skipped.

Nulls: a null or termless text has no terms; as a document it does not count for N and never matches, as a query it has no
rows. A null document id ranks behind others of its score; a null or repeated item id gets its own rows like any other. Every
row is a document of its own, repeated or not. Extra columns are ignored. Empty tables give no rows. Terms are compared by
64-bit hashes."""

from __future__ import annotations

import heapq
import math
from bisect import insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gaugeline.llm.common import small_batches
from gaugeline.llm.textarrays import word_hashes
from gaugeline.session import durable

_BYTES = np.arange(256)
#: Bytes that separate terms: ASCII but letters and digits.
BREAK = (_BYTES < 0x30) | ((_BYTES >= 0x3A) & (_BYTES <= 0x40)) | ((_BYTES >= 0x5B) & (_BYTES <= 0x60)) | ((_BYTES >= 0x7B) & (_BYTES <= 0x7F))
QUERY_BYTES = 1 << 20          # query text that is searched at a time
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 20
GROUP, STEP = 64, 256          # queries whose heaps are worked on together; intervals split at a time
FIRST = 32                     # one document in so many gives the first k-th scores


def terms_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and where each row's begin."""
    hashes, off, _ = word_hashes(col, space=BREAK)
    return hashes, off


class Queries:
    """A block of query texts as term numbers: vocabulary (sorted hashes), and per query its distinct terms with counts."""

    def __init__(self, texts: list[str]):
        hashes, off = terms_of(pa.array(texts, pa.string()))
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        self.terms = [np.unique(number[a:b], return_counts=True) for a, b in zip(off[:-1], off[1:])]

    def groups(self):
        """(query numbers, term numbers, counts) as rectangles of queries with about equally many terms; -1 where there is none."""
        order = sorted((q for q in range(len(self.terms)) if len(self.terms[q][0])), key=lambda q: len(self.terms[q][0]))
        for i in range(0, len(order), GROUP):
            own = order[i:i + GROUP]
            width = max(len(self.terms[q][0]) for q in own)
            t, c = np.full((len(own), width), -1), np.zeros((len(own), width), np.int64)
            for r, q in enumerate(own):
                n = len(self.terms[q][0])
                t[r, :n], c[r, :n] = self.terms[q]
            yield own, t, c


def index(docs: DataFrame, id: str, text: str, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row whose text has a term."""
    kind = StructType([StructField("doc_id", docs.schema[id].dataType), *StructType.fromDDL("n bigint, terms array<int>, tfs array<int>").fields])

    def run(batches):
        for b in batches:
            hashes, off = terms_of(b.column(1))
            n = np.diff(off)
            at = np.searchsorted(vocabulary, hashes)
            hit = vocabulary[np.minimum(at, len(vocabulary) - 1)] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
            row = np.repeat(np.arange(len(n)), n)[hit]
            pair, tf = np.unique(row * max(len(vocabulary), 1) + at[hit], return_counts=True)
            row, term = np.divmod(pair, max(len(vocabulary), 1))
            lists = np.append(0, np.cumsum(np.bincount(row, minlength=len(n))))
            made = [pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(v, pa.int32())) for v in (term, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *made], ["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    small_batches(docs.sparkSession)
    return docs.select(id, text).mapInArrow(run, kind)


class Block:
    """Posting lists of a block of documents, in id order, with impacts and the sparse tables of their range maxima."""

    def __init__(self, lengths: np.ndarray, rows: np.ndarray, terms: np.ndarray, tfs: np.ndarray, size: int, documents: int, total: int):
        m = 25 + 75 * lengths * documents // total
        self.docs = len(lengths)
        key = terms * self.docs + rows
        order = np.argsort(key)
        self.key, tf = key[order], tfs[order]
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[rows[order]])
        self.start = np.searchsorted(self.key, np.arange(size + 1) * self.docs)
        longest = int(np.diff(self.start).max(initial=1))
        self.log = np.zeros(longest + 1, np.int64)
        for i in range(1, longest.bit_length()):
            self.log[1 << i:] = i
        n, tables = len(key), [np.arange(len(key), dtype=np.int32)]
        for j in range(1, longest.bit_length()):
            below, half = tables[-1], 1 << (j - 1)
            a, b = below[:n - half], below[half:]
            level = below.copy()
            level[:n - half] = np.where(self.impact[b] > self.impact[a], b, a)
            tables.append(level)
        self.table, self.width = np.concatenate(tables), n

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest impact, its place) among the postings lo to hi - 1; 0 where there are none."""
        some = hi > lo
        j = self.log[np.where(some, hi - lo, 1)] * self.width
        a, b = self.table[np.where(some, j + lo, 0)], self.table[np.where(some, j + hi - (1 << (j // self.width)), 0)]
        at = np.where(self.impact[b] > self.impact[a], b, a)
        return np.where(some, self.impact[at], 0), at


class Best:
    """The k best documents of a query so far: (-score, id is null, id)."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.kept = k, floor, []

    def may_hold(self, bound: int, id) -> bool:
        """Could a document of this score, with this id or a larger one, be among the best?"""
        if bound < max(self.floor, 1):
            return False
        return len(self.kept) < self.k or (-bound, id is None, 0 if id is None else id) < self.kept[-1]

    def add(self, score: int, id) -> None:
        insort(self.kept, (-score, id is None, 0 if id is None else id))
        del self.kept[self.k:]


def search_block(block: Block, ids: list, queries: list[int], terms: np.ndarray, weights: np.ndarray, best: list[Best]) -> int:
    """Best-first search of one block for a group of queries; returns the intervals split."""
    if not block.width:
        return 0
    own = np.where(terms >= 0, terms, 0)
    base = own * block.docs
    lo, hi = np.where(terms >= 0, block.start[own], 0), np.where(terms >= 0, block.start[own + 1], 0)
    heaps: list[list] = [[] for _ in queries]

    def push(q: np.ndarray, first: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        value, at = block.largest(lo, hi)
        adds = value * weights[q]
        bound = adds.sum(axis=1)
        split = block.key[at[np.arange(len(q)), adds.argmax(axis=1)]] % block.docs
        for i in np.flatnonzero(bound).tolist():
            k, b, a = int(q[i]), int(bound[i]), int(first[i])
            if best[queries[k]].may_hold(b, ids[a]):
                heapq.heappush(heaps[k], (-b, a, int(split[i]), lo[i], hi[i]))

    push(np.arange(len(queries)), np.zeros(len(queries), np.int64), lo, hi)
    active, done = [k for k in range(len(queries)) if heaps[k]], 0
    while active:
        taken = []
        for k in active:
            b, h = best[queries[k]], heaps[k]
            for _ in range(max(1, STEP // len(active))):
                if not h:
                    break
                if not b.may_hold(-h[0][0], ids[h[0][1]]):
                    if -h[0][0] < -b.kept[-1][0] if len(b.kept) == b.k else -h[0][0] < b.floor:
                        h.clear()            # bounds only fall from here
                        break
                    heapq.heappop(h)
                    continue
                taken.append((k, heapq.heappop(h)))
        if taken:
            done += len(taken)
            q = np.array([k for k, _ in taken])
            a, d = (np.array([x[i] for _, x in taken]) for i in (1, 2))
            lo, hi = np.stack([x[3] for _, x in taken]), np.stack([x[4] for _, x in taken])
            mark = base[q] + d[:, None]
            at = np.clip(np.searchsorted(block.key, mark), lo, hi)
            near = np.minimum(at, block.width - 1)
            here = (at < hi) & (block.key[near] == mark)
            score = (np.where(here, block.impact[near], 0) * weights[q]).sum(axis=1)
            for k, s, x in zip(q.tolist(), score.tolist(), d.tolist()):
                b = best[queries[k]]
                if b.may_hold(s, ids[x]):
                    b.add(s, ids[x])
            left = d > a
            push(np.concatenate([q[left], q]), np.concatenate([a[left], d + 1]), np.concatenate([lo[left], at + here]), np.concatenate([at[left], hi]))
        active = [k for k in active if heaps[k]]
    return done


def _blocks(batches):
    """Batches joined until they fill a block."""
    held, docs, postings = [], 0, 0
    for b in batches:
        held.append(b)
        docs += b.num_rows
        postings += len(b.column(2).flatten())
        if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, docs, postings = [], 0, 0
    if docs:
        yield pa.Table.from_batches(held).combine_chunks()


def _searched(rows: DataFrame, q: Queries, weight: np.ndarray, documents: int, total: int, k: int, floors: list[int]) -> DataFrame:
    """(query, doc_id, score): the best of every task for every query."""
    kind = StructType([StructField("query", LongType()), rows.schema["doc_id"], StructField("score", LongType())])
    groups = [(own, t, np.where(t >= 0, weight[np.maximum(t, 0)], 0) * c) for own, t, c in q.groups()]
    size = len(q.vocabulary)

    def run(batches):
        best = [Best(k, f) for f in floors]
        typed = None
        for t in _blocks(batches):
            t = t.take(pc.sort_indices(t, [("doc_id", "ascending")], null_placement="at_end"))
            typed = t.column("doc_id").type
            terms, tfs = (t.column(c).combine_chunks() for c in ("terms", "tfs"))
            n = np.asarray(terms.value_lengths()).astype(np.int64)
            flat = [np.asarray(v.flatten()).astype(np.int64) for v in (terms, tfs)]
            block = Block(np.asarray(t.column("n")).astype(np.int64), np.repeat(np.arange(len(n)), n), *flat, size, documents, total)
            ids = [*t.column("doc_id").to_pylist(), None]
            for own, term, w in groups:
                search_block(block, ids, own, term, w, best)
        found = [(i, None if null else id, -s) for i, b in enumerate(best) for s, null, id in b.kept]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], typed), pa.array([f[2] for f in found], pa.int64())], ["query", "doc_id", "score"])

    return rows.mapInArrow(run, kind)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _answer(docs: DataFrame, texts: list[str], prints: list[str], k: int, id: str, text: str) -> DataFrame:
    """(print, rank, doc_id, score) of one block of queries."""
    spark, q = docs.sparkSession, Queries(texts)
    rows = durable(index(docs, id, text, q.vocabulary), "postings")
    documents, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(q.vocabulary), np.int64)
    for t, c in rows.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():      # one row a query term at most
        df[t] = c
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(c) + 1))) for c in df], np.int64)
    floors, names = [0] * len(texts), StructType([StructField("query", LongType()), StructField("print", StringType())])
    few = rows.where(F.expr(f"pmod(xxhash64(doc_id), {FIRST}) = 0"))
    kth = _ranked(_searched(few, q, weight, documents, max(total, 1), k, floors), k).where(F.col("rank") == k)
    for r in kth.select("query", "score").toLocalIterator():                                               # one row a query at most
        floors[r[0]] = r[1]
    best = _ranked(_searched(rows, q, weight, documents, max(total, 1), k, floors), k)
    return best.join(F.broadcast(spark.createDataFrame(list(enumerate(prints)), names)), "query").select("print", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item id, rank, document id, score): up to k documents with a score above 0 for every row of `items`."""
    asked = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("body")).where("body is not null")
    texts = durable(asked.select("body").distinct().withColumn("print", F.sha2("body", 256)), "queries")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    parts = -(-size // query_bytes)
    found = None
    for p in range(parts):
        own = texts.where(F.expr(f"pmod(xxhash64(print), {parts}) = {p}")).collect()           # about query_bytes of text
        if own:
            part = _answer(docs, [r["body"] for r in own], [r["print"] for r in own], k, id, text)
            part = durable(part, "ranked") if parts > 1 else part
            found = part if found is None else found.unionByName(part)
    if found is None:
        none = StructType([items.schema[item], StructField("rank", docs.schema[id].dataType)])
        return items.sparkSession.createDataFrame([], none).select(F.col(f"`{item}`").alias(item), F.lit(0).alias("rank"), F.col("rank").alias(id), F.lit(0).cast("long").alias("score"))
    ranked = asked.select("item", F.sha2("body", 256).alias("print")).join(found, "print")
    return ranked.select(F.col("item").alias(item), "rank", F.col("doc_id").alias(id), "score")
