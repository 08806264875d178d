"""Benchmark decontamination by greedy string tiling.

1. Every window of `SEED` words of a benchmark item is a seed, hashed by a rolling sum of word hashes (Karp-Rabin). A
   bit table of fixed size (1 MB, whatever the number of seeds) goes to all tasks; a document's windows pass it or are
   dropped on the spot, so hardly any text that is not benchmark text is shuffled.
2. A pair that reaches the coverage shares so many of the item's seeds that one of its rarest (by documents) is among them: only those
   make candidates, so a phrase of many items and many documents joins nothing by itself. The windows of the candidates then join
   the seeds, a row for each distinct seed with its places in both texts; matches lie on diagonals.
3. Per pair, the longest run of matches not yet marked is marked again and again, in both texts, until no run of SEED
   words is left. Marked words over the item's words are the coverage; passages that were reordered are still covered.
4. Pairs with at least `COVERAGE` are contaminated.

An item with fewer than SEED words is its own seed: documents that hold it word by word are found. All windows of all texts take
part. Bytes A-Z are lower-cased. Null or empty texts have no words and match nothing. A repeated document row gives the same rows once, unless its id
differs; repeated items likewise. A null id is kept as null. Extra columns are ignored.

A rare seed that very many documents hold all the same is a hot join key; Spark splits it by rows. What a pair carries is bounded by
the lengths of its two texts: places are listed once per seed, and diagonals are walked one item word at a time."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gaugeline.llm.common import fresh, small_batches
from gaugeline.llm.textarrays import mix, shingle_hashes, word_hashes
from gaugeline.session import durable

SEED, COVERAGE = 5, 0.6
BITS = 1 << 23


def windows(col: pa.Array) -> list[tuple[int, np.ndarray, int]]:
    """Per row: number of words, hashes of its windows of SEED words, and a print of the whole sequence."""
    words, off, _ = word_hashes(col)
    out = []
    for a, b in zip(off[:-1], off[1:]):
        w = words[a:b]
        whole = int(mix(w + mix(np.arange(len(w), dtype=np.uint64))).sum(dtype=np.uint64))
        out.append((b - a, shingle_hashes(w, SEED) if b - a >= SEED else w[:0], whole))
    return out


def _rows(id: str, kind, extra: str) -> StructType:
    return StructType([StructField(id, kind), *StructType.fromDDL(extra).fields])


def seeds(items: DataFrame, id: str, text: str) -> DataFrame:
    """(id, print, words, seed, q): every window of every item; the whole of a shorter one."""

    def run(batches):
        for b in batches:
            words, off, _ = word_hashes(b.column(text))
            for i, ((n, h, whole), a) in enumerate(zip(windows(b.column(text)), off[:-1])):
                h = shingle_hashes(words[a:a + n], int(n)) if 0 < n < SEED else h
                k = len(h)
                if k:
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(id)[i].as_py()] * k, b.column(id).type), pa.array(np.full(k, whole, np.uint64).view(np.int64)), pa.array(np.full(k, n, np.int64)),
                                                      pa.array(h.view(np.int64)), pa.array(np.arange(k, dtype=np.int32))], names=[id, "iprint", "item_words", "seed", "q"])

    small_batches(items.sparkSession)
    return items.select(F.col(id), F.col(f"`{text}`").alias(text)).mapInArrow(run, _rows(id, items.schema[id].dataType, "iprint bigint, item_words bigint, seed bigint, q int")).distinct()


def seed_bits(s: DataFrame, bits: int = BITS) -> bytes:
    """A bit per seed, in a table of fixed size."""
    h = s.select((F.pmod(F.col("seed"), F.lit(bits)) + 1).alias("h"))
    out = bytearray(bits // 8 + 4096)
    for r in h.groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect():
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = r["m"]
    return bytes(out)


def hits(docs: DataFrame, bits: bytes, id: str, text: str, sizes: tuple[int, ...] = (SEED,)) -> DataFrame:
    """(id, print, seed, p): the windows of documents, of each of the given sizes, that pass the bit table."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        table = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            rows, prints, found, places = [], [], [], []
            words, off, _ = word_hashes(b.column(text)) if sizes != (SEED,) else (None, np.zeros(b.num_rows, np.int64), None)
            for i, (n, h, whole) in enumerate(windows(b.column(text))):
                every = [h if k == SEED else shingle_hashes(words[off[i]:off[i] + n], k) for k in sizes if n >= k]
                for own in every:
                    at = (own & np.uint64(BITS - 1)).astype(np.int64)
                    p = np.flatnonzero((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                    if len(p):
                        rows.append(np.full(len(p), i))
                        prints.append(np.full(len(p), whole, np.uint64))
                        found.append(own[p])
                        places.append(p)
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(id).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(prints).view(np.int64)), pa.array(np.concatenate(found).view(np.int64)),
                                                  pa.array(np.concatenate(places).astype(np.int32))], names=[id, "dprint", "seed", "p"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id), F.col(f"`{text}`").alias(text)).mapInArrow(run, _rows(id, docs.schema[id].dataType, "dprint bigint, seed bigint, p int"))


def diagonals(met: list[tuple[list[int], list[int]]]) -> list[tuple[int, int, int]]:
    """Runs of matches (windows in a row, first place in document, in item), from the places of each shared seed in both. One item
    word at a time: memory goes with the document's places, not with the pairs of places."""
    place = np.concatenate([np.asarray(p, np.int64) for p, _ in met])
    seed = np.repeat(np.arange(len(met)), [len(p) for p, _ in met])
    order = np.argsort(place, kind="stable")
    place, seed = place[order], seed[order]
    at = [np.flatnonzero(seed == i) for i in range(len(met))] if len(met) < 64 else np.split(np.argsort(seed, kind="stable"), np.cumsum(np.bincount(seed, minlength=len(met)))[:-1])
    follows = np.append(False, place[1:] == place[:-1] + 1)
    of = sorted((q, i) for i, (_, qs) in enumerate(met) for q in qs)
    out, now, last = [], np.zeros(len(place), np.int64), -2
    for q, i in [*of, (None, None)]:
        old, now = now, np.zeros(len(place), np.int64)
        if q is not None:
            hit = at[i]
            before = np.where(follows[hit] & (q == last + 1), old[np.maximum(hit - 1, 0)], 0)
            now[hit] = before + 1
        # Runs that do not go on end here.
        held = np.flatnonzero(old)
        on = np.zeros(len(held), bool)
        inner = held + 1 < len(place)
        on[inner] = now[held[inner] + 1] == old[held[inner]] + 1
        out += [(int(n), int(p) - int(n) + 1, last - int(n) + 1) for n, p in zip(old[held[~on]], place[held[~on]])]
        last = q
    return out


def tile(p: np.ndarray, q: np.ndarray, words: int, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiling of one pair from its matching windows, pair by pair of places: (place in document, place in item, length)."""
    order = np.lexsort((p, p - q))
    p, q = p[order].astype(np.int64), q[order].astype(np.int64)
    cut = np.flatnonzero((np.diff(p - q) != 0) | (np.diff(p) != 1)) + 1
    return greedy([(e - s, int(p[s]), int(q[s])) for s, e in zip(np.append(0, cut), np.append(cut, len(p)))], words, least)


def greedy(runs: list[tuple[int, int, int]], words: int, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles, longest first, from runs of matching windows (windows in a row, first place in document, in item)."""
    heap = [(-(int(n) + least - 1), p, q) for n, p, q in runs]
    heapq.heapify(heap)
    in_doc, in_item, out = set(), np.zeros(words, bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -int(n)
        free = [not in_item[b + j] and a + j not in in_doc for j in range(n)]
        if all(free):
            out.append((a, b, n))
            in_item[b:b + n] = True
            in_doc.update(range(a, a + n))
            continue
        start = None
        for j, ok in enumerate([*free, False]):
            if ok and start is None:
                start = j
            elif not ok and start is not None:
                if j - start >= least:
                    heapq.heappush(heap, (-(j - start), a + start, b + start))
                start = None
    return sorted(out)


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Contaminated pairs: doc_id, item_id, item_words, covered (words), coverage, tiles (document:item:length, places
    in words), and dprint, the print of the document's words."""
    s = durable(seeds(items, item_id, item_text), "seeds")
    short = sorted(r[0] for r in s.where(F.col("item_words") < SEED).select("item_words").distinct().collect())         # SEED - 1 sizes at most
    found = hits(docs, seed_bits(s), doc_id, text, (*short, SEED))
    # A row for each seed of a document and of an item, with all its places.
    found = found.join(s.select("seed").distinct(), "seed", "left_semi").groupBy(doc_id, "dprint", "seed").agg(F.collect_set("p").alias("p"))
    found = durable(found, "hits")
    own = s.groupBy(item_id, "iprint", "item_words", "seed").agg(F.collect_set("q").alias("q"))
    held = found.groupBy("seed").agg(F.count("*").alias("docs"))
    # A pair that reaches the coverage shares ceil(coverage * words / SEED) places of seeds at least, so one of an item's rarest.
    item, need = [item_id, "iprint", "item_words"], F.greatest(F.col("item_words") - SEED + 1 - F.ceil(F.col("item_words") * coverage / SEED) + 1, F.lit(1))
    # Places, not seeds, are counted: a seed that an item repeats stands for all its places.
    place = F.sum(F.size("q")).over(Window.partitionBy(*item).orderBy("docs", "seed")) - F.size("q")
    rare = own.join(held, "seed", "left").withColumn("docs", F.coalesce("docs", F.lit(0))).withColumn("before", place).where(F.col("before") < need).where("docs > 0")
    pairs = found.select(doc_id, "dprint", "seed").join(rare.select("seed", *item), "seed").select(doc_id, "dprint", *item).distinct()
    pairs = pairs.select(F.col(doc_id).alias("_doc"), F.col("dprint").alias("_print"), F.col(item_id).alias("_item"), F.col("iprint").alias("_iprint"))
    both = own.join(pairs, (F.col("iprint") == F.col("_iprint")) & F.col(item_id).eqNullSafe(F.col("_item"))).withColumnRenamed("seed", "_seed").drop("_item", "_iprint")
    joined = both.join(found, (F.col("_seed") == F.col("seed")) & (F.col("_print") == F.col("dprint")) & F.col("_doc").eqNullSafe(F.col(doc_id)))
    met = joined.groupBy(doc_id, "dprint", *item).agg(F.collect_list(F.struct("p", "q")).alias("m"))
    # Each matching window adds SEED words at most: pairs that cannot reach the coverage are dropped unread.
    met = met.where(F.aggregate("m", F.lit(0), lambda a, x: a + F.size(x["q"])) * SEED >= F.col("item_words") * coverage)

    def run(batches):
        for b in batches:
            covered, tiles = [], []
            for m, n in zip(b.column("m").to_pylist(), b.column("item_words").to_pylist()):
                t = greedy(diagonals([(x["p"], x["q"]) for x in m]), n, min(SEED, n))
                covered.append(sum(x[2] for x in t))
                tiles.append(",".join(f"{x}:{y}:{k}" for x, y, k in t))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (doc_id, item_id, "item_words")), pa.array(covered, pa.int64()), pa.array(tiles, pa.string()), b.column("dprint")],
                                             names=[doc_id, item_id, "item_words", "covered", "tiles", "dprint"])

    out = StructType([StructField(doc_id, docs.schema[doc_id].dataType), StructField(item_id, items.schema[item_id].dataType),
                      StructField("item_words", LongType()), *StructType.fromDDL("covered bigint, tiles string, dprint bigint").fields])
    tiled = met.select(doc_id, item_id, "item_words", "m", "dprint").mapInArrow(run, out)
    return tiled.withColumn("coverage", F.col("covered") / F.col("item_words")).where(F.col("coverage") >= coverage)


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The documents without a contaminated pair. A document row is told by id and text print, so of rows that share an
    id only those with benchmark text go; a null id is an id here."""
    bad = matches(docs, items, doc_id=doc_id, text=text, **kw).select(F.col(doc_id).alias("_id"), F.col("dprint").alias("_p")).distinct()

    name = fresh(docs, "_print")

    def run(batches):
        for b in batches:
            prints = np.array([x[2] for x in windows(b.column(text))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints)], [*b.schema.names, name])

    small_batches(docs.sparkSession)
    own = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))
    return own.join(bad, own[doc_id].eqNullSafe(bad["_id"]) & (own[name] == bad["_p"]), "left_anti").drop(name)
