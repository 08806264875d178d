"""Exact n-gram Jaccard join: documents whose shingle sets overlap by at least `PERCENT` of their union, and classes of them.

The incidence matrix of documents and shingles is multiplied with itself in blocks of shingle columns:

1. Every batch of documents is one block row: per document the size of its set, the 128-bit print of the set (equal sets
   are one class from here on) and its shingles with the smallest hashes (a third of all, chosen by hash, so that two
   documents choose alike).
2. Column blocks are ranges of hashes. A batch sends each block its distinct shingles once, whatever their number of
   documents, and gets their document counts back, one byte each. No shingle, however frequent, is a hot key.
3. With the counts every set is ordered from rare to frequent. Two sets that link share a shingle among the first few
   (size - ceil(0.8 * size) + 1), so only those entries stay, less those found in one document only. Most documents
   have none left and are done.
4. Sets with such entries are few. They are read again whole and multiplied in the same way, now with all their
   shingles: a set with too many shingles of its own cannot link at all, and the rest are ordered over all shingles.
5. Remaining entries meet by shingle. Pairs are discarded by size-derived bounds: sizes and places in the order
   must still allow the overlap 9 * overlap >= 4 * (size + size) asks for. What passes is counted in full on the whole
   sets: first with the set of each shingle that has the smallest part of its own (the middle of a family of near
   copies), then all pairs that are still in different classes (see `linking`).

Results are exact (up to 64-bit hash collisions); no cap, sample or prefix of a text is used.

Null text, or one without words: empty set, linked with nothing. Fewer words than N: the whole sequence is the one
shingle. Repeated rows link as equal sets. A null id counts as larger than all: it is never a class' smallest id unless
all are null. Extra columns are ignored."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gaugeline.llm import linking
from gaugeline.llm.common import add_columns, in_files, small_batches
from gaugeline.llm.textarrays import set_print, shingle_hashes, word_hashes
from gaugeline.session import durable

N, PERCENT = 5, 80
SHARE, ALL = int(0.35 * 2**64), 2**64      # hashes below take part in the counting: first a third, then all
ROW_TOKENS, BLOCK_TOKENS = 150_000, 750_000
#: What a written file holds at least: text behind block rows, shingles behind entries, whole sets.
FILE_BYTES, FILE_TOKENS, FILE_SETS = 8 << 20, 1_000_000, 5_000
BITS = 1 << 23                             # of the filter for documents that are read again: 1 MB whatever the input


def least_overlap(n: int) -> int:
    return -(-PERCENT * n // 100)


def shingle_sets(col: pa.Array, n: int = N) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    words, off, _ = word_hashes(col)
    return [np.unique(shingle_hashes(words[a:b], n)) for a, b in zip(off[:-1], off[1:])]


def _block_rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    """One row per batch: documents (id, size, print) and their chosen shingles, joined end to end."""

    def run(batches):
        task, serial = TaskContext.get().partitionId(), 0
        ids, sizes, prints, tokens, held = [], [], [], [], 0

        def row():
            counts = np.array([len(t) for t in tokens], "<i4")
            d = pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())], names=["id", "n", "cls"])
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 33 | serial], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(d)], pa.int32()), d), pa.array([counts.tobytes()], pa.binary()),
                 pa.array([np.concatenate(tokens).astype("<u8").tobytes()], pa.binary()), pa.array([int(counts.sum())], pa.int64())],
                names=["bid", "docs", "counts", "tokens", "n_tokens"])

        for b in batches:
            if not len(b):
                continue
            ids.append(b.column(id))
            for s in shingle_sets(b.column(text)):
                n = len(s)
                sizes.append(n)
                prints.append(set_print(s))
                take = max(int(np.searchsorted(s, np.uint64(SHARE))), n - least_overlap(n) + 1) if n >= 4 else 0    # smaller sets link only when equal
                tokens.append(s[:take])
                held += take
            if held >= ROW_TOKENS:
                yield row()
                serial += 1
                ids, sizes, prints, tokens, held = [], [], [], [], 0
        if ids:
            yield row()

    small_batches(docs.sparkSession)
    kinds = docs.select(F.lit(0).cast("bigint").alias("bid"), F.array(F.struct(F.col(id).alias("id"), F.lit(0).cast("bigint").alias("n"), F.lit(b"").alias("cls"))).alias("docs"),
                        F.lit(b"").alias("counts"), F.lit(b"").alias("tokens"), F.lit(0).cast("bigint").alias("n_tokens")).schema
    return docs.select(F.col(id), F.col(f"`{text}`").alias(text)).mapInArrow(run, _nullable(kinds))


def _nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])


def _set_rows(sets: DataFrame) -> DataFrame:
    """Block rows of whole sets."""

    def run(batches):
        task, serial, held, nodes, tokens = TaskContext.get().partitionId(), 0, 0, [], []

        def row():
            counts = np.array([len(t) for t in tokens], "<i4")
            d = pa.StructArray.from_arrays([pa.nulls(len(nodes), pa.int64()), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary())], names=["id", "n", "cls"])
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 33 | serial], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(d)], pa.int32()), d), pa.array([counts.tobytes()], pa.binary()),
                 pa.array([np.concatenate(tokens).tobytes()], pa.binary()), pa.array([int(counts.sum())], pa.int64())], names=["bid", "docs", "counts", "tokens", "n_tokens"])

        for b in batches:
            for node, s in zip(b.column("node").to_pylist(), b.column("set").to_pylist()):
                nodes.append(node)
                tokens.append(np.frombuffer(s, "<u8"))
                held += len(tokens[-1])
                if held >= ROW_TOKENS:
                    yield row()
                    serial, held, nodes, tokens = serial + 1, 0, [], []
        if nodes:
            yield row()

    small_batches(sets.sparkSession)
    return sets.select("node", "set").mapInArrow(run, "bid bigint, docs array<struct<id:bigint,n:bigint,cls:binary>>, counts binary, tokens binary, n_tokens bigint")


def _below(tokens: np.ndarray, share: int) -> np.ndarray:
    return np.ones(len(tokens), bool) if share == ALL else tokens < np.uint64(share)


def _requests(rows: DataFrame, blocks: int, share: int) -> DataFrame:
    """Per batch and block: the distinct shingles of the batch in that range and in how many of its documents they are."""

    def run(batches):
        cuts = np.array([share * i // blocks for i in range(1, blocks)], np.uint64)
        for b in batches:
            for bid, t in zip(b.column("bid").to_pylist(), b.column("tokens").to_pylist()):
                v, c = np.unique(np.frombuffer(t, "<u8"), return_counts=True)
                keep = _below(v, share)
                v, c = v[keep], np.minimum(c[keep], 2**31 - 1).astype("<i4")
                at = [0, *np.searchsorted(v, cuts).tolist(), len(v)]
                full = [i for i in range(blocks) if at[i + 1] > at[i]]
                yield pa.RecordBatch.from_arrays([pa.array([bid] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([v[at[i]:at[i + 1]].tobytes() for i in full], pa.binary()),
                                                  pa.array([c[at[i]:at[i + 1]].tobytes() for i in full], pa.binary())], names=["bid", "block", "tokens", "counts"])

    return rows.select("bid", "tokens").mapInArrow(run, "bid bigint, block int, tokens binary, counts binary")


def _counted(t: pa.Table) -> pa.Table:
    """Counts of one block, back to each batch: one byte a shingle, exact up to 127, then by powers of 2**(1/4)."""
    parts = [np.frombuffer(x, "<u8") for x in t.column("tokens").to_pylist()]
    weights = np.concatenate([np.frombuffer(x, "<i4") for x in t.column("counts").to_pylist()])
    _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(inverse, weights)
    level = np.where(total < 128, total, np.minimum(128 + 4 * np.log2(np.maximum(total, 128) / 128), 255)).astype(np.uint8)[inverse]
    out, at = [], 0
    for p in parts:
        out.append(level[at:at + len(p)].tobytes())
        at += len(p)
    return pa.table({"bid": t.column("bid"), "block": t.column("block"), "levels": pa.array(out, pa.binary())})


def _entries(left: pa.Table, right: pa.Table, share: int) -> pa.Table:
    """Entries of one batch that can still meet another document: (key, node, n, rank, lead, far). `far` is the part of
    the counted shingles that no other document has, in thousandths."""
    keys, nodes, sizes, ranks, own_part = [], [], [], [], []
    if len(left):
        order = np.argsort(right.column("block").to_numpy()) if len(right) else []
        levels = right.column("levels").to_pylist()
        level = np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(levels[i], np.uint8) for i in order)])
        tokens = np.frombuffer(left.column("tokens")[0].as_py(), "<u8")
        distinct = np.unique(tokens)
        distinct = distinct[_below(distinct, share)]
        of_token = np.full(len(tokens), 256, np.int64)                  # uncounted: after all counted ones
        low = _below(tokens, share)
        if len(distinct):
            of_token[low] = level[np.searchsorted(distinct, tokens[low])]
        at = 0
        for d, c in zip(left.column("docs")[0].as_py(), np.frombuffer(left.column("counts")[0].as_py(), "<i4")):
            own, lv, n = tokens[at:at + c], of_token[at:at + c], d["n"]
            at += c
            if not c or n < 4:
                continue
            first = np.argsort(lv, kind="stable")[:n - least_overlap(n) + 1]      # own is sorted: ties by hash
            shared = np.flatnonzero(lv[first] > 1)
            keys.append(own[first[shared]])
            ranks.append(shared)
            sizes.append(np.full(len(shared), n))
            nodes.extend([d["cls"]] * len(shared))
            own_part.append(np.full(len(shared), int((lv == 1).sum()) * 1000 // len(lv)))
    cat = lambda x, t: np.concatenate([np.empty(0, t), *x]).astype(t)
    n, r = cat(sizes, np.int64), cat(ranks, np.int64)
    return pa.table({"key": pa.array(cat(keys, np.uint64).view(np.int64)), "node": pa.array(nodes, pa.binary()), "n": pa.array(n), "rank": pa.array(r),
                     "lead": pa.array(9 * (n - r) >= 8 * n), "far": pa.array(cat(own_part, np.int64))})


def _multiply(rows: DataFrame, share: int, finish) -> DataFrame:
    """Counts of all shingles of the block rows, handed to `finish` batch by batch."""
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    levels = _requests(rows, max(math.ceil(total / BLOCK_TOKENS), 1), share).groupBy("block").applyInArrow(_counted, "bid bigint, block int, levels binary")
    both = rows.groupBy("bid").cogroup(levels.groupBy("bid"))
    return in_files(both.applyInArrow(lambda left, right: finish(left, right, share), ENTRY), total, FILE_TOKENS)


ENTRY = "key bigint, node binary, n bigint, rank bigint, lead boolean, far bigint"


def meeting(entries: DataFrame) -> DataFrame:
    """The entries of shingles at which two sets can meet."""
    met = entries.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.max("lead").alias("lead")).where("a <> b and lead").select("key")
    return entries.join(met, "key", "left_semi")


def whole_entries(sets: DataFrame) -> DataFrame:
    """Entries of a written table of whole sets (node, set), ordered over all shingles."""
    return durable(_multiply(durable(_set_rows(sets), "rows"), ALL, _entries), "entries")


def _may_link(x: str, y: str) -> str:
    """Sizes and places still allow the overlap; x is the smaller."""
    need = f"4 * ({x}.n + {y}.n)"
    return f"(9 * ({x}.n - {x}.rank) >= {need} and 9 * ({y}.n - {y}.rank) >= {need})"


def bit_table(ids: DataFrame, bits: int = BITS, hashed: bool = False) -> bytes:
    """A bit per hashed id, `bits` in all: what comes to the driver and goes to the tasks has that size at most. hashed:
    the ids are 64-bit hashes already."""
    h = ids.select((F.pmod(F.col(ids.columns[0]) if hashed else F.xxhash64(ids.columns[0]), F.lit(bits)) + 1).alias("h"))     # the bitmap functions count from 1
    parts = h.groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect()
    out = bytearray(bits // 8 + 4096)
    for r in parts:
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = r["m"]
    return bytes(out)


def marked(table: bytes, hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which of the hashes (already reduced to the table's bits) are marked."""
    raw, h = np.frombuffer(table, np.uint8), hashes
    return (raw[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1


def _sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame, id: str, text: str) -> DataFrame:
    """(node, set) of the given classes, from one document of each."""
    one = nodes.join(classes, nodes["node"] == classes["cls"]).select("first").where("first is not null")
    filt = docs.sparkSession.sparkContext.broadcast(bit_table(one))
    has_null = nodes.join(classes, nodes["node"] == classes["cls"]).where("first is null").limit(1).count() > 0

    def run(batches):
        for b in batches:
            h = b.column("_h")
            keep = marked(filt.value, h.fill_null(0).to_numpy(zero_copy_only=False)) & h.is_valid().to_numpy(zero_copy_only=False)
            if has_null:
                keep |= h.is_null().to_numpy(zero_copy_only=False)
            t = b.column(text).filter(pa.array(keep))
            if len(t):
                s = shingle_sets(t)
                yield pa.RecordBatch.from_arrays([pa.array([set_print(x) for x in s], pa.binary()), pa.array([x.astype("<u8").tobytes() for x in s], pa.binary())], names=["node", "set"])

    read = docs.select(F.when(F.col(id).isNotNull(), F.pmod(F.xxhash64(id), F.lit(BITS))).alias("_h"), F.col(f"`{text}`").alias(text))
    own = read.mapInArrow(run, "node binary, set binary").join(nodes, "node", "left_semi")
    return durable(in_files(own.groupBy("node").agg(F.first("set").alias("set")), nodes.count(), FILE_SETS), "sets")


def _verifier(sets: DataFrame):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        sa, sb = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
        small_batches(pairs.sparkSession, 64)
        return pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")

    return verify


def with_print(df: DataFrame, text: str = "text", out: str = "print") -> DataFrame:
    """Append the print of every row's shingle set, null for an empty set."""

    def fn(b):
        return {out: pa.array([set_print(s) if len(s) else None for s in shingle_sets(b.column(text))], pa.binary())}

    return add_columns(df, fn, f"`{out}` binary")


def classify(docs: DataFrame, id: str = "doc_id", text: str = "text", detail: bool = False) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links, itself included). detail: also `print` (of the
    row's set) and `component` (the print that names its class), both null for an empty set."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).first()
    rows = durable(_block_rows(in_files(docs, size, FILE_BYTES), id, text), "blocks")
    some = meeting(durable(_multiply(rows, SHARE, _entries).select("key", "node", "lead"), "entries"))
    active = durable(in_files(some.select("node").distinct(), n, linking.FILE_ROWS), "active")
    flat = rows.select(F.explode("docs").alias("d")).select(F.col("d.id").alias(id), F.col("d.n").alias("n_shingles"), F.col("d.cls").alias("cls"))
    classes = flat.where("n_shingles > 0").groupBy("cls").agg(F.min(id).alias("first"))
    sets = _sets(docs, active, classes, id, text)
    entries = whole_entries(sets)
    members = durable(in_files(meeting(entries), entries.count(), linking.FILE_ROWS), "members")
    comp = linking.link(members, _verifier(sets), _may_link)
    least = classes.join(comp, classes["cls"] == comp["node"], "left").select("cls", "first", F.coalesce("comp", "cls").alias("comp"))
    smallest = least.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_class = least.join(smallest, "comp").select("cls", "component_id", "comp")
    linked = flat.where("n_shingles > 0").join(by_class, "cls")
    alone = flat.where("n_shingles = 0").withColumn("component_id", F.col(id))
    own = [F.col("cls").alias("print"), F.col("comp").alias("component")] if detail else []
    none = [F.lit(None).cast("binary").alias(c) for c in ("print", "component")] if detail else []
    return linked.select(id, "n_shingles", "component_id", *own).unionByName(alone.select(id, "n_shingles", "component_id", *none))
