"""Repeated passages: lines that occur again, exactly or nearly, and runs of words that occur again wherever they stand.

Paragraphs are the lines of a text with at least `N` words (shorter ones have no shingle; they count inside runs of words).
Equal word-shingle sets are one class from the start. For the rest MinHash signatures are cut into `BANDS` bands of `ROWS`
rows: at a similarity of 0.8 the chance of no common band is (1 - 0.8**4)**14 = 0.06 %. Sets of up to `FEW` shingles meet at
their least hashes instead, so many that two similar sets have one in common; sizes near the limit have both. Paragraphs of
a common key are compared on their whole shingle sets (Jaccard of 0.8 or more, five words): first with the middle of the
key's family, then those still in different classes that share a shingle among their rarest, without which two sets cannot
link. Linked paragraphs form components, of which the first occurrence (smallest document, then place) stays and all others
are removed.

Runs of words: every window of `LONG` words that occurs twice is found, inside lines and across them. The least hash of
every `LONG` - `SEED` + 1 neighbouring windows of `SEED` words is an anchor, so two equal long windows have an equal anchor; long
windows around repeated anchors are then counted by their own hashes, which needs no pairs. The first occurrence of a window
(smallest document, then word) stays; neighbouring windows whose first occurrence is in the same document are one passage.
A window that overlaps the first one like it in its document is no occurrence, nor is one whose words all go with lines.

Hot passages: copies meet as one class before any join; a band of k near copies is compared with its pivot, not in
pairs (see `linking`). Occurrences are counted by partial sums, and the join back is one that Spark splits by rows.

A null or empty text has no paragraphs. Repeated rows count as occurrences. A null id comes after all others as the place
of the first occurrence. Extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gaugeline.llm import linking, ngram_join
from gaugeline.llm.common import small_batches
from gaugeline.llm.textarrays import mix, shingle_hashes, word_hashes
from gaugeline.session import durable

N, BANDS, ROWS = 5, 14, 4
LEAST = 4                  # shingles below which two different sets cannot reach the similarity
FEW, MANY = 45, 36         # sets of up to FEW shingles meet at the least of them, those of MANY or more in bands; 0.8 * (FEW + 1) > MANY
LONG, SEED = 50, 25        # words of the shortest run that counts, and of an anchor
_TIMES = mix(np.arange(BANDS * ROWS, dtype=np.uint64), 31) | np.uint64(1)
_PLUS = mix(np.arange(BANDS * ROWS, dtype=np.uint64), 32)


def split_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, word offsets of their lines, line offsets of the texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lines = pc.split_pattern(col.cast(pa.large_string()).fill_null(""), "\n")
    off = lines.offsets.to_numpy()
    words, at, _ = word_hashes(lines.flatten())
    return words, at, off - off[0]


class Paragraphs:
    """The paragraphs of a batch, all at once: row, place of the line, its first word, words, and the sorted distinct shingles of all of
    them behind one another (`flat`; those of paragraph i are `flat[start[i]:start[i + 1]]`)."""

    def __init__(self, words: np.ndarray, at: np.ndarray, off: np.ndarray):
        sizes = np.diff(at)
        own = np.flatnonzero(sizes >= N)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))[own]
        self.row, self.place, self.word, self.words = row, own - off[row], at[own] - at[off[row]], sizes[own]
        count = self.words - N + 1
        line = np.repeat(np.arange(len(own)), count)
        every = shingle_hashes(words, N) if len(own) else np.empty(0, np.uint64)
        first = np.cumsum(count) - count
        values = every[np.repeat(at[own] - first, count) + np.arange(len(line))]
        order = np.lexsort((values, line))
        values = values[order]                              # lines stay where they are
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (line[1:] != line[:-1])
        self.flat = values[new]
        self.n = np.bincount(line[new], minlength=len(own))
        self.start = np.concatenate([[0], np.cumsum(self.n)])

    def __len__(self) -> int:
        return len(self.row)

    def prints(self) -> np.ndarray:
        """`set_print` of every paragraph's set, as 16-byte values."""
        parts = [np.add.reduceat(mix(self.flat, salt), self.start[:-1]) for salt in (21, 22)]
        return np.stack(parts, axis=1).astype(">u8").view([("a", ">u8"), ("b", ">u8")]).ravel()

    def sets(self, which: np.ndarray) -> list[np.ndarray]:
        return [self.flat[self.start[i]:self.start[i + 1]] for i in which.tolist()]


def _over(pick, x: np.ndarray, width: int) -> np.ndarray:
    """`pick` (minimum or maximum) of every `width` neighbours."""
    size = 1
    while 2 * size <= width:
        x, size = pick(x[:-size], x[size:]), 2 * size
    return pick(x[:len(x) - (width - size)], x[width - size:])


def anchors(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors, and the hash of every window of `SEED` words. ends: word offsets of the texts."""
    n, more = len(words), LONG - SEED
    if n < LONG:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    x, text = shingle_hashes(words, SEED), np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    low = _over(np.minimum, x, more + 1)
    low[text[:n - LONG + 1] != text[LONG - 1:]] = 0                    # long windows end with their text
    none = np.zeros(more, np.uint64)
    return np.flatnonzero(_over(np.maximum, np.concatenate([none, low, none]), more + 1) == x), x


def long_windows(words: np.ndarray, ends: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows of `LONG` words that hold an anchor whose hash is `wanted`."""
    at, x = anchors(words, ends)
    at = at[wanted(x[at])]
    text = np.searchsorted(ends, at, "right") - 1
    low, high = np.maximum(at - (LONG - SEED), ends[text]), np.minimum(at, ends[text + 1] - LONG)
    some = low <= high
    step = np.bincount(low[some], minlength=len(words) + 1) - np.bincount(high[some] + 1, minlength=len(words) + 1)
    at = np.flatnonzero(np.cumsum(step) > 0)
    return at, mix(x[at] * _TIMES[0] + x[at + SEED], 33)


def _covered(gone: list[dict] | None, n: int) -> np.ndarray:
    """How many of the first k words of a text go with lines, for k = 0 to n."""
    mark = np.zeros(n + 1, np.int64)
    for g in gone or []:
        mark[g["word"] + 1:g["word"] + g["n_words"] + 1] = 1
    return np.cumsum(mark)


def band_keys(flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Band keys of the non-empty sets that begin at `start` in `flat`, one row each; some ten thousand shingles at a time."""
    ends, keys, i = np.append(start, len(flat)), np.zeros((len(start), BANDS), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + (1 << 15), "right")) - 1)
        own, at = flat[ends[i]:ends[j]], ends[i:j] - ends[i]
        for k in range(BANDS * ROWS):
            b = k // ROWS
            keys[i:j, b] = mix(keys[i:j, b] + np.minimum.reduceat(own * _TIMES[k] + _PLUS[k], at), b + 1)
        i = j
    return keys


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all ranges behind one another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def flat_keys(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets of n shingles that begin at `start`, behind one another, and how many each has; similar sets that differ
    have one in common (see above)."""
    few = np.where((n >= LEAST) & (n <= FEW), n + 1 + (-ngram_join.PERCENT * n // 100), 0)
    many = np.flatnonzero(n >= MANY)
    row = np.concatenate([np.repeat(np.arange(len(n)), few), np.repeat(many, BANDS)])
    size = n[many]
    banded = band_keys(flat[_ranges(start[many], size)], np.cumsum(size) - size) if len(many) else np.empty((0, BANDS), np.uint64)
    keys = np.concatenate([mix(flat[_ranges(start, few)], 34), banded.ravel()])
    return keys[np.argsort(row, kind="stable")], np.bincount(row, minlength=len(n))


def _ends(sets: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0, *map(len, sets)])


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys of non-empty sets, one row each."""
    return band_keys(np.concatenate(sets), _ends(sets)[:-1])


def meeting_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Keys of each set."""
    keys, own = flat_keys(np.concatenate(sets), _ends(sets)[:-1], np.array([len(x) for x in sets]))
    return np.split(keys, np.cumsum(own)[:-1])


def _doc(id: str, text: str):
    """What tells rows apart: a hash of id and text."""
    return F.xxhash64(F.col(id), F.col(f"`{text}`"))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


SIGNED = "_doc bigint, place bigint, word bigint, n_words bigint, n bigint, cls binary, keys array<bigint>, anchors array<bigint>, at array<int>"


def _signed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """A row for every paragraph, and one with the anchors (and the number of words) of every text that has some."""
    out = StructType([StructField(id, docs.schema[id].dataType), *StructType.fromDDL(SIGNED).fields])

    def run(batches):
        for b in batches:
            words, at, off = split_words(b.column(text))
            found = Paragraphs(words, at, off)
            take = lambda c, rows: b.column(c).take(pa.array(rows, pa.int64()))
            if len(found):
                prints = found.prints()
                which = np.unique(prints, return_index=True)[1]              # a class gets its keys once a batch
                which = np.sort(which)
                keys, own = flat_keys(found.flat, found.start[which], found.n[which])
                sizes = np.zeros(len(found), np.int64)
                sizes[which] = own
                none = [pa.nulls(len(found), t) for t in (pa.list_(pa.int64()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [take(id, found.row), take("_doc", found.row), *(pa.array(v, pa.int64()) for v in (found.place, found.word, found.words, found.n)),
                     pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(found), [None, pa.py_buffer(prints.tobytes())]).cast(pa.binary()), _lists(keys.view(np.int64), sizes), *none], names=out.names)
            ends = at[off]
            pos, x = anchors(words, ends)
            if len(pos):
                of = np.searchsorted(ends, pos, "right") - 1
                row, sizes = np.unique(of, return_counts=True)
                none = [pa.nulls(len(row), t) for t in (pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [take(id, row), take("_doc", row), *none, pa.array(np.diff(ends)[row]), none[0], pa.nulls(len(row), pa.binary()), pa.nulls(len(row), pa.list_(pa.int64())),
                     _lists(x[pos].view(np.int64), sizes), _lists((pos - ends[of]).astype(np.int32), sizes)], names=out.names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id), _doc(id, text).alias("_doc"), F.col(f"`{text}`").alias(text)).mapInArrow(run, out)


def _sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame, id: str, text: str) -> DataFrame:
    """(node, set) of the given classes, read again from one document of each (and any document without id)."""
    filt = docs.sparkSession.sparkContext.broadcast(ngram_join.bit_table(nodes.join(classes, nodes["node"] == classes["cls"]).where("first is not null").select("first")))

    def run(batches):
        for b in batches:
            h = b.column("_h")
            keep = ngram_join.marked(filt.value, h.fill_null(0).to_numpy(zero_copy_only=False)) | h.is_null().to_numpy(zero_copy_only=False)
            t = b.column(text).filter(pa.array(keep))
            own = Paragraphs(*split_words(t)) if len(t) else ()
            if len(own):
                prints, which = np.unique(own.prints(), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(which), [None, pa.py_buffer(prints.tobytes())]).cast(pa.binary()),
                                                  pa.array([s.astype("<u8").tobytes() for s in own.sets(which)], pa.binary())], names=["node", "set"])

    read = docs.select(F.when(F.col(id).isNotNull(), F.pmod(F.xxhash64(id), F.lit(ngram_join.BITS))).alias("_h"), F.col(f"`{text}`").alias(text))
    own = read.mapInArrow(run, "node binary, set binary").join(nodes, "node", "left_semi")
    return durable(own.groupBy("node").agg(F.first("set").alias("set")), "sets")


def _marked(keyed: DataFrame, table: bytes) -> DataFrame:
    """(key, node) of the keys that are marked, so that the others are not shuffled again."""
    filt, low = keyed.sparkSession.sparkContext.broadcast(table), np.int64(ngram_join.BITS - 1)

    def run(batches):
        for b in batches:
            keys = b.column("keys")
            flat = keys.flatten().to_numpy()
            keep = np.flatnonzero(ngram_join.marked(filt.value, flat & low))
            row = np.repeat(np.arange(len(b)), np.diff(keys.offsets.to_numpy()))[keep]
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), b.column("cls").take(pa.array(row))], names=["key", "node"])

    return keyed.mapInArrow(run, "key bigint, node binary")


def _repeated_anchors(marks: DataFrame, gone: DataFrame) -> tuple[bytes, bytes]:
    """Bit tables of the anchors that occur twice around words that do not go with lines, and of the texts that have them."""
    def run(batches):
        for b in batches:
            hashes, docs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for doc, n, h, at, g in zip(*(b.column(c).to_pylist() for c in ("_doc", "n_words", "anchors", "at", "gone"))):
                h, at, upto = np.array(h, np.int64), np.array(at, np.int64), _covered(g, n)
                low, high = np.maximum(at - (LONG - SEED), 0), np.minimum(at + LONG, n)
                h = np.unique(h[upto[high] - upto[low] < high - low], return_counts=True)
                hashes.append(np.repeat(h[0], np.minimum(h[1], 2)))
                docs.append(np.full(len(hashes[-1]), doc))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(docs))], names=["h", "_doc"])

    flat = durable(marks.select("_doc", "n_words", "anchors", "at").join(gone, "_doc", "left").mapInArrow(run, "h bigint, _doc bigint"), "anchors")
    twice = durable(flat.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1").select("h"), "twice")
    table = ngram_join.bit_table(twice, hashed=True)
    filt, low = marks.sparkSession.sparkContext.broadcast(table), np.int64(ngram_join.BITS - 1)

    def docs_of(batches):
        for b in batches:
            keep = ngram_join.marked(filt.value, b.column("h").to_numpy() & low)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(b.column("_doc").to_numpy()[keep]))], names=["_doc"])

    return table, ngram_join.bit_table(flat.mapInArrow(docs_of, "_doc bigint"), hashed=True)


def _long_runs(docs: DataFrame, marks: DataFrame, gone: DataFrame, id: str, text: str) -> DataFrame:
    """Passages of `LONG` words or more, a row per occurrence."""
    filt = docs.sparkSession.sparkContext.broadcast(_repeated_anchors(marks, gone))
    key, low = StructField(id, docs.schema[id].dataType), np.int64(ngram_join.BITS - 1)

    def find(batches):
        for b in batches:
            mine = np.flatnonzero(ngram_join.marked(filt.value[1], b.column("_doc").to_numpy() & low))
            if not len(mine):
                continue
            b = b.take(pa.array(mine))
            words, at, off = split_words(b.column(text))
            ends = at[off]
            pos, h = long_windows(words, ends, lambda x: ngram_join.marked(filt.value[0], x.view(np.int64) & low))
            of = np.searchsorted(ends, pos, "right") - 1
            row, sizes = np.unique(of, return_counts=True)
            place = np.searchsorted(at, pos, "right") - 1 - off[of]
            take = lambda c: b.column(c).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [take(id), take("_doc"), pa.array(np.diff(ends)[row]), *(_lists(v, sizes) for v in (pos - ends[of], place, h.view(np.int64)))], names=[id, "_doc", "n", "word", "place", "h"])

    def flatten(batches):
        for b in batches:
            for i, (n, g, *lists) in enumerate(zip(*(b.column(c).to_pylist() for c in ("n", "gone", "word", "place", "h")))):
                word, place, h = (np.array(x, np.int64) for x in lists)
                upto = _covered(g, n)
                keep = upto[word + LONG] - upto[word] < LONG
                word, place, h = word[keep], place[keep], h[keep]
                _, first, same = np.unique(h, return_index=True, return_inverse=True)
                ahead = word - word[first[same]]
                keep = (ahead == 0) | (ahead >= LONG)
                k = int(keep.sum())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(np.full(k, i))) for c in (id, "_doc", "copies")), *(pa.array(x[keep]) for x in (word, place, h))],
                                                 names=[id, "_doc", "copies", "word", "place", "h"])

    small_batches(docs.sparkSession)
    found = docs.select(F.col(id), _doc(id, text).alias("_doc"), F.col(f"`{text}`").alias(text)).mapInArrow(
        find, StructType([key, *StructType.fromDDL("_doc bigint, n bigint, word array<bigint>, place array<bigint>, h array<bigint>").fields]))
    found = found.groupBy("_doc").agg(F.first(F.struct(id, "n", "word", "place", "h")).alias("x"), F.count("*").alias("copies")).select("_doc", "copies", "x.*")
    flat = durable(found.join(gone, "_doc", "left").mapInArrow(flatten, StructType([key, *StructType.fromDDL("_doc bigint, copies bigint, word bigint, place bigint, h bigint").fields])), "windows")
    groups = flat.groupBy("h").agg(F.sum("copies").alias("occurrences"), F.min(F.struct(F.col(id).isNull(), F.col(id), "_doc", "word", "place")).alias("main")).where("occurrences > 1")
    here = flat.join(groups, "h").withColumn("removed", ~((F.col("_doc") == F.col("main._doc")) & (F.col("word") == F.col("main.word"))))
    run = F.col("word") - F.row_number().over(Window.partitionBy("_doc", "main._doc", "removed").orderBy("word"))
    here = here.withColumn("kept", F.col("main._doc")).withColumn("run", run)
    out = here.groupBy("_doc", "kept", "removed", "run").agg(
        F.first(id).alias(id), F.min("word").alias("word"), F.min_by("place", "word").alias("place"), (F.max("word") + LONG - F.min("word")).alias("n_words"),
        F.max("occurrences").alias("occurrences"), F.min_by("main", "word").alias("main"), F.first("copies").alias("copies"))
    out = _spread(out, "copies").withColumn("removed", F.col("removed") | (F.col("_copy") > 1))
    return out.select(id, "place", "n_words", "occurrences", F.col(f"main.{id}").alias("kept_id"), F.col("main.place").alias("kept_place"), "removed", "word", F.col("main.word").alias("kept_word"))


def _spread(rows: DataFrame, copies: str, chunk: int = 4096) -> DataFrame:
    """Every row as often as `copies` says, numbered from 1 in `_copy`. Rows with many copies are dealt out in chunks first."""
    one = rows.where(F.col(copies) <= chunk).withColumn("_chunk", F.lit(0).cast("bigint"))
    many = rows.where(F.col(copies) > chunk).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({copies} - 1) div {chunk}"))))
    both = one.unionByName(many.hint("rebalance"))
    return both.withColumn("_copy", F.explode(F.sequence(F.col("_chunk") * chunk + 1, F.least(F.col(copies), (F.col("_chunk") + 1) * chunk)))).drop("_chunk")


def repeated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per occurrence of a passage that occurs more than once: id, place (line), n_words, occurrences, kept_id and
    kept_place (the occurrence that stays), removed, word and kept_word (the first word, counted from the start of the text).
    A passage that runs across lines has the place of its first word. Of a run of words `occurrences` is the most that one
    of its windows has, and the kept place is that of its first window."""
    signed = durable(_signed(docs, id, text), "paragraphs")
    rows = signed.where("cls is not null")
    classes = rows.groupBy("cls").agg(F.min(id).alias("first"))
    keyed = rows.select("cls", "keys")
    shared = keyed.select(F.explode("keys").alias("key"), F.xxhash64("cls").alias("c")).groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("key")
    shared = durable(shared, "shared")
    entries = _marked(keyed, ngram_join.bit_table(shared, hashed=True))
    met = durable(entries.join(shared, "key", "left_semi").distinct(), "met")
    sets = _sets(docs, met.select("node").distinct(), classes, id, text)
    # A paragraph with too many shingles of its own cannot reach the similarity with any other: it has no entry.
    entries = ngram_join.whole_entries(sets)
    own = entries.groupBy("node").agg(F.max("n").alias("n"), F.min("rank").alias("rank"), F.max("lead").alias("lead"), F.min("far").alias("far"))
    members = durable(met.join(own, "node"), "members")
    comp = linking.link(members, ngram_join._verifier(sets), ngram_join._may_link, durable(ngram_join.meeting(entries), "meeting"))
    flat = rows.join(comp, rows["cls"] == comp["node"], "left").select(id, "_doc", "place", "word", "n_words", F.coalesce("comp", "cls").alias("comp"))
    groups = flat.groupBy("comp").agg(F.count("*").alias("occurrences"), F.min(F.struct(F.col(id).isNull(), F.col(id), "place", "word", "_doc")).alias("main")).where("occurrences > 1")
    lines = flat.join(groups, "comp").withColumn("other", (F.col("_doc") != F.col("main._doc")) | (F.col("place") != F.col("main.place")))
    lines = durable(lines.select(id, "_doc", "place", "n_words", "occurrences", F.col(f"main.{id}").alias("kept_id"), F.col("main.place").alias("kept_place"), "other",
                                 "word", F.col("main.word").alias("kept_word")), "lines")
    gone = durable(lines.where("other").groupBy("_doc").agg(F.collect_set(F.struct("word", "n_words")).alias("gone")), "gone")
    shown = [id, "place", "n_words", "occurrences", "kept_id", "kept_place", "removed", "word", "kept_word"]
    # Of equal rows that all hold the first occurrence, one keeps it.
    main = lines.where("not other").groupBy(*[c for c in lines.columns if c != "other"]).agg(F.count("*").alias("copies"))
    kept = _spread(main, "copies").withColumn("removed", F.col("_copy") > 1).select(*shown)
    return lines.where("other").withColumnRenamed("other", "removed").select(*shown).unionByName(kept).unionByName(_long_runs(docs, signed.where("at is not null"), gone, id, text))
