"""Token ids of a corpus in binary shards, with constant-time access by document key.

Files (all below one folder):
  tokens-*.bin   16 bytes of head (magic, version, bytes per id), then the ids of whole documents as little-endian
                 unsigned integers of 2 bytes where the vocabulary fits (else 4), each document followed by the end id;
                 documents in ascending order of key
  index-*.mph    one bucket of keys: a minimal perfect hash (a seed per small group of keys) and, per slot, fingerprint,
                 shard, offset within the shard and number of ids
  docs/ shards/ buckets/   Parquet tables: what each task wrote, first id of each shard, file of each bucket

Every file has a name of its own per task attempt, and only files named in the tables are read, so a lost executor
or a repeated attempt leaves a file that nothing refers to. Shards are ranges of keys, so the work and each file are
bounded; the first id of a shard is the sum of the ids of those before (one row per shard). Buckets hold some
`BUCKET_KEYS` keys however many there are.

Looking up a key: its bucket by hash, its slot by the bucket's seeds, then the fingerprint; a stranger is refused with
probability 1 - 2**-32. Keys are the texts of ids; a null id is a key of its own. Of documents that share an id (order: hash
of the text) the index names the first; all of them are in the shards. A null text is empty: the end id alone."""

from __future__ import annotations

import math
import os
import re
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gaugeline.llm.common import small_batches
from gaugeline.llm.textarrays import mix

HEAD, HEAD_BYTES, MAGIC = "<8sII", 16, b"GLTOKENS"
INDEX_HEAD = "<8sII"
BUCKET_KEYS, GROUP, FEW = 40_000, 3, 60
#: How byte-level tokenizers split a text before merging (a fixed value of this vocabulary's format).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PIECES, NOT_WHITE = re.compile(r"\s*\S+|\s+"), re.compile(r"[\x1c-\x1f]")
ODD = re.compile(r"[^\S \n]")
CACHED = 1_000_000         # words a Python worker remembers at most


class Encoder:
    """Ids of texts by the tokenizers library, word by word: a word that was seen before is not encoded again.

    Words are cut where a blank stands between two visible characters. No match of the byte-level splitting pattern
    reaches across, so the ids are those of the whole text. Texts with other white space are cut only where white space
    follows a visible character, and those with separators that Python but not the pattern counts as white space are
    encoded whole. A new word is split by the pattern and its parts go to the
    merging model of the library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True      # their strings in a text are ordinary text
        self.merge = self.tokenizer.model.tokenize
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.letter = "H" if self.width == 2 else "I"
        self.after_blank, self.first = Words(self.spaced), Words(self.word)
        self.parts = Words(self.part)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def part(self, p: str) -> bytes:
        """Ids of one match of the pattern."""
        ids = [t.id for t in self.merge(p.encode().decode("latin-1").translate(BYTE_NAMES))]
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def word(self, w: str) -> bytes:
        """Ids of a word with what is written onto it; its parts (the bare word, marks) are remembered on their own."""
        return b"".join(map(self.parts.__getitem__, PATTERN.findall(w)))

    def spaced(self, w: str) -> bytes:
        return self.parts[" " + w] if w.isalpha() else self.word(" " + w)

    def pieces(self, text: str) -> bytes:
        """A text with unusual white space, cut only where white space follows a visible character."""
        if NOT_WHITE.search(text):
            return self.whole(text)
        return b"".join(map(self.first.__getitem__, PIECES.findall(text)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        for known in (self.after_blank, self.first, self.parts):
            if len(known) > CACHED:
                known.clear()
        after, first, out = self.after_blank.__getitem__, self.first, []
        for t in texts:
            if not t:
                out.append(b"")
            elif t[0] == " " or t[-1] == " " or "  " in t or " \n" in t or "\n " in t or ODD.search(t):
                out.append(self.pieces(t))
            else:
                head, _, rest = t.partition(" ")
                out.append(first[head] + b"".join(map(after, rest.split(" "))) if rest else first[head])
        return out


class Words(dict):
    """Ids of words, made when a word is first met; very long ones are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, w: str) -> bytes:
        ids = self.make(w)
        if len(w) <= 64:
            self[w] = ids
        return ids


def _byte_names() -> dict[int, str]:
    """The printable character that names each byte in a byte-level vocabulary: itself where it is printable and no
    blank, else the next free character from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


BYTE_NAMES = _byte_names()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def key_of(id: str) -> Column:
    return F.coalesce(F.col(id).cast("string"), F.lit("\x00null"))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text") -> None:
    """Encode all texts into `folder` (empty or new, shared by all executors) and index them."""
    spark = docs.sparkSession
    small_batches(spark)
    ordered = docs.select(F.col(id), F.col(f"`{text}`").alias(text), F.xxhash64(F.col(f"`{text}`")).alias("_h"))
    ordered = ordered.repartitionByRange(F.col(id).asc_nulls_first(), F.col("_h")).sortWithinPartitions(F.col(id).asc_nulls_first(), F.col("_h")).select(id, text)

    def encode(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        shard, name, out, at = TaskContext.get().partitionId(), f"tokens-{uuid.uuid4().hex}.bin", None, 0
        enc = encoder(tokenizer)
        end = struct.pack("<" + enc.letter, end_id)
        for b in batches:
            if not len(b):
                continue
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(struct.pack(HEAD, MAGIC, 1, enc.width))
            sizes = []
            for ids in enc.encode(b.column(text).to_pylist()):
                out.write(ids)
                out.write(end)
                sizes.append(len(ids) // enc.width + 1)
            k = len(sizes)
            offsets = at + np.cumsum([0, *sizes])[:-1]
            at += sum(sizes)
            yield pa.RecordBatch.from_arrays([b.column(id), pa.array([shard] * k, pa.int32()), pa.array([name] * k), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())],
                                             names=[id, "shard", "file", "offset", "n_tokens"])
        if out is not None:
            out.close()

    made = StructType([StructField(id, docs.schema[id].dataType), *StructType.fromDDL("shard int, file string, offset bigint, n_tokens bigint").fields])
    ordered.mapInArrow(encode, made).write.parquet(f"{folder}/docs")
    rows = spark.read.parquet(f"{folder}/docs")
    sizes = rows.groupBy("shard", "file").agg(F.sum("n_tokens").alias("ids"))
    sizes.selectExpr("shard", "file", "ids", "coalesce(sum(ids) over (order by shard rows between unbounded preceding and 1 preceding), 0L) as base").write.parquet(f"{folder}/shards")
    _index(rows, folder, id)


def _slots(keys: np.ndarray, seeds: np.ndarray, m: int) -> np.ndarray:
    """Slot of each key under the seed of its group; a negative seed names the slot itself."""
    moved = (mix(keys + seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3) % np.uint64(m)).astype(np.int64)
    return np.where(seeds < 0, -seeds - 1, moved)


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """Seeds (one per group) that send m distinct 64-bit keys to m slots without a collision or a gap. Large groups
    choose first; a group of one takes a free slot by name."""
    m = len(keys)
    groups = max(-(-m // GROUP), 1)
    g = (mix(keys, 2) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(g, kind="stable")
    bounds = np.searchsorted(g[order], np.arange(groups + 1))
    size = np.diff(bounds)
    seeds, taken = np.zeros(groups, np.int64), np.zeros(m, bool)
    for k in range(int(size.max(initial=0)), 1, -1):
        left = np.flatnonzero(size == k)                              # groups of this size that have no seed yet
        own = keys[order[bounds[left][:, None] + np.arange(k)]]
        seed = 0
        while len(left) > FEW:                                        # one seed for all groups
            s = _slots(own, np.full((len(left), 1), seed, np.int64), m)
            fits = np.flatnonzero(~taken[s].any(axis=1) & (np.diff(np.sort(s, axis=1), axis=1) != 0).all(axis=1))
            first = np.zeros(len(fits) * k, bool)                     # of groups that want the same slot the first has it
            first[np.unique(s[fits].ravel(), return_index=True)[1]] = True
            fits = fits[first.reshape(-1, k).all(axis=1)]
            seeds[left[fits]] = seed
            taken[s[fits].ravel()] = True
            rest = np.ones(len(left), bool)
            rest[fits] = False
            left, own, seed = left[rest], own[rest], seed + 1
        for i, group in zip(left, own):                               # many seeds for one group
            for start in range(seed, 1 << 24, 1024):
                s = _slots(group[None, :], np.arange(start, start + 1024, dtype=np.int64)[:, None], m)
                good = np.flatnonzero(~taken[s].any(axis=1) & (np.diff(np.sort(s, axis=1), axis=1) != 0).all(axis=1))
                if len(good):
                    seeds[i] = start + good[0]
                    taken[s[good[0]]] = True
                    break
            else:
                raise ValueError("two keys of one bucket have the same hash")
    single = np.flatnonzero(size == 1)
    seeds[single] = -np.flatnonzero(~taken) - 1
    return seeds


def _index(rows: DataFrame, folder: str, id: str) -> None:
    keyed = rows.select(F.xxhash64(key_of(id)).alias("k"), F.xxhash64(key_of(id), F.lit(7)).alias("f"), F.struct("shard", "offset", "n_tokens").alias("at"))
    keyed = keyed.groupBy("k", "f").agg(F.min("at").alias("at"))
    buckets = max(math.ceil(rows.count() / BUCKET_KEYS), 1)

    def build(t: pa.Table) -> pa.Table:
        keys = t.column("k").to_numpy().view(np.uint64)
        m, seeds = len(keys), perfect_hash(keys)
        groups = len(seeds)
        slot = _slots(keys, seeds[(mix(keys, 2) % np.uint64(groups)).astype(np.int64)], m)
        put = lambda name, kind: _put(t.column(name).to_numpy(), slot, kind)
        name = f"index-{uuid.uuid4().hex}.mph"
        fs, root = pafs.FileSystem.from_uri(folder)
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(struct.pack(INDEX_HEAD, b"GLTOKIDX", m, groups))
            out.write(seeds.astype("<i4").tobytes())
            out.write(_put((t.column("f").to_numpy().view(np.uint64) >> np.uint64(32)), slot, "<u4") + put("shard", "<u4") + put("offset", "<u8") + put("n_tokens", "<u8"))
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "file": pa.array([name])})

    flat = keyed.select(F.pmod("k", F.lit(buckets)).alias("bucket"), "k", "f", "at.shard", "at.offset", "at.n_tokens")
    flat.groupBy("bucket").applyInArrow(build, "bucket bigint, file string").withColumn("buckets", F.lit(buckets).cast("bigint")).write.parquet(f"{folder}/buckets")


def _put(values: np.ndarray, slot: np.ndarray, kind: str) -> bytes:
    out = np.zeros(len(values), kind)
    out[slot] = values
    return out.tobytes()


@lru_cache(maxsize=4)
def bucket_arrays(path: str):
    """One bucket's arrays: seeds, fingerprints, shards, offsets, sizes."""
    fs, p = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(p) as f:
        data = f.read()
    magic, m, groups = struct.unpack_from(INDEX_HEAD, data)
    if magic != b"GLTOKIDX":
        raise ValueError(f"{path} is no index file")
    out, at = [], struct.calcsize(INDEX_HEAD)
    for kind, n in (("<i4", groups), ("<u4", m), ("<u4", m), ("<u8", m), ("<u8", m)):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def find(path: str, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, ...]:
    """(known, shard, offset, n_tokens) of keys of one bucket."""
    seeds, finger, shard, offset, size = bucket_arrays(path)
    slot = _slots(keys, seeds[(mix(keys, 2) % np.uint64(len(seeds))).astype(np.int64)].astype(np.int64), len(finger))
    return finger[slot] == (prints >> np.uint64(32)).astype(np.uint32), shard[slot], offset[slot], size[slot]


def lookup(keys: DataFrame, folder: str, id: str = "doc_id") -> DataFrame:
    """Append shard, offset and n_tokens to distinct keys; those that the store does not have are left out."""
    spark = keys.sparkSession
    buckets = spark.read.parquet(f"{folder}/buckets")
    n = buckets.agg(F.max("buckets")).first()[0] or 1
    own = keys.select(id, F.xxhash64(key_of(id)).alias("k"), F.xxhash64(key_of(id), F.lit(7)).alias("f")).withColumn("bucket", F.pmod("k", F.lit(n)))
    own = own.join(buckets.select("bucket", "file"), "bucket").repartition("bucket").sortWithinPartitions("bucket")

    def run(batches):
        for b in batches:
            files = np.array(b.column("file").to_pylist())
            k, f = (b.column(c).to_numpy().view(np.uint64) for c in ("k", "f"))
            for name in np.unique(files):
                at = np.flatnonzero(files == name)
                known, *where = find(f"{folder}/{name}", k[at], f[at])
                took = at[known]
                yield pa.RecordBatch.from_arrays([b.column(id).take(pa.array(took)), *(pa.array(w[known].astype(t)) for w, t in zip(where, (np.int32, np.int64, np.int64)))],
                                                 names=[id, "shard", "offset", "n_tokens"])

    return own.select(id, "k", "f", "file").mapInArrow(run, StructType([keys.schema[id], *StructType.fromDDL("shard int, offset bigint, n_tokens bigint").fields]))


def fetch(places: DataFrame, folder: str, id: str = "doc_id", out: str = "token_ids") -> DataFrame:
    """Append `start` (ids of all documents before) and the ids as unsigned 32-bit integers, read by place. Rows are dealt by shard and read in
    order of offset."""
    shards = places.sparkSession.read.parquet(f"{folder}/shards").select("shard", "file", "base")
    rows = places.join(shards, "shard").repartition("shard").sortWithinPartitions("shard", "offset")
    small_batches(places.sparkSession)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        name, f, width = None, None, 4
        for b in batches:
            ids = []
            for file, offset, n in zip(b.column("file").to_pylist(), b.column("offset").to_pylist(), b.column("n_tokens").to_pylist()):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{root}/{file}")
                    magic, _, width = struct.unpack(HEAD, f.read(HEAD_BYTES))
                    if magic != MAGIC:
                        raise ValueError(f"{file} is no token file")
                f.seek(HEAD_BYTES + width * offset)
                ids.append(np.frombuffer(f.read(width * n), f"<u{width}").astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(id), pa.array(np.array(b.column("base").to_pylist(), np.int64) + b.column("offset").to_numpy()), b.column("n_tokens"), pa.array(ids, pa.binary())],
                                             names=[id, "start", "n_tokens", out])
        if f is not None:
            f.close()

    schema = StructType([places.schema[id], *StructType.fromDDL(f"start bigint, n_tokens bigint, `{out}` binary").fields])
    return rows.select(id, "file", "base", "offset", "n_tokens").mapInArrow(run, schema)


def read(keys: DataFrame, folder: str, id: str = "doc_id") -> DataFrame:
    """Start, number and raw ids of the documents with the given keys."""
    return fetch(lookup(keys.select(id).distinct(), folder, id), folder, id)


