"""Byte-level BPE encoding and decoding with a local rank file.

`encode` gives every text its token ids as one binary value of little-endian unsigned 32-bit integers; `decode` turns
such a value back into the raw bytes of the text. Long texts are cut where no match of the splitting pattern can
reach across, so a piece of bounded size is encoded at a time and the ids are those of the uncut text.

Nulls: a null text counts as empty (no ids, zero tokens); null ids decode to no bytes. Repeated rows are encoded
each; other columns pass through, and an input column that has an output's name is replaced."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeline.llm.common import add_columns

PIECE = 1 << 16            # characters after which the next safe boundary is taken


@lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str):
    """One encoder per rank file and Python worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE):
    """Cut before a space or newline that follows a visible character: a match may begin there, none runs across, and
    the only look-ahead of the pattern is taken inside white space, which stays whole."""
    start, n = 0, len(text)
    while n - start > size:
        i = start + size
        while i < n and not (text[i] in " \n" and not text[i - 1].isspace()):
            i += 1
        yield text[start:i]
        start = i
    yield text[start:]


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens") -> DataFrame:
    """Append `ids` and `count`. `ranks` is a file every executor has (part of the installed software)."""

    def fn(b):
        enc = encoding(ranks, pattern)
        made, sizes = [], []
        for t in b.column(text).to_pylist():
            if t is None or len(t) <= PIECE:
                v = np.array(enc.encode_ordinary(t), dtype="<u4") if t else np.empty(0, "<u4")
            else:
                v = np.concatenate([np.array(enc.encode_ordinary(p), dtype="<u4") for p in pieces(t)])
            made.append(v.tobytes())
            sizes.append(len(v))
        return {ids: pa.array(made, pa.binary()), count: pa.array(sizes, pa.int64())}

    return add_columns(df, fn, f"`{ids}` binary, `{count}` bigint")


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Append the raw bytes behind the ids (not a string: ids may end inside a character)."""

    def fn(b):
        enc = encoding(ranks, pattern)
        return {out: pa.array([enc.decode_bytes(np.frombuffer(v or b"", "<u4").tolist()) for v in b.column(ids).to_pylist()], pa.binary())}

    return add_columns(df, fn, f"`{out}` binary")
