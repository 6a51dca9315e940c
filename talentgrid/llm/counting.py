"""Corpus frequencies of 64-bit tokens, without a row per token.

Chunks of documents send their distinct tokens packed by token range; a range adds them up
and answers every chunk with those met twice or more. A token is known by its leading
``32 + bits`` bits, so a frequency may include a few strangers: it is an upper bound, good
for ordering and for ruling out tokens that occur once.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACKED = "rng long, chunk long, keys binary, counts binary"
OFTEN = "chunk long, rng long, keys binary, counts binary"


def range_bits(n_docs: int, docs_per_range: int = 4096) -> int:
    return min(30, max(0, math.ceil(math.log2(max(1, n_docs / docs_per_range)))))


def _squeezed(keys: np.ndarray) -> bytes:
    """Rising 32-bit numbers as compressed differences, byte by byte place."""
    return zlib.compress(np.diff(keys, prepend=np.uint32(0)).astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), 1)


def _unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), "u1").reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u4")[:, 0], dtype="u4")


def pack(chunk: int, tokens: np.ndarray, bits: int) -> pa.Table:
    """Rows of ``PACKED`` for the tokens (with repeats) of a chunk."""
    tokens, counts = np.unique(tokens >> np.uint64(32 - bits), return_counts=True)
    rng = (tokens >> np.uint64(32)).astype("int64")
    edge = np.flatnonzero(np.diff(rng)) + 1
    parts = list(zip(np.split(rng, edge), np.split(tokens.astype("<u4"), edge),
                     np.split(np.minimum(counts, 65535).astype("<u2"), edge))) if len(tokens) else []
    return pa.table({
        "rng": pa.array([int(r[0]) for r, _, _ in parts], pa.int64()), "chunk": pa.array([chunk] * len(parts), pa.int64()),
        "keys": pa.array([_squeezed(k) for _, k, _ in parts], pa.binary()),
        "counts": pa.array([c.tobytes() for _, _, c in parts], pa.binary())})


def _add_up(key, table):
    keys = [_unsqueezed(k) for k in table.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(c, "<u2") for c in table.column("counts").to_pylist()]).astype("int64")
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.minimum(np.bincount(place, counts, len(every)), 2 ** 32 - 1).astype("<u4")
    out, at = [], 0
    for chunk, k in zip(table.column("chunk").to_pylist(), keys):
        f = total[place[at:at + len(k)]]
        at += len(k)
        often = f >= 2
        if often.any():
            out.append((chunk, _squeezed(k[often]), f[often].tobytes()))
    return pa.table({"chunk": pa.array([c for c, _, _ in out], pa.int64()),
                     "rng": pa.array([key[0].as_py()] * len(out), pa.int64()),
                     "keys": pa.array([k for _, k, _ in out], pa.binary()),
                     "counts": pa.array([f for _, _, f in out], pa.binary())})


def often(packed: DataFrame) -> DataFrame:
    """Rows of ``OFTEN``: per chunk its tokens met twice or more in all."""
    return packed.groupBy("rng").applyInArrow(_add_up, OFTEN)


def frequencies(answer: pa.Table, tokens: np.ndarray, bits: int) -> np.ndarray:
    """Frequency of every token of a chunk, from its rows of ``OFTEN``."""
    if not answer.num_rows:
        return np.ones(len(tokens), "int64")
    known = np.concatenate([_unsqueezed(k).astype("uint64") + (np.uint64(r) << np.uint64(32))
                            for r, k in zip(answer.column("rng").to_pylist(), answer.column("keys").to_pylist())])
    count = np.concatenate([np.frombuffer(c, "<u4") for c in answer.column("counts").to_pylist()])
    o = np.argsort(known)
    known, count = known[o], count[o]
    k = tokens >> np.uint64(32 - bits)
    at = np.searchsorted(known, k)
    at[at == len(known)] = 0
    return np.where(known[at] == k, count[at], 1).astype("int64")
