"""Shared helpers: tables, Arrow text buffers, vectorised hashes, memory-mapped models."""

from __future__ import annotations

import mmap
import os
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..sources.stored import shared_folder, stored

#: Bytes of text that one numpy step works on; bounds a task's memory whatever the Arrow batch holds.
CHUNK_BYTES = 1 << 20

U64 = np.uint64


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(spark, df):
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset in a local
    session (tests) a local one is chosen.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


# ---------------------------------------------------------------- text buffers


def utf8_view(column):
    """(bytes, offsets, is-null) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    null = np.asarray(pc.is_null(column)) if len(column) else np.zeros(0, bool)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets, null


def chunks(offsets, limit=CHUNK_BYTES):
    """Row ranges (i, j) with at most ``limit`` bytes, or one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_chunks(column, limit=CHUNK_BYTES):
    """(first row, bytes, offsets from 0) of each chunk of a string column."""
    data, offsets, _ = utf8_view(column)
    for i, j in chunks(offsets, limit):
        own = offsets[i : j + 1]
        yield i, data[own[0] : own[-1]], own - own[0]


# ---------------------------------------------------------------- hashing


def mix(x):
    """Bijective finaliser on uint64 arrays (splitmix64's constants)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: one pseudo-random 64-bit code for each byte value
BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


@lru_cache(maxsize=1)
def _powers(size):
    steps = np.full(size, _BASE, U64)
    steps[0] = 1
    back = np.full(size, _INVERSE, U64)
    back[0] = 1
    return np.multiply.accumulate(steps), np.multiply.accumulate(back)


def powers(n):
    """Powers of the hash base and of its inverse mod 2**64, at least n of each."""
    return _powers(1 << max(21, int(n).bit_length()))


def prefix_sums(codes):
    """Running sums of 64-bit codes from which ``span_hashes`` takes the hash of any stretch."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def prefix_hashes(data):
    """Running sums of bytes."""
    return prefix_sums(BYTE_CODES[data])


def span_hashes(sums, start, end):
    """Position-free 64-bit hashes of data[start:end], vectorised (not yet mixed)."""
    _, back = powers(len(sums))
    return (sums[end] - sums[start]) * back[start]


# ---------------------------------------------------------------- words

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(data, offsets):
    """(start, end, row) of the words ``[^\\x20\\x09-\\x0D]+`` of each row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    black = ~WHITE[data]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first = black.copy()
    first[1:] &= ~black[:-1]
    first[inner] = black[inner]
    last = black.copy()
    last[:-1] &= ~black[1:]
    before = inner[inner > 0] - 1
    last[before] = black[before]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


# ---------------------------------------------------------------- models on executors

_mapped = {}


def mapped(key, broadcast):
    """Memory map of a broadcast byte string, once for each Python worker.

    The worker writes the bytes to its own temporary folder, maps the file and unlinks it at
    once, so that nothing stays on the executor when the worker ends.
    """
    if key not in _mapped:
        fd, path = tempfile.mkstemp(prefix="model-")
        with os.fdopen(fd, "w+b") as f:
            f.write(broadcast.value)
            f.flush()
            _mapped[key] = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        os.unlink(path)
    return _mapped[key]


def packed(arrays):
    """Named numpy arrays as one byte string that ``unpacked`` reads without copying."""
    import json

    head, body, at = {}, [], 0
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        raw = a.tobytes()
        head[name] = [a.dtype.str, list(a.shape), at]
        body.append(raw + b"\0" * (-len(raw) % 16))
        at += len(body[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 16) % 16)
    return len(text).to_bytes(16, "little") + text + b"".join(body)


def unpacked(buffer):
    import json

    n = int.from_bytes(buffer[:16], "little")
    out = {}
    for name, (kind, shape, at) in json.loads(bytes(buffer[16 : 16 + n])).items():
        count = int(np.prod(shape))
        out[name] = np.frombuffer(buffer, np.dtype(kind), count, 16 + n + at).reshape(shape)
    return out


#: ``df`` as a Parquet table in the shared checkpoint folder, read back: lineage ends there
written = stored
