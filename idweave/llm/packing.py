"""Variable-capacity best-fit packing.

Texts are cut into pieces of at most the largest permitted length and packed into sequences of
several permitted lengths.  Pieces are placed in decreasing order into the open bin that they
fill best.  Where none fits, a bin is opened whose size costs least for what the remaining
pieces can put into it: every permitted size is tried against the lengths that are left.  At
last each bin shrinks to the smallest permitted length that holds its contents.

The rows are dealt to shards of about equal size by a hash of their place in the input, so that
neither null ids nor repeated rows gather in one; shards are packed independently, no task holds
more than its shard, and only ids and lengths are shuffled.

Lengths are UTF-8 bytes (the tokens of a byte-level model).  Defined results: null and empty
texts have no piece and no row.  Repeated rows are packed each, and numbered among themselves;
ties in length go by id.  An empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .common import table

#: Permitted sequence lengths.
SIZES = (2048, 4096, 8192, 16384)
#: A sequence of n tokens costs OVERHEAD + n + n * n / ATTENTION: a fixed part, the layers' work and attention's.
OVERHEAD, ATTENTION = 64, 32768
#: Rows of a shard on average.
SHARD_ROWS = 2048


class _Lengths:
    """Counts of the lengths that are left, in ascending order."""

    def __init__(self, lengths):
        self.values, counts = np.unique(lengths, return_counts=True)
        self.values = self.values.tolist()
        self.left = dict(zip(self.values, counts.tolist()))

    def take(self, length):
        self.left[length] -= 1
        if not self.left[length]:
            del self.values[bisect_left(self.values, length)]

    def fill(self, room):
        """How much of ``room`` the lengths left would fill, the largest that fits first."""
        free, k = room, bisect_right(self.values, room)
        while free and k:
            length = self.values[k - 1]
            free -= length * min(self.left[length], free // length)
            k = min(k - 1, bisect_right(self.values, free))
        return room - free


def _opening(length, left, sizes):
    """The permitted size whose cost for each token placed is least; the larger one on ties."""
    best, least = None, None
    for size in sizes:
        if size >= length:
            cost = (OVERHEAD + size + size * size / ATTENTION) / (length + left.fill(size - length))
            if least is None or cost <= least:
                best, least = size, cost
    return best


def pack(lengths, sizes=SIZES):
    """(bin, offset in it) of each piece and the final size of each bin, for lengths of 1 to max(sizes)."""
    sizes = sorted(sizes)
    lengths = np.asarray(lengths, np.int64)
    left = _Lengths(lengths)
    free, used, where = [], [], [None] * len(lengths)  # free: (room, bin) of the open bins
    for i in np.lexsort((np.arange(len(lengths)), -lengths)).tolist():
        length = int(lengths[i])
        left.take(length)
        k = bisect_left(free, (length, -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            room, b = _opening(length, left, sizes), len(used)
            used.append(0)
        where[i] = (b, used[b])
        used[b] += length
        if room > length:
            insort(free, (room - length, b))
    final = [sizes[bisect_left(sizes, u)] for u in used]
    return where, final


def pack_texts(docs, sizes=SIZES, id_col="doc_id", text_col="text", shard_rows=SHARD_ROWS, n_rows=None):
    """A row for each piece: id, piece, start and length in the text's bytes, bin_id, bin_size and bin_offset."""
    largest = max(sizes)
    src = docs.select(F.col(id_col), F.octet_length(text_col).cast("long").alias("n_bytes"))
    shards = max(1, -(-(src.count() if n_rows is None else n_rows) // shard_rows))
    id_type = src.schema[0].dataType.simpleString()
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
    rows = src.withColumn("shard", shard).filter(F.col("n_bytes") > 0)

    def run(key, pdf):
        pdf = pdf.sort_values(["n_bytes", id_col], ascending=[False, True], kind="stable")
        total = pdf.n_bytes.to_numpy()
        each = -(-total // largest)
        row = np.repeat(np.arange(len(pdf)), each)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        start = piece * largest
        length = np.minimum(total[row] - start, largest)
        where, final = pack(length, sizes)
        bins = np.array([b for b, _ in where], np.int64)
        return pd.DataFrame({
            id_col: pdf[id_col].to_numpy()[row], "piece": piece, "start": start, "length": length,
            "bin_id": [f"{key[0]}-{b}" for b in bins], "bin_size": np.array(final, np.int64)[bins], "bin_offset": [o for _, o in where],
        })

    return rows.groupBy("shard").applyInPandas(run, f"`{id_col}` {id_type}, piece long, start long, length long, bin_id string, bin_size long, bin_offset long")


def query(spark, sf_dir):
    return pack_texts(table(spark, sf_dir, "documents"))
