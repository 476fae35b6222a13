"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

Texts become counts of hashed words and hashed byte shapes; logarithms of the counts, weighted
by inverse document frequency, are projected by a truncated singular value decomposition.  The
labelled texts' unit vectors are broadcast (their number is bounded), the cosines of every
document with all of them are computed exactly in blocks, and the nearest ones vote with
weights that grow with their similarity.

All products are taken in fixed point: factors are multiples of a power of two in float64 and
sums stay below 2**53 of their steps, so they are exact in any order.  A score depends neither on a row's place in its
block nor on the linear algebra library, its kernel or its threads.

Defined results: a null or empty text has the zero vector and scores the share of good labels.
Rows are scored one by one; repeated rows repeat, an empty table gives none.  Without labels all
scores are 0.5.  Rows with several labels count with the least of them.  Ties between equally
near neighbours go to the lower position in the sample (ids in the order of their text form).
Equal texts have equal scores wherever they stand.  Ids may have any type that casts to a string.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import mapped, mix, packed, prefix_hashes, span_hashes, table, text_chunks, unpacked, words

#: Hash buckets of words and of shapes, latent dimensions.
WORD_BUCKETS, SHAPE_BUCKETS, DIM = 3072, 1024, 48
#: Labelled rows of each label that are learned from, at most.
SAMPLE = 1500
#: Neighbours that vote, and how steeply their weight grows with the cosine.
NEIGHBOURS, STEEP = 15, 12.0
#: Rows scored at a time.
BLOCK = 128
#: Bits after the point of weighted counts (below 2**6), of the basis (at most 1), of unit vectors and of votes.
#: Sums over 2**12 buckets stay below 2**49, those over 2**7 dimensions below 2**53.
COUNT_BITS, BASIS_BITS, UNIT_BITS, VOTE_BITS = 12, 19, 15, 40

_BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS

#: byte -> shape class: lower, upper, digit, white, line end, inner punctuation, symbol, first or later byte of a longer character
_SHAPE = np.full(256, 6, np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58] = 0, 1, 2
_SHAPE[[32, 9, 13, 11, 12]], _SHAPE[10] = 3, 4
_SHAPE[list(b".,;:'\"()-?")] = 5
_SHAPE[0x80:0xC0], _SHAPE[0xC0:] = 0, 7


def term_counts(data, offsets):
    """Sparse (row, bucket, count) of each row's words, repeated words and four-byte shapes."""
    n = len(offsets) - 1
    start, end, row = words(data, offsets)
    key = mix(span_hashes(prefix_hashes(data), start, end) + (end - start).astype(np.uint64))
    bucket = (key % np.uint64(WORD_BUCKETS - 1)).astype(np.int64) + 1
    # a word that follows itself counts in bucket 0
    again = np.flatnonzero((key[1:] == key[:-1]) & (row[1:] == row[:-1])) + 1
    shapes = _SHAPE[data].astype(np.int64)
    code = shapes[:-3] << 9 | shapes[1:-2] << 6 | shapes[2:-1] << 3 | shapes[3:] if len(data) > 3 else np.zeros(0, np.int64)
    where = np.repeat(np.arange(n), np.diff(offsets))[: len(code)]
    # four shapes that start in one row and end in the next would depend on the neighbours
    code_ok = np.repeat(np.arange(n), np.diff(offsets))[3:] == where if len(code) else np.zeros(0, bool)
    shape = code[code_ok] % SHAPE_BUCKETS if SHAPE_BUCKETS < 4096 else code[code_ok]
    cell = np.concatenate([row * _BUCKETS + bucket, row[again] * _BUCKETS, where[code_ok] * _BUCKETS + WORD_BUCKETS + shape])
    if n * _BUCKETS <= 1 << 23:
        dense = np.bincount(cell, minlength=n * _BUCKETS)
        used = np.flatnonzero(dense)
        return used // _BUCKETS, used % _BUCKETS, dense[used]
    used, times = np.unique(cell, return_counts=True)
    return used // _BUCKETS, used % _BUCKETS, times


def _fixed(x, bits):
    """``x`` in steps of 2**-bits, in float64."""
    return np.rint(np.asarray(x, np.float64) * float(1 << bits)) / float(1 << bits)


def _dense(n, row, bucket, times, length):
    """Logarithms of counts for each thousand bytes: rows of any length compare."""
    out = np.zeros((n, _BUCKETS))
    rate = times / np.maximum(length[row], 200) * 1000.0
    out[row, bucket] = np.log1p(rate)
    return out


def _latent(counts, weights, basis):
    """Unit vectors of dense counts, in steps of 2**-UNIT_BITS; zeros stay zeros."""
    latent = _fixed(counts * weights, COUNT_BITS) @ basis
    largest = np.abs(latent).max(axis=1, keepdims=True)
    scaled = _fixed(latent / np.where(largest > 0, largest, 1.0), 20)
    norm = np.sqrt(np.square(scaled).sum(axis=1, keepdims=True))
    return _fixed(scaled / np.where(norm > 0, norm, 1.0), UNIT_BITS)


def project(texts, weights, basis):
    """Unit latent vectors of an Arrow string column; zeros for empty texts."""
    basis = _fixed(basis, BASIS_BITS)
    out = np.zeros((len(texts), basis.shape[1]))
    for i, data, offsets in text_chunks(texts, 1 << 19):
        for a in range(0, len(offsets) - 1, BLOCK):
            own = offsets[a : a + BLOCK + 1]
            part, at = data[own[0] : own[-1]], own - own[0]
            counts = _dense(len(at) - 1, *term_counts(part, at), np.diff(at))
            out[i + a : i + a + len(at) - 1] = _latent(counts, weights, basis)
    return out


def _counted(batches):
    """(i, y, length, buckets, times) of each text (i, y, text): at most 4,096 buckets of 6 bytes, however long the text."""
    for batch in batches:
        out = [[], [], []]
        for _, data, offsets in text_chunks(batch.column(2), 1 << 19):
            row, bucket, times = term_counts(data, offsets)
            for a, b in zip(*np.searchsorted(row, [np.arange(len(offsets) - 1), np.arange(1, len(offsets))])):
                out[1].append(bucket[a:b].astype(np.int16).tobytes())
                out[2].append(times[a:b].astype(np.int32).tobytes())
            out[0] += np.diff(offsets).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["i", "y", "length", "buckets", "times"])


def fit_vectors(counted, labels):
    """Model arrays from a bounded list of term counts (length, buckets, times) with labels."""
    counts = np.zeros((len(counted), _BUCKETS))
    for i, (length, buckets, times) in enumerate(counted):
        bucket = np.frombuffer(buckets, np.int16).astype(np.int64)
        counts[i] = _dense(1, np.zeros(len(bucket), np.int64), bucket, np.frombuffer(times, np.int32), np.array([length]))
    seen = (counts > 0).sum(0)
    weights = np.log((1 + len(counts)) / (1 + seen))
    weights[seen < 3] = 0
    rows = (counts * weights).astype(np.float32)
    # truncated decomposition by power iteration on a random start
    rng = np.random.default_rng(11)
    rank = min(DIM, *rows.shape)
    basis = np.linalg.qr(rng.normal(size=(_BUCKETS, rank)).astype(np.float32))[0]
    for _ in range(6):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    basis = _fixed(basis, BASIS_BITS)
    return {"weights": weights, "basis": basis, "vectors": _latent(counts, weights, basis), "labels": np.asarray(labels, np.float64)}


def vote(vectors, model):
    """Share of label 1 among the nearest labelled vectors, weighted by similarity; exact, in blocks."""
    known, labels = model["vectors"], model["labels"]
    good = labels.mean()
    k = min(NEIGHBOURS, len(known))
    out = np.empty(len(vectors))
    # classes differ in size in the sample by chance only, but may: each label's votes are weighed alike
    balance = np.where(labels > 0.5, 0.5 / max(good, 1e-9), 0.5 / max(1 - good, 1e-9))
    place = np.arange(len(known))
    for i in range(0, len(vectors), BLOCK):
        # the cosine and the place in one number: no two are equal
        cosine = ((vectors[i : i + BLOCK] @ known.T) * float(1 << 2 * UNIT_BITS)).astype(np.int64)
        near = np.argpartition(place - cosine * len(known), k - 1, axis=1)[:, :k]
        near.sort(axis=1)
        weight = np.exp(STEEP * (np.take_along_axis(cosine, near, 1) / float(1 << 2 * UNIT_BITS) - 1))
        weight = _fixed(weight * np.minimum(balance[near], 1 << 8), VOTE_BITS) + 2.0**-VOTE_BITS
        out[i : i + BLOCK] = (weight * labels[near]).sum(1) / weight.sum(1)
    empty = ~vectors.any(axis=1)
    out[empty] = good
    return np.clip(out, 0, 1)


def held_out(id_col="doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text leaves 1 mod 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs, labels, id_col="doc_id", text_col="text", label_col="quality", bound=SAMPLE):
    """The packed model, learned from the ``bound`` rows of each label that are least by hash; None without any."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("string").alias("i")).agg(F.min(label_col).alias("y"))
    picked = []
    for y in (0, 1):
        picked += known.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(bound).collect()
    if not picked:
        return None
    spark = docs.sparkSession
    # 2 * bound rows of an id and a number: the size of this side does not depend on the data
    ids = F.broadcast(spark.createDataFrame([(r.i, r.y) for r in picked], "i string, y int"))

    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).join(ids, "i")
    found = rows.groupBy("i").agg(F.max("y").alias("y"), F.min("t").alias("t")).select("i", "y", "t")
    # texts are counted in tasks: what the driver collects is bounded in bytes too, at 2 * bound rows of 25 KB
    found = found.mapInArrow(_counted, "i string, y int, length long, buckets binary, times binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: r.i)
    return packed(fit_vectors([(r.length, r.buckets, r.times) for r in found], [r.y for r in found]))


def score_quality(docs, model, id_col="doc_id", text_col="text"):
    """id, score and predicted of every row."""
    src = docs.select(id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model or b"")
    key, usable = f"neighbours-{hash(model)}", model is not None

    def run(batches):
        own = unpacked(mapped(key, shared)) if usable else None
        for batch in batches:
            if usable:
                score = vote(project(batch.column(1), own["weights"], own["basis"]), own)
            else:
                score = np.full(batch.num_rows, 0.5)
            columns = [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "score", "predicted"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, score double, predicted int")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
