"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are compared: one counted over all
rows (the raw corpus), one over trusted rows (all rows labelled good).  A
text's score is the mean log ratio of its n-grams, so that length does not matter; every
document whose score is at least the threshold passes.  The threshold comes from the scores of
all labelled rows: the cut between good and bad rows with the best balanced accuracy,
but never above the score that all but ``KEEP_LOST`` of the good rows reach.  Labels are joined to
each text's n-grams (sorted buckets, about one byte each), not to the text, and by a merge join at any size,
so that what is shuffled and stored is in proportion to the input and a small part of it.

Defined results: a null or empty text has no words and fails the base rules.  Every row is
judged by itself, so repeated rows repeat with equal results and an empty table gives none.
Without labelled good rows the trusted model is the raw one: every score is 0 and passes.
Words are byte strings between ASCII white space, compared by 64-bit hashes within a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..sources.stored import stored
from .common import WHITE, mapped, mix, packed, prefix_hashes, span_hashes, table, text_chunks, unpacked, words

#: Hash buckets of the two multinomials.
BUCKETS = 1 << 14
#: Share of trusted rows that the threshold may lose.
KEEP_LOST = 0.002
#: Base rules.
LEAST_WORDS, REPEAT_PERCENT = 50, 50

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_NEWLINE = 10

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Ratios are whole multiples of this, so that their sums do not depend on the order of a text's n-grams.
UNIT = 2.0**-32
#: Byte of packed n-grams that adds to the next one.
_MORE = 255


def _features(data, offsets):
    """(row, bucket) of every hashed unigram and bigram, with what the rules also need."""
    start, end, row = words(data, offsets)
    sums = prefix_hashes(data)
    word = mix(span_hashes(sums, start, end) + (end - start).astype(np.uint64))
    same = row[1:] == row[:-1]
    pair = mix(word[:-1] * np.uint64(3) + word[1:])[same]
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    bucket = np.concatenate([(word >> shift), (pair >> shift)]).astype(np.int64)
    return np.concatenate([row, row[1:][same]]), bucket, (start, end, row, word, sums)


def _base(data, offsets, parts):
    """The five counts of each row."""
    n = len(offsets) - 1
    start, end, row, word, sums = parts
    count = lambda rows: np.bincount(rows, minlength=n)
    n_words = count(row)
    total = np.concatenate([[0], np.cumsum(~WHITE[data] & ((data & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
    chars = total[offsets[1:]] - total[offsets[:-1]]
    n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]

    breaks = np.flatnonzero(data == _NEWLINE)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.concatenate([line_start[1:], [len(data)]]) if len(line_start) else line_start
    ends_here = np.zeros(len(data) + 1, bool)
    ends_here[breaks + 1] = True
    line_end = line_end - ends_here[line_end]
    has_word = np.searchsorted(start, line_start, "left") < np.searchsorted(start, line_end, "left")
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    key = mix(mix(span_hashes(sums, line_start, line_end) + (line_end - line_start).astype(np.uint64)) + line_row.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    n_dup = count(line_row) - count(line_row[first])

    inside = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    key = mix(word[inside] * np.uint64(9) + word[inside + 1] * np.uint64(3) + word[inside + 2]) + row[inside].astype(np.uint64)
    _, which, times = np.unique(mix(key), return_inverse=True, return_counts=True)
    again = inside[times[which] > 1] if len(inside) else inside
    covered = np.zeros(len(row), bool)
    for k in range(3):
        covered[again + k] = True
    return n_words, chars, n_symbols, n_dup, count(row[covered])


def pack_grams(row, bucket, n):
    """A binary column of ``n`` rows: each row's sorted buckets as steps from one to the next."""
    key = np.sort(row * BUCKETS + bucket)
    row, bucket = key // BUCKETS, key % BUCKETS
    step = bucket.copy()
    step[1:] -= np.where(row[1:] == row[:-1], bucket[:-1], 0)
    size = step // _MORE + 1
    ends = np.cumsum(size)
    data = np.full(int(ends[-1]) if len(ends) else 0, _MORE, np.uint8)
    data[ends - 1] = step % _MORE
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, weights=size, minlength=n))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _grams(data, offsets):
    """(row, bucket) of packed n-grams."""
    ends = np.flatnonzero(data != _MORE)
    row = np.searchsorted(offsets, ends, "right") - 1
    total = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
    return row, total[ends + 1] - total[offsets[row]]


def grams(docs, id_col="doc_id", text_col="text"):
    """(i, g) of every row: its key and its packed n-grams."""

    def run(batches):
        for batch in batches:
            for i, data, offsets in text_chunks(batch.column(1)):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pack_grams(*_features(data, offsets)[:2], n)], names=["i", "g"])

    return docs.select(_key(docs, id_col).alias("i"), text_col).mapInArrow(run, "i long, g binary")


def bucket_counts(rows, read=_features):
    """Counts of each bucket over a table's first column, texts or what else ``read`` takes; one pass, each task sends its sums."""

    def run(batches):
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0)):
                sums += np.bincount(read(data, offsets)[1], minlength=BUCKETS)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["bucket", "n"])

    found = rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    out = np.zeros(BUCKETS)
    out[found.bucket] = found.n
    return out


def corpus_counts(docs, trusted_ids, id_col="doc_id", text_col="text"):
    """(raw, trusted) counts of each bucket over all rows; ``trusted_ids`` are a few known ids."""
    trusted = docs.filter(_key(docs, id_col).isin([int(i) for i in trusted_ids]))
    return np.array([bucket_counts(docs.select(text_col)), bucket_counts(trusted.select(text_col))])


def log_ratios(counts):
    """Smoothed log p_trusted / p_raw of each bucket; zeros without trusted counts."""
    raw, trusted = counts
    if not trusted.sum():
        return np.zeros(BUCKETS)
    # the trusted model backs off to the raw one with the weight of one count a bucket on average
    p = (raw + 1) / (raw.sum() + BUCKETS)
    q = (trusted + BUCKETS * p) / (trusted.sum() + BUCKETS)
    return np.round(np.log(q / p) / UNIT) * UNIT


def _scores(table_, row, bucket, n):
    """Mean log ratio of each row's n-grams; 0 without any."""
    times = np.bincount(row, minlength=n)
    return np.bincount(row, weights=table_[bucket], minlength=n) / np.maximum(times, 1)


def score_grams(packed_grams, ratios):
    """Scores of an Arrow column of packed n-grams; those of the texts."""
    out = np.zeros(len(packed_grams))
    for i, data, offsets in text_chunks(packed_grams):
        out[i : i + len(offsets) - 1] = _scores(ratios, *_grams(data, offsets), len(offsets) - 1)
    return out


def pick_threshold(scored):
    """The cut with the best balanced accuracy (lowest on ties) that loses KEEP_LOST of the good at most.

    ``scored`` is a table (s, good) of all labelled rows.  The cut lies half way to the next lower
    score.  Scores are dealt by ranges; counts below each are running sums in its range and the sums of the
    ranges before, of which the driver sees one row each.
    """
    spark = scored.sparkSession
    each = scored.groupBy("s").agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
    each = stored(spark, each.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "scores")
    ranges = each.groupBy("part").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.max("s").alias("last")).orderBy("part").collect()
    goods, bads = sum(r.g for r in ranges), sum(r.b for r in ranges)
    if not goods:
        return -np.inf
    offsets, g0, b0, last = [], 0, 0, None
    for r in ranges:
        offsets.append((r.part, g0, b0, last))
        g0, b0, last = g0 + r.g, b0 + r.b, r.last
    offsets = spark.createDataFrame(offsets, "part int, g0 long, b0 long, last double")
    inside = Window.partitionBy("part").orderBy("s")
    below = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = each.join(offsets, "part").select(
        "s", "g", (F.col("g0") + F.coalesce(F.sum("g").over(below), F.lit(0))).alias("lost"), (F.col("b0") + F.coalesce(F.sum("b").over(below), F.lit(0))).alias("dropped"),
        F.coalesce(F.lag("s").over(inside), "last").alias("lower"),
    )
    most = rows.filter(F.col("lost") + F.col("g") > int(KEEP_LOST * (goods - 1))).agg(F.min("s")).first()[0]
    if not bads:
        return float(most)
    right = F.round(1 - F.col("lost") / goods + F.col("dropped") / bads, 9)
    best = rows.filter(F.col("s") <= F.lit(most)).agg(F.max_by(F.struct("s", "lower"), F.struct(right, -F.col("s"))).alias("x")).first().x
    return float(best.s if best.lower is None else (best.s + best.lower) / 2)


def _key(df, id_col):
    """Column: a whole number for each id: the id itself, or 64 bits of hash where it is none."""
    own = F.col(id_col)
    if isinstance(df.schema[id_col].dataType, IntegralType):
        return own.cast("long")
    return F.when(own.isNotNull(), F.xxhash64(own.cast("string")))


def labelled(docs, labels, id_col="doc_id", text_col="text", label_col="quality"):
    """(i, good, g) of all rows with a label; an id labelled both ways is good."""
    marks = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    marks = marks.select(_key(labels, id_col).alias("i"), (F.col(label_col) == 1).alias("good")).groupBy("i").agg(F.max("good").alias("good"))
    # without the hint few labels are broadcast and many are not: growth would jump where the plan changes
    return grams(docs, id_col, text_col).filter("i IS NOT NULL").join(marks.hint("merge"), "i").select("i", "good", "g")


def fit(docs, labels, id_col="doc_id", text_col="text"):
    """The model as packed bytes: log ratios and the threshold."""
    known = stored(docs.sparkSession, labelled(docs, labels, id_col, text_col), "labelled")  # read twice
    ratios = log_ratios((bucket_counts(docs.select(text_col)), bucket_counts(known.filter("good").select("g"), _grams)))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score_grams(batch.column(2), ratios))], names=["i", "good", "s"])

    scored = known.mapInArrow(run, "i long, good boolean, s double").groupBy("i").agg(F.max("good").alias("good"), F.min("s").alias("s"))
    return packed({"ratios": ratios, "cut": np.array([pick_threshold(scored)])})


def _judge(texts, model):
    """Arrow columns: the five counts, base_failed, kept and llr."""
    n = len(texts)
    counts, scores = np.zeros((5, n), np.int64), np.zeros(n)
    for i, data, offsets in text_chunks(texts):
        k = len(offsets) - 1
        row, bucket, parts = _features(data, offsets)
        counts[:, i : i + k] = _base(data, offsets, parts)
        scores[i : i + k] = _scores(model["ratios"], row, bucket, k)
    failed = (counts[0] < LEAST_WORDS) | (100 * counts[4] > REPEAT_PERCENT * counts[0])
    kept = ~failed & (scores >= model["cut"][0])
    return counts, failed, kept, scores


def _mapper(docs, model, columns, emit, schema):
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = f"quality-{hash(model)}"

    def run(batches):
        own = unpacked(mapped(key, shared))
        for batch in batches:
            yield emit(batch, own)

    return columns.mapInArrow(run, schema)


def quality_rules(docs, labels, id_col="doc_id", text_col="text"):
    """id, the five counts, base_failed, kept and the score ``llr`` of every row."""
    src = docs.select(id_col, text_col)
    id_type = src.schema[0].dataType.simpleString()

    def emit(batch, model):
        counts, failed, kept, scores = _judge(batch.column(1), model)
        columns = [batch.column(0), *map(pa.array, counts), pa.array(failed), pa.array(kept), pa.array(scores)]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, *COUNTS, "base_failed", "kept", "llr"])

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, llr double"
    return _mapper(docs, fit(docs, labels, id_col, text_col), src, emit, schema)


def keep_good(docs, labels, id_col="doc_id", text_col="text"):
    """The rows of ``docs`` that the rules keep, with all their columns."""
    at = docs.columns.index(text_col)

    def emit(batch, model):
        return batch.filter(pa.array(_judge(batch.column(at), model)[2]))

    return _mapper(docs, fit(docs, labels, id_col, text_col), docs, emit, docs.schema)


def query(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
