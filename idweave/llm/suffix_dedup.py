"""Exact removal of repeated passages by a depth-limited radix sort of suffixes.

A text is a row of *tokens*: its UTF-8 bytes, or its words.  Two suffixes belong together only
if their first ``threshold`` tokens are equal, so the sort stops there: it runs
most-significant-digit passes and drops groups of one after each.  A digit is a part of those
tokens that is chosen by the tokens themselves:

1. the *gram*: of all grams of ``gram`` tokens in the window, the one with the least hash.
   Neighbouring windows share it, so one row stands for a run of suffixes;
2. the *core*: the tokens that ``spread`` neighbouring suffixes of a run have in common;
3. the few tokens left of each suffix.

In each pass a row holds the digit's hash (``key``) and a hash of all tokens of its run
(``whole``).  Runs that are equal as a whole are settled at once; a key with different runs
goes on to the next pass with one row for each of them; the rest are dropped.  Equal groups at
the end are exactly the repeated windows.  Spark shuffles hashes and positions; texts are
joined twice by id, once for the runs that pass 2 must look at and once to cut.  Several rules
(bytes and words, say) go through the same passes together; their keys never meet.

Keys are at least 128 bits in every comparison of whole windows.  All state between passes is
written to the session's shared checkpoint folder.

Defined results: a null or empty text has no tokens, nothing is removed.  Rows are keyed by id
and text, so repeated rows count as repeats of each other and null ids do not mix; the spans of
repeated rows are one set, so that many of them cost no more than their number.  Texts may be of
any length: they are cut into overlapping segments for hashing.  An empty table gives none.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .common import BYTE_CODES, chunks, mix, powers, prefix_hashes, prefix_sums, span_hashes, table, utf8_view, words, written


@dataclass(frozen=True)
class Rule:
    """Windows of ``threshold`` tokens (``byte`` or ``word``) that may not start twice; ``gram`` and ``spread`` tune the passes."""

    unit: str
    threshold: int
    gram: int
    spread: int


#: Strings of 400 bytes.
BYTES = Rule("byte", 400, 100, 16)
#: Passages of over 50 words ``[^\x20\x09-\x0D]+``, whatever white space parts them.
PASSAGES = Rule("word", 51, 15, 6)
#: Bytes tokenised at a time; tokens of a longer text that are hashed at a time.
CHUNK, SEGMENT = 1 << 18, 1 << 22
#: Words of more bytes are hashed one by one.
LONG_WORD = 1 << 12

_POSITION = np.uint64((1 << 24) - 1)
_C1, _C2, _C3 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

_RUNS = "id {id}, th long, rule int, key long, whole long, n int, lo long, hi long, pos long, gram boolean"
_BLOCKS = "id {id}, th long, rule int, key long, whole long, n int, base long, first int, last int, rest binary"


def _u(x):
    return np.asarray(x).astype(np.uint64)


def _salt(k):
    return mix(np.array([k + 1], np.uint64))


def word_codes(data, start, end):
    """64-bit codes of the words data[start:end]; equal words have equal codes."""
    codes = np.zeros(len(start), np.uint64)
    large = end - start > LONG_WORD
    for k in np.flatnonzero(large):
        codes[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes())
    small = np.flatnonzero(~large)
    at = 0
    while at < len(small):  # stretches of text, so that the running sums stay short
        stop = at + max(1, int(np.searchsorted(end[small[at:]], start[small[at]] + SEGMENT, "right")))
        own = small[at:stop]
        a, b = start[own[0]], end[own[-1]]
        codes[own] = mix(span_hashes(prefix_hashes(data[a:b]), start[own] - a, end[own] - a) + _u(end[own] - start[own]))
        at = stop
    return codes


def tokens(unit, data, offsets):
    """(values, offsets) of the tokens of each row: bytes as they are, words as 64-bit codes."""
    if unit == "byte":
        return data, offsets
    start, end, row = words(data, offsets)
    return word_codes(data, start, end), np.searchsorted(row, np.arange(len(offsets)))


def _codes(values):
    return BYTE_CODES[values] if values.dtype == np.uint8 else values


def window_runs(values, offsets, threshold=BYTES.threshold, gram=BYTES.gram):
    """Runs (row, lo, hi, pos) of window starts lo..hi that share the gram at pos; all windows are in one run each."""
    n, width = len(values), threshold - gram + 1
    none = np.zeros(0, np.int64)
    if n < threshold:
        return none, none, none, none, None
    sums = prefix_sums(_codes(values))
    _, back = powers(n + 1)
    order = mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1] + _C3)
    order = (order & ~_POSITION) | np.arange(len(order), dtype=np.uint64)
    padded = np.full(-(-len(order) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(order)] = order
    grid = padded.reshape(-1, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - threshold + 1
    least = np.minimum(after[:count], before[width - 1 : width - 1 + count])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(row[:count] == row[threshold - 1 :])
    if not len(start):
        return none, none, none, none, None
    at = (least[start] & _POSITION).astype(np.int64)
    cut = np.flatnonzero((at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(start) - 1]])
    lo, hi = start[first], start[last]
    return row[lo], lo, hi, at[first], sums


def _merged(row, lo, end):
    """Maximal spans of ascending, overlapping or touching spans."""
    new = np.concatenate([[True], (lo[1:] > end[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return row[first], lo[first], (end[np.append(first[1:], len(row)) - 1] if len(row) else end)


def _pieces(rule, data, offsets):
    """(first row, row offsets, start, values) of the tokens that are hashed at a time; offsets count from start."""
    for i, j in chunks(offsets, CHUNK):
        a = offsets[i]
        values, own = tokens(rule.unit, data[a : offsets[j]], offsets[i : j + 1] - a)
        if j - i > 1 or len(values) <= SEGMENT:
            yield i, own, 0, values
        else:
            for a in range(0, len(values) - rule.threshold + 1, SEGMENT):
                part = values[a : a + SEGMENT + rule.threshold - 1]
                yield i, np.array([0, len(part)]), a, part


def _run_rows(batches, rules):
    """Pass 1's rows of each batch (id, th, text), and the spans that repeat within one text (gram is false)."""
    for batch in batches:
        data, offsets, _ = utf8_view(batch.column(2))
        for r, rule in enumerate(rules):
            out = [[] for _ in range(8)]
            for i, own, a, values in _pieces(rule, data, offsets):
                row, lo, hi, pos, sums = window_runs(values, own, rule.threshold, rule.gram)
                if not len(row):
                    continue
                key = mix(span_hashes(sums, pos, pos + rule.gram) + _C1 + _salt(r))
                whole = mix(span_hashes(sums, lo, hi + rule.threshold) + _u(pos - lo) * _C2 + _u(hi - lo) * _C3)
                _, first, which, times = np.unique(mix(key + whole * np.uint64(3) + _u(row)), return_index=True, return_inverse=True, return_counts=True)
                twice = np.flatnonzero(times[which] > 1)
                shift = a - own[:-1]
                for k, x in enumerate((i + row[first], key[first].view(np.int64), whole[first].view(np.int64), np.minimum(times, 2), lo[first] + shift[row[first]], hi[first] + shift[row[first]], pos[first] + shift[row[first]], np.ones(len(first), bool))):
                    out[k].append(x)
                if len(twice):
                    row, lo, end = _merged(row[twice], lo[twice], hi[twice] + rule.threshold)
                    for k, x in enumerate((i + row, lo * 0, lo * 0, lo * 0 + 2, lo + shift[row], end + shift[row], lo * 0, np.zeros(len(row), bool))):
                        out[k].append(x)
            row, key, whole, n, lo, hi, pos, is_gram = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(row), r, np.int32)), pa.array(key, pa.int64()), pa.array(whole, pa.int64()), pa.array(n.astype(np.int32)), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(pos, pa.int64()), pa.array(is_gram.astype(bool))],
                names=["id", "th", "rule", "key", "whole", "n", "lo", "hi", "pos", "gram"],
            )


def _blocks(values, own, row, lo, hi, pos, gram, rule):
    """Blocks of ``spread`` neighbouring windows of runs: (run, base, first, last, key, whole, rest); positions are in ``values``."""
    spread, left = rule.spread, rule.spread - 1
    q0, q1 = (pos - hi) // spread, (pos - lo) // spread
    each = q1 - q0 + 1
    run = np.repeat(np.arange(len(lo)), each)
    q = np.repeat(q0, each) + np.arange(len(run)) - np.repeat(np.cumsum(each) - each, each)
    row, lo, hi, pos = row[run], lo[run], hi[run], pos[run]
    base = pos - spread * q - left
    first, last = np.maximum(lo, base) - base, np.minimum(hi, base + left) - base
    sums = prefix_sums(_codes(values))
    key = mix(span_hashes(sums, base + left, base + rule.threshold) + gram[run].view(np.uint64) + _u(q) * _C1)
    whole = mix(span_hashes(sums, base + first, base + last + rule.threshold) + _u(first) * _C2 + _u(last) * _C3 + _u(q) * _C1)
    where = np.concatenate([base[:, None] + np.arange(left), base[:, None] + rule.threshold + np.arange(left)], axis=1)
    inside = (where >= own[row][:, None]) & (where < own[row + 1][:, None])
    rest = np.where(inside, values[np.clip(where, 0, max(len(values) - 1, 0))], 0).astype(values.dtype)
    return run, base, first, last, key.view(np.int64), whole.view(np.int64), rest


def _block_rows(batches, rules):
    """Pass 2's rows of each batch (id, th, text, runs); long texts are taken in segments, like in pass 1."""
    for batch in batches:
        data, offsets, _ = utf8_view(batch.column(2))
        runs = batch.column(3)
        ends = np.asarray(runs.value_lengths().fill_null(0)).cumsum()
        flat = runs.flatten()
        which = np.asarray(flat.field("rule"))
        row_of = np.repeat(np.arange(batch.num_rows), np.diff(np.concatenate([[0], ends])))
        all_lo, all_hi, all_pos, gram = (np.asarray(flat.field(k)) for k in ("lo", "hi", "pos", "key"))
        for r, rule in enumerate(rules):
            margin = rule.threshold + rule.spread
            for i, j in chunks(offsets, CHUNK):
                mine = np.arange(ends[i - 1] if i else 0, ends[j - 1])
                mine = mine[which[mine] == r]
                if not len(mine):
                    continue
                a = offsets[i]
                values, own = tokens(rule.unit, data[a : offsets[j]], offsets[i : j + 1] - a)
                row = row_of[mine] - i
                lo, hi, pos = (x[mine] + own[row] for x in (all_lo, all_hi, all_pos))
                piece = lo // SEGMENT if j - i == 1 else np.zeros(len(mine), np.int64)
                for k in np.unique(piece):
                    pick = np.flatnonzero(piece == k)
                    a = max(0, lo[pick].min() - margin)
                    b = min(len(values), hi[pick].max() + rule.threshold + margin)
                    run, base, first, last, key, whole, rest = _blocks(values[a:b], own - a, row[pick], lo[pick] - a, hi[pick] - a, pos[pick] - a, gram[mine[pick]], rule)
                    at = np.arange(len(rest) + 1, dtype=np.int32) * (2 * (rule.spread - 1) * values.itemsize)
                    rest = pa.Array.from_buffers(pa.binary(), len(rest), [None, pa.py_buffer(at), pa.py_buffer(rest.tobytes())])
                    of = row[pick][run]
                    take = pa.array(i + of, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(run), r, np.int32)), pa.array(key), pa.array(whole), pa.array(np.ones(len(run), np.int32)), pa.array(base + a - own[of]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), rest],
                        names=["id", "th", "rule", "key", "whole", "n", "base", "first", "last", "rest"],
                    )


def _settle(spark, rows, name):
    """(rows whose whole repeats, one row for each different whole of a repeated key that has several)."""
    # what is joined back is written first: both sides of each join are then plain exchanges, and the
    # rows of a key that very many texts share can be split over tasks
    by_key = rows.groupBy("key").agg(F.sum("n").alias("total"), F.min("whole").alias("w0"), F.max("whole").alias("w1"))
    by_key = written(spark, by_key.filter("total > 1").select("key", (F.col("w0") == F.col("w1")).alias("same")), f"{name}-keys")
    again = written(spark, rows.join(by_key, "key"), name)
    mixed = again.filter("not same")
    order = F.xxhash64("id", "th", *[c for c in ("lo", "base") if c in rows.columns])
    kept = [c for c in rows.columns if c not in ("key", "whole", "n")]
    each = mixed.withColumn("order", order).groupBy("key", "whole").agg(F.sum("n").alias("total"), *[F.min_by(c, "order").alias(c) for c in kept])
    each = written(spark, each, f"{name}-each")
    repeated = each.filter("total > 1").select("key", "whole")
    settled = again.filter("same").drop("same").unionByName(mixed.drop("same").join(repeated, ["key", "whole"], "left_semi"))
    return settled, each


def _keyed(docs, id_col, text_col):
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def _with_text(docs, lists, how):
    """Join of (id, th, text) rows with lists by id and text hash; null ids are equal."""
    lists = lists.select(F.col("id").alias("i2"), F.col("th").alias("t2"), "list")
    return docs.join(lists, docs["id"].eqNullSafe(lists["i2"]) & (docs["th"] == lists["t2"]), how)


def repeated_spans(docs, id_col="doc_id", text_col="text", rules=(BYTES,)):
    """(id, th, list of (rule, lo, end)) of every text that holds a window of a rule's length that starts elsewhere too.

    ``th`` is the xxhash64 of the text, ``rule`` the place of the rule in ``rules``; spans are in
    the rule's tokens and may overlap.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    id_type = keyed.schema["id"].dataType.simpleString()
    # a window of words has white space between them
    least = min(x.threshold if x.unit == "byte" else 2 * x.threshold - 1 for x in rules)
    of_rule = lambda values: f"element_at(array({', '.join(map(str, values))}), rule + 1)"
    rows = keyed.filter(F.octet_length("text") >= least).mapInArrow(lambda b: _run_rows(b, rules), _RUNS.format(id=id_type))
    rows = written(spark, rows, "runs")
    settled, each = _settle(spark, rows.filter("gram").drop("gram"), "runs-again")
    threshold = F.expr(of_rule([x.threshold for x in rules]))
    spans = [rows.filter("not gram").select("id", "th", "rule", "lo", F.col("hi").alias("end")), settled.select("id", "th", "rule", "lo", (F.col("hi") + threshold).alias("end"))]

    lists = each.groupBy("id", "th").agg(F.collect_list(F.struct("rule", "lo", "hi", "pos", "key")).alias("list"))
    looked = _with_text(keyed, lists, "inner").select("id", "th", "text", "list")
    blocks = looked.mapInArrow(lambda b: _block_rows(b, rules), _BLOCKS.format(id=id_type))
    blocks = written(spark, blocks, "blocks")
    settled, each = _settle(spark, blocks, "blocks-again")
    spans.append(settled.select("id", "th", "rule", (F.col("base") + F.col("first")).alias("lo"), (F.col("base") + F.col("last") + threshold).alias("end")))

    windows = each.select("id", "th", "rule", "key", "base", "rest", F.explode(F.sequence("first", "last")).alias("k"))
    left, size = of_rule([x.spread - 1 for x in rules]), of_rule([1 if x.unit == "byte" else 8 for x in rules])
    tail = F.expr(f"xxhash64(k, substring(rest, k * {size} + 1, ({left} - k) * {size}), substring(rest, {left} * {size} + 1, k * {size}))")
    windows = windows.select("id", "th", "rule", "key", tail.alias("tail"), (F.col("base") + F.col("k")).alias("lo"))
    twice = windows.groupBy("key", "tail").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "tail")
    twice = written(spark, twice, "windows")
    found = windows.join(twice, ["key", "tail"], "left_semi")
    spans.append(found.select("id", "th", "rule", "lo", (F.col("lo") + threshold).alias("end")))

    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out.groupBy("id", "th").agg(F.collect_set(F.struct("rule", "lo", "end")).alias("list"))


def _spans_of_rows(batch, list_at):
    """For each row the (rule, lo, end) arrays of its list."""
    lists = batch.column(list_at)
    flat = lists.flatten()
    rule, lo, end = (np.asarray(flat.field(k)) for k in ("rule", "lo", "end"))
    begin = 0
    for stop in np.asarray(lists.value_lengths().fill_null(0)).cumsum().tolist():
        yield rule[begin:stop], lo[begin:stop], end[begin:stop]
        begin = stop


def _runs(lo, end):
    """Maximal runs of spans in any order."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    _, lo, end = _merged(np.zeros(len(lo), np.int64), lo, end)
    return lo, end


def _byte_runs(rule, text, lo, end):
    """Maximal runs in bytes; those of words begin and end with a word."""
    lo, end = _runs(lo, end)
    if rule.unit == "word" and len(lo):
        start, stop, _ = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        lo, end = start[lo], stop[end - 1]
    return list(zip(lo.tolist(), end.tolist()))


def _without(text, runs):
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


def dedup_report(docs, id_col="doc_id", text_col="text", rule=BYTES, passages=PASSAGES):
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row by ``rule``, and n_passage_words.

    n_passage_words counts the words that a passage of ``passages`` covers, which starts elsewhere
    too; they are only reported, not removed.
    """
    rules = (rule, passages)
    src = _with_text(_keyed(docs, id_col, text_col), repeated_spans(docs, id_col, text_col, rules), "left").select("id", "text", "list")

    def report(text, which, lo, end):
        cut = which == 0
        runs = _byte_runs(rule, text, lo[cut], end[cut])
        kept = _without(text, runs)
        a, b = _runs(lo[~cut], end[~cut])
        return len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), int((b - a).sum())

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            rows = [report(text.as_py() or b"", *spans) for text, spans in zip(texts, _spans_of_rows(batch, 2))]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")


def _whole_characters(text, runs):
    """Kept text: a removed run that would split a character leaves it whole."""
    whole = []
    for a, b in runs:
        while a < len(text) and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            whole.append((a, b))
    return _without(text, whole).decode("utf-8", "replace")


def remove_repeats(docs, id_col="doc_id", text_col="text", length_col="n_chars", rule=BYTES):
    """``docs`` with the repeated passages cut out of the text and its length brought up to date."""
    columns = docs.columns
    marked = docs.withColumns({"__id": F.col(id_col), "__th": F.xxhash64(text_col)})
    lists = repeated_spans(docs, id_col, text_col, (rule,)).select(F.col("id").alias("__i2"), F.col("th").alias("__t2"), F.col("list").alias("__list"))
    src = marked.join(lists, marked["__id"].eqNullSafe(lists["__i2"]) & (marked["__th"] == lists["__t2"]), "left").select(*columns, "__list")
    text_at = columns.index(text_col)

    def cut(text, lo, end):
        if not len(lo):
            return text
        raw = text.encode()
        return _whole_characters(raw, _byte_runs(rule, raw, lo, end))

    def run(batches):
        for batch in batches:
            texts = batch.column(text_at)
            new = [cut(text.as_py(), lo, end) for text, (_, lo, end) in zip(texts, _spans_of_rows(batch, batch.num_columns - 1))]
            out = [batch.column(k) for k in range(len(columns))]
            out[text_at] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(out, names=columns)

    out = src.mapInArrow(run, docs.schema)
    if length_col in columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(kind))
    return out


def query(spark, sf_dir):
    return dedup_report(table(spark, sf_dir, "documents"))
