"""Spelling variants: words at one edit from each other, found by k-d trees over letter counts.

One inserted, deleted or replaced letter changes a word's vector of letter counts by 2 at most in
L1 distance: one letter more, one letter less, or one of each.  So the neighbours of a word lie in
a small box around its vector.  Words of each length form a k-d tree; a search walks the trees of
the word's own length and of the next one, prunes every box that needs more letters or fewer than
one edit gives, and compares the order of letters in the leaves that remain.

Words are counted in tasks and partial counts are summed.  The upper levels of the trees come from
a bounded sample of the vocabulary; they deal all words to boxes of about ``BOX`` words, and a
word is sent, as a search, to the boxes that its neighbours can lie in.  A task holds one box, its
searches and the box's own small tree.  Searches return one row of sums for each word and box, never pairs.

Defined results: null and empty texts have no words.  Repeated rows count each.  A null id reads as
an empty one.  Of near words with the same count the smallest in code-point order is taken.  Words
of any length are searched; an empty table gives none.  Letters are A-Z, a-z and U+00C0 to U+00FF.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import mapped, packed, table, unpacked, written

#: Shortest word in code points, fewest occurrences, and how many times commoner a form must be.
LENGTH, OCCURRENCES, RATIO = 7, 2, 10
#: Words in a box, about, and in a leaf of its tree at most.
BOX, LEAF = 16384, 12
#: Words that the upper levels are learned from, and the longest of them in letters; longer ones have a box for each length.
SAMPLE, LONGEST = 131072, 255
#: Distinct words that a task counts before it passes them on, and bytes that one comparison holds.
HELD, CELLS = 200_000, 4 << 20

_RUN = re.compile(rb"[a-z\xc0-\xff]+")
#: letters in Latin-1 -> axis: 26 of their own, the accented ones share six (sharing only shortens distances)
_AXES = 32
_AXIS = np.zeros(256, np.int64)
_AXIS[97:123] = np.arange(26)
_AXIS[0xC0:] = 26 + np.arange(64) % 6


# ---------------------------------------------------------------- words


def _no_change(prefix, word):
    return word


def one_letter_lost(prefix, word):
    """The word, or the word without one code point, as the checksum of id and word says."""
    utf8 = word if word.isascii() else word.decode("latin-1").encode()
    h = zlib.crc32(utf8, prefix)
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs, id_col="doc_id", text_col="text", change=_no_change, shortest=LENGTH):
    """(raw, n): words in Latin-1 with their occurrences; ``change(crc32 of "id:", word)`` may alter a document's words."""
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))

    def run(batches):
        held = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["raw", "n"])
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # Latin-1 has one byte a code point; what it lacks becomes "?", which is no letter; lower() knows A-Z alone
                raw = (text.as_py() or "").encode("latin-1", "replace").lower()
                prefix = zlib.crc32(f"{own}:".encode())
                for word, n in Counter(_RUN.findall(raw)).items():
                    if len(word) >= shortest:
                        word = change(prefix, word)
                        if len(word) >= shortest:
                            held[word] += n
                if len(held) >= HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return src.mapInArrow(run, "raw binary, n long").groupBy("raw").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- trees


def matrix(words):
    """Letters of words of one length, a row each."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def letter_counts(letters):
    """Vectors of letter counts of rows of letters."""
    out = np.zeros((len(letters), _AXES), np.int32)
    step = max(1, CELLS // max(letters.shape[1], 1))
    for a in range(0, len(letters), step):
        own = letters[a : a + step]
        cell = _AXIS[own] + np.arange(len(own))[:, None] * _AXES
        out[a : a + step] = np.bincount(cell.ravel(), minlength=len(own) * _AXES).reshape(-1, _AXES)
    return out


class Tree:
    """A k-d tree over letter counts: a node cuts an axis into counts below and not below a number."""

    def __init__(self, axis, cut, below, above):
        self.axis, self.cut, self.below, self.above = axis, cut, below, above  # children < 0 are leaves ~child

    @classmethod
    def build(cls, points, leaf):
        """The tree and each point's leaf."""
        axis, cut, below, above, place = [], [], [], [], np.zeros(len(points), np.int64)
        leaves, waiting = 0, [(np.arange(len(points)), None, None)]
        while waiting:
            own, parent, side = waiting.pop()
            best = _best_cut(points[own]) if len(own) > leaf else None
            if best is None:
                place[own], child, leaves = leaves, ~leaves, leaves + 1
            else:
                child = len(axis)
                axis.append(best[0]), cut.append(best[1]), below.append(0), above.append(0)
                high = points[own, best[0]] >= best[1]
                waiting += [(own[high], child, above), (own[~high], child, below)]
            if side is not None:
                side[parent] = child
        return cls(*(np.array(x, np.int32) for x in (axis, cut, below, above))), place

    @property
    def leaves(self):
        return len(self.axis) + 1

    def reach(self, queries, more, fewer):
        """(leaf, rows of ``queries``) of the leaves whose boxes lie within ``more`` letters more and ``fewer`` fewer."""
        none = np.zeros(len(queries), np.int32)
        waiting = [(0 if len(self.axis) else ~0, np.arange(len(queries)), none, none, {}, {})]
        while waiting:
            node, own, up, down, low, high = waiting.pop()
            if not len(own):
                continue
            if node < 0:
                yield ~node, own
                continue
            j, t = int(self.axis[node]), int(self.cut[node])
            q = queries[own, j]
            # what the box asks on this axis now, less what it asked before
            u = up + np.maximum(t - q, 0) - np.maximum(low.get(j, 0) - q, 0)
            d = down + np.maximum(q - (t - 1), 0) - (np.maximum(q - high[j], 0) if j in high else 0)
            a, b = u <= more, d <= fewer
            waiting.append((int(self.above[node]), own[a], u[a], down[a], {**low, j: t}, high))
            waiting.append((int(self.below[node]), own[b], up[b], d[b], low, {**high, j: t - 1}))

    def leaf_of(self, points):
        """The leaf whose box holds each point."""
        out = np.zeros(len(points), np.int64)
        for leaf, own in self.reach(points, 0, 0):
            out[own] = leaf
        return out


def _best_cut(points):
    """(axis, number) that cuts points most evenly; None if all are equal."""
    best, least = None, len(points)
    step = max(1, len(points) // 4096)
    own = points[::step]
    for sample in (own, points) if step > 1 else (own,):
        for t in range(1, 4):
            share = np.abs(2 * (sample >= t).sum(0) - len(sample))
            j = int(share.argmin())
            if share[j] < min(least, len(sample)):
                best, least = (j, t), share[j]
        if best is not None:
            return best
    # counts above three alone differ
    spread = points.max(0) - points.min(0)
    j = int(spread.argmax())
    return (j, int(points[:, j].min()) + (int(spread[j]) + 1) // 2) if spread[j] else None


def one_edit(queries, points):
    """Whether each query (row) and point (column) are one edit apart; points are as long or one letter longer."""
    n = queries.shape[1]
    if n == points.shape[1]:
        return (queries[:, None] != points[None]).sum(2) == 1
    head = np.logical_and.accumulate(queries[:, None] == points[None, :, :-1], axis=2).sum(2)
    tail = np.logical_and.accumulate((queries[:, None] == points[None, :, 1:])[:, :, ::-1], axis=2).sum(2)
    return head + tail >= n


def near(queries, points):
    """(query rows, point rows) of all pairs at one edit, by a tree of the points and order of letters."""
    found_q, found_p = [], []
    if len(queries) and len(points):
        tree, place = Tree.build(letter_counts(points), LEAF)
        order = np.argsort(place, kind="stable")
        begin = np.searchsorted(place[order], np.arange(tree.leaves + 1))
        longer = points.shape[1] > queries.shape[1]
        for leaf, own in tree.reach(letter_counts(queries), 1, 0 if longer else 1):
            members = order[begin[leaf] : begin[leaf + 1]]
            step = max(1, CELLS // (max(points.shape[1], 1) * min(len(members), 256)))
            for b in range(0, len(members), 256):  # many words can share one vector: anagrams
                for a in range(0, len(own), step):
                    q, p = np.nonzero(one_edit(queries[own[a : a + step]], points[members[b : b + 256]]))
                    found_q.append(own[a : a + step][q]), found_p.append(members[b : b + 256][p])
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_p)


# ---------------------------------------------------------------- boxes


def upper_trees(vocabulary):
    """Packed upper trees: for each length in a bounded sample the tree whose leaves are boxes."""
    spark = vocabulary.sparkSession
    total = vocabulary.count()
    # words whose hash is below a share of its range: as many as SAMPLE in the mean, four deviations more at most
    share = min(1.0, SAMPLE / max(total, 1))
    low = F.xxhash64("raw").cast("double") < (2 * share - 1) * 2.0**63
    sample = vocabulary.filter((F.octet_length("raw") <= LONGEST) & (low | F.lit(share == 1.0))).select("raw").limit(SAMPLE + 4 * math.isqrt(SAMPLE)).collect()
    leaf = max(64, BOX * len(sample) // max(total, 1))
    lengths = {}
    for r in sample:
        lengths.setdefault(len(r.raw), []).append(bytes(r.raw))
    arrays = {"lengths": np.array(sorted(lengths), np.int64)}
    for n, own in lengths.items():
        tree, _ = Tree.build(letter_counts(matrix(sorted(own))), leaf)
        arrays |= {f"{n}-{k}": getattr(tree, k) for k in ("axis", "cut", "below", "above")}
    return spark.sparkContext.broadcast(packed(arrays))


def _dealt(batches, trees):
    """(length, box, search, raw, n): each word in its own box, and as a search in all boxes that may hold neighbours."""
    for batch in batches:
        lengths = {}
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lengths.setdefault(len(word), []).append((word, n))
        for size, own in lengths.items():
            words, ns = [w for w, _ in own], np.array([n for _, n in own])
            counts = letter_counts(matrix(words))
            parts = [(size, False, leaf, rows) for leaf, rows in trees(size).reach(counts, 0, 0)]
            for target, fewer in ((size, 1), (size + 1, 0)):
                parts += [(target, True, leaf, rows) for leaf, rows in trees(target).reach(counts, 1, fewer)]
            for target, search, leaf, rows in parts:
                columns = [np.full(len(rows), target), np.full(len(rows), leaf), np.full(len(rows), search)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([words[k] for k in rows], pa.binary()), pa.array(ns[rows])], names=["length", "box", "search", "raw", "n"])


def _partial(words, ns, owner, other, other_words, other_ns):
    """(raw, n_near, best_n, best) of each word in ``owner``: how many others, and the commonest of them."""
    if not len(owner):
        return []
    order = np.lexsort((owner,))
    owner, other = owner[order], other[order]
    out = []
    for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
        best = min((-int(other_ns[k]), other_words[k]) for k in other[part])
        out.append((words[owner[part[0]]], len(part), -best[0], best[1]))
    return out


def _searched(group):
    """Sums of one box: for each search its neighbours here, and for each word here the shorter ones that search it."""
    search = group.column("search").to_numpy()
    raws, ns = group.column("raw").to_pylist(), group.column("n").to_numpy()
    here = np.flatnonzero(~search)
    out = []
    if len(here):
        points, point_ns = [raws[k] for k in here], ns[here]
        letters, size = matrix(points), len(points[0])
        asked = np.flatnonzero(search)
        sizes = np.array([len(raws[k]) for k in asked], np.int64)
        for n in (size, size - 1):
            own = asked[sizes == n]
            if len(own):
                words, own_ns = [raws[k] for k in own], ns[own]
                q, p = near(matrix(words), letters)
                out += _partial(words, own_ns, q, p, points, point_ns)
                if n < size:
                    out += _partial(points, point_ns, p, q, words, own_ns)
    columns = list(zip(*out)) or [[], [], [], []]
    types = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["raw", "n_near", "best_n", "best"])


def near_words(vocabulary):
    """(raw, n_near, best_n, best) of the words of a table (raw, n) that have words at one edit."""
    shared = upper_trees(vocabulary)
    key = f"trees-{id(shared)}-{hash(shared.value)}"

    def deal(batches):
        arrays = unpacked(mapped(key, shared))
        known, none = set(arrays["lengths"].tolist()), Tree(*[np.zeros(0, np.int32)] * 4)
        trees = lambda n: Tree(*(arrays[f"{n}-{k}"] for k in ("axis", "cut", "below", "above"))) if n in known else none
        yield from _dealt(batches, trees)

    dealt = vocabulary.select("raw", "n").mapInArrow(deal, "length long, box long, search boolean, raw binary, n long")
    found = dealt.groupBy("length", "box").applyInArrow(_searched, "raw binary, n_near long, best_n long, best binary")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("b")))
    return found.groupBy("raw").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("raw", "n_near", (-F.col("best.m")).alias("best_n"), F.col("best.b").alias("best"))


def variant_groups(vocabulary, ratio=RATIO):
    """word, n, n_near, form, form_n and root of each word of a table (raw, n) that is stored, not computed again."""
    spark = vocabulary.sparkSession
    found = vocabulary.join(near_words(vocabulary), "raw", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = found.select("raw", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    found = written(spark, found, "variants")
    # a form is ratio times commoner: chains are short, and each round doubles the steps taken
    roots = found.filter("form IS NOT NULL").select("raw", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("raw").alias("root"), F.col("root").alias("next"))
        step = written(spark, roots.join(ahead, "root", "left").select("raw", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.select("raw", "root")
        if not step.filter("moved").limit(1).count():
            break
    text = lambda c: F.decode(F.col(c), "ISO-8859-1")
    return found.join(roots, "raw", "left").select(text("raw").alias("word"), "n", "n_near", text("form").alias("form"), "form_n", F.decode(F.coalesce("root", "raw"), "ISO-8859-1").alias("root"))


def query(spark, sf_dir):
    counts = word_counts(table(spark, sf_dir, "documents"), change=one_letter_lost).filter(F.col("n") >= OCCURRENCES)
    return variant_groups(written(spark, counts, "words")).select("word", "form", "root", "n", "n_near", "form_n")
