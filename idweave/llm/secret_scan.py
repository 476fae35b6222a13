"""Secret scans: patterns of known kinds, and a battery of randomness tests for tokens of any kind.

Base spans come from three patterns.  Other tokens of ``SHORTEST`` characters or more are judged
by randomness.  A token's encoding is the smallest alphabet that holds all of its characters.
Three tests ask whether it is a random string over that alphabet: chi-squared uniformity of
its symbols, runs above and below the alphabet's middle, and serial correlation of neighbours.
Their p-values are combined by Fisher's sum.  A token is random if that sum is no larger than
chance makes it, and if ordinary text would not look that random.

Ordinary text is a first-order Markov chain over the alphabet, from the counts of neighbouring
characters of all documents outside long tokens (integers, summed before the shuffle).  The
chain yields the mean and deviation of the sum's logarithm for a token of each length, so a
short token needs a better fit than a long one: its p-value is the chance that text of its
length and alphabet looks as random.  These p-values, over all tokens of all documents, go through
the Benjamini-Hochberg step-up at rate ``RATE``, on counts of p-values in steps of 2**(-1/8).

Defined results: a null or empty text has no spans.  Texts are read whole.  Places are code
points, ends exclusive.  Repeated rows repeat.  Spans begin in order; of those with one start the
kinds come as listed.  A token that overlaps a base span is not reported again.  Of tokens that
overlap each other the one that text explains least stays, on ties the longer, then the first.
An empty table gives none.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import mapped, packed, table, text_chunks, unpacked, written

#: Shortest token that is tested; level at which the battery rejects randomness; false-discovery rate.
SHORTEST, LEVEL, RATE = 20, 1e-3, 0.01
#: Median of Fisher's sum for random strings: a still smaller sum is no stronger evidence.
MEDIAN = 5.348
#: Strings that each chain yields for each length, and those lengths; between them moments are interpolated.
DRAWN, LENGTHS = 512, (20, 28, 40, 64, 128, 256, 1024)
#: Kinds of spans in their order.
KINDS = ("assign", "access", "hex", "random")
#: Steps of p-values: bin b holds p from 2**(-(b + 1) / 8) to 2**(-b / 8).
BINS = 1024

_ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a shorter run holds no longer one
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_FAMILIES = [re.compile(rf"(?<![{c}])[{c}]{{{SHORTEST},}}") for c in ("A-Za-z0-9", "A-Za-z0-9+/", r"A-Za-z0-9_\-")]

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: encodings from the smallest alphabet on, symbols in their order
ALPHABETS = [
    _DIGITS, _DIGITS + _LOWER[:6], _DIGITS + _UPPER[:6], _LOWER, _UPPER, _UPPER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER,
    _UPPER + _LOWER, _UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_",
]
_ALL = _UPPER + _LOWER + _DIGITS + "+/-_"
_SETS = [frozenset(a) for a in ALPHABETS]
_SYMBOL = np.full(256, 255, np.uint8)
_SYMBOL[[ord(c) for c in _ALL]] = np.arange(len(_ALL))
_RANKS = np.full((len(ALPHABETS), 128), -1, np.int64)
for _k, _a in enumerate(ALPHABETS):
    _RANKS[_k, [ord(c) for c in _a]] = np.arange(len(_a))


def encoding(token):
    """Number of the smallest alphabet that holds a token's characters; None without one."""
    have = set(token)
    return next((k for k, s in enumerate(_SETS) if have <= s), None)


# ---------------------------------------------------------------- the battery


def _tail(z):
    """Chance of a normal deviate at least as far out on either side."""
    return np.maximum(np.vectorize(math.erfc, otypes=[float])(np.abs(z) / math.sqrt(2)), 1e-300)


def battery(ranks, m):
    """Fisher's sum of the three tests for each row of ranks from 0 to m - 1 (all rows of one length)."""
    rows, n = ranks.shape
    counts = np.bincount((ranks + np.arange(rows)[:, None] * m).ravel(), minlength=rows * m).reshape(rows, m)
    chi = (np.square(counts).sum(1) * (m / n)) - n
    # Wilson and Hilferty's cube root, with the exact mean and variance of few symbols over many classes
    mean, variance = m - 1.0, 2.0 * (m - 1) * (n - 1) / n
    df = 2 * mean * mean / variance
    z_chi = (np.cbrt(np.maximum(chi, 0) / mean) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = ranks >= m // 2
    above = high.sum(1)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    both = 2.0 * above * (n - above)
    expected, spread = both / n + 1, both * (both - n) / (float(n) * n * (n - 1))
    z_runs = np.where(spread > 0, (runs - expected) / np.sqrt(np.maximum(spread, 1e-9)), math.sqrt(n))
    x = ranks - ranks.mean(1, keepdims=True)
    square = np.square(x).sum(1)
    r = np.where(square > 0, (x[:, 1:] * x[:, :-1]).sum(1) / np.maximum(square, 1e-9), 1.0)
    z_serial = (r + 1.0 / n) * math.sqrt(n)
    return -2 * sum(np.log(_tail(z)) for z in (z_chi, z_runs, z_serial))


def chance(fisher):
    """Chance that random strings have a larger sum: chi-squared with six degrees of freedom."""
    h = fisher / 2
    return math.exp(-h) * (1 + h + h * h / 2)


# ---------------------------------------------------------------- ordinary text


def pair_counts(docs, text_col="text"):
    """(pair, n): neighbouring characters of tokens' alphabets in all texts, outside long tokens."""

    def run(batches):
        total = np.zeros(len(_ALL) ** 2, np.int64)
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0)):
                total += _pairs(data, offsets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["pair", "n"])

    return docs.select(text_col).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _pairs(data, offsets):
    """Counts of neighbouring symbols, spaces and other characters between words left out; rows don't touch."""
    symbol = _SYMBOL[data]
    inside = symbol < 255
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[inner] = inside[inner]
    last[:-1] &= ~inside[1:]
    last[inner[inner > 0] - 1] = inside[inner[inner > 0] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    for a, b in zip(begin[end - begin >= SHORTEST], end[end - begin >= SHORTEST]):
        inside[a:b] = False
    at = np.flatnonzero(inside)
    row = np.searchsorted(offsets, at, "right")
    own = symbol[at].astype(np.int64)
    pair = (own[:-1] * len(_ALL) + own[1:])[row[1:] == row[:-1]]
    return np.bincount(pair, minlength=len(_ALL) ** 2)


#: a little plain text, so that there is a chain where a corpus is nearly empty
_PLAIN = "The words of ordinary text follow one another by habit 2 or 3 letters at a time and Most Of Them are short in 1999 as in 2024 or 1850"


def fit_text_model(docs, text_col="text"):
    """Packed moments of the sum's logarithm for each encoding and length; at most 66 * 66 counts reach the driver."""
    n = len(_ALL)
    total = _pairs(np.frombuffer(_PLAIN.encode(), np.uint8), np.array([0, len(_PLAIN)])).astype(np.float64)
    for r in pair_counts(docs, text_col).collect():
        total[r.pair] += r.n
    total = total.reshape(n, n)
    mean, deviation = np.zeros((len(ALPHABETS), len(LENGTHS))), np.zeros((len(ALPHABETS), len(LENGTHS)))
    for k, alphabet in enumerate(ALPHABETS):
        own = [_ALL.index(c) for c in alphabet]
        chain = total[np.ix_(own, own)] + 1e-3
        first, following = chain.sum(1).cumsum(), chain.cumsum(1)
        rng = np.random.default_rng(k)
        state = np.searchsorted(first, rng.random(DRAWN) * first[-1])
        drawn = np.empty((DRAWN, max(LENGTHS)), np.int64)
        for i in range(max(LENGTHS)):
            drawn[:, i] = state
            edge = rng.random(DRAWN) * following[state, -1]
            state = np.minimum((following[state] <= edge[:, None]).sum(1), len(alphabet) - 1)
        for j, length in enumerate(LENGTHS):
            log = np.log(np.maximum(battery(drawn[:, :length], len(alphabet)), 1e-6))
            mean[k, j], deviation[k, j] = log.mean(), max(log.std(), 0.05)
    return packed({"mean": mean, "deviation": deviation})


def token_bin(token, model):
    """Bin of the chance that ordinary text looks as random as a token; 0 if the battery rejects randomness."""
    k = encoding(token)
    fisher = float(battery(_RANKS[k, np.frombuffer(token.encode(), np.uint8)][None], len(ALPHABETS[k]))[0])
    if chance(fisher) < LEVEL:
        return 0
    at = math.log(min(max(len(token), LENGTHS[0]), LENGTHS[-1]))
    grid = np.log(LENGTHS)
    z = (math.log(max(fisher, MEDIAN)) - np.interp(at, grid, model["mean"][k])) / np.interp(at, grid, model["deviation"][k])
    # a logistic tail: text strays further than a normal deviate would
    p = 1 / (1 + math.exp(min(-z * math.pi / math.sqrt(3), 700)))
    return min(int(-8 * math.log2(p)), BINS - 1)


# ---------------------------------------------------------------- spans


def base_spans(text):
    """(start, kind, end) of the three patterns, in order; kinds by number."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def tokens(text, model):
    """(start, bin, end) of the long tokens, no two of which overlap."""
    found = {m.span() for family in _FAMILIES for m in family.finditer(text)}
    kept = []
    for b, a, e in sorted((-token_bin(text[a:e], model), a, e) for a, e in found if encoding(text[a:e]) is not None):
        if all(e <= x or a >= y for x, _, y in kept):
            kept.append((a, -b, e))
    return sorted(kept)


def scan(docs, model, id_col="doc_id", text_col="text"):
    """id, base (start, kind, end) and tokens (start, bin, end, apart): ``apart`` where no base span is overlapped."""
    src = docs.select(id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = f"text-{hash(model)}"
    span, token = "start int, kind int, `end` int", "start int, bin int, `end` int, apart boolean"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    token_type = pa.list_(pa.struct([("start", pa.int32()), ("bin", pa.int32()), ("end", pa.int32()), ("apart", pa.bool_())]))

    def run(batches):
        own = unpacked(mapped(key, shared))
        for batch in batches:
            bases, others = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                bases.append([{"start": a, "kind": k, "end": e} for a, k, e in base])
                others.append([{"start": a, "bin": b, "end": e, "apart": all(e <= x or a >= y for x, _, y in base)} for a, b, e in tokens(text, own)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, span_type), pa.array(others, token_type)], names=[id_col, "base", "tokens"])

    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, base array<struct<{_colons(span)}>>, tokens array<struct<{_colons(token)}>>")


def _colons(fields):
    return ", ".join(f"{n}: {t}" for n, t in (f.split() for f in fields.split(", ")))


def discovery_bin(counts, rate=RATE):
    """The least bin whose tokens are discoveries, from {bin: number}, by the step-up; BINS if there is none."""
    total, seen, least = sum(counts.values()), 0, BINS
    for b in sorted(counts, reverse=True):
        seen += counts[b]
        if 2.0 ** (-b / 8) <= rate * seen / total:
            least = b
    return least


def find_secrets(docs, id_col="doc_id", text_col="text", rate=RATE):
    """id, base and spans: all secrets as (start, kind, end), kinds by number in ``KINDS``."""
    spark = docs.sparkSession
    found = written(spark, scan(docs, fit_text_model(docs, text_col), id_col, text_col), "tokens")
    # one count for each of the BINS steps
    counts = {r.bin: r.n for r in found.select(F.explode("tokens.bin").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = discovery_bin(counts, rate)
    random = F.expr(f"transform(filter(tokens, t -> t.apart AND t.bin >= {least}), t -> named_struct('start', t.start, 'kind', {KINDS.index('random')}, 'end', t.`end`))")
    return found.select(id_col, "base", F.array_sort(F.concat("base", random)).alias("spans"))


def spans_text(spans):
    """Column: ``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
