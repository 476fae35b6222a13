"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's word 5-grams (a shorter text is one n-gram of all its words) are hashed once.  The
top bits of a hash choose one of ``BINS`` bins, and each bin keeps its least hash.  Empty bins
are filled by optimal densification: bin i takes the value of the first filled bin in its own
pseudo-random order of all bins, which does not depend on the text.  Of each bin only the low
``BITS`` bits are stored, packed as hexadecimal digits.  The likeness of two fingerprints is
the share of equal bins, corrected for the 2**-BITS of them that agree by chance.

The edited text of a row ends with a piece of the next row's text.  Rows are dealt to ranges of
(id, hash of the text) whose bounds come from a random sample of bounded size; the first row of
each range also goes to the range before it, so that every row meets the next one in its own range.
Many rows with one id are split by their texts.  Of very many equal rows all but one range's worth
are followed by an equal row wherever they go, so they are dealt out at random.

Defined results: a null text counts as empty; texts without words share one fingerprint.  Rows
are ordered by id, then by the text's xxhash64; null ids come first; after the last row comes the
first.  A table of one row is followed by itself.  An empty table gives none.
"""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import table

N, BINS, BITS = 5, 128, 8
#: Rows of a range on average, ranges at most (beyond RANGE_ROWS * MOST_RANGES rows they grow, and Spark's window spills),
#: and sampled rows for each range: the bounds come from MOST_RANGES * SAMPLED rows of two numbers at most.
RANGE_ROWS, MOST_RANGES, SAMPLED = 512, 1 << 17, 16

#: bits below a bin's number in a hash without its sign
_LOW = 63 - (BINS.bit_length() - 1)


def _order(i):
    """Step of bin i's order of the bins: place t is bin (i + t * step) % BINS; steps are odd, so all bins have a place."""
    h = (i * 0x9E3779B1 + 0x85EBCA6B) & 0xFFFFFFFF
    h = ((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
    h = ((h ^ h >> 12) * 0x297A2D39) & 0xFFFFFFFF
    return (h ^ h >> 15) % BINS | 1


#: place of bin j in bin i's order: (j - i) * _BACK[i] % BINS
_BACK = [pow(_order(i), -1, BINS) for i in range(BINS)]


def _let(name, value, body):
    """SQL for ``body`` with ``value`` computed once under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def fingerprint(text):
    """Column: the fingerprint of the text column named ``text``, as BINS * BITS / 4 hexadecimal digits."""
    words = rf"filter(split(coalesce({text}, ''), r'[\x20\x09-\x0D]+'), x -> x <> '')"
    grams = (
        f"CASE WHEN size(w) >= {N} THEN transform(sequence(0, size(w) - {N}), "
        f"i -> shiftrightunsigned(xxhash64({', '.join(f'w[i + {k}]' for k in range(N))}), 1)) "
        f"ELSE array(shiftrightunsigned(xxhash64(w), 1)) END"
    )
    least = f"filter(s, (x, i) -> i = 0 OR shiftright(x, {_LOW}) <> shiftright(s[i - 1], {_LOW}))"
    digits = f"transform(f, x -> substring(hex({1 << BITS} + (x & {(1 << BITS) - 1})), 2))"
    # an empty bin's donor: place in the bin's order and position among the filled ones in one number
    donor = f"array_min(transform(b, (j, p) -> shiftleft(((j - i) * back) & {BINS - 1}, 12) | p)) & 4095"
    filled = f"transform(array({', '.join(map(str, _BACK))}), (back, i) -> {_let('at', 'array_position(b, i)', f'v[IF(at > 0, CAST(at AS INT) - 1, {donor})]')})"
    body = _let("b", f"transform(f, x -> CAST(shiftright(x, {_LOW}) AS INT))", _let("v", digits, f"array_join({filled}, '')"))
    return F.expr(_let("w", f"transform({words}, x -> xxhash64(x))", _let("s", f"sort_array({grams})", _let("f", least, body))))


def likeness(a, b):
    """Column: estimated Jaccard similarity of the texts behind two fingerprint columns, 0 to 1."""
    chance = 2.0**-BITS
    size = BITS // 4
    same = f"size(filter(sequence(0, {BINS - 1}), i -> substring(x, i * {size} + 1, {size}) = substring(y, i * {size} + 1, {size})))"
    if BITS == 8:  # bytes compare without counting characters
        same = f"size(filter(sequence(1, {BINS}), i -> substring(x, i, 1) = substring(y, i, 1)))"
        a, b = f"unhex({a})", f"unhex({b})"
    share = F.expr(_let("x", a, _let("y", b, same))) / F.lit(float(BINS))
    return F.greatest(F.lit(0.0), (share - chance) / (1 - chance))


def _range_bounds(keys, n):
    """The ascending keys that begin a range, and how many ranges begin with each (over 1: very many equal rows)."""
    ranges = min(MOST_RANGES, -(-n // RANGE_ROWS))
    if ranges < 2:
        return []
    sample = keys.sample(min(1.0, SAMPLED * ranges / n), seed=17)
    places = sample.agg(F.sort_array(F.collect_list("key")).alias("keys")).select(F.explode(F.filter("keys", lambda _, i: i % SAMPLED == SAMPLED - 1)).alias("key"))
    return places.groupBy("key").agg(F.count(F.lit(1)).alias("times")).orderBy("key").collect()  # about MOST_RANGES rows at most


def _constant(values, kind):
    """Column: a constant array, written as JSON, which Catalyst reads once when it plans."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def with_next(docs, id_col, text_col, carried):
    """``docs`` (id, text and the columns ``carried``) with the next row's text and carried columns as ``next_*``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).alias("key")
    found = docs.select(key).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).first()
    bounds = _range_bounds(docs.select(key), found.n)
    kind = f"struct<id:{id_type},th:bigint>"
    begins = _constant([{"id": b.key.id, "th": b.key.th} for b in bounds], kind)
    times = _constant([b.times for b in bounds], "bigint")
    first = F.get(_constant([{"id": found.first.id, "th": found.first.th}] if found.n else [], kind), F.lit(0))
    rows = docs.withColumn("__key", key)
    # binary search: the number of bounds that are not above the key
    halves = F.array(*[F.lit(1 << e) for e in reversed(range(MOST_RANGES.bit_length()))])
    step = lambda k, half: F.when((k + half <= len(bounds)) & (F.get(begins, k + half - 1) <= F.col("__key")), k + half).otherwise(k)
    rows = rows.withColumn("__range", F.aggregate(halves, F.lit(0), step))
    leads = F.coalesce(F.get(begins, F.col("__range") - 1) == F.col("__key"), F.lit(False))
    rows = rows.withColumns({"__leads": leads, "__times": F.when(leads, F.get(times, F.col("__range") - 1)).otherwise(1), "__last": F.lit(len(bounds))})
    # equal rows that fill several ranges: one share stays in order, the others are followed by their like
    rows = rows.withColumn("__share", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "__times"))
    apart = F.col("__share") > 0
    # (range, 0) is the row itself; (range before, 1) the row that follows that range's last
    place = lambda r, share, after: F.struct(F.lit(r).cast("long").alias("r"), F.lit(share).cast("long").alias("s"), F.lit(after).alias("after"))
    own = place(F.col("__range"), F.col("__share"), 0)
    before = F.when(F.col("__leads") & ~apart, place(F.col("__range") - 1, 0, 1))
    around = F.when(F.col("__key").eqNullSafe(first) & ~apart, place(F.col("__last"), 0, 1))
    rows = rows.withColumn("__p", F.explode(F.filter(F.array(own, before, around), lambda p: p.isNotNull())))
    # the range is dealt by a hash of its number; ranges are many and even
    order = Window.partitionBy("__p.r", "__p.s").orderBy("__p.after", "__key.id", "__key.th")
    rows = rows.withColumns({f"next_{c}": F.coalesce(F.lead(c).over(order), F.when(apart, F.col(c))) for c in (text_col, *carried)})
    return rows.filter("__p.after = 0").drop("__key", "__range", "__leads", "__times", "__last", "__share", "__p")


def fingerprint_edits(docs, id_col="doc_id", text_col="text"):
    """id, n_chars, edited_sha256, both fingerprints and their likeness to each other and to the next row's."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("fingerprint", fingerprint("text"))
    rows = with_next(rows, "id", "text", ["fingerprint"])
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("id", F.length("text").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = rows.select("*", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("edited").alias("edited_fingerprint"))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def query(spark, sf_dir):
    return fingerprint_edits(table(spark, sf_dir, "documents"))
