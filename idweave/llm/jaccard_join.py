"""N-gram Jaccard self-join by MinHash banding.

Texts are sets of hashed word 5-grams (a shorter text is one n-gram of all its words).  Equal
sets are collapsed first.  Band and row counts follow from a target recall at the similarity
threshold; sets are shuffled on the hashes of their bands, and all pairs that share a bucket
are verified on the full n-gram sets.  No pair becomes a row: a task compares two blocks of a
bucket's sets by matrix products and sends, for each set, the number of its links and one edge
to the first set of its local component.  A pair that meets in several buckets counts in the
first of them only.  Buckets of any size are split into blocks, so no task holds a whole one:
blocks grow only where a bucket would have more than ``MOST_BLOCKS`` of them, so that a bucket
sends each of its sets to that many tasks at most, and a task works through large blocks in tiles.
Buckets with the same members are compared once.  The edges are then joined into classes
by alternating large-star and small-star rounds.

Result for each row: class_id, the least id of its class, and n_links, the number of other rows
whose set is at least as similar as the threshold (copies included).  There is one result for each
row; the representative of a class is its row with the least id.

Defined results: texts without words are alike to nothing (their class is their own id).  Rows
with a null id have a null class and no links.  Repeated rows are copies of each other.  Equal ids
on different texts are different rows: each has the links of its own text, and only the least id
of its class names that class, so classes of unlike texts may bear the same id.  An empty table
gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import checkpointed, mix, prefix_hashes, span_hashes, table, text_chunks, words, written

N, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Hash functions of a signature, at most.
MOST_HASHES = 192
#: Sets in a block, as long as a bucket has no more than MOST_BLOCKS; a task compares two blocks, in tiles of TILE sets.
BLOCK, MOST_BLOCKS, TILE = 256, 64, 256
#: Columns of the incidence matrix that are multiplied at a time.
WIDTH = 4096


def bands_for(threshold=THRESHOLD, recall=RECALL, most=MOST_HASHES):
    """(bands, rows): the most rows whose bands reach the recall at the threshold within ``most`` hashes."""
    best = None
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(data, offsets, n=N):
    """(row, hash) of the distinct word n-grams of each row, sorted by row and hash."""
    start, end, row = words(data, offsets)
    word = mix(span_hashes(prefix_hashes(data), start, end) + (end - start).astype(np.uint64))
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.zeros(0, np.int64)
    gram = np.zeros(len(first), np.uint64)
    for k in range(n):
        gram = mix(gram * np.uint64(3) + word[first + k])
    gram_row = row[first]
    # rows of fewer words: one n-gram of all of them
    short = np.flatnonzero((count > 0) & (count < n))
    at = np.searchsorted(row, short)
    whole = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        more = k < count[short]
        whole[more] = mix(whole[more] * np.uint64(3) + word[at[more] + k] + np.uint64(1))
    gram, gram_row = np.concatenate([gram, whole]), np.concatenate([gram_row, short])
    order = np.lexsort((gram, gram_row))
    gram, gram_row = gram[order], gram_row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (gram_row[1:] != gram_row[:-1])
    return gram_row[new], gram[new]


def _multipliers(n):
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def _signatures(batches, bands, rows):
    """(id, h1, h2, k1, k2, n, bands) of each row (id, h1, h2, text); k1 and k2 identify its set, null without words."""
    multipliers = _multipliers(bands * rows)
    names = ["id", "h1", "h2", "k1", "k2", "n", "bands"]
    for batch in batches:
        out = [[] for _ in range(5)]
        for i, data, offsets in text_chunks(batch.column(3)):
            row, gram = shingles(data, offsets)
            if not len(row):
                continue
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            k1, k2 = np.add.reduceat(mix(gram), first), np.add.reduceat(mix(gram ^ np.uint64(0x5851F42D4C957F2D)), first)
            band = np.zeros((len(first), bands), np.uint64)
            for b in range(bands):
                h = np.full(len(first), np.uint64(b + 1))
                for r in range(rows):
                    h = mix(h * np.uint64(3) + np.minimum.reduceat(gram * multipliers[b * rows + r], first))
                band[:, b] = h
            out[0].append(i + row[first])
            for k, x in enumerate((k1, k2, np.diff(np.append(first, len(row))), band.ravel()), 1):
                out[k].append(x.view(np.int64))
        at, k1, k2, n, band = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * bands), pa.array(band))
        keys = lambda at: [batch.column(k).take(pa.array(at, pa.int64())) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*keys(at), pa.array(k1), pa.array(k2), pa.array(n), lists], names=names)
        rest = np.setdiff1d(np.arange(batch.num_rows), at)
        if len(rest):
            yield pa.RecordBatch.from_arrays([*keys(rest), *[pa.nulls(len(rest), pa.int64())] * 3, pa.nulls(len(rest), pa.list_(pa.int64()))], names=names)


def _sets(batches):
    """(id, places, copies, grams) of each text (id, places, copies, text)."""
    for batch in batches:
        sizes, grams = np.zeros(batch.num_rows, np.int64), [np.zeros(0, np.uint64)]
        for i, data, offsets in text_chunks(batch.column(3)):
            row, gram = shingles(data, offsets)
            sizes[i : i + len(offsets) - 1] = np.bincount(row, minlength=len(offsets) - 1)
            grams.append(gram)
        at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate(grams).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], names=["id", "places", "copies", "grams"])


def _overlaps(gram, member, left, right):
    """Sizes of the intersections of members [0, left) with members of [right[0], right[1])."""
    order = np.argsort(gram, kind="stable")
    gram, member = gram[order], member[order]
    column = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    shared = np.bincount(column)[column] > 1 if len(gram) else np.zeros(0, bool)
    column, member = column[shared], member[shared]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    n = right[1]
    out = np.zeros((left, right[1] - right[0]), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        lo, hi = np.searchsorted(column, [a, a + WIDTH])
        x = np.zeros((n, min(WIDTH, int(column[-1]) + 1 - a)), np.float32)
        x[member[lo:hi], column[lo:hi] - a] = 1
        out += x[:left] @ x[right[0] :].T
    return out


def _joined(label, i, j):
    """``label`` (the least index of each node's component so far) after adding the edges (i, j)."""
    while True:
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return label
        label = label.copy()
        np.minimum.at(label, high, low)  # roots point to lower roots
        while (label[label] != label).any():
            label = label[label]


def compare(ids, blocks, copies, sizes, gram, places, band, threshold, pair, tile=None):
    """(id, root id, links) of the members of one group that have links: a block, or two blocks across.

    ``places`` has each member's bucket in each band (0: none that counts); a pair counts here
    only if ``band`` is the first band whose bucket both share.
    """
    tile = tile or TILE
    end = np.cumsum(sizes)
    grams = lambda members: np.concatenate([gram[end[m] - sizes[m] : end[m]] for m in members.tolist()])
    tiles = [[own[a : a + tile] for a in range(0, len(own), tile)] for own in (np.flatnonzero(blocks == b) for b in pair)]
    across = pair[0] != pair[1]
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for x, left in enumerate(tiles[0]):
        for y in range(0 if across else x, len(tiles[1])):
            right, other = tiles[1][y], across or y > x
            both = np.concatenate([left, right]) if other else left
            member = np.repeat(np.arange(len(both)), sizes[both])
            from_ = len(left) if other else 0
            common = _overlaps(grams(both), member, len(left), (from_, len(both)))
            # the same test as |A & B| / |A | B| >= threshold, without rounding in the quotient
            union = sizes[left][:, None] + sizes[right][None] - common
            linked = common >= threshold * union - 1e-9
            if not other:
                np.fill_diagonal(linked, False)
            i, j = np.nonzero(linked)
            i, j = left[i], right[j]
            first = np.ones(len(i), bool)
            for b in range(band):
                first &= ~((places[i, b] == places[j, b]) & (places[i, b] != 0))
            i, j = i[first], j[first]
            np.add.at(links, i, copies[j])
            if other:
                np.add.at(links, j, copies[i])
            if len(i):
                label = _joined(label, i, j)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    used = np.flatnonzero(links > 0)
    return ids[used], least[label[used]], links[used]


def _groups(batches, keys):
    """Tables of the rows with equal keys, from batches that are sorted by them."""
    rest = None
    for batch in batches:
        own = pa.Table.from_batches([batch])
        own = own if rest is None else pa.concat_tables([rest, own]).combine_chunks()
        if not own.num_rows:
            continue
        values = [own.column(k).to_numpy() for k in keys]
        new = np.zeros(own.num_rows - 1, bool)
        for v in values:
            new |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield own.slice(a, b - a)
        rest = own.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _compare_groups(batches, bands, threshold):
    """(id, root, links) of every group of (bucket, band, b0, b1, block, id, copies, places, grams)."""
    out, size = [[], [], []], 0
    emit = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], names=["id", "root", "links"])
    for group in _groups(batches, ["bucket", "b0", "b1"]):
        if group.num_rows < 2:
            continue
        group = group.combine_chunks()
        one = lambda name: group.column(name).chunk(0)
        grams = one("grams")
        vectors = np.asarray(one("places").flatten()).reshape(-1, bands)
        found = compare(
            np.asarray(one("id")), np.asarray(one("block")), np.asarray(one("copies")), np.asarray(grams.value_lengths()), np.asarray(grams.flatten()),
            vectors, int(one("band")[0].as_py()), threshold, (one("b0")[0].as_py(), one("b1")[0].as_py()),
        )
        for k, x in enumerate(found):
            out[k].append(x)
        size += len(found[0])
        if size > 50_000:
            yield emit()
            out, size = [[], [], []], 0
    yield emit()


def classes(spark, edges):
    """(node, root) of every node of the edges (u, v): root is the least node of its connected component.

    Alternating large-star and small-star rounds until nothing changes; each round's edges are checkpointed.
    """
    edges = checkpointed(spark, edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = checkpointed(spark, large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpointed(spark, small.select("e.u", "e.v").filter("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def _sets_of(docs, id_col, text_col, threshold, recall, block, most_blocks=MOST_BLOCKS):
    """(rows, sets): id, k1 and k2 of every row with an id, and what became of each set.

    A set (k1, k2) has the least row (id, h1, h2) that holds it, the least of its class and the links of its rows; h1
    and h2 identify a text.
    """
    spark = docs.sparkSession
    bands, rows = bands_for(threshold, recall)
    known = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("text")).filter("id is not null")
    schema = "id long, h1 long, h2 long, k1 long, k2 long, n long, bands array<long>"
    signed = written(spark, known.mapInArrow(lambda b: _signatures(b, bands, rows), schema), "signatures")
    # what is joined back is written first: both sides of each join are then plain exchanges, and the
    # rows of a set with very many copies can be split over tasks
    heads = signed.filter("k1 is not null").groupBy("k1", "k2").agg(F.min(F.struct("id", "h1", "h2")).alias("head"), F.count(F.lit(1)).alias("copies"))
    # a number for each set: ids may stand on several texts
    heads = written(spark, heads.select("k1", "k2", "head", "copies", F.monotonically_increasing_id().alias("set")), "heads")

    # buckets: one row for each band of each set
    first = heads.select("k1", "k2", "head.*", "copies", "set")
    keys = ["k1", "k2", "id", "h1", "h2"]
    banded = signed.select(*keys, "bands").join(first, keys).dropDuplicates(keys).select("set", "id", "h1", "h2", "copies", F.posexplode("bands").alias("band", "bucket"))
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("who"), F.min("set").alias("least")).filter("size > 1")
    buckets = buckets.groupBy("who", "size", "least").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    placed = written(spark, banded.join(buckets, "bucket"), "placed")
    place = F.struct(F.col("band").cast("long").alias("band"), "bucket", "size")
    places = placed.groupBy("id", "h1", "h2").agg(F.max("set").alias("set"), F.max("copies").alias("copies"), F.collect_list(place).alias("places"))
    # at every size a join by shuffle, never a broadcast: the sets that share a bucket grow with the input
    looked = known.join(places.hint("merge"), ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"]).select("set", "places", "copies", "text")
    kind = "array<struct<band:bigint,bucket:bigint,size:bigint>>"
    sets = looked.mapInArrow(_sets, f"id long, places {kind}, copies long, grams array<long>")
    vector = F.expr(f"transform(sequence(0, {bands - 1}), b -> coalesce(try_element_at(filter(places, p -> p.band = b), 1).bucket, 0L))")
    sets = sets.select("id", "copies", "grams", vector.alias("vector"), F.explode("places").alias("p"))
    sets = sets.select("id", "copies", "grams", F.col("vector").alias("places"), "p.band", "p.bucket", F.least(F.ceil(F.col("p.size") / F.lit(block)), F.lit(most_blocks)).alias("blocks"))
    sets = sets.withColumn("block", F.pmod(F.xxhash64("id", "bucket"), "blocks"))
    # a block meets itself and each other block once
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sets = sets.withColumns({"b0": F.least("block", "other"), "b1": F.greatest("block", "other")})
    sets = sets.select("bucket", "band", "b0", "b1", "block", "id", "copies", "places", "grams")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = sets.repartition(parts, "bucket", "b0", "b1").sortWithinPartitions("bucket", "b0", "b1")
    found = written(spark, sets.mapInArrow(lambda b: _compare_groups(b, bands, threshold), "id long, root long, links long"), "links")

    links = written(spark, found.groupBy("id").agg(F.sum("links").alias("links")).select(F.col("id").alias("set"), "links"), "link-counts")
    roots = classes(spark, found.select(F.col("id").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("set"), "root")
    linked = roots.unionByName(roots.select(F.col("root").alias("set"), "root").distinct())
    least = linked.join(heads.select("set", "head"), "set").groupBy("root").agg(F.min("head").alias("least"))
    each = heads.join(links, "set", "left").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")).join(least, "root", "left")
    each = each.select("k1", "k2", "head", F.least("head", "least").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("id", "h1", "h2", "k1", "k2"), written(spark, each, "classes")


def _keys(id_col, text_col):
    """id, and 128 bits that identify the text."""
    text = F.col(text_col)
    return F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def jaccard_classes(docs, id_col="doc_id", text_col="text", threshold=THRESHOLD, recall=RECALL, block=BLOCK, most_blocks=MOST_BLOCKS):
    """id, class_id and n_links of every row; ids are integers."""
    rows, sets = _sets_of(docs, id_col, text_col, threshold, recall, block, most_blocks)
    worded = rows.join(sets, ["k1", "k2"]).select("id", F.col("least.id").alias("class_id"), "n_links")
    none = F.lit(0).cast("long").alias("n_links")
    out = worded.unionByName(rows.filter("k1 is null").select("id", F.col("id").alias("class_id"), none))
    out = out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "class_id", "n_links")
    return out.unionByName(docs.filter(F.col(id_col).cast("long").isNull()).select(id_col, F.lit(None).cast("long").alias("class_id"), none))


def keep_representatives(docs, id_col="doc_id", text_col="text", threshold=THRESHOLD):
    """The row of each class with the least id, with all its columns; rows with a null id stay."""
    rows, sets = _sets_of(docs, id_col, text_col, threshold, RECALL, BLOCK)
    heads = sets.filter("head = least").select("head.*").unionByName(rows.filter("k1 is null").select("id", "h1", "h2"))
    own = [f"__{k}" for k in heads.columns]
    keyed = docs.select("*", *[k.alias(name) for k, name in zip(_keys(id_col, text_col), own)])
    kept = keyed.join(heads.toDF(*own), own, "left_semi").dropDuplicates(own)
    return kept.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))


def query(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))
