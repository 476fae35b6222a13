"""Search by tags: a query matches a name that holds all of its tags, in any order and spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..sources.stored import stored


def query_tags(query: str) -> str:
    """SQL: the tags of a query string, which is parsed like any name."""
    q = names.text(query)
    return names.tags(q, f"({names.convention(q)})")


def holds(tags: str, wanted: str) -> str:
    """SQL: whether ``tags`` holds every tag of ``wanted``, in any order."""
    return f"forall({wanted}, q -> array_contains({tags}, q))"


def holds_in_order(tags: str, wanted: str) -> str:
    """SQL: whether ``wanted`` is a subsequence of ``tags``.

    An automaton over the tags: its state is the number of wanted tags that were met, and a tag
    that is the next wanted one moves it on.  The earliest match of each is enough.
    """
    step = f"at + IF(coalesce(t = try_element_at({wanted}, at + 1), false), 1, 0)"
    return f"aggregate({tags}, 0, (at, t) -> {step}) = size({wanted})"


def search(identifiers, query: str, ordered: bool = False):
    """Occurrences whose tags hold every tag of the query; an empty query matches all.

    With ``ordered`` the query's tags stand in the name in the query's order, others between
    them or not, and a tag that the query repeats is needed as often.
    """
    test = F.expr((holds_in_order if ordered else holds)("tags", f"({query_tags(query)})"))
    # a tag of ASCII letters stands in the name itself: names without one are not parsed
    for tag in identifiers.sparkSession.sql(f"SELECT {query_tags(query)}").first()[0]:
        if tag.isascii():
            test = F.contains(F.lower("identifier"), F.lit(tag)) & test
    hits = identifiers.filter(test)
    return hits.select(*[c for c in ("file", "line", "column", "identifier", "convention", "tags", "role", "shape") if c in hits.columns])


def ordered(hits):
    """Hits by file, line and column."""
    return hits.orderBy("file", "line", "column")


#: Tasks that the names of one tag are dealt to.
SPREAD = 16


def search_many(identifiers, queries, query_col: str = "query", ordered: bool = False):
    """(query, file, line, column, identifier) of all queries of a table at once.

    Queries with the same tags are one search.  A search is joined with the names that hold its
    rarest tag only (a name or search of any other tag is not looked at), then all of its tags are
    tested, so the rows examined are bounded by its rarest tag's names; a search with a tag that no
    name holds ends there.  The names of a tag are dealt to SPREAD tasks, the searches, which are
    the few, go to each of them.  Queries without tags match all rows and are left out here: use
    ``search`` for them.
    """
    spark = identifiers.sparkSession
    names_ = stored(spark, identifiers.select("identifier", "tags").distinct(), "names")
    postings = names_.select("identifier", "tags", F.explode(F.array_distinct("tags")).alias("tag"))
    common = postings.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))

    q = names.parse(queries.select(F.col(query_col).alias("identifier")).distinct()).select(F.col("identifier").alias(query_col), "tags")
    q = q.filter(F.size("tags") > 0).withColumn("wanted", F.col("tags") if ordered else F.array_sort(F.array_distinct("tags"))).drop("tags")
    searches = q.select("wanted").distinct()
    counted = searches.select("wanted", F.explode(F.array_distinct("wanted")).alias("tag")).join(common, "tag", "left")
    rarest = counted.groupBy("wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tag")).alias("rarest")).filter("rarest.n > 0")
    rarest = rarest.select("wanted", F.col("rarest.tag").alias("tag"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    own = postings.withColumn("part", F.pmod(F.xxhash64("identifier"), F.lit(SPREAD)).cast("int"))
    hit = own.join(rarest, ["tag", "part"]).filter(F.expr((holds_in_order if ordered else holds)("tags", "wanted"))).select("identifier", "wanted")
    return identifiers.join(hit, "identifier").join(q, "wanted").select(query_col, "file", "line", "column", "identifier")
