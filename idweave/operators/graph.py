"""Tag co-occurrence graphs: nodes are tags, edges count neighbouring tags within identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.stored import stored
from .search import query_tags


def tag_nodes(identifiers):
    """Every distinct tag, also of names of one tag."""
    # not a bare column: for that Spark would add a filter that repeats the parse
    return identifiers.select(F.explode(F.expr("IF(size(tags) > 0, tags, NULL)")).alias("tag")).distinct()


def tag_edges(identifiers, count_col: str | None = None):
    """(src, dst, weight): occurrences of neighbouring tags; each repetition counts, loops are edges.

    ``count_col`` says how often a row's name occurs; without it each row is one occurrence.
    """
    # the size is tested inside the generator: a filter would be pushed below the parse and repeat it
    pairs = F.expr("IF(size(tags) < 2, NULL, transform(sequence(1, size(tags) - 1), i -> struct(tags[i - 1] AS src, tags[i] AS dst)))")
    found = identifiers.select((F.lit(1) if count_col is None else F.col(count_col)).cast("long").alias("n"), F.explode(pairs).alias("e"))
    return found.groupBy(F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).agg(F.sum("n").alias("weight"))


def subgraph(nodes, edges, query: str):
    """(nodes, edges) of the query's tags and their direct neighbours, with all edges among those.

    Nodes and edges, which are few beside the names, are stored once: they are read several times here.
    """
    spark = edges.sparkSession
    nodes, edges = stored(spark, nodes, "nodes"), stored(spark, edges, "edges")
    wanted = query_tags(query)
    seeds = nodes.filter(F.expr(f"array_contains({wanted}, tag)"))
    near = edges.filter(F.expr(f"array_contains({wanted}, src) OR array_contains({wanted}, dst)"))
    kept = seeds.unionByName(near.select(F.explode(F.array("src", "dst")).alias("tag"))).distinct()
    inner = edges.join(kept.withColumnRenamed("tag", "src"), "src", "left_semi").join(kept.withColumnRenamed("tag", "dst"), "dst", "left_semi")
    return kept, inner.select("src", "dst", "weight")


def dot_lines(edges):
    """The line of each edge in DOT form, with its sort keys."""
    line = F.concat(F.lit('\t"'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), F.col("weight").cast("string"), F.lit('"];'))
    return edges.select("src", "dst", "weight", line.alias("dot"))
