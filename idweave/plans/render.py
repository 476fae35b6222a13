"""Renderers: rows as text or JSON lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Display -> spelling in JSON and in text listings (fixed values).
JSON_SPELLING = {"snake_case": "snake_case", "camelCase": "camel_case", "PascalCase": "pascal_case", "kebab-case": "kebab_case", "UPPER_SNAKE_CASE": "upper_snake_case", "Ada_Case": "ada_case"}
DEBUG_SPELLING = {"snake_case": "SnakeCase", "camelCase": "CamelCase", "PascalCase": "PascalCase", "kebab-case": "KebabCase", "UPPER_SNAKE_CASE": "UpperSnakeCase", "Ada_Case": "AdaCase"}


def spelled(column, spelling):
    """Column: a convention in another spelling."""
    out = F
    for display, other in spelling.items():
        out = out.when(column == display, F.lit(other))
    return out


def extract_lines(identifiers):
    """Text line of each occurrence: place, name, tags, convention, context, role and shape, with tabs between."""
    listed = F.concat(F.lit("["), F.array_join("tags", ", "), F.lit("]"))
    none = lambda c: F.coalesce(F.col(c), F.lit("none"))
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    line = F.concat_ws("\t", place, "identifier", listed, spelled(F.col("convention"), DEBUG_SPELLING), F.concat(F.lit("ctx:"), none("context")), F.concat(F.lit("role:"), none("role")), F.concat(F.lit("shape:"), none("shape")))
    return identifiers.select("file", "line", "column", line.alias("text"))


def search_lines(hits):
    """Text line of each hit: place, name and convention, with tabs between."""
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    return hits.select("file", "line", "column", F.concat_ws("\t", place, "identifier", spelled(F.col("convention"), DEBUG_SPELLING)).alias("text"))


def lint_lines(violations):
    """Text line of each violation."""
    label = F.when(F.col("expected_convention") == "PascalCase", "type").when(F.col("expected_convention").isin("UPPER_SNAKE_CASE", "upper_snake", "screaming"), "constant").otherwise("identifier")
    line = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"), F.lit(" warning: "), label, F.lit(" `"), "identifier", F.lit("` should be "), "expected_convention", F.lit(" → `"), F.coalesce("suggested_fix", F.lit("?")), F.lit("`"))
    return violations.select("file", "line", "column", line.alias("text"))


def parsed_json(identifiers):
    """JSON of each parsed name; conventions in their JSON spelling, a missing context is left out."""
    parsed = F.struct(F.col("identifier").alias("original"), spelled(F.col("convention"), JSON_SPELLING).alias("convention"), "tags", "namespaces", "role", "shape")
    return F.to_json(parsed, {"ignoreNullFields": "false"})


def edge_json(edges):
    """JSON of each edge, as a graph's JSON text holds it."""
    return edges.select("src", "dst", F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "weight")).alias("json"))


def node_json(nodes, edges):
    """JSON of each node, as a graph's JSON text holds it, and whether no edge touches it."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias("tag")).distinct().withColumn("touched", F.lit(True))
    return nodes.join(touched, "tag", "left").select("tag", F.regexp_extract(F.to_json(F.array("tag")), r"(?s)^\[(.*)\]$", 1).alias("json"), F.col("touched").isNull().alias("isolated"))


def parse_text(row) -> str:
    """The listing of one parsed name."""
    out = [f"name:       {row['identifier']}", f"convention: {row['convention']}", f"tags:       [{', '.join(row['tags'])}]"]
    out += [f"dimension {i}: [{', '.join(d)}]" for i, d in enumerate(row["namespaces"])]
    out += [f"{k}:{' ' * (11 - len(k))}{row[k]}" for k in ("role", "shape") if row[k] is not None]
    return "\n".join([*out, f"canonical:  {'_'.join(row['tags'])}"])


def dot(edges) -> str:
    """DOT text of an edge table, for graphs that a reader can look at: one row for each edge comes to the driver."""
    from ..operators.graph import dot_lines

    rows = dot_lines(edges).orderBy("src", "dst", "weight").select("dot").toLocalIterator()
    return "digraph tags {\n\trankdir=LR;\n" + "".join(r.dot + "\n" for r in rows) + "}\n"


def graph_json(nodes, edges) -> dict:
    """Nodes and edges in order, for graphs that a reader can look at."""
    return {
        "nodes": [r.tag for r in nodes.orderBy("tag").toLocalIterator()],
        "edges": [{"from": r.src, "to": r.dst, "weight": r.weight} for r in edges.orderBy("src", "dst").toLocalIterator()],
    }
