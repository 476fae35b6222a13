"""Command line over the operators: ``python -m idweave.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import names
from .operators import classify, extract, graph, lint, search
from .plans import config, render
from .sources import files


def _session():
    return SparkSession.builder.appName("idweave").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _parse(spark, name, convention=None):
    rows = spark.createDataFrame([(name, convention)], "identifier string, given string")
    return names.parse(rows, convention_col="given")


def _json(rows):
    return json.dumps(rows, indent=2, ensure_ascii=False)


def _occurrences(df):
    """Rows as JSON values, streamed to the terminal."""
    parsed = F.from_json(render.parsed_json(None), "original string, convention string, tags array<string>, namespaces array<array<string>>, role string, shape string")
    for r in df.select("file", "line", "column", "identifier", parsed.alias("parsed"), "context").toLocalIterator():
        row = r.asDict(recursive=True)
        yield {k: v for k, v in row.items() if k != "context" or v is not None}


def cmd_parse(spark, a):
    row = _parse(spark, a.name, a.convention)
    if a.format == "json":
        return print(_json(json.loads(row.select(render.parsed_json(None).alias("j")).first().j)))
    print(render.parse_text(row.first()))


def cmd_init(_, a):
    if os.path.exists(config.FILE_NAME):
        sys.exit(f"{config.FILE_NAME} already exists")
    with open(config.FILE_NAME, "w") as f:
        f.write(config.generate(a.lang, a.preset))
    print(f"Created {config.FILE_NAME}")


def cmd_lint(spark, a):
    found = config.find(a.path)
    if found is None:
        sys.exit(f"error: no {config.FILE_NAME} found (searched from {a.path} upward)")
    try:
        rules = lint.rules_frame(spark, config.resolve(found))
    except config.ConfigError as e:
        sys.exit(f"error: {e}")
    rows = lint.lint(classify.extract_with_context(files.read_tree(spark, a.path)), rules).orderBy("file", "line", "column").cache()
    n = rows.count()
    if not n:
        return print("No naming convention violations found.")
    if a.format == "json":
        print(_json([r.asDict() for r in rows.toLocalIterator()]))
    else:
        for r in render.lint_lines(rows).orderBy("file", "line", "column").toLocalIterator():
            print(r.text)
        print(f"\nFound {n} violation(s).", file=sys.stderr)
    sys.exit(1)


def cmd_extract(spark, a):
    tree = files.read_tree(spark, a.path)
    found = (classify.extract_with_context(tree) if a.ast else extract.extract_identifiers(tree)).orderBy("file", "line", "column")
    if a.format == "json":
        return print(_json(list(_occurrences(found))))
    for r in render.extract_lines(found).toLocalIterator():
        print(r.text)


def cmd_search(spark, a):
    hits = search.ordered(search.search(extract.extract_identifiers(files.read_tree(spark, a.path, extract.MAX_FILE_SIZE)), a.query))
    if a.format == "json":
        spelled = hits.withColumn("convention", render.spelled(F.col("convention"), render.JSON_SPELLING))
        return print(_json([r.asDict(recursive=True) for r in spelled.toLocalIterator()]))
    for r in render.search_lines(hits).toLocalIterator():
        print(r.text)


def cmd_alias(spark, a):
    wanted = names.parse_convention(a.convention or "")
    row = _parse(spark, a.name).select("tags", F.expr(names.aliases("tags")).alias("aliases")).first()
    found = {k: v for k, v in sorted(row.aliases.items()) if wanted in (None, k)}
    if a.format == "json":
        return print(_json({"tags": row.tags, "aliases": found}))
    for k, v in found.items():
        print(f"{k + ':':<16} {v}")


def cmd_prose(spark, a):
    row = names.describe(_parse(spark, a.name)).select(F.col("identifier").alias("original"), "prose", "tags", "role", "shape").first()
    print(_json(row.asDict()) if a.format == "json" else row.prose)


def cmd_graph(spark, a):
    found = extract.extract_identifiers(files.read_tree(spark, a.path, extract.MAX_FILE_SIZE))
    nodes, edges = graph.tag_nodes(found), graph.tag_edges(found)
    if a.query is not None:
        nodes, edges = graph.subgraph(nodes, edges, a.query)
    print(_json(render.graph_json(nodes, edges)) if a.format == "json" else render.dot(edges), end="\n" if a.format == "json" else "")


def main(argv=None):
    parser = argparse.ArgumentParser(prog="idweave", description="Identifier analytics on Spark")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name, *arguments, run):
        sub = commands.add_parser(name)
        for flags, options in arguments:
            sub.add_argument(*flags, **options)
        if name != "init":
            sub.add_argument("-f", "--format", default="text")
        sub.set_defaults(run=run)

    named, conv = (("name",), {}), (("-c", "--convention"), {})
    path = (("path",), {"nargs": "?", "default": "."})
    command("parse", named, conv, run=cmd_parse)
    command("init", (("-l", "--lang"), {}), (("-p", "--preset"), {}), run=cmd_init)
    command("lint", path, run=cmd_lint)
    command("extract", (("path",), {}), (("--ast",), {"action": "store_true"}), run=cmd_extract)
    command("search", (("query",), {}), (("path",), {}), run=cmd_search)
    command("alias", named, conv, run=cmd_alias)
    command("prose", named, run=cmd_prose)
    command("graph", path, (("-q", "--query"), {}), run=cmd_graph)
    a = parser.parse_args(argv)
    a.run(None if a.command == "init" else _session(), a)


if __name__ == "__main__":
    main()
