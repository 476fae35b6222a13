"""Plans of queries that were slow on large tables."""

import os
import random
import re

from pyspark.sql import functions as F

from idweave import queries
from idweave.functions import names
from idweave.operators import declarations, extract, graph, search
from idweave.sources import derived

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_renderings_find_tags_once(spark):
    plan = plan_of(queries.queries()["sql_renderings"](spark, SF))
    assert "lambda" not in plan.split("Generate explode(arrays_zip")[1].split("\n")[0]


def test_small_files_are_dealt_over_the_cores(spark):
    assert derived.names_table(spark, SF).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_search_parses_only_names_that_hold_the_letters(spark):
    rows = spark.createDataFrame([("f", 1, "withValue"), ("f", 2, "Without"), ("f", 3, "a_WITH_b"), ("f", 4, None), ("f", 5, "with")], "file string, line int, identifier string")
    found = search.search(names.parse(rows), "With")  # no column of places
    assert sorted(r.line for r in found.collect()) == [1, 3, 5]
    assert "contains(lower(identifier" in plan_of(found).lower()


def test_search_in_documents_leaves_places_out(spark):
    assert "octet_length(x" not in plan_of(queries.queries()["search_documents"](spark, SF))


def test_sorted_hits_are_not_sorted_twice(spark):
    assert "rangepartitioning" not in plan_of(queries.queries()["search_sorted"](spark, SF))


def test_few_folders_are_broadcast(spark):
    plan = plan_of(queries.queries()["lint_nearest_config"](spark, SF))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_edges_of_counted_names(spark):
    rows = spark.createDataFrame([("a_b",)] * 3 + [("aB",), ("a",)], "identifier string")
    counted = rows.groupBy("identifier").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, graph.tag_edges(names.parse(counted), "n").collect())) == sorted(map(tuple, graph.tag_edges(names.parse(rows)).collect())) == [("a", "b", 4)]


def test_places_in_parts_of_long_lines(spark, monkeypatch):
    """Places equal those counted by hand whatever the sizes of parts, and no lambda makes a value for each name."""
    plan = plan_of(queries.queries()["extract_columns"](spark, SF))
    assert "lambdafunction(named_struct(identifier" not in plan and "posexplode(split(" in plan
    r = random.Random(4)
    pieces = ["getUser", "a_b", "x", "$v", "my-name", "the-box-", "é", "日本", "éa", "7", "7up", " ", "  ", ".", "-", "\u0001", "\u0002", "\U0001f600"]
    texts = ["".join(r.choice(pieces) + r.choice([" ", "", "; "]) for _ in range(n)) for n in (0, 1, 2, 9, 40, 41, 600)] + ["no_name" * 100, "é " * 400, "\u0001" * 600, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    for kebab, hyphen in ((None, ""), (F.lit(True), "-")):
        wanted = [
            (n, m.group(), len(t[: m.start()].encode()) + 1) for n, t in enumerate(texts) for m in re.finditer(rf"\b[a-zA-Z_$][a-zA-Z0-9_${hyphen}]*\b", t or "")
        ]
        for short, block, group in ((extract.SHORT, extract.BLOCK, extract.GROUP), (0, 1, 1), (20, 2, 3), (0, 40, 2)):
            for name, value in (("SHORT", short), ("BLOCK", block), ("GROUP", group)):
                monkeypatch.setattr(extract, name, value)
            found = extract.occurrences(rows, kebab)
            assert sorted((x.n, x.identifier, x.column) for x in found.collect()) == sorted(wanted)
            monkeypatch.undo()


def test_no_step_of_declarations_is_interpreted(spark, monkeypatch):
    """HotSpot compiles no method of more than 8,000 bytes of bytecode: such a step takes several times as long."""
    generator = getattr(getattr(spark._jvm.org.apache.spark.sql.catalyst.expressions.codegen, "CodeGenerator$"), "MODULE$")

    def sizes(plan):
        own = [generator.compile(plan.doCodeGen()._2())._2().maxMethodCodeSize()] if plan.getClass().getSimpleName() == "WholeStageCodegenExec" else []
        return own + [n for k in range(plan.children().size()) for n in sizes(plan.children().apply(k))]

    found = []
    stored = declarations.stored
    check = lambda df: found.extend(sizes(df._jdf.queryExecution().executedPlan()))
    monkeypatch.setattr(declarations, "stored", lambda session, df, name: check(df) or stored(session, df, name))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        check(declarations.declarations(spark.createDataFrame([("a", "rust", "fn aa(bb: u8) { let (cc, dd) = bb; }")], "file string, language string, content string")))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(found) > 5 and max(found) < 8000
