"""Every registered identifier query against its SQL, on the smallest tables."""

import collections
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from idweave import oracle, queries
from idweave.operators import extract

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, db, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = collections.Counter(tuple(map(str, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert found
    if name in oracle.ORACLE_SQL:
        wanted = db.sql(oracle.ORACLE_SQL[name])
        assert sorted(wanted.columns) == columns
        expected = collections.Counter(tuple(map(str, r)) for r in wanted.project(",".join(f'"{c}"' for c in columns)).fetchall())
        assert found == expected


def test_texts_over_a_mebibyte_are_whole(spark, tmp_path):
    """Long texts, of many lines and of one, count in every query; only trees have the reference's limit."""
    long = {7: "with_value getUser 1x é\n" * 60_000, 8: "with_value the-box " * 80_000}
    assert all(len(t.encode()) > extract.MAX_FILE_SIZE for t in long.values())
    spark.createDataFrame([*long.items(), (9, "short withText")], "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, t) for k, t in long.items()], "page_id long, html string").coalesce(2).write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("extract_identifiers", "identifier_counts", "search_documents"):
        df = queries.queries()[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        wanted = c.sql(oracle.ORACLE_SQL[name]).project(",".join(f'"{x}"' for x in columns)).fetchall()
        assert collections.Counter(map(tuple, df.select(*columns).collect())) == collections.Counter(wanted), name
    run = lambda name: queries.queries()[name](spark, str(tmp_path))
    places = run("extract_columns").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("column").alias("last")).collect()
    assert sorted(map(tuple, places)) == [("7", 120_000, 12), ("8", 240_000, 80_000 * 19 - 3), ("9", 2, 7)]
    kebab = {(r.identifier, r["count"]) for r in run("extract_kebab").groupBy("identifier").count().collect()}
    assert kebab == {("with_value", 140_000), ("getUser", 60_000), ("the-box", 80_000)}
    assert {(r.src, r.dst): r.weight for r in run("graph_kebab_pages").collect()} == {("with", "value"): 140_000, ("get", "user"): 60_000, ("the", "box"): 80_000}


def test_plans_stay_in_the_jvm(spark):
    df = queries.queries()["extract_identifiers"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # no shuffle by a key; only a single small file is dealt over the cores
    assert "Python" not in plan and "hashpartitioning" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
