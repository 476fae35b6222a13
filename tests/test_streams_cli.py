import json

import pytest
from pyspark.sql import functions as F

from idweave import cli
from idweave.functions import names
from idweave.operators.graph import tag_edges
from idweave.streaming import streams


@pytest.fixture()
def table(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:30:00", n) for i, n in enumerate(["get_user", "getUser", "user_list", "on_user", "get_user_list", "lone"] * 5)]
    path = str(tmp_path / "names")
    spark.createDataFrame(rows, "id int, ts string, identifier string").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(path)
    return path


def test_stream_equals_batch(spark, table):
    batch = names.parse(spark.read.parquet(table))
    stream = streams.parse_stream(streams.read_table_stream(spark, table))
    assert sorted(streams.run_once(stream, spark).select("id", "tags").collect()) == sorted(batch.select("id", "tags").collect())
    assert sorted(streams.run_once(streams.edge_counts(stream), spark, "complete").collect()) == sorted(tag_edges(batch).collect())


def test_windows(spark, table):
    stream = streams.windowed_tags(streams.parse_stream(streams.read_table_stream(spark, table)))
    found = streams.run_once(stream, spark, "complete")
    assert found.agg(F.sum("n")).first()[0] == names.parse(spark.read.parquet(table)).select(F.sum(F.size("tags"))).first()[0]
    assert found.select("start").distinct().count() == 5


def run(capsys, *argv):
    code = 0
    try:
        cli.main(list(argv))
    except SystemExit as e:
        code = e.code
    return code, capsys.readouterr().out


def test_cli(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    code, out = run(capsys, "parse", "auth__get_user")
    assert code == 0 and out.splitlines() == ["name:       auth__get_user", "convention: snake_case", "tags:       [auth, get, user]", "dimension 0: [auth]", "dimension 1: [get, user]", "canonical:  auth_get_user"]
    assert json.loads(run(capsys, "parse", "getUser", "-f", "json")[1]) == {"original": "getUser", "convention": "camel_case", "tags": ["get", "user"], "namespaces": [], "role": "getter", "shape": None}
    assert run(capsys, "alias", "a_b", "-c", "camel")[1] == "camelCase:       aB\n" and len(run(capsys, "alias", "a_b")[1].splitlines()) == 6
    assert run(capsys, "prose", "is_valid_email")[1] == "Checks if email is valid\n"
    (tmp_path / "a.rs").write_text("fn getUser() {}\nfn get_post() {}\n")
    assert run(capsys, "lint", str(tmp_path))[0] not in (0, None)
    assert run(capsys, "init", "-l", "rust")[0] == 0 and run(capsys, "init")[0] not in (0, None)
    code, out = run(capsys, "lint", str(tmp_path))
    assert code == 1 and out == f"{tmp_path}/a.rs:1:4 warning: identifier `getUser` should be snake_case → `get_user`\n"
    assert [r["identifier"] for r in json.loads(run(capsys, "search", "user", str(tmp_path), "-f", "json")[1])] == ["getUser"]
    assert run(capsys, "search", "user", str(tmp_path))[1] == f"{tmp_path}/a.rs:1\tgetUser\tCamelCase\n"
    assert run(capsys, "graph", str(tmp_path), "-q", "post")[1] == 'digraph tags {\n\trankdir=LR;\n\t"get" -> "post" [label="1"];\n}\n'
    assert run(capsys, "extract", str(tmp_path), "--ast")[1].splitlines()[1] == f"{tmp_path}/a.rs:2\tget_post\t[get, post]\tSnakeCase\tctx:function\trole:getter\tshape:none"
    assert json.loads(run(capsys, "extract", str(tmp_path), "-f", "json")[1])[0]["parsed"]["tags"] == ["get", "user"]
