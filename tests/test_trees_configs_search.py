"""Source trees as sources, sinks and streams; configurations in folders; ordered and many-query search; table functions."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from idweave.functions import names, sql_functions
from idweave.operators import graph, search
from idweave.plans import config, hierarchy
from idweave.sources import files, stored
from idweave.streaming import streams

# ---------------------------------------------------------------- trees


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([("a/b.py", "one\r\ntwo"), ("c.rs", "é"), ("a/x/deep.go", "package x"), ("a/y/deep.go", "package y" * 100), (None, "x"), ("z.py", None)], "path string, content string").repartition(3)


def tree_of(root):
    return {os.path.relpath(os.path.join(p, f), root) for p, _, fs in os.walk(root) for f in fs}


def test_writer_is_all_or_nothing(spark, rows, tmp_path):
    root = str(tmp_path / "t")
    files.write_tree(rows, root)
    assert tree_of(root) == {"a/b.py", "c.rs", "a/x/deep.go", "a/y/deep.go"} and os.listdir(tmp_path) == ["t"]
    with pytest.raises(Exception, match="only overwrite replaces it"):
        files.write_tree(rows, root)
    files.write_tree(rows.filter("path = 'c.rs'"), root, overwrite=True)
    assert tree_of(root) == {"c.rs"} and os.listdir(tmp_path) == ["t"]
    # a task that dies after it has seen some rows leaves neither a tree nor a staged one
    with pytest.raises(Exception, match="not below the tree"):
        files.write_tree(rows.unionByName(spark.createDataFrame([("../out.py", "x")], "path string, content string")).coalesce(1), str(tmp_path / "u"))
    with pytest.raises(Exception, match="not below the tree"):
        files.write_tree(spark.createDataFrame([("/abs.py", "x")], "path string, content string"), str(tmp_path / "u"))
    assert os.listdir(tmp_path) == ["t"]


def test_attempts_of_a_task_do_not_mix(tmp_path):
    import pyarrow as pa

    class Killed(Exception):
        pass

    def dying():
        yield pa.RecordBatch.from_pydict({"path": ["a.py", "b.py"], "content": ["1", "2"]})
        raise Killed

    writer = files._Writer({"path": str(tmp_path / "t")}, False)
    with pytest.raises(Killed):
        writer.write(dying())
    assert tree_of(f"{writer.staged}/tree") == set()
    batch = pa.RecordBatch.from_pydict({"path": ["a.py", "d/b.py"], "content": ["1", "2"]})
    messages = [writer.write([batch]), writer.write([batch])]  # the second attempt of a task that was thought lost
    writer.commit(messages)
    assert tree_of(tmp_path / "t") == {"a.py", "d/b.py"} and os.listdir(tmp_path) == ["t"]
    # what the driver can't see is no shared folder
    writer = files._Writer({"path": str(tmp_path / "u")}, False)
    with pytest.raises(OSError, match="not shared"):
        writer.commit([files._Moved("elsewhere", 1)])
    assert os.listdir(tmp_path) == ["t"]


@pytest.mark.parametrize("root", ["hdfs://host/x", "s3a://bucket/x", "gs://b/x", "hdfs:/x"])
def test_other_stores_are_refused(spark, rows, root):
    with pytest.raises(ValueError, match="folder that the driver and all executors see"):
        files.read_tree(spark, root)
    with pytest.raises(ValueError, match="folder that the driver and all executors see"):
        files.write_tree(rows, root)


def test_guards(spark, tmp_path):
    (tmp_path / "big.py").write_bytes(b"x" * 1_048_577)
    (tmp_path / "fits.py").write_bytes(b"x" * 1_048_576)
    (tmp_path / "latin.py").write_bytes(b"caf\xe9")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "ok.py").write_text("x")
    (tmp_path / "link.py").symlink_to(tmp_path / "d" / "ok.py")
    (tmp_path / "linked").symlink_to(tmp_path / "d")
    (tmp_path / "gone.py").symlink_to(tmp_path / "nothing")
    found = {os.path.relpath(r.path, tmp_path) for r in files.read_tree(spark, str(tmp_path), 1_048_576).select("path").collect()}
    assert found == {"fits.py", "d/ok.py"}


def test_options_reach_the_walk(spark, rows, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    files.write_tree(rows, root)
    # unwanted folders are not opened
    opened = []
    scan = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(os.fspath(p)) or scan(p))
    parts = files._Reader({"path": root, "below": "a/y", "extensions": "go,rs", "minsize": "10"}).partitions()
    assert opened == [root, f"{root}/a", f"{root}/a/y"] and [f for p in parts for f, _ in p.files] == [f"{root}/a/y/deep.go"]
    # each combination gives what a filter gives on all rows, also beside other reads of the tree
    whole = files.read_tree(spark, root)
    listed = [tuple(r) for r in whole.select("path", "ext", "size").collect()]
    for options, test in [
        ({"min_size": 9, "max_size": 9}, lambda p, e, n: n == 9), ({"max_size": 8}, lambda p, e, n: n < 9), ({"max_size": 0}, lambda p, e, n: n == 0), ({"min_size": 9}, lambda p, e, n: n >= 9),
        ({"extensions": ("go", "py"), "max_size": 100}, lambda p, e, n: e in ("go", "py") and n <= 100), ({"extensions": ()}, lambda p, e, n: False),
        ({"below": "/a/x/"}, lambda p, e, n: "/a/x/" in p), ({"below": "nowhere"}, lambda p, e, n: False), ({}, lambda p, e, n: True),
    ]:
        own = files.read_tree(spark, root, **options)
        wanted = sorted(p for p, e, n in listed if test(p, e, n))
        assert sorted(r.path for r in own.collect()) == wanted
        assert own.unionByName(whole.filter("size > 8")).count() == len(wanted) + sum(n > 8 for _, _, n in listed)


def test_files_stream_once(spark, rows, tmp_path):
    root = str(tmp_path / "t")
    files.write_tree(rows, root)
    stream = files.stream_tree(spark, root)

    def run():
        time.sleep(files.SETTLED + 0.1)
        out = stream.select("path", "content").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        out.awaitTermination()
        return sorted((os.path.relpath(r.path, root), r.content) for r in spark.read.schema("path string, content string").parquet(str(tmp_path / "out")).collect())

    first = run()
    assert [p for p, _ in first] == ["a/b.py", "a/x/deep.go", "a/y/deep.go", "c.rs"] and run() == first
    os.makedirs(f"{root}/new")
    with open(f"{root}/new/n.py", "w") as f:
        f.write("later")
    with open(f"{root}/c.rs", "w") as f:
        f.write("changed")
    assert run() == sorted([*first, ("new/n.py", "later"), ("c.rs", "changed")])


def test_shared_folder_is_asked_for(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stored.shared_folder(Session)
    assert os.path.isdir(stored.shared_folder(spark))


# ---------------------------------------------------------------- configurations in folders


def test_ancestors(spark):
    for folder, wanted in [("", [("", 0)]), ("a", [("", 0), ("a", 1)]), ("a/b", [("", 0), ("a", 1), ("a/b", 2)]), ("/a/b", [("", 0), ("", 1), ("/a", 2), ("/a/b", 3)])]:
        got = spark.range(1).select(F.expr(hierarchy.ancestors(repr(folder))).alias("a")).first().a
        assert [tuple(x) for x in got] == wanted
    assert [r.f for r in spark.createDataFrame([("a/b.py",), ("x",), ("/r.py",)], "p string").select(F.expr(hierarchy.folder_of("p")).alias("f")).collect()] == ["a", "", ""]


def test_merge_against_a_fold_by_hand(spark):
    r = random.Random(3)
    folders = ["", "a", "a/b", "a/b/c", "a/x", "z"]
    texts, data = [], {}
    for folder in folders:
        if folder in ("a/x",) or r.random() < 0.2:
            continue
        own = {c: {f: r.choice(["snake", "camel", "ada"]) if f == "convention" else r.choice(["p", "q"]) for f in hierarchy.FIELDS if r.random() < 0.5} for c in ("type", "field", "function") if r.random() < 0.8}
        data[folder] = own
        body = "".join(f"[contexts.{c}]\n" + "".join(f'{k} = "{v}"\n' for k, v in fs.items()) for c, fs in own.items())
        texts.append((f"{folder}/.naming.toml".lstrip("/"), 'version = 1\nname = "n"\n' + body))
    fields = hierarchy.config_fields(spark.createDataFrame([*texts, ("a/readme.toml", "no configuration")], "path string, content string"))
    merged = {}
    for folder in data:
        above = [a for a in folders if a in data and (a == "" or a == folder or folder.startswith(a + "/"))]
        for a in sorted(above, key=len):
            for c, fs in data[a].items():
                if fs:
                    merged.setdefault((folder, c), {}).update(fs)
    got = {(x.folder, x.context): {f: x[f] for f in hierarchy.FIELDS if x[f] is not None} for x in hierarchy.merged_rules(fields).collect()}
    assert got == merged
    near = {(x.folder, x.context): {f: x[f] for f in hierarchy.FIELDS if x[f] is not None} for x in hierarchy.nearest_rules(fields).collect()}
    assert near == {(folder, c): fs for folder, own in data.items() for c, fs in own.items() if fs}
    homes = {x.own: x.folder for x in hierarchy.nearest_folder(spark.createDataFrame([(f,) for f in folders], "own string"), fields).collect()}
    assert homes == {f: max((a for a in data if a == "" or a == f or f.startswith(a + "/")), key=len) for f in folders if any(a == "" or a == f or f.startswith(a + "/") for a in data)}


def test_extends_in_order_and_errors(spark):
    text = 'version = 1\nname = "n"\nextends = ["rust", "go"]\n[contexts.constant]\nconvention = "kebab"\n'
    rules = {x.context: x.convention for x in hierarchy.nearest_rules(hierarchy.config_fields(spark.createDataFrame([("a/.naming.toml", text)], "path string, content string"))).collect()}
    assert rules["function"] == "camelCase" and rules["macro"] == "snake_case" and rules["constant"] == "kebab"
    assert config.to_contexts({"extends": ["rust"]})[1] == {}
    for bad in ('extends = ["./other.toml"]', "not toml ["):
        with pytest.raises(Exception, match="failed to parse a/.naming.toml"):
            hierarchy.config_fields(spark.createDataFrame([("a/.naming.toml", bad)], "path string, content string")).collect()


def test_a_file_that_sets_nothing_still_is_the_nearest(spark):
    configs = spark.createDataFrame([(".naming.toml", 'version = 1\nname = "r"\n[contexts.type]\nconvention = "snake"\n'), ("a/.naming.toml", 'version = 1\nname = "a"\n')], "path string, content string")
    parsed = names.parse(spark.createDataFrame([("a/x.py", 1, 1, "BadName", "type"), ("x.py", 1, 1, "BadName", "type"), ("x.py", 2, 1, "BadName", None)], "file string, line int, column int, identifier string, context string"))
    assert [(x.file, x.suggested_fix) for x in hierarchy.lint_tree(parsed, configs).collect()] == [("x.py", "bad_name")]
    assert sorted(x.file for x in hierarchy.lint_tree(parsed, configs, merged=True).collect()) == ["a/x.py", "x.py"]


# ---------------------------------------------------------------- search


def parsed(spark, identifiers):
    rows = spark.createDataFrame([("f", i, 1, n) for i, n in enumerate(identifiers)], "file string, line int, column int, identifier string")
    return names.parse(rows)


def in_order(tags, wanted):
    rest = iter(tags)
    return all(any(t == w for t in rest) for w in wanted)


def test_ordered_search_by_hand(spark):
    r = random.Random(2)
    words = ["get", "user", "name", "by", "id"]
    own = ["_".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(200)]
    table = parsed(spark, own)
    for query in ("get_user", "userGet", "get-get", "NameById", "id", "", "user_user_user"):
        wanted = [t for t in search_tags(spark, query)]
        got = {x.line for x in search.search(table, query, ordered=True).collect()}
        assert got == {i for i, n in enumerate(own) if in_order(n.split("_"), wanted)}
        assert {x.line for x in search.search(table, query).collect()} == {i for i, n in enumerate(own) if set(wanted) <= set(n.split("_"))}


def search_tags(spark, query):
    return names.parse(spark.createDataFrame([(query,)], "identifier string")).first().tags


def test_many_queries_by_hand(spark):
    r = random.Random(4)
    words = ["get", "user", "name", "by", "id", "rare"]
    own = ["_".join(r.choice(words[: 5 + (r.random() < 0.1)]) for _ in range(r.randint(1, 5))) for _ in range(150)]
    asked = list({r.choice(["_", "-"]).join(r.choice([*words, "absent"]) for _ in range(r.randint(1, 3))) for _ in range(60)}) + ["", "GetUser", "get_user"]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    for ordered in (False, True):
        got = {(x.query, x.line) for x in search.search_many(parsed(spark, own), queries, ordered=ordered).collect()}
        wanted = set()
        for q in set(asked):
            tags = search_tags(spark, q)
            wanted |= {(q, i) for i, n in enumerate(own) if tags and (in_order(n.split("_"), tags) if ordered else set(tags) <= set(n.split("_")))}
        assert got == wanted


def test_a_tag_on_all_names_and_queries_is_not_joined(spark):
    n = 6000
    own = [f"get_name{i}x" for i in range(n)]
    queries = spark.range(4000).select(F.concat(F.lit("get_other"), F.col("id").cast("string"), F.lit("x")).alias("query")).unionByName(spark.range(20).select(F.concat(F.lit("getName"), F.col("id").cast("string"), F.lit("x")).alias("query")))
    table = parsed(spark, own)
    start = time.time()
    found = search.search_many(table, queries)
    assert found.count() == 20 and time.time() - start < 20
    # what the join of names and searches yields is bounded by the rarest tags: one name for each query with a hit
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_subgraph_reads_stored_tables(spark):
    table = parsed(spark, ["get_user", "user_name", "name_list", "other", "get_id"])
    nodes, edges = graph.subgraph(graph.tag_nodes(table), graph.tag_edges(table), "user")
    assert {x.tag for x in nodes.collect()} == {"get", "user", "name"} and {(x.src, x.dst) for x in edges.collect()} == {("get", "user"), ("user", "name")}
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "ExistingRDD" not in plan and "regexp_replace" not in plan


# ---------------------------------------------------------------- table functions and late rows


def test_table_functions_stay_generators(spark):
    sql_functions.register(spark)
    spark.createDataFrame([(1, "getUser with_value\r\nself x the-box\n"), (2, ""), (3, None), (4, "one\n\ntwo_")], "id int, body string").createOrReplaceTempView("texts")
    for function, wanted in (("extract_names", "the box"), ("extract_hyphened_names", "the-box")):
        found = spark.sql(f"SELECT t.id, e.* FROM texts t, LATERAL {function}(t.body) e")
        got = [(x.id, x.line, x.identifier, x.convention) for x in found.orderBy("id", "line").collect()]
        last = [(1, 2, w) for w in wanted.split()]
        assert sorted(x[:3] for x in got) == sorted([(1, 1, "getUser"), (1, 1, "with_value"), *last, (4, 1, "one"), (4, 3, "two_")])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan
    assert spark.sql("SELECT count(*) AS n FROM texts t, LATERAL name_renderings('getUser') r WHERE t.id = 1").first().n == 6


def test_append_mode_drops_late_rows_and_frees_state(spark):
    times = [(0, "2024-01-01 00:10:00"), (0, "2024-01-01 05:00:00"), (1, "2024-01-01 10:00:00"), (2, "2024-01-01 00:20:00"), (2, "2024-01-01 09:30:00"), (3, "2024-01-01 20:00:00")]
    rows = spark.createDataFrame(times, "delivery int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("identifier", F.lit("on_click"))
    stream = streams.read_table_stream(spark, streams.deliveries(spark, rows, "delivery", 4), files_a_batch=1)
    out = streams.run_once(streams.windowed_tags(streams.parse_stream(stream), late="2 hours"), spark)
    # the second row of 00:00 comes after that window was closed; the windows within two hours of the end are still open
    assert sorted((str(x.start)[11:13], x.n) for x in out.filter("tag = 'click'").collect()) == [("00", 1), ("05", 1), ("09", 1), ("10", 1)]
