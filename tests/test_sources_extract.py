import random
import re

import pytest
from pyspark.sql import functions as F

from idweave.operators import classify, extract, graph, lint, search
from idweave.plans import config, render
from idweave.sources import files


@pytest.fixture()
def tree(tmp_path):
    def put(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())

    put("src/sample.rs", "fn create_user(person_name: String) {\n    let user_id = 1;\n}\nfn validate_user() {}\n")
    put("src/__init__.py", "def get_user(a):\n    x = 1\n")
    put(".eslintrc.js", "const rootConfig = 1")
    put("_pkg/style.css", ".nav-bar { font-size: 1 }")
    put("node_modules/gone.js", "var gone_name = 1")
    put("a/target/gone.rs", "fn gone_name() {}")
    put(".hidden/gone.py", "gone_name = 1")
    put("notes.md", "some_words")
    put("bad.py", b"\xff\xfe broken_name")
    put("big.py", "big_name = 1\n" * 100_000)
    return tmp_path


def test_listing(spark, tree):
    found = {r.path.removeprefix(f"{tree}/") for r in files.read_tree(spark, str(tree)).select("path").collect()}
    assert found == {"src/sample.rs", "src/__init__.py", ".eslintrc.js", "_pkg/style.css", "big.py"}


def test_one_file_needs_no_extension(spark, tree):
    assert files.read_tree(spark, str(tree / "notes.md")).count() == 1


def test_text_mode(spark, tree):
    found = extract.extract_identifiers(files.read_tree(spark, str(tree)))
    rows = {(r.file.rpartition("/")[2], r.line, r.column, r.identifier) for r in found.collect()}
    assert ("sample.rs", 1, 4, "create_user") in rows and ("sample.rs", 2, 9, "user_id") in rows and ("style.css", 1, 2, "nav-bar") in rows and ("style.css", 1, 12, "font-size") in rows
    assert not {"fn", "let", "x", "a", "big_name"} & {r[3] for r in rows}
    assert found.filter("context is not null").count() == 0


def brute(content, kebab=False):
    out = []
    pattern = re.compile(r"\b[a-zA-Z_$][a-zA-Z0-9_$-]*\b" if kebab else r"\b[a-zA-Z_$][a-zA-Z0-9_$]*\b")
    lines = content.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    for k, line in enumerate(lines, 1):
        line = line.removesuffix("\r") if k < len(lines) or content.endswith("\n") else line
        for m in pattern.finditer(line):
            if len(m[0]) > 1 and m[0] not in extract.KEYWORDS:
                out.append((k, len(line[: m.start()].encode()) + 1, m[0]))
    return out


@pytest.mark.parametrize("ext", ["py", "css"])
def test_places_against_brute_force(spark, ext):
    r = random.Random(1)
    words = ["foo_bar", "é", "naïve", "x", "$foo", "1$foo", "this", "This", "a-b", "--", "ü ", "getX", "\r", "\n", "\r\n", " ", "x$ ", "日本"]
    texts = ["", "\n", "a\n\nbb", *("".join(r.choice(words) for _ in range(r.randint(1, 200))) for _ in range(60))]
    df = spark.createDataFrame([(str(i), ext, len(t.encode()), t) for i, t in enumerate(texts)], files.SCHEMA)
    found = {(r.file, r.line, r.column, r.identifier) for r in extract.extract_identifiers(df).collect()}
    assert found == {(str(i), *x) for i, t in enumerate(texts) for x in brute(t, ext == "css")}


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "py", 0, None), ("b", None, 3, "foo_x")], files.SCHEMA)
    assert [r.identifier for r in extract.extract_identifiers(df).collect()] == ["foo_x"]
    assert extract.extract_identifiers(df.limit(0)).count() == 0


@pytest.mark.parametrize("folders", [1, 2, 5, 1000])
def test_tasks_walk_what_the_driver_leaves(spark, tmp_path, folders):
    r = random.Random(folders)
    wanted = {}
    for k in range(60):
        below = [r.choice(["a", "b", "_c", ".hidden", "target", "d.e"]) for _ in range(r.randint(0, 4))]
        path = tmp_path.joinpath("root", *below, f"f{k}.{r.choice(['py', 'rs', 'md'])}")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * k)
        if path.suffix != ".md" and not {".hidden", "target"} & set(below):
            wanted[str(path)] = k
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "linked.py").write_text("x")
    (tmp_path / "root" / "link.py").symlink_to(tmp_path / "other" / "linked.py")
    (tmp_path / "root" / "link").symlink_to(tmp_path / "other")
    (tmp_path / "root" / "broken.py").write_bytes(b"\xff")
    spark.dataSource.register(files.SourceTree)
    read = spark.read.format("source_tree").option("folders", folders)
    assert {x.path: x.size for x in read.load(str(tmp_path / "root")).collect()} == wanted
    assert {x.path for x in read.option("maxsize", 30).load(str(tmp_path / "root")).collect()} == {p for p, n in wanted.items() if n <= 30}
    assert read.load(str(tmp_path / "root" / "none")).count() == 0


def test_written_trees_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.py", "one\r\ntwo"), ("c.rs", "é")], "path string, content string")
    assert files.write_tree(rows, str(tmp_path / "t")) == 2
    assert {(x.path, x.content) for x in files.read_tree(spark, str(tmp_path / "t")).select("path", "content").collect()} == {(f"{tmp_path}/t/a/b.py", "one\r\ntwo"), (f"{tmp_path}/t/c.rs", "é")}


SAMPLES = {
    "rs": ("struct UserProfile { user_id: u32 }\nenum ConnectionState { Open }\nconst MAX_RETRIES: u32 = 3;\nuse std::collections::HashMap;\nfn create_user(person_name: String) { let total = 1; }\n",
           {("UserProfile", "type"), ("ConnectionState", "type"), ("MAX_RETRIES", "constant"), ("HashMap", "import"), ("create_user", "function"), ("person_name", "parameter"), ("total", "variable"), ("user_id", "field")}),
    "py": ("import os.path\nclass UserService:\n    def get_user(self, user_id: int):\n        value = 1\n", {("os.path", "import"), ("UserService", "type"), ("get_user", "function"), ("user_id", "parameter"), ("value", "variable")}),
    "js": ("import { readFile } from 'fs';\nclass PostManager {\n  deletePost(postId) {}\n}\nfunction createUser(name) { const total = 1; } // function gone() {}\n",
           {("readFile", "import"), ("PostManager", "type"), ("deletePost", "function"), ("postId", "parameter"), ("createUser", "function"), ("name", "parameter"), ("total", "variable")}),
    "go": ('import "net/http"\ntype Server struct {}\nconst maxSize = 1\nfunc handleUser(userId int) { total := 1 }\n', {("http", "import"), ("Server", "type"), ("maxSize", "constant"), ("handleUser", "function"), ("userId", "parameter")}),
    "c": ("#include <stdio.h>\nstruct user_data { int user_age; };\nint get_user(int user_id) {\n  int total = 1;\n  return total;\n}\n", {("stdio.h", "import"), ("user_data", "type"), ("get_user", "function"), ("user_id", "parameter"), ("total", "variable"), ("user_age", "field")}),
    "java": ("import java.util.List;\npublic class UserService {\n    private int userCount = 0;\n    public String getUser(String userId) {\n        int total = 1;\n        return null;\n    }\n}\n",
             {("List", "import"), ("UserService", "type"), ("userCount", "field"), ("userCount", "variable"), ("getUser", "function"), ("userId", "parameter"), ("total", "variable")}),
    "rb": ("require 'net/http'\nclass UserService\n  MAX_SIZE = 1\n  def get_user(user_id)\n    @user_name = 1\n    total = 2\n  end\nend\n", {("http", "import"), ("UserService", "type"), ("MAX_SIZE", "constant"), ("get_user", "function"), ("user_id", "parameter"), ("user_name", "field"), ("total", "variable")}),
    "php": ("<?php\nuse App\\Models\\User;\nclass UserService {\n  const MAX_SIZE = 1;\n  private $userName;\n  function getUser($userId) { static $total = 1; }\n}\n", {("User", "import"), ("UserService", "type"), ("MAX_SIZE", "constant"), ("userName", "field"), ("getUser", "function"), ("userId", "parameter"), ("total", "variable")}),
    "cs": ("using System.Collections;\npublic class UserService {\n    private int userCount = 0;\n    public string GetUser(string userId) {\n        return null;\n    }\n}\n", {("Collections", "import"), ("UserService", "type"), ("userCount", "field"), ("userCount", "variable"), ("GetUser", "function"), ("userId", "parameter")}),
    "swift": ("import Foundation\nclass UserService {\n    let maxSize = 1\n    var userName = 2\n    func getUser(userId: Int) {}\n}\n", {("Foundation", "import"), ("UserService", "type"), ("maxSize", "constant"), ("userName", "variable"), ("getUser", "function"), ("userId", "parameter")}),
    "kt": ("import java.util.List\nclass UserService {\n    val MAX_SIZE = 1\n    val userName = 2\n    fun getUser(userId: Int) {}\n}\n", {("List", "import"), ("UserService", "type"), ("MAX_SIZE", "constant"), ("userName", "variable"), ("getUser", "function"), ("userId", "parameter")}),
    "ts": ("class Store {}\nfunction loadUser(userId: string, pageSize: number): void { let total = 1; }\n", {("Store", "type"), ("loadUser", "function"), ("userId", "parameter"), ("pageSize", "parameter"), ("total", "variable")}),
}


@pytest.mark.parametrize("ext", SAMPLES)
def test_contexts(ext):
    content, expected = SAMPLES[ext]
    found = classify.contexts_of(content, files.LANGUAGES[ext])
    assert expected <= {(name, context) for _, _, name, context in found}
    assert "gone" not in {name for _, _, name, _ in found}
    lines = content.split("\n")
    # imports of most languages are reported where their statement begins, Rust's where its path ends
    place = lambda line, column: lines[line - 1].encode()[column - 1 :].decode()
    for line, column, name, context in found:
        if context != "import" or ext in ("py", "js", "ts", "tsx"):
            # a variable of Ruby or PHP begins at its sigil, which is no part of the name
            sigil = "$" if ext == "php" and context in ("variable", "parameter", "field") else "@" if ext == "rb" and context == "field" else ""
            assert place(line, column).startswith(sigil + name)
        elif ext == "rs":
            assert place(line, column).startswith(";")
        elif ext != "go" and ext != "php":
            assert place(line, column).split()[0] in ("import", "using", "require", "#include")


def found_in(content, language):
    return {(line, column, name, context) for line, column, name, context in classify.contexts_of(content, language)}


def test_java_members():
    content = (
        "class Shop {\n    private int userCount = 0;\n    String ownName;\n    int getSize(int most) { int total = 1; return total; }\n    int after;\n}\n"
        "interface Limits { int MAX_SIZE = 3; void run(String given); }\n"
    )
    assert found_in(content, "java") == {
        (1, 7, "Shop", "type"), (2, 17, "userCount", "field"), (2, 17, "userCount", "variable"), (3, 12, "ownName", "field"), (3, 12, "ownName", "variable"),
        (4, 9, "getSize", "function"), (4, 21, "most", "parameter"), (4, 33, "total", "variable"), (5, 9, "after", "field"), (5, 9, "after", "variable"),
        (7, 11, "Limits", "type"), (7, 24, "MAX_SIZE", "constant"), (7, 24, "MAX_SIZE", "variable"), (7, 43, "run", "function"), (7, 54, "given", "parameter"),
    }


def test_cpp_and_tsx():
    content = (
        "#include <vector>\ntypedef unsigned long ulong_type;\ntypedef struct { int depth; } Point;\nclass Shape : public Base {\npublic:\n  virtual double area() const;\n"
        "private:\n  int width = 0;\n  char label[10];\n};\nvoid Shape::resize(int factor, char *name) { int local = 1; }\nstruct Point origin;\n"
    )
    assert found_in(content, "cpp") == {
        (1, 1, "vector", "import"), (2, 23, "ulong_type", "type"), (3, 22, "depth", "field"), (3, 31, "Point", "type"), (6, 18, "area() const", "field"), (8, 7, "width", "field"),
        (9, 8, "label[10]", "field"), (11, 13, "resize", "function"), (11, 24, "factor", "parameter"), (11, 37, "*name", "parameter"), (11, 50, "local", "variable"), (12, 8, "Point", "type"),
        (12, 14, "origin", "variable"),
    }
    content = "import { useState } from 'react';\nclass Panel {\n  render(props: Props) { return 1; }\n}\nfunction App(title: string): void { const size = 1; }\n"
    assert found_in(content, "tsx") == {
        (1, 10, "useState", "import"), (2, 7, "Panel", "type"), (3, 3, "render", "function"), (3, 10, "props", "parameter"), (5, 10, "App", "function"), (5, 14, "title", "parameter"), (5, 43, "size", "variable"),
    }


def test_syntax_mode_falls_back(spark):
    df = spark.createDataFrame([("a.rs", "rs", 1, SAMPLES["rs"][0]), ("b.css", "css", 1, ".nav-bar {}")], files.SCHEMA)
    found = {(r.file, r.identifier, r.context) for r in classify.extract_with_context(df).collect()}
    assert ("b.css", "nav-bar", None) in found and ("a.rs", "create_user", "function") in found


def occurrences(spark, values, context=None):
    from idweave.functions import names

    df = spark.createDataFrame([(f"f{i}", i, 1, v, context) for i, v in enumerate(values)], "file string, line int, column int, identifier string, context string")
    return names.parse(df)


def test_search(spark):
    df = occurrences(spark, ["validateUser", "user_validate", "USER", "ValidateUserName", "other"])
    hits = lambda q: [r.identifier for r in search.ordered(search.search(df, q)).collect()]
    assert hits("validate-user") == ["validateUser", "user_validate", "ValidateUserName"]
    assert len(hits("")) == 5 and hits("nothing") == []
    queries = spark.createDataFrame([("user",), ("validate_user",), ("",)], "query string")
    many = {(r.query, r.identifier) for r in search.search_many(df, queries).collect()}
    assert ("user", "USER") in many and ("validate_user", "user_validate") in many and not any(q == "" for q, _ in many)


def test_graph(spark):
    df = occurrences(spark, ["create_user", "createUser", "user_user", "lone", "delete_post", "post_user"])
    edges = {(r.src, r.dst): r.weight for r in graph.tag_edges(df).collect()}
    assert edges == {("create", "user"): 2, ("user", "user"): 1, ("delete", "post"): 1, ("post", "user"): 1}
    nodes = graph.tag_nodes(df)
    assert {r.tag for r in nodes.collect()} == {"create", "user", "lone", "delete", "post"}
    kept, inner = graph.subgraph(nodes, graph.tag_edges(df), "create")
    assert {r.tag for r in kept.collect()} == {"create", "user"} and {(r.src, r.dst) for r in inner.collect()} == {("create", "user"), ("user", "user")}
    assert render.dot(inner) == 'digraph tags {\n\trankdir=LR;\n\t"create" -> "user" [label="2"];\n\t"user" -> "user" [label="1"];\n}\n'
    assert render.graph_json(kept, inner)["nodes"] == ["create", "user"]
    assert graph.tag_edges(df.limit(0)).count() == 0


def test_lint(spark):
    rules = spark.createDataFrame([("function", "snake"), ("type", "nonsense")], "context string, expected_convention string")
    found = lint.lint(occurrences(spark, ["getUser", "get_user", "main"], "function"), rules)
    assert {(r.identifier, r.expected_convention, r.actual_convention, r.suggested_fix) for r in found.collect()} == {("getUser", "snake", "camelCase", "get_user"), ("main", "snake", "camelCase", "main")}
    assert lint.lint(occurrences(spark, ["getUser"], None), rules).count() == 0
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_lint_a_tree(spark, tree):
    (tree / ".naming.toml").write_text('version = 1\nname = "x"\nextends = ["rust"]\n[contexts.function]\nconvention = "camelCase"\n')
    path = config.find(str(tree / "src"))
    rules = lint.rules_frame(spark, config.resolve(path))
    found = lint.lint(classify.extract_with_context(files.read_tree(spark, str(tree / "src"))), rules)
    assert {(r.identifier, r.suggested_fix) for r in found.collect()} >= {("create_user", "createUser"), ("validate_user", "validateUser")}


def test_prune_matches_the_walk(spark):
    df = spark.createDataFrame([("r/a.py",), ("r/.x/a.py",), ("r/target/a.py",), ("r/_p/__init__.py",), ("r/.eslintrc.js",), ("r/a.md",), ("r/vendor2/a.go",)], "path string")
    assert {r.path for r in files.prune(df).collect()} == {"r/a.py", "r/_p/__init__.py", "r/.eslintrc.js", "r/vendor2/a.go"}


def test_listed_extensions_agree(spark):
    df = spark.createDataFrame([("a/.bashrc",), ("a.b/c",), ("x.tar.gz",), ("p.PY",)], "path string").withColumn("e", files.ext_of(F.col("path")))
    assert [r.e for r in df.collect()] == [files.extension(p) for p in ("a/.bashrc", "a.b/c", "x.tar.gz", "p.PY")]


@pytest.mark.parametrize("ext,piece", [("c", "// a comment of a header, {with} brackets; and words\n"), ("java", "word" * 16_384 + "\n"), ("js", "const a1 = [1, 2, 3], b2 = { c: 4 };\n"), ("rb", "# comment\nvalue = 1\n")])
def test_scan_takes_time_in_proportion(spark, ext, piece):
    import time

    from idweave.operators import declarations

    def took(size):
        df = spark.createDataFrame([("f", files.LANGUAGES[ext], piece * (size // len(piece)))], "file string, language string, content string")
        start = time.time()
        n = declarations.declarations(df).count()
        return time.time() - start, n

    took(1 << 12)
    small, n = took(1 << 18)
    large, m = took(1 << 20)
    assert large < 4 * 2 * max(small, 2.0) and (n == 0) == (m == 0)


def test_scan_of_edges(spark):
    df = spark.createDataFrame([("a.rs", "rs", 0, ""), ("b.c", "c", 0, None), ("c.js", "js", 1, "}}} let xx = 1; \"never closed"), ("d.go", "go", 1, "/* never closed func aa() {}"), ("e.kt", "kt", 1, "fun ü1() {}\nfun é2(日本: Int) {}")], files.SCHEMA)
    found = {(r.file, r.line, r.column, r.identifier, r.context) for r in classify.classify(df).collect()}
    assert found == {("c.js", 1, 9, "xx", "variable"), ("e.kt", 1, 5, "ü1", "function"), ("e.kt", 2, 5, "é2", "function"), ("e.kt", 2, 9, "日本", "parameter")}
    plan = classify.classify(df.filter("ext <> 'py'"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1  # Python files alone
    assert classify.classify(df.limit(0)).count() == 0


def test_texts_are_neither_broadcast_nor_joined_to_few_tasks(spark, monkeypatch):
    """Contexts of files: texts and heads go by merge joins, in tasks of bounded bytes however small the table is on disk."""
    from idweave.operators import declarations

    monkeypatch.setattr(declarations, "TASK_BYTES", 100)
    rows = [(f"f{k}", "rust", f"fn run_{k}((left, right): (u8, u8), own: u8) {{ let (aa_{k}, bb) = own; }}") for k in range(20)]
    files = spark.createDataFrame(rows, "file string, language string, content string")
    found = declarations.declarations(files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    bound = max(spark.sparkContext.defaultParallelism, sum(len(r[2]) for r in rows) // 100 + 1)
    assert f", {bound}), REPARTITION_BY_NUM" in plan
    assert found.filter("context = 'variable'").count() == 20 and found.filter("context = 'parameter'").count() == 40


def test_equal_texts_are_classified_once(spark, monkeypatch):
    """Copies of a text cost one scan and each has all its rows, whatever their paths; languages stay apart."""
    seen = []
    for name in ("declarations", "python_declarations"):
        run = getattr(classify, name)
        monkeypatch.setattr(classify, name, lambda texts, run=run: seen.append(texts.count()) or run(texts))
    rust, python, c = SAMPLES["rs"][0], SAMPLES["py"][0], SAMPLES["c"][0]
    rows = [(f"a{k}.rs", "rs", 1, rust) for k in range(40)] + [(f"b{k}.py", "py", 1, python) for k in range(30)] + [("c.c", "c", 1, c), ("c.cpp", "cpp", 1, c)]
    rows += [("twice.rs", "rs", 1, rust)] * 2 + [(None, "rs", 1, rust), ("d.rs", "rs", 1, rust + "fn more() {}"), ("none.rs", "rs", 0, None), ("empty.py", "py", 0, "")]
    found = classify.classify(spark.createDataFrame(rows, files.SCHEMA)).collect()
    assert sorted(seen) == [1, 4]  # Python; Rust's two, C and C++
    places = {(ext, content): classify.contexts_of(content, files.LANGUAGES[ext]) for ext, content in {(r[1], r[3]) for r in rows if r[3]}}
    wanted = [(path, files.LANGUAGES[ext], *place) for path, ext, _, content in rows if content for place in places[ext, content]]
    assert sorted(map(str, wanted)) == sorted(str((r.file, r.language, r.line, r.column, r.identifier, r.context)) for r in found)
