"""Names, paths and source files that Spark derives from the given tables.

The tables hold no source code.  Names in all conventions come from part, nation, event and
order columns; paths and small source files are built from part names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .files import as_files, spread
from .samples import NESTED


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CAPITAL = "transform(split(p_name, ' '), w -> concat(upper(substring(w, 1, 1)), substring(w, 2)))"
_SNAKE = "replace(p_name, ' ', '_')"

#: (kind, table, key, expression of the name, context that rules see)
NAMES = [
    ("part_snake", "part", "p_partkey", _SNAKE, "variable"),
    ("part_camel", "part", "p_partkey", f"concat('get', array_join({_CAPITAL}, ''))", "function"),
    ("part_pascal", "part", "p_partkey", f"array_join({_CAPITAL}, '')", "type"),
    ("part_kebab", "part", "p_partkey", "replace(p_name, ' ', '-')", "parameter"),
    ("part_ada", "part", "p_partkey", f"array_join({_CAPITAL}, '_')", "field"),
    ("part_ns", "part", "p_partkey", f"concat(replace(lower(p_type), ' ', '_'), '__', {_SNAKE}, '_list')", None),
    ("brand_mixed", "part", "p_partkey", "replace(p_brand, '#', '_')", "import"),
    ("nation_upper", "nation", "n_nationkey", "n_name", "constant"),
    ("event_handler", "events", "event_id", "concat('on_', event_type)", "function"),
    ("event_check", "events", "event_id", "concat('validate_', event_type)", "function"),
    ("event_test", "events", "event_id", "concat('is_', event_type, '_set')", "function"),
    ("priority_kebab", "orders", "o_orderkey", "o_orderpriority", None),
]


def names_table(spark, sf_dir):
    """file (the kind), line (the key), column, identifier and context of all derived names."""
    out = None
    for source in dict.fromkeys(n[1] for n in NAMES):  # one scan of each table
        own = [n for n in NAMES if n[1] == source]
        each = F.array(*[F.struct(F.lit(kind).alias("file"), F.expr(name).alias("identifier"), F.lit(context).cast("string").alias("context")) for kind, _, _, name, context in own])
        rows = spread(table(spark, sf_dir, source).select(F.col(own[0][2]).cast("long").alias("line"), each.alias("n"))).select("line", F.explode("n").alias("n"))
        rows = rows.select("n.file", "line", F.lit(1).alias("column"), "n.identifier", "n.context")
        out = rows if out is None else out.unionByName(rows)
    return out


#: Folders that names are placed in, by remainders of their line.
NAME_FOLDERS = ("repo/src/api", "repo/src", "repo/lib", "elsewhere", "repo/src/api/v2/deep")


def placed_names(spark, sf_dir):
    """The derived names with files in folders of a project."""
    folder = f"element_at(array({', '.join(repr(f) for f in NAME_FOLDERS)}), CAST(pmod(line, {len(NAME_FOLDERS)}) AS INT) + 1)"
    return names_table(spark, sf_dir).withColumn("file", F.concat(F.expr(folder), F.lit("/"), "file"))


#: Deliveries of events: a quarter of the month each, and what comes two deliveries late.
DELIVERIES = 4


def delivered_events(spark, sf_dir):
    """Events with the delivery they come in: every eleventh one comes two deliveries late."""
    quarter = F.expr(f"least(CAST((day(ts) - 1) div 8 AS INT), {DELIVERIES - 1})")
    late = F.when(F.col("event_id") % 11 == 0, 2).otherwise(0)
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select("event_id", "ts", "event_type", F.least(quarter + late, F.lit(DELIVERIES - 1)).alias("delivery"))


def document_files(spark, sf_dir, ext="txt"):
    """Documents in the shape of files."""
    return as_files(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), F.col("doc_id"), F.col("text"), ext)


def page_files(spark, sf_dir, ext="css"):
    """Pages in the shape of files whose identifiers may hold hyphens."""
    return as_files(spread(table(spark, sf_dir, "pages").select("page_id", "html")), F.col("page_id"), F.col("html"), ext)


#: Folder and extension of each part's path, by remainders of its key.
_PATH = (
    "concat('repo/', CASE p_partkey % 6 WHEN 0 THEN 'src' WHEN 1 THEN 'node_modules/lib' WHEN 2 THEN '.hidden' WHEN 3 THEN '_pkg' WHEN 4 THEN 'a/target' ELSE 'b' END,"
    " '/', replace(p_name, ' ', '_'), '_', cast(p_partkey as string), CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.kts' WHEN 2 THEN '.md' WHEN 3 THEN '.rs' ELSE '.d.ts' END)"
)


def path_table(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_PATH).alias("path"))


def tree_files(spark, sf_dir):
    """A file for each part's path: two lines with its names."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select(F.expr(_PATH).alias("path"), F.expr(f"array_join({_CAPITAL}, '')").alias("P"), F.expr(_SNAKE).alias("s"))
    return part.select("path", F.concat(F.lit("class "), "P", F.lit("\nself "), "s", F.lit(" value1 = get"), "P", F.lit("\n")).alias("content"))


def guarded_files(spark, sf_dir):
    """Those files with some that text mode leaves out: of 1 MiB and two bytes, of bytes that are not UTF-8; some of 1 MiB stay."""
    own = tree_files(spark, sf_dir)
    key = F.regexp_extract("path", r"_(\d+)\.", 1).cast("long")
    long = lambda n: F.repeat(F.lit("ab"), F.lit(n))
    content = F.when(key % 400 == 7, long(524_289)).when(key % 400 == 8, long(524_288)).otherwise(F.col("content")).cast("binary")
    return own.select("path", F.when(key % 13 == 0, F.unhex(F.lit("61FF62"))).otherwise(content).alias("content"))


#: remainder of the key -> (extension, source text with marks for the Pascal, snake, camel and kebab name)
SOURCES = {
    0: ("py", "import @s\nclass @P:\n    def @s(self, count: int):\n        value = 1\n"),
    1: ("rs", "// fn @s() {}\nuse a::@P;\npub struct @P { size: u32 }\nfn @s(total: u32) { let value = 1; }\n"),
    2: ("js", "/* class Gone */\nclass @P {}\nfunction @c(first) {}\nimport { @s } from 'a';\n"),
    3: ("go", 'type @P struct {}\nfunc @c(total int) {}\nconst @s = 1\nimport "a/@s"\n'),
    4: ("css", ".@k { color: red }\n"),
    5: ("c", "#include <@s.h>\nint @s(int total) {\n  int value = 1;\n}\nstruct @P { int size; };\n"),
    6: ("cpp", "class @P {\n  int @s;\n};\nint @P::@c(int total) { return 1; }\n"),
    7: ("java", "import a.@P;\nclass @P {\n  int @c;\n  void run(String given) { int total = 1; }\n}\n"),
    8: ("rb", "require '@s'\nclass @P\n  def @s(count)\n    total = 1\n  end\nend\n"),
    9: ("php", "<?php\nuse App\\@P;\nclass @P {\n  private $size;\n  function @c($count) {}\n}\n"),
    10: ("cs", "using A.@P;\nclass @P {\n  private int @c;\n  void Run(string given) {}\n}\n"),
    11: ("swift", "import @P\nclass @P {\n  let @c = 1\n  func run(total: Int) {}\n}\n"),
    12: ("kt", "import a.@P\nclass @P {\n  val @c = 1\n  fun run(total: Int) {}\n}\n"),
    13: ("ts", "import { @c } from 'a';\nclass @P {}\nfunction run(total: number): void {}\n"),
    14: ("tsx", "const @c = 1;\nclass @P {}\n"),
}


def source_files(spark, sf_dir):
    """A small source file for each part, in one of fifteen languages."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).withColumns({"P": F.expr(f"array_join({_CAPITAL}, '')"), "s": F.expr(_SNAKE), "k": F.expr("replace(p_name, ' ', '-')")})
    part = part.withColumn("c", F.concat(F.lit("get"), "P"))
    ext, text = F, F
    for key, (e, t) in SOURCES.items():
        ext, text = ext.when(F.expr(f"p_partkey % {len(SOURCES)} = {key}"), F.lit(e)), text.when(F.expr(f"p_partkey % {len(SOURCES)} = {key}"), F.lit(t))
    for mark in "Psck":
        text = F.replace(text, F.lit("@" + mark), F.col(mark))
    part = part.select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("path"), ext.alias("ext"), text.alias("content"))
    return part.select("path", "ext", F.octet_length("content").cast("long").alias("size"), "content")


def nested_files(spark, sf_dir):
    """A source file for each part with nesting and several declarators, in one of thirteen languages."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).withColumns({"P": F.expr(f"array_join({_CAPITAL}, '')"), "s": F.expr(_SNAKE)})
    kinds, texts = F.array(*map(F.lit, NESTED)), F.array(*map(F.lit, NESTED.values()))
    at = (F.col("p_partkey") % len(NESTED)).cast("int") + 1
    text = F.replace(F.element_at(texts, at), F.lit("Qs"), F.col("s"))
    text = F.replace(F.replace(text, F.lit("Qc"), F.concat(F.lit("get"), "P")), F.lit("QP"), F.col("P"))
    part = part.select(F.concat(F.lit("nested_"), F.col("p_partkey").cast("string")).alias("path"), F.element_at(kinds, at).alias("ext"), text.alias("content"))
    return part.select("path", "ext", F.octet_length("content").cast("long").alias("size"), "content")
