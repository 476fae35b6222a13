"""The registered queries of the identifier operators; every one runs over its whole tables."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import names, sql_functions
from .operators import classify, extract, graph, lint, search
from .plans import config, hierarchy, presets, render
from .sources import derived, files
from .sources.stored import shared_folder, stored
from .streaming import streams


def _parsed(spark, sf_dir):
    return names.parse(derived.names_table(spark, sf_dir))


def _key(df, *columns):
    return df.select("file", "line", "identifier", *columns)


def _extracted(spark, sf_dir, places=True):
    return extract.extract_identifiers(derived.document_files(spark, sf_dir), places=places, max_size=None)


def _kebab(spark, sf_dir):
    return extract.extract_identifiers(derived.page_files(spark, sf_dir), places=False, max_size=None)


#: Rules of the lint queries: a language's own, with two contexts replaced by the project's.
PROJECT = {"version": 1, "name": "shop", "contexts": {"field": {"convention": "camel"}, "import": {"convention": "lowercase"}}}


def project_config():
    return config.merge(config.builtin("rust"), config.from_dict(PROJECT))


def _rules(spark):
    return lint.rules_frame(spark, project_config())


def _violations(spark, sf_dir):
    return lint.lint(_parsed(spark, sf_dir), _rules(spark))


def detect_convention(spark, sf_dir):
    return _key(_parsed(spark, sf_dir), "convention")


def parse_tags(spark, sf_dir):
    return _key(_parsed(spark, sf_dir), F.array_join("tags", " ").alias("tags"))


def canonical_key(spark, sf_dir):
    return _key(_parsed(spark, sf_dir), F.expr(names.canonical("tags")).alias("canonical"))


def namespaces(spark, sf_dir):
    return _key(_parsed(spark, sf_dir), F.expr("array_join(transform(namespaces, d -> array_join(d, ' ')), '|')").alias("namespaces"))


def detect_role(spark, sf_dir):
    return _key(_parsed(spark, sf_dir), "role")


def detect_shape(spark, sf_dir):
    return _key(_parsed(spark, sf_dir), "shape")


def forced_convention(spark, sf_dir):
    """Names parsed under a given convention: every spelling in turn, one of them unknown."""
    spellings = ["snake", "camelCase", "kebab", "screaming", "ada", "title"]
    rows = derived.names_table(spark, sf_dir).withColumn("given", F.expr(f"element_at(array({', '.join(map(names.text, spellings))}), CAST(line % {len(spellings)} AS INT) + 1)"))
    return _key(names.parse(rows, convention_col="given"), "given", "convention", F.array_join("tags", " ").alias("tags"))


def _join(conv):
    return lambda spark, sf_dir: _key(_parsed(spark, sf_dir), F.expr(names.joined("tags", names.text(conv))).alias("rendered"))


def alias_all_long(spark, sf_dir):
    return _key(names.alias_rows(_parsed(spark, sf_dir)), "target", "alias")


def alias_map(spark, sf_dir):
    entries = F.expr(f"array_join(transform(map_entries({names.aliases('tags')}), e -> concat(e.key, '=', e.value)), ' ')")
    return _key(_parsed(spark, sf_dir), entries.alias("aliases"))


def prose(spark, sf_dir):
    return _key(names.describe(_parsed(spark, sf_dir)), "prose")


def sql_surface(spark, sf_dir):
    """The same functions called from SQL."""
    sql_functions.register(spark)
    derived.names_table(spark, sf_dir).createOrReplaceTempView("derived_names")
    return spark.sql(
        "SELECT file, line, identifier, detect_convention(identifier) AS convention, join_tags(name_tags(identifier), 'Ada_Case') AS rendered,"
        " tags_role(name_tags(identifier)) AS role FROM derived_names"
    )


def equivalence_groups(spark, sf_dir):
    """Canonical keys with their number of spellings and occurrences."""
    rows = _parsed(spark, sf_dir).select(F.expr(names.canonical("tags")).alias("canonical"), "identifier")
    return rows.groupBy("canonical").agg(F.countDistinct("identifier").alias("spellings"), F.count(F.lit(1)).alias("n"))


def extract_lines(spark, sf_dir):
    return extract.lines(derived.document_files(spark, sf_dir)).select(F.col("path").alias("file"), "line", "text")


def extract_identifiers(spark, sf_dir):
    return _extracted(spark, sf_dir, places=False).select("file", "line", "identifier", "convention", F.array_join("tags", " ").alias("tags"))


def extract_columns(spark, sf_dir):
    return _extracted(spark, sf_dir).select("file", "line", "column", "identifier")


def extract_kebab(spark, sf_dir):
    return _kebab(spark, sf_dir).select("file", "line", "identifier", F.array_join("tags", " ").alias("tags"))


def keyword_filter(spark, sf_dir):
    """Occurrences that are dropped, by word."""
    found = extract.occurrences(extract.lines(derived.document_files(spark, sf_dir)).drop("ext", "size"), places=False)
    return found.filter(~extract.is_identifier()).groupBy("identifier").agg(F.count(F.lit(1)).alias("n"))


def identifier_counts(spark, sf_dir):
    return extract.identifier_counts(derived.document_files(spark, sf_dir), max_size=None)


def _search(query):
    return lambda spark, sf_dir: search.search(_parsed(spark, sf_dir), query).select("file", "line", "identifier", "convention")


def search_documents(spark, sf_dir):
    return search.search(_extracted(spark, sf_dir, places=False), "With").select("file", "line", "identifier")


def search_ordered(spark, sf_dir):
    """The query's tags in the query's order."""
    return search.search(_parsed(spark, sf_dir), "smallGear", ordered=True).select("file", "line", "identifier", "convention")


def search_sorted(spark, sf_dir):
    """Hits with their place in the order of file, line and column."""
    hits = search.search(_parsed(spark, sf_dir), "GearSmall")
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("line", "column")))
    return ranked.select("file", "place", "line", "identifier")


def _end_words(spark, sf_dir):
    """Queries of the first and the last word of every part name."""
    return derived.table(spark, sf_dir, "part").select(F.expr("concat(element_at(split(p_name, ' '), 1), '_', element_at(split(p_name, ' '), -1))").alias("query")).distinct()


def search_many_ordered(spark, sf_dir):
    return search.search_many(_parsed(spark, sf_dir), _end_words(spark, sf_dir), ordered=True).select("query", "file", "line", "identifier")


def search_many(spark, sf_dir):
    """Every part name as a query against all derived names."""
    queries = derived.table(spark, sf_dir, "part").select(F.expr("replace(p_name, ' ', '-')").alias("query")).distinct()
    return search.search_many(_parsed(spark, sf_dir), queries).select("query", "file", "line", "identifier")


def graph_nodes(spark, sf_dir):
    return graph.tag_nodes(_parsed(spark, sf_dir))


def graph_edges(spark, sf_dir):
    return graph.tag_edges(_parsed(spark, sf_dir))


def graph_dot_lines(spark, sf_dir):
    return graph.dot_lines(graph_edges(spark, sf_dir)).select("dot")


def graph_json_edges(spark, sf_dir):
    return render.edge_json(graph_edges(spark, sf_dir)).select("json")


def _subgraph(spark, sf_dir):
    # each name is parsed once, however often it occurs
    counted = stored(spark, derived.names_table(spark, sf_dir).groupBy("identifier").agg(F.count(F.lit(1)).alias("n")), "names")
    parsed = names.parse(counted)
    return graph.subgraph(graph.tag_nodes(parsed), graph.tag_edges(parsed, "n"), "smallGear")


def graph_json_nodes(spark, sf_dir):
    """The nodes of a graph's JSON text: also those of names of one tag, which no edge touches."""
    return render.node_json(graph.tag_nodes(_parsed(spark, sf_dir)), graph_edges(spark, sf_dir)).select("tag", "json", "isolated")


def graph_subgraph_nodes(spark, sf_dir):
    return _subgraph(spark, sf_dir)[0]


def graph_subgraph_edges(spark, sf_dir):
    return _subgraph(spark, sf_dir)[1]


def graph_kebab_pages(spark, sf_dir):
    return graph.tag_edges(_kebab(spark, sf_dir))


def lint_violations(spark, sf_dir):
    return _violations(spark, sf_dir).select("file", "line", "identifier", "expected_convention", "actual_convention")


def lint_suggested_fix(spark, sf_dir):
    return _violations(spark, sf_dir).select("file", "line", "identifier", "suggested_fix")


def lint_lines(spark, sf_dir):
    return render.lint_lines(_violations(spark, sf_dir)).select("text")


#: Files of a project: what the nearest one extends is merged left to right, then its own values.
PROJECT_FILES = {
    ".naming.toml": 'version = 1\nname = "shop"\nextends = ["java", "team.toml"]\n[contexts.type]\nconvention = "Ada_Case"\n[contexts.import]\nconvention = "lowercase"\n',
    "team.toml": 'version = 1\nname = "team"\nextends = ["rust"]\n[contexts.field]\nconvention = "kebab"\n[contexts.parameter]\nconvention = "snake"\n',
    "src/main/readme.txt": "",
}


def _rules_of_files(spark, texts):
    """The rules that hold for src/main in a project of these files."""
    with tempfile.TemporaryDirectory() as folder:
        for name, text in texts.items():
            path = os.path.join(folder, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w") as f:
                f.write(text)
        return lint.rules_frame(spark, config.resolve(config.find(os.path.join(folder, "src/main"))))


def lint_resolved_config(spark, sf_dir):
    """Violations of a configuration file that extends a language and another file."""
    found = lint.lint(_parsed(spark, sf_dir), _rules_of_files(spark, PROJECT_FILES))
    return found.select("file", "line", "identifier", "expected_convention", "suggested_fix")


def lint_generated_config(spark, sf_dir):
    """Violations of a new configuration file as it is generated for a language."""
    found = lint.lint(_parsed(spark, sf_dir), _rules_of_files(spark, {".naming.toml": config.generate("go"), "src/main/x": ""}))
    return found.select("file", "line", "identifier", "expected_convention", "suggested_fix")


#: Configuration files of a project's folders; a rule without convention only adds to those above it.
FOLDER_CONFIGS = [
    ("repo/.naming.toml", 'version = 1\nname = "repo"\nextends = ["rust"]\n[contexts.field]\nconvention = "kebab"\n[contexts.import]\nconvention = "screaming"\n'),
    ("repo/src/.naming.toml", 'version = 1\nname = "src"\n[contexts.function]\nconvention = "PascalCase"\nprefix = "do"\n[contexts.import]\nconvention = "lowercase"\n'),
    ("repo/src/api/.naming.toml", 'version = 1\nname = "api"\n[contexts.type]\nconvention = "Ada_Case"\n[contexts.function]\nsuffix = "Fn"\n'),
]


def _folder_configs(spark):
    return spark.createDataFrame(FOLDER_CONFIGS, "path string, content string")


def _lint_tree(spark, sf_dir, merged):
    found = hierarchy.lint_tree(names.parse(derived.placed_names(spark, sf_dir)), _folder_configs(spark), merged)
    return found.select("file", "line", "identifier", "expected_convention", "suggested_fix")


def lint_nearest_config(spark, sf_dir):
    """Each file under the rules of the nearest configuration above it."""
    return _lint_tree(spark, sf_dir, False)


def lint_merged_config(spark, sf_dir):
    """Each file under the rules of all configurations above it, the closest one first."""
    return _lint_tree(spark, sf_dir, True)


def merged_context_rules(spark, sf_dir):
    """The rules that hold for each derived name's folder, with prefix and suffix, and how many names they meet."""
    fields = hierarchy.config_fields(_folder_configs(spark))
    own = derived.placed_names(spark, sf_dir).select(F.expr(hierarchy.folder_of("file")).alias("own"), "context").filter("context IS NOT NULL")
    counts = own.groupBy("own", "context").agg(F.count(F.lit(1)).alias("n"))
    rules = hierarchy.nearest_folder(counts, fields).join(hierarchy.merged_rules(fields), "folder")
    return counts.join(rules, ["own", "context"]).select("own", "folder", "context", "convention", "prefix", "suffix", "n")


def preset_violations(spark, sf_dir):
    """Violations of every built-in preset's rules over all derived names."""
    rules = presets.presets_frame(spark).select("preset", "context", "convention").withColumnRenamed("convention", "wanted")
    parsed = _parsed(spark, sf_dir).groupBy("context", "convention").agg(F.count(F.lit(1)).alias("n"))
    found = parsed.join(F.broadcast(rules), "context").filter("convention <> wanted")
    return found.groupBy("preset", "context", "wanted").agg(F.sum("n").alias("violations"))


def source_prune(spark, sf_dir):
    return files.prune(derived.path_table(spark, sf_dir)).select("p_partkey", "path")


def detect_language(spark, sf_dir):
    ext = files.ext_of(F.col("path"))
    return derived.path_table(spark, sf_dir).select("p_partkey", ext.alias("ext"), files.language_of(ext).alias("language"))


def _written_tree(spark, rows):
    """The place of a new tree of files in the shared folder."""
    root = f"{files.local_path(shared_folder(spark))}/tree-{uuid.uuid4().hex}"
    files.write_tree(rows, root)
    return root


def _below(root, column="file"):
    return F.expr(f"substring({column}, {len(root) + 2})").alias(column)


def scan_tree(spark, sf_dir):
    """Identifiers of a tree of source files that is written first, in the shared folder."""
    root = _written_tree(spark, derived.tree_files(spark, sf_dir))
    found = extract.extract_identifiers(files.read_tree(spark, root, extract.MAX_FILE_SIZE))
    return found.select(_below(root), "line", "column", "identifier")


def scan_guards(spark, sf_dir):
    """Files of a tree that text mode reads: none over 1 MiB, none that is not UTF-8, no links."""
    root = _written_tree(spark, derived.guarded_files(spark, sf_dir))
    # a link to a folder and one to nothing
    os.symlink(f"{root}/repo/src", f"{root}/repo/linked")
    os.symlink(f"{root}/gone.py", f"{root}/repo/dangling.py")
    return files.read_tree(spark, root, extract.MAX_FILE_SIZE).select(_below(root, "path"), "size")


def scan_filtered(spark, sf_dir):
    """A part of the tree: only its folders are opened, and only files of the extensions and sizes are read."""
    root = _written_tree(spark, derived.tree_files(spark, sf_dir))
    tree = files.read_tree(spark, root, extract.MAX_FILE_SIZE, min_size=51, extensions=("py", "rs"), below="repo/src")
    return tree.select(_below(root, "path"), "size")


def stream_tree(spark, sf_dir):
    """Identifiers of a tree that arrive as a stream of files."""
    root = _written_tree(spark, derived.tree_files(spark, sf_dir))
    time.sleep(files.SETTLED)
    found = extract.extract_identifiers(files.stream_tree(spark, root, extract.MAX_FILE_SIZE)).select(_below(root), "line", "column", "identifier")
    return streams.run_once(found, spark)


def sql_table_function(spark, sf_dir):
    """Names of documents by a SQL table function."""
    sql_functions.register(spark)
    derived.table(spark, sf_dir, "documents").createOrReplaceTempView("derived_documents")
    return spark.sql("SELECT CAST(d.doc_id AS STRING) AS file, e.line, e.identifier, e.convention, array_join(e.tags, ' ') AS tags FROM derived_documents d, LATERAL extract_names(d.text) e")


def sql_renderings(spark, sf_dir):
    """All renderings of the derived names by a SQL table function."""
    sql_functions.register(spark)
    derived.names_table(spark, sf_dir).createOrReplaceTempView("derived_names")
    return spark.sql("SELECT n.file, n.line, n.identifier, r.convention AS target, r.alias FROM derived_names n, LATERAL name_renderings(n.identifier) r")


def classify_contexts(spark, sf_dir):
    return classify.classify(derived.source_files(spark, sf_dir)).select("file", "line", "column", "identifier", "context", "language")


def classify_nested(spark, sf_dir):
    """Contexts in files with nesting and several declarators."""
    return classify.classify(derived.nested_files(spark, sf_dir)).select("file", "line", "column", "identifier", "context", "language")


def extract_with_context(spark, sf_dir):
    return classify.extract_with_context(derived.source_files(spark, sf_dir), max_size=None).select("file", "line", "column", "identifier", "context", "convention")


def lint_sources(spark, sf_dir):
    """Rules against the contexts of source files."""
    return lint.lint(classify.extract_with_context(derived.source_files(spark, sf_dir), max_size=None), _rules(spark))


def extract_text_lines(spark, sf_dir):
    return render.extract_lines(_parsed(spark, sf_dir)).select("text")


def parsed_json(spark, sf_dir):
    return _key(_parsed(spark, sf_dir), render.parsed_json(None).alias("json"))


def stream_parse(spark, sf_dir):
    """Names of the part table parsed on a stream."""
    stream = streams.read_table_stream(spark, f"{sf_dir}/part.parquet").select("p_partkey", F.expr("replace(p_name, ' ', '_')").alias("identifier"))
    parsed = streams.parse_stream(stream).select("p_partkey", "identifier", F.array_join("tags", " ").alias("tags"))
    return streams.run_once(parsed, spark)


def stream_graph_edges(spark, sf_dir):
    """Running edge weights of the part table's names after the last batch."""
    stream = streams.read_table_stream(spark, f"{sf_dir}/part.parquet").select(F.expr("replace(p_name, ' ', '_')").alias("identifier"))
    return streams.run_once(streams.edge_counts(streams.parse_stream(stream)), spark, "complete")


def stream_windowed_tags(spark, sf_dir):
    """Tags of event names in hourly windows."""
    stream = streams.read_table_stream(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.expr("concat('on_', event_type)").alias("identifier"))
    counts = streams.run_once(streams.windowed_tags(streams.parse_stream(stream), late="3650 days"), spark, "complete")
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "tag", "n")


def stream_late_tags(spark, sf_dir):
    """Closed hourly windows of events that come in four deliveries, some two deliveries late: those over 36 hours late are dropped."""
    folder = streams.deliveries(spark, derived.delivered_events(spark, sf_dir), "delivery", derived.DELIVERIES)
    stream = streams.read_table_stream(spark, folder, files_a_batch=1).select("ts", F.expr("concat('on_', event_type)").alias("identifier"))
    counts = streams.run_once(streams.windowed_tags(streams.parse_stream(stream), late="36 hours"), spark)
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "tag", "n")


def queries():
    own = [
        detect_convention, parse_tags, canonical_key, namespaces, detect_role, detect_shape, forced_convention, alias_all_long, alias_map, prose,
        sql_surface, equivalence_groups, extract_lines, extract_identifiers, extract_columns, extract_kebab, keyword_filter, identifier_counts,
        search_documents, search_ordered, search_sorted, search_many, search_many_ordered, graph_nodes, graph_edges, graph_dot_lines, graph_json_edges, graph_json_nodes, graph_subgraph_nodes, graph_subgraph_edges, graph_kebab_pages,
        lint_violations, lint_suggested_fix, lint_lines, lint_resolved_config, lint_generated_config, lint_nearest_config, lint_merged_config, merged_context_rules,
        preset_violations, source_prune, detect_language, scan_tree, scan_guards, scan_filtered, stream_tree, sql_table_function, sql_renderings, classify_contexts, classify_nested, extract_with_context,
        lint_sources, extract_text_lines, parsed_json, stream_parse, stream_graph_edges, stream_windowed_tags, stream_late_tags,
    ]
    out = {f.__name__: f for f in own}
    for short, conv in (("snake", "snake_case"), ("camel", "camelCase"), ("pascal", "PascalCase"), ("kebab", "kebab-case"), ("upper", "UPPER_SNAKE_CASE"), ("ada", "Ada_Case")):
        out[f"join_{short}"] = _join(conv)
    out |= {"search_single": _search("gear"), "search_and": _search("GearSmall"), "search_empty": _search("")}
    return out
