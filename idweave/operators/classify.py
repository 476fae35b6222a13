"""Syntactic contexts of identifiers.

Python files go through the standard ``ast`` module, a file at a time in tasks.  Declarations of
all other languages are found by column expressions (``declarations``): tokens, brackets, statements
and a table of rules.  This approximates a grammar: exotic layouts may differ.  Imports are reported
where their statement begins.  Rows are parsed further as column expressions.

Equal texts of one language, as copies of a file are, have equal declarations: ``classify`` stores the
different texts once with a number each, finds and parses the names of these, and joins them to the files
by the texts' SHA-256.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..sources.files import language_of
from ..sources.stored import stored
from .declarations import declarations
from .extract import MAX_FILE_SIZE, extract_identifiers


def _python(content):
    """(offset as (line, byte column), name, context) of Python's declarations."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return
    rows = content.split("\n")
    place = lambda line, name, col: (line, len(rows[line - 1].encode()[:col]) + rows[line - 1].encode()[col:].find(name.encode()) + 1)
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield *place(node.lineno, node.name, node.col_offset + (9 if isinstance(node, ast.AsyncFunctionDef) else 3)), node.name, "function"
            args = node.args
            for a in [*args.posonlyargs, *args.args, *args.kwonlyargs]:
                if a.annotation is not None:
                    yield a.lineno, a.col_offset + 1, a.arg, "parameter"
        elif isinstance(node, ast.ClassDef):
            yield *place(node.lineno, node.name, node.col_offset + 5), node.name, "type"
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name):
                    yield target.lineno, target.col_offset + 1, target.id, "variable"
        elif isinstance(node, ast.ImportFrom) and not node.level:
            if node.module != "__future__":  # a statement of its own kind
                yield *place(node.lineno, node.module, node.col_offset + 4), node.module, "import"
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            # the first name that is not renamed; a relative module is no plain name
            for a in node.names:
                if a.asname is None and a.name != "*":
                    yield a.lineno, a.col_offset + 1, a.name, "import"
                    break


def python_declarations(files):
    """(file, line, column, identifier, context, language) of a table (file, language, content) of Python files."""

    def run(batches):
        for batch in batches:
            rows = [(file, *r, language) for file, language, content in zip(batch.file, batch.language, batch.content) for r in sorted(set(_python(content))) if len(r[2].encode()) > 1]
            yield pd.DataFrame(rows, columns=["file", "line", "column", "identifier", "context", "language"])

    return files.mapInPandas(run, f"file {files.schema['file'].dataType.simpleString()}, line int, column int, identifier string, context string, language string")


def contexts_of(content, language):
    """Sorted (line, column, name, context) of one text, by the session that runs or a new one; names of one byte are left out."""
    spark = SparkSession.builder.getOrCreate()
    files = spark.createDataFrame([("", language, content)], "file string, language string, content string")
    found = (python_declarations if language == "python" else declarations)(files)
    return sorted(map(tuple, found.select("line", "column", "identifier", "context").collect()))


def different_texts(src):
    """(file, language, text, content) of the different texts of a table (language, text, content): ``file`` is a number."""
    texts = src.select("language", "text", "content").distinct()
    return stored(src.sparkSession, texts.select(F.monotonically_increasing_id().alias("file"), "language", "text", "content"), "texts")


def classify(files, path_col: str = "path"):
    """The occurrence table of syntax mode for the files of known languages.

    Each row is a file; a null or empty text has no rows.
    """
    src = files.select(F.col(path_col).alias("file"), language_of(F.col("ext")).alias("language"), "content").filter("language IS NOT NULL AND content <> ''")
    src = src.withColumn("text", F.unhex(F.sha2("content", 256)))
    texts = different_texts(src)
    own = texts.select("file", "language", "content")
    found = python_declarations(own.filter("language = 'python'")).unionByName(declarations(own.filter("language <> 'python'")))
    # merged, so that AQE splits the files of a very frequent text, and neither side is held whole
    found = names.parse(found).join(texts.select("file", "text").hint("merge"), "file").drop("file")
    found = src.select("file", "language", "text").join(found.hint("merge"), ["language", "text"])
    return found.select("file", "line", "column", "identifier", "convention", "tags", "namespaces", "role", "shape", "context", "language")


def extract_with_context(files, path_col: str = "path", max_size: int | None = MAX_FILE_SIZE):
    """Syntax mode where the language is known, text mode (context null) elsewhere; ``max_size`` is the text mode's."""
    other = files.filter(language_of(F.col("ext")).isNull())
    return classify(files, path_col).unionByName(extract_identifiers(other, path_col, max_size=max_size))
