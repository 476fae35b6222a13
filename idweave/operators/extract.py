"""Identifier extraction from file contents: a flat map that stays inside the JVM.

Input: rows with ``path``, ``ext``, ``size`` and ``content``.  Output: one row for each
occurrence with file, line, column (1-based byte offset) and the parsed name.  Everything is one
stage without a shuffle: scan, explode lines, explode identifiers, project.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..sources.files import KEBAB_EXTENSIONS

#: Words that are never identifiers (fixed values); the test minds case.
KEYWORDS = (
    "if", "else", "for", "while", "return", "fn", "func", "function", "def", "class", "struct", "enum", "impl", "use",
    "import", "from", "let", "const", "var", "pub", "self", "this", "true", "false", "null", "none", "nil",
)

#: Larger files of a source tree yield nothing in text mode (fixed value); texts of tables have no limit.
MAX_FILE_SIZE = 1_048_576

#: Bytes of a marked line that is not cut, matches of each part of a longer one, and parts whose lengths are added up together.
SHORT, BLOCK, GROUP = 256, 16, 256

PLAIN = r"(?U)\b[a-zA-Z_$][a-zA-Z0-9_$]*\b"
KEBAB = r"(?U)\b[a-zA-Z_$][a-zA-Z0-9_$-]*\b"


def lines(files, content_col: str = "content"):
    """A row for each line; ``\\n`` and ``\\r\\n`` end one, a last empty piece is none.  ``line`` counts from 1."""
    pieces = F.split(F.regexp_replace(F.col(content_col), r"\r?\n\z", ""), r"\r?\n")
    rows = files.filter(F.octet_length(content_col) > 0)
    return rows.select(*[c for c in files.columns if c != content_col], F.posexplode(pieces).alias("line", "text")).withColumn("line", F.col("line") + 1)


def occurrences(rows, kebab=None, places=True):
    """A row for each identifier match of lines: identifier and its byte column; no filters yet.

    ``kebab`` is a boolean column that chooses the pattern with hyphens.  Without ``places`` the
    column, most of the work, is left out.
    """
    if not places:
        every = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        found = every(PLAIN) if kebab is None else F.when(kebab, every(KEBAB)).otherwise(every(PLAIN))
        return rows.select(*[c for c in rows.columns if c != "text"], F.explode(found).alias("identifier"))
    marked = lambda pattern: F.regexp_replace("text", pattern, "\u0001$0\u0002")
    kept = [c for c in rows.columns if c != "text"]
    # a line that holds a mark character itself would shift the places
    rows = rows.withColumn("text", F.translate("text", "\u0001\u0002", "  "))
    rows = rows.withColumn("__m", marked(PLAIN) if kebab is None else F.when(kebab, marked(KEBAB)).otherwise(marked(PLAIN)))
    # long lines are cut into parts of BLOCK matches, so that the place of a match in its part is found by looking at little text
    parts = F.regexp_extract_all("__m", F.lit(f"[^\u0001]*(?:\u0001[^\u0001]*){{1,{BLOCK}}}"), F.lit(0))
    rows = rows.select(*kept, F.when(F.octet_length("__m") <= SHORT, F.array("__m")).otherwise(parts).alias("__p"))
    # byte offsets of the parts: sums over groups of them, then within a group
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    sizes = f"transform(__p, x -> octet_length(x) - {2 * BLOCK})"
    before = lambda sums, at: f"aggregate({sums}, named_struct('at', {at}, 'out', CAST(array() AS ARRAY<INT>)), (s, x) -> named_struct('at', s.at + x, 'out', concat(s.out, array(s.at))), s -> s.out)"
    own = f"slice(b, c * {GROUP} + 1, {GROUP})"
    every = f"sequence(0, CAST((size(b) - 1) div {GROUP} AS INT))"
    groups = f"transform({every}, c -> aggregate({own}, 0, (s, x) -> s + x))"
    offsets = let("b", sizes, let("g", before(groups, "0"), f"flatten(transform({every}, c -> {before(own, 'g[c]')}))"))
    rows = rows.withColumn("__o", F.expr(f"IF(size(__p) < 2, array(0), {offsets})"))
    rows = rows.select(*kept, F.explode(F.arrays_zip("__p", "__o")).alias("__z"))
    rows = rows.select(*kept, F.col("__z.__p").alias("__p"), F.col("__z.__o").alias("__o"))
    # compiled functions from here on: a split by one character, and the bytes before the k-th mark
    rows = rows.select(*kept, "__p", "__o", F.posexplode(F.split("__p", "\u0001")).alias("__k", "__t")).filter("__k > 0")
    column = F.expr("1 + __o + octet_length(substring_index(__p, '\u0001', __k)) - 2 * (__k - 1)")
    return rows.select(*kept, F.substring_index("__t", "\u0002", 1).alias("identifier"), column.alias("column"))


def is_identifier(c: str = "identifier"):
    """Longer than one byte and no keyword."""
    return (F.octet_length(c) > 1) & ~F.col(c).isin(*KEYWORDS)


def extract_identifiers(files, path_col: str = "path", places: bool = True, max_size: int | None = MAX_FILE_SIZE):
    """The occurrence table of text mode: file, line, column, identifier and the parsed fields; context is null.

    Without ``places`` there is no column.  ``max_size`` is for the files of a tree; None takes texts of any size.
    """
    if max_size is not None:
        files = files.filter(F.col("size") <= max_size)
    src = files.select(F.col(path_col).alias("file"), "ext", "content")
    found = occurrences(lines(src), F.col("ext").isin(*KEBAB_EXTENSIONS), places).filter(is_identifier())
    found = names.parse(found.drop("ext"))
    return found.withColumns({"context": F.lit(None).cast("string"), "language": F.lit(None).cast("string")})


def identifier_counts(files, max_size: int | None = MAX_FILE_SIZE):
    """Occurrences of each identifier and of its canonical key: partial sums before the shuffle."""
    found = extract_identifiers(files, places=False, max_size=max_size)
    return found.groupBy("identifier", F.expr(names.canonical("tags")).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))
