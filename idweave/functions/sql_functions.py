"""The identifier functions as SQL functions: their bodies are expressions that Catalyst inlines.

The table functions are for ``LATERAL``.  Their bodies explode one expression, so that Catalyst
turns the join with them into a generator on the outer rows: no shuffle, no Python.
"""

from __future__ import annotations

from . import names

#: function -> (parameters, return type, body)
FUNCTIONS = {
    "detect_convention": ("n STRING", "STRING", names.convention("n")),
    "parse_convention": ("s STRING", "STRING", names.convention_of_spelling("s")),
    "name_tags": ("n STRING", "ARRAY<STRING>", names.tags("n", f"({names.convention('n')})")),
    "name_namespaces": ("n STRING", "ARRAY<ARRAY<STRING>>", names.namespaces("n", f"({names.convention('n')})")),
    "tags_role": ("t ARRAY<STRING>", "STRING", names.role("t")),
    "tags_shape": ("t ARRAY<STRING>", "STRING", names.shape("t")),
    "canonical_name": ("t ARRAY<STRING>", "STRING", names.canonical("t")),
    "join_tags": ("t ARRAY<STRING>, c STRING", "STRING", names.joined("t", "c")),
    "name_aliases": ("t ARRAY<STRING>", "MAP<STRING, STRING>", names.aliases("t")),
    "tags_prose": ("t ARRAY<STRING>, r STRING, s STRING", "STRING", names.prose("t", "r", "s")),
}


def _extracted(pattern):
    """SQL: structs of line and identifier of a text's names, as text mode extracts them."""
    from ..operators.extract import KEYWORDS  # the operators build on these functions

    words = ", ".join(map(names.text, KEYWORDS))
    pieces = r"split(regexp_replace(content, r'\r?\n\z', ''), r'\r?\n')"
    kept = f"filter(regexp_extract_all(t, r'{pattern}', 0), x -> octet_length(x) > 1 AND x NOT IN ({words}))"
    return f"flatten(transform(IF(content = '', CAST(array() AS ARRAY<STRING>), {pieces}), (t, i) -> transform({kept}, x -> named_struct('line', i + 1, 'identifier', x))))"


def table_functions():
    """function -> (parameters, columns, body)"""
    from ..operators.extract import KEBAB, PLAIN

    columns = "line INT, identifier STRING, convention STRING, tags ARRAY<STRING>"
    body = f"SELECT o.line, o.identifier, {names.convention('o.identifier')}, {names.tags('o.identifier', '(' + names.convention('o.identifier') + ')')} FROM (SELECT explode(@) AS o)"
    return {
        "extract_names": ("content STRING", columns, body.replace("@", _extracted(PLAIN))),
        "extract_hyphened_names": ("content STRING", columns, body.replace("@", _extracted(KEBAB))),
        "name_renderings": (
            "name STRING", "convention STRING, alias STRING",
            # the tags are found once, not for each convention; no lambda, so Spark compiles it all
            f"SELECT o.`0`, {names.joined('o.`1`', 'o.`0`')} FROM (SELECT explode(arrays_zip(array({', '.join(map(names.text, names.CONVENTIONS))}), array_repeat({names.tags('name', '(' + names.convention('name') + ')')}, {len(names.CONVENTIONS)}))) AS o)",
        ),
    }


def register(spark) -> None:
    """Create all functions as temporary functions of the session."""
    for name, (parameters, columns, body) in table_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
