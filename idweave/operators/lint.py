"""Convention rules: occurrences with a syntactic context against a small table of rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names

#: Contexts that rules can name (fixed values).
CONTEXTS = ("function", "variable", "type", "constant", "import", "parameter", "field")


def rules_frame(spark, config):
    """(context, expected): the configuration's usable rules, seven at most."""
    contexts = config.contexts or {}
    rows = [(c, contexts[c].convention) for c in CONTEXTS if c in contexts and names.parse_convention(contexts[c].convention)]
    return spark.createDataFrame(rows, "context string, expected_convention string")


def lint(identifiers, rules):
    """Violations: file, line, column, identifier, expected and actual convention, suggested fix.

    ``rules`` holds (context, expected_convention), one row for each context that has a rule: at
    most ``len(CONTEXTS)`` rows, so the side that is broadcast does not grow with the data.
    """
    rules = rules.filter(F.col("context").isin(*CONTEXTS)).dropDuplicates(["context"])
    wanted = rules.select("context", "expected_convention", F.expr(names.convention_of_spelling("expected_convention")).alias("wanted"))
    found = identifiers.join(F.broadcast(wanted.filter("wanted IS NOT NULL")), "context")
    found = found.filter(F.col("convention") != F.col("wanted"))
    return found.select("file", "line", "column", "identifier", "expected_convention", F.col("convention").alias("actual_convention"), F.expr(names.joined("tags", "wanted")).alias("suggested_fix"))
