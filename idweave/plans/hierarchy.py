"""Configuration files in a hierarchy of folders, for tables of files.

Each file is judged by the nearest configuration above it, or, with ``merged``, by all above it:
fields merge from the root down, and the closest one to the file that sets a field wins.

Paths are cut at ``/``; the folder of a path without one is empty and is the root of relative
paths.  Both joins are equi-joins on folders: a folder's ancestors are listed, so no path is
compared with every configuration.  Folders are few beside the files and are joined first.
"""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import functions as F

from ..functions import names
from ..sources.stored import stored
from .config import FILE_NAME, ConfigError, to_contexts

#: Fields of a context that merge on their own.
FIELDS = ("convention", "prefix", "suffix")


def folder_of(path: str) -> str:
    """SQL: a path's folder."""
    return f"regexp_extract({path}, '^(.*)/[^/]*$', 1)"


def ancestors(folder: str) -> str:
    """SQL: (above, depth) of a folder and of all folders above it, the root with depth 0."""
    parts = f"IF({folder} = '', CAST(array() AS ARRAY<STRING>), split({folder}, '/'))"
    return f"transform(sequence(0, size({parts})), i -> named_struct('above', array_join(slice({parts}, 1, i), '/'), 'depth', i))"


def config_fields(configs):
    """(folder, context, field, value, step) of a table (path, content) of configuration files.

    What a file extends comes first, left to right, then its own; ``step`` counts them.  Entries
    of ``extends`` are names of built-in presets here: a table has no other files to read.
    """

    def run(batches):
        for batch in batches:
            rows = [(path, *r) for path, content in zip(batch.path, batch.content) for r in _fields(path, content)]
            yield pd.DataFrame(rows, columns=["path", "context", "field", "value", "step"])

    found = configs.filter(F.col("path").rlike(rf"(^|/)\Q{FILE_NAME}\E$")).select("path", "content")
    found = found.mapInPandas(run, "path string, context string, field string, value string, step int")
    return found.select(F.expr(folder_of("path")).alias("folder"), "context", "field", "value", "step")


def _fields(path, content):
    """The fields that one file sets; a file that sets none still has a row without context."""
    try:
        data = tomllib.loads(content)
        for step, contexts in enumerate(to_contexts(data)):
            for context, own in contexts.items():
                for field in FIELDS:
                    if own.get(field) is not None:
                        yield context, field, str(own[field]), step
    except (tomllib.TOMLDecodeError, ConfigError, AttributeError, TypeError) as e:
        raise ConfigError(f"failed to parse {path}: {e}") from e
    yield None, None, None, 0


def _one_row(fields, *keys):
    """The fields of each context side by side: of each the value that ``place`` ranks last."""
    each = [F.max_by("value", F.when(F.col("field") == f, F.col("place"))).alias(f) for f in FIELDS]
    return fields.filter("context IS NOT NULL").groupBy(*keys, "context").agg(*each)


def nearest_rules(fields):
    """(folder, context, convention, prefix, suffix) of each folder with a configuration, of that file alone."""
    return _one_row(fields.withColumn("place", F.struct("step")), "folder")


def merged_rules(fields):
    """(folder, context, convention, prefix, suffix) of each folder with a configuration, merged with all above it."""
    below = fields.select("folder").distinct().select("folder", F.explode(F.expr(ancestors("folder"))).alias("a")).select("folder", "a.above", "a.depth")
    above = fields.withColumnRenamed("folder", "above")
    return _one_row(below.join(above, "above").withColumn("place", F.struct("depth", "step")), "folder")


def nearest_folder(folders, fields):
    """(own, folder): for each of the distinct ``own`` folders the nearest one at or above it that has a configuration."""
    known = fields.select(F.col("folder").alias("above")).distinct()
    up = folders.select("own").distinct().select("own", F.explode(F.expr(ancestors("own"))).alias("a")).select("own", "a.above", "a.depth")
    return up.join(known, "above").groupBy("own").agg(F.max_by("above", "depth").alias("folder"))


def lint_tree(identifiers, configs, merged: bool = False):
    """Violations as ``lint`` lists them, each file under the rules of the nearest configuration above it.

    Files with none above them have no rules.  With ``merged`` a field that the nearest one does not
    set comes from the next one above, and so on.
    """
    fields = config_fields(configs)
    rules = (merged_rules if merged else nearest_rules)(fields).select("folder", "context", F.col("convention").alias("expected_convention"), F.expr(names.convention_of_spelling("convention")).alias("wanted"))
    rules = rules.filter("wanted IS NOT NULL")
    rows = identifiers.filter("context IS NOT NULL").withColumn("own", F.expr(folder_of("file")))
    # folders with their rules are joined first; what meets the names has one row for each folder and context.  Stored, its size
    # is known: few folders are broadcast, and the names are not sorted in one task for each of their few keys
    by_folder = nearest_folder(rows, fields).join(rules, "folder").select("own", "context", "expected_convention", "wanted")
    by_folder = stored(identifiers.sparkSession, by_folder, "folders")
    found = rows.join(by_folder, ["own", "context"]).filter(F.col("convention") != F.col("wanted"))
    return found.select("file", "line", "column", "identifier", "expected_convention", F.col("convention").alias("actual_convention"), F.expr(names.joined("tags", "wanted")).alias("suggested_fix"))
