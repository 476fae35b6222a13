"""Structured Streaming forms.

Parsing, extraction, search and lint keep no state, so their batch functions run on a stream as
they are.  The tag graph becomes a running count: each micro-batch is aggregated before it
meets the state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import names
from ..operators.graph import tag_edges
from ..sources.stored import shared_folder


def deliveries(spark, rows, delivery_col, n):
    """A Parquet folder that holds each delivery's rows in a file of its own, written one after the other."""
    folder = f"{shared_folder(spark)}/deliveries-{uuid.uuid4().hex}"
    for k in range(n):
        rows.filter(F.col(delivery_col) == k).drop(delivery_col).coalesce(1).write.mode("append").parquet(folder)
    return folder


def read_table_stream(spark, path, files_a_batch=None):
    """A stream of the files of a Parquet table, a folder or a single file; the oldest files come first."""
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(f.rstrip("/").endswith(f"/{name}") for f in batch.inputFiles()):  # streams read folders only
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def parse_stream(stream, name_col="identifier"):
    """Parsed names of a stream; nothing is kept between batches."""
    return names.parse(stream, name_col)


def edge_counts(stream):
    """Running edge weights of a stream of parsed names, for complete or update mode."""
    return tag_edges(stream)


def run_once(stream, spark, mode="append"):
    """All that a stream holds now, written to the shared folder and read back.

    Append mode keeps every batch's rows; in complete mode the last batch's result stands.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{folder}/out")
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def windowed_tags(stream, time_col="ts", window="1 hour", late="2 hours"):
    """(window start, tag, n): tags of a stream of parsed names in tumbling windows.

    The watermark is the latest time of all earlier batches less ``late``.  Rows of windows that end
    by then are dropped; in append mode a window comes out once, when the watermark passes
    its end, and its state is freed.
    """
    rows = stream.withWatermark(time_col, late).select(time_col, F.explode("tags").alias("tag"))
    counts = rows.groupBy(F.window(time_col, window).alias("w"), "tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "tag", "n")
