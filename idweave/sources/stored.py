"""Intermediate tables in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid


def shared_folder(spark) -> str:
    """The session's ``spark.checkpoint.dir``.  Only a local session without one, as in tests, gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


def stored(spark, df, name: str):
    """``df`` as a Parquet table in the shared folder, read back: what follows does not compute it again."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
