"""Tables in the folder that all executors share: how loops cut their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def shared_dir(df: DataFrame, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a local one is set only on a single machine without the setting."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again."""
    path = shared_dir(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
