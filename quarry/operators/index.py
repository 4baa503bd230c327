"""Keeping an index: what changed, cascades, meta entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dedupe_files(files: DataFrame, order: str | None = None) -> DataFrame:
    """One row a relpath: the last by ``order``, any of equal rows otherwise."""
    if order is None:
        return files.dropDuplicates(["relpath"])
    last = W.partitionBy("relpath").orderBy(F.desc(order))
    return files.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def changes(walked: DataFrame, stored: DataFrame, parser_changed: bool = False) -> DataFrame:
    """relpath, state of every file on either side: dirty (parse it), reused or removed."""
    new = walked.select("relpath", F.col("digest").alias("new"))
    old = stored.select("relpath", F.col("digest").alias("old"))
    both = new.join(old, "relpath", "full")
    same = F.lit(not parser_changed) & (F.col("new") == F.col("old"))
    return both.select("relpath", F.when(F.col("new").isNull(), "removed").when(F.coalesce(same, F.lit(False)), "reused").otherwise("dirty").alias("state"))


def without_files(table: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """Rows of a table none of whose path columns names a file that went (relpath)."""
    for c in columns or ("relpath",):
        table = table.join(gone.select(F.col("relpath").alias(c)), c, "left_anti")
    return table


def upsert(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """key, value with the changes' values in place of old ones."""
    return meta.join(changes, "key", "left_anti").unionByName(changes)
