"""Code that nothing reaches: dead symbols, dead files, hollow bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.tags import hollow_reason

_ROOTS = ("app", "cli", "main", "run", "setup")


def _product(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("is_test")).select("relpath")


def dead_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols no call resolves to, that are no entries, tests or usual roots; public ones first."""
    unused = symbols.filter((F.col("fan_in") == 0) & ~F.col("is_entry") & ~F.col("is_test") & ~F.col("name").isin(*_ROOTS))
    return unused.join(_product(files), "relpath", "left_semi").orderBy(F.desc("is_public"), "relpath", "start_line", "ord")


def dead_files(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Product files without incoming edges (own ones count) and without entries."""
    reached = edges.filter("dst_relpath is not null").select(F.col("dst_relpath").alias("relpath"))
    entered = symbols.filter("is_entry").select("relpath")
    return files.filter(~F.col("is_test")).join(reached, "relpath", "left_anti").join(entered, "relpath", "left_anti").orderBy("relpath")


def hollow_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Product symbols with a reason for being called hollow."""
    rows = symbols.filter(~F.col("is_test")).withColumn("reason", hollow_reason("body", "docstring")).filter("reason <> ''")
    return rows.join(_product(files), "relpath", "left_semi")
