"""Small helpers the operators share: columns, native word arrays, shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def word_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array for null or blank texts.

    Trimming first means that no empty strings have to be filtered out with a lambda.
    """
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


class Renamed:
    """A table whose columns are c0, c1, ...: an operator's own columns, which begin with '_', can't clash with the caller's.

    Renaming goes by place, so columns whose names differ in case only, or not at all, all survive.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def has(self, name: str) -> bool:
        return name.lower() in (n.lower() for n in self.names)

    def name(self, name: str) -> str:
        """The new name of a column, found by its exact name first."""
        lowered = [n.lower() for n in self.names]
        return f"c{self.names.index(name) if name in self.names else lowered.index(name.lower())}"

    def restored(self, but: tuple[str, ...] = ()) -> list[Column]:
        """The caller's columns under their names, in order, without those that the operator replaces."""
        gone = {n.lower() for n in but}
        return [F.col(f"c{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in gone]


def row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns of a row. Nulls count by their place; maps and the like as JSON."""
    plain = [c if f.dataType.typeName() not in ("map", "struct", "array", "variant") else F.to_json(F.struct(c)) for c, f in zip(df.columns, df.schema, strict=True)]
    nulls = F.concat(F.lit("n"), *[F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])
    return [F.xxhash64(nulls, *plain), F.xxhash64(F.lit("again"), nulls, *plain)]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor of a cluster can reach.

    Only where the setting is absent (single-machine tests) is a local folder set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, lost executors lose nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A table for the small side of a join: broadcast if it is counted to have at most so many (narrow) rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def total_bytes(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows of a table, and the UTF-8 bytes of a text column."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
