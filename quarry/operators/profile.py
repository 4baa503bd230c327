"""Profiles: weights by frame, laid over files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPEEDSCOPE = "shared struct<frames:array<struct<name:string>>>, profiles array<struct<samples:array<array<long>>,weights:array<double>>>"
CPUPROFILE = "nodes array<struct<callFrame:struct<functionName:string>,name:string,hitCount:double>>"


def speedscope_weights(rows: DataFrame, column: str = "json") -> DataFrame:
    """name, weight of the first profile's leaf frames; a sample without a weight counts 1."""
    p = rows.select(F.from_json(column, SPEEDSCOPE).alias("p")).select("p.shared.frames", F.get("p.profiles", F.lit(0)).alias("f"))
    samples = p.select("frames", F.col("f.weights").alias("w"), F.posexplode("f.samples").alias("i", "sample")).filter(F.size("sample") > 0)
    name = F.get(F.col("frames"), F.element_at("sample", -1).cast("int"))["name"]
    return samples.select(name.alias("name"), F.coalesce(F.get("w", F.col("i")), F.lit(1.0)).alias("weight")).filter("name is not null").groupBy("name").agg(F.sum("weight").alias("weight"))


def cpuprofile_weights(rows: DataFrame, column: str = "json") -> DataFrame:
    """name, weight by hits of functions; empty names leave."""
    nodes = rows.select(F.explode(F.from_json(column, CPUPROFILE)["nodes"]).alias("n"))
    named = nodes.select(F.coalesce("n.callFrame.functionName", "n.name", F.lit("")).alias("name"), F.coalesce("n.hitCount", F.lit(0.0)).alias("weight")).filter("name <> ''")
    return named.groupBy("name").agg(F.sum("weight").alias("weight"))


def short_name(name: F.Column) -> F.Column:
    """After the last '.', and then after the last '::'."""
    return F.element_at(F.split(F.element_at(F.split(name, "\\."), -1), "::"), -1)


def overlay(files: DataFrame, symbols: DataFrame, weights: DataFrame) -> DataFrame:
    """Files with the weights of frames that name one of their symbols added to profile_self and profile_total."""
    hits = weights.withColumn("name", short_name(F.col("name"))).join(symbols.select("name", "relpath"), "name")
    added = hits.groupBy("relpath").agg(F.sum("weight").alias("_added"))
    more = {c: F.coalesce(c, F.lit(0.0)) + F.coalesce("_added", F.lit(0.0)) for c in ("profile_self", "profile_total")}
    return files.join(added, "relpath", "left").withColumns(more).drop("_added")


def mapped(symbols: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: frames, and matches of frames with symbols."""
    hits = weights.withColumn("name", short_name(F.col("name"))).join(symbols.select("name"), "name").agg(F.count(F.lit(1)).alias("mapped"))
    return weights.agg(F.count(F.lit(1)).alias("frames")).crossJoin(hits)  # one row each
