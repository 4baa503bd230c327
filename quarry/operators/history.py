"""Change history: churn, ownership, bursts, age, temporal coupling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400
#: Commits of more files than this say nothing about coupling.
WIDEST_COMMIT = 50


def file_history(log: DataFrame) -> DataFrame:
    """path, churn, revisions, authors, bus_factor, bursts, first_ts, last_ts, age_days from log rows.

    A row is one file of one commit. bursts is the most rows on one UTC day; empty authors and times
    of 0 are unknown; age counts whole days from the first change to the last change of any file.
    """
    known = F.when(F.col("ts") != 0, F.col("ts"))
    days = log.filter("ts <> 0").groupBy("path", F.expr(f"ts div {DAY}").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    bursts = days.groupBy("path").agg(F.max("n").alias("bursts"))
    now = log.agg(F.coalesce(F.max(known), F.lit(0)).alias("now"))
    people = F.count_distinct(F.when(F.col("author") != "", F.col("author")))
    per = log.groupBy("path").agg(F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.count(F.lit(1)).alias("revisions"), people.alias("authors"), F.coalesce(F.min(known), F.lit(0)).alias("first_ts"), F.coalesce(F.max(known), F.lit(0)).alias("last_ts"))
    rows = per.join(bursts, "path", "left").crossJoin(F.broadcast(now))  # now is one row
    age = F.when((F.col("first_ts") != 0) & (F.col("now") != 0), F.expr(f"(now - first_ts) div {DAY}")).otherwise(0)
    return rows.withColumns({"bus_factor": F.least("authors", F.lit(9)), "bursts": F.coalesce("bursts", F.lit(0)), "age_days": age}).drop("now")


def with_history(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files with the history of their paths; 0 and '' for those without."""
    seen = file_history(log).withColumnRenamed("path", "relpath").drop("revisions")
    stamp = lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, "").otherwise(F.col(c).cast("string"))
    numbers = ("churn", "authors", "bus_factor", "bursts", "age_days")
    out = files.drop(*numbers, "first_seen", "last_seen").join(seen, "relpath", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in numbers} | {"first_seen": stamp("first_ts"), "last_seen": stamp("last_ts")}).drop("first_ts", "last_ts")


def commit_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count_distinct("commit").alias("commits"))


def coupling(log: DataFrame, revisions: int = 3, shared: int = 2, strength: float = 0.3) -> DataFrame:
    """file_a, file_b, shared, strength of files that change together, shared over the fewer revisions.

    Pairs arise inside commits of 2 to 50 distinct files only, so a commit makes at most 1,225.
    """
    touched = log.select("commit", "path").distinct()
    small = touched.groupBy("commit").agg(F.count(F.lit(1)).alias("n")).filter(f"n between 2 and {WIDEST_COMMIT}").select("commit")
    rows = touched.join(small, "commit", "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.commit") == F.col("b.commit")) & (F.col("a.path") < F.col("b.path")))
    counted = pairs.groupBy(F.col("a.path").alias("file_a"), F.col("b.path").alias("file_b")).agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= shared)
    often = log.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= revisions)
    both = counted.join(often.select(F.col("path").alias("file_a"), F.col("n").alias("na")), "file_a").join(often.select(F.col("path").alias("file_b"), F.col("n").alias("nb")), "file_b")
    return both.select("file_a", "file_b", "shared", (F.col("shared") / F.least("na", "nb")).alias("strength")).filter(F.col("strength") >= strength)


def hot_files(files: DataFrame, limit: int = 20) -> DataFrame:
    return files.select("relpath", "churn", "authors", "bus_factor", "hotspot", "bursts", "age_days").orderBy(F.desc("churn"), "relpath").limit(limit)


def strongest_coupling(pairs: DataFrame, limit: int = 20) -> DataFrame:
    return pairs.orderBy(F.desc("strength"), F.desc("shared"), "file_a", "file_b").limit(limit)
