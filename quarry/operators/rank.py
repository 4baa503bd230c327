"""Ranks: personalised PageRank of files, hotspots, reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.names import is_generic
from quarry.operators.graph import file_graph, pagerank
from quarry.operators.metrics import files_with_complexity


def compute_rank(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Files with pagerank, hotspot and their complexity. Each entry symbol adds 5 to its file's base weight.

    hotspot = (1 + churn) (1 + cognitive / 10), times 1 + profile_total where there is one.
    """
    weights = symbols.filter("is_entry").groupBy("relpath").agg((5.0 * F.count(F.lit(1))).alias("weight"))
    scores = pagerank(files, file_graph(edges), weights)
    base = files_with_complexity(files.drop("pagerank", "hotspot"), symbols).join(scores, "relpath", "left")
    plain = (1.0 + F.coalesce("churn", F.lit(0))) * (1.0 + F.col("cognitive") / 10.0)
    profile = F.coalesce("profile_total", F.lit(0.0))
    return base.withColumns({"pagerank": F.coalesce("pagerank", F.lit(0.0)), "hotspot": F.when(profile != 0, plain * (1.0 + profile)).otherwise(plain)})


def file_order(ranked: DataFrame) -> DataFrame:
    score = F.col("pagerank") * (1.0 + F.col("cognitive") / 20.0) + F.col("hotspot") * 0.01
    return ranked.orderBy(score.desc(), "relpath")


def why() -> F.Column:
    """Why a symbol is worth reading, in words."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("is_entry"), F.lit("entry point")),
            F.when(F.col("fan_in") > 2, F.concat(F.lit("used by "), F.col("fan_in").cast("string"), F.lit(" callers"))),
            F.when(F.col("cognitive") >= 8, F.concat(F.lit("cognitive complexity "), F.col("cognitive").cast("string"))),
            F.when(F.col("pagerank") > 0.05, F.lit("high graph centrality")),
        )
    )
    return F.when(F.size(reasons) == 0, "ranked by PageRank and complexity").otherwise(F.array_join(reasons, ", "))


def reading_order(symbols: DataFrame, files: DataFrame, limit: int = 15) -> DataFrame:
    """The symbols to read first: position, the symbol's columns, pagerank, why.

    The best max(20 limit, 80) are taken first; of those, generic names that are no entries and repeats of a
    name in a file leave. Ties go by relpath and ord.
    """
    product = files.filter(~F.col("is_test")).select("relpath", "pagerank")
    score = F.col("is_entry").cast("int") * 3.0 + F.col("pagerank") * 10.0 + F.col("cognitive") * 0.2 + F.col("fan_in") * 0.3
    columns = [c for c in ("relpath", "ord", "name", "signature", "kind", "cognitive", "cyclomatic", "fan_in", "fan_out", "start_line", "is_entry", "effects") if c in symbols.columns]
    rows = symbols.filter(~F.col("is_test")).select(*columns).join(product, "relpath").withColumn("score", score)
    top = rows.orderBy(F.desc("score"), "relpath", "ord").limit(max(20 * limit, 80))
    first = W.partitionBy("relpath", "name").orderBy(F.desc("score"), "relpath", "ord")
    kept = top.filter(~is_generic(F.col("name")) | F.col("is_entry")).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    best = kept.orderBy(F.desc("score"), "relpath", "ord").limit(limit)
    place = W.orderBy(F.desc("score"), "relpath", "ord")  # over `limit` rows
    return best.withColumn("position", F.row_number().over(place)).withColumn("why", why()).drop("score").orderBy("position")
