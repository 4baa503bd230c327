"""Structural issues: god functions and modules, effects in the core, shotgun surgery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.paths import basename, far_apart, is_boundary, is_docs, is_noise_partner, is_outside_core
from quarry.operators.metrics import complexity_by_file

_IO = ("filesystem", "network", "db", "process")


def god_score(cognitive: Column, fan_out: Column, loc: Column) -> Column:
    """cognitive (1 + fan_out / 5) (1 + ln loc / ln 80): complexity leads and length is damped."""
    return cognitive * (1.0 + fan_out / 5.0) * (1.0 + F.log(F.greatest(loc, F.lit(1))) / F.log(F.lit(80.0)))


def _product(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("is_test")).select("relpath")


def _row(rows: DataFrame, kind: str, detail: Column, score: Column, ord_: Column) -> DataFrame:
    return rows.select("relpath", ord_.cast("int").alias("ord"), F.lit(kind).alias("kind"), detail.alias("detail"), score.cast("double").alias("score"))


def god_functions(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Product functions outside docs of cognitive complexity 15 or a score of 40."""
    loc = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))
    rows = symbols.filter(~F.col("is_test")).join(_product(files), "relpath", "left_semi").withColumns({"loc": loc, "god": god_score(F.col("cognitive"), F.col("fan_out"), loc)})
    rows = rows.filter(((F.col("cognitive") >= 15) | (F.col("god") >= 40)) & ~is_docs(F.col("relpath")))
    return _row(rows, "god_function", F.format_string("god function cognitive=%d fan_out=%d loc=%d", "cognitive", "fan_out", "loc"), F.col("god"), F.col("ord"))


def effects_in_core(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Product functions with I/O effects and two callers or more, away from boundaries, UI, tools and docs."""
    io = F.filter("effects", lambda t: t.isin(*_IO))
    path = F.col("relpath")
    rows = symbols.filter(~F.col("is_test") & (F.col("fan_in") >= 2) & (F.size(io) > 0) & ~is_boundary(path) & ~is_outside_core(path)).join(_product(files), "relpath", "left_semi")
    quoted = F.concat(F.lit('["'), F.array_join(io, '", "'), F.lit('"]'))
    return _row(rows, "effect_in_core", F.format_string("I/O %s mixed into core (fan_in=%d)", quoted, "fan_in"), F.col("fan_in"), F.col("ord"))


def god_modules(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Product files outside docs of cognitive complexity 40 in all, or 20 symbols."""
    rows = _product(files).join(complexity_by_file(symbols), "relpath").filter(((F.col("cognitive") >= 40) | (F.col("symbols") >= 20)) & ~is_docs(F.col("relpath")))
    return _row(rows, "god_module", F.format_string("god module symbols=%d cognitive=%d", "symbols", "cognitive"), F.col("cognitive"), F.lit(None))


def shotgun_surgery(coupling: DataFrame, files: DataFrame) -> DataFrame:
    """Files of different top folders that change together; at the first that is indexed, else the second, else nowhere."""
    pairs = coupling.filter((F.col("strength") >= 0.4) & far_apart(F.col("file_a"), F.col("file_b")) & ~is_noise_partner(F.col("file_a")) & ~is_noise_partner(F.col("file_b")))
    at = lambda c: files.select(F.col("relpath").alias(c), F.col("relpath").alias(f"{c}_at"))
    rows = pairs.join(at("file_a"), "file_a", "left").join(at("file_b"), "file_b", "left").withColumn("relpath", F.coalesce("file_a_at", "file_b_at")).filter("relpath is not null")
    return _row(rows, "shotgun_surgery", F.format_string("%s <-> %s shared=%d", "file_a", "file_b", "shared"), F.col("strength"), F.lit(None))


def find_issues(symbols: DataFrame, files: DataFrame, coupling: DataFrame) -> DataFrame:
    return god_functions(symbols, files).unionByName(effects_in_core(symbols, files)).unionByName(god_modules(symbols, files)).unionByName(shotgun_surgery(coupling, files))


def list_issues(issues: DataFrame, symbols: DataFrame, limit: int = 40) -> DataFrame:
    """Issues with names and lines: the best ``limit`` of each kind, kinds in order of their best score.

    0 gives none, a negative limit all. Issues of whole files are named after the file and placed at its
    first symbol, or line 1; a missing path is recovered from a shotgun detail.
    """
    if limit == 0:
        return list_issues(issues, symbols, -1).limit(0)
    path = F.coalesce("relpath", F.when(F.col("kind") == "shotgun_surgery", F.substring_index("detail", " <-> ", 1)))
    own = symbols.select("relpath", "ord", "name", "start_line")
    first = symbols.groupBy("relpath").agg(F.min("start_line").alias("first_line"))
    rows = issues.withColumn("relpath", path).join(own, ["relpath", "ord"], "left").join(first, "relpath", "left")
    rows = rows.withColumns({"start_line": F.coalesce("start_line", "first_line", F.lit(1)), "name": F.coalesce("name", basename(F.col("relpath")))}).drop("first_line")
    rank = W.partitionBy("kind").orderBy(F.desc("score"), "relpath", "ord", "detail")
    best = issues.groupBy("kind").agg(F.max("score").alias("_best"))
    ranked = rows.withColumn("_n", F.row_number().over(rank))  # a limit keeps few a kind; Spark prunes each partition to it
    kept = ranked if limit < 0 else ranked.filter(F.col("_n") <= limit)
    order = ["kind", "_n"] if limit >= 0 else []
    out = kept.join(F.broadcast(best), "kind")  # one row for each of the few kinds
    out = out.orderBy(F.desc("_best"), *order) if limit >= 0 else out.orderBy(F.desc("score"), "relpath", "ord", "detail")
    return out.select("kind", "detail", "score", "relpath", "name", "start_line")
