"""Rollups over files and symbols: inventory, languages, per-file complexity, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import is_test, language


def with_file_metrics(raw: DataFrame, content: str = "content") -> DataFrame:
    """relpath and content (string or binary) become language, digest, loc, size, is_test, tokens.

    loc counts lines that aren't blank; tokens counts words after '/' and '.' are made spaces.
    """
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    loc = F.size(F.filter(F.split(text, "\r?\n"), lambda x: x.rlike(r"(?U)\S")))
    words = F.regexp_count(F.translate(text, "/.", "  "), F.lit(r"(?U)\S+"))
    return raw.select(
        "relpath",
        language(F.col("relpath")).alias("language"),
        F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary")), 256).alias("digest"),
        loc.cast("long").alias("loc"),
        F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("size"),
        is_test(F.col("relpath")).alias("is_test"),
        words.cast("long").alias("tokens"),
    )


def languages(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))


def inventory(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: files and lines of product and tests, their ratio, tokens, public symbols."""
    some = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    test = F.col("is_test")
    per_file = files.agg(F.count_if(~test).alias("prod_files"), F.count_if(test).alias("test_files"), some(~test, "loc").alias("prod_loc"), some(test, "loc").alias("test_loc"), some(~test, "tokens").alias("tokens"))
    public = symbols.agg(F.count_if(F.col("is_public") & ~F.col("is_test")).alias("public_symbols"))
    ratio = F.round(F.col("test_loc") / F.when(F.col("prod_loc") == 0, 1).otherwise(F.col("prod_loc")), 3)
    return per_file.crossJoin(public).withColumn("test_to_code", ratio)  # one row each


def entry_points(files: DataFrame, symbols: DataFrame) -> DataFrame:
    product = files.filter(~F.col("is_test")).select("relpath")
    return symbols.filter("is_entry").join(product, "relpath", "left_semi").select("name", "signature", "relpath", "start_line").orderBy("relpath", "start_line", "name")


def complexity_by_file(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("relpath").agg(F.sum("cognitive").alias("cognitive"), F.sum("cyclomatic").alias("cyclomatic"), F.count(F.lit(1)).alias("symbols"))


def files_with_complexity(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every file with its sums, 0 without symbols; symbols are summed before the join."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("cognitive", "cyclomatic", "symbols")}
    return files.join(complexity_by_file(symbols), "relpath", "left").withColumns(zero)


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def name_occurrences(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """name, n of each table, counted in one job."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def search_rows(rows: DataFrame, text: str = "", language: str = "", product: bool | None = None) -> DataFrame:
    """Rows of a table that hold the text in any column, in a language, of product or of test files."""
    out = rows
    if text:
        everything = F.lower(F.concat_ws(" ", *[F.col(f.name).cast("string") for f in rows.schema]))
        out = out.filter(everything.contains(text.lower()))
    if language:
        out = out.filter(F.col("language") == language)
    if product is not None:
        out = out.filter(~F.col("is_test") if product else F.col("is_test"))
    return out


def page(rows: DataFrame, by: list, number: int = 0, size: int = 200) -> DataFrame:
    """One page of a sorted table."""
    return rows.orderBy(*by).offset(number * size).limit(size)
