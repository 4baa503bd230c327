"""Behaviour slices: what a symbol reaches, who calls it, which tests and types touch it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import IDENTIFIER, contains_identifier
from quarry.functions.tags import effects
from quarry.sources.shared import materialize

TYPE_KINDS = ("enum", "struct", "trait", "type", "union")
USE_SITES, TESTS = 40, 20


def find_symbols(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols named by 'path::name' or by name alone, in order of path."""
    path, sep, name = query.rpartition("::")
    rows = symbols.filter(F.col("name") == (name if sep else query))
    return (rows.filter(F.col("relpath") == path) if sep else rows).orderBy("relpath", "ord")


def reach(roots: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """relpath, ord, depth: symbols that resolved calls reach from the roots, with the least depth.

    Steps and levels are written to the shared folder, so that each is computed once; a level first drops
    what earlier levels have. Unresolved calls lead nowhere.
    """
    steps = edges.filter("kind = 'call' and src_ord is not null and dst_ord is not null").select(F.col("src_relpath").alias("relpath"), F.col("src_ord").alias("ord"), "dst_relpath", "dst_ord").distinct()
    steps = materialize(steps, "steps")
    level = materialize(roots.select("relpath", "ord").distinct().withColumn("depth", F.lit(0)), "level")
    seen = level
    for d in range(1, depth + 1):
        to = level.join(steps, ["relpath", "ord"]).select(F.col("dst_relpath").alias("relpath"), F.col("dst_ord").alias("ord")).distinct()
        level = materialize(to.join(seen.select("relpath", "ord"), ["relpath", "ord"], "left_anti").withColumn("depth", F.lit(d)), "level")
        seen = seen.unionByName(level)
    return seen


def unresolved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Names that the nodes call without a known target."""
    open_ = edges.filter("kind = 'call' and dst_relpath is null").select(F.col("src_relpath").alias("relpath"), F.col("src_ord").alias("ord"), "dst_name")
    return open_.join(nodes.select("relpath", "ord"), ["relpath", "ord"], "left_semi").select("dst_name").distinct()


def callers(root: DataFrame, edges: DataFrame, symbols: DataFrame, with_open: bool) -> DataFrame:
    """A row for each call of the root's name that resolves to its file or, with_open, to nothing."""
    one = root.select(F.col("relpath").alias("_path"), F.col("name").alias("dst_name")).limit(1)
    hit = F.col("dst_relpath") == F.col("_path")
    calls = edges.filter("kind = 'call' and src_ord is not null").join(F.broadcast(one), "dst_name").filter(hit | F.col("dst_relpath").isNull() if with_open else hit)
    who = calls.select(F.col("src_relpath").alias("relpath"), F.col("src_ord").alias("ord"))
    return who.join(symbols.select("relpath", "ord", "name", "start_line", "is_test"), ["relpath", "ord"])


def tests_of(root: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls from tests, the first 20."""
    return callers(root, edges, symbols, True).filter("is_test").select("name", "relpath", "start_line").orderBy("relpath", "start_line", "name").limit(TESTS)


def type_uses(root: DataFrame, symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first 40 symbols outside the slice whose signature or body names the root type."""
    one = root.filter(F.col("kind").isin(*TYPE_KINDS)).select(F.col("name").alias("_type")).limit(1)
    rest = symbols.join(nodes.select("relpath", "ord"), ["relpath", "ord"], "left_anti").crossJoin(F.broadcast(one))  # at most one row
    used = contains_identifier(F.col("signature"), F.col("_type")) | contains_identifier(F.col("body"), F.col("_type"))
    return rest.filter(used).drop("_type").orderBy("relpath", "ord").limit(USE_SITES)


def parameters(signature: Column) -> Column:
    """Names between the first '(' and the last ')', without types, defaults, self and cls."""
    inside = F.regexp_extract(F.coalesce(signature, F.lit("")), r"(?s)^[^(]*\((.*)\)[^)]*$", 1)
    names = F.transform(F.split(inside, ","), lambda p: F.btrim(F.get(F.split(F.get(F.split(F.btrim(p), ":"), F.lit(0)), "="), F.lit(0))))
    return F.filter(names, lambda n: n.rlike(IDENTIFIER) & ~n.isin("cls", "self"))


def taint(rows: DataFrame, reached: Column) -> DataFrame:
    """sinks (effects of the own body that the slice has), params, and params that may reach a sink."""
    out = rows.withColumns({"sinks": F.array_intersect(effects("body"), reached), "params": parameters(F.col("signature"))})
    may = F.filter("params", lambda p: F.contains(F.col("body"), p))
    return out.withColumn("params_may_reach_sinks", F.when(F.size("sinks") > 0, may).otherwise(F.array().cast("array<string>")))


def rollup(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: files (blast radius), symbols, sorted effects, summed cost."""
    rows = symbols.join(nodes.select("relpath", "ord", "depth"), ["relpath", "ord"])
    tags = F.sort_array(F.array_distinct(F.flatten(F.collect_set("effects"))))  # sets of at most seven tags
    return rows.agg(F.count_distinct("relpath").alias("blast_radius"), F.count(F.lit(1)).alias("symbols"), tags.alias("effects"), F.coalesce(F.sum("cost_hint"), F.lit(0)).alias("cost_hint"))
