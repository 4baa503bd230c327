"""Call and import graphs: resolution, fan-in and fan-out, PageRank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import is_generic
from quarry.sources.shared import materialize

#: Edges up to which PageRank runs in one task over arrays (some 100 MB); beyond, rounds are joins.
ONE_TASK_EDGES = 2_000_000


def attach_calls(symbols: DataFrame, owner_calls: DataFrame) -> DataFrame:
    """call_facts from the parser's (relpath, owner, callee): calls belong to every symbol of that name in the file."""
    keys = symbols.select("relpath", "ord", F.col("name").alias("owner"))
    return owner_calls.join(keys, ["relpath", "owner"]).select("relpath", "ord", "callee")


def resolve_calls(call_facts: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Call edges. A callee resolves to the one symbol of its name in the caller's file; with none there, to
    the one in the caller's language, or anywhere if the language has none. Two candidates, or a generic name
    outside the file, leave it unresolved (dst null).

    Candidates are counted per (name, file), (name, language) and name before the join, so that a popular
    name never multiplies the calls; the three lookups have one row a key.
    """
    named = symbols.join(files.select("relpath", "language"), "relpath").select("name", "relpath", "ord", "language")
    target = F.min(F.struct("relpath", "ord"))
    own = named.groupBy("name", "relpath").agg(F.count(F.lit(1)).alias("own_n"), F.min("ord").alias("own_ord"))
    near = named.groupBy("name", "language").agg(F.count(F.lit(1)).alias("near_n"), target.alias("near_at"))
    wide = named.groupBy("name").agg(F.count(F.lit(1)).alias("wide_n"), target.alias("wide_at"))
    calls = call_facts.join(files.select("relpath", "language"), "relpath").withColumnRenamed("callee", "name")
    found = calls.join(own, ["name", "relpath"], "left").join(near, ["name", "language"], "left").join(wide, "name", "left")
    at = (
        F.when(F.col("own_n") == 1, F.struct("relpath", F.col("own_ord").alias("ord")))
        .when((F.col("own_n") > 1) | is_generic(F.col("name")), None)
        .when(F.col("near_n") == 1, F.col("near_at"))
        .when((F.col("near_n") > 1) | (F.col("wide_n") > 1), None)
        .otherwise(F.col("wide_at"))
    )
    return found.select(F.col("relpath").alias("src_relpath"), F.col("ord").alias("src_ord"), at.alias("at"), F.col("name").alias("dst_name")).select(
        "src_relpath", "src_ord", F.col("at.relpath").alias("dst_relpath"), F.col("at.ord").alias("dst_ord"), "dst_name", F.lit("call").alias("kind")
    )


def import_stem(hint: F.Column) -> F.Column:
    """The last path part of a module hint up to its first dot, quotes trimmed."""
    clean = F.regexp_replace(F.replace(hint, F.lit("\\"), F.lit("/")), "^[\"']+|[\"']+$", "")
    return F.get(F.split(F.element_at(F.split(clean, "/"), -1), "\\."), F.lit(0))


def resolve_imports(import_facts: DataFrame, files: DataFrame) -> DataFrame:
    """Import edges to every file named like the hint's stem: below a folder .py, .ts or .rs, at the root .py."""
    stems = import_facts.select(F.col("relpath").alias("src_relpath"), import_stem(F.col("module_hint")).alias("dst_name")).filter("dst_name <> ''")
    named = files.select(F.col("relpath").alias("dst_relpath"), F.regexp_extract("relpath", r"(?:^|/)([^/.]+)\.(?:py|ts|rs)$", 1).alias("dst_name"))
    named = named.filter((F.col("dst_name") != "") & (F.col("dst_relpath").contains("/") | F.col("dst_relpath").endswith(".py")))
    none = F.lit(None).cast("int")
    return stems.join(named, "dst_name").select("src_relpath", none.alias("src_ord"), "dst_relpath", none.alias("dst_ord"), "dst_name", F.lit("import").alias("kind"))


def with_fans(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols with fan_out (all calls) and fan_in (calls resolved to them), 0 without."""
    calls = edges.filter("kind = 'call'")
    out = calls.filter("src_ord is not null").groupBy(F.col("src_relpath").alias("relpath"), F.col("src_ord").alias("ord")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = calls.filter("dst_ord is not null").groupBy(F.col("dst_relpath").alias("relpath"), F.col("dst_ord").alias("ord")).agg(F.count(F.lit(1)).alias("fan_in"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("fan_in", "fan_out")}
    return symbols.drop("fan_in", "fan_out").join(out, ["relpath", "ord"], "left").join(into, ["relpath", "ord"], "left").withColumns(zero)


def file_graph(edges: DataFrame) -> DataFrame:
    """src, dst, n: resolved edges of any kind between different files, counted."""
    known = edges.filter("dst_relpath is not null and src_relpath <> dst_relpath")
    return known.groupBy(F.col("src_relpath").alias("src"), F.col("dst_relpath").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def _pagerank_arrays(damping: float, rounds: int):
    def run(table: pa.Table) -> pa.Table:
        ids, src, dst, n, base = (table.column(c).to_numpy() for c in ("id", "src", "dst", "n", "base"))
        node = np.isnan(n)
        names, start = ids[node], base[node].astype(float)
        order = np.argsort(names)
        names, start = names[order], start[order]
        s, d, w = np.searchsorted(names, src[~node]), np.searchsorted(names, dst[~node]), n[~node]
        w = w / np.maximum(np.bincount(s, w, len(names)), 1)[s]
        score = start.copy()
        for _ in range(rounds):
            score = (1 - damping) * start + damping * np.bincount(d, score[s] * w, len(names))
        return pa.table({"id": names, "pagerank": score})

    return run


def pagerank(nodes: DataFrame, edges: DataFrame, personalize: DataFrame | None = None, rounds: int = 40, damping: float = 0.85) -> DataFrame:
    """relpath, pagerank of all nodes (relpath) after a fixed number of rounds over edges (src, dst, n).

    Repeated edges weigh more; rank at nodes without outgoing edges is lost; personalize (relpath, weight) sets the
    base to weight / max(sum, 1), 1 / n for all without it. Edges to other nodes don't count.
    """
    nodes = nodes.select("relpath").distinct()
    total = nodes.count()
    known = edges.join(nodes.withColumnRenamed("relpath", "src"), "src", "left_semi").join(nodes.withColumnRenamed("relpath", "dst"), "dst", "left_semi")
    if personalize is None or not personalize.limit(1).count():
        based = nodes.withColumn("base", F.lit(1.0 / max(total, 1)))
    else:
        wanted = nodes.join(personalize.groupBy("relpath").agg(F.sum("weight").alias("weight")), "relpath", "left")
        sum_ = wanted.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("s")).first()["s"]
        based = wanted.select("relpath", (F.coalesce("weight", F.lit(0.0)) / max(1.0, sum_)).alias("base"))
    if total <= ONE_TASK_EDGES and known.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES:
        ident = lambda c: F.xxhash64(c)
        rows = based.select(ident("relpath").alias("id"), F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(float("nan")).alias("n"), "base")
        rows = rows.unionByName(known.select(F.lit(0).cast("long").alias("id"), ident("src").alias("src"), ident("dst").alias("dst"), F.col("n").cast("double").alias("n"), F.lit(0.0).alias("base")))
        scored = rows.groupBy(F.lit(0).alias("all")).applyInArrow(_pagerank_arrays(damping, rounds), "id long, pagerank double")
        return nodes.withColumn("id", ident("relpath")).join(scored, "id").select("relpath", "pagerank")
    out = known.groupBy("src").agg(F.sum("n").alias("degree"))
    weights = materialize(known.join(out, "src").select("src", "dst", (F.col("n") / F.col("degree")).alias("w")), "weights")
    based = materialize(based, "base")
    score = based.select("relpath", F.col("base").alias("pagerank"))
    for k in range(rounds):
        into = weights.join(score.withColumnRenamed("relpath", "src"), "src").groupBy(F.col("dst").alias("relpath")).agg(F.sum(F.col("pagerank") * F.col("w")).alias("in"))
        score = based.join(into, "relpath", "left").select("relpath", ((1 - damping) * F.col("base") + damping * F.coalesce("in", F.lit(0.0))).alias("pagerank"))
        if k % 5 == 4:
            score = materialize(score, "rank")
    return score
