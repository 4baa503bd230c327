"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._spark import materialize, word_array
from quarry.llm.quality_rules import STOP_WORDS

#: Bound of the labelled sample that the document classifier is fitted on.
SAMPLE = 20_000
BINS = 12
#: Evidence of one feature is held within this many nats: no single feature decides.
LIMIT = 4.0
#: Bounds of the fitted strengths: pseudo-documents by which a host leans on the whole, and a path on its host.
STRENGTHS = (2.0, 1000.0)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds f0..f6, ratios over the whole text; 0 for null and blank texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    stop = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    out = docs.withColumn("_w", word_array(F.col(text))).withColumn("_n", F.greatest(F.size("_w"), F.lit(1)).cast("double"))
    chars = F.greatest(F.char_length(t), F.lit(1)).cast("double")
    pairs = F.expr("CASE WHEN size(_w) < 3 THEN 0 ELSE size(array_distinct(zip_with(slice(_w, 1, size(_w) - 1), slice(_w, 2, size(_w) - 1), (a, b) -> xxhash64(a, b)))) END")
    return out.withColumns(
        {
            "f0": F.log(F.col("_n")),
            "f1": F.regexp_count(t, F.lit("[#*$%&|<>]")) / F.col("_n"),
            "f2": F.regexp_count(t, F.lit("\\p{Lu}")) / chars,
            "f3": F.regexp_count(t, F.lit("[!?]")) / F.col("_n"),
            "f4": F.size(F.array_distinct("_w")) / F.col("_n"),
            "f5": F.size(F.filter("_w", lambda w: w.isin(stop))) / F.col("_n"),
            "f6": pairs / F.col("_n"),
        }
    ).drop("_w", "_n")


NAMES = tuple(f"f{i}" for i in range(7))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, sample: int = SAMPLE, limit: float = LIMIT) -> tuple[float, list[tuple[list[float], list[float]]]]:
    """Log prior odds, and for each feature its bin edges and the log likelihood ratio of each bin.

    A label over 0 is good, any other bad; a null one, or one of a null id, teaches nothing, and of several for an
    id the largest counts. Bins are quantiles of at most ``sample`` labelled rows, taken by hash; ratios are
    Laplace-smoothed and held within ``limit`` nats. The sample is drawn from the label table first, so texts don't
    move: at most ``sample`` ids and labels are broadcast, and only the sample's features reach the driver.
    """
    known = labels.select(F.col(id_col).alias("_id"), (F.col(label) > 0).cast("int").alias("y")).filter("_id is not null and y is not null").groupBy("_id").agg(F.max("y").alias("y"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id")
    rows = features(rows, "_text").select(*NAMES, "y", F.xxhash64("_id", "_text").alias("_h"))
    got = rows.orderBy("_h").limit(sample).collect()  # ids that repeat in the table give more rows than the sample has
    good = sum(r["y"] for r in got)
    bad = len(got) - good
    prior = math.log((good + 1) / (bad + 1))
    tables = []
    for name in NAMES:
        values = sorted(r[name] for r in got)
        edges = sorted({values[len(values) * k // BINS] for k in range(1, BINS)}) if values else []
        hits = [[0, 0] for _ in range(len(edges) + 1)]
        for r in got:
            hits[sum(r[name] >= e for e in edges)][r["y"]] += 1
        k = len(hits)
        ratios = [math.log((g + 1) / (good + k)) - math.log((b + 1) / (bad + k)) for b, g in hits]
        tables.append((edges, [max(-limit, min(limit, x)) for x in ratios]))
    return prior, tables


def evidence(tables: list[tuple[list[float], list[float]]]) -> Column:
    """The summed log likelihood ratios as one expression."""
    total = F.lit(0.0)
    for name, (edges, ratios) in zip(NAMES, tables, strict=True):
        term = F.lit(float(ratios[0]))
        for edge, ratio in zip(edges, ratios[1:], strict=True):
            term = F.when(F.col(name) >= edge, F.lit(float(ratio))).otherwise(term)
        total = total + term
    return total


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strengths(paths: DataFrame, bounds: tuple[float, float]) -> tuple[float, float, float]:
    """The global mean, and the strengths of hosts and of paths within hosts, from an analysis of variance.

    Strength is the variance inside a path over that between sites, beyond what sampling explains: sites that
    differ keep their own rates, sites that don't lean on their parent. Only one row of sums reaches the driver.
    """
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("k"), F.sum(F.col("s") ** 2 / F.col("n")).alias("ss"), F.sum(F.col("n") ** 2).alias("nn"))
    sums = {"n": F.sum("n"), "s": F.sum("s"), "q": F.sum("q"), "p": F.sum("k"), "h": F.count(F.lit(1)), "paths": F.sum("ss"), "hosts": F.sum(F.col("s") ** 2 / F.col("n")), "hn": F.sum(F.col("n") ** 2), "pn": F.sum(F.col("nn") / F.col("n"))}
    m = hosts.agg(*[c.alias(k) for k, c in sums.items()]).first()
    if not m["n"]:
        return 0.5, bounds[1], bounds[1]
    inside = max(0.0, m["q"] - m["paths"]) / max(1, m["n"] - m["p"])

    def strength(between: float, groups: float, rows: float) -> float:
        spread = (between - groups * inside) / rows if rows > 0 else 0.0
        return min(bounds[1], max(bounds[0], inside / spread)) if spread > 0 else bounds[1]

    host = strength(m["hosts"] - m["s"] ** 2 / m["n"], m["h"] - 1, m["n"] - m["hn"] / m["n"])
    return m["s"] / m["n"], host, strength(m["paths"] - m["hosts"], m["p"] - m["h"], m["n"] - m["pn"])


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.5, sample: int = SAMPLE, limit: float = LIMIT, strengths: tuple[float, float] = STRENGTHS) -> DataFrame:
    """id, host, path, evidence (nats), host_rate, path_rate, quality (posterior), kept for every row.

    A site's rate for a document is the mean posterior of its other documents under the global prior, shrunk: hosts
    to the global rate, paths to their host, both by strengths fitted from the variance between sites and held
    within ``strengths``. The document's own evidence, which is left out of its sites, then meets the logit of its
    path's rate. Null hosts and paths are sites of their own; null and empty texts have the evidence of empty
    texts; very long texts are read whole; without labels all evidence is 0. Repeated rows count each time, as
    documents of their site; other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    prior, tables = fit(docs, labels, id_col, text, label, sample, limit)
    scored = features(docs.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(text).alias("text")))
    scored = materialize(scored.select("id", "host", "path", evidence(tables).alias("evidence")), "evidence")
    p = _logistic(F.col("evidence") + prior)
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q"))
    paths = materialize(paths, "paths")
    overall, host_strength, path_strength = _strengths(paths, strengths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("_hn"), F.sum("s").alias("_hs")).withColumnRenamed("host", "_host")
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).select("_host", F.col("path").alias("_path"), "n", "s", "_hn", "_hs")
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    host_rate = (F.col("_hs") - p + host_strength * overall) / (F.col("_hn") - 1 + host_strength)
    path_rate = (F.col("s") - p + path_strength * F.col("host_rate")) / (F.col("n") - 1 + path_strength)
    rated = joined.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    rate = F.least(F.greatest(F.col("path_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    out = rated.withColumn("quality", _logistic(F.col("evidence") + F.log(rate / (1 - rate))))
    return out.select(F.col("id").alias(id_col), "host", "path", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= threshold).alias("kept"))
