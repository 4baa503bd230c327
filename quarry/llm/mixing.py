"""Mixing sources to target weights by Poisson replication and a global shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import let
from quarry.llm._spark import Renamed, materialize

SEED = "mix-1"
#: The largest mean of one draw; exp(-mean) must stay a normal double. Larger rates are drawn in parts.
MAX_RATE = 64.0
#: Sources whose rates are broadcast, at most; one has 1.5 kB at most.
BROADCAST_SOURCES = 4096


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of the parts joined by ':', null parts as empty."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def target_rates(docs: DataFrame, weights: dict[str, float] | None, size: float, source: str) -> DataFrame:
    """Mean repetitions per source: share of the target rows over rows there are, from one grouped count.

    Sources without a weight, and the null source, weigh 1; weights None weighs all sources alike,
    tempered: the square root of their rows. Returns source, n, rate.
    """
    counts = docs.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.sqrt("n")
    else:
        weight = F.lit(1.0)
        for name, value in weights.items():
            weight = F.when(F.col(source) == name, F.lit(float(value))).otherwise(weight)
    weighed = counts.withColumn("_weight", weight)
    total = weighed.agg(F.sum("_weight").alias("_all"), F.sum("n").alias("_rows"))
    rate = F.col("_weight") / F.col("_all") * F.col("_rows") * float(size) / F.col("n")
    return weighed.crossJoin(F.broadcast(total)).select(source, "n", rate.alias("rate"))  # total is one row


def _with_rates(docs: DataFrame, rates: DataFrame, source: str) -> DataFrame:
    """Every row with its source's rates; rows are shuffled only if there are more sources than may be broadcast.

    Beyond that bound, the sources that hold a thousandth of the rows or more (so a thousand at most) are still
    broadcast, and the rows of all others, no group of which is large, meet their rates by a shuffle.
    """
    same = lambda side: docs[source].eqNullSafe(side["_source"])
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        small = F.broadcast(rates)
        return docs.join(small, same(small), "inner").drop("_source", "_rows")
    total = rates.agg(F.sum("_rows")).first()[0]
    large = F.col("_rows") * 1000 >= total
    hot, rest = F.broadcast(rates.filter(large)), rates.filter(~large)
    split = docs.join(hot, same(hot), "inner").unionByName(docs.join(hot, same(hot), "left_anti").join(rest, same(rest), "inner"))
    return split.drop("_source", "_rows")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: str = SEED, source: str = "source", id_col: str = "doc_id", tell: bool = False, text: str = "text") -> DataFrame:
    """Rows repeated so that sources reach their target shares in expectation, in a global random order.

    Each row draws its count by inverting the Poisson distribution of its source's rate at a number
    hashed from seed, id and text: the same on every run and retry. A rate over MAX_RATE is the sum of
    independent draws of equal parts, whose numbers are hashed from the first, so no rate is cut. Rows of count 0
    leave. Equal rows draw alike; null ids, texts and sources are values; texts of any length are hashed whole; a
    table without a text column draws by id. Output partitions are random by hash, and each is sorted by the hash.
    An empty table gives an empty one. Columns of any name pass unchanged. With tell, copy (int, from 0), n_copies
    and mix_key are added, in place of columns of these names; the input columns alone return otherwise.

    The rates, one row a source, are written to the shared folder and counted before they are broadcast.
    """
    own = Renamed(docs)
    c_source, c_id = own.name(source), own.name(id_col)
    rates = target_rates(own.df, weights, size, c_source).select(F.col(c_source).alias("_source"), F.col("n").alias("_rows"), F.col("rate").alias("_rate"))
    rates = rates.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / MAX_RATE)).cast("int")).withColumn("_rate", F.col("_rate") / F.col("_parts"))
    # P(X <= k) for k = 0.. until it rounds to 1, once per source and not per row
    steps = int(MAX_RATE + 12 * math.sqrt(MAX_RATE) + 20)
    cdf = F.expr(
        f"""aggregate(sequence(1, {steps}), named_struct('t', exp(-_rate), 'c', array(exp(-_rate))),
            (a, k) -> named_struct('t', a.t * _rate / k, 'c', concat(a.c, array(element_at(a.c, -1) + a.t * _rate / k))), a -> a.c)"""
    )
    rates = materialize(rates.withColumn("_cdf", F.filter(cdf, lambda c: c < 1.0 - 1e-15)).drop("_rate"), "rates")
    body = F.md5(F.coalesce(F.col(own.name(text)), F.lit(""))) if own.has(text) else F.lit("")
    unit = hash_unit(F.lit(seed), F.col(c_id), body)

    def count(u: Column) -> Column:
        return F.size(F.filter("_cdf", lambda c: c <= u))

    def summed(u: Column) -> Column:
        first = (u * float(1 << 52)).cast("long")
        others = F.transform(F.sequence(F.lit(2), F.col("_parts")), lambda k: hash_unit(F.lit(seed), first, k))
        return F.aggregate(others, count(u), lambda n, v: n + count(v))

    draws = F.when(F.col("_parts") == 1, count(F.col("_u"))).otherwise(let(F.col("_u"), summed))
    drawn = _with_rates(own.df, rates, c_source).withColumn("_u", unit).withColumn("_n", draws).drop("_cdf", "_parts")
    copies = drawn.filter("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    copies = copies.withColumn("_key", F.xxhash64(F.lit(seed), "_u", "_copy"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = copies.repartition(parts, "_key").sortWithinPartitions("_key")
    if tell:
        return mixed.select(*own.restored(("copy", "n_copies", "mix_key")), F.col("_copy").alias("copy"), F.col("_n").alias("n_copies"), F.col("_key").alias("mix_key"))
    return mixed.select(*own.restored())
