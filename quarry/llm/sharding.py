"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm._spark import Renamed, row_hashes

PARTITIONS = 64
#: Rows that one task ranks: there are more logical partitions where those would be larger, and a larger shard is
#: ranked in hash ranges of about so many.
RANK_ROWS = 200_000


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good items among ``sample`` drawn without replacement; exact inversion, no bound on the counts.

    The mass beyond 64 and 12 deviations from the mode is far below the rounding of a double.
    """
    lo, hi = max(0, sample - bad), min(good, sample)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(hi, max(lo, (sample + 1) * (good + 1) // (total + 2)))
    p = good / total
    spread = 64 + int(12 * math.sqrt(max(1.0, sample * p * (1 - p) * (total - sample) / max(1, total - 1))))
    a, b = max(lo, mode - spread), min(hi, mode + spread)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.exp(logs - logs.max())
    return a + int(np.searchsorted(np.cumsum(mass), rng.random() * mass.sum(), "right").clip(0, b - a))


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that go from each partition to each shard: row sums are given, column sums differ by one at most.

    Which shards get the odd rows is drawn too. Each partition draws from what the shards still lack.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    n = sum(rows)
    lack = np.full(shards, n // shards, dtype=np.int64)
    lack[rng.permutation(shards)[: n % shards]] += 1
    out = np.zeros((len(rows), shards), np.int64)
    for i, count in enumerate(rows):
        need, rest = count, int(lack.sum())
        for s in range(shards):
            rest -= int(lack[s])
            out[i, s] = draw_hypergeometric(rng, int(lack[s]), rest, need)
            need -= out[i, s]
        lack -= out[i]
    return out


def _numbered(group: str, *order: str) -> Column:
    return F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("long") - 1


def _permuted(df: DataFrame, seed: int) -> DataFrame:
    """Adds _rank: a random permutation of the rows (_id) of each logical partition."""
    return df.withColumn("_local", F.xxhash64(F.lit(f"{seed}:local"), "_part", "_id")).withColumn("_rank", _numbered("_part", "_local", "_id")).drop("_local")


def _slots(dealt: DataFrame, bits: int) -> DataFrame:
    """Adds slot, gapless from 0 in each shard in the order of _final, ranking ranges of it one by one."""
    tie = ("_final", "_part", "_rank")
    if not bits:
        return dealt.withColumn("slot", _numbered("_shard", *tie))
    # the sign bit is flipped so that ranges follow the signed order of the key
    binned = dealt.withColumn("_bin", F.shiftrightunsigned(F.col("_final").bitwiseXOR(F.lit(-(2**63))), 64 - bits))
    before = W.partitionBy("_shard").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)  # 2**bits rows a shard
    counts = binned.groupBy("_shard", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_shard", "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(W.partitionBy("_shard", "_bin").orderBy(*tie)).cast("long") - 1
    return binned.withColumn("slot", inner).join(starts, ["_shard", "_bin"]).withColumn("slot", F.col("slot") + F.col("_before"))


def shard(docs: DataFrame, shards: int = 16, seed: int = 7, partitions: int = PARTITIONS) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in each shard) to every row: law ``rows``.

    Rows fall into logical partitions by a seeded hash of all their columns, each partition deals its locally
    permuted rows to the shards as the drawn matrix says, and each shard permutes what it received. Every
    assignment with these sizes is equally likely. It depends on the rows alone, not on files, partitions or
    retries: wholly equal rows are numbered among themselves, and as they are alike it doesn't matter which has
    which number. Null ids and texts count as values, texts may have any length, an empty table gives an empty one.
    Columns named shard or slot are replaced, all others pass unchanged, whatever their names.

    A row repeated more than RANK_ROWS times would crowd one partition: such rows are counted, and made again from
    one of them in logical partitions of their own. The input is read several times and must be a stored table or
    the like. Counts of logical partitions (a row for each RANK_ROWS rows of input) reach the driver.
    """
    spark, own = docs.sparkSession, Renamed(docs)
    first, second = row_hashes(own.df)
    total = own.df.count()
    usual = max(partitions, math.ceil(total / RANK_ROWS))
    keyed = own.df.withColumns({"_h": first, "_g": second}).withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), "_h"), F.lit(usual)).cast("int"))
    counts = {r["_part"]: r["count"] for r in keyed.groupBy("_part").count().collect()}
    rows = [counts.get(i, 0) for i in range(usual)]
    crowded = [i for i, n in enumerate(rows) if n > 2 * RANK_ROWS]
    hot = []
    if crowded:  # at most a row for each RANK_ROWS rows of input
        repeats = keyed.filter(F.get(F.lit([i in set(crowded) for i in range(usual)]), F.col("_part"))).groupBy("_h", "_g", "_part").agg(F.count(F.lit(1)).alias("n"))
        hot = sorted(map(tuple, repeats.filter(F.col("n") > RANK_ROWS).collect()))
    made = []
    for h, g, part, n in hot:
        rows[part] -= n
        sizes = [RANK_ROWS] * (n // RANK_ROWS) + ([n % RANK_ROWS] if n % RANK_ROWS else [])
        made.append({"_h": h, "_g": g, "_parts": [{"_part": len(rows) + i, "_n": k} for i, k in enumerate(sizes)]})
        rows += sizes
    bounds = [[int(x) for x in np.cumsum(r)] for r in communication_matrix(rows, shards, seed)]

    rest = keyed
    if made:
        kinds = "array<struct<_h: bigint, _g: bigint, _parts: array<struct<_part: int, _n: bigint>>>>"
        listed = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(made)), kinds))))
        rest = keyed.join(listed, ["_h", "_g"], "left_anti")
    dealt = _permuted(rest.withColumn("_id", _numbered("_part", "_h", "_g")), seed).drop("_h", "_g", "_id")
    if made:
        one = keyed.join(listed, ["_h", "_g"]).groupBy("_h", "_g").agg(F.first("_parts").alias("_parts"), *[F.first(c).alias(c) for c in own.df.columns])  # all alike
        parts = one.select(*own.df.columns, F.inline("_parts")).repartition("_part")
        copies = parts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_id"), "_part", *own.df.columns)
        dealt = dealt.unionByName(_permuted(copies, seed).drop("_id"))
    ends = F.from_json(F.lit(json.dumps(bounds)), "array<array<bigint>>")
    dealt = dealt.withColumn("_shard", F.size(F.filter(F.get(ends, F.col("_part")), lambda e: e <= F.col("_rank"))).cast("int"))
    dealt = dealt.withColumn("_final", F.xxhash64(F.lit(f"{seed}:final"), "_part", "_rank"))
    bits = max(0, math.ceil(math.log2(max(1, math.ceil(total / shards)) / RANK_ROWS)))
    placed = _slots(dealt, bits)
    return placed.select(*own.restored(("shard", "slot")), F.col("_shard").alias("shard"), "slot")
