"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm._spark import Renamed, materialize, small_side, word_array

SHINGLE = 5
CONTAINMENT = 0.8


def _window(words: str, i: str, size: int) -> list[Column]:
    return [F.get(F.col(words), F.col(i) + k) for k in range(size)]


def _explode_windows(df: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """A row for each word position that begins a window; _w stays available to compiled code, uncopied."""
    last = F.size("_w") - size
    return df.filter(last >= 0).select(*keep, "_w", F.explode(F.sequence(F.lit(0), last)).alias("_i"))


def item_shingles(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct shingles of every item: item, size (words in a shingle), shingle, h, n (shingles of the item).

    Items of fewer than five words have one shingle, the whole of them. Items are keyed by id and
    normalised words, so repeated ids with other texts stay apart. Null and blank items have none.
    """
    words = items.select(F.col(item_id).alias("item"), word_array(F.lower(F.col(text))).alias("_w")).filter(F.size("_w") > 0)
    words = words.withColumn("_key", F.xxhash64("_w")).dropDuplicates(["item", "_key"])
    parts = None
    for size in range(1, SHINGLE + 1):
        own = words.filter(F.size("_w") == size) if size < SHINGLE else words.filter(F.size("_w") >= SHINGLE)
        rows = _explode_windows(own, size, ["item", "_key"]).select("item", "_key", F.lit(size).alias("size"), F.concat_ws(" ", *_window("_w", "_i", size)).alias("shingle"), F.xxhash64(*_window("_w", "_i", size)).alias("h"))
        parts = rows if parts is None else parts.unionByName(rows)
    distinct = parts.distinct()
    return distinct.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("item", "_key")))


def sketches(shingles: DataFrame, containment: float) -> DataFrame:
    """Bottom-k MinHash of every item; k belongs to the item's size class, a power of two.

    A text with the share t of n shingles lacks at most n - ceil(t n), so among the floor((1 - t) n) + 1
    smallest hashes one is in the text: no item is missed, at any size of text. The class takes k for
    its upper end, so that items of a class share one k.
    """
    upper = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    k = F.floor(F.lit(1.0 - containment) * upper + 1e-9) + 1
    rank = F.row_number().over(W.partitionBy("item", "_key").orderBy("h", "shingle"))
    return shingles.withColumns({"_rank": rank, "_k": k}).filter("_rank <= _k").select("item", "_key", "size", "h")


def find_contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """Pairs of a text and an item of which it holds at least the given share of distinct word shingles.

    Words are lower-cased. Returns the id column, item_id, n_shared, n_item (long), containment (double), one row
    a pair; a repeated id with an equal text gives one. Null or blank texts and items match nothing; very long texts are read whole;
    texts shorter than a shingle hold none of it. Empty tables give empty results. Extra columns are ignored.
    Sketches and candidate pairs are written to the shared folder. Search: windows of all texts whose hash is at most the largest of any sketch, joined on the hash.
    Verification: the candidate texts' windows as words, joined with all shingles of the item.
    """
    shingles = materialize(item_shingles(items, item_id, item_text), "shingles")
    # Sizes that occur, and the largest sketch hash of each: at most five rows, read to plan the search.
    sketch = materialize(sketches(shingles, containment), "sketches")
    limits = {r["size"]: r["top"] for r in sketch.groupBy("size").agg(F.max("h").alias("top")).collect()}
    source = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    texts = source.select("_id", F.xxhash64("_text").alias("_tag"), word_array(F.lower("_text")).alias("_w"))
    pairs = None
    for size, top in sorted(limits.items()):
        hashed = _explode_windows(texts, size, ["_id", "_tag"]).select("_id", "_tag", F.xxhash64(*_window("_w", "_i", size)).alias("h")).filter(F.col("h") <= top)
        found = hashed.join(sketch.filter(F.col("size") == size), "h").select("_id", "_tag", "item", "_key", "size")
        pairs = found if pairs is None else pairs.unionByName(found)
    empty = f"{_type(docs, id_col)}, item_id {_type(items, item_id)}, n_shared bigint, n_item bigint, containment double"
    if pairs is None:
        return docs.sparkSession.createDataFrame([], f"{id_col} {empty}")
    pairs = materialize(pairs.distinct(), "candidates")
    # the texts of candidates only, so texts move only where candidates are too many to broadcast; equal rows of one id count once
    wanted = small_side(pairs.select("_id", "_tag").distinct())
    match = source["_id"].eqNullSafe(wanted["_id"]) & (F.xxhash64(source["_text"]) == wanted["_tag"])
    held = source.join(wanted, match, "left_semi").select("_id", F.xxhash64("_text").alias("_tag"), word_array(F.lower("_text")).alias("_w"))
    hits = None
    for size in sorted(limits):
        own = shingles.filter(F.col("size") == size).select("shingle", "item", "_key", "n")
        rows = _explode_windows(held, size, ["_id", "_tag"]).select("_id", "_tag", F.concat_ws(" ", *_window("_w", "_i", size)).alias("shingle"))
        rows = rows.join(own, "shingle").select("_id", "_tag", "item", "_key", "n", "shingle")
        hits = rows if hits is None else hits.unionByName(rows)
    scored = hits.distinct().groupBy("_id", "_tag", "item", "_key", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    same = [scored[c].eqNullSafe(pairs[c]) for c in ("_id", "_tag", "item", "_key")]
    exact = F.col("n_shared") + 1e-9 >= containment * F.col("n")
    verified = scored.filter(exact).join(pairs, same[0] & same[1] & same[2] & same[3], "left_semi")
    best = verified.groupBy("_id", "item").agg(F.max(F.struct((F.col("n_shared") / F.col("n")).alias("c"), "n_shared", "n")).alias("m"))
    return best.select(F.col("_id").alias(id_col), F.col("item").alias("item_id"), F.col("m.n_shared").alias("n_shared"), F.col("m.n").alias("n_item"), F.col("m.c").alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that hold no item, with their columns. Rows whose id is shared with a tainted text leave too.

    Rows of a null id leave if any of them is tainted; null and blank texts stay; repeated rows stay or leave
    together; an empty table gives an empty one. Columns of any name pass unchanged.
    """
    own = Renamed(docs)
    key = own.name(id_col)
    tainted = find_contained(own.df, items, key, own.name(text), **options).select(F.col(key).alias("_tainted")).distinct()
    tainted = small_side(materialize(tainted, "tainted"))
    return own.df.join(tainted, own.df[key].eqNullSafe(tainted["_tainted"]), "left_anti").select(*own.restored())


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
