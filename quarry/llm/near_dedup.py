"""Near-duplicate components: one-permutation MinHash, optimal densification, banded buckets, star edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm._components import connected_components
from quarry.llm._kernel import Words, hash_windows, hash_words, mix, pieces, split_words, text_buffer, window_starts
from quarry.llm._spark import Renamed, materialize, row_hashes

SHINGLE = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A pair at the threshold shares no band with probability (1 - 0.85**ROWS)**BANDS, under 1e-6.
BANDS, ROWS = 44, 8
_PIECE = 1 << 20
#: Rows whose texts and sets a Python worker holds at a time.
_SLICE = 512
_SIGNATURE = "id long, t1 long, t2 long, n long, s1 long, s2 long, bands array<long>"


def shingle_sets(words: Words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: five words, or all of a shorter text as one."""
    h = hash_words(words, lower=True)
    start = window_starts(words, SHINGLE)
    windows = hash_windows(h, SHINGLE)[start]
    cut = np.searchsorted(start, words.first)
    sets = []
    for i in range(len(words.first) - 1):
        lo, hi = words.first[i], words.first[i + 1]
        if hi - lo >= SHINGLE:
            sets.append(np.unique(windows[cut[i] : cut[i + 1]]))
        elif hi > lo:
            sets.append(hash_windows(h[lo:hi], int(hi - lo)) ^ np.uint64(hi - lo))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def text_sets(column: pa.Array):
    """(row, shingle set) of each text of a column, a few megabytes of text at a time."""
    data, offsets = text_buffer(column)
    for lo, hi in pieces(offsets, _PIECE):
        yield lo, shingle_sets(split_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes, one row for each set; all-zero rows for empty sets.

    One hash serves all bins: its high bits choose the bin, and the least of each bin is the first in
    sorted order. Empty bins take the value of another bin, probed in a random order of their own that
    is the same for all sets, so that two sets agree in any bin with the probability of their Jaccard
    similarity.
    """
    k = bands * rows
    value = np.zeros((len(sets), k), np.uint64)
    full = np.zeros((len(sets), k), bool)
    for i, u in enumerate(sets):
        if len(u):
            at = ((u >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            first = np.concatenate([[True], at[1:] != at[:-1]])
            value[i, at[first]] = u[first]
            full[i, at[first]] = True
    has = full.any(1)
    doc, bin_ = np.nonzero(~full & has[:, None])
    attempt = 0
    while len(doc):
        attempt += 1
        probe = mix(bin_.astype(np.uint64) * np.uint64(0x9E3779B1) + np.uint64(attempt << 32)) % np.uint64(k)
        hit = full[doc, probe]
        value[doc[hit], bin_[hit]] = value[doc[hit], probe[hit]]
        doc, bin_ = doc[~hit], bin_[~hit]
    out = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + value[:, r::rows])
    out = mix(out ^ (np.arange(bands, dtype=np.uint64) + np.uint64(1)))
    out[~has] = 0
    return out


def _sign(bands: int, rows: int):
    def sign(batches):
        for batch in (b.slice(k, _SLICE) for b in batches for k in range(0, len(b), _SLICE)):
            for lo, sets in text_sets(batch.column("text")):
                for at in range(0, len(sets), 256):
                    part = sets[at : at + 256]
                    own = [batch.column(c).slice(lo + at, len(part)).cast(pa.int64()) for c in ("id", "t1", "t2")]
                    total = lambda salt: np.array([mix(u ^ np.uint64(salt)).sum() if len(u) else 0 for u in part], np.uint64).view(np.int64)  # noqa: B023, E731
                    n = np.array([len(u) for u in part], np.int64)
                    flat = signatures(part, bands, rows)
                    flat = pa.array(flat[n > 0].ravel().view(np.int64))
                    ends = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(total(0)), pa.array(total(0x1B873593CC9E2D51)), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "t1", "t2", "n", "s1", "s2", "bands"])

    return sign


def _verify(batches):
    """Intersection and union of the full shingle sets of each pair of texts."""
    for batch in (b.slice(k, _SLICE) for b in batches for k in range(0, len(b), _SLICE)):
        sides = []
        for name in ("ta", "tb"):
            coded = batch.column(name).dictionary_encode()  # the centre of a star comes up many times
            sets = [s for _, part in text_sets(coded.dictionary) for s in part]
            sides.append([sets[i] for i in coded.indices.to_pylist()])
        inter = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides, strict=True)], np.int64)
        union = np.array([len(x) + len(y) for x, y in zip(*sides, strict=True)], np.int64) - inter
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(inter), pa.array(union)], ["a", "b", "inter", "union"])


def _shingles(batches):
    """A row for each distinct shingle of each text."""
    for batch in (b.slice(k, _SLICE) for b in batches for k in range(0, len(b), _SLICE)):
        nodes = batch.column("node").to_numpy()
        for lo, sets in text_sets(batch.column("text")):
            n = np.array([len(u) for u in sets], np.int64)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[lo : lo + len(sets)], n)), pa.array(np.repeat(n, n)), pa.array(flat)], ["node", "n", "bucket"])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The exact sizes for pairs (a, b), written to the shared folder; texts has node and text."""
    half = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    both = half.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    checked = both.select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long, inter long, union long")
    return materialize(checked, "links")


def _prefixes(texts: DataFrame, percent: int) -> DataFrame:
    """bucket, node, n, pos: the rarest shingles of each text, as many as it can lack and still be in a link, plus one.

    Any order of shingles serves, if it is one for all texts: two linked texts share one of these. The rarest
    come first, so unlike texts with a common passage don't meet. Shingles of one text alone take places but give
    no rows. pos is a shingle's place in its text's order.
    """
    rows = texts.mapInArrow(_shingles, "node long, n long, bucket long")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_df")).filter("_df > 1")
    own = W.partitionBy("node")
    placed = rows.join(shared, "bucket").withColumn("_at", F.row_number().over(own.orderBy("_df", "bucket"))).withColumn("_m", F.count(F.lit(1)).over(own))
    pos = F.col("n") - F.col("_m") + F.col("_at") - 1
    return placed.withColumn("pos", pos).filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100)).select("bucket", "node", "n", "pos")


def _graph(docs: DataFrame, id_col: str, text: str, bands: int, rows: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows (id, t1, t2, n, s1, s2), and n, s1, s2, component (a number), component_id of every class of equal sets.

    Classes are numbered when they are written, so that repeated ids keep different texts apart.
    """
    # the hashes tell which row a signature belongs to where ids repeat
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(2), "text")})
    signed = materialize(source.mapInArrow(_sign(bands, rows), _SIGNATURE), "signatures")
    narrow = signed.drop("bands")
    equal = ["n", "s1", "s2"]
    key = F.coalesce("id", F.lit(2**63 - 1)).alias("_k")  # null comes after all others
    classes = narrow.filter("n > 0").select(*equal, "id", key).groupBy(*equal).agg(F.min("id").alias("rep"), F.min("_k").alias("_k"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def chosen(*columns: str) -> DataFrame:
        """node and some columns of one row of each class: its rows share all bands, and any of its texts serves."""
        on = [*equal, "_k"]
        return signed.select(*equal, key, *columns).join(classes.select(*on, "node"), on).dropDuplicates(on)

    placed = chosen("bands").select("node", "n", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("center"), F.min_by("n", "node").alias("cn"), F.count(F.lit(1)).alias("size"))
    members = placed.join(shared.filter("size > 1").drop("size"), "bucket")
    members = materialize(members, "members")

    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    linked = (100 * F.col("inter") >= percent * F.col("union")) & (F.col("union") > 0)
    pairs = materialize(members.filter((F.col("node") != F.col("center")) & near(F.col("n"), F.col("cn"))).select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    # The texts of bucket members, written once: later rounds read those of open buckets only. Joins of
    # texts are merge joins at every size; a broadcast that small tables allow would plan them otherwise.
    held = ["t1", "t2", "_k"]
    wanted = chosen("t1", "t2").join(members.select("node").distinct(), "node", "left_semi").select(*held, "node")
    texts = source.select("t1", "t2", key, "text").join(wanted.hint("merge"), held).dropDuplicates(held).select("node", "text")
    texts = materialize(texts, "texts")
    checked = _links(pairs, texts)
    edges = checked.filter(linked).select("a", "b")
    labels = connected_components(edges)

    def opened(table: DataFrame) -> DataFrame:
        """The rows of buckets whose members are in more than one component, with these."""
        now = table.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        split = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
        return now.join(split, "bucket", "left_semi")

    left = opened(members.select("bucket", "node")).select("node").distinct().hint("merge")
    texts = materialize(texts.join(left, "node", "left_semi"), "texts")
    seen = checked.select("a", "b")
    buckets = materialize(_prefixes(texts, percent), "prefixes")
    turn = 0
    while True:
        now = materialize(opened(buckets), "open")
        if not now.limit(1).count():
            break
        leader = now.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(1 << min(2 * turn, 30))).alias("_sub")).agg(F.min("node").alias("node")).select("bucket", "node")
        lead = now.join(leader, ["bucket", "node"], "left_semi").select("bucket", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("pos").alias("xpos"), F.col("component").alias("xc"))
        # if this is their first common shingle, no more than the shorter rest can be common
        most = F.least(F.col("n") - F.col("pos"), F.col("xn") - F.col("xpos"))
        enough = most * (100 + percent) >= percent * (F.col("n") + F.col("xn"))
        more = now.join(lead, "bucket").filter((F.col("component") != F.col("xc")) & near(F.col("n"), F.col("xn")) & enough)
        more = more.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct().join(seen, ["a", "b"], "left_anti")
        found = _links(more, texts)
        seen = materialize(seen.unionByName(found.select("a", "b")), "seen")
        added = found.filter(linked).select("a", "b")
        if added.limit(1).count():
            edges = edges.unionByName(added)
            labels = connected_components(edges)
        buckets = now.join(leader, ["bucket", "node"], "left_anti").select("bucket", "node", "n", "pos")
        turn += 1

    named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return narrow, named.drop("_k").join(least, "component").select(*equal, "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """Components of texts linked by 100 * |A & B| >= percent * |A | B| of their distinct 5-word shingles.

    Words are lower-cased in A-Z only; a text of fewer words is one shingle; null and blank texts have an
    empty set and link with nothing. Returns a row for each input row: the id (long), n_shingles,
    component_id (least id reachable), kept (id = component_id). Rows of equal sets form one class, and rows of
    one id but other texts are in classes of their own. Rows of a null id link like others; where no other
    id is reachable, their component is null and they are kept. Very long texts are read whole. Empty tables give
    empty results; other columns are ignored, whatever their names.

    In every bucket all members are compared with its first class (a star), never with each other. A
    bucket whose members are then in more than one component may hide links between members. The texts of
    such buckets are put in buckets again, by their rarest shingles, as many as a linked text may lack and one:
    linked texts share one of these, and unlike ones seldom do, however many there are. There, members become
    centres in turn, four times as many each round, until none is left or the bucket is in one component.
    """
    signed, classes = _graph(docs, id_col, text, bands, rows, percent)
    full = signed.filter("n > 0").join(classes.drop("component"), ["n", "s1", "s2"]).select("id", "n", "component_id")
    # texts without words are one by one, and many
    out = full.unionByName(signed.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """One row of every component of near_duplicates, and all rows without words; all columns unchanged.

    The row of the least id stays, a null one counting as largest; of several such rows the one whose text, then
    whose whole row, has the least hash. Repeated rows leave but for one. Columns may have any names.
    """
    own = Renamed(docs)
    c_id, c_text = own.name(id_col), own.name(text)
    signed, classes = _graph(own.df, c_id, c_text, bands, rows, percent)
    placed = signed.filter("n > 0").join(classes, ["n", "s1", "s2"]).select("id", "t1", "t2", "component", "component_id")
    groups = placed.groupBy("component", "component_id", "id", "t1", "t2").agg(F.count(F.lit(1)).alias("_rows"))
    groups = materialize(groups, "groups")
    # the rows of a component's least id: one group in nearly all cases
    best = groups.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min(F.struct("t1", "t2")).alias("_best"))
    judged = groups.join(best, "component")
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.struct("t1", "t2") == F.col("_best"))
    gone = judged.filter(~stays).select("id", "t1", "t2").distinct()
    again = judged.filter(stays & (F.col("_rows") > 1)).select("id", "t1", "t2")
    keyed = own.df.withColumns({"_id": F.col(c_id).cast("long"), "_t1": F.xxhash64(c_text), "_t2": F.xxhash64(F.lit(2), c_text)})
    same = lambda left, right: left["_id"].eqNullSafe(right["id"]) & (left["_t1"] == right["t1"]) & (left["_t2"] == right["t2"])
    left = keyed.join(gone, same(keyed, gone), "left_anti")
    if again.limit(1).count():
        h, g = row_hashes(own.df)
        alike = left.join(again, same(left, again), "left_semi").withColumn("_key", F.struct(h.alias("h"), g.alias("g")))
        one = alike.groupBy("_id", "_t1", "_t2").agg(F.min_by(F.struct(*own.df.columns), "_key").alias("_row")).select("_row.*")
        left = left.join(again, same(left, again), "left_anti").select(*own.df.columns).unionByName(one)
    return left.select(*own.restored())
