"""Removal of word windows that an earlier document has: Count-min prefilter, then exact grouping.

Documents are hashed into blocks of bounded size. Three passes over the blocks exchange compact
arrays with owners of hash ranges, so that nothing is broadcast and no task holds more than its
block or its range:

1. Every block sends its partial Count-min sketch (two rows of counters), sparsely: the sorted cells
   it touches, as gaps. The owner of a cell range adds up what all blocks sent and returns one bit a
   cell: counted more than once, or not. The width follows the size of the input.
2. A window's estimate is the lower of its two counters, never below its count: a window with a bit
   unset in either row is unique. All others go to owners of hash ranges, with the least document id
   of the block, and are grouped exactly; one bit each returns: does an earlier document have it?
3. Blocks remove the words that such windows cover.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _bytes
from quarry.llm._kernel import hash_windows, hash_words, mix, pieces, split_words, text_buffer, window_starts
from quarry.llm._spark import materialize, small_side, total_bytes

WINDOW = 13
#: Text of one block, which a task holds; the number of blocks follows from it.
BLOCK_BYTES = 12 << 20
#: Sketch cells for each window of the input, in each of the two rows.
CELLS_PER_WINDOW = 8
_PIECE = 1 << 20
_NO_ID = np.iinfo(np.int64).max
_REQUEST = "block int, part int, n int, body binary"
_REPLY = "block int, part int, n int, exact boolean, bits binary"


def _windows(table: pa.Table, size: int, seeds: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows for each seed, the window's row and first word, and where rows' words begin."""
    data, offsets = text_buffer(table.column("text"))
    hashes: list[list[np.ndarray]] = [[] for _ in seeds]
    at, rows, counts, base = [], [], [], 0
    for lo, hi in pieces(offsets, _PIECE):
        words = split_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        start = window_starts(words, size)
        for out, seed in zip(hashes, seeds, strict=True):
            out.append(hash_windows(hash_words(words, seed), size, seed)[start])
        at.append(start + base)
        rows.append(words.doc[start] + lo)
        counts.append(np.diff(words.first))
        base += len(words.start)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    first = np.concatenate([[0], np.cumsum(cat(counts, np.int64))])
    return [cat(h, np.uint64) for h in hashes], cat(rows, np.int64), cat(at, np.int64), first


def _ids(table: pa.Table) -> np.ndarray:
    """Document ids; null comes after all others."""
    return table.column("id").combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _order(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and the places they come from; packed into one sort where both fit 64 bits."""
    low = max(1, int(len(keys)).bit_length())
    if bits + low <= 64:
        packed = np.sort((keys << np.uint64(low)) | np.arange(len(keys), dtype=np.uint64))
        return packed >> np.uint64(low), (packed & np.uint64((1 << low) - 1)).astype(np.int64)
    at = np.argsort(keys)
    return keys[at], at


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0x5851F42D4C957F2D)) if row else h) >> np.uint64(64 - bits)


def _unique(h: np.ndarray, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cells in order, whether each is touched twice or more here, and each window's place among them."""
    cells, at = _order(_cells(h, row, bits), bits)
    new = np.ones(len(cells), bool)
    new[1:] = cells[1:] != cells[:-1]
    first = np.flatnonzero(new)
    place = np.empty(len(cells), np.int64)
    place[at] = np.cumsum(new) - 1
    return cells[first], np.diff(np.append(first, len(cells))) > 1, place


def _ranges(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Ends of the runs of sorted keys below each of the upper bounds of equal ranges."""
    bounds = np.array([min((1 << bits) * (r + 1) // parts, (1 << 64) - 1) for r in range(parts - 1)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def _sketch(size: int, bits: int, parts: int):
    def send(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        (h,), _, _, _ = _windows(table, size, (0,))
        rows = []
        for row in (0, 1):
            cells, twice, _ = _unique(h, row, bits)
            ends = _ranges(cells, bits, parts)
            for r in range(parts):
                lo, hi = ends[r], ends[r + 1]
                if lo == hi:
                    continue
                gaps = np.diff(cells[lo:hi], prepend=cells[lo : lo + 1])
                gaps[0] = cells[lo]
                control, data = _bytes.encode((gaps << np.uint64(1)) | twice[lo:hi], _bytes.WIDTHS_64)
                rows.append((block, row * parts + r, int(hi - lo), control + data))
        return _requests(rows)

    return send


def _requests(rows: list[tuple]) -> pa.Table:
    names, kinds = ("block", "part", "n", "body"), (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(names, kinds, strict=True))})


def _replies(table: pa.Table, flags: np.ndarray, exact: bool) -> pa.Table:
    """One row of bits for each request, in the order of the requests."""
    counts = table.column("n").to_numpy()
    ends = np.cumsum(counts)
    bits = [np.packbits(flags[e - n : e]).tobytes() for e, n in zip(ends, counts, strict=True)]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "n": table.column("n"), "exact": pa.array([exact] * len(counts), pa.bool_()), "bits": pa.array(bits, pa.binary())})


def _merge(bits: int):
    def merge(table: pa.Table) -> pa.Table:
        cells, twice = [], []
        for n, body in zip(table.column("n").to_pylist(), table.column("body").to_pylist(), strict=True):
            quads = -(-n // 4)
            values = _bytes.decode(body[:quads], body[quads:], n, _bytes.WIDTHS_64)
            cells.append(np.cumsum(values >> np.uint64(1), dtype=np.uint64))
            twice.append((values & np.uint64(1)).astype(bool))
        all_cells, at = _order(np.concatenate(cells), bits)
        again = np.concatenate(twice)[at]
        same = all_cells[1:] == all_cells[:-1]
        again[1:] |= same
        again[:-1] |= same
        flags = np.empty(len(again), bool)
        flags[at] = again
        return _replies(table, flags, False)

    return merge


def _bits(replies: pa.Table, exact: bool, low: int, high: int) -> np.ndarray:
    """The bits of the replies of parts low to high, in order of their parts."""
    rows = [(p, n, b) for p, n, e, b in zip(*(replies.column(c).to_pylist() for c in ("part", "n", "exact", "bits")), strict=True) if e == exact and low <= p < high]
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for _, n, b in sorted(rows))])


def _candidates(table: pa.Table, replies: pa.Table, size: int, bits: int, parts: int):
    """Windows that both rows estimate as repeated, grouped by their hashes inside the block."""
    (h1, h2), rows, at, first = _windows(table, size, (0, 1))
    keep = np.ones(len(h1), bool)
    if len(h1):
        for row in (0, 1):
            keep &= _bits(replies, False, row * parts, (row + 1) * parts)[_unique(h1, row, bits)[2]]
    h1, h2, rows, at = h1[keep], h2[keep].astype(np.uint32), rows[keep], at[keep]
    order = np.argsort(h1)
    h1, h2, rows, at = h1[order], h2[order], rows[order], at[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    starts = np.flatnonzero(new)
    ids = _ids(table)[rows]
    least = np.minimum.reduceat(ids, starts) if len(starts) else ids
    return h1, h2, starts, least, ids, np.cumsum(new) - 1, at, first


def _propose(size: int, bits: int, parts: int):
    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return _requests([])
        block = table.column("block")[0].as_py()
        h1, h2, starts, least, *_ = _candidates(table, replies, size, bits, parts)
        h1, h2 = h1[starts], h2[starts]
        ends = _ranges(h1, 64, parts)
        return _requests([(block, r, int(hi - lo), _bytes.planes(h1[lo:hi]) + _bytes.planes(h2[lo:hi]) + _bytes.planes(least[lo:hi])) for r, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if lo < hi])

    return send


def _group(table: pa.Table) -> pa.Table:
    """Exact grouping of one hash range: is the least id of the window anywhere below the block's?"""
    h1, h2, ids = [], [], []
    for n, body in zip(table.column("n").to_pylist(), table.column("body").to_pylist(), strict=True):
        view = memoryview(body)
        h1.append(_bytes.from_planes(view, n, "<u8"))
        h2.append(_bytes.from_planes(view[8 * n :], n, "<u4"))
        ids.append(_bytes.from_planes(view[12 * n :], n, "<i8"))
    a, b, least = np.concatenate(h1), np.concatenate(h2), np.concatenate(ids)
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    overall = np.repeat(np.minimum.reduceat(least, starts), np.diff(np.append(starts, len(a))))
    flags = np.empty(len(a), bool)
    flags[order] = overall < least
    return _replies(table, flags, True)


def _remove(size: int, bits: int, parts: int):
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("copies", pa.int64())])

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return schema.empty_table()
        _, _, _, least, ids, entry, at, first = _candidates(table, replies, size, bits, parts)
        gone = _bits(replies, True, 0, parts)[entry] | (ids > least[entry]) if len(entry) else np.zeros(0, bool)
        edge = np.zeros(first[-1] + 1, np.int32)
        edge[at[gone]] += 1
        np.subtract.at(edge, at[gone] + size, 1)
        kept = np.cumsum(edge[:-1]) == 0
        removed = np.concatenate([[0], np.cumsum(~kept)])
        n_removed = removed[first[1:]] - removed[first[:-1]]
        texts = []
        for i, body in enumerate(table.column("text").cast(pa.large_binary()).to_pylist()):
            words = (body or b"").split()
            texts.append(b" ".join(compress(words, kept[first[i] : first[i + 1]]) if n_removed[i] else words))
        return pa.table([table.column("id").combine_chunks(), pa.array(np.diff(first)), pa.array(n_removed), pa.array(texts, pa.binary()).cast(pa.string()), table.column("copies").combine_chunks()], schema=schema)

    return remove


def _blocks(docs: DataFrame, blocks: int, block_bytes: int) -> tuple[DataFrame, bool]:
    """id, text, copies, block of all rows, and whether copies matter.

    Rows of equal id and text would all meet in one block. As they remove nothing from each other and keep
    the same words, those that would fill a quarter of a block stand there once, with their number.
    """
    docs = docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(2), "text")})
    own = F.coalesce(F.octet_length("text"), F.lit(0)) + 32
    counted = docs.groupBy("id", "t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.max(own).alias("_bytes"))
    many = counted.filter((F.col("copies") > 1) & (4 * F.col("copies") * F.col("_bytes") > block_bytes)).drop("_bytes")
    many = materialize(many, "repeats")
    repeated = many.limit(1).count() > 0
    rows = docs.select("id", "text", F.lit(1).cast("long").alias("copies"))
    if repeated:
        hot = small_side(many)
        same = docs["id"].eqNullSafe(hot["id"]) & (docs["t1"] == hot["t1"]) & (docs["t2"] == hot["t2"])
        once = docs.join(hot, same).groupBy(docs["id"], docs["t1"], docs["t2"]).agg(F.first("text").alias("text"), F.first("copies").alias("copies"))
        rest = docs.join(hot, same, "left_anti").select("id", "text", F.lit(1).cast("long").alias("copies"))
        rows = rest.unionByName(once.select("id", "text", "copies"))
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")), repeated


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Removes each word covered by a window of ``size`` words that also starts in a document of a smaller id.

    Windows are judged on the input. Returns a row for each input row: the id (long), n_words, n_removed
    (long), kept_text (kept words joined by one space). Null texts have no words; texts shorter than a
    window keep all. A null id counts as larger than any; rows of equal ids remove nothing from each
    other. Very long texts have a block of their own; many equal rows are worked on once and returned as often as
    they came. An empty table gives an empty one. Other columns
    are not returned, whatever their names. Windows are compared by 96 bits of two independent hashes.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    _, volume = total_bytes(source, "text")
    blocks = max(1, math.ceil(volume / block_bytes))
    bits = min(44, max(16, math.ceil(math.log2(CELLS_PER_WINDOW * max(1, volume // 6)))))
    parts = max(1, math.ceil(blocks / 2))
    held, repeated = _blocks(source, blocks, block_bytes)
    # every pass reads this exchange again; it is planned and run once
    held = held.repartition(blocks, "block")
    by_block = held.groupBy("block")
    touched = by_block.applyInArrow(_sketch(size, bits, parts), _REQUEST)
    counted = touched.groupBy("part").applyInArrow(_merge(bits), _REPLY).repartition(blocks, "block")
    proposed = by_block.cogroup(counted.groupBy("block")).applyInArrow(_propose(size, bits, parts), _REQUEST)
    grouped = proposed.groupBy("part").applyInArrow(_group, _REPLY)
    answers = counted.unionByName(grouped)
    out = by_block.cogroup(answers.groupBy("block")).applyInArrow(_remove(size, bits, parts), "id long, n_words long, n_removed long, kept_text string, copies long")
    if repeated:
        out = materialize(out, "kept")
        chunk = 10_000  # copies that one row makes; rows are spread before they are made
        again = out.filter("copies > 1").withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {chunk}")))).repartition("id", "_at")
        again = again.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(chunk), F.col("copies") - F.col("_at") * chunk))))
        out = out.filter("copies = 1").unionByName(again.select(*out.columns))
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_text")
