"""Review packs: questions, sessions, heat maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY, BASE_COST = 45, 10
WIDTH, HEIGHT = 960.0, 640.0


def sessions(items: DataFrame, groups: list[str], order: list[str], cost: Column, capacity: int = CAPACITY) -> DataFrame:
    """Items with session (from 0): filled in order until the next would exceed the capacity.

    A fold over the ordered items of a group (a reading order, a conversation): the load starts anew
    with each session, so no window expresses it.
    """
    plain = [c for c in items.columns if c not in groups]
    row = F.struct(*order, cost.alias("_cost"), *[F.col(c).alias(f"_v_{c}") for c in plain])
    step = """aggregate(_items, named_struct('s', 0, 'load', 0L, 'out', cast(array() as array<int>)), (a, x) ->
        CASE WHEN a.load > 0 AND a.load + x._cost > {c} THEN named_struct('s', a.s + 1, 'load', cast(x._cost as bigint), 'out', concat(a.out, array(a.s + 1)))
        ELSE named_struct('s', a.s, 'load', cast(a.load + x._cost as bigint), 'out', concat(a.out, array(a.s))) END, a -> a.out)""".format(c=capacity)
    packed = items.groupBy(*groups).agg(F.sort_array(F.collect_list(row)).alias("_items")).withColumn("_s", F.expr(step))
    flat = packed.select(*groups, F.explode(F.arrays_zip("_items", "_s")).alias("z"))
    return flat.select(*groups, *[F.col(f"z._items._v_{c}").alias(c) for c in plain], F.col("z._s").alias("session"))


def reading_questions(order: DataFrame, top: int = 8, hard: int = 10) -> DataFrame:
    """position, question: effects of the first symbols, and a split of those that are complex."""
    rows = order.filter(F.col("position") <= top)
    name, path = F.col("name"), F.col("relpath")
    ask = F.array_compact(
        F.array(
            F.format_string("Which side effects has `%s::%s`, and do they belong at a boundary?", path, name),
            F.when(F.col("cognitive") >= hard, F.format_string("Could `%s` in `%s` be divided? Its cognitive complexity is %d.", name, path, F.col("cognitive"))),
        )
    )
    return rows.select("position", F.posexplode(ask).alias("part", "question")).orderBy("position", "part")


def issue_questions(listed: DataFrame, top: int = 5) -> DataFrame:
    return listed.limit(top).select(F.format_string("Should `%s` in `%s` be refactored? %s", "kind", "relpath", "detail").alias("question"))


def color(score: Column, most: Column) -> Column:
    """From blue-green to red by the share of the greatest score."""
    t = F.least(F.greatest(score / most, F.lit(0.0)), F.lit(1.0))
    byte = lambda c: F.floor(c).cast("int")
    mixed = F.format_string("#%02x%02x%02x", byte(40.0 + 200.0 * t), byte(130.0 - 40.0 * t), byte(100.0 - 20.0 * t))
    return F.when(most <= 0, "#4a6fa5").otherwise(mixed)


def heat_rectangles(files: DataFrame, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """relpath, x, y, w, h, score, fill: a slice-and-dice tree map of files by lines, in order of path.

    Which side is cut depends on the box that is left, so the layout is a fold over the sorted files.
    The map is for people: select or roll up to some thousands of files first.
    """
    score = F.col("hotspot") + F.col("cognitive") + 10.0 * F.coalesce("profile_total", F.lit(0.0))
    rows = files.select("relpath", F.greatest(F.col("loc"), F.lit(1)).cast("double").alias("size"), score.alias("score"))
    packed = rows.agg(F.sort_array(F.collect_list(F.struct("relpath", "size", "score"))).alias("f"), F.sum("size").alias("total"), F.greatest(F.max("score"), F.lit(1.0)).alias("most"))
    fold = f"""aggregate(f, named_struct('x', 0D, 'y', 0D, 'w', {width}D, 'h', {height}D, 'left', total, 'out', cast(array() as array<struct<x:double,y:double,w:double,h:double>>)), (a, r) ->
        CASE WHEN a.w >= a.h THEN named_struct('x', a.x + a.w * r.size / greatest(a.left, 1D), 'y', a.y, 'w', a.w - a.w * r.size / greatest(a.left, 1D), 'h', a.h, 'left', a.left - r.size,
            'out', concat(a.out, array(named_struct('x', a.x, 'y', a.y, 'w', a.w * r.size / greatest(a.left, 1D), 'h', a.h))))
        ELSE named_struct('x', a.x, 'y', a.y + a.h * r.size / greatest(a.left, 1D), 'w', a.w, 'h', a.h - a.h * r.size / greatest(a.left, 1D), 'left', a.left - r.size,
            'out', concat(a.out, array(named_struct('x', a.x, 'y', a.y, 'w', a.w, 'h', a.h * r.size / greatest(a.left, 1D))))) END, a -> a.out)"""
    flat = packed.withColumn("r", F.expr(fold)).select("most", F.explode(F.arrays_zip("f", "r")).alias("z"))
    return flat.select("z.f.relpath", "z.r.x", "z.r.y", "z.r.w", "z.r.h", F.col("z.f.score").alias("score"), color(F.col("z.f.score"), F.col("most")).alias("fill"))
