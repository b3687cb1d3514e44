"""Monotone calibration: pool-adjacent-violators over ranges of scores, and interpolation between its blocks.

A block is a run of scores with one fitted value. Ranges are pooled apart, and pooled again under other cuts until
every block lies below the next one, so no task holds a whole group; each round carries a pooling at least a range
further. Neighbours that are equal, not falling, join without losing the mean scores at their ends, between which the
fit is flat. Pooling keeps sums, so the result does not depend on the cuts (exactly so while sums are integers below 2^53).

Defined results: rows with a null or non-finite score, label or weight, or a weight of 0 or less, are left out of the
fit; equal scores count as one; a null group is a group; an empty table gives no block. A score without a
fit in its group, a null and a NaN one get a null; scores beyond the ends get the value of the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.lineage import cut

RANGE_ROWS = 200_000  # blocks of a range aimed at

_BLOCKS = "g string, lo double, hi double, sx double, sy double, w double, x0 double, x1 double, part int"


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks of one range; a block joins the one before while that one's mean is not below its own."""
    schema = pa.schema([("g", pa.string()), *((n, pa.float64()) for n in ("lo", "hi", "sx", "sy", "w", "x0", "x1")), ("part", pa.int32())])
    part, group, stack = None, None, []

    def full() -> pa.RecordBatch:
        cols = np.array(stack, float).reshape(-1, 7).T
        return pa.record_batch([pa.array([group] * len(stack), pa.string()), *(pa.array(c) for c in cols), pa.array([part] * len(stack), pa.int32())], schema=schema)

    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in schema.names}
        for g, lo, hi, sx, sy, w, x0, x1, p in zip(*(c[n] for n in schema.names), strict=True):
            if (g, p) != (group, part):
                if stack:
                    yield full()
                group, part, stack = g, p, []
            while stack and stack[-1][3] * w >= sy * stack[-1][4]:
                lo, _, sxb, syb, wb, x0b, _ = stack.pop()
                level = syb * w == sy * wb
                sx, sy, w = sx + sxb, sy + syb, w + wb
                x0, x1 = (x0b, x1) if level else (sx / w, sx / w)
            stack.append((lo, hi, sx, sy, w, x0, x1))
    if stack:
        yield full()


def isotonic_blocks(points: DataFrame) -> DataFrame:
    """(g, x, y, w) -> (g, lo, hi, x0, x1, y, w): each block's first and last score, the ends of its flat stretch
    (both the mean score, unless equal blocks met), fitted value and weight."""
    good = points.select(F.col("g").cast("string").alias("g"), *(F.col(n).cast("double").alias(n) for n in "xyw"))
    good = good.where(_finite("x") & _finite("y") & _finite("w") & (F.col("w") > 0)).withColumn("x", F.col("x") + F.lit(0.0))  # -0.0 is 0.0
    cells = good.groupBy("g", "x").agg(F.sum(F.col("y") * F.col("w")).alias("sy"), F.sum("w").alias("w"))
    now = cut(cells.select("g", F.col("x").alias("lo"), F.col("x").alias("hi"), (F.col("x") * F.col("w")).alias("sx"), "sy", "w", F.col("x").alias("x0"), F.col("x").alias("x1")))
    step = 0
    while True:
        ranges = max(1, -(-now.count() // RANGE_ROWS))
        if ranges > 1:
            ranges += 1 + step % 2  # quantiles of n and n + 1 parts meet nowhere inside, so the cuts move
        sorted_ = now.repartitionByRange(ranges, "g", "lo").sortWithinPartitions("g", "lo").withColumn("part", F.spark_partition_id())
        now = cut(sorted_.mapInArrow(_pool, _BLOCKS))
        if ranges == 1 or not _broken(now):
            break
        now, step = now.drop("part"), step + 1
    return now.select("g", "lo", "hi", "x0", "x1", (F.col("sy") / F.col("w")).alias("y"), "w")


def _broken(blocks: DataFrame) -> bool:
    """Whether the last block of a range does not lie below the first one of the group's next range: a row per group and range."""
    mean = F.struct("sy", "w")
    ends = blocks.groupBy("g", "part").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
    before = F.lag("last").over(Window.partitionBy("g").orderBy("part"))
    return bool(ends.withColumn("b", before).where("b.sy * first.w >= first.sy * b.w").limit(1).count())


def _around(knots: DataFrame, points: DataFrame) -> DataFrame:
    """Distinct (g, x) of points with `below` and `above`: the group's last knot up to x and the first one after x.

    Knots and scores are cut into common ranges; a range looks for what it lacks among the ends of the others."""
    every = knots.select("g", F.col("x").alias("p"), F.struct("x", "y").alias("k")).unionByName(points.select("g", F.col("x").alias("p"), F.lit(None).cast("struct<x:double,y:double>").alias("k")))
    placed = cut(every.repartitionByRange("g", "p").withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("g", "part").orderBy("p", F.col("k").isNull())  # a knot at x comes before x
    down, up = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(1, Window.unboundedFollowing)
    inside = placed.withColumn("below", F.last("k", True).over(down)).withColumn("above", F.first("k", True).over(up)).where("k IS NULL")
    ends = placed.groupBy("g", "part").agg(F.max_by("k", F.when(F.col("k").isNotNull(), F.col("p"))).alias("last"), F.min_by("k", F.when(F.col("k").isNotNull(), F.col("p"))).alias("first"))
    order = Window.partitionBy("g").orderBy("part")  # a row per group and range
    ends = ends.select(
        "g", "part",
        F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    i, e = inside.alias("i"), ends.alias("e")
    return i.join(e, F.col("i.g").eqNullSafe(F.col("e.g")) & (F.col("i.part") == F.col("e.part"))).select(
        "i.g", F.col("i.p").alias("x"), F.coalesce("i.below", "e.before").alias("below"), F.coalesce("i.above", "e.after").alias("above"))


def _per_score(points: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """All rows of points with the value of their (g, x)."""
    p, f = points.alias("p"), found.alias("f")
    key = F.col("p.g").cast("string").eqNullSafe(F.col("f.g")) & (F.col("p.x").cast("double") == F.col("f.x"))
    return p.join(f, key, "left").select("p.*", F.col(f"f.{name}").alias(name))


def _scores(points: DataFrame) -> DataFrame:
    return points.select(F.col("g").cast("string").alias("g"), (F.col("x").cast("double") + F.lit(0.0)).alias("x")).where("x IS NOT NULL AND NOT isnan(x)").distinct()


def isotonic(points: DataFrame) -> DataFrame:
    """(g, x, fit): the fitted value of each distinct score."""
    blocks = isotonic_blocks(points)
    good = points.where(_finite("x") & _finite("y") & _finite("w") & (F.col("w") > 0))
    return _around(blocks.select("g", F.col("lo").alias("x"), "y"), _scores(good)).select("g", "x", F.round("below.y", 6).alias("fit"))


def calibrated(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """points (g, x, ...) with `p`: linear between a group's blocks, flat within and beyond the last ones."""
    knots = blocks.select("g", F.explode(F.array_distinct(F.array("x0", "x1"))).alias("x"), "y")
    near = _around(knots, _scores(points))
    x0, y0, x1, y1 = F.col("below.x"), F.col("below.y"), F.col("above.x"), F.col("above.y")
    between = y0 + (F.col("x") - x0) * ((y1 - y0) / (x1 - x0))
    value = F.when(F.col("below").isNull(), y1).when(F.col("above").isNull(), y0).otherwise(between)
    return _per_score(points, near.select("g", "x", value.alias("p")), "p")
