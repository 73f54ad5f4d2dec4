"""Isotonic regression without a place that sees all scores.

Equal scores are summed first and range-partitioned.  Each partition pools its neighbours that fall into a stack of rising
blocks, row by row; the stacks of ``FAN`` partitions at a time are then pooled into one until one is left.  Of 0/1 labels in
N rows a rising stack has at most about N ** (2/3) blocks, since their means are different fractions of that many rows, and
of noisy ones about N ** (1/3); only that many rows ever meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undercroft.session import stored

FAN = 32
BLOCK = pa.schema([("part", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("total", pa.float64()), ("n", pa.float64())])
BLOCK_DDL = "part long, lo double, hi double, total double, n double"


def push(stack: list[list[float]], block: list[float]) -> None:
    """Puts a block (lo, hi, total, n) on a rising stack; what would not rise is pooled."""
    while stack and stack[-1][2] * block[3] >= block[2] * stack[-1][3]:
        lo, _, total, n = stack.pop()
        block = [lo, block[1], total + block[2], n + block[3]]
    stack.append(block)


def as_batch(part: int, stack: list[list[float]]) -> pa.RecordBatch:
    columns = [[part] * len(stack), *(list(c) for c in zip(*stack, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, BLOCK, strict=True)], schema=BLOCK)


def pool_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack, part = [], 0
    for b in batches:
        for part, lo, hi, total, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            push(stack, [lo, hi, total, n])
    if stack:
        yield as_batch(part, stack)


def pool_group(rows: pa.Table) -> pa.Table:
    stack: list[list[float]] = []
    for lo, hi, total, n in zip(*(rows.sort_by("lo")[c].to_pylist() for c in ("lo", "hi", "total", "n")), strict=True):
        push(stack, [lo, hi, total, n])
    return pa.Table.from_batches([as_batch(rows["part"][0].as_py(), stack)])


def isotonic_blocks(scored: DataFrame, y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """``lo, hi, value``: scores from ``lo`` to ``hi`` map to ``value``, rising from block to block.

    Rows with a null or NaN score or label take no part.
    """
    x, label = F.col(p).cast("double"), F.col(y).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = scored.filter(x.isNotNull() & ~F.isnan(x) & label.isNotNull() & ~F.isnan(label)).select(x.alias("lo"), (label * w).alias("total"), w.alias("n"))
    sums = rows.groupBy("lo").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0")
    dealt = sums.repartitionByRange("lo").sortWithinPartitions("lo").select(F.spark_partition_id().cast("long").alias("part"), "lo", F.col("lo").alias("hi"), "total", "n")
    blocks = stored(dealt.mapInArrow(pool_partition, BLOCK_DDL))
    most = blocks.agg(F.max("part")).first()[0] or 0
    while most:
        grouped = blocks.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        blocks, most = stored(grouped.groupBy("part").applyInArrow(pool_group, BLOCK_DDL)), most // FAN
    return blocks.select("lo", "hi", (F.col("total") / F.col("n")).alias("value"))


def interpolated(points: DataFrame, x: str, blocks: DataFrame) -> DataFrame:
    """``x, value`` of the distinct ``points``: linear between blocks, level beyond them.

    Points and block ends are range-partitioned together; a partition takes the nearest end of another from one summary row each.
    """
    ends = blocks.select(F.explode(F.array(F.struct(F.col("lo").alias("x"), "value"), F.struct(F.col("hi").alias("x"), "value"))).alias("e")).select("e.x", "e.value", F.lit(True).alias("end")).distinct()
    both = points.select(F.col(x).alias("x"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("end")).union(ends)
    dealt = stored(both.repartitionByRange("x").withColumn("part", F.spark_partition_id()))
    at = F.when(F.col("end"), F.struct("x", "value"))
    sides = {"below": F.last(at, True), "above": F.first(at, True)}
    outer = dealt.groupBy("part").agg(F.max(at).alias("last"), F.min(at).alias("first"))
    parts = Window.orderBy("part")  # a row a partition
    outer = outer.select("part", F.last("last", True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(parts.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    own = Window.partitionBy("part").orderBy("x")
    frames = {"below": own.rangeBetween(Window.unboundedPreceding, 0), "above": own.rangeBetween(0, Window.unboundedFollowing)}
    near = dealt.withColumns({n: f.over(frames[n]) for n, f in sides.items()}).filter("NOT end").join(outer, "part")
    lo, hi = F.coalesce("below", "before"), F.coalesce("above", "after")
    share = (F.col("x") - lo["x"]) / (hi["x"] - lo["x"])
    value = F.when(lo.isNull(), hi["value"]).when(hi.isNull() | (hi["x"] == lo["x"]), lo["value"]).otherwise(lo["value"] + (hi["value"] - lo["value"]) * share)
    return near.select(F.col("x").alias(x), value.alias("value"))


def calibrated(scored: DataFrame, target: DataFrame, y: str = "y", p: str = "p", out: str = "p_calibrated") -> DataFrame:
    """``target`` with the monotone map of its score learnt on ``scored``; null where the score is null or nothing was learnt."""
    blocks = isotonic_blocks(scored, y, p)
    distinct = target.filter(F.col(p).isNotNull() & ~F.isnan(p)).select(F.col(p).cast("double").alias("_x")).distinct()
    mapped = interpolated(distinct, "_x", blocks).withColumnRenamed("value", out)
    return target.join(mapped, F.col(p).cast("double") == F.col("_x"), "left").drop("_x")
