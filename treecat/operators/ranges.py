"""Byte ranges: coalescing of near ones, and offsets after compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as C
from ..sources import files


def coalesce_ranges(df: DataFrame, partition: list[str] | None = None, entry: str = "entry", offset: str = "offset", size: str = "size") -> DataFrame:
    """``df`` without empty ranges, with ``range_group``: entries fetched by one request.

    An entry joins the one before it when the gap is under 4 MiB and at most
    half of both sizes together. ``partition`` names the columns of an
    archive, so that many archives are planned at once.
    """
    df = df.where(F.col(size) > 0)
    w = Window.partitionBy(*(partition or [])).orderBy(entry, offset, size)
    end = F.lag(F.col(offset) + F.col(size)).over(w)
    gap = F.col(offset) - end
    near = (gap < C.MERGE_GAP) & (gap <= C.MERGE_WASTE * (F.col(size) + F.lag(size).over(w)))
    starts = F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)
    return df.withColumn("__starts", starts).withColumn("range_group", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__starts")


def plan_ranges(entries: list[tuple[int, int]]) -> list[list[int]]:
    """The same rule for one header's few entries: lists of entry numbers."""
    groups: list[list[int]] = []
    for n, (offset, size) in enumerate(entries):
        if not size:
            continue
        if groups:
            last, length = entries[groups[-1][-1]]
            gap = offset - last - length
            if gap < C.MERGE_GAP and gap <= C.MERGE_WASTE * (size + length):
                groups[-1].append(n)
                continue
        groups.append([n])
    return groups


def running_offset(df: DataFrame, order: str, length: str, start: int = 200, partition: list[str] | None = None, name: str = "new_offset") -> DataFrame:
    """Where each block lands when blocks are packed in ``order`` behind a preamble of ``start`` bytes.

    Without ``partition`` all blocks go into one container: the range-sorted
    rows are written once with their partition's number, and a partition starts
    behind the lengths of those before it, so no task sees all rows.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if partition:
        w = before(Window.partitionBy(*partition).orderBy(order))
        return df.withColumn(name, F.coalesce(F.sum(length).over(w), F.lit(0)) + start)
    spark = df.sparkSession
    path = files.scratch(spark, "offsets")
    ranged = df.orderBy(order).withColumn("__row", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    written = spark.read.schema(ranged.schema).parquet(path).withColumn("__part", F.shiftright("__row", 33))
    sums = written.groupBy("__part").agg(F.sum(length).alias("__sum"))
    starts = sums.select("__part", F.coalesce(F.sum("__sum").over(before(Window.orderBy("__part"))), F.lit(0)).alias("__start"))  # one row per sorted partition
    inside = F.coalesce(F.sum(length).over(before(Window.partitionBy("__part").orderBy("__row"))), F.lit(0))
    return written.withColumn("__inside", inside).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__inside") + start).drop("__part", "__row", "__inside", "__start")
