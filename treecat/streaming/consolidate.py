"""Incremental consolidation: part tables that arrive in a folder are appended to a level table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import SOURCE_FILE
from ..operators.levels import without_padding


def stream_level(spark: SparkSession, incoming: str, schema, target: str, checkpoint: str, hide_padding: bool = False) -> StreamingQuery:
    """Append each new Parquet part in ``incoming`` to the level table ``target``, once, and stop when none is left.

    A row's source file is its part's name, so links stay unambiguous. Offsets
    and commits are in ``checkpoint``: a restart neither drops nor repeats parts.
    """
    rows = spark.readStream.schema(schema).parquet(incoming)
    rows = rows.withColumn(SOURCE_FILE, F.element_at(F.split(F.input_file_name(), "/"), -1))
    rows = without_padding(rows) if hide_padding else rows
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(rows: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Samples per day of a stream (or a table); days close ``late`` after the newest sample."""
    day = F.window(F.col(f"`{time}`").cast("timestamp"), "1 day")
    return rows.withColumn(time, F.col(f"`{time}`").cast("timestamp")).withWatermark(time, late).groupBy(day.alias("day")).agg(F.count("*").alias("samples")) if rows.isStreaming else rows.groupBy(day.alias("day")).agg(F.count("*").alias("samples"))
