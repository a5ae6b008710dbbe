"""Compilation: a selection of samples becomes a container of its own.

New offsets come from sums over range-sorted partitions. Tasks copy the bytes:
each writes its samples at their places in the new file, which must be on a
file system that driver and tasks share; a repeated task writes the same bytes
again. Spark writes the footer, and only its header passes the driver.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.paths import from_vsi, parse_subfile
from ..operators.levels import q
from ..operators.ranges import running_offset
from ..sources import files
from ..sources.streams import open_input
from .container import BARE, FULL, LENGTH, METADATA_AT, OFFSET, POINTER

PREAMBLE = 200


def planned(samples: DataFrame) -> DataFrame:
    """The samples with ``new_offset``: packed in the order of their old offsets, behind the preamble."""
    return running_offset(samples.withColumn("__at", q(OFFSET)).withColumn("__n", q(LENGTH)), "__at", "__n", PREAMBLE).drop("__at", "__n")


def copied(plan: DataFrame, path: str, chunk: int) -> int:
    """Bytes that tasks have copied to the file ``path``, piece by piece, never a sample whole."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        out = os.open(path, os.O_WRONLY)
        try:
            for b in batches:
                for pointer, to in zip(b.column("pointer").to_pylist(), b.column("new_offset").to_pylist()):
                    root, offset, size = parse_subfile(pointer)
                    with open_input(from_vsi(root)) as source:
                        source.seek(offset)
                        for at in range(0, size, chunk):
                            piece = source.read(min(chunk, size - at))
                            if not piece:
                                raise EOFError(f"{root} ends before {pointer}")
                            os.pwrite(out, piece, to + at)
                    done += size
            os.fsync(out)
        finally:
            os.close(out)
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["bytes"])

    rows = plan.select(q(POINTER).alias("pointer"), "new_offset")
    return rows.mapInArrow(copy, "bytes long").agg(F.sum("bytes")).first()[0] or 0


def compile_subset(samples: DataFrame, path: str, metadata: dict | None = None, chunk: int = 8 << 20) -> str:
    """Write a container of the samples at ``path``."""
    spark = samples.sparkSession
    where = files.scratch(spark, "plan")
    plan = planned(samples)
    plan.write.parquet(where)
    plan = spark.read.schema(plan.schema).parquet(where)
    end = PREAMBLE + (plan.agg(F.sum(q(LENGTH))).first()[0] or 0)
    with open(path, "wb") as f:
        f.truncate(end)
    if copied(plan, os.path.abspath(path), chunk) != end - PREAMBLE:
        raise OSError(f"not all bytes of {path} were copied")
    table = files.scratch(spark, "footer")
    footer = plan.withColumn(OFFSET, F.col("new_offset")).drop(POINTER, "new_offset").orderBy(q(OFFSET)).coalesce(1)
    footer.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "22").parquet(table)
    part, document = files.only_part(spark, table), json.dumps(metadata).encode() if metadata is not None else b""
    size = files.size(spark, part)
    with open(path, "r+b") as f:
        f.seek(end)
        for at in range(0, size, chunk):
            f.write(files.read_range(spark, part, at, min(chunk, size - at)))
        f.write(document)
        f.seek(0)
        f.write((FULL if document else BARE) + struct.pack("<QQ", end, size))
        if document:
            f.seek(METADATA_AT)
            f.write(struct.pack("<QQ", end + size, len(document)))
    return path
