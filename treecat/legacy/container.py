"""Containers: a magic, a pointer to a Parquet footer that lists samples, and the samples' bytes."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import FormatError, NavigationError, TreecatError
from ..functions.paths import parse_subfile, subfile, to_vsi
from ..logs import logger
from ..operators.levels import q
from ..sources import files

# Fixed values of the format: magics of a bare container and of one with metadata, field places, column names.
BARE, FULL = b"#y", b"WX"
FOOTER_AT, METADATA_AT = 2, 26
OFFSET, LENGTH, KIND, NAME = "tortilla:offset", "tortilla:length", "tortilla:file_format", "tortilla:id"
NESTED, RAW = "TORTILLA", "BYTES"
POINTER = "internal:subfile"
PREFIXES = ("internal:", "tortilla:", "stac:", "rai:")


def footer_of(stream, start: int = 0) -> pa.Table:
    """The sample list of the container that begins at ``start`` of a seekable stream."""
    stream.seek(start)
    head = stream.read(18)
    if head[:2] not in (BARE, FULL):
        raise FormatError("the bytes do not open with a container's magic")
    offset, length = struct.unpack_from("<QQ", head, FOOTER_AT)
    stream.seek(start + offset)
    return pq.read_table(io.BytesIO(stream.read(length)))


def _footer(spark: SparkSession, path: str, start: int = 0) -> pa.Table:
    head = files.read_range(spark, path, start, 18)
    if head[:2] not in (BARE, FULL):
        raise FormatError(f"{path} does not open with a container's magic")
    offset, length = struct.unpack_from("<QQ", head, FOOTER_AT)
    return pq.read_table(io.BytesIO(files.read_range(spark, path, start + offset, length)))


def ordered_columns(columns: Sequence[str]) -> list[str]:
    """Columns by prefix: internal, container, sample, location, the rest."""
    place = lambda c: next((n for n, p in enumerate(PREFIXES) if c.startswith(p)), len(PREFIXES))
    return sorted(columns, key=place)


def _one(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    rows = spark.createDataFrame(_footer(spark, path, start))
    rows = rows.withColumn(OFFSET, q(OFFSET).cast("long") + start) if start else rows
    rows = rows.withColumn(POINTER, subfile(q(OFFSET), q(LENGTH), F.lit(to_vsi(path))))
    return rows.select(*map(q, ordered_columns(rows.columns)))


def load(paths: str | Sequence[str], spark: SparkSession | None = None) -> DataFrame:
    """The samples of one container, or of several, sorted by id; of several, unreadable ones are logged and left out."""
    spark = spark or SparkSession.builder.getOrCreate()
    if isinstance(paths, str):
        return _one(spark, paths)

    def one(path: str) -> DataFrame | None:
        try:
            return _one(spark, path)
        except TreecatError as e:
            logger.warning("%s is left out: %s", path, e)
            return None

    with ThreadPoolExecutor(8) as pool:  # footers are small reads
        found = [df for df in pool.map(one, paths) if df is not None]
    if not found:
        raise FormatError("none of the containers can be read")
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    return united.select(*map(q, ordered_columns(united.columns))).sort(q(NAME))


def load_metadata(paths: str | Sequence[str], spark: SparkSession | None = None) -> dict:
    """The metadata document of a full container; of a list, the first one's."""
    spark = spark or SparkSession.builder.getOrCreate()
    path = paths if isinstance(paths, str) else paths[0]
    head = files.read_range(spark, path, 0, METADATA_AT + 16)
    if head[:2] != FULL:
        raise FormatError(f"{path} has no metadata")
    offset, length = struct.unpack_from("<QQ", head, METADATA_AT)
    return json.loads(files.read_range(spark, path, offset, length))


def read(samples: DataFrame, key: int | str) -> DataFrame | bytes | str:
    """A nested container's samples, a raw sample's bytes, or else a pointer."""
    if isinstance(key, int):
        found = samples.orderBy(q(OFFSET)).offset(key).limit(1) if key >= 0 else samples.limit(0)
    else:
        found = samples.where(q(NAME) == F.lit(key)).limit(1)
    row = found.select(q(POINTER).alias("pointer"), q(KIND).alias("kind")).first()
    if row is None:
        raise NavigationError(f"no sample {key!r}")
    root, offset, size = parse_subfile(row["pointer"])
    if row["kind"] == NESTED:
        return _one(samples.sparkSession, root, offset)
    return files.read_range(samples.sparkSession, root, offset, size) if row["kind"] == RAW else row["pointer"]
