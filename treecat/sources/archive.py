"""Single-file archives, and ``catalog_archive``, the Spark source that reads their levels.

Layout: a header of 256 bytes, then blocks. The header is ``TREECAT1``, the
number of entries (u64) and (offset, size) pairs (u64 each), little-endian,
filled with zeros. The last entry is the collection document, those before it
the level tables as Parquet; an entry of size 0 is a missing level. Archives
with another header are read through a hook, ``"module:function"``: it gets the
stream and returns the same list of (offset, size).

A level table is read in place. Footers are read by the driver for a few
archives and by tasks for many; row groups become partitions, small ones
together. A task reads the column chunks it needs and no others, near ones in
one request, through streams that need no JVM (``sources/streams.py``).

Spark hands a Python source its filters but not the columns a query needs. So
filters skip row groups by their statistics (and Spark applies them again), and
columns are chosen by whoever loads: ``columns`` of :func:`treecat.load`, or
``.schema(...)`` on the reader.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema

from ..constants import COLLECTION
from ..errors import FormatError, StorageError
from ..operators.ranges import plan_ranges
from . import collection
from .streams import _Ranged, named, open_input, window

HEADER = 256
MAGIC = b"TREECAT1"
MOST_ENTRIES = (HEADER - 16) // 16


def pack_header(entries: list[tuple[int, int]]) -> bytes:
    if len(entries) > MOST_ENTRIES:
        raise FormatError(f"a header holds {MOST_ENTRIES} entries, not {len(entries)}")
    flat = [x for e in entries for x in e]
    return (MAGIC + struct.pack(f"<Q{len(flat)}Q", len(entries), *flat)).ljust(HEADER, b"\0")


def read_header(raw: bytes) -> list[tuple[int, int]]:
    if len(raw) < HEADER or raw[:8] != MAGIC:
        raise FormatError("the file does not open with an archive header")
    (n,) = struct.unpack_from("<Q", raw, 8)
    if not 0 < n <= MOST_ENTRIES:
        raise FormatError(f"the archive header declares {n} entries")
    flat = struct.unpack_from(f"<{2 * n}Q", raw, 16)
    return list(zip(flat[::2], flat[1::2]))


#: Bytes of level table that one task reads, and archives whose footers the driver reads.
TASK_BYTES, FEW = 64 << 20, 32
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

#: What tasks of this process have read: (path, level's offset, row group, columns, requests). For tests.
READS: list[tuple] = []


def _parquet(stream, offset: int, size: int) -> pq.ParquetFile:
    return pq.ParquetFile(pa.PythonFile(window(stream, offset, size), mode="r"))


def chunk_ranges(meta: pq.FileMetaData, group: int, columns: Iterable[str]) -> list[tuple[int, int]]:
    """(offset, size) of the wanted columns' chunks in a row group, in order."""
    wanted, found = set(columns), []
    for i in range(meta.num_columns):
        c = meta.row_group(group).column(i)
        if c.path_in_schema.split(".")[0] in wanted or c.path_in_schema in wanted:
            start = c.data_page_offset if c.dictionary_page_offset is None else min(c.dictionary_page_offset, c.data_page_offset)
            found.append((start, c.total_compressed_size))
    return sorted(found)


def prefetched(stream, offset: int, size: int, ranges: list[tuple[int, int]]):
    """The window on a level table with the ranges in memory, near ones fetched by one request, and the number of requests."""
    held = []
    for group in plan_ranges(ranges):
        start, end = ranges[group[0]][0], max(sum(ranges[n]) for n in group)
        stream.seek(offset + start)
        held.append((start, stream.read(end - start)))
    inner = window(stream, offset, size)

    def fetch(a: int, b: int) -> bytes:
        for start, data in held:
            if start <= a and b <= start + len(data):
                return data[a - start : b - start]
        inner.seek(a)
        return inner.read(b - a)

    return _Ranged(size, fetch), len(held)


def _may_hold(f: Filter, meta: pq.RowGroupMetaData, places: dict[str, int]) -> bool:
    """Whether a row group can have rows that pass; true where its statistics do not say."""
    name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
    stats = meta.column(places[name]).statistics if name in places else None
    if stats is None or not stats.has_min_max:
        return True
    low, high = stats.min, stats.max
    try:
        if isinstance(f, EqualTo):
            return low <= f.value <= high
        if isinstance(f, In):
            return any(low <= v <= high for v in f.value if v is not None)
        if isinstance(f, GreaterThan):
            return high > f.value
        if isinstance(f, GreaterThanOrEqual):
            return high >= f.value
        if isinstance(f, LessThan):
            return low < f.value
        if isinstance(f, LessThanOrEqual):
            return low <= f.value
    except TypeError:  # statistics and value of different kinds
        return True
    return True


def _groups(meta: pq.FileMetaData, filters: list[Filter]) -> list[int]:
    places = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
    return [g for g in range(meta.num_row_groups) if all(_may_hold(f, meta.row_group(g), places) for f in filters)]


@dataclass
class _Part(InputPartition):
    """Row groups of one archive's level; all of them without a list."""

    path: str
    offset: int
    size: int
    groups: list[int] | None


class ArchiveSource(DataSource):
    """Options: ``places``, a JSON list of [path, offset, size] of level tables of one schema, and ``opener``."""

    @classmethod
    def name(cls) -> str:
        return "catalog_archive"

    def _places(self) -> list:
        return json.loads(self.options["places"])

    def schema(self):
        path, offset, size = self._places()[0]
        with open_input(path, self.options.get("opener")) as stream:
            return from_arrow_schema(_parquet(stream, offset, size).schema_arrow)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._places(), schema.names, self.options.get("opener"))


class _Reader(DataSourceReader):
    def __init__(self, places: list, columns: list[str], opener: str | None):
        self.places, self.columns, self.opener, self.filters = places, columns, opener, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Used to skip row groups; Spark checks every row again."""
        self.filters = list(filters)
        return filters

    def partitions(self) -> list[InputPartition]:
        if len(self.places) > FEW:
            return [_Part(*place, None) for place in self.places]
        parts: list[InputPartition] = []
        for path, offset, size in self.places:
            with open_input(path, self.opener) as stream:
                meta = _parquet(stream, offset, size).metadata
            held, weight = [], 0
            for g in _groups(meta, self.filters):
                held.append(g)
                weight += sum(n for _, n in chunk_ranges(meta, g, self.columns))
                if weight >= TASK_BYTES:
                    parts.append(_Part(path, offset, size, held))
                    held, weight = [], 0
            if held:
                parts.append(_Part(path, offset, size, held))
        return parts or [_Part(*self.places[0], [])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        with open_input(partition.path, self.opener) as stream:
            meta = _parquet(stream, partition.offset, partition.size).metadata
            for g in _groups(meta, self.filters) if partition.groups is None else partition.groups:
                buffered, requests = prefetched(stream, partition.offset, partition.size, chunk_ranges(meta, g, self.columns))
                READS.append((partition.path, partition.offset, g, tuple(self.columns), requests))
                file = pq.ParquetFile(pa.PythonFile(buffered, mode="r"), metadata=meta)
                for batch in file.iter_batches(row_groups=[g], columns=self.columns):
                    yield batch.select(self.columns)


def entries_of(path: str, header: str | None = None, opener: str | None = None) -> list[tuple[int, int]]:
    """The archive's (offset, size) list, by its own header or by the hook ``header``."""
    try:
        with open_input(path, opener) as stream:
            return list(named(header)(stream)) if header else read_header(stream.read(HEADER))
    except OSError as e:
        raise StorageError(f"{path} cannot be read: {e}") from e


def scan(spark: SparkSession, path: str, columns: dict[int, list[str]] | None = None, header: str | None = None, opener: str | None = None) -> tuple[dict, dict[int, DataFrame]]:
    """(collection document, level tables) of an archive; ``columns`` limits what is read of a level.

    Switches Spark's filter push-down to Python sources on, which is off by default.
    """
    entries = entries_of(path, header, opener)
    offset, size = entries[-1]
    with open_input(path, opener) as stream:
        stream.seek(offset)
        document = collection.parse(stream.read(size), f"{COLLECTION} in {path}")
    spark.dataSource.register(ArchiveSource)
    spark.conf.set(PUSHDOWN, "true")
    more = {"opener": opener} if opener else {}
    levels = {}
    for n, (o, s) in enumerate(entries[:-1]):
        if s:
            found = spark.read.format("catalog_archive").options(places=json.dumps([[path, o, s]]), **more)
            whole = found.load()
            wanted = (columns or {}).get(n)
            keep = None if wanted is None else [f for f in whole.schema if f.name in wanted]
            levels[n] = whole if keep is None else found.schema(type(whole.schema)(keep)).load()
    if 0 not in levels:
        raise FormatError(f"{path} has no level 0")
    return document, levels


def requests(path: str, header: str | None = None, opener: str | None = None) -> list[list[int]]:
    """Which header entries one range request would fetch together."""
    return plan_ranges(entries_of(path, header, opener))


def archive_bytes(levels: list[bytes], document: bytes, blocks: bytes = b"") -> bytes:
    """A small archive: header, ``blocks`` of data, level tables (Parquet bytes), the document."""
    at, entries, out = HEADER + len(blocks), [], []
    for part in [*levels, document]:
        entries.append((at, len(part)))
        out.append(part)
        at += len(part)
    return b"".join([pack_header(entries), blocks, *out])
