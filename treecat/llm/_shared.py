"""Helpers that the operators share: ASCII folding, word splitting, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Spark's limit on the bytes of an Arrow batch, and the one that ``map_arrow`` sets.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Bytes 0-255 with A-Z folded to a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 of ``text`` with only A-Z folded; null is empty."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER) if text else b""


def space_words(text: str | None) -> list[bytes]:
    r"""Folded words ``[^\x20\x09-\x0D]+``; ``bytes.split`` splits at just those six bytes."""
    return lower_bytes(text).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a local session gets a folder below the temporary one;
    on a cluster that would lose data, so there it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not used before, in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at durable files."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str = "n", hot_rows: int = 100_000, most_hot: int = 100_000) -> DataFrame:
    """``left`` inner-joined to ``right``, which has one row a key and in ``rows`` how many rows of ``left`` have it.

    Keys with more than ``hot_rows`` rows are few (at most their share of the
    table) and meet by a broadcast, so no task gets all rows of one; the others
    are shuffled. More than ``most_hot`` such keys are left to the shuffle,
    where AQE splits them. ``left`` should be cheap to read twice.
    """
    hot = cut(right.where(F.col(rows) > hot_rows), "hot")
    if not 0 < hot.count() <= most_hot:
        return left.join(right, keys)
    some = F.broadcast(hot)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(rows) <= hot_rows), keys)
    return left.join(some, keys).unionByName(rest)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(f, schema)`` over batches of some ``BATCH_BYTES`` or one row.

    By its defaults of 10,000 rows and 64 MB a task holds tens of MB of text at
    once, in the executor and again in Python. The limit is the session's; one
    that the session has set itself stays. Python workers serve task after task,
    so one first gives back what tasks before it have freed.
    """
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from f(batches)

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system, of Arrow and, with glibc, of Python and numpy."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows, so that few long texts at a time become Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
