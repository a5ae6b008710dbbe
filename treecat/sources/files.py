"""Small reads on the driver through Hadoop's file systems: whatever Spark reads, this reads."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..errors import StorageError


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, where, fs = _open(spark, path)
    return bool(fs.exists(where))


def is_folder(spark: SparkSession, path: str) -> bool:
    _, where, fs = _open(spark, path)
    return bool(fs.exists(where)) and bool(fs.getFileStatus(where).isDirectory())


def size(spark: SparkSession, path: str) -> int:
    _, where, fs = _open(spark, path)
    if not fs.exists(where):
        raise StorageError(f"no such file: {path}")
    return int(fs.getFileStatus(where).getLen())


def version(spark: SparkSession, path: str) -> dict:
    """What tells a file's content apart from an earlier one's: its size, and its time as a tag."""
    _, where, fs = _open(spark, path)
    if not fs.exists(where):
        raise StorageError(f"no such file: {path}")
    status = fs.getFileStatus(where)
    return {"size": int(status.getLen()), "etag": str(status.getModificationTime())}


def read_range(spark: SparkSession, path: str, offset: int = 0, length: int | None = None) -> bytes:
    """Bytes [offset, offset + length) of a file, to its end without a length."""
    jvm, where, fs = _open(spark, path)
    if not fs.exists(where):
        raise StorageError(f"no such file: {path}")
    there = int(fs.getFileStatus(where).getLen())
    length = there - offset if length is None else length
    if offset < 0 or length < 0 or offset + length > there:
        raise StorageError(f"bytes {offset} ... {offset + length} are outside {path} ({there} bytes)")
    stream = fs.open(where)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def join(*parts: str) -> str:
    return "/".join([*(p.rstrip("/") for p in parts[:-1]), parts[-1]])


def write(spark: SparkSession, path: str, data: bytes, copied: Sequence[str] = (), tail: bytes = b"") -> None:
    """A new file: ``data``, then the bytes of the ``copied`` files, then ``tail``. The JVM copies through a buffer."""
    jvm, where, fs = _open(spark, path)
    stream = fs.create(where, False)
    try:
        stream.write(bytearray(data))
        for other in copied:
            _, there, its = _open(spark, other)
            source = its.open(there)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 20, False)
            finally:
                source.close()
        if tail:
            stream.write(bytearray(tail))
    finally:
        stream.close()


def only_part(spark: SparkSession, folder: str) -> str:
    """The one data file that Spark wrote below ``folder``."""
    _, where, fs = _open(spark, folder)
    found = [str(f.getPath()) for f in fs.listStatus(where) if str(f.getPath().getName()).startswith("part-")]
    if len(found) != 1:
        raise StorageError(f"{folder} has {len(found)} parts, not one")
    return found[0]


def joined_parquet(spark: SparkSession, folder: str, path: str) -> str:
    """One Parquet file of the row groups of all data files that Spark wrote below ``folder``, in their order.

    The JVM copies the row groups as they are, without decoding them, and
    writes a footer of all.
    """
    jvm, where, fs = _open(spark, folder)
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.parquet.hadoop
    parts = sorted((str(f.getPath()) for f in fs.listStatus(where) if str(f.getPath().getName()).startswith("part-")))
    if not parts:
        raise StorageError(f"{folder} has no parts")
    inputs = [hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(p), conf) for p in parts]
    reader = hadoop.ParquetFileReader.open(inputs[0])
    try:
        meta = reader.getFileMetaData()
    finally:
        reader.close()
    output = hadoop.util.HadoopOutputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
    writer = hadoop.ParquetFileWriter(output, meta.getSchema(), hadoop.ParquetFileWriter.Mode.CREATE, 128 << 20, 0)
    writer.start()
    for one in inputs:
        writer.appendFile(one)
    writer.end(meta.getKeyValueMetaData())
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A path not used before, in the folder that all executors share.

    A local session that names none gets one below the temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise StorageError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return join(base, f"{name}-{uuid.uuid4().hex}")
