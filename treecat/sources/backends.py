"""Scans of the three layouts, behind one interface."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession

from .. import constants as C
from ..errors import FormatError, StorageError
from ..operators.levels import q
from . import archive, collection, files


class Backend(ABC):
    """One layout: its name, and what a path of it holds."""

    format: str

    @abstractmethod
    def scan(self, spark: SparkSession, path: str, columns: dict[int, list[str]] | None = None, **hooks: str | None) -> tuple[dict, dict[int, DataFrame]]:
        """(collection document, raw level tables by number); ``columns`` are those wanted of a level, all if it is not named."""

    def root(self, path: str, base_path: str | None) -> str:
        """Where the samples' bytes are."""
        if base_path is not None:
            raise FormatError(f"base_path goes with the consolidated layout, not with {self.format!r}")
        return path


def chosen(levels: dict[int, DataFrame], columns: dict[int, list[str]] | None) -> dict[int, DataFrame]:
    """The levels with their wanted columns alone."""
    return {n: df.select(*(q(c) for c in df.columns if c in columns[n])) if n in (columns or {}) else df for n, df in levels.items()}


class PlainFolder(Backend):
    """``COLLECTION.json`` and ``METADATA/level{n}.parquet``, up to the first gap."""

    format = C.PLAIN

    def scan(self, spark: SparkSession, path: str, columns: dict[int, list[str]] | None = None, **hooks: str | None) -> tuple[dict, dict[int, DataFrame]]:
        document = collection.read(spark, files.join(path, C.COLLECTION))
        if not files.is_folder(spark, files.join(path, "METADATA")):
            raise StorageError(f"{path} has no METADATA folder")
        levels = {}
        for n in range(C.MAX_LEVELS):
            where = files.join(path, "METADATA", f"level{n}.parquet")
            if not files.exists(spark, where):
                break
            levels[n] = spark.read.parquet(where)
        if not levels:
            raise StorageError(f"{path} has no level 0")
        return document, chosen(levels, columns)


class Consolidated(Backend):
    """``COLLECTION.json`` and ``level{n}.parquet`` of many archives side by side; levels may be missing."""

    format = C.CONSOLIDATED

    def scan(self, spark: SparkSession, path: str, columns: dict[int, list[str]] | None = None, **hooks: str | None) -> tuple[dict, dict[int, DataFrame]]:
        document = collection.read(spark, files.join(path, C.COLLECTION))
        names = {n: files.join(path, f"level{n}.parquet") for n in range(C.MAX_LEVELS)}
        levels = {n: spark.read.parquet(p) for n, p in names.items() if files.exists(spark, p)}
        if 0 not in levels:
            raise StorageError(f"{path} has no level 0")
        return document, chosen(levels, columns)

    def root(self, path: str, base_path: str | None) -> str:
        if base_path is not None:
            return base_path
        return path.rstrip("/").removesuffix(C.CONSOLIDATED_FOLDER).rstrip("/") or "/"


class Archive(Backend):
    format = C.ARCHIVE

    def scan(self, spark: SparkSession, path: str, columns: dict[int, list[str]] | None = None, **hooks: str | None) -> tuple[dict, dict[int, DataFrame]]:
        return archive.scan(spark, path, columns, **hooks)


BACKENDS: dict[str, Backend] = {b.format: b for b in (PlainFolder(), Consolidated(), Archive())}


def create_backend(kind: str) -> Backend:
    if kind not in BACKENDS:
        raise FormatError(f"{kind!r} is not one of the layouts {sorted(BACKENDS)}")
    return BACKENDS[kind]
