"""Which layout a path has, and what older layouts are called."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from .. import constants as C
from ..errors import FormatError
from . import files


def by_name(path: str) -> str:
    """The layout a name alone suggests."""
    last = path.rstrip("/").rsplit("/", 1)[-1]
    if last == C.CONSOLIDATED_FOLDER:
        return C.CONSOLIDATED
    return C.ARCHIVE if last.lower().endswith(C.ARCHIVE_SUFFIXES) else C.PLAIN


#: A name in a dataset registry, such as ``registry:dataset``: neither a scheme with a path nor a drive letter.
_REGISTERED = re.compile(r"[A-Za-z][\w.+-]+:(?!/)")


def refuse_legacy(path: str) -> None:
    """An error that says what to do, for names of the first format generation: its suffixes, and names in a registry."""
    if _REGISTERED.match(path) or path.rstrip("/").lower().endswith(C.LEGACY_SUFFIXES):
        raise FormatError(f"{path} has the first-generation format: read it with treecat.legacy.load")


def detect(spark: SparkSession, path: str) -> tuple[str, str]:
    """(layout, path of its root). A consolidated copy inside a folder comes before the folder itself."""
    refuse_legacy(path)
    named = by_name(path)
    if named != C.PLAIN:
        return named, path.rstrip("/")
    inside = files.join(path, C.CONSOLIDATED_FOLDER)
    if files.exists(spark, files.join(inside, C.COLLECTION)):
        return C.CONSOLIDATED, inside
    if files.exists(spark, files.join(path, C.COLLECTION)):
        return C.PLAIN, path.rstrip("/")
    raise FormatError(f"{path} has no {C.COLLECTION}, nor is it an archive")


def detect_root_first(spark: SparkSession, path: str) -> str:
    """The layout, with a folder's own collection before a consolidated copy inside it."""
    named = by_name(path)
    if named == C.PLAIN and not files.exists(spark, files.join(path, C.COLLECTION)):
        return C.CONSOLIDATED if files.exists(spark, files.join(path, C.CONSOLIDATED_FOLDER, C.COLLECTION)) else C.PLAIN
    return named
