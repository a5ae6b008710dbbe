"""The collection document of a catalog."""

from __future__ import annotations

import copy
import json
from collections import OrderedDict
from typing import Any

from pyspark.sql import SparkSession

from ..constants import TREE_KEY
from ..errors import FormatError, SchemaError
from ..schema import TreeSchema
from . import cache, files

_seen: OrderedDict[str, dict] = OrderedDict()
_MOST = 64


def parse(raw: bytes, where: str) -> dict[str, Any]:
    try:
        found = json.loads(raw)
    except ValueError as e:
        raise FormatError(f"{where} is not JSON: {e}") from e
    if not isinstance(found, dict):
        raise FormatError(f"{where} is not a JSON object")
    return found


def read(spark: SparkSession, path: str) -> dict[str, Any]:
    """The document at ``path``; the last 64 are remembered, remote ones on disk too, for as long as their size and time stay."""
    if path not in _seen:
        _seen[path] = parse(_remote(spark, path) if "://" in path and not path.startswith("file:") else files.read_range(spark, path), path)
        while len(_seen) > _MOST:
            _seen.popitem(last=False)
    _seen.move_to_end(path)
    return copy.deepcopy(_seen[path])


def _remote(spark: SparkSession, path: str) -> bytes:
    folder, _, name = path.rpartition("/")
    return cache.fetch(folder, [name], lambda n: files.read_range(spark, f"{folder}/{n}"), files.version(spark, path))[name].read_bytes()


def forget() -> None:
    _seen.clear()


def tree_of(document: dict[str, Any]) -> TreeSchema:
    if TREE_KEY not in document:
        raise SchemaError(f"the collection has no {TREE_KEY}")
    return TreeSchema.from_dict(document[TREE_KEY])
