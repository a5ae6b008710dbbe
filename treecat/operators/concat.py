"""Concatenation of datasets: validate, settle columns, unite level by level."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, functions as F, types as T

from .. import constants as C
from ..errors import QueryError, SchemaError
from ..functions.paths import to_vsi
from ..schema import merge
from .levels import children_of, q, with_pointer

if TYPE_CHECKING:
    from ..dataset import Dataset

MODES = ("intersection", "fill_missing", "strict")


def check(datasets: Sequence[Dataset], mode: str) -> None:
    if len(datasets) < 2:
        raise QueryError("concat takes two datasets or more")
    if mode not in MODES:
        raise QueryError(f"column_mode is one of {MODES}, not {mode!r}")
    first = datasets[0]
    for n, d in enumerate(datasets):
        if not d.is_rsut():
            raise SchemaError(f"dataset {n} is not structurally homogeneous")
    for n, d in enumerate(datasets):
        if d.backend != first.backend:
            raise QueryError(f"dataset {n} has the frame backend {d.backend!r}, the first {first.backend!r}")
    for n, d in enumerate(datasets):
        if d.format != first.format:
            raise SchemaError(f"dataset {n} has the format {d.format!r}, the first {first.format!r}")
    for n, d in enumerate(datasets):
        if not d.schema.is_compatible(first.schema):
            raise SchemaError(f"the tree of dataset {n} differs from the first")


def settle_columns(columns: Sequence[Sequence[str]], kind: str, level: int, mode: str) -> list[str]:
    """The united level's columns, sorted."""
    need = (C.CRITICAL_DEEPER if level else C.CRITICAL_ROOT)[kind]
    for n, have in enumerate(columns):
        if missing := need - set(have):
            raise SchemaError(f"dataset {n} lacks {sorted(missing)} at level {level}")
    sets = [set(c) for c in columns]
    if mode == "strict" and any(s != sets[0] for s in sets):
        odd = sorted(set.union(*sets) - set.intersection(*sets))
        raise SchemaError(f"columns differ at level {level}: {odd}")
    return sorted(set.union(*sets) if mode == "fill_missing" else set.intersection(*sets))


def unite(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """UNION ALL by name; a column that is text in one frame and not in another is text in all."""
    text = {
        c
        for c in columns
        if len({type(f.schema[c].dataType) for f in frames if c in f.columns}) > 1
        and any(isinstance(f.schema[c].dataType, T.StringType) for f in frames if c in f.columns)
    }
    cast = lambda f, c: q(c).cast("string").alias(c) if c in text else q(c)
    parts = [f.select(*(cast(f, c) for c in columns if c in f.columns)) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*(q(c) for c in columns))


def concat(datasets: Sequence[Dataset], column_mode: str = "intersection") -> Dataset:
    """One dataset of all samples of all datasets, as their filters left them.

    Level 0 is each dataset's current selection; deeper levels are what hangs
    below it. The first dataset gives the metadata.
    """
    datasets = list(datasets)
    check(datasets, column_mode)
    first, levels = datasets[0], {}
    own: list[DataFrame] = []
    for level in range(1 + max(max(d.levels) for d in datasets)):
        now = []
        for d, above in zip(datasets, own or [None] * len(datasets)):
            frame = d.current if not level else d.filtered.get(level, d.levels[level])
            frame = frame.drop(C.GDAL_VSI, C.ORDER)
            if C.SOURCE_PATH not in frame.columns:
                frame = frame.withColumn(C.SOURCE_PATH, F.lit(to_vsi(d.root)))
            now.append(children_of(above, frame) if level else frame)
        own = now
        columns = settle_columns([f.columns for f in own], first.format, level, column_mode)
        levels[level] = with_pointer(unite(own, columns), first.format, first.root, level)
    return first.replace(
        path="<concatenated>", levels=levels, current=levels[0], filtered={}, schema=merge(d.schema for d in datasets),
        rsut=True, joined=frozenset(), extent_modified=False,
    )
