"""Sanity checks: a user's function over every sample, in Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.paths import from_vsi, parse_subfile
from ..operators.levels import q
from ..sources.streams import open_input
from .container import KIND, LENGTH, NAME, NESTED, OFFSET, POINTER, footer_of


def nested_samples(pointer: str) -> Iterator[tuple[str, str, str]]:
    """(id, kind, pointer) of the samples of the container that a pointer leads to."""
    root, start, _ = parse_subfile(pointer)
    with open_input(from_vsi(root)) as stream:
        rows = footer_of(stream, start).select([NAME, KIND, OFFSET, LENGTH]).to_pylist()
    for r in rows:
        yield r[NAME], r[KIND], f"/vsisubfile/{r[OFFSET] + start}_{r[LENGTH]},{root}"


def sanity_check(samples: DataFrame, read_function: Callable[[str], object], partitions: int | None = None) -> DataFrame:
    """``(id, error)`` of the samples whose pointer the function cannot read.

    Containers inside are opened and their samples checked, at any depth; such
    a sample's id is the path of ids to it. A container that cannot be opened is
    an error of its own.
    """
    kind = q(KIND) if KIND in samples.columns else F.lit(None).cast("string")
    rows = samples.select(q(NAME).alias("id"), kind.alias("kind"), q(POINTER).alias("pointer"))
    rows = rows.repartition(partitions) if partitions else rows

    def failures(name: str, kind: str | None, pointer: str) -> Iterator[tuple[str, str]]:
        try:
            if kind != NESTED:
                read_function(pointer)
                return
            inside = list(nested_samples(pointer))
        except Exception as e:  # noqa: BLE001  whatever the user's function raises is the finding
            yield name, f"{type(e).__name__}: {e}"
            return
        for below, its, at in inside:
            yield from failures(f"{name}/{below}", its, at)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [x for row in zip(b["id"], b["kind"], b["pointer"]) for x in failures(*row)]
            yield pd.DataFrame(found, columns=["id", "error"])

    return rows.mapInPandas(check, "id string, error string")
