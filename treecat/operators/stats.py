"""Aggregation of pre-computed statistics cells, weighted by pixel counts.

A cell is an array over bands. A continuous band has the nine values of
``constants.CELL``; any other length is a categorical band, one share per class
(a categorical band of nine classes cannot be told from a continuous one).
Every aggregate is one pass (the deviation two) over exploded bands with partial aggregation; only
bands x values numbers reach the driver, as float32.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..errors import QueryError
from .levels import q


def stats_column(columns: list[str]) -> str:
    for name in C.STATS_COLUMNS:
        if name in columns:
            return name
    raise QueryError(f"no statistics column among {columns}; one of {C.STATS_COLUMNS} is looked for")


def pixel_weight(df: DataFrame) -> Column:
    """Product of a shape's last two numbers; 1 without a shape of two dimensions."""
    if C.SHAPE_COLUMN not in df.columns:
        return F.lit(1.0)
    s = q(C.SHAPE_COLUMN)
    return F.when(F.size(s) >= 2, F.element_at(s, -1).cast("double") * F.element_at(s, -2).cast("double")).otherwise(1.0)


def bands(df: DataFrame, column: str | None = None) -> DataFrame:
    """``(band, w, v)`` of every band of every non-empty cell, values as float32."""
    column = column or stats_column(df.columns)
    cells = df.where(F.size(q(column)) > 0).select(q(column).cast("array<array<float>>").alias("cell"), pixel_weight(df).alias("w"))
    return cells.select("w", F.posexplode("cell").alias("band", "v"))


def _value(name: str) -> Column:
    return F.get("v", F.lit(C.CELL.index(name))).cast("double")


def _lowest(c: Column) -> Column:
    """Minimum that is NaN if any value is."""
    return F.when(F.max(F.isnan(c)), F.lit(float("nan"))).otherwise(F.min(c))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / F.nullif(b, F.lit(0.0)))


AGGREGATES = {
    "min": lambda: _lowest(_value("min")),
    "max": lambda: F.max(_value("max")),
    "mean": lambda: _ratio(F.sum(F.col("w") * _value("mean")), F.sum("w")),
    **{p: (lambda p=p: F.avg(_value(p))) for p in ("p25", "p50", "p75", "p95")},
}


def pooled_std(long: DataFrame) -> DataFrame:
    """``(band, value)`` of ``bands`` rows in two steps: the bands' weighted means, then squares around them.

    Squares around zero would cancel where means are large beside deviations.
    There is one mean per band, and a cell holds all bands in one row, so the
    means are few and broadcast.
    """
    w, m, s = F.col("w"), _value("mean"), _value("std")
    centre = long.groupBy("band").agg(_ratio(F.sum(w * m), F.sum(w)).alias("centre"))
    away = long.join(F.broadcast(centre), "band")
    squares = F.sum((w - 1) * s * s + w * (m - F.col("centre")) ** 2)
    return away.groupBy("band").agg(F.sqrt(_ratio(squares, F.sum(w) - 1)).alias("value"))


def continuous(df: DataFrame, what: str, column: str | None = None) -> DataFrame:
    """``(band, value)`` of one aggregate over continuous cells.

    min and max are unweighted, the mean is weighted, the standard deviation
    is pooled, percentiles are plain means. A total weight of 1 has no
    standard deviation (NaN).
    """
    long = bands(df, column)
    return pooled_std(long) if what == "std" else long.groupBy("band").agg(AGGREGATES[what]().alias("value"))


def categorical(df: DataFrame, column: str | None = None) -> DataFrame:
    """``(band, class, value)``: weighted mean share of each class."""
    long = bands(df, column).select("band", "w", F.posexplode("v").alias("class", "share"))
    return long.groupBy("band", "class").agg(_ratio(F.sum(F.col("w") * F.col("share").cast("double")), F.sum("w")).alias("value"))


def widths(df: DataFrame, column: str | None = None) -> tuple[int | None, int | None]:
    """(narrowest, widest) band of all cells."""
    row = bands(df, column).agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    return row[0], row[1]


def check_kind(df: DataFrame, want_continuous: bool, column: str | None = None) -> None:
    low, high = widths(df, column)
    if low is None:
        raise QueryError("there are no statistics to aggregate")
    if low != high:
        raise QueryError(f"cells of {low} and of {high} values are mixed")
    if (low == len(C.CELL)) != want_continuous:
        raise QueryError(f"the cells are {'continuous' if not want_continuous else 'categorical'}")


def aggregate(df: DataFrame, what: str) -> np.ndarray:
    """float32 values by band, for ``categorical`` a bands x classes matrix."""
    check_kind(df, what != "categorical")
    rows = (categorical(df) if what == "categorical" else continuous(df, what)).collect()
    shape = tuple(1 + max(r[k] for r in rows) for k in range(2 if what == "categorical" else 1))
    out = np.full(shape, np.nan, np.float32)
    for r in rows:
        out[tuple(r[k] for k in range(len(shape)))] = r["value"]
    return out


def pick(values: np.ndarray, band: int | list[int]):
    """One band as a number (or class vector), a list of bands as an array in that order."""
    for b in [band] if isinstance(band, int) else band:
        if not 0 <= b < len(values):
            raise QueryError(f"band {b} is outside 0 ... {len(values) - 1}")
    one = values[band]
    return float(one) if np.ndim(one) == 0 else one
