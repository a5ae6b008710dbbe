"""Frames: rows of one level, in order, from which one descends to children or to a sample's bytes.

A frame is lazy. Positions follow the frame's order columns. Results leave by
``to_arrow``, ``to_pandas``, ``to_polars`` or as the Spark DataFrame itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, GroupedData, Window, functions as F

from . import constants as C
from .errors import BackendError, NavigationError
from .operators.levels import children_of, order_columns, q
from .sources import files

_adapters: dict[str, Callable[[DataFrame], Any]] = {}


def register_backend(name: str, convert: Callable[[DataFrame], Any]) -> None:
    """What ``Frame.collect`` gives for datasets loaded with ``backend=name``."""
    _adapters[name] = convert


def available_backends() -> list[str]:
    return sorted(_adapters)


def _polars(df: DataFrame) -> Any:
    try:
        import polars
    except ImportError as e:
        raise BackendError("polars is not installed") from e
    return polars.from_arrow(df.toArrow())


register_backend("spark", lambda df: df)
register_backend("arrow", lambda df: df.toArrow())
register_backend("pandas", lambda df: df.toPandas())
register_backend("polars", _polars)


class _Indexer:
    def __init__(self, get: Callable[[Any], DataFrame]):
        self._get = get

    def __getitem__(self, key: Any) -> DataFrame:
        return self._get(key)


class Frame:
    def __init__(self, full: DataFrame, visible: Sequence[str], below: dict[int, DataFrame], level: int, backend: str = "arrow", order: Sequence[Column] | None = None):
        self._full, self._visible, self._below = full, list(visible), below
        self.level, self.backend = level, backend
        self._order = list(order) if order else [q(c) for c in order_columns(full)]

    def _with(self, full: DataFrame | None = None, visible: Sequence[str] | None = None, order: Sequence[Column] | None = None) -> Frame:
        return Frame(full if full is not None else self._full, visible or self._visible, self._below, self.level, self.backend, order or self._order)

    # --- shape and output --------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return list(self._visible)

    @property
    def df(self) -> DataFrame:
        """The rows as a Spark DataFrame, in no particular order."""
        return self._full.select(*map(q, self._visible))

    def ordered(self) -> DataFrame:
        return (self._full.orderBy(*self._order) if self._order else self._full).select(*map(q, self._visible))

    def __len__(self) -> int:
        return self._full.count()

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self._visible)

    def collect(self) -> Any:
        """All rows in the frame's backend."""
        if self.backend not in _adapters:
            raise BackendError(f"{self.backend!r} is not one of {available_backends()}")
        return _adapters[self.backend](self.ordered())

    def to_arrow(self):
        return self.ordered().toArrow()

    def to_pandas(self):
        return self.ordered().toPandas()

    def to_polars(self):
        return _polars(self.ordered())

    def write_parquet(self, path: str, **options) -> None:
        self.df.write.parquet(path, **options)

    # --- rows by position ----------------------------------------------------------

    def head(self, n: int = C.HEAD_ROWS) -> DataFrame:
        return self.ordered().limit(n)

    def tail(self, n: int = C.TAIL_ROWS) -> DataFrame:
        """The last rows, in order."""
        backwards = [o.desc() for o in self._order]
        last = self._full.orderBy(*backwards).limit(n) if backwards else self._full.limit(n)
        return last.orderBy(*self._order).select(*map(q, self._visible))

    def limit(self, n: int) -> Frame:
        return self._with(self._full.orderBy(*self._order).limit(n) if self._order else self._full.limit(n))

    def with_position(self, name: str = "position") -> DataFrame:
        """Rows with their 0-based position.

        The range-sorted rows are written once, each with its partition and its
        place there; a partition starts after the rows of those before it. So
        the counts and the rows are of one sort, whatever a second one would do.
        """
        spark = self._full.sparkSession
        ranged = self._full.orderBy(*self._order) if self._order else self._full
        ranged = ranged.select(*map(q, self._visible), F.monotonically_increasing_id().alias("__id"))
        path = files.scratch(spark, "positions")
        ranged.write.parquet(path)
        part, within = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
        written = spark.read.schema(ranged.schema).parquet(path).withColumns({"__part": part, "__within": within})
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per sorted partition
        starts = written.groupBy("__part").count()
        starts = starts.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
        joined = written.join(F.broadcast(starts), "__part")
        return joined.select((F.col("__start") + F.col("__within")).alias(name), *map(q, self._visible))

    def rows(self, start: int, stop: int | None = None) -> DataFrame:
        """Rows at positions [start, stop), or the one at ``start``."""
        stop = start + 1 if stop is None else stop
        return self.ordered().offset(start).limit(max(0, stop - start))

    def named(self, ids: str | Sequence[str]) -> DataFrame:
        """Rows with these ids, in the frame's order."""
        return self._full.where(q(C.ID).isin([ids] if isinstance(ids, str) else list(ids))).orderBy(*self._order).select(*map(q, self._visible))

    @property
    def iloc(self) -> _Indexer:
        """``frame.iloc[3]``, ``frame.iloc[2:5]``: rows by position."""
        return _Indexer(lambda k: self.rows(k.start or 0, len(self) if k.stop is None else k.stop) if isinstance(k, slice) else self.rows(k))

    @property
    def loc(self) -> _Indexer:
        """``frame.loc["a"]``, ``frame.loc[["a", "b"]]``: rows by id."""
        return _Indexer(self.named)

    def __setitem__(self, name: str, value: Column) -> None:
        """Add or replace a column in place; protected ones cannot be."""
        changed = self.with_columns(**{name: value})
        self._full, self._visible = changed._full, changed._visible

    def __getitem__(self, key: str | Sequence[str] | slice | Column) -> DataFrame | Frame:
        if isinstance(key, slice):
            return self.iloc[key]
        if isinstance(key, Column):
            return self.filter(key)
        return self.select(*([key] if isinstance(key, str) else key))

    # --- relational operations -------------------------------------------------------

    def filter(self, condition: Column | str) -> Frame:
        return self._with(self._full.where(condition))

    query = filter

    def without_padding(self) -> Frame:
        """Rows whose id does not hold the padding mark anywhere."""
        return self._with(self._full.where(~q(C.ID).contains(C.PADDING_PREFIX)))

    def select(self, *columns: str) -> Frame:
        if missing := [c for c in columns if c not in self._visible]:
            raise KeyError(f"no columns {missing}")
        return self._with(visible=columns)

    def with_columns(self, **columns: Column) -> Frame:
        """Added or replaced columns; those that navigation needs are protected."""
        if bad := sorted(set(columns) & (C.PROTECTED | {C.CURRENT_ID})):
            raise ValueError(f"columns {bad} are protected")
        full = self._full.withColumns(columns)
        return self._with(full, [*self._visible, *(c for c in columns if c not in self._visible)])

    assign = with_columns

    def sort(self, *columns: str | Column, ascending: bool = True) -> Frame:
        by = [q(c) if isinstance(c, str) else c for c in columns]
        by = by if ascending else [c.desc() for c in by]
        return self._with(order=[*by, *self._order])

    sort_values = sort

    def group_by(self, *columns: str) -> GroupedData:
        return self._full.groupBy(*map(q, columns))

    groupby = group_by

    # --- navigation --------------------------------------------------------------------

    def _row(self, key: int | str):
        if isinstance(key, bool) or not isinstance(key, (int, str)):
            raise NavigationError(f"a sample is named by position or id, not {key!r}")
        if isinstance(key, str):
            if C.ID not in self._full.columns:
                raise NavigationError("the rows have no id")
            rows = self._full.where(q(C.ID) == F.lit(key)).orderBy(*self._order).limit(1)
        else:
            if key < 0:
                raise NavigationError(f"position {key} is negative")
            rows = self._full.orderBy(*self._order).offset(key).limit(1)
        wanted = [c for c in (C.ID, C.TYPE, C.CURRENT_ID, C.SOURCE_FILE, C.SOURCE_PATH, C.GDAL_VSI) if c in self._full.columns]
        found = rows.select(*map(q, wanted)).toArrow()
        if not found.num_rows:
            raise NavigationError(f"no sample {key!r}")
        return found

    def read(self, key: int | str) -> str | Frame:
        """A FILE's pointer, or a FOLDER's children."""
        found = self._row(key)
        row = found.to_pylist()[0]
        if C.TYPE not in row:
            raise NavigationError("the rows have no type")
        if row[C.TYPE] == C.FILE:
            if C.GDAL_VSI not in row:
                raise NavigationError("the rows have no pointers")
            return row[C.GDAL_VSI]
        if self.level + 1 not in self._below:
            raise NavigationError(f"there is no level {self.level + 1}")
        if C.CURRENT_ID not in row:
            raise NavigationError("the rows have no current id")
        below = self._below[self.level + 1]
        keep = q(C.PARENT_ID) == F.lit(row[C.CURRENT_ID])
        for c in (C.SOURCE_FILE, C.SOURCE_PATH):
            if c in row and c in below.columns:
                keep = keep & (q(c) == F.lit(row[c]))
        return Frame(below.where(keep), [c for c in below.columns if c != C.ORDER], self._below, self.level + 1, self.backend)

    def children(self) -> Frame:
        """All children of all rows at once."""
        if self.level + 1 not in self._below:
            raise NavigationError(f"there is no level {self.level + 1}")
        below = children_of(self._full, self._below[self.level + 1])
        return Frame(below, [c for c in below.columns if c != C.ORDER], self._below, self.level + 1, self.backend)

    def __repr__(self) -> str:
        shown = self.without_padding()._with().head(C.REPR_ROWS).toPandas() if C.ID in self._full.columns else self.head(C.REPR_ROWS).toPandas()
        return f"Frame(level={self.level}, columns={len(self._visible)})\n{shown}"
