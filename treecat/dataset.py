"""A dataset: lazy level tables, a current selection of root samples, and what is known of them."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import constants as C
from .errors import QueryError
from .frame import Frame
from .functions import geo, temporal
from .operators import homogeneity, stats
from .operators.cascade import cascade, check_level
from .operators.concat import concat
from .operators.levels import children_of, parents_of, q
from .plans import sql as plans
from .schema import TreeSchema


@dataclass(frozen=True)
class Dataset:
    """Immutable; every operation gives a new dataset, and nothing runs until rows are asked for.

    ``levels`` are all samples by depth, ``current`` the selected root samples,
    ``filtered`` the levels a cascade has narrowed.
    """

    spark: SparkSession
    path: str
    root: str
    format: str
    collection_document: dict[str, Any]
    schema: TreeSchema
    levels: dict[int, DataFrame]
    current: DataFrame
    filtered: dict[int, DataFrame] = field(default_factory=dict)
    rsut: bool | Callable[[], bool] = True
    joined: frozenset[int] = frozenset()
    extent_modified: bool = False
    backend: str = "arrow"

    def replace(self, **changes) -> Dataset:
        return dataclasses.replace(self, **changes)

    # --- metadata ------------------------------------------------------------

    def __getattr__(self, name: str) -> Any:
        defaults = {"id": None, "description": "", "title": None, "extent": {}, "tasks": [], "licenses": [], "providers": [], "curators": [], "keywords": []}
        if name in defaults:
            return self.__dict__["collection_document"].get(name) or defaults[name]
        raise AttributeError(name)

    @property
    def version(self) -> str:
        return self.collection_document.get("dataset_version") or "unknown"

    @property
    def collection(self) -> dict[str, Any]:
        return dict(self.collection_document)

    @property
    def field_schema(self) -> dict[str, list]:
        return self.collection_document.get(C.FIELDS_KEY, {})

    @cached_property
    def n(self) -> int:
        """Selected root samples, counted when first asked for."""
        return self.current.count()

    @property
    def pit_schema(self) -> TreeSchema:
        return self.schema.with_n(self.n)

    @property
    def max_depth(self) -> int:
        return max(self.levels)

    def navigation_columns(self, describe: bool = False) -> list[str] | dict[str, str]:
        """Columns a selection must keep to stay navigable."""
        names = sorted(C.NAVIGATION[self.format])
        return {c: C.NAVIGATION_TEXT[c] for c in names} if describe else names

    def columns(self, level: int = 0) -> list[str]:
        check_level(level, self.max_depth)
        return self.levels[level].columns

    # --- selection -------------------------------------------------------------

    def sql(self, query: str) -> Dataset:
        """A SELECT over ``data`` (the current selection) and ``level0 ... levelN``.

        Column names may stand in double quotes or backticks. The result is no
        longer taken as homogeneous when it lacks a navigation column or the
        query reads a deeper level.
        """
        tables = {"data": self.current, **{f"level{n}": df for n, df in self.levels.items()}}
        found, deeper = plans.run(self.spark, query, tables)
        lost = bool(C.NAVIGATION[self.format] - set(found.columns)) or bool(deeper)
        return self.replace(current=found, filtered={}, rsut=False if lost else self.rsut, joined=self.joined | deeper, extent_modified=True)

    def _narrowed(self, keep) -> Dataset:
        """A root filter; children that a cascade had narrowed stay those of the samples left."""
        current, filtered = self.current.where(keep), {}
        above = current
        for level in sorted(self.filtered):
            filtered[level] = above = children_of(above, self.filtered[level]) if level else current
        return self.replace(current=current, filtered=filtered, extent_modified=True)

    def _filter(self, level: int, make) -> Dataset:
        """``make(frame, column names)`` gives the condition at the level."""
        check_level(level, self.max_depth)
        if not level:
            return self._narrowed(make(self.current))
        start = {n: self.filtered.get(n, df) for n, df in self.levels.items()} | {0: self.current}
        found = cascade(start, level, make(start[level]))
        check = True if self.schema.root["type"] == C.FILE else lambda: homogeneity.is_homogeneous_after_cascade(found[0], found[1])
        return self.replace(current=found[0], filtered=found, rsut=check, joined=self.joined | frozenset(range(1, level + 1)), extent_modified=True)

    def filter_bbox(self, minx: float, miny: float, maxx: float, maxy: float, geometry_col: str = "auto", level: int = 0) -> Dataset:
        """Samples whose geometry meets the box; at a deeper level, root samples above such samples."""
        box = tuple(map(float, (minx, miny, maxx, maxy)))

        def make(df: DataFrame):
            column = geo.geometry_column(df.columns) if geometry_col == "auto" else geometry_col
            if column not in df.columns:
                raise QueryError(f"level {level} has no column {column!r}")
            return geo.wkb_meets(q(column), box)

        return self._filter(level, make)

    def filter_datetime(self, datetime_range: str | datetime | tuple, time_col: str = "auto", level: int = 0) -> Dataset:
        """Samples of a day or a closed range of days; at a deeper level as in :meth:`filter_bbox`."""
        temporal.parse_range(datetime_range)

        def make(df: DataFrame):
            column = temporal.time_column(df.columns) if time_col == "auto" else time_col
            if column not in df.columns:
                raise QueryError(f"level {level} has no column {column!r}")
            return temporal.in_days(df, column, datetime_range)

        return self._filter(level, make)

    def concat(self, *others: Dataset, column_mode: str = "intersection") -> Dataset:
        return concat([self, *others], column_mode)

    # --- rows ------------------------------------------------------------------

    def _frame(self, clean: bool) -> Frame:
        keep = {C.GDAL_VSI} | ({C.CURRENT_ID, C.PARENT_ID, *((C.SOURCE_FILE,) if self.format == C.CONSOLIDATED else ())} if self.filtered else set())
        visible = [c for c in self.current.columns if c != C.ORDER and not (clean and c.startswith("internal:") and c not in keep)]
        below = {n: self.filtered.get(n, df) for n, df in self.levels.items()}
        return Frame(self.current, visible, below, 0, self.backend)

    @property
    def data(self) -> Frame:
        """The selection without its internal columns (but for pointers, and links after a cascade)."""
        return self._frame(True)

    @property
    def data_raw(self) -> Frame:
        return self._frame(False)

    # --- homogeneity -----------------------------------------------------------

    def is_rsut(self) -> bool:
        """Whether all root samples are known to have the same children by id."""
        return self.rsut() if callable(self.rsut) else self.rsut

    def verify_rsut(self) -> bool:
        """Look again, at the current selection."""
        if self.schema.root["type"] == C.FILE or 1 not in self.levels:
            return True
        return homogeneity.is_homogeneous(self.current, self.filtered.get(1, self.levels[1]))

    # --- statistics ------------------------------------------------------------

    def stats_frame(self, level: int = 0, id: str | None = None, scope: str = "current") -> DataFrame:
        """The rows whose cells are aggregated.

        At the root: the current selection, or all samples with ``scope``
        "all". Below: the children of every parent named ``id``.
        """
        check_level(level, self.max_depth)
        if scope not in ("current", "all"):
            raise QueryError(f"scope is current or all, not {scope!r}")
        if not level:
            return self.current if scope == "current" else self.levels[0]
        if id is None:
            raise QueryError("below the root the id of a parent is needed")
        above = self.levels[level - 1]
        return children_of(above.where(q(C.ID) == F.lit(id)), self.levels[level])

    def _stat(self, what: str, band, level: int, id: str | None, scope: str):
        df = self.stats_frame(level, id, scope)
        stats.stats_column(df.columns)
        return stats.pick(stats.aggregate(df, what), band)

    def write(self, path: str) -> str:
        """The selection and all below it as a catalog of its own."""
        from .sources.export import write_catalog

        return write_catalog(self, path)

    # --- lifecycle ---------------------------------------------------------------

    def persist(self) -> Dataset:
        for df in self.levels.values():
            df.persist()
        return self

    def close(self) -> None:
        """Let go of persisted levels; the session belongs to the caller."""
        for df in self.levels.values():
            df.unpersist()

    def __enter__(self) -> Dataset:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __repr__(self) -> str:
        from .render import text

        return text(self)

    def _repr_html_(self) -> str:
        from .render import html

        return html(self)


def _statistic(what: str, text: str) -> Callable:
    def method(self: Dataset, band: int | list[int], level: int = 0, id: str | None = None, scope: str = "current"):
        return self._stat(what, band, level, id, scope)

    method.__name__, method.__doc__ = f"stats_{what}", text
    return method


_PLAIN_MEAN = "Plain mean of the samples' percentiles."
for _what, _text in {
    "mean": "Pixel-weighted mean.", "std": "Pooled standard deviation.", "min": "Least value.", "max": "Greatest value.",
    "p25": _PLAIN_MEAN, "p50": _PLAIN_MEAN, "p75": _PLAIN_MEAN, "p95": _PLAIN_MEAN, "categorical": "Pixel-weighted mean share of each class.",
}.items():
    setattr(Dataset, f"stats_{_what}", _statistic(_what, _text))
Dataset.stats_median = Dataset.stats_p50


def from_levels(spark: SparkSession, document: dict, raw: dict[int, DataFrame], kind: str, path: str, root: str, backend: str = "arrow") -> Dataset:
    """A dataset over raw level tables: padding hidden, pointers added."""
    from .functions.paths import to_vsi
    from .operators.levels import level_view
    from .sources.collection import tree_of

    base = to_vsi(root)
    levels = {n: level_view(df, kind, base, n) for n, df in raw.items()}
    return Dataset(spark, path, root, kind, document, tree_of(document), levels, levels[0], backend=backend)


__all__ = ["Dataset", "from_levels", "parents_of"]
