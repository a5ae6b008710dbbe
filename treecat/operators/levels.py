"""Levels of a tree: padding, pointers, keys that link them, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions.paths import folder_pointer, subfile, with_slash

LINK_SOURCES = (C.SOURCE_FILE, C.SOURCE_PATH)


def q(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col(f"`{name}`")


def without_padding(df: DataFrame) -> DataFrame:
    """Rows that are no padding. LIKE semantics: ``_`` is a wildcard, null ids go."""
    return df.where(~q(C.ID).like(C.PADDING_PREFIX + "%"))


def with_pointer(df: DataFrame, kind: str, root: str, level: int) -> DataFrame:
    """``df`` with its virtual file paths; after concat each row has its own root."""
    df = df.drop(C.GDAL_VSI)
    base = q(C.SOURCE_PATH) if C.SOURCE_PATH in df.columns else F.lit(root)
    slashed = F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/"))) if C.SOURCE_PATH in df.columns else F.lit(with_slash(root))
    if kind == C.PLAIN:
        below = q(C.RELATIVE_PATH) if level and C.RELATIVE_PATH in df.columns else q(C.ID)
        pointer = folder_pointer(slashed, below, q(C.TYPE))
    elif kind == C.CONSOLIDATED:
        pointer = subfile(q(C.OFFSET), q(C.SIZE), F.concat(slashed, q(C.SOURCE_FILE)))
    else:
        pointer = subfile(q(C.OFFSET), q(C.SIZE), base)
    return df.withColumn(C.GDAL_VSI, pointer)


def level_view(df: DataFrame, kind: str, root: str, level: int) -> DataFrame:
    return with_pointer(without_padding(df), kind, root, level)


def links(parent: DataFrame, child: DataFrame) -> list[tuple[str, str]]:
    """(parent column, child column) pairs that tie a child to its parent, source columns included."""
    shared = [c for c in LINK_SOURCES if c in parent.columns and c in child.columns]
    return [(C.CURRENT_ID, C.PARENT_ID), *((c, c) for c in shared)]


def _matched(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    keys = right.select(*(q(r).alias(f"__k{n}") for n, (_, r) in enumerate(pairs)))
    test = None
    for n, (name, _) in enumerate(pairs):
        one = left[f"`{name}`"] == keys[f"__k{n}"]
        test = one if test is None else test & one
    return left.join(keys, test, "left_semi")


def parents_of(parent: DataFrame, child: DataFrame) -> DataFrame:
    """The parents that have a row in ``child``: a semi-join on the link columns only."""
    return _matched(parent, child, links(parent, child))


def children_of(parent: DataFrame, child: DataFrame) -> DataFrame:
    """The children whose parent is a row of ``parent``."""
    return _matched(child, parent, [(c, p) for p, c in links(parent, child)])


def order_columns(df: DataFrame) -> list[str]:
    """What positions follow: a query's own order, else the stored row numbers within each source."""
    return [c for c in (C.ORDER, C.SOURCE_PATH, C.SOURCE_FILE, C.CURRENT_ID) if c in df.columns]
