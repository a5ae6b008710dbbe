"""Cascade filters: filter a level, then keep at each level above the parents of what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..errors import QueryError
from .levels import parents_of


def check_level(level: int, max_depth: int) -> None:
    if not 0 <= level <= max_depth:
        raise QueryError(f"level {level} is outside 0 ... {max_depth}")


def cascade(levels: dict[int, DataFrame], level: int, keep: Column) -> dict[int, DataFrame]:
    """Filtered frames of the levels 0 ... ``level``; ``levels`` holds what each starts from."""
    found = {level: levels[level].where(keep)}
    for above in range(level - 1, -1, -1):
        found[above] = parents_of(levels[above], found[above + 1])
    return dict(sorted(found.items()))
