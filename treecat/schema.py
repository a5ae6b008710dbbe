"""The tree schema: which types and ids stand at which depth."""

from __future__ import annotations

import copy
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from .constants import FILE, FOLDER
from .errors import SchemaError


@dataclass(frozen=True)
class TreeSchema:
    """``root`` is {"n", "type"}; ``hierarchy`` maps a depth to patterns {"n", "type": [...], "id": [...]}."""

    root: dict[str, Any]
    hierarchy: dict[str, list[dict[str, Any]]]

    def __post_init__(self) -> None:
        if self.root.get("type") not in (FILE, FOLDER):
            raise SchemaError(f"the root's type is {self.root.get('type')!r}, not {FILE} or {FOLDER}")
        for depth, patterns in self.hierarchy.items():
            if not str(depth).isdigit():
                raise SchemaError(f"depth {depth!r} is not a number")
            for p in patterns:
                kinds, ids = p.get("type"), p.get("id")
                if not kinds or not ids:
                    raise SchemaError(f"a pattern at depth {depth} lacks types or ids")
                if len(kinds) != len(ids):
                    raise SchemaError(f"a pattern at depth {depth} has {len(kinds)} types and {len(ids)} ids")
                if bad := set(kinds) - {FILE, FOLDER}:
                    raise SchemaError(f"types {sorted(bad)} at depth {depth} are not known")

    @classmethod
    def from_dict(cls, data: dict) -> TreeSchema:
        if "root" not in data:
            raise SchemaError("a tree schema needs a root")
        return cls(copy.deepcopy(data["root"]), copy.deepcopy(data.get("hierarchy", {})))

    def to_dict(self) -> dict:
        return {"root": copy.deepcopy(self.root), "hierarchy": copy.deepcopy(self.hierarchy)}

    @property
    def max_depth(self) -> int:
        return max(map(int, self.hierarchy), default=0)

    def with_n(self, n: int) -> TreeSchema:
        """The same tree with another number of root samples; deeper counts stay."""
        return TreeSchema({**copy.deepcopy(self.root), "n": n}, copy.deepcopy(self.hierarchy))

    def shape(self) -> tuple:
        """Everything but the counts; compatible trees have equal shapes."""
        levels = ((int(d), tuple((tuple(p["type"]), tuple(p["id"])) for p in ps)) for d, ps in self.hierarchy.items())
        return self.root["type"], tuple(sorted(levels))

    def is_compatible(self, other: TreeSchema) -> bool:
        return self.shape() == other.shape()

    def __add__(self, other: TreeSchema) -> TreeSchema:
        """Counts added, pattern by pattern."""
        if not self.is_compatible(other):
            raise SchemaError("trees of different shapes have no sum")
        merged = {
            d: [{**copy.deepcopy(p), "n": p.get("n", 0) + q.get("n", 0)} for p, q in zip(ps, other.hierarchy[d])]
            for d, ps in self.hierarchy.items()
        }
        return TreeSchema({**copy.deepcopy(self.root), "n": self.root.get("n", 0) + other.root.get("n", 0)}, merged)


def merge(schemas: Iterable[TreeSchema]) -> TreeSchema:
    return reduce(TreeSchema.__add__, schemas)
