"""WKB geometries against a box: exact, closed, for all 2D types and their Z, M and EWKB forms.

Batches of points or of polygons with equally many vertices are decoded by
numpy at once; everything else goes geometry by geometry.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from ..constants import GEOMETRY_COLUMNS
from ..errors import QueryError

Box = tuple[float, float, float, float]
POINT, LINE, POLYGON = 1, 2, 3


def geometry_column(columns: list[str]) -> str:
    for name in GEOMETRY_COLUMNS:
        if name in columns:
            return name
    raise QueryError(f"no geometry column among {columns}; one of {GEOMETRY_COLUMNS} is looked for")


def point_wkb(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, POINT, x, y)


def box_wkb(x0: float, y0: float, x1: float, y1: float) -> bytes:
    return struct.pack("<BIII10d", 1, POLYGON, 1, 5, x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)


def parts(raw: bytes) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(kind, rings or lines or points as n x 2 arrays) of each simple part of a geometry."""

    def one(at: int) -> tuple[int, list]:
        order = "<" if raw[at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", raw, at + 1)
        at += 5
        extra = bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            at += 4
        code &= 0xFFFF
        extra += {0: 0, 1: 1, 2: 1, 3: 2}.get(code // 1000, 0)
        kind, wide = code % 1000, 2 + extra

        def coordinates(at: int, n: int) -> tuple[int, np.ndarray]:
            got = np.frombuffer(raw, order + "f8", n * wide, at).reshape(n, wide)[:, :2]
            return at + 8 * n * wide, got

        def count(at: int) -> tuple[int, int]:
            return at + 4, struct.unpack_from(order + "I", raw, at)[0]

        if kind == POINT:
            at, xy = coordinates(at, 1)
            return at, [] if np.isnan(xy).any() else [(POINT, [xy])]
        if kind == LINE:
            at, n = count(at)
            at, xy = coordinates(at, n)
            return at, [(LINE, [xy])] if n else []
        if kind == POLYGON:
            at, n = count(at)
            rings = []
            for _ in range(n):
                at, m = count(at)
                at, xy = coordinates(at, m)
                rings.append(xy)
            return at, [(POLYGON, rings)] if rings and len(rings[0]) else []
        if kind in (4, 5, 6, 7):
            at, n = count(at)
            found = []
            for _ in range(n):
                at, more = one(at)
                found += more
            return at, found
        raise ValueError(f"WKB type {kind} is not known")

    yield from one(0)[1]


def _line_meets(xy: np.ndarray, box: Box) -> bool:
    """Whether any segment meets the closed box (clipping by parameter)."""
    if len(xy) == 1:
        return bool(box[0] <= xy[0, 0] <= box[2] and box[1] <= xy[0, 1] <= box[3])
    a, d = xy[:-1], np.diff(xy, axis=0)
    t0, t1, alive = np.zeros(len(a)), np.ones(len(a)), np.ones(len(a), bool)
    for axis, low, high in ((0, box[0], box[2]), (1, box[1], box[3])):
        flat = d[:, axis] == 0
        alive &= ~flat | ((a[:, axis] >= low) & (a[:, axis] <= high))
        step = np.where(flat, 1.0, d[:, axis])
        u, v = (low - a[:, axis]) / step, (high - a[:, axis]) / step
        t0 = np.where(flat, t0, np.maximum(t0, np.minimum(u, v)))
        t1 = np.where(flat, t1, np.minimum(t1, np.maximum(u, v)))
    return bool((alive & (t0 <= t1)).any())


def _inside(ring: np.ndarray, x: float, y: float) -> bool:
    """Even-odd test of a point against a closed ring."""
    (x0, y0), (x1, y1) = ring[:-1].T, ring[1:].T
    over = (y0 > y) != (y1 > y)
    at = x0 + (y - y0) * (x1 - x0) / np.where(y1 == y0, 1.0, y1 - y0)
    return bool((over & (x < at)).sum() % 2)


def intersects(raw: bytes | None, box: Box) -> bool:
    """Null and empty geometries meet nothing; touching counts."""
    if not raw:
        return False
    for kind, pieces in parts(bytes(raw)):
        if any(_line_meets(p, box) for p in pieces):
            return True
        # no boundary meets the box: it lies wholly inside or outside
        if kind == POLYGON and _inside(pieces[0], box[0], box[1]) and not any(_inside(h, box[0], box[1]) for h in pieces[1:]):
            return True
    return False


def _box_rows(raw: np.ndarray, box: Box) -> np.ndarray | None:
    """All rows at once, if they are little-endian points, or polygons of one ring that is an upright rectangle."""
    if raw.shape[1] == 21 and (raw[:, :5] == np.frombuffer(struct.pack("<BI", 1, POINT), np.uint8)).all():
        x, y = np.ascontiguousarray(raw[:, 5:]).view("<f8").T
        return (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])
    if raw.shape[1] == 93 and (raw[:, :13] == np.frombuffer(struct.pack("<BIII", 1, POLYGON, 1, 5), np.uint8)).all():
        xy = np.ascontiguousarray(raw[:, 13:]).view("<f8").reshape(-1, 5, 2)
        low, high = xy.min(axis=1), xy.max(axis=1)
        upright = (((xy == low[:, None]) | (xy == high[:, None])).all(axis=(1, 2)) & ((np.diff(xy, axis=1) != 0).sum(axis=2) == 1).all(axis=1)).all()
        if upright:
            return (low[:, 0] <= box[2]) & (high[:, 0] >= box[0]) & (low[:, 1] <= box[3]) & (high[:, 1] >= box[1])
    return None


def wkb_meets(column: Column, box: Box) -> Column:
    """Whether each WKB of a binary column meets the box (min x, min y, max x, max y)."""
    box = tuple(map(float, box))
    if len(box) != 4:
        raise QueryError(f"a box has four sides, not {len(box)}")

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        out = np.zeros(len(values), bool)
        sizes = values.map(lambda v: len(v) if v is not None else 0).to_numpy()
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == size)
            rows = np.frombuffer(b"".join(values.iloc[at]), np.uint8).reshape(len(at), size)
            found = _box_rows(rows, box)
            out[at] = [intersects(v, box) for v in values.iloc[at]] if found is None else found
        return pd.Series(out)

    return test(column)
