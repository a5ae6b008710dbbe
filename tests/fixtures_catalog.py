"""Made-up marine catalogs in the layouts this library reads.

``buoys`` is one level of files, ``rivers`` has folders with unequally many
gauges, ``cruises`` has three levels: cruise, station, cast. Positions, days and
measurements follow from the row's number, so tests can work their answers out.
"""

from __future__ import annotations

import io
import json
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from treecat import constants as C
from treecat.functions.geo import box_wkb, point_wkb
from treecat.sources.archive import HEADER, archive_bytes

BOX, CENTRE, TIME, SHAPE, STATS = "istac:geometry", "istac:centroid", "istac:time_start", C.SHAPE_COLUMN, C.STATS_COLUMNS[0]
TYPES = {BOX: pa.binary(), CENTRE: pa.binary(), TIME: pa.timestamp("us"), SHAPE: pa.list_(pa.int64()), STATS: pa.list_(pa.list_(pa.float32())), C.CURRENT_ID: pa.int64(), C.PARENT_ID: pa.int64(), C.OFFSET: pa.int64(), C.SIZE: pa.int64()}


def day(n: int) -> datetime:
    return datetime(2021, 6, 1) + timedelta(days=n)


def spot(n: int) -> tuple[float, float]:
    """The n-th position: a straight course to the north-east, from 30 W 10 S."""
    return 12.0 * n - 30, 5.0 * n - 10


def around(x: float, y: float, half: float = 0.25) -> tuple[float, float, float, float]:
    return x - half, y - half, x + half, y + half


def placed_at(n: int) -> dict:
    return {BOX: box_wkb(*around(*spot(n))), CENTRE: point_wkb(*spot(n))}


def table(rows: list[dict]) -> pa.Table:
    names = list(dict.fromkeys(k for r in rows for k in r))
    return pa.table({n: pa.array([r.get(n) for r in rows], TYPES.get(n)) for n in names})


def document(root: str, n: int, hierarchy: dict, name: str) -> dict:
    return {
        "id": name, "dataset_version": "0.3.1", "description": f"{name}, made up", "tasks": ["regression"], "licenses": ["CC0-1.0"], "title": name,
        "extent": {"spatial": [-31, -11, 120, 60], "temporal": ["2021-06-01", "2021-12-31"]}, "keywords": ["sea"],
        C.TREE_KEY: {"root": {"n": n, "type": root}, "hierarchy": hierarchy}, C.FIELDS_KEY: {"level0": [["id", "string", ""]]},
    }


def cell(mean: float, std: float = 3.0) -> list[float]:
    """min, max, mean, std, valid share, percentiles 25, 50, 75, 95."""
    return [mean - 12, mean + 14, mean, std, 98.0, mean - 2, mean + 0.5, mean + 3, mean + 9]


BUOYS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot"]


def buoys() -> tuple[dict, list[pa.Table]]:
    rows = [
        {C.ID: f"buoy_{b}", C.TYPE: C.FILE, **placed_at(i), TIME: day(17 * i), "depth_m": 40.0 + 7 * i, "owner": "port" if i % 2 else "navy", SHAPE: [1, 20, 10 * (i + 1)], STATS: [cell(8.0 + i), cell(30.0 - 2 * i)], C.CURRENT_ID: i, C.PARENT_ID: i}
        for i, b in enumerate(BUOYS)
    ]
    return document(C.FILE, len(rows), {}, "buoys"), [table(rows)]


#: River, and how many gauges it has.
RIVERS = {"loire": 2, "po": 4, "ebro": 2, "tisza": 3}


def rivers() -> tuple[dict, list[pa.Table]]:
    """Gauges stand at the positions 0, 1, 2 ... in the rivers' order and report shares of ice, water, mud; the Tisza's second one reports levels."""
    top, gauges = [], []
    for r, (name, n) in enumerate(RIVERS.items()):
        first, last = spot(len(gauges)), spot(len(gauges) + n - 1)
        top.append({C.ID: name, C.TYPE: C.FOLDER, BOX: box_wkb(first[0] - 1, first[1] - 1, last[0] + 1, last[1] + 1), TIME: day(r), "basin_km2": 1000.0 * (r + 1), C.CURRENT_ID: r, C.PARENT_ID: r})
        for k in range(n):
            stats = [cell(50.0 + k)] if name == "po" or (name == "tisza" and k == 1) else [[0.1, 0.7, 0.2]]
            gauges.append({C.ID: f"gauge_{k}", C.TYPE: C.FILE, **placed_at(len(gauges)), TIME: day(40 * k + r), SHAPE: [1, 8, 8], STATS: stats, C.CURRENT_ID: len(gauges), C.PARENT_ID: r, C.RELATIVE_PATH: f"{name}/gauge_{k}"})
    names = [f"gauge_{k}" for k in range(4)]
    return document(C.FOLDER, len(top), {"1": [{"n": len(gauges), "type": [C.FILE] * 4, "id": names}]}, "rivers"), [table(top), table(gauges)]


STATIONS = ("inshore", "shelf", "slope")
CASTS = ("ctd", "oxygen")


def cruises(which: range = range(12)) -> tuple[dict, list[pa.Table]]:
    """Cruise n sails on day 9 n at position n; its casts' mean is n, half a unit more for oxygen."""
    top, stations, casts = [], [], []
    for at, t in enumerate(which):
        name = f"cruise_{t:03d}"
        top.append({C.ID: name, C.TYPE: C.FOLDER, **placed_at(t), TIME: day(9 * t), "crew": 5 + t % 4, C.CURRENT_ID: at, C.PARENT_ID: at})
        for s, station in enumerate(STATIONS):
            stations.append({C.ID: station, C.TYPE: C.FOLDER, "fathoms": 10 * (s + 1), C.CURRENT_ID: len(stations), C.PARENT_ID: at, C.RELATIVE_PATH: f"{name}/{station}/"})
            for k, cast in enumerate(CASTS):
                casts.append({C.ID: cast, C.TYPE: C.FILE, SHAPE: [1, 30, 2], STATS: [cell(t + 0.5 * k)], "pressure": 100 * (s + 1) + k, C.CURRENT_ID: len(casts), C.PARENT_ID: len(stations) - 1, C.RELATIVE_PATH: f"{name}/{station}/{cast}"})
    one = {"n": 2 * len(top), "type": [C.FILE] * 2, "id": list(CASTS)}
    shape = {"1": [{"n": 3 * len(top), "type": [C.FOLDER] * 3, "id": list(STATIONS)}], "2": [dict(one) for _ in STATIONS]}
    return document(C.FOLDER, len(top), shape, "cruises"), [table(top), table(stations), table(casts)]


def write_folder(made: tuple[dict, list[pa.Table]], where: Path) -> str:
    (where / "METADATA").mkdir(parents=True)
    (where / C.COLLECTION).write_text(json.dumps(made[0]))
    for n, t in enumerate(made[1]):
        pq.write_table(t, where / "METADATA" / f"level{n}.parquet")
    return str(where)


def _bytes(t: pa.Table, rows: int = 7) -> bytes:
    out = io.BytesIO()
    pq.write_table(t, out, row_group_size=rows)
    return out.getvalue()


def placed(t: pa.Table, start: int = HEADER) -> pa.Table:
    """With 10 bytes for each row."""
    return t.append_column(C.OFFSET, pa.array([start + 10 * i for i in range(len(t))], pa.int64())).append_column(C.SIZE, pa.array([10] * len(t), pa.int64()))


def write_zip(made: tuple[dict, list[pa.Table]], where: Path) -> str:
    blocks = b"".join(f"block{i:05d}".encode() for i in range(max(map(len, made[1]))))
    where.write_bytes(archive_bytes([_bytes(placed(t)) for t in made[1]], json.dumps(made[0]).encode(), blocks))
    return str(where)


def write_consolidated(parts: dict[str, tuple[dict, list[pa.Table]]], where: Path) -> str:
    """Parts side by side; ids are those of each part and so repeat."""
    inside = where / C.CONSOLIDATED_FOLDER
    inside.mkdir(parents=True)
    tables = [[placed(t).append_column(C.SOURCE_FILE, pa.array([name] * len(t))) for t in made[1]] for name, made in parts.items()]
    first = next(iter(parts.values()))[0]
    (inside / C.COLLECTION).write_text(json.dumps(first))
    for n, level in enumerate(zip(*tables)):
        pq.write_table(pa.concat_tables(level), inside / f"level{n}.parquet")
    return str(where)
