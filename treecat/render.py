"""Text and HTML descriptions of a dataset. Neither runs a Spark job beyond the root count."""

from __future__ import annotations

from html import escape
from typing import TYPE_CHECKING

from .constants import FOLDER

if TYPE_CHECKING:
    from .dataset import Dataset

SHOWN = 4


def _extent(d: Dataset) -> str:
    spatial = (d.extent or {}).get("spatial")
    mark = " (filtered)" if d.extent_modified else ""
    return f"{spatial}{mark}" if spatial else f"unknown{mark}"


def text(d: Dataset) -> str:
    when = (d.extent or {}).get("temporal")
    flag = "on demand" if callable(d.rsut) else d.rsut
    lines = [
        f"<Dataset {d.id or 'unnamed'}>",
        f"├── version: {d.version}",
        f"├── description: {d.description[:77] + '...' if len(d.description) > 80 else d.description}",
        f"├── spatial extent: {_extent(d)}",
        f"├── temporal extent: {when if when else 'unknown'}",
        f"├── root samples: {d.n}",
        f"├── levels: {len(d.levels)}",
        f"└── homogeneous: {flag}",
    ]
    return "\n".join(lines)


def children_shown(ids: list[str], kinds: list[str]) -> list[tuple[str, str]]:
    """All children up to four, else the first two, an ellipsis and the last."""
    pairs = list(zip(ids, kinds))
    return pairs if len(pairs) <= SHOWN else [*pairs[:2], ("…", ""), pairs[-1]]


def tree_svg(d: Dataset) -> str:
    """The tree's shape: the root and, below it, each depth's children."""
    rows = [[("root", d.schema.root["type"])]]
    for depth in sorted(d.schema.hierarchy, key=int):
        first = d.schema.hierarchy[depth][0]
        rows.append(children_shown(first["id"], first["type"]))
    parts, width = [], 140 * max(map(len, rows))
    spots: list[float] = []
    for y, row in enumerate(rows):
        step = width / len(row)
        centres = [step * (i + 0.5) for i in range(len(row))]
        above = spots[0] if y == 1 else spots[len(spots) // 2] if spots else None
        for x, (name, kind) in zip(centres, row):
            if above is not None:
                parts.append(f'<line x1="{above:.0f}" y1="{y * 60 - 22}" x2="{x:.0f}" y2="{y * 60 + 8}" stroke="#888"/>')
            shape = "#dbe9ff" if kind == FOLDER else "#eeeeee"
            parts.append(f'<rect x="{x - 60:.0f}" y="{y * 60 + 8}" width="120" height="28" rx="4" fill="{shape}"/>')
            parts.append(f'<text x="{x:.0f}" y="{y * 60 + 27}" text-anchor="middle" font-size="12">{escape(name)}</text>')
        spots = centres
    return f'<svg width="{width}" height="{60 * len(rows)}" xmlns="http://www.w3.org/2000/svg">{"".join(parts)}</svg>'


def _table(rows: list[tuple], head: tuple) -> str:
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + line(head, "th") + "".join(line(r, "td") for r in rows) + "</table>"


def html(d: Dataset) -> str:
    """Header, dimensions, hierarchy, attributes, fields and tree."""
    fold = lambda title, body, open_=False: f"<details{' open' if open_ else ''}><summary>{escape(title)}</summary>{body}</details>"
    dimensions = [(f"level{n}", len(df.columns)) for n, df in sorted(d.levels.items())]
    hierarchy = [(depth, i, p.get("n"), ", ".join(p["id"])) for depth, ps in sorted(d.schema.hierarchy.items(), key=lambda x: int(x[0])) for i, p in enumerate(ps)]
    attributes = [(k, d.collection_document.get(k)) for k in ("title", "tasks", "licenses", "providers", "curators", "keywords", "extent")]
    fields = [(level, *map(str, f)) for level, fs in sorted(d.field_schema.items()) for f in fs]
    parts = [
        f"<h3>{escape(str(d.id or 'unnamed'))} <small>{escape(d.version)}</small></h3><p>{escape(d.description)}</p>",
        fold(f"Dimensions: {d.n} root samples", _table(dimensions, ("level", "columns")), True),
        fold("Hierarchy", _table(hierarchy, ("depth", "pattern", "n", "ids"))),
        fold("Attributes", _table([a for a in attributes if a[1]], ("name", "value"))),
        fold("Fields", _table(fields, ("level", "name", "type", "description")) if fields else ""),
        fold("Tree", tree_svg(d)),
    ]
    return f'<div class="treecat">{"".join(parts)}</div>'
