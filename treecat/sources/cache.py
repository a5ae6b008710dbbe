"""A driver-side disk cache for the small metadata files of remote catalogs."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Callable
from pathlib import Path

ENVIRONMENT = "TREECAT_CACHE_DIR"


def folder() -> Path:
    return Path(os.environ.get(ENVIRONMENT) or Path.home() / ".cache" / "treecat")


def entry(url: str) -> Path:
    return folder() / hashlib.sha256(url.encode()).hexdigest()[:16]


def is_valid(known: dict, remote: dict | None) -> bool:
    """ETags decide where both have one, else sizes; what the remote does not tell is trusted."""
    if not remote:
        return True
    for key in ("etag", "size"):
        if known.get(key) is not None and remote.get(key) is not None:
            return known[key] == remote[key]
    return True


def fetch(url: str, names: list[str], download: Callable[[str], bytes], remote: dict | None = None) -> dict[str, Path]:
    """Local files of a catalog's metadata, downloaded where the cache has no valid copy."""
    where = entry(url)
    mark = where / "entry.json"
    known = json.loads(mark.read_text()) if mark.exists() else None
    if known is None or not is_valid(known, remote) or not all((where / n).exists() for n in names):
        shutil.rmtree(where, ignore_errors=True)
        where.mkdir(parents=True)
        for n in names:
            (where / n).write_bytes(download(n))
        mark.write_text(json.dumps({"url": url, **(remote or {})}))
    return {n: where / n for n in names}


def stats() -> dict[str, int]:
    found = [p for p in folder().rglob("*") if p.is_file()] if folder().exists() else []
    return {"entries": sum(p.name == "entry.json" for p in found), "bytes": sum(p.stat().st_size for p in found)}


def clear() -> None:
    shutil.rmtree(folder(), ignore_errors=True)
