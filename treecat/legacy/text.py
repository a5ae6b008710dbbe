"""Text forms of the format: sizes and points."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import BackendError
from ..operators.levels import q

_UNITS = {"B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "PB": 10**15}
_POINT = r"^\s*POINT\s*\(\s*(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)\s*\)\s*$"


def bytes_of(size: str) -> int:
    """``"100MB"`` as bytes, decimal units."""
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([KMGTP]?B)\s*", size, re.I)
    if not found:
        raise ValueError(f"{size!r} is not a size")
    return int(float(found[1]) * _UNITS[found[2].upper()])


def points(wkt: Column) -> tuple[Column, Column]:
    """(longitude, latitude) of ``POINT (x y)`` texts; null where the text is none."""
    part = lambda n: F.when(wkt.rlike(_POINT), F.regexp_extract(wkt, _POINT, n)).try_cast("double")
    return part(1), part(2)


def to_geodataframe(samples: DataFrame, wkt: str = "stac:centroid", crs: str = "EPSG:4326"):
    """The samples on the driver as a geopandas frame of their points; needs geopandas."""
    try:
        import geopandas
    except ImportError as e:
        raise BackendError("geopandas is not installed") from e
    lon, lat = points(q(wkt))
    rows = samples.withColumns({"__lon": lon, "__lat": lat}).toPandas()
    return geopandas.GeoDataFrame(rows.drop(columns=["__lon", "__lat"]), geometry=geopandas.points_from_xy(rows["__lon"], rows["__lat"]), crs=crs)
