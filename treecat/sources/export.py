"""Writing catalogs: a dataset's levels and document as a folder, a consolidated catalog, or an archive."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from .. import constants as C
from ..operators.levels import children_of
from . import files

if TYPE_CHECKING:
    from ..dataset import Dataset


def write_catalog(dataset: Dataset, path: str) -> str:
    """The dataset's selection and all that hangs below it, in its own layout (an archive's as a consolidated one).

    Every level is one Parquet write; a level's rows are those below the level
    above, by semi-joins on the link columns.
    """
    spark = dataset.spark
    plain = dataset.format == C.PLAIN
    home = path if plain else files.join(path, C.CONSOLIDATED_FOLDER)
    where = files.join(home, "METADATA") if plain else home
    above = None
    for level in sorted(dataset.levels):
        rows = dataset.current if above is None else children_of(above, dataset.filtered.get(level, dataset.levels[level]))
        above = rows = rows.drop(C.GDAL_VSI, C.ORDER)
        rows.write.parquet(files.join(where, f"level{level}.parquet"))
    document = dataset.collection | {C.TREE_KEY: dataset.pit_schema.to_dict()}
    files.write(spark, files.join(home, C.COLLECTION), json.dumps(document).encode())
    return path


def write_archive(spark: SparkSession, path: str, levels: list[DataFrame], document: dict, row_group: int = 8 << 20) -> str:
    """An archive of level tables and their document, without blocks of data.

    Tasks write a level's Parquet files; their row groups are joined to the one
    Parquet file that the format asks for, without decoding them, and the
    levels' files are then copied behind the header piece by piece.
    """
    from .archive import HEADER, pack_header

    parts = []
    for df in levels:
        where = files.scratch(spark, "level")
        df.write.option("parquet.block.size", row_group).parquet(where)
        parts.append(files.joined_parquet(spark, where, where + ".parquet"))
    sizes = [files.size(spark, p) for p in parts]
    raw = json.dumps(document).encode()
    entries, at = [], HEADER
    for n in [*sizes, len(raw)]:
        entries.append((at, n))
        at += n
    files.write(spark, path, pack_header(entries), parts, raw)
    return path
