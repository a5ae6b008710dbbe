"""Structural homogeneity: whether all samples have the same children, by id.

The test compares digests of bounded size; signatures spelled out are for display.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from .levels import links, q


def child_signatures(parent: DataFrame, child: DataFrame) -> DataFrame:
    """``parent``'s link columns and ``signature``: its children's ids in order, joined by ``|``; null without children."""
    pairs = links(parent, child)
    keys = parent.select(*(q(p).alias(p) for p, _ in pairs))
    made = child.groupBy(*(q(c).alias(p) for p, c in pairs)).agg(F.expr(f"listagg(`{C.ID}`, '|') WITHIN GROUP (ORDER BY `{C.ID}`)").alias("signature"))
    return keys.join(made, [p for p, _ in pairs], "left")


def child_digests(parent: DataFrame, child: DataFrame) -> DataFrame:
    """``parent``'s link columns with ``n, h, g``: how many named children it has, and two order-free sums of their ids' hashes.

    Equal for equal sets of ids (repeats count), and of bounded size however
    many children there are; partial sums keep a hot parent out of one task.
    """
    pairs = links(parent, child)
    keys = parent.select(*(q(p).alias(p) for p, _ in pairs))
    total = lambda salt: F.sum(F.xxhash64(q(C.ID), F.lit(salt)).cast("decimal(38,0)"))
    named = child.where(q(C.ID).isNotNull())
    made = named.groupBy(*(q(c).alias(p) for p, c in pairs)).agg(F.count("*").alias("n"), total(1).alias("h"), total(2).alias("g"))
    return keys.join(made, [p for p, _ in pairs], "left")


def count_signatures(parent: DataFrame, child: DataFrame, empty_counts: bool) -> int:
    """How many different sets of children there are; childless parents count as one if ``empty_counts``."""
    found = child_digests(parent, child)
    found = found.na.fill(0, ["n"]) if empty_counts else found.where("n > 0")
    return found.select("n", "h", "g").distinct().count()


def is_homogeneous(parent: DataFrame, child: DataFrame) -> bool:
    """At most one signature; without any rows this holds."""
    return count_signatures(parent, child, False) <= 1


def is_homogeneous_after_cascade(parent: DataFrame, child: DataFrame) -> bool:
    """Just one signature; an empty result does not comply."""
    return count_signatures(parent, child, True) == 1
