"""Labelled rows for the classifiers, one agreed label per document, and exact order statistics of what is computed for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._shared import cut


def held_out_fold(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id's text leaves 1 when divided by 3; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column | None = None, most_broadcast: int = 1_000_000) -> DataFrame:
    """``(doc_id, text, label)`` of all labelled documents.

    Rows with a null id or label take no part, nor do documents whose labels
    disagree. ``learn`` limits the ids that may be used. Up to
    ``most_broadcast`` labelled ids are broadcast, and then only labelled texts
    are shuffled; documents that repeat an id count once, with their smallest
    text.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    ids = ids if learn is None else ids.where(learn)
    ids = ids.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    ids = cut(ids, "labelled_ids")
    ids = F.broadcast(ids) if ids.count() <= most_broadcast else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def order_statistics(df: DataFrame, column: str, ranks: list[int], most: int = 100_000) -> list[float]:
    """The values that sorting the doubles of ``column``, none null, puts at the ranks (from 0; beyond the last, the last).

    Counts in 4,096 equal cells narrow the range until at most ``most`` rows
    are left, which are sorted on the driver.
    """
    value, n = F.col(column), F.count("*").alias("n")
    whole = df.agg(F.min(value).alias("low"), F.max(value).alias("high"), n).first()
    out = []
    for rank in ranks:
        rank, (low, high, left) = min(rank, whole["n"] - 1), whole
        while left > most and low < high:
            cell = F.least(F.floor((value - low) / (high - low) * 4096), F.lit(4095))
            cells = df.where(value.between(low, high)).groupBy(cell.alias("cell")).agg(F.min(value).alias("low"), F.max(value).alias("high"), n)
            for _, low, high, left in sorted(cells.collect()):
                if rank < left:
                    break
                rank -= left
        some = [low] if low == high else sorted(r[0] for r in df.where(value.between(low, high)).select(column).collect())
        out.append(some[0 if low == high else rank])
    return out
