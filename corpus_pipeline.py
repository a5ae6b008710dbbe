"""Corpus pipeline: five stages over ``documents``, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet in the shared folder and reads it back as the next stage's docs.

Odd rows, in every stage: a null text counts as empty; an empty text is no
reason to go but for its quality, which is judged like any other's; repeated
rows are judged alike, and all but one go at near_duplicates; rows with a null
doc_id are one document there; very long texts are read whole; columns beyond
those of ``documents`` are kept as they are, whatever their names, unless
encoding adds one of that name. Without documents no rows come out; without
labels toxicity and quality keep all; without benchmark items decontamination
does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treecat.llm._shared import cut, table
from treecat.llm.decontaminate import decontaminate
from treecat.llm.ordinal_toxicity import drop_toxic
from treecat.llm.pairwise_quality import keep_quality
from treecat.llm.pieces import encode_pieces
from treecat.llm.simhash import drop_near_duplicates


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model calls toxic go; all stay where no label says toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the quality threshold go; all stay without labels of quality."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard of five-word shingles of 0.8 or more) the document with the smallest id stays; null and empty texts are one group."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; null and empty texts have none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, with its piece ids; none for a null or empty text."""
    return encode_pieces(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Two stages learn their models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
