from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) as a table like ``documents``, with a column whose name many operators use themselves."""

    def make(rows, extra: bool = False):
        df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            names = ("fp", "n", "key", "score", "label", "n_words", "hit_runs", "hit_items", "toxic", "grade", "expected_severity", "piece_ids", "tokens", "batch")
            df = df.withColumns({c: F.lit("mine") for c in names})
        return df

    return make


@pytest.fixture
def odd_rows():
    """Null and empty texts, a null id, repeated rows, a long text, blanks of all kinds."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "no id here at all"), (4, "same row twice over"), (4, "same row twice over"), (5, long), (6, "x" * 20_000), (7, "ÄÖ Ü ▁ 日本語 🙂")]
