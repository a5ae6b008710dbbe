"""The pipeline's stages and the registered queries, over a small set of tables."""

from __future__ import annotations

import random

import pytest
from llm_texts import prose
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from treecat.llm._shared import cut


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables with planted cases; what must go is known by doc_id."""
    rng, base = random.Random(9), str(tmp_path_factory.mktemp("tables"))
    rows, labels, gone = [], [], {"toxic": set(), "junk": set(), "copy": set(), "leak": set()}
    items = [(i, prose(rng, 25)) for i in range(10)]
    for i in range(400):
        kind = ("toxic", "junk", "copy", "leak")[i // 10 % 8] if i // 10 % 8 < 4 and i >= 20 else "clean"
        text = prose(rng, 120)
        if kind == "toxic":
            text = text + " you utter idiot, scum and moron " + prose(rng, 5) + " idiot scum"
        elif kind == "junk":
            text = " ".join(w + rng.choice(["***", "%%%"]) for w in text.split())
        elif kind == "copy":
            text = rows[i % 10][1]
        elif kind == "leak":
            text += " " + items[i % 10][1]
        rows.append((i, text, "en", "src0", len(text)))
        if kind != "clean":
            gone[kind].add(i)
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, rows, gone


def test_stages_do_their_work_on_what_the_one_before_kept(spark, tables):
    base, rows, gone = tables
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns, left = docs.columns, {r[0] for r in rows}
    for (name, stage), kind in zip(corpus_pipeline.STAGES, ("toxic", "junk", "copy", "leak", None)):
        docs = stage(spark, docs, base)
        left -= gone.get(kind, set())
        docs = docs.cache()
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == left, name
        assert docs.columns == columns or name == "encoding"
    assert docs.where("not round_trip").count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, base).collect()} == left


def test_queries_are_registered():
    names = list(entry.queries())
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")].__len__() == 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_pipeline_over_empty_documents(spark, tables, tmp_path):
    base, _, _ = tables
    for t in ("labels", "benchmark", "documents"):
        df = spark.read.parquet(f"{base}/{t}.parquet")
        (df.limit(0) if t == "documents" else df).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.fixture
def odd_tables(spark, tables, tmp_path, odd_rows):
    """The planted tables with odd rows and clashing columns beside them."""
    base, rows, gone = tables
    names = ("fp", "n", "key", "score", "label", "n_words", "hit_runs", "hit_items", "toxic", "grade", "expected_severity", "__quality", "component", "batch", "bands", "hashes")
    more = [(None if i is None else 10_000 + i, t, "en", "src0", len(t or "")) for i, t in odd_rows]
    docs = spark.read.parquet(f"{base}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumns({c: F.lit("mine") for c in names})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        df = spark.read.parquet(f"{base}/{t}.parquet")
        odd = [(None, None, None), (10_001, None, 1), (1, None, None)] if t == "labels" else [(None, None), (77, ""), (None, "...")]
        df.unionByName(spark.createDataFrame(odd, df.schema)).write.parquet(str(tmp_path / f"{t}.parquet"))
    return str(tmp_path), rows, gone, names


def test_odd_rows_go_through_all_stages(spark, odd_tables):
    base, rows, gone, names = odd_tables
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns, all_gone = docs.columns, set().union(*gone.values())
    for (name, stage), kind in zip(corpus_pipeline.STAGES, ("toxic", "junk", "copy", "leak", None)):
        docs = cut(stage(spark, docs, base), name)
        assert docs.columns[: len(columns)] == columns, name
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert {i for i in left if i is not None and i < 10_000} == {r[0] for r in rows} - set().union(*(gone[k] for k in ("toxic", "junk", "copy", "leak")[: 1 + ["toxic", "junk", "copy", "leak", None].index(kind)])), name
        assert all({r[c] for r in docs.select(c).distinct().collect()} == {"mine"} for c in names)
        if name == "toxicity":  # nothing odd is toxic, and repeated rows stay
            assert docs.where("doc_id IS NULL OR doc_id > 10000").count() == 9
        if name == "near_duplicates":
            assert docs.where("doc_id = 10004").count() <= 1 and docs.where("text IS NULL OR trim(text) = ''").count() <= 1
    assert docs.where("NOT round_trip").count() == 0 and all_gone.isdisjoint(left)


@pytest.mark.parametrize("without", ["labels", "benchmark"])
def test_pipeline_without_labels_or_benchmark(spark, tables, tmp_path, without):
    base, rows, gone = tables
    for t in ("labels", "benchmark", "documents"):
        df = spark.read.parquet(f"{base}/{t}.parquet")
        (df.limit(0) if t == without else df).write.parquet(str(tmp_path / f"{t}.parquet"))
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kinds = ("copy", "leak") if without == "labels" else ("toxic", "junk", "copy")
    want = {r[0] for r in rows} - set().union(*(gone[k] for k in kinds))
    assert left == want


def test_near_copies_go(spark):
    """Texts with one word in 60 or in 40 changed (J of some 0.84 and 0.8) go, those of 0.7 stay, as a plain comparison says."""
    rng, rows = random.Random(12), []
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for i in range(60):
        words = fresh(240)
        rows.append(words)
        for k in (4, 5, 8):
            copy = list(words)
            for j in range(k):
                copy[(2 * j + 1) * 240 // (2 * k)] = "changed"
            rows.append(copy)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label] if label[j] < label[i] else [label[i] if x == label[j] else x for x in label]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert left == set(label) and 60 < len(left) < len(rows)
