"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(severity <= k) is the logistic function of threshold_k minus a score that
all thresholds share. Labels say toxic or not; a toxic document's grade (1 to
``GRADES`` - 1) is the third it falls into by how many of its features stand
out in toxic documents, so grades order documents by strength of evidence and
carry no judgement from outside.

Features are hashes of words and of the runs of five bytes in them, so that an
unseen form of a known word counts too. All ``2 ** BITS`` of them may be used;
those whose presence depends on the label, by chi-square over all labelled
documents, are. The likelihood and its gradient are summed in Spark tasks and
minimised by L-BFGS on the driver, which never holds a document's features.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import cut, map_arrow, slices, table
from .decontaminate import words
from .labelled import held_out_fold, labelled_texts, order_statistics

GRADES = 4
#: Features are numbers below 2 ** BITS: a model has no more weights than that.
BITS = 22
GRAM = 5
_CACHE = 200_000
#: Parts that sum a gradient, and numbers of a gradient that each sends to the driver; longer ones are first summed by blocks of that length.
_MOST_PARTS, BLOCK = 64, 1 << 16


def word_features(word: bytes) -> set[int]:
    """Numbers of the word and of its runs of ``GRAM`` bytes, its ends marked."""
    marked = b"^" + word + b"$"
    names = [marked, *(marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1))]
    return {xxhash.xxh32_intdigest(x) >> (32 - BITS) for x in names}


@dataclass(frozen=True)
class OrdinalModel:
    """``place`` tells the place of each used feature in ``weights``."""

    place: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def features(self, text: str | None, cache: dict[bytes, tuple[int, ...]]) -> tuple[list[int], list[float]]:
        """(places, values) of a text's features: 1 + log(occurrences). ``cache`` keeps words' places."""
        counts: dict[int, int] = {}
        for word, n in Counter(words(text)).items():
            at = cache.get(word)
            if at is None:
                at = tuple(self.place[f] for f in word_features(word) if f in self.place)
                if len(cache) < _CACHE and len(word) <= 64:
                    cache[word] = at
            for i in at:
                counts[i] = counts.get(i, 0) + n
        return list(counts), [1 + log(n) for n in counts.values()]

    def above(self, texts: list, cache: dict | None = None) -> np.ndarray:
        """P(severity >= k) for k = 1 ... GRADES - 1, a row per text."""
        score, cache = np.zeros(len(texts)), {} if cache is None else cache
        for n, text in enumerate(texts):
            at, values = self.features(text, cache)
            score[n] = float(self.weights[at] @ np.array(values)) if at else 0.0
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def thresholds(p: np.ndarray) -> np.ndarray:
    """In order: the first parameter is free, each next adds an exponential."""
    return np.cumsum(np.concatenate([p[:1], np.exp(p[1:])]))


def ordinal_loss(p: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray]:
    """(negative log likelihood, its gradient) of documents with sparse features (row, column, value).

    ``p`` are the weights, then the thresholds' parameters.
    """
    n_features, n = len(p) - GRADES + 1, len(grade)
    w, free = p[:n_features], p[n_features:]
    theta = thresholds(free)
    score = np.bincount(rows, values * w[cols], n)
    f = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -50, 50)))  # P(y <= k - 1), k = 1 ...
    at, none, all_ = np.arange(n), np.zeros((n, 1)), np.ones((n, 1))
    full, slope = np.concatenate([none, f, all_], axis=1), np.concatenate([none, f * (1 - f), none], axis=1)
    like = np.maximum(full[at, grade + 1] - full[at, grade], 1e-12)
    hi, lo = slope[at, grade + 1] / like, slope[at, grade] / like
    by_theta = np.array([lo[grade == k].sum() - hi[grade == k - 1].sum() for k in range(1, GRADES)])
    tail = np.cumsum(by_theta[::-1])[::-1]
    by_free = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
    return float(-np.log(like).sum()), np.concatenate([np.bincount(cols, values * (hi - lo)[rows], n_features), by_free])


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], p: np.ndarray, rounds: int = 40, memory: int = 8, least: float = 1e-4) -> np.ndarray:
    """L-BFGS with a halving line search, until a round gains less than ``least`` of the loss."""
    loss, g = evaluate(p)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(steps):
            alphas.append((s @ q) / (s @ y))
            q -= alphas[-1] * y
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(g).max())
        for (s, y), a in zip(steps, reversed(alphas)):
            q += (a - (y @ q) / (s @ y)) * s
        size, slope = 1.0, g @ q
        while True:
            new_p = p - size * q
            new_loss, new_g = evaluate(new_p)
            if new_loss <= loss - 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        if new_loss >= loss:
            break
        if (new_p - p) @ (new_g - g) > 1e-12:
            steps = [*steps[-memory + 1 :], (new_p - p, new_g - g)]
        gain = loss - new_loss
        p, loss, g = new_p, new_loss, new_g
        if gain < least * abs(loss):
            break
    return p


def learn_ordinal(parts: Callable[[np.ndarray], tuple[float, np.ndarray]], n: int, n_features: int, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) for the least mean loss; ``parts`` sums ``ordinal_loss`` over the ``n`` documents."""

    def evaluate(p: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g = parts(p)
        w = np.concatenate([p[:n_features], np.zeros(GRADES - 1)])
        return loss / n + l2 / 2 * float(w @ w), g / n + l2 * w

    p = minimise(evaluate, np.concatenate([np.zeros(n_features), [1.0], np.zeros(GRADES - 2)]))
    return p[:n_features], thresholds(p[n_features:])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn=None, least_chi: float = 15.0) -> OrdinalModel:
    """Learn from all labelled documents, whole texts.

    Without a toxic label there are no features and nothing is toxic.
    """
    spark = docs.sparkSession
    known = cut(labelled_texts(docs, labels, label, learn), "toxic_labelled")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, np.ndarray] = {}

        def numbers(word: bytes) -> np.ndarray:
            at = cache.get(word)
            if at is None:
                at = np.fromiter(word_features(word), np.int32)
                if len(cache) < _CACHE and len(word) <= 64:
                    cache[word] = at
            return at

        none = np.empty(0, np.int32)
        for b in slices(batches):
            found = [np.unique(np.concatenate([none, *map(numbers, set(words(t)))])) for t in b.column("text").to_pylist()]
            bad = np.repeat(b.column("label").to_numpy(), [len(x) for x in found])
            feature, at = np.unique(np.concatenate([none, *found]), return_inverse=True)
            columns = [feature, np.bincount(at, bad, len(feature)).astype(np.int64), np.bincount(at, minlength=len(feature))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "bad", "df"])

    n = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")).first()
    seen = map_arrow(known.select("label", "text"), distinct, "feature int, bad long, df long")
    seen = seen.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("df").alias("df")).where("df >= 2")
    # chi-square of a feature's presence against the label
    expected = F.col("df") * float(n["bad"] / max(1, n["n"]))
    chi = (F.col("bad") - expected) ** 2 / F.greatest(expected * (1 - F.col("df") / float(max(1, n["n"]) + 1)), F.lit(1e-9))
    used = seen.where(F.round(chi, 9) > least_chi).select("feature", "bad", "df").toPandas().sort_values("feature") if n["bad"] else None
    if used is None or not len(used):
        return OrdinalModel({}, np.zeros(0), np.array([20.0 + k for k in range(GRADES - 1)]))
    rate = n["bad"] / n["n"]
    place = {int(f): i for i, f in enumerate(used["feature"])}
    marks = (used["bad"] > 2 * rate * used["df"]).to_numpy(np.float64)  # features that stand out in toxic documents
    blank = spark.sparkContext.broadcast((OrdinalModel(place, np.zeros(len(place)), np.zeros(GRADES - 1)), marks))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        model, marks = blank.value
        for b in slices(batches):
            found = [model.features(t, cache) for t in b.column("text").to_pylist()]
            strength = [float(marks[x] @ np.array(v)) if x else 0.0 for x, v in found]
            columns = [b.column("doc_id"), b.column("label"), pa.array(strength, pa.float64()), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "strength", "at", "value"])

    rows = cut(map_arrow(known.select("doc_id", "label", "text"), sparse, "doc_id long, label int, strength double, at array<int>, value array<double>"), "toxic_features")
    bad = rows.where("label > 0")
    at = (bad.count() - 1) * np.arange(1, GRADES - 1) / (GRADES - 1)
    low, high = (np.array(order_statistics(bad, "strength", [int(r) for r in f(at)])) for f in (np.floor, np.ceil))
    edges = low + (high - low) * (at - np.floor(at))
    rows = rows.coalesce(_MOST_PARTS)

    def total(p: np.ndarray) -> tuple[float, np.ndarray]:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, g = 0.0, np.zeros(len(p))
            for b in slices(batches, 2048):
                strength, label = b.column("strength").to_numpy(), b.column("label").to_numpy()
                grade = np.where(label > 0, 1 + np.searchsorted(edges, strength, side="left"), 0)
                sizes = np.diff(b.column("at").offsets.to_numpy())
                cols, values = (b.column(c).flatten().to_numpy() for c in ("at", "value"))
                more = ordinal_loss(p, np.repeat(np.arange(b.num_rows), sizes), cols, values, grade)
                loss, g = loss + more[0], g + more[1]
            blocks = [g[at : at + BLOCK].tobytes() for at in range(0, len(g), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([loss] + [0.0] * (len(blocks) - 1)), pa.array(blocks, pa.binary())], names=["block", "loss", "g"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, sums = {}, {}
            for b in batches:
                for k, one, g in zip(*(b.column(c).to_pylist() for c in ("block", "loss", "g"))):
                    loss[k], sums[k] = loss.get(k, 0.0) + one, sums.get(k, 0.0) + np.frombuffer(g, np.float64)
            columns = [pa.array(sums.keys(), pa.int32()), pa.array(loss.values(), pa.float64()), pa.array([g.tobytes() for g in sums.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "loss", "g"])

        schema = "block int, loss double, g binary"
        found = map_arrow(rows.select("label", "strength", "at", "value"), partial, schema)
        found = found if len(p) <= BLOCK else map_arrow(found.repartition("block"), summed, schema)
        g = np.zeros(len(p))
        found = found.toArrow()
        for k, part in zip(found.column("block").to_pylist(), found.column("g").to_pylist()):
            g[k * BLOCK : (k + 1) * BLOCK] += np.frombuffer(part, np.float64)
        return float(sum(found.column("loss").to_pylist())), g

    return OrdinalModel(place, *learn_ordinal(total, n["n"], len(place)))


def with_severity(docs: DataFrame, model: OrdinalModel, drop_toxic: bool = False) -> DataFrame:
    """``docs`` with ``expected_severity double, grade int, toxic boolean`` (replaced if there).

    Expected severity is the sum of P(severity >= k); the grade is the most
    likely one; toxic means P(severity >= 1) of a half or more. A null or
    empty text has no features.
    """
    added = ("expected_severity", "grade", "toxic")
    docs = docs.drop(*added)
    schema = docs.select("*", F.lit(0.0).alias(added[0]), F.lit(0).alias(added[1]), F.lit(True).alias(added[2])).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in slices(batches):
            above = shared.value.above(b.column("text").to_pylist(), cache)
            edge = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            toxic = above[:, 0] >= 0.5
            new = [pa.array(above.sum(axis=1), pa.float64()), pa.array((edge[:, :-1] - edge[:, 1:]).argmax(axis=1), pa.int32()), pa.array(toxic, pa.bool_())]
            out = pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *added])
            yield out.filter(pa.array(~toxic)) if drop_toxic else out

    return map_arrow(docs, add, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, all columns as they were.

    Null and empty texts have no features and stay; repeated rows stay or go
    together; without documents there are no rows, without toxic labels all stay.
    """
    model = fit_toxicity(docs, labels)
    names = docs.columns
    held = docs.withColumnsRenamed({c: f"__{c}" for c in ("expected_severity", "grade", "toxic") if c in names})
    kept = with_severity(held, model, drop_toxic=True)
    return kept.select(*(F.col(f"__{c}").alias(c) if f"__{c}" in held.columns and c not in held.columns else F.col(c) for c in names))


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the labels outside the held-out fold; one row per row of ``documents``."""
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels, learn=~held_out_fold())
    scored = with_severity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out_fold().alias("held_out"), "expected_severity", "grade", "toxic")
