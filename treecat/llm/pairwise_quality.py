"""Document quality by Bradley-Terry pairwise ranking.

Documents labelled 1 are preferred to documents labelled 0. A linear score is
learned from all such pairs, of all labelled documents, by logistic loss on the
differences of their features. The threshold is a quantile of the scores of the
labelled documents: the share of label 0 among them. A document's ``score`` is the probability that it beats
a document at the threshold.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import cut, map_arrow, slices, space_words, table
from .labelled import held_out_fold, labelled_texts, order_statistics

#: Words share this many hashed features.
BUCKETS = 128
N_FEATURES = 129 + 6 + BUCKETS
_MEMO = 500_000
_MOST_PARTS = 64


class _Buckets(dict):
    """Word -> its hashed feature."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh32_intdigest(word) % BUCKETS
        if len(self) < _MEMO:
            self[word] = found
        return found


_buckets = _Buckets()


def text_features(text: str | None) -> np.ndarray:
    """Square roots of the shares of the 128 ASCII bytes and of all others, six measures of length and repetition, square roots of the shares of words by hash."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.empty(0, np.uint8)
    counts = np.bincount(raw, minlength=256)
    out = np.zeros(N_FEATURES, np.float32)
    if not len(raw):
        return out
    out[:128] = np.sqrt(counts[:128] / len(raw))
    out[128] = np.sqrt(counts[128:].sum() / len(raw))
    words, lines = space_words(text), text.split("\n")
    n = max(1, len(words))
    symbols = sum(counts[i] for i in range(33, 127) if not chr(i).isalnum())
    out[129:135] = np.log1p(len(raw)) / 10, np.log1p(len(words)) / 10, len(raw) / n / 20, len(set(words)) / n, len(set(lines)) / len(lines), symbols / n
    out[135:] = np.sqrt(np.bincount(np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words)), minlength=BUCKETS) / n)
    return out


def _matrix(texts: list) -> np.ndarray:
    return np.stack([text_features(t) for t in texts]) if texts else np.empty((0, N_FEATURES), np.float32)


@dataclass(frozen=True)
class PairwiseModel:
    weights: np.ndarray
    threshold: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        margin = features.astype(np.float64) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


#: Pairs whose differences are held at a time.
_PAIRS = 4096
#: Width of the steps in which scores are tabulated; cells of the second derivative.
STEP, CELLS = 1 / 128, 128
#: Runs a function over all (features, label) batches of each part and returns what it says of each.
Parts = Callable[[Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], tuple]], list[tuple]]


def drawn_pairs(good: np.ndarray, bad: np.ndarray, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random (preferred, other) rows."""
    rng = np.random.default_rng(seed)
    return rng.choice(good, pairs), rng.choice(bad, pairs)


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -500, 500)))


def tabulated(scores: np.ndarray, n: np.ndarray | None = None, total: np.ndarray | None = None) -> np.ndarray:
    """Rows of (step, number of scores, sum of scores) in the order of the steps; merges tables where ``n`` and ``total`` are given."""
    step = np.floor(scores / STEP) if n is None else scores
    n, total = (np.ones(len(scores)), scores) if n is None else (n, total)
    found, at = np.unique(step, return_inverse=True)
    return np.stack([found, np.bincount(at, n, len(found)), np.bincount(at, total, len(found))], axis=1)


def wrong_order(own: np.ndarray, other: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum over the other label's scores o of the logistic function of sign * (s - o) and its slope, at the mean score s of each step.

    A step of the other table counts as its number at its mean, so a pair's
    term is off by the second order of STEP.
    """
    s, m = own[:, 2] / own[:, 1], other[:, 2] / other[:, 1]
    value, slope = np.zeros(len(s)), np.zeros(len(s))
    for at in range(0, len(s), 512):
        p = _sigmoid(sign * (s[at : at + 512, None] - m))
        value[at : at + 512], slope[at : at + 512] = p @ other[:, 1], sign * ((p * (1 - p)) @ other[:, 1])
    return value, slope


def learn_all_pairs(parts: Parts, l2: float = 1e-3, rounds: int = 25) -> tuple[np.ndarray, int, int]:
    """(weights, labels 1, labels 0) for the least mean logistic loss of all pairs (label 1, label 0) plus ``l2`` / 2 times the squared weights of scaled features.

    A pair's loss depends on two scores. So a round first tabulates the scores
    of each label and from the tables knows for any document the sum over all
    documents of the other label; then the slope is a sum over documents.
    Newton's steps take the second derivative from scores in ``CELLS`` cells,
    which decides how fast, not where, they end. Without both labels the
    weights are 0.
    """

    def moments(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple:
        n, first, second = np.zeros(3), 0.0, 0.0
        for x, y in batches:
            x = x.astype(np.float64)
            n += len(x), (y == 1).sum(), (y == 0).sum()
            first, second = first + x.sum(axis=0), second + (x * x).sum(axis=0)
        return n, np.atleast_1d(first), np.atleast_1d(second)

    found = [f for f in parts(moments) if f[0][0]]
    if not found:
        return np.zeros(N_FEATURES), 0, 0
    (n, n_good, n_bad), first, second = (sum(f[k] for f in found) for k in range(3))
    if not n_good or not n_bad:
        return np.zeros(len(first)), int(n_good), int(n_bad)
    mean = first / n
    scale = np.sqrt(np.maximum(second / n - mean * mean, 0))
    scale[scale < 1e-6] = np.inf  # a feature that never varies says nothing
    w = np.zeros(len(mean))
    for _ in range(rounds):

        def tables(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple:
            scores = [(((x - mean) / scale) @ w, y) for x, y in batches]
            return tuple(tabulated(np.concatenate([s[y == k] for s, y in scores] or [np.empty(0)])) for k in (1, 0))

        said = parts(tables)
        good, bad = (tabulated(*np.concatenate([t[k] for t in said]).T) for k in (0, 1))
        side = {1: (good[:, 0], good[:, 2] / good[:, 1], *wrong_order(good, bad, -1)), 0: (bad[:, 0], bad[:, 2] / bad[:, 1], *wrong_order(bad, good, 1))}
        middle = np.sort(np.concatenate([side[1][1], side[0][1]]))
        edges = np.linspace(*np.quantile(middle, (0.001, 0.999)), CELLS - 1)
        cells = [[np.bincount(np.searchsorted(edges, side[k][1]), v, CELLS) for v in (t[:, 1], t[:, 2])] for k, t in ((1, good), (0, bad))]
        at = [np.divide(total, many, out=np.zeros(CELLS), where=many > 0) for many, total in cells]
        met = _sigmoid(at[0][:, None] - at[1])
        met *= 1 - met
        curve = {1: met @ cells[1][0], 0: met.T @ cells[0][0]}

        def slopes(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple:
            gradient, hessian, sums = np.zeros(len(w)), np.zeros((len(w), len(w))), np.zeros((2, CELLS, len(w)))
            for x, y in batches:
                x = (x - mean) / scale
                for k, (step, centre, value, slope) in side.items():
                    z = x[y == k]
                    s = z @ w
                    place = np.minimum(np.searchsorted(step, np.floor(s / STEP)), len(step) - 1)
                    cell = np.searchsorted(edges, centre[place])
                    gradient += (-1 if k else 1) * ((value[place] + slope[place] * (s - centre[place])) @ z)
                    hessian += (z * curve[k][cell][:, None]).T @ z
                    sums[1 - k] += (np.arange(CELLS)[:, None] == cell) @ z
            return gradient, hessian, sums

        gradient, hessian, sums = (sum(f[k] for f in parts(slopes)) for k in range(3))
        cross = sums[0].T @ met @ sums[1]
        pairs = n_good * n_bad
        step = np.linalg.solve((hessian - cross - cross.T) / pairs + l2 * np.eye(len(w)), gradient / pairs + l2 * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w / scale, int(n_good), int(n_bad)


def _one_sided(n_features: int, n_good: int, n_bad: int) -> PairwiseModel:
    """Without both labels nothing can be ranked: all weights are 0, and the score is above a half only if label 1 is the only one."""
    return PairwiseModel(np.zeros(n_features), -1.0 if n_good else 1.0 if n_bad else 0.0)


def learn_ranking(features: np.ndarray, label: np.ndarray, pairs: int | None = None, l2: float = 1e-3, rounds: int = 25, seed: int = 1) -> PairwiseModel:
    """The ranking of rows in memory, from all pairs as ``learn_all_pairs`` learns it.

    With ``pairs``, which no query uses, from so many random ones instead, by
    Newton's method on their differences.
    """
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return _one_sided(features.shape[1], len(good), len(bad))
    if pairs is None:
        weights = learn_all_pairs(lambda f: [f(iter([(features, label)]))], l2, rounds)[0]
    else:
        scale = features.std(axis=0, dtype=np.float64)
        scale[scale < 1e-6] = np.inf
        x = features / scale.astype(features.dtype)
        better, worse = drawn_pairs(good, bad, pairs, seed)
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            gradient, hessian = l2 * w, l2 * np.eye(len(w))
            for at in range(0, pairs, _PAIRS):  # some pairs at a time, so that their differences take little memory
                d = (x[better[at : at + _PAIRS]] - x[worse[at : at + _PAIRS]]).astype(np.float64)
                p = _sigmoid(-(d @ w))  # of the wrong order
                gradient -= (p @ d) / pairs
                hessian += (d * (p * (1 - p))[:, None]).T @ d / pairs
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        weights = w / scale
    ranked = np.sort(features @ weights)
    cut_at = len(bad)  # as many scores lie below the threshold as there are labels 0
    return PairwiseModel(weights, float((ranked[cut_at - 1] + ranked[min(cut_at, len(ranked) - 1)]) / 2))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", learn=None) -> PairwiseModel:
    """Learn from every labelled document and every pair of unlike labels.

    Features (263 numbers each) are written once to the shared folder; tasks
    sum over them, and tables and sums of bounded size reach the driver.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = _matrix(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    texts = labelled_texts(docs, labels, label, learn).select("label", "text")
    rows = cut(map_arrow(texts, features, "label int, x binary"), "quality_features")
    rows = rows.coalesce(_MOST_PARTS)  # each part sends about a megabyte

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in slices(batches, 2048):
            yield np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES), b.column("label").to_numpy()

    def parts(f: Callable) -> list[tuple]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(matrices(batches)))], pa.binary())], names=["said"])

        return [pickle.loads(x) for x in map_arrow(rows, run, "said binary").toArrow().column("said").to_pylist()]

    weights, n_good, n_bad = learn_all_pairs(parts)
    if not n_good or not n_bad:
        return _one_sided(N_FEATURES, n_good, n_bad)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in matrices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x @ weights, pa.float64())], names=["score"])

    ranked = order_statistics(cut(map_arrow(rows, scored, "score double"), "quality_scores"), "score", [n_bad - 1, n_bad])
    return PairwiseModel(weights, float(sum(ranked) / 2))


def with_quality(docs: DataFrame, model: PairwiseModel, name: str = "score", least: float | None = None) -> DataFrame:
    """``docs`` with a double column ``name`` (replaced if there); with ``least``, only the rows that reach it."""
    docs = docs.drop(name) if name in docs.columns and name != "text" else docs
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            score = model.scores(_matrix(b.column("text").to_pylist()))
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, name])
            yield out if least is None else out.filter(pa.array(score >= least))

    return map_arrow(docs, add, schema)


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, all columns as they were.

    A null text counts as empty and is judged like one; repeated rows stay or
    go together; without documents there are no rows, without labels all stay.
    """
    model = fit_quality(docs, labels)
    name = next(c for c in (f"__quality{n or ''}" for n in range(len(docs.columns) + 1)) if c not in docs.columns)
    return with_quality(docs, model, name, least).drop(name)


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty; repeated rows stay; an empty table gives no rows."""
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = fit_quality(docs, labels, learn=~held_out_fold())
    scored = with_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
