"""A bigram model by deleted interpolation, learned from the corpus and scored over the corpus.

Maximum-likelihood estimates of order 2, 1 and 0 are mixed with weights that
depend on how often the context occurred (buckets by powers of two). The
weights come from expectation-maximisation on held-out counts: every training
token in turn is held out by deleting its own occurrence from the counts.

The job never ships a model. Documents are packed into batches of token
numbers (a table bucketed by batch), and each batch asks for the corpus counts
of its distinct words and bigrams, which come back as a second table, bucketed
alike, so that batches and totals meet without a shuffle; it is read twice, for
the weights and for the scores. A frequent word or bigram is one entry a batch
and so no hot key. Keys are asked for in one of two ways, which give the same
totals:

* as lists: a batch deals its sorted keys by hash into buckets of a bounded
  number of tokens; sorted keys pack into some six bytes. Lists number batches
  times buckets, so this is for up to ``most_listed`` tokens;
* as rows (key, batch, place, count) beyond that: a window over the key adds
  the counts up, in a shuffle whose sort spills, and rows whose total is more
  than their batch's own count return. Both grow in proportion to the text.

Words and bigrams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import new_folder, slices, space_words

END = np.uint64(xxhash.xxh64_intdigest(b""))
START = np.uint64(xxhash.xxh64_intdigest(b" "))
BATCH_TOKENS = 1_000_000
#: Tokens whose keys one bucket adds up.
BUCKET_TOKENS = 8_000_000
#: Width of a histogram cell in natural logarithms of a probability.
CELL = 0.125
BUCKETS = 48


def _planes(values: np.ndarray) -> bytes:
    """The numbers' bytes by significance, which compress far better than number by number."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """64-bit hashes of (context, word) pairs of word hashes."""
    k = before * np.uint64(0x9E3779B97F4A7C15) + after * np.uint64(0xC2B2AE3D27D4EB4F)
    k ^= k >> np.uint64(29)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(32))


class _Batch:
    """Documents as token numbers into their sorted distinct word hashes."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.tokens = array("I")
        self.docs: list[tuple] = []

    def add(self, doc_id: int | None, held: bool, words: list[bytes]) -> None:
        index = self.index
        self.tokens.extend([index.setdefault(w, len(index)) for w in words])
        self.tokens.append(index.setdefault(b"", len(index)))
        self.docs.append((doc_id, held, len(words) + 1))

    def row(self, name: int) -> dict:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.index), np.uint64, len(self.index))
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        ids, held, sizes = zip(*self.docs)
        return {
            "batch": name, "n_tokens": len(self.tokens), "ids": list(ids), "held": list(held), "sizes": list(sizes),
            "words": _planes(hashes[order]), "tokens": _planes(place[np.frombuffer(self.tokens, np.uint32)]),
        }


_PACKED = pa.schema([("batch", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("tokens", pa.binary())])
_PACKED_SQL = "batch long, n_tokens long, ids array<long>, held array<boolean>, sizes array<int>, words binary, tokens binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made, now = TaskContext.get().partitionId(), 0, _Batch()
    for b in slices(batches):
        for doc_id, held, text in zip(*(c.to_pylist() for c in b.columns)):
            now.add(doc_id, held, space_words(text))
            if len(now.tokens) >= BATCH_TOKENS:
                yield pa.RecordBatch.from_pylist([now.row(part << 32 | made)], schema=_PACKED)
                made, now = made + 1, _Batch()
    if now.docs:
        yield pa.RecordBatch.from_pylist([now.row(part << 32 | made)], schema=_PACKED)


class _Unpacked:
    """A packed batch with its bigrams: ``uniq`` are the distinct pair keys, ``pair`` each token's number in them."""

    def __init__(self, words: bytes, tokens: bytes, sizes: list[int], held: list[bool]):
        self.words = _numbers(words, np.uint64)
        self.tokens = _numbers(tokens, np.uint32).astype(np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.train = np.repeat(~np.array(held, bool), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        hashes = self.words[self.tokens]
        before = np.concatenate(([START], hashes[:-1]))
        before[self.first] = START
        self.uniq, self.pair = np.unique(pair_keys(before, hashes), return_inverse=True)


def _dealt(keys: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Positions of the sorted keys by bucket, in order."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1])


def _listed(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            row = b.to_pylist()[0]
            x = _Unpacked(row["words"], row["tokens"], row["sizes"], row["held"])
            out = []
            for kind, keys, which in ((1, x.words, x.tokens), (2, x.uniq, x.pair)):
                counts = np.bincount(which[x.train], minlength=len(keys)).astype(np.uint32)
                for k, at in enumerate(_dealt(keys, buckets)):
                    if len(at):
                        out.append((k, row["batch"], kind, _planes(keys[at]), _planes(counts[at])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int8(), pa.binary(), pa.binary()))], names=["bucket", "batch", "kind", "keys", "counts"])

    return run


def _added_up(rows: pa.Table) -> pa.Table:
    """Per asked list the corpus counts of its keys; batch -1 carries the bucket's number of distinct words."""
    bucket, out = rows.column("bucket")[0].as_py(), []
    for kind in (1, 2):
        mine = rows.filter(pc.equal(rows.column("kind"), kind))
        if not mine.num_rows:
            continue
        keys = [_numbers(k, np.uint64) for k in mine.column("keys").to_pylist()]
        counts = np.concatenate([_numbers(c, np.uint32) for c in mine.column("counts").to_pylist()])
        uniq, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, counts, len(uniq)).astype(np.uint64)
        if kind == 1:
            out.append((-1, bucket, 0, int((total > 0).sum()), b""))
        at = 0
        for batch, k in zip(mine.column("batch").to_pylist(), keys):
            out.append((batch, bucket, kind, 0, _planes(total[which[at : at + len(k)]])))
            at += len(k)
    types = (pa.int64(), pa.int32(), pa.int8(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["batch", "bucket", "kind", "v", "totals"])


#: Where a batch's bigrams begin among its places; words come before.
PAIRS = 1 << 31


def _as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per distinct word and bigram of a batch, with its training occurrences there."""
    for b in slices(batches, 1):
        row = b.to_pylist()[0]
        x = _Unpacked(row["words"], row["tokens"], row["sizes"], row["held"])
        for first, keys, which in ((0, x.words, x.tokens), (PAIRS, x.uniq, x.pair)):
            counts = np.bincount(which[x.train], minlength=len(keys)).astype(np.int32)
            for at in range(0, len(keys), 100_000):
                n = len(keys[at : at + 100_000])
                columns = (pa.array(keys[at : at + n].view(np.int64)), pa.array(np.full(n, row["batch"])), pa.array(first + at + np.arange(n)), pa.array(counts[at : at + n]))
                yield pa.RecordBatch.from_arrays(list(columns), names=["key", "batch", "place", "n"])


def _counted(buckets: int, batch: pa.Table, got: pa.Table) -> tuple | None:
    """(unpacked batch, its row, counts per token of context, bigram and word); None for a group without a batch."""
    if not batch.num_rows:
        return None
    row = batch.to_pylist()[0]
    x = _Unpacked(row["words"], row["tokens"], row["sizes"], row["held"])
    if buckets:
        lists = {(k, b): t for k, b, t in zip(*(got.column(c).to_pylist() for c in ("kind", "bucket", "totals")))}
        words, pairs = np.zeros(len(x.words), np.int64), np.zeros(len(x.uniq), np.int64)
        for kind, keys, total in ((1, x.words, words), (2, x.uniq, pairs)):
            for k, at in enumerate(_dealt(keys, buckets)):
                if len(at):
                    total[at] = _numbers(lists[kind, k], np.uint64)
    else:  # what no other batch has is as often as here
        words, pairs = (np.bincount(which[x.train], minlength=len(keys)) for keys, which in ((x.words, x.tokens), (x.uniq, x.pair)))
        place, total = got.column("place").to_numpy(), got.column("total").to_numpy()
        pair = place >= PAIRS
        words[place[~pair]], pairs[place[pair] - PAIRS] = total[~pair], total[pair]
    word, pair = words[x.tokens], pairs[x.pair]
    context = np.concatenate(([0], word[:-1]))
    # a document's first context is its start, which occurs as often as the end does
    context[x.first] = words[np.flatnonzero(x.words == END)[0]]
    return x, row, context, pair, word


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def cells(context: np.ndarray, pair: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Held-out histogram of training tokens: (bucket, bigram cell, word cell, tokens, sum p2, sum p1).

    Each token's own occurrence is deleted from all three counts first.
    """
    context, pair, word = context - 1, pair - 1, word - 1
    p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    p1 = word / max(n - 1, 1)
    cell = lambda p: np.where(p > 0, 1 + np.floor(-np.log(np.maximum(p, 1e-300)) / CELL), 0).astype(np.int64)
    key = (bucket_of(context).astype(np.int64) << 40) | (cell(p2) << 20) | cell(p1)
    uniq, which = np.unique(key, return_inverse=True)
    sums = [np.bincount(which, w, len(uniq)) for w in (np.ones(len(which)), p2, p1)]
    return uniq >> 40, uniq >> 20 & 0xFFFFF, uniq & 0xFFFFF, *sums


def learn_weights(bucket: np.ndarray, tokens: np.ndarray, p2: np.ndarray, p1: np.ndarray, v: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (buckets x order 2, 1, 0) by expectation-maximisation on the held-out histogram.

    One pseudo-count for each order keeps every weight above zero; a bucket
    without tokens takes the weights of the nearest lower one that has some.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    p = np.stack([p2, p1, np.full(len(p1), 1 / (v + 1))], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (tokens / share.sum(axis=1))[:, None]
        new = 1.0 + np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], axis=1)
        weights = new / new.sum(axis=1, keepdims=True)
    seen = np.bincount(bucket, tokens, BUCKETS) > 0
    last = np.array([0.0, 0.0, 1.0])
    for b in range(BUCKETS):
        last = weights[b] = weights[b] if seen[b] else last
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]  # nothing is known after an unseen context
    return weights


def probabilities(weights: np.ndarray, context: np.ndarray, pair: np.ndarray, word: np.ndarray, n: int, v: int) -> np.ndarray:
    w = weights[bucket_of(context)]
    return w[:, 0] * np.where(context > 0, pair / np.maximum(context, 1), 0.0) + w[:, 1] * (word / max(n, 1)) + w[:, 2] / (v + 1)


def _bucketed(df: DataFrame, name: str, parts: int) -> DataFrame:
    """``df`` as a table in ``parts`` buckets by batch."""
    spark = df.sparkSession
    where = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(parts, "batch").option("path", new_folder(spark, name)).option("compression", "zstd")
    writer.saveAsTable(where)
    found = spark.table(where)
    spark.sql(f"DROP TABLE {where}")  # only the catalog's entry: the files stay, and the frame knows them and their buckets
    return found


def corpus_totals(packed: DataFrame, parts: int, buckets: int) -> tuple[DataFrame, int]:
    """(a table of totals by batch, distinct training words); as lists in ``buckets`` buckets, as rows if there are none.

    Totals are dealt by batch before they are written, so that each task writes its own buckets alone.
    """
    asked = packed.select("batch", "held", "sizes", "words", "tokens")
    if buckets:
        asks = asked.mapInArrow(_listed(buckets), "bucket int, batch long, kind byte, keys binary, counts binary")
        totals = asks.groupBy("bucket").applyInArrow(_added_up, "batch long, bucket int, kind byte, v long, totals binary")
        totals = _bucketed(totals.repartition(parts, "batch"), "totals", parts)
        return totals.where("kind > 0").select("batch", "bucket", "kind", "totals"), totals.where("kind = 0").agg(F.sum("v")).first()[0] or 0
    same = Window.partitionBy("key", F.col("place") >= PAIRS)
    asks = asked.mapInArrow(_as_rows, "key long, batch long, place long, n int")
    first = (F.min("batch").over(same) == F.col("batch")) & (F.col("place") < PAIRS)
    totals = asks.select("batch", "place", "n", F.sum("n").over(same).alias("total"), first.alias("first")).where("total > n OR first AND total > 0")
    totals = _bucketed(totals.drop("n").repartition(parts, "batch"), "totals", parts)
    return totals.select("batch", "place", "total"), totals.where("first").count()


def interpolated_scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", most_listed: int = 20_000_000_000) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    The model learns from the rows whose ``held_out`` is false; a null there
    counts as true. Tokens are the folded words and one end; a null or empty
    text is the end alone. Repeated rows count each; no rows give no rows;
    other columns are not read. Beyond ``most_listed`` tokens keys are asked
    for as rows, not as lists, with the same result.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held"), F.col(text).cast("string").alias("text"))
    packed = _bucketed(rows.mapInArrow(_pack, _PACKED_SQL), "packed", parts)  # a task writes no more files than it has batches
    trained = F.aggregate(F.arrays_zip("held", "sizes"), F.lit(0).cast("long"), lambda s, x: s + F.when(x["held"], 0).otherwise(x["sizes"]))
    every, n = (x or 0 for x in packed.agg(F.sum("n_tokens"), F.sum(trained)).first())
    buckets = max(64, math.ceil(every / BUCKET_TOKENS)) if every <= most_listed else 0
    totals, v = corpus_totals(packed, parts, buckets)
    met = packed.groupBy("batch").cogroup(totals.groupBy("batch"))
    cell_types = [(c, pa.int64()) for c in ("bucket", "cell2", "cell1")] + [(c, pa.float64()) for c in ("tokens", "p2", "p1")]

    def histogram(batch: pa.Table, got: pa.Table) -> pa.Table:
        found = _counted(buckets, batch, got)
        if found is None:
            return pa.schema(cell_types).empty_table()
        x, _, context, pair, word = found
        return pa.table([pa.array(c, t) for c, (_, t) in zip(cells(context[x.train], pair[x.train], word[x.train], n), cell_types)], names=[c for c, _ in cell_types])

    held = met.applyInArrow(histogram, "bucket long, cell2 long, cell1 long, tokens double, p2 double, p1 double")
    held = held.groupBy("bucket", "cell2", "cell1").agg(*(F.sum(c).alias(c) for c in ("tokens", "p2", "p1"))).toArrow()
    b, tokens, p2, p1 = (held.column(c).to_numpy() for c in ("bucket", "tokens", "p2", "p1"))
    weights = learn_weights(b, tokens, p2 / np.maximum(tokens, 1), p1 / np.maximum(tokens, 1), v)
    out = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def score(batch: pa.Table, got: pa.Table) -> pa.Table:
        found = _counted(buckets, batch, got)
        if found is None:
            return pa.schema(out).empty_table()
        x, row, context, pair, word = found
        by_doc = lambda values: np.add.reduceat(values, x.first)
        base = by_doc(np.log10((word + 0.1) / (n + 0.1 * (v + 1))))
        model = by_doc(np.log10(probabilities(weights, context, pair, word, n, v)))
        columns = [row["ids"], row["held"], x.sizes, by_doc((word > 0).astype(np.int64)), np.full(len(x.sizes), n, np.int64), base, model]
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, out)], names=[c for c, _ in out])

    return met.applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, learning from those outside the held-out tenth; odd rows as in ``interpolated_scores``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return interpolated_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
