"""Near copies by exact Jaccard similarity of word shingles; SimHash links and MinHash bands say which documents meet.

A document is the set of its distinct shingle hashes; equal sets count as one
from the start. Sets whose SimHash fingerprints link (``simhash.py``) are
compared first, and what they settle is not compared again. Of ``BANDS * ROWS`` minima each band takes ``ROWS``; a pair of
similarity s misses every band with probability (1 - s ** ROWS) ** BANDS, which
is 3e-6 at 0.8. Bands whose members are the same are compared once. Sets that
meet are compared exactly, and at most one edge per row leaves a group; groups
above ``group_rows`` are dealt into chunks that meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._shared import cut, lower_bytes, map_arrow, slices
from .components import connected_components, named_components

BANDS, ROWS = 24, 4
_RNG = np.random.default_rng(11)
_FACTORS = _RNG.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
#: Shingles whose minima are taken at once, so that a very long text takes bounded memory.
STEP = 1 << 12


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; fewer words make one shingle, no words none."""
    words = lower_bytes(text).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[i:j], 42) for i, j in zip(starts, (ends[size - 1 :] - 1).tolist()))
    return np.unique(np.fromiter(hashes, np.uint64, len(starts)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band; an empty set has none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP):
        least = np.minimum(least, (hashes[at : at + STEP, None] * _FACTORS + _SHIFTS).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), n) for n, r in enumerate(rows)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if set in over half the hashes; an empty set has 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        bits = np.unpackbits(hashes[at : at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 1)


def with_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp, sim, bands, hashes, row)``; ``fp`` is a digest of the set, ``sim`` its SimHash, ``row`` a number to be written with it."""
    def lists(arrays: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, shingle) for t in b.column("text").to_pylist()]
            fps = np.fromiter(map(_digest, sets), np.uint64, len(sets))
            sims = np.fromiter(map(majority_bits, sets), np.uint64, len(sets))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(fps.view(np.int64)), pa.array(sims.view(np.int64)), lists([band_keys(s) for s in sets]), lists(sets)], names=["doc_id", "fp", "sim", "bands", "hashes"]
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long, sim long, bands array<long>, hashes array<long>").withColumn("row", F.monotonically_increasing_id())


def with_set_digest(docs: DataFrame, shingle: int = 5, name: str = "fp") -> DataFrame:
    """``docs`` with the digest of ``with_sets`` in a new column ``name``."""
    schema = docs.select("*", F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.fromiter((_digest(shingle_set(t, shingle)) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=[*b.schema.names, name])

    return map_arrow(docs, run, schema)


def set_links(sets: list[np.ndarray], similarity: float, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges, at most one a row, that connect the sorted sets as all pairs of at least ``similarity`` do.

    Sets with the same number in ``known`` are linked already.
    """
    sizes = np.array([len(s) for s in sets])
    left, edges = np.arange(len(sets)), []
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            p = reached.pop()
            if known is not None:
                same = known[left] == known[p]
                reached += left[same].tolist()
                left = left[~same]
            near = np.minimum(sizes[left], sizes[p]) >= similarity * np.maximum(sizes[left], sizes[p]) - 1e-6
            tried = left[near]
            if not len(tried):
                continue
            flat = np.concatenate([sets[i] for i in tried])
            place = np.minimum(np.searchsorted(sets[p], flat), sizes[p] - 1)
            starts = np.cumsum(sizes[tried]) - sizes[tried]
            common = np.add.reduceat((sets[p][place] == flat).astype(np.int64), starts)
            found = tried[common / (sizes[p] + sizes[tried] - common) >= similarity]
            edges += [(int(i), p) for i in found]
            reached += found.tolist()
            left = left[~np.isin(left, found)]
    return edges


def distinct_sets(sets: DataFrame) -> DataFrame:
    """Written ``with_sets`` rows -> ``(fp, sim, least_id, n, row, bands)``, one row a set; the row with the least number stands for all."""
    named = [F.min("doc_id").alias("least_id"), F.count("*").alias("n"), F.min("row").alias("row")]
    return cut(sets.groupBy("fp").agg(F.first("sim").alias("sim"), *named, F.first("bands").alias("bands")), "sets")


def confirmed_links(sets: DataFrame, own: DataFrame, links: DataFrame, similarity: float, most_broadcast: int = 1_000_000) -> DataFrame:
    """``links(u, v)`` of SimHash fingerprints -> those pairs ``(u, v)`` of sets, by ``fp``, that have ``similarity``.

    One set stands for a fingerprint in the links; the others of the same
    fingerprint are compared to it.
    """
    heads = cut(own.groupBy("sim").agg(F.min("fp").alias("head")), "heads")
    pairs = own.join(heads, "sim").where("fp <> head").select(F.col("fp").alias("u"), F.col("head").alias("v"))
    for end in ("u", "v"):
        links = links.join(heads.select(F.col("sim").alias(end), F.col("head").alias(f"head_{end}")), end)
    pairs = cut(pairs.union(links.select("head_u", "head_v")), "pairs")
    ends = pairs.select("u", "v", F.explode(F.array("u", "v")).alias("fp")).join(own.select("fp", "row"), "fp").select("row", "u", "v")
    ends = cut(ends, "ends")
    ends = F.broadcast(ends) if ends.count() <= most_broadcast else ends
    met = sets.select("row", "hashes").join(ends, "row").groupBy("u", "v").agg(F.collect_list("hashes").alias("h"))
    a, b = F.col("h")[0], F.col("h")[1]
    common = F.size(F.array_intersect(a, b))
    return cut(met.where(common / (F.size(a) + F.size(b) - common) >= similarity).select("u", "v"), "confirmed")


def set_components(sets: DataFrame, own: DataFrame, known: DataFrame, similarity: float = 0.8, group_rows: int = 1024, most_broadcast: int = 1_000_000) -> DataFrame:
    """Written ``with_sets`` rows, their ``distinct_sets`` and links ``known(u, v)`` of sets that are settled -> ``(fp, n, component, component_id)`` as ``fingerprint_components`` has them.

    What a set meets is a table of numbers; up to ``most_broadcast`` of these
    are broadcast, and then hashes move once, to the groups they are compared
    in. Groups whose sets are all linked already are left out.
    """
    label = F.coalesce("component", "fp").alias("label")
    marked = cut(own.join(connected_components(known).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "row", "bands", label), "labels")
    met = marked.select("fp", "row", "label", F.explode("bands").alias("key"))
    alike = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.min("fp").alias("a"), F.max("fp").alias("b")]
    groups = met.groupBy("key").agg(*alike, F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    groups = groups.groupBy("n", "x", "a", "b").agg(F.min("key").alias("key"))
    groups = cut(groups.select("key", F.ceil(F.col("n") / group_rows).cast("int").alias("chunks")), "groups")
    met = cut(met.join(groups, "key").select("row", "fp", "label", "key", "chunks"), "met")
    met = F.broadcast(met) if met.count() <= most_broadcast else met
    met = sets.select("row", "hashes").join(met, "row")
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", "label", "hashes")
    met = met.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fps, labels, held = None, [], [], []

        def out() -> pa.RecordBatch:
            edges = set_links(held, similarity, np.array(labels))
            return pa.RecordBatch.from_arrays([pa.array([fps[e[k]] for e in edges], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for b in batches:
            lists = b.column("hashes")
            ends = lists.offsets.to_numpy().tolist()
            values = lists.values.to_numpy().view(np.uint64)
            for n, now in enumerate(zip(*(b.column(c).to_pylist() for c in ("key", "a", "b", "fp", "label")))):
                if now[:3] != group:
                    if len(held) > 1:
                        yield out()
                    group, fps, labels, held = now[:3], [], [], []
                fps.append(now[3])
                labels.append(now[4])
                held.append(values[ends[n] : ends[n + 1]])
        if len(held) > 1:
            yield out()

    edges = known.union(map_arrow(met, links, "u long, v long"))
    return named_components(own.select("fp", "least_id", "n"), connected_components(edges))
