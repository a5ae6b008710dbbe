"""SimHash near-duplicates, compared through pivot distance tables.

A document's fingerprint has 64 bits. Two fingerprints link when at most
``radius`` bits differ. Distances to fixed pivot fingerprints obey the triangle
inequality, so a pair whose distances to any pivot differ by more than
``radius`` cannot link; only pairs that pass every pivot are verified exactly.

Which pairs meet at all is settled by blocks, since the coordinates of random
fingerprints all lie near 32 and so tell too few of them apart to be a join key:
with one pivot a pair passes with probability 0.57, with 16 with 1e-4. The
fingerprint is cut into ``radius + k`` blocks, and a linking pair agrees on at
least ``k`` of them, so it meets in a group of one of the choices of ``k``
blocks. ``k`` grows with the number of fingerprints (2 to 5, of 15 to 126
groups a fingerprint), so that groups of unrelated ones stay small; none of
this loses a pair. A fingerprint's pivot distances are computed once and go
along to its groups. Groups above ``group_rows`` are dealt into chunks, and
chunks meet pairwise, so no task grows with a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import cut, lower_bytes, map_arrow, slices, spread_join
from .components import connected_components, named_components
from .set_similarity import confirmed_links, distinct_sets, set_components, with_set_digest, with_sets

BITS = 64
#: Shingles whose bits are counted at once, so that a very long text takes bounded memory.
STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of XXH64 over word shingles, repeats included, as an unsigned integer.

    Fewer words than ``shingle`` make one shingle of all of them; no words give 0.
    """
    words = lower_bytes(text).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    n = len(words) - shingle + 1
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    for at in range(0, n, STEP):
        hashes = np.fromiter(
            (digest(joined[i:j], seed) for i, j in zip(starts[at : at + STEP], stops[at : at + STEP])), np.uint64
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = 4) -> DataFrame:
    """``docs`` with a long column ``name`` that holds the fingerprint's 64 bits (replaced if there)."""
    docs = docs.drop(name) if name in docs.columns and name != text else docs
    schema = docs.select("*", F.lit(0).cast("long").alias(name)).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(text).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=[*b.schema.names, name])

    return map_arrow(docs, add, schema)


def pivots(count: int = 16) -> np.ndarray:
    """Reference fingerprints: hashes of 0, 1, 2, ..., so every task has the same ones."""
    return np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(count)], np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot, one row per pivot."""
    return np.stack([np.bitwise_count(fps ^ p).astype(np.int8) for p in refs])


def packed_distances(fp: Column, refs: np.ndarray) -> list[Column]:
    """``distance_table`` in Spark: longs of eight distances each, a byte a pivot."""
    out = []
    for at in range(0, len(refs), 8):
        word = F.lit(0).cast("long")
        for n, ref in enumerate(refs[at : at + 8].view(np.int64).tolist()):
            word = word.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(ref).cast("long"))).cast("long"), 8 * n))
        out.append(word.alias(f"pivots{at // 8}"))
    return out


def unpacked_distances(words: list[np.ndarray]) -> np.ndarray:
    """The rows of ``distance_table`` from the columns of ``packed_distances``."""
    return np.concatenate([np.ascontiguousarray(w).view(np.int8).reshape(-1, 8).T for w in words])


def _linked(fps: np.ndarray, dist: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple:
    """The pairs that no pivot discards and that an exact comparison confirms."""
    for row in dist:
        keep = np.abs(row[i] - row[j]) <= radius
        i, j = i[keep], j[keep]
        if not len(i):
            return i, j
    keep = np.bitwise_count(fps[i] ^ fps[j]) <= radius
    return i[keep], j[keep]


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Label of each of n rows: the smallest row it is linked to, directly or not."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def group_links(fps: np.ndarray, group: np.ndarray, dist: np.ndarray, radius: int, side: int = 64) -> tuple:
    """Links inside the runs of equal ``group`` as at most one edge per row: (u, v) arrays; ``dist`` is their distance table."""
    n = len(fps)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, n))
    found_i, found_j = [], []
    small = np.repeat(np.where(sizes <= side, sizes, 0), sizes)
    place = np.arange(n) - np.repeat(starts, sizes)
    rows = np.flatnonzero(small > 1)
    for shift in range(1, side):
        rows = rows[place[rows] + shift < small[rows]]
        if not len(rows):
            break
        i, j = _linked(fps, dist, rows, rows + shift, radius)
        found_i.append(i)
        found_j.append(j)
    for start, size in zip(starts[sizes > side], sizes[sizes > side]):
        order = start + np.argsort(dist[0, start : start + size], kind="stable")
        first = dist[0, order]
        upto = np.searchsorted(first, first + radius, side="right")
        for at in range(0, size, 256):
            part = np.arange(at, min(at + 256, size))
            width = upto[part] - part - 1
            i = np.repeat(part, width)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
            i, j = _linked(fps, dist, order[i], order[j], radius)
            found_i.append(i)
            found_j.append(j)
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_i, found_j))
    label = _stars(i, j, n)
    rest = np.flatnonzero(label != np.arange(n))
    return fps[rest], fps[label[rest]]


def _blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of n blocks that cover the 64 bits."""
    edges = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def equal_blocks(rows: int, radius: int, most: int = 5) -> int:
    """How many blocks a group agrees on: the fewest for which groups of unrelated fingerprints have 64 rows at most, up to ``most``."""
    return next((k for k in range(2, most) if rows >> (BITS * k // (radius + k)) <= 64), most)


def _key(fp: Column, blocks: tuple) -> Column:
    key = F.lit(0).cast("long")
    for at, width in blocks:
        key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)))
    return key


def fingerprint_links(fps: DataFrame, radius: int = 4, group_rows: int = 2048, n_pivots: int = 16, most_hot: int = 100_000, equal: int | None = None) -> DataFrame:
    """Edges ``(u, v)`` that connect the distinct longs ``fps(fp)`` as all links of up to ``radius`` bits do.

    ``equal`` blocks of ``radius + equal`` make a group; without it the number
    follows from the count. The list of hot groups is broadcast while it has
    ``most_hot`` rows at most, else it is joined by a shuffle that AQE splits.
    """
    refs = pivots(n_pivots)
    fps = cut(fps.select("fp", *packed_distances(F.col("fp"), refs)), "distances")
    equal = equal or equal_blocks(fps.count(), radius)
    choices = list(combinations(_blocks(radius + equal), equal))
    near = fps.columns[1:]
    met = fps.select(
        "fp", *near,
        F.explode(F.array(*[F.struct(F.lit(n).alias("band"), _key(F.col("fp"), c).alias("key")) for n, c in enumerate(choices)])).alias("x"),
    ).select("fp", *near, "x.band", "x.key")
    hot = met.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > group_rows)
    hot = cut(hot.select("band", "key", F.ceil(F.col("n") / group_rows).cast("int").alias("chunks")), "hot")
    hot = F.broadcast(hot) if hot.count() <= most_hot else hot
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    met = met.join(hot, ["band", "key"], "left").withColumn("own", F.coalesce(own, F.lit(0)))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks") - 1, F.lit(0)))))
    met = met.select("band", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", *near)
    met = met.repartition("band", "key", "a", "b").sortWithinPartitions("band", "key", "a", "b", "fp")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(part: list[np.ndarray]) -> pa.RecordBatch:
            change = np.zeros(len(part[0]), bool)
            for c in part[:4]:
                change[1:] |= c[1:] != c[:-1]
            u, v = group_links(part[4].view(np.uint64), np.cumsum(change), unpacked_distances(part[5:]), radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            n = len(held[0])
            last = np.ones(n, bool)
            for c in held[:4]:
                last &= c == c[-1] if n else last
            whole = n - int(last.sum())
            if whole >= 20_000:
                yield out([c[:whole] for c in held])
                held = [c[whole:] for c in held]
        if held is not None and len(held[0]):
            yield out(held)

    return map_arrow(met, links, "u long, v long")


def fingerprint_components(prints: DataFrame, radius: int = 4) -> DataFrame:
    """``prints(doc_id, fp)`` -> ``(fp, n, component, component_id)``: per distinct fingerprint its rows and the smallest doc_id reachable.

    ``component`` is the component's smallest fingerprint. A null doc_id never is the smallest; a component of null ids alone has a null id.
    """
    own = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "prints")
    return named_components(own, connected_components(fingerprint_links(own.select("fp"), radius)))


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    Null and empty texts have fingerprint 0 and link like any other; repeated
    rows stay; other columns are not read; no rows give no rows.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = cut(with_fingerprint(docs).select("doc_id", "fp"), "fingerprints")
    found = spread_join(prints, fingerprint_components(prints, radius), ["fp"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 4, most_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, one row per such id.

    Documents link where the Jaccard similarity of their word shingles is at
    least ``similarity``. SimHash fingerprints of the shingles are searched
    through the pivot distance tables, and links of up to ``radius`` bits are
    confirmed by exact similarity. At 0.8 fingerprints lie some ten bits apart,
    so what is not linked by then is also met by MinHash bands. All columns stay. Rows that repeat a doc_id
    with a text of the same component count as one document: the one with the
    smallest text stays. Null ids count as one id, which stays where its
    component has no other; null and empty texts are one group; an empty table
    gives no rows.

    Where ids are unique, the ids that go are taken out by an anti-join; up to
    ``most_broadcast`` of them are broadcast, and then no text is shuffled.
    """
    columns = docs.columns
    prints = cut(with_sets(docs, shingle), "sets")
    own = distinct_sets(prints)
    links = fingerprint_links(own.select(F.col("sim").alias("fp")).distinct(), radius)
    stay = set_components(prints, own, confirmed_links(prints, own, links, similarity), similarity)
    if not prints.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count():
        gone = cut(spread_join(prints.select("doc_id", "fp"), stay, ["fp"]).where("doc_id <> component_id").select("doc_id"), "gone")
        gone = F.broadcast(gone) if gone.count() <= most_broadcast else gone
        return docs.join(gone, "doc_id", "left_anti").select(*columns)
    marked = with_set_digest(docs, shingle, name="__fp")
    stay = stay.withColumnsRenamed({"fp": "__fp", "n": "__rows", "component": "__component", "component_id": "__id"})
    order = Window.partitionBy("doc_id", "__component").orderBy("text")
    kept = spread_join(marked, stay, ["__fp"], "__rows").where(F.col("doc_id").eqNullSafe(F.col("__id")))
    return kept.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*columns)
