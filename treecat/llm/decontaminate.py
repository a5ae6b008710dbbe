"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all text.

Words are runs of digits, letters and non-ASCII characters after folding A-Z.
A benchmark item gives every window of ``width`` consecutive words; a shorter
item is one window. Tasks turn the items into a table of windows, each with a
rolling 64-bit hash and a 128-bit BLAKE2 digest of its words. A document's
windows are hashed at once from prefix sums; a hash that hits is verified by
the digest.

Up to ``most_bytes`` the windows are broadcast as sorted arrays, and the pass
over the documents has no shuffle. Beyond it a bitmap of fixed size is
broadcast instead, the windows that it lets through meet the window table in a
shuffle join that carries row numbers and digests, and both ways give the same
rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._shared import cut, map_arrow, slices

#: 0-9, a-z and bytes from 0x80 stay, A-Z fold, all else is a space.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RUN = re.compile(rb"[^ ]+")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of a window in the broadcast arrays: hash, digest, item.
WINDOW_BYTES = 28
#: Bits of the bitmap, as a power of two, at most.
MOST_BITS = 28
_MEMO = 500_000


def words(text: str | None) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the folded text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


def digest(window: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(window), digest_size=16).digest()


class _Hashes(dict):
    """Word -> place of its hash in ``table()``; a word not seen before is hashed when asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.values, self._known = [], np.empty(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self.values.append(xxhash.xxh64_intdigest(word))
        self[word] = place = len(self._known) + len(self.values) - 1
        return place

    def table(self) -> np.ndarray:
        """All hashes by place."""
        if self.values:
            self._known, self.values = np.concatenate([self._known, np.array(self.values, np.uint64)]), []
        return self._known


class Rolling:
    """Window hashes of word sequences: sum of h(word j) * BASE ** j, from prefix sums modulo 2 ** 64."""

    def __init__(self) -> None:
        self.seen, self.power, self.back = _Hashes(), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def sums(self, flat: list[bytes]) -> np.ndarray:
        """Prefix sums, from which ``hashes`` takes windows."""
        n = len(flat)
        if len(self.seen) > _MEMO:
            self.seen = _Hashes()
        at = np.fromiter(map(self.seen.__getitem__, flat), np.int64, n)
        h = self.seen.table()[at]
        if len(self.power) < n + 1:
            size = max(n + 1, 2 * len(self.power))
            grown = lambda base: np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64))))
            self.power, self.back = grown(_BASE), grown(_INVERSE)
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.power[:n], dtype=np.uint64)))

    def hashes(self, sums: np.ndarray, size: int) -> np.ndarray:
        """The hash of every window of ``size`` words, by its first word."""
        n = len(sums) - size
        return (sums[size:] - sums[:n]) * self.back[:n] if n > 0 else np.empty(0, np.uint64)


def window_table(items: DataFrame, width: int) -> DataFrame:
    """``items(item long, text)`` -> ``(item, size, hash, digest)``, one row per distinct window of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for b in slices(batches, 1):
            found = words(b.column("text")[0].as_py())
            size = min(width, len(found))
            if size:
                uniq, first = np.unique(rolling.hashes(rolling.sums(found), size), return_index=True)
                for at in range(0, len(uniq), 100_000):
                    part, rows = uniq[at : at + 100_000], first[at : at + 100_000].tolist()
                    item = b.column("item")[0].as_py()
                    columns = [pa.array([item] * len(part), pa.int64()), pa.array([size] * len(part), pa.int32()), pa.array(part.view(np.int64)), pa.array([digest(found[i : i + size]) for i in rows], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "size", "hash", "digest"])

    return map_arrow(items, run, "item long, size int, hash long, digest binary")


def filter_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places in a bitmap of 2 ** bits."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


class WindowSet:
    """The windows by size, as sorted arrays; ``names`` are the items' ids as strings (None for a null id)."""

    def __init__(self, windows: pa.Table, names: dict[int, str | None]):
        self.names = sorted({n for n in names.values() if n is not None})
        place = {n: i for i, n in enumerate(self.names)} | {None: -1}
        keys = np.array(sorted(names), np.int64)
        values = np.array([place[names[k]] for k in keys.tolist()], np.int32)
        size, hashes, item = (windows.column(c).to_numpy() for c in ("size", "hash", "item"))
        whole = pa.concat_arrays(windows.column("digest").chunks) if len(size) else None  # its values are 16 bytes each, end to end
        digests = np.frombuffer(whole.buffers()[2], ">u8", 2 * len(size)).reshape(-1, 2).astype(np.uint64) if len(size) else np.empty((0, 2), np.uint64)
        self.tables = {}
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            h, d, names_ = hashes[rows].view(np.uint64), digests[rows], values[np.searchsorted(keys, item[rows])]
            order = np.lexsort((names_, d[:, 1], d[:, 0], h))
            h, d, names_ = h[order], d[order], names_[order]
            new = np.ones(len(h), bool)  # a window's rows stand together
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            bits = int(np.clip(len(first).bit_length() + 3, 12, 26))
            may_be = np.zeros(1 << bits, bool)
            may_be[filter_bits(h[first], bits)] = True
            self.tables[n] = h[first], np.ascontiguousarray(d[first]).astype(">u8").view("V16").ravel(), np.append(first, len(h)), names_, bits, may_be

    def hits(self, rolling: Rolling, flat: list[bytes], ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first word, words, item numbers) of every window found in documents whose words stand end to end; ``ends`` gives for each word its document's end."""
        sums = rolling.sums(flat)
        for size, (hashes, digests, first, names, bits, may_be) in self.tables.items():
            found = rolling.hashes(sums, size)
            at = np.flatnonzero(may_be[filter_bits(found, bits)])
            at = at[at + size <= ends[at]]
            place = np.searchsorted(hashes, found[at])
            same = hashes[np.minimum(place, len(hashes) - 1)] == found[at]
            for i, p in zip(at[same].tolist(), place[same].tolist()):
                sure = digest(flat[i : i + size])  # verified: a hash alone may be another window's
                while p < len(hashes) and hashes[p] == found[i]:
                    if digests[p].tobytes() == sure:
                        yield i, size, names[first[p] : first[p + 1]]
                        break
                    p += 1


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def remove_runs(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` without the words [begin, end) of each run and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _RUN.finditer(raw.translate(_WORD))]
    kept, at = [], 0
    for begin, end in runs:
        kept.append(raw[at : places[begin][0]])
        at = places[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def _columns(counts: list, runs: list, held: list) -> list[pa.Array]:
    spans = [[{"begin": x, "end": y} for x, y in r] for r in runs]
    return [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(held, pa.list_(pa.string()))]


def _flat(texts: list) -> tuple[list[list[bytes]], list[bytes], np.ndarray, np.ndarray]:
    """(words by text, all words, each word's text's start, and its end)."""
    found = [words(t) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    stops = np.cumsum(sizes)
    return found, list(chain.from_iterable(found)), stops - sizes, np.repeat(stops, sizes)


_ADDED = {"n_words": "bigint", "hit_runs": "array<struct<begin:int,end:int>>", "hit_items": "array<string>"}


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = 10, most_bytes: int = 64 << 20, keep_text: bool = True, most_broadcast: int = 1_000_000) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_runs`` (word positions [begin, end)) and ``hit_items`` (sorted ids as strings).

    Columns of these names are replaced; without ``keep_text`` the text goes. A
    null or empty text has no words and no hits. Benchmark rows without words
    take no part; the words of those with a null id hit, but the id is no item.
    Repeated items count once, repeated documents each; empty tables are fine.
    """
    spark = docs.sparkSession
    docs = docs.drop(*(c for c in _ADDED if c != text))
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = cut(items.where("text is not null"), "items")
    windows = cut(window_table(items.select("item", "text"), width), "windows")
    size = windows.count() * WINDOW_BYTES + (items.agg(F.sum(F.coalesce(F.length("item_id"), F.lit(0)) + 60)).first()[0] or 0)
    names = [c for c in docs.columns if keep_text or c != text]
    schema = docs.select(*names, *(F.lit(None).cast(t).alias(c) for c, t in _ADDED.items())).schema
    if size > most_bytes:
        return _scan_by_join(docs, items, windows, text, names, schema, most_broadcast)
    held = WindowSet(windows.toArrow(), {r["item"]: r["item_id"] for r in items.select("item", "item_id").collect()})
    shared = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rolling = shared.value, Rolling()
        for b in slices(batches):
            found, flat, starts, ends = _flat(b.column(text).to_pylist())
            edge, which = np.zeros(len(flat) + 1, np.int32), [set() for _ in found]
            for i, n, holders in index.hits(rolling, flat, ends):
                edge[i] += 1
                edge[i + n] -= 1
                which[int(np.searchsorted(starts, i, "right")) - 1].update(holders.tolist())
            hit = np.cumsum(edge[:-1]) > 0
            runs = [_runs(hit[a : a + len(w)]) if any_ else [] for a, w, any_ in zip(starts.tolist(), found, which)]
            out = _columns(list(map(len, found)), runs, [sorted(index.names[i] for i in x if i >= 0) for x in which])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *out], names=[*names, *_ADDED])

    return map_arrow(docs, run, schema)


def _scan_by_join(docs: DataFrame, items: DataFrame, windows: DataFrame, text: str, names: list[str], schema, most_broadcast: int) -> DataFrame:
    """The same for window tables of any size."""
    spark = docs.sparkSession
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most the width
    bits = int(np.clip(windows.count().bit_length() + 3, 12, MOST_BITS))
    place = F.shiftrightunsigned("hash", 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    filled = windows.groupBy(F.shiftrightunsigned(place, 6).alias("word")).agg(F.bit_or(bit).alias("set")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[filled.column("word").to_numpy()] = filled.column("set").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)
    kind = "array<struct<at:int,size:int,hash:bigint,digest:binary>>"
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    seen_schema = numbered.select("__row", *names, F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast(kind).alias("__seen")).schema
    seen_type = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("digest", pa.binary())]))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, bitmap = Rolling(), shared.value
        for b in slices(batches):
            found, flat, starts, ends = _flat(b.column(text).to_pylist())
            sums, seen = rolling.sums(flat), [[] for _ in found]
            for size in sizes:
                hashes = rolling.hashes(sums, size)
                at = filter_bits(hashes, bits)
                at = np.flatnonzero(bitmap[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
                at = at[at + size <= ends[at]]
                for i, h in zip(at.tolist(), hashes[at].view(np.int64).tolist()):
                    d = int(np.searchsorted(starts, i, "right")) - 1
                    seen[d].append({"at": i - int(starts[d]), "size": size, "hash": h, "digest": digest(flat[i : i + size])})
            columns = [b.column("__row"), *(b.column(c) for c in names), pa.array(list(map(len, found)), pa.int64()), pa.array(seen, seen_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["__row", *names, "n_words", "__seen"])

    sifted = cut(map_arrow(numbered, sift, seen_schema), "sifted")
    seen = sifted.select("__row", F.explode("__seen").alias("s")).select("__row", "s.*")
    hits = cut(seen.join(windows, ["size", "hash", "digest"]).join(items.select("item", "item_id"), "item").groupBy("__row").agg(F.collect_set(F.struct("at", "size")).alias("__spans"), F.sort_array(F.collect_set("item_id")).alias("hit_items")), "hits")
    hits = F.broadcast(hits) if hits.count() <= most_broadcast else hits
    met = sifted.drop("__seen").join(hits, "__row", "left").drop("__row")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            runs = []
            for n, spans in zip(b.column("n_words").to_pylist(), b.column("__spans").to_pylist()):
                edge = np.zeros(n + 1, np.int32)
                for s in spans or ():
                    edge[s["at"]] += 1
                    edge[s["at"] + s["size"]] -= 1
                runs.append(_runs(np.cumsum(edge[:-1]) > 0) if spans else [])
            out = _columns(b.column("n_words").to_pylist(), runs, [x or [] for x in b.column("hit_items").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *out], names=[*names, *_ADDED])

    return map_arrow(met, merge, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """One row per document: how many of its words a benchmark window covers, and a digest of the items; odd rows as in ``scan``."""
    found = scan(docs.select("doc_id", "text"), benchmark, width=width, keep_text=False)
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("bigint"), lambda s, r: s + (r["end"] - r["begin"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", width: int = 10) -> DataFrame:
    """``docs`` without what the benchmark contaminates; all columns stay.

    ``mode`` "documents" drops the documents with a hit, "spans" keeps them and
    removes the covered words from ``text``. Null and empty texts stay, as do
    repeated rows; an empty benchmark contaminates nothing.
    """
    columns, schema = docs.columns, docs.schema
    found = scan(docs.withColumns({f"__{c}": F.col(c) for c in ("n_words", "hit_runs", "hit_items") if c in columns}), benchmark, width=width)
    if mode == "documents":
        kept = found.where(F.size("hit_runs") == 0)
        return kept.select(*(F.col(f"__{c}").alias(c) if f"__{c}" in found.columns else F.col(c) for c in columns))
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cleaned = [
                remove_runs(t, [(r["begin"], r["end"]) for r in runs]) if runs else t
                for t, runs in zip(b.column("text").to_pylist(), b.column("hit_runs").to_pylist())
            ]
            take = lambda c: f"__{c}" if f"__{c}" in b.schema.names else c
            yield pa.RecordBatch.from_arrays([pa.array(cleaned, pa.string()) if c == "text" else b.column(take(c)) for c in columns], names=columns)

    return map_arrow(found, run, schema)


#: Items' and documents' windows, joined; DuckDB.
CONTAMINATION_SQL = r"""
WITH
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, size, p, array_to_string(w[p:p + size - 1], ' ') AS k
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
h AS (SELECT rid, p, dw.size, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.size = bw.size),
hits AS (
  SELECT rid, count(DISTINCT q) AS n_hit
  FROM (SELECT rid, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT rid, p, size FROM h)) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT rid, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""
