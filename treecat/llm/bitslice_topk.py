"""Exact top-k inner products through a bit-sliced index.

Each task turns its rows, in blocks, into an index: bit j of a component's code
for all rows of the block is one bitmap, a slice. Codes keep every bit of the
quantised components, so the slices' sum weighted by a query's components *is*
the score. The sum is taken over whole bitmaps by carry-save adders, and its
slices give the top rows from the most significant downward: at each one, the
rows that have the bit stay if they are enough, else they are in and the search
goes on among the others. Only ties at the last place are left to resolve, by
the smaller id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._shared import new_folder, table

BLOCK = 1 << 15


class SlicedBlock:
    """The bit-sliced index of the rows ``values`` (n x d integers), in order of their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.n, values = ids[order], len(ids), values[order]
        self.low = values.min(axis=0)
        codes = values - self.low
        self.depth = max(1, int(codes.max(initial=0)).bit_length())
        self.words = -(-self.n // 64)
        packed = np.zeros((values.shape[1], self.depth, self.words * 8), np.uint8)
        for j in range(self.depth):
            rows = np.packbits(((codes >> j) & 1).astype(np.uint8).T, axis=1, bitorder="little")
            packed[:, j, : rows.shape[1]] = rows
        self.slices = packed.view(np.uint64)
        alive = np.zeros(self.words * 8, np.uint8)
        alive[: -(-self.n // 8)] = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        self.alive = alive.view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of A >= 0 and a number: every row's score is that number plus A.

        A negative weight takes the complement of the code, so that all terms are positive:
        -|w| * code = |w| * (top - code) - |w| * top.
        """
        top = (1 << self.depth) - 1
        weight, negative = np.abs(query), query < 0
        base = int(query @ self.low) - int(weight[negative].sum()) * top
        columns: dict[int, list[np.ndarray]] = defaultdict(list)
        for k in range(int(weight.max(initial=0)).bit_length()):
            dims = np.flatnonzero(weight >> k & 1)
            planes = self.slices[dims] ^ np.where(negative[dims], ~np.uint64(0), np.uint64(0))[:, None, None]
            for j in range(self.depth):
                columns[k + j].append(planes[:, j])
        out, k = [], 0
        while columns and k <= max(columns):
            column = np.concatenate([*columns.pop(k, []), np.empty((0, self.words), np.uint64)])
            while len(column) > 2:  # carry-save: three slices become a sum and a carry, all triples at once
                m = len(column) // 3
                a, b, c, rest = column[:m], column[m : 2 * m], column[2 * m : 3 * m], column[3 * m :]
                x = a ^ b
                columns[k + 1].append((a & b) | (x & c))
                column = np.concatenate([x ^ c, rest])
            if len(column) == 2:
                columns[k + 1].append((column[0] & column[1])[None])
                column = column[:1] ^ column[1:]
            out.append(column[0] if len(column) else np.zeros(self.words, np.uint64))
            k += 1
        return out, base

    def top(self, query: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best rows, ties to smaller ids, and how many rows were resolved beyond the slices.

        Rows that score less than ``floor`` may be left out.
        """
        sums, base = self.sums(query)
        if floor is not None and (floor - base) >> len(sums) > 0:
            return self.ids[:0], self.ids[:0], 0
        sure, open_ = np.zeros_like(self.alive), self.alive
        for i in range(len(sums) - 1, -1, -1):  # from the most significant slice downward
            both = open_ & sums[i]
            if int(np.bitwise_count(sure | both).sum()) >= k:
                open_ = both
            else:
                sure, open_ = sure | both, open_ & ~sums[i]
        positions = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
        inside, ties = positions(sure), positions(open_)
        rows = np.concatenate([inside, ties[: k - len(inside)]])  # rows stand by id: the first ties have the smallest
        scores = np.full(len(rows), base, np.int64)
        for i, s in enumerate(sums):
            scores += (s[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << i
        return self.ids[rows], scores, len(ties)


def _whole(vectors: pa.ListArray, scale: float) -> tuple[np.ndarray, list]:
    """Row numbers and integer vectors of the rows without null or non-finite components."""
    rows, found = [], []
    for n, v in enumerate(vectors):
        if v.is_valid:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                rows.append(n)
                found.append(np.floor(scale * x).astype(np.int64))
    return np.array(rows, np.int64), found


def _merged(old: tuple, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, scores = np.concatenate([old[0], ids]), np.concatenate([old[1], scores])
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def sliced_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, most_queries: int = 20_000, among: bool = True) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row of ``queries`` the k best of ``vectors(vec_id, embedding)``.

    Scores are integer inner products of ``floor(scale * x)``; ties go to the
    smaller vec_id. With ``among`` the queries are rows of ``vectors``, and each
    one's own row, but no other row of its id, is no candidate. Rows with a null
    id, a null vector or null or non-finite components take no part, and vectors
    of different lengths never meet. Repeated rows count each; without vectors
    or queries there are no rows. Other columns are not read.

    Queries are broadcast in chunks of ``most_queries``, chosen by a hash of
    the id; each chunk meets all rows, block by block, in one pass. Beyond one
    chunk every pass writes its ranks to the shared folder.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    vectors, queries = clean(vectors), clean(queries)
    wanted = k + 1 if among else k  # the own row may be one of the best
    chunks = max(1, -(-queries.count() // most_queries))
    folder = new_folder(spark, "top_k")

    def one_pass(chunk: int) -> DataFrame:
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == chunk) if chunks > 1 else queries
        got = mine.toArrow().combine_chunks()
        column = got.column("embedding").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float64()))
        rows, numbers = _whole(column, scale)
        ids = got.column("vec_id").to_numpy()[rows] if len(rows) else rows
        asked = spark.sparkContext.broadcast((ids, numbers))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, numbers = asked.value
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            held: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))

            def use(size: int) -> None:
                names, values = held.pop(size)
                block = SlicedBlock(np.array(names, np.int64), np.stack(values))
                for n, query in enumerate(numbers):
                    if len(query) == size:
                        old = best.get(n, (np.empty(0, np.int64), np.empty(0, np.int64)))
                        found = block.top(query, wanted, int(old[1][-1]) if len(old[1]) >= wanted else None)
                        best[n] = _merged(old, found[0], found[1], wanted)

            for b in batches:
                rows, values = _whole(b.column("embedding"), scale)
                for i, v in zip(b.column("vec_id").to_numpy()[rows].tolist(), values):
                    held[len(v)][0].append(i)
                    held[len(v)][1].append(v)
                    if len(held[len(v)][0]) >= BLOCK:
                        use(len(v))
            for size in list(held):
                use(size)
            flat = [(n, int(ids[n]), int(numbers[n] @ numbers[n]), i, s) for n, (names, scores) in best.items() for i, s in zip(names.tolist(), scores.tolist())]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], names=["n", "query_id", "own", "vec_id", "score"])

        found = vectors.mapInArrow(search, "n long, query_id long, own long, vec_id long, score long")
        place = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "vec_id"))
        ranked = found.withColumn("rank", place).where(F.col("rank") <= wanted)
        if among:  # of rows with the query's id and its own score one goes: those look alike in the result
            mine = F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("rank"))
            ranked = ranked.withColumn("gone", F.coalesce(F.min(mine).over(Window.partitionBy("n")), F.lit(wanted)))
            ranked = ranked.where("rank <> gone").withColumn("rank", F.col("rank") - (F.col("rank") > F.col("gone")).cast("int"))
        return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    if chunks == 1:
        return one_pass(0)
    for chunk in range(chunks):
        found = one_pass(chunk)
        found.write.mode("append").parquet(folder)
    return spark.read.schema(found.schema).parquet(folder)


def op8_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all ``embeddings`` for every row whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return sliced_top_k(rows, rows.where("vec_id % 50 = 0"))


TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
