from __future__ import annotations

import random

import numpy as np
import xxhash
from llm_texts import prose
from pyspark.sql import functions as F

from treecat.llm.components import connected_components
from treecat.llm.simhash import distance_table, drop_near_duplicates, equal_blocks, fingerprint, fingerprint_components, group_links, packed_distances, pivots, simhash_components, unpacked_distances


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, fps):
    least = {}
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprint_and_spark_agree(spark):
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (0, 1, 2, 3, 4, 5, 50, 400)] + ["A b\tC d e\x0bf", None, "É É É É É"]
    for t in texts:
        assert fingerprint(t) == brute_fingerprint(t)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_components_match_brute_force(docs, odd_rows):
    rng = random.Random(2)
    base = [prose(rng, 200).split() for _ in range(12)]
    rows = [(100 + i, " ".join(base[i % 12][: 200 - (i // 12) % 3] + (["extra"] if i % 5 == 0 else []))) for i in range(120)] + odd_rows
    found = simhash_components(docs(rows, extra=True)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted((d is None, d or 0, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, brute_components(rows, fps)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in found) == want


def test_empty_table(docs):
    assert simhash_components(docs([])).count() == 0 and drop_near_duplicates(docs([])).count() == 0


def test_planted_fingerprints_with_hot_groups(spark):
    """Random fingerprints and one dense ball, in chunks far smaller than the ball: no link is lost."""
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = [f ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for f in fps[:100] for k in (1, 4, 5)]
    ball = [fps[0] ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(40, 64) for b in range(40, a)]
    every = np.unique(np.concatenate([fps, np.array(near, np.uint64), np.array(ball, np.uint64)]))
    rows = [(int(i), int(f)) for i, f in enumerate(every.view(np.int64))]
    from treecat.llm import simhash

    df = spark.createDataFrame(rows, "doc_id long, fp long")
    links = {equal: simhash.fingerprint_links(df.select("fp"), group_rows=32, equal=equal) for equal in (2, 3, 5)}
    found, *others = ({r["node"]: r["component"] for r in connected_components(x).collect()} for x in links.values())
    assert others == [found, found]  # however many blocks a group agrees on
    label = list(range(len(every)))

    def find(a):
        while label[a] != a:
            label[a] = label[label[a]]
            a = label[a]
        return a

    for i, f in enumerate(every):
        for j in np.flatnonzero(np.bitwise_count(every ^ f) <= 4):
            label[find(i)] = find(j)
    groups, want = {}, {}
    for i, (_, f) in enumerate(rows):
        want.setdefault(find(i), set()).add(f)
        groups.setdefault(found.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert fingerprint_components(df).count() == len(every)


def test_number_of_blocks_and_distances(spark):
    assert [equal_blocks(n, 4) for n in (0, 10**6, 10**8, 10**9, 10**10, 10**11, 10**13)] == [2, 2, 2, 3, 4, 4, 5]
    fps = np.random.default_rng(5).integers(0, 1 << 64, 300, np.uint64)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = df.select("fp", *packed_distances(F.col("fp"), pivots())).toArrow()
    dist = unpacked_distances([got.column(k).to_numpy() for k in (1, 2)])
    assert (dist == distance_table(got.column("fp").to_numpy().view(np.uint64), pivots())).all()


def test_group_links_cover_all_pairs_of_small_and_large_groups():
    rng = np.random.default_rng(4)
    centre = np.uint64(rng.integers(0, 1 << 63))
    fps = np.array([centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3, replace=False).astype(np.uint64)) for _ in range(300)], np.uint64)
    for size in (5, 64, 65, 300):
        u, v = group_links(fps[:size], np.zeros(size, int), distance_table(fps[:size], pivots()), 4)
        assert len(u) < size

        def classes(pairs):
            at = {int(f): int(f) for f in fps[:size]}

            def find(x):
                while at[x] != x:
                    x = at[x]
                return x

            for a, b in pairs:
                at[find(int(a))] = find(int(b))
            return sorted(sorted(x for x in at if find(x) == r) for r in {find(x) for x in at})

        every = [(a, b) for a in fps[:size] for b in fps[:size] if (int(a) ^ int(b)).bit_count() <= 4]
        assert classes(zip(u, v)) == classes(every)


def test_drop_keeps_one_of_each_group(docs):
    rng = random.Random(5)
    a, b = prose(rng, 100), prose(rng, 100)
    rows = [(3, a), (1, a), (2, b), (7, b.upper()), (None, ""), (9, None), (8, "")]
    left = drop_near_duplicates(docs(rows, extra=True))
    assert left.columns == docs(rows, extra=True).columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 8]
    assert drop_near_duplicates(docs([(1, a), (1, a), (1, b)])).count() == 2
    unique = docs([(3, a), (1, a), (2, b), (7, b.upper()), (9, None), (8, "")], extra=True)
    for most in (0, 10):
        left = drop_near_duplicates(unique, most_broadcast=most)
        assert left.columns == unique.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 8]


def test_fingerprints_link_near_copies_without_bands(docs, monkeypatch):
    """Texts with one word in 600 changed lie within 4 bits: the pivot search alone finds them, exact similarity alone decides."""
    from treecat.llm import set_similarity, simhash

    rng, rows = random.Random(8), []
    for i in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words[:-1], "changed"])), (3 * i + 2, prose(rng, 40))]
    rows += [(100 + i, t) for i, t in enumerate(("", "one", "two words", None))]
    sims = {i: set_similarity.majority_bits(set_similarity.shingle_set(t)) for i, t in rows}
    near = {3 * i + 1 for i in range(20) if (sims[3 * i] ^ sims[3 * i + 1]).bit_count() <= 4}
    assert len(near) > 10
    monkeypatch.setattr(set_similarity, "band_keys", lambda hashes: np.empty(0, np.uint64))
    left = {r["doc_id"] for r in drop_near_duplicates(docs(rows)).collect()}
    assert left == {i for i, _ in rows} - near - {103}
    monkeypatch.setattr(simhash, "fingerprint_links", lambda prints, radius: prints.crossJoin(prints.select(F.col("fp").alias("v"))).where("fp < v").withColumnRenamed("fp", "u"))
    left = {r["doc_id"] for r in drop_near_duplicates(docs(rows)).collect()}  # all pairs meet: none goes without similarity
    assert left == {i for i, _ in rows} - {3 * i + 1 for i in range(20)} - {103}


def test_known_links_are_not_made_again():
    from treecat.llm.set_similarity import set_links

    base = np.arange(100, dtype=np.uint64)
    sets = [base, np.append(base[:-1], np.uint64(200)), np.arange(300, 400, dtype=np.uint64), np.append(base[:-2], np.uint64(999))]
    assert len(set_links(sets, 0.8)) == 2
    assert set_links(sets, 0.8, np.array([1, 1, 1, 1])) == []
    assert len(set_links(sets, 0.8, np.array([1, 2, 2, 3]))) == 2


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1400)] + [(5000, 5001), (5001, 5000), (6000, 6000), (None, 3)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert {found[i] for i in range(301)} == {0} and {found[i] for i in range(1000, 1400)} == {1000} and found[5001] == 5000 and 6000 not in found
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
