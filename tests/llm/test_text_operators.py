from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import prose

from treecat.llm._shared import BATCH_BYTES, map_arrow
from treecat.llm import decontaminate as dc, pieces as ps, token_counts as tc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_contamination(rows, items):
    windows = {}
    for key, text in items:
        w = words(text)
        if w:
            size = min(10, len(w))
            for i in range(len(w) - size + 1):
                windows.setdefault(tuple(w[i : i + size]), set()).update({str(key)} if key is not None else ())
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for size in range(1, 11):
                if i + size <= len(w) and (names := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= names
        out.append((doc is None, doc or 0, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.fixture
def leaks(odd_rows):
    rng = random.Random(1)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 11, 30]))) for i in range(20)]
    items += [(20, items[4][1]), (20, items[4][1]), (21, ""), (22, None), (None, "an item without id"), (None, items[5][1] + " and more than that"), (23, "ÄÖ Ü 日本語"), (24, "...")]
    rows = [(10 + i, prose(rng, 60)) for i in range(30)]
    rows += [(50 + i, f"{prose(rng, 5)} {items[i][1].upper().replace(' ', ' - ')}! {prose(rng, 5)}") for i in range(20)]
    rows += [(92, f"{prose(rng, 4)} an item, without: ID {prose(rng, 4)}")]  # a null id's words are hit
    rows += [(90, items[3][1] + " " + items[3][1]), (91, " ".join(items[4][1].split()[:9]))]
    return rows + odd_rows, items


@pytest.mark.parametrize("most", [160 << 20, 0])
def test_contamination_matches_brute_force(spark, docs, leaks, most, monkeypatch):
    rows, items = leaks
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    scan = dc.scan
    monkeypatch.setattr(dc, "scan", lambda *a, **k: scan(*a, **k, most_bytes=most))
    found = dc.contamination(docs(rows, extra=True), benchmark).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *r[1:]) for r in found) == brute_contamination(rows, items)


def test_decontamination_of_documents_and_spans(spark, docs):
    item = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"before. {item.upper()}, after"), (2, "clean text"), (3, None), (4, item)]
    left = dc.decontaminate(docs(rows, extra=True), benchmark)
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3] and left.columns == docs(rows, extra=True).columns
    assert {r["n_words"] for r in left.collect()} == {"mine"}
    cut = dc.decontaminate(docs(rows, extra=True), benchmark, "spans")
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "before. , after", 2: "clean text", 3: None, 4: ""}
    assert {r["hit_items"] for r in cut.collect()} == {"mine"}
    for none in (benchmark.limit(0), spark.createDataFrame([(1, None), (2, "..")], "item_id long, text string")):
        assert dc.decontaminate(docs(rows), none).count() == 4
    assert dc.contamination(docs([]), benchmark).count() == 0
    with pytest.raises(ValueError):
        dc.decontaminate(docs(rows), benchmark, "x")


def test_false_hash_hits_are_told_apart(spark, docs, leaks, monkeypatch):
    """With hashes of four bits nearly every window hits; the digests settle it."""
    rows, items = leaks
    weak = dc.Rolling.hashes
    monkeypatch.setattr(dc.Rolling, "hashes", lambda self, sums, size: weak(self, sums, size) & np.uint64(0xF << 60))

    def exact(items, width):
        made = [(r["item"], *w) for r in items.collect() for w in windows_of(r["text"], width)]
        return items.sparkSession.createDataFrame(made, "item long, size int, hash long, digest binary")

    def windows_of(text, width):
        w = dc.words(text)
        size, rolling = min(width, len(w)), dc.Rolling()
        hashes = rolling.hashes(rolling.sums(w), size) if w else ()
        return {(size, int(np.uint64(h).view(np.int64)), bytes(dc.digest(w[i : i + size]))) for i, h in enumerate(hashes)}

    index = dc.WindowSet(exact(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(items)], "item long, text string"), 10).toArrow(), {i: None if k is None else str(k) for i, (k, _) in enumerate(items)})
    got = []
    for doc, text in rows:
        flat = dc.words(text)
        hit, names = set(), set()
        for i, n, holders in index.hits(dc.Rolling(), flat, np.full(len(flat), len(flat))):
            hit |= set(range(i, i + n))
            names |= {index.names[k] for k in holders if k >= 0}
        got.append((doc is None, doc or 0, len(flat), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert sorted(got) == brute_contamination(rows, items)


# --- pieces ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return ps.PieceModel(ps.read_model(ps.MODEL))


def by_word(model, words):
    ids, counts = model.encode_words(words)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_false_hash_matches_are_searched_plainly(model, monkeypatch):
    made = ["naïve", " the", "▁x", " and", "a" * 20]
    want = by_word(model, made)
    honest = ps.PieceModel._searched
    monkeypatch.setattr(ps.PieceModel, "_searched", lambda self, parts: (lambda x, n: (np.where(np.arange(len(x)) % 3 == 1, 5000, x), n))(*honest(self, parts)))
    assert by_word(model, made) == want


def brute_best(model, text):
    """Highest sum of piece scores over the whole text with its space before it, by plain search."""
    s = " " + text
    best = [0.0] + [-np.inf] * len(s)
    for j in range(1, len(s) + 1):
        for n in range(1, min(16, j) + 1):
            score = model.scores.get(s[j - n : j], (model.unknown if n == 1 else -np.inf,))[0]
            best[j] = max(best[j], best[j - n] + score)
    return best[-1]


def score_of(model, text, ids):
    """The sum of scores of ids; a character's byte pieces together cost the unknown score."""
    total, pending = 0.0, b""
    by_id = {i: s for s, i in model.scores.values()}
    for i in ids:
        if i in by_id:
            total += by_id[i]
        else:
            pending += model.texts[i]
            try:
                total += model.unknown * len(pending.decode())
                pending = b""
            except UnicodeDecodeError:
                pass
    return total


def test_viterbi_is_optimal_and_exact(model, odd_rows):
    rng = random.Random(1)
    texts = [t for _, t in odd_rows if t and len(t) < 1000] + ["", " ", "\n", "a \n  b", "▁▁ ▁", "naïve café", "a" * 100, " " * 40]
    texts += ["".join(rng.choice("abc étheing \n▁日🙂") for _ in range(rng.randrange(60))) for _ in range(300)]
    for text, ids in zip(texts, model.encode(texts)):
        assert model.decode(ids.tolist()) == text
        if text:
            assert score_of(model, text, ids.tolist()) == pytest.approx(brute_best(model, text))
    assert model.encode([None, ""])[0].tolist() == []


def test_batched_search_equals_the_plain_one(model):
    rng = random.Random(2)
    made = {"".join(rng.choice("etaoinshrdlu é") for _ in range(rng.randrange(1, 30))).replace(" ", "") or "x" for _ in range(500)}
    made = sorted(" " + w for w in made)
    assert by_word(model, made) == [model._spelled(w, model.plain(w)) for w in made]


def test_pieces_through_spark(spark, docs, odd_rows):
    found = ps.encode_pieces(docs(odd_rows, extra=True))
    rows = found.collect()
    assert len(rows) == len(odd_rows) and all(r["round_trip"] and r["n_pieces"] == len(r["piece_ids"]) for r in rows)
    back = ps.decode_pieces(found.select("doc_id", "piece_ids"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=key) == sorted(((i, t or "") for i, t in odd_rows), key=key)
    assert ps.encode_pieces(docs([])).count() == 0


def test_ids_are_those_of_the_library(spark, docs, odd_rows):
    """A BPE model merges by rank: the ids of every text without a literal space mark are sentencepiece's own."""
    import sentencepiece

    rng = random.Random(4)
    texts = ["the and that for with", " the  and   that\n for", "a" * 300, " " * 40, "x" * 20_000, "naïve café 日本語 🙂\t\u3000ﬁ"]
    texts += [t for _, t in odd_rows if t and "▁" not in t]
    texts += ["".join(rng.choice("abcetaoinshr étheing \n日🙂") for _ in range(rng.randrange(1, 120))) for _ in range(500)]
    library = sentencepiece.SentencePieceProcessor(model_file=ps.MODEL)
    found = ps.encode_pieces(docs(list(enumerate(texts)))).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r["piece_ids"] == library.encode(r["text"]) and r["round_trip"], r["text"][:80]
    merged = ps.PieceModel(ps.read_model(ps.MODEL), ps.is_bpe(ps.MODEL))
    made = sorted({w for t in texts for w in t.split(" ") if w and "\n" not in w})
    assert by_word(merged, made) == [merged._spelled(w, merged.plain(w)) for w in made]


def unspaced(rng, n):
    """Text without a space: run-on words, an address, Chinese, base64-like and repeated characters."""
    kinds = [lambda: prose(rng, 30).replace(" ", ""), lambda: "https://a.example/" + str(rng.random()) + "/x?y=", lambda: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(50)), lambda: "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(200)), lambda: rng.choice("xa=-_") * 150]
    out = ""
    while len(out) < n:
        out += rng.choice(kinds)()
    return out[:n]


def test_long_texts_without_spaces_take_the_batched_search(monkeypatch):
    """100,000 characters in a row: the library's ids by merges, the plain search's by Viterbi, and no plain search runs."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=ps.MODEL)
    rng = random.Random(8)
    texts = [unspaced(rng, 100_000), "".join(prose(rng, 3_000).split()), "ab" * 20_000, "a" * 30_000]
    want = ps.PieceModel(ps.read_model(ps.MODEL))
    short = unspaced(rng, 5_000)
    plain = want._spelled(" " + short, want.plain(" " + short))
    monkeypatch.setattr(ps.PieceModel, "plain", lambda *_: pytest.fail("plain search"))
    merged = ps.PieceModel(ps.read_model(ps.MODEL), True)
    for text, ids in zip(texts, merged.encode(texts)):
        assert ids.tolist() == library.encode(text), text[:50]
    assert want.encode([short])[0].tolist() == plain
    assert want.decode(want.encode(texts[:1])[0].tolist()) == texts[0]


def test_encoding_takes_bounded_memory(monkeypatch):
    """A million characters of words not seen before are searched some at a time, words of many pieces are not all remembered, and the ids are the same."""
    import tracemalloc

    rng = random.Random(9)
    merged = ps.PieceModel(ps.read_model(ps.MODEL), True)
    made = [" " + "".join(rng.choice("etaoinshrdlu") for _ in range(9)) for _ in range(100_000)]
    tracemalloc.start()
    ids, counts = merged.encode_words(made)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(counts) == len(made) and counts.sum() == len(ids) and peak < 60e6
    texts, seen = [unspaced(rng, 2_000) for _ in range(30)], ps._Words()
    want = [x.tolist() for x in merged.encode(texts)]
    monkeypatch.setattr(ps, "_CELLS", 500)
    monkeypatch.setattr(ps, "_CACHED", 5_000)
    for text, one in zip(texts, want):
        assert merged.encode([text], seen)[0].tolist() == one
        assert len(seen.ids) < 5_000 + 3 * len(text)


def test_arrow_batches_are_small(spark):
    """Rows of 4 KB reach Python in batches of some 4 MB, in a session that has no limit of its own."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    found = map_arrow(spark.newSession().range(0, 5_000, 1, 1).selectExpr("repeat('x', 4096) AS text"), sizes, "n long")
    most = [r["n"] for r in found.collect()]
    assert sum(most) >= 5_000 * 4096 and max(most) < 1.1 * BATCH_BYTES
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    found = map_arrow(own.range(0, 5_000, 1, 1).selectExpr("repeat('x', 4096) AS text"), sizes, "n long")
    assert max(r["n"] for r in found.collect()) < 1.1 * (1 << 20)


def test_tasks_give_back_what_was_freed():
    """Freed numbers and words of a task before it, kept apart by a few that stay, go back to the system."""
    run = """
import re, numpy as np
from treecat.llm._shared import give_back
pss = lambda: sum(map(int, re.findall(r"Pss_Anon:[^0-9]+([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024
rows = [np.zeros(2000, np.int8) for _ in range(100_000)]
rows = rows[::100]
held = pss()
give_back()
print(held - pss())
"""
    import subprocess
    import sys

    assert float(subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, check=True).stdout) > 50


def test_models_that_cannot_work():
    byte = [(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)]
    with pytest.raises(ValueError):
        ps.PieceModel([("a", -1.0, "normal")])
    with pytest.raises(ValueError):
        ps.PieceModel([*byte, ("a▁b", -1.0, "normal")])
    tie = ps.PieceModel([*byte, ("▁", -1.0, "normal"), ("a", -1.0, "normal"), ("aa", -2.0, "normal")])
    assert [tie.texts[i] for i in tie.encode(["aaa"])[0]] == [b" ", b"a", b"aa"]  # the longer last piece


# --- token counts ----------------------------------------------------------------


def brute_sections(text, rule):
    """By offsets of an independent library over the same vocabulary."""
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False)


def test_spans_match_another_library(spark, docs):
    rng = random.Random(3)
    texts = ["\n".join(prose(rng, rng.randrange(12)) for _ in range(6)) for _ in range(20)] + ["a\n\n\nb  \n c", "naïve\ncafé 日本\n語"]
    found = tc.section_token_counts(docs(list(enumerate(texts))), rule="first").collect()
    for i, text in enumerate(texts):
        mine = sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["section"])
        assert [(r["char_start"], r["char_end"]) for r in mine] == [(sum(len(x) + 1 for x in text.split("\n")[:k]), sum(len(x) + 1 for x in text.split("\n")[: k + 1]) - (k == text.count("\n"))) for k in range(text.count("\n") + 1)]
        encoded = brute_sections(text, "first")
        want = [0] * len(mine)
        for start, _ in encoded.offsets:
            want[next(k for k, r in enumerate(mine) if r["char_start"] <= start < r["char_end"])] += 1
        assert [r["tokens"] for r in mine] == want and mine[0]["doc_tokens"] == len(encoded.ids)


@pytest.mark.parametrize("rule, want", [("first", [1, 2, 0]), ("last", [0, 2, 1]), ("majority", [1, 1, 1]), ("split", [2 / 3, 1 + 1 / 3 + 1 / 4, 3 / 4])])
def test_boundary_rules(rule, want):
    # tokens of 3, 2 and 4 bytes; sections of 2, 4 and 3 bytes
    counts, crossing = tc.attribute(np.array([3, 5, 9]), np.array([0, 2, 6, 9]), rule)
    assert counts.tolist() == pytest.approx(want) and crossing.tolist() == [1, 2, 1]


def test_ties_and_empty_sections():
    assert tc.attribute(np.array([4]), np.array([0, 2, 4]), "majority")[0].tolist() == [1, 0]
    assert tc.attribute(np.array([4]), np.array([0, 2, 2, 4]), "split")[0].tolist() == [0.5, 0, 0.5]
    assert tc.attribute(np.array([], int), np.array([0, 0]), "first")[0].tolist() == [0]


@pytest.mark.parametrize("rule", tc.RULES)
def test_sections_add_up(docs, odd_rows, rule):
    found = tc.section_token_counts(docs(odd_rows, extra=True), rule=rule).collect()
    total = {}
    for r in found:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["tokens"]
    want = {r["doc_id"]: r["doc_tokens"] * (2 if r["doc_id"] == 4 else 1) for r in found}
    assert total == pytest.approx(want) and {r["doc_id"] for r in found} == {i for i, _ in odd_rows}


def test_fields_and_bad_arguments(spark, docs):
    df = spark.createDataFrame([(1, "Title here", None, "Body text"), (2, None, None, None)], "k int, a string, b string, text string")
    found = tc.section_token_counts(df, "k", ("a", "b", "text"), by_line=False, rule="majority").orderBy("k", "section").collect()
    assert [r["section"] for r in found] == [0, 1, 2] * 2 and sum(r["tokens"] for r in found[:3]) == found[0]["doc_tokens"]
    for bad in ({"rule": "x"}, {"fields": ("a", "b")}):
        with pytest.raises(ValueError):
            tc.section_token_counts(df, "k", **bad)
    assert tc.section_token_counts(docs([])).count() == 0
    clash = tc.section_token_counts(df.withColumnRenamed("k", "tokens"), "tokens")
    assert clash.columns == ["key", "section", "char_start", "char_end", "tokens", "crossing", "doc_tokens"] and {r["key"] for r in clash.collect()} == {1, 2}
