from __future__ import annotations

import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from treecat.llm._shared import spread_join
from treecat.llm import archive as ar, bitslice_topk as bs, url_templates as ut

# --- top-k -----------------------------------------------------------------------


def brute_top(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, x) in enumerate(ok):
        if q % 50 == 0:
            scored = sorted((-int(x @ y), i) for n, (i, y) in enumerate(ok) if n != at and len(y) == len(x))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("chunk, block", [(20_000, 1 << 15), (3, 64)])
def test_top_k_matches_brute_force(spark, chunk, block, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(bs, "BLOCK", block)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(500)]
    rows += [(600 + i, [0.5] * 16) for i in range(30)]  # ties
    rows += [(650, [0.5] * 16), (650, [0.25] * 16), (700, rows[7][1]), (700, rows[7][1]), (750, [0.0] * 16), (800, [-0.7] * 16)]
    rows += [(1150, [3.0] * 16)] * 8 + [(1200, [-3.0] * 16), (1200, [3.5] * 16)]  # repeats of one id: only the own row is left out
    rows += [(850, None), (900, [1.0] * 15 + [None]), (950, [1.0] * 15 + [float("nan")]), (1000, [float("inf")] * 16), (None, [9.0] * 16), (1050, [1.0, 2.0]), (1051, [1.0, 2.0]), (1100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit("x"), "score": F.lit("y")})
    found = bs.sliced_top_k(df, df.where("vec_id % 50 = 0"), most_queries=chunk)
    assert sorted(tuple(r) for r in found.collect()) == brute_top(rows)


def test_top_k_of_nothing_and_of_few(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bs.sliced_top_k(empty, empty).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in bs.sliced_top_k(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, 131072)]


def test_sliced_sums_are_the_scores():
    rng = np.random.default_rng(2)
    values, ids = rng.integers(-300, 300, (200, 8)), rng.permutation(200)
    block = bs.SlicedBlock(ids, values)
    order = np.argsort(ids)
    for _ in range(20):
        q = rng.integers(-300, 300, 8)
        sums, base = block.sums(q)
        a = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:200].astype(int) << i for i, s in enumerate(sums))
        assert (base + a == values[order] @ q).all()
        best, scores, resolved = block.top(q, 6)
        assert sorted(zip(-scores, best)) == sorted(zip(-(values @ q), ids))[:6] and resolved < 12  # full depth: hardly a row is left to resolve


# --- archives --------------------------------------------------------------------


def test_pages_come_back(spark):
    rng = random.Random(1)
    same, other = "é" * 60, "z" * 99
    rows = [(5, "http://a/x y", same), (3, None, same), (9, "http://b", same), (4, "u", other), (6, "u", other), (7, "u", None), (8, "u", ""), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n\n" * 30), (11, "u", "\x00\n" * 80)]
    rows += [(100 + i, f"http://h/{i}", "".join(rng.choice("ab\n\r é") for _ in range(rng.randrange(400)))) for i in range(200)] + [(None, "u", same), (3, None, same), (12, "u", "long " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"n": F.lit(1), "payload_digest": F.lit("x")}).repartition(3)
    found = sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in map(tuple, ar.pages_through_archives(pages).collect()))
    first = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    repeated = {raw for raw in first if sum((h or "").encode() == raw for _, _, h in rows) > 1}

    def want(i, html):
        raw = (html or "").encode()
        again = raw in repeated and i != first[raw]
        return ((i is None, i or 0), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None)

    assert found == sorted(want(i, h) for i, _, h in rows)
    assert ar.pages_through_archives(pages.limit(0)).count() == 0


def test_both_arc_versions():
    for version in (1, 2):
        body = ar.http_response(b"payload\n\n", {"X-Page-Id": 1})
        raw = ar.arc_opening(version, "n.arc", "1997") + b"\n" + ar.arc_record(version, "http://a b", "1.2.3.4", "19970203040506", "text/html", body) + b"\n\n" + ar.arc_record(version, None, "0.0.0.0", "1998", "text/plain", b"") + b"\n"
        first, second = ar.parse_arc(io.BytesIO(raw))
        assert (first["URL"], first["IP-address"], first["Archive-date"], first["body"]) == ("http://a%20b", "1.2.3.4", "19970203040506", body)
        assert second["URL"] == "-" and second["body"] == b"" and ("Result-code" in first) == (version == 2)
    assert ar.warc_date("19970203040506") == "1997-02-03T04:05:06Z" and ar.warc_date("1997") == "1997-01-01T00:00:00Z"


@pytest.mark.parametrize("raw", [b"http://a 0 1 t 1\nx", ar.arc_opening(1, "n", "1997")[:-5], ar.arc_opening(1, "n", "1997") + b"\na b c\n", ar.arc_opening(1, "n", "1997") + b"\na b c d 5\nxx", ar.arc_opening(1, "n", "1997").replace(b"\n1 0", b"\n7 0")])
def test_broken_archives(raw):
    with pytest.raises(ValueError):
        list(ar.parse_arc(io.BytesIO(raw)))


def test_warc_records():
    raw = ar.warc_record({"WARC-Type": "response", "A": None, "B": "x: y"}, b"\r\n\r\nabc") + ar.END + ar.warc_record({"WARC-Type": "revisit"}, b"") + ar.END
    first, second = ar.parse_warc(io.BytesIO(raw))
    assert first == ({"warc-type": "response", "b": "x: y", "content-length": "7"}, b"\r\n\r\nabc") and second[1] == b""
    with pytest.raises(ValueError):
        list(ar.parse_warc(io.BytesIO(raw[:60])))


def test_archives_of_other_origin(spark, tmp_path):
    """No page ids: repeats within and across files, a DNS answer, plain and gzipped files, by record or whole."""
    page = lambda n: ar.http_response(b"payload of some length " * 20 + str(n).encode(), {})
    files = {
        "a.arc": [("http://h/1", page(1)), ("dns:h", b"19970101 h. 300 IN A 1.2.3.4\n" * 5), ("http://h/2", page(2))],
        "b.arc.gz": [("http://h/3", page(1)), ("http://h/4", page(3)), ("http://h/5", page(3))],
        "sub/c.arc.gz": [("http://h/6", page(1)), ("dns:h", b"19970101 h. 300 IN A 1.2.3.4\n" * 5), ("ftp://h/7", page(9)[:40])],
    }
    for n, (name, records) in enumerate(files.items()):
        version = 1 + n % 2
        parts = [ar.arc_opening(version, name, "1997"), *(ar.arc_record(version, u, "1.1.1.1", "19970203040506", "text/dns" if u[0] == "d" else "text/html", body) for u, body in records)]
        parts = [x + b"\n" for x in parts]
        raw = b"".join(parts) if n == 0 else gzip.compress(b"".join(parts)) if n == 1 else b"".join(map(gzip.compress, parts))
        (tmp_path / "arc" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "arc" / name).write_bytes(raw)
    for most in (0, 100):
        out = str(tmp_path / f"warc{most}")
        ar.arc_to_warc(spark, str(tmp_path / "arc"), out, most_broadcast=most)
        found = {r["url"]: r for r in ar.read_warc(spark, out).collect() if r["url"] != "dns:h"}
        every = ar.read_warc(spark, out).collect()
        assert len(every) == 9 and len({r["record_id"] for r in every}) == 9 and {r["page_id"] for r in every} == {None}
        assert {u: r["record_type"] for u, r in found.items()} == {"http://h/1": "response", "http://h/2": "response", "http://h/3": "revisit", "http://h/4": "response", "http://h/5": "revisit", "http://h/6": "revisit", "ftp://h/7": "resource"}
        assert found["http://h/3"]["refers_to_id"] == found["http://h/6"]["refers_to_id"] == found["http://h/1"]["record_id"]
        assert found["http://h/5"]["refers_to_id"] == found["http://h/4"]["record_id"] and found["http://h/4"]["warc_date"] == "1997-02-03T04:05:06Z"
        dns = [r for r in every if r["url"] == "dns:h"]
        assert [(r["record_type"], r["content_type"], r["refers_to_id"]) for r in dns] == [("resource", "text/dns", None)] * 2
    # each record is a member of its own: one can start at any of them
    raw = next((tmp_path / "warc0").glob("part-*")).read_bytes()
    starts = [m.start() for m in re.finditer(re.escape(ar._MEMBER + b"\0"), raw)]
    assert len(starts) > 1
    for at in starts:
        assert zlib.decompressobj(31).decompress(raw[at:]).startswith(b"WARC/1.1\r\n")


# --- URLs ------------------------------------------------------------------------


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end], rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return host.translate({c: c + 32 for c in range(65, 91)}), tail[:stop]


def brute_rule(host, path):
    fits = [(len(r), r, v) for r, v in ut.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def brute_tree(rows, min_rows=20, min_share=0.02, z=1.96, strength=5.0):
    """{(host, path): (template, impurity)} by recursion over lists of URLs."""
    overall = (sum(v == "block" for *_, v in rows) + strength * 0.5) / (sum(v is not None for *_, v in rows) + strength)
    out = {}

    def smooth(group, prior):
        return (sum(v == "block" for *_, v in group) + strength * prior) / (sum(v is not None for *_, v in group) + strength)

    def grow(group, template, depth, impurity):
        below = {}
        for row in group:
            segments = [s for s in row[1].split("/") if s]
            if len(segments) <= depth:
                out[row[0], row[1]] = template, impurity
            elif len(group) < min_rows:
                out[row[0], row[1]] = template + "/**", impurity
            else:
                below.setdefault(segments[depth], []).append(row)
        literal = {s: g for s, g in below.items() if len(g) >= min_rows and len(g) >= min_share * len(group)}
        names = {s: "*" for s in below}
        stats = {s: (sum(v == "block" for *_, v in g), sum(v is not None for *_, v in g)) for s, g in literal.items()}
        labelled = sorted((b / k, s) for s, (b, k) in stats.items() if k)
        branches = []
        for rate, s in labelled:
            if branches:
                other = branches[-1][-1]
                (b1, k1), (b2, k2) = stats[other], stats[s]
                p = (b1 + b2 + 1) / (k1 + k2 + 2)
                if abs(rate - b1 / k1) <= z * (p * (1 - p) * (1 / k1 + 1 / k2)) ** 0.5:
                    branches[-1].append(s)
                    continue
            branches.append([s])
        branches += [[s] for s, (_, k) in stats.items() if not k]
        for b in branches:
            for s in b:
                names[s] = s if len(b) == 1 else "{" + "|".join(sorted(b)) + "}"
        grown = {}
        for s, g in below.items():
            grown.setdefault(names[s], []).extend(g)
        for name, g in grown.items():
            grow(g, f"{template}/{name}", depth + 1, smooth(g, impurity))

    hosts = {}
    for row in rows:
        hosts.setdefault(row[0], []).append(row)
    for host, group in hosts.items():
        grow(group, "", 0, smooth(group, overall))
    return out


@pytest.mark.parametrize("most", [0, 200_000])
def test_urls_match_brute_force(spark, most):
    rng = random.Random(1)
    urls = [None, "", "no scheme", "http://", "http://HOST", "http://a.ORG?x=/y", "HTTP://b.org#/", "http://example.org/en/1", "https://x.example.org/es/1?u=http://z/de/", "http://com/fr/", "http://notcom/fr/", "http://a.com/FR/", "http://a\n.com/de/\nx"]
    urls += ["http://long.com/de/" + "x" * 50_000, "http://many.com/" + "a/" * 3_000]
    urls += [f"http{rng.choice(['', 's'])}://{rng.choice(['www.', 'm.', ''])}h{rng.randrange(3)}.example.{rng.choice(['com', 'com', 'org', 'net'])}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.choice(['a', 'b', str(rng.randrange(500))])}{rng.choice(['', '/', '/p/q', '/p/q/r'])}" for _ in range(3000)]
    # templates that differ at their twelfth segment alone
    urls += [f"http://{h}.deep.com{'/s' * 11}/{rng.choice('xy')}/{rng.randrange(900)}" for h in ("u", "v") for _ in range(80)]
    urls += [f"http://com/{lang}/k" for lang in ("fr", "de") for _ in range(40)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(5, urls[5]), (None, urls[7])], "page_id long, url string").withColumn("host", F.lit("x"))
    rows = [(*brute_url(u), *brute_rule(*brute_url(u))) for u in [*urls, urls[5], urls[7]]]
    tree = brute_tree([(h, p, v) for h, p, _, v in rows])
    found = ut.judge_urls(pages, most_broadcast=most).collect()
    assert len(found) == len(rows)
    seen = set()
    for r in found:
        host, path, rule, says = rows[r["page_id"] if r["page_id"] is not None else 7]
        template, impurity = tree[host, path]
        assert (r["host"], r["path"], r["rule"], r["template"]) == (host, path, rule, template)
        assert r["impurity"] == pytest.approx(impurity) and r["verdict"] == (says or ("block" if impurity > 0.5 else "allow"))
        seen.add((rule is None, r["verdict"]))
    assert len(seen) == 4 and {t for (h, _), (t, _) in tree.items() if h == "u.deep.com"} == {"/s" * 11 + "/x/*", "/s" * 11 + "/y/*"}


def test_no_urls_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert ut.judge_urls(pages.limit(0)).count() == 0
    assert ut.judge_urls(pages, rules=()).first()["verdict"] == "allow"


def test_hot_keys_join_like_others(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 600, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    for hot, most in ((100, 10), (100, 0), (10_000, 10)):
        assert sorted(tuple(r) for r in spread_join(left, right, ["k"], "n", hot, most).select("k", "id", "v").collect()) == sorted((r["k"], r["id"], 2 * r["k"]) for r in left.collect())
