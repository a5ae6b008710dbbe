"""First-generation containers and incremental consolidation."""

from __future__ import annotations

import io
import json
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from treecat import legacy
from treecat.constants import SOURCE_FILE
from treecat.errors import FormatError, NavigationError
from treecat.functions import paths as legacy_paths
from treecat.legacy.container import BARE, FULL, KIND, LENGTH, NAME, OFFSET, POINTER
from treecat.streaming.consolidate import daily_counts, stream_level


def container(samples: list[tuple[str, str, bytes]], metadata: dict | None = None) -> bytes:
    blocks, rows, at = [], [], 200
    for name, kind, data in samples:
        rows.append({NAME: name, KIND: kind, OFFSET: at, LENGTH: len(data), "cloud": 1, "stac:crs": "x"})
        blocks.append(data)
        at += len(data)
    table = io.BytesIO()
    pq.write_table(pa.Table.from_pylist(rows), table)
    footer, document = table.getvalue(), json.dumps(metadata).encode() if metadata else b""
    head = (FULL if metadata else BARE) + struct.pack("<QQ", at, len(footer))
    head = head.ljust(26, b"\0") + struct.pack("<QQ", at + len(footer), len(document))
    return head.ljust(200, b"\0") + b"".join(blocks) + footer + document


@pytest.fixture
def files(tmp_path):
    inner = container([("x", "BYTES", b"inner")])
    (tmp_path / "a.tortilla").write_bytes(container([("s2", "GTiff", b"22"), ("s1", "BYTES", b"111"), ("s3", "TORTILLA", inner)]))
    (tmp_path / "b.taco").write_bytes(container([("s0", "BYTES", b"0000")], {"k": 1}))
    (tmp_path / "bad.taco").write_bytes(b"nothing of the kind, at some length")
    return [str(tmp_path / n) for n in ("a.tortilla", "b.taco", "bad.taco")]


def test_read(spark, files):
    rows = legacy.load(files[0], spark)
    assert rows.columns[0] == POINTER and rows.columns.index("stac:crs") < rows.columns.index("cloud")
    assert legacy.read(rows, "s1") == b"111" and legacy.read(rows, 0).startswith("/vsisubfile/200_2,")
    assert legacy.read(legacy.read(rows, "s3"), "x") == b"inner"
    for bad in ("none", 9, -1):
        with pytest.raises(NavigationError):
            legacy.read(rows, bad)
    assert [r[0] for r in legacy.load(files, spark).select(f"`{NAME}`").collect()] == ["s0", "s1", "s2", "s3"]
    assert legacy.load_metadata(files[1], spark) == {"k": 1}
    with pytest.raises(FormatError):
        legacy.load_metadata(files[0], spark)
    with pytest.raises(FormatError):
        legacy.load(files[2], spark)


def test_compile(spark, files, tmp_path):
    rows = legacy.load(files[0], spark).where(f"`{NAME}` <> 's2'")
    out = legacy.compile_subset(rows, str(tmp_path / "c.taco"), {"title": "t"}, chunk=2)
    back = legacy.load(out, spark)
    assert back.count() == 2 and legacy.read(back, "s1") == b"111" and legacy.load_metadata(out, spark) == {"title": "t"}
    assert legacy.read(legacy.read(back, "s3"), "x") == b"inner"


def test_compile_in_many_tasks(spark, tmp_path):
    blocks = [(f"s{i:03d}", "BYTES", bytes([i % 251]) * (i % 37)) for i in range(300)]
    (tmp_path / "many.tortilla").write_bytes(container(blocks))
    rows = legacy.load(str(tmp_path / "many.tortilla"), spark).repartition(7)
    kept = rows.where(f"int(substring(`{NAME}`, 2)) % 3 <> 0")
    back = legacy.load(legacy.compile_subset(kept, str(tmp_path / "less.tortilla"), chunk=5), spark)
    raw = (tmp_path / "less.tortilla").read_bytes()
    found = {r[NAME]: raw[r[OFFSET] : r[OFFSET] + r[LENGTH]] for r in back.select(f"`{NAME}`", f"`{OFFSET}`", f"`{LENGTH}`").collect()}
    assert found == {n: data for n, _, data in blocks if int(n[1:]) % 3}
    ends = sorted((r[OFFSET], r[OFFSET] + r[LENGTH]) for r in back.select(f"`{OFFSET}`", f"`{LENGTH}`").collect())
    assert ends[0][0] == 200 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_sanity_checks_go_into_containers(spark, tmp_path):
    deepest = container([("bad", "BYTES", b"zz"), ("good", "BYTES", b"1")])
    inner = container([("x", "BYTES", b"inner"), ("deep", "TORTILLA", deepest)])
    (tmp_path / "n.tortilla").write_bytes(container([("top", "BYTES", b"0"), ("in", "TORTILLA", inner), ("torn", "TORTILLA", b"not a container at all")]))

    def check(pointer):
        root, offset, size = legacy_paths.parse_subfile(pointer)
        with open(root, "rb") as f:
            f.seek(offset)
            if f.read(size) == b"zz":
                raise OSError("broken")

    found = dict(map(tuple, legacy.sanity_check(legacy.load(str(tmp_path / "n.tortilla"), spark), check).collect()))
    assert found["in/deep/bad"] == "OSError: broken" and found.keys() == {"in/deep/bad", "torn"}


def test_sanity_and_text(spark, files):
    rows = legacy.load(files[0], spark)

    def check(pointer):
        if "/vsisubfile/200_" in pointer:
            raise OSError("broken")

    assert [tuple(r) for r in legacy.sanity_check(rows, check).collect()] == [("s2", "OSError: broken")]
    assert legacy.bytes_of("100MB") == 10**8 and legacy.bytes_of("1.5 kb") == 1500
    with pytest.raises(ValueError):
        legacy.bytes_of("much")
    df = spark.createDataFrame([("POINT (1.5 -2)",), ("LINE",), (None,)], "t string")
    assert [tuple(r) for r in df.select(*legacy.points(F.col("t"))).collect()] == [(1.5, -2.0), (None, None), (None, None)]


def test_incremental_consolidation(spark, tmp_path):
    parts, target = tmp_path / "in", str(tmp_path / "level0.parquet")
    parts.mkdir()
    schema = "id string, t timestamp"

    def arrive(name, ids):
        pq.write_table(pa.table({"id": ids, "t": pa.array([86400_000_000 * i for i in range(len(ids))], pa.timestamp("us", "UTC"))}), parts / name)
        stream_level(spark, str(parts), schema, target, str(tmp_path / "offsets")).awaitTermination(120)

    arrive("a.parquet", ["x", "y"])
    arrive("b.parquet", ["z", "__TACOPAD__0"])
    found = spark.read.parquet(target)
    assert {tuple(r) for r in found.select("id", f"`{SOURCE_FILE}`").collect()} == {("x", "a.parquet"), ("y", "a.parquet"), ("z", "b.parquet"), ("__TACOPAD__0", "b.parquet")}
    assert sorted(r["samples"] for r in daily_counts(found, "t").collect()) == [2, 2]
