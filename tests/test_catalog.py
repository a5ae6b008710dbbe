"""Layouts, filters, cascades, concat and navigation on small catalogs with known answers."""

from __future__ import annotations

import http.server
import math
import pathlib
import struct
import threading

import fixtures_catalog as fx
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import treecat
from treecat import constants as C
from treecat.errors import BackendError, FormatError, NavigationError, QueryError, SchemaError, StorageError
from treecat.functions import geo, paths, temporal
from treecat.operators import homogeneity, stats
from treecat.operators.levels import q
from treecat.operators.ranges import plan_ranges
from treecat.schema import TreeSchema, merge
from treecat.sources import archive, cache, collection, detect, files, streams


@pytest.fixture(scope="module")
def where(tmp_path_factory):
    base = tmp_path_factory.mktemp("catalogs")
    return {
        "flat": fx.write_folder(fx.buoys(), base / "flat"),
        "nested": fx.write_folder(fx.rivers(), base / "nested"),
        "deep": fx.write_folder(fx.cruises(), base / "deep"),
        "zip": fx.write_zip(fx.cruises(), base / "deep.zip"),
        "parts": fx.write_consolidated({"a.zip": fx.cruises(range(5)), "b.zip": fx.cruises(range(5, 12))}, base / "parts"),
    }


@pytest.fixture(scope="module")
def load(spark, where):
    return lambda name, **more: treecat.load(where[name], spark=spark, **more)


def ids(d):
    return sorted(r[0] for r in d.current.select("id").collect())


# --- loading -------------------------------------------------------------------


def test_layouts_give_the_same_tree(load):
    for name in ("deep", "zip", "parts"):
        d = load(name)
        assert (d.n, d.levels[1].count(), d.levels[2].count()) == (12, 36, 72), name
        assert d.max_depth == 2 and d.version == "0.3.1" and d.tasks == ["regression"]
    assert (load("deep").format, load("zip").format, load("parts").format) == (C.PLAIN, C.ARCHIVE, C.CONSOLIDATED)


def test_load_lists_and_errors(spark, where, tmp_path):
    with pytest.raises(QueryError):
        treecat.load([], spark=spark)
    assert treecat.load([where["flat"]], spark=spark).n == 6
    assert treecat.load([where["flat"], where["flat"]], spark=spark).n == 12
    for legacy in ("x.taco", "x.tortilla", "registry:x"):
        with pytest.raises(FormatError, match="legacy"):
            treecat.load(legacy, spark=spark)
    with pytest.raises(FormatError):
        treecat.load(str(tmp_path), spark=spark)
    (tmp_path / "half").mkdir()
    (tmp_path / "half" / C.COLLECTION).write_text("{}")
    with pytest.raises(StorageError):
        treecat.load(str(tmp_path / "half"), spark=spark)
    (tmp_path / "bad.zip").write_bytes(b"x" * 300)
    with pytest.raises(FormatError):
        treecat.load(str(tmp_path / "bad.zip"), spark=spark)
    with pytest.raises(BackendError):
        treecat.load(where["flat"], backend="none", spark=spark)
    with pytest.raises(FormatError):
        treecat.load(where["flat"], base_path="/x", spark=spark)


def test_detection(spark, where):
    assert detect.by_name("a/.tacocat/") == C.CONSOLIDATED and detect.by_name("a.ZIP") == C.ARCHIVE and detect.by_name("a") == C.PLAIN
    assert detect.detect(spark, where["parts"])[0] == C.CONSOLIDATED
    assert detect.detect_root_first(spark, where["flat"]) == C.PLAIN


def test_archive_reads_row_groups_in_parallel(load, where, monkeypatch):
    part = [where["zip"], *archive.entries_of(where["zip"])[2]]
    groups = lambda: [p.groups for p in archive._Reader([part], ["id"], None).partitions()]
    assert groups() == [list(range(math.ceil(72 / 7)))]  # small ones together
    monkeypatch.setattr(archive, "TASK_BYTES", 1)
    assert groups() == [[g] for g in range(math.ceil(72 / 7))]
    assert load("zip").levels[2].agg(F.sum("pressure")).first()[0] == 12 * sum(100 * (s + 1) + k for s in range(3) for k in range(2))


def _reads(part, columns, filters=()):
    """(row group, columns, requests) of a read of an archive's level, in this process."""
    reader = archive._Reader([part], columns, None)
    assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark applies them again
    archive.READS.clear()
    rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    return rows, [x[2:] for x in archive.READS]


def test_archive_reads_only_what_is_asked_for(where):
    offset, size = archive.entries_of(where["zip"])[2]
    part = [where["zip"], offset, size]
    rows, reads = _reads(part, ["id", "pressure"])
    assert len(rows) == 72 and set(rows[0]) == {"id", "pressure"} and len(reads) == math.ceil(72 / 7)
    assert {r[1] for r in reads} == {("id", "pressure")} and all(1 <= r[2] <= 2 for r in reads)
    current, by_range = archive.GreaterThanOrEqual((C.CURRENT_ID,), 60), archive.LessThan((C.CURRENT_ID,), 65)
    rows, reads = _reads(part, [C.CURRENT_ID], [current, by_range])
    assert [r[0] for r in reads] == [8, 9] and {60, 61, 62, 63, 64} <= {r[C.CURRENT_ID] for r in rows}
    assert _reads(part, ["id"], [archive.EqualTo((C.CURRENT_ID,), 1000)]) == ([], [])
    assert len(_reads(part, ["id"], [archive.EqualTo((C.CURRENT_ID,), "text"), archive.In(("none",), (1,))])[0]) == 72


def test_archive_requests_stay_within_the_wanted_columns(where):
    """Bytes that are fetched, against the chunks of the wanted columns."""
    import io

    offset, size = archive.entries_of(where["zip"])[2]
    fetched = []

    class Spy(io.FileIO):
        def read(self, n=-1):
            fetched.append((self.tell(), n))
            return super().read(n)

    with Spy(where["zip"]) as stream:
        meta = archive._parquet(stream, offset, size).metadata
        wanted = archive.chunk_ranges(meta, 3, ["id", "pressure"])
        fetched.clear()
        _, requests = archive.prefetched(stream, offset, size, wanted)
    assert len(wanted) == 2 and len(fetched) == requests and sum(n for _, n in fetched) < size / 4
    assert all(any(at - offset <= a and a + n <= at - offset + m for at, m in fetched) for a, n in wanted)


def test_archive_filters_and_columns_through_spark(spark, load):
    d = load("zip", columns={2: ["pressure"]})
    assert C.STATS_COLUMNS[0] not in d.levels[2].columns and "pressure" in d.levels[2].columns and d.data.read(0).read(0).read(1).endswith("deep.zip")
    found = d.levels[2].where("pressure = 301 AND `internal:current_id` >= 60")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual" in plan or "internal:current_id" in plan
    assert found.count() == 2
    assert load("nested", columns={0: ["basin_km2"]}).levels[0].where("basin_km2 > 3000").count() == 1


class _Ranges(http.server.BaseHTTPRequestHandler):
    """Files of a folder by byte ranges alone."""

    def _raw(self):
        return (self.server.home / self.path.lstrip("/")).read_bytes()

    def do_HEAD(self):
        self.send_response(200)
        self.send_header("Content-Length", str(len(self._raw())))
        self.end_headers()

    def do_GET(self):
        a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
        body = self._raw()[a : b + 1]
        self.send_response(206)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_archive_over_http(spark, where):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Ranges)
    server.home = pathlib.Path(where["zip"]).parent
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}/deep.zip"
        d = treecat.load(url, spark=spark)
        assert d.n == 12 and d.levels[2].agg(F.sum("pressure")).first()[0] == load_local(spark, where)
        assert d.levels[2].select(q(C.GDAL_VSI)).first()[0].endswith(f",/vsicurl/{url}")
        with pytest.raises(StorageError):
            treecat.load(url.replace("deep.zip", "none.zip"), spark=spark)
    finally:
        server.shutdown()


def load_local(spark, where):
    return treecat.load(where["zip"], spark=spark).levels[2].agg(F.sum("pressure")).first()[0]


def test_streams_know_the_schemes(tmp_path, monkeypatch):
    monkeypatch.setenv("AWS_REGION", "eu-west-1")
    (tmp_path / "x y").write_bytes(b"0123456789")
    for path in (str(tmp_path / "x y"), f"file:{tmp_path}/x%20y", f"file://{tmp_path}/x%20y"):
        with streams.open_input(path) as f:
            f.seek(3)
            assert f.read(4) == b"3456" and f.seek(0, 2) == 10
    for scheme in ("s3a", "s3n", "s3"):
        fs, inner = streams.file_system(f"{scheme}://bucket/key")
        assert type(fs).__name__ == "S3FileSystem" and inner == "bucket/key"
    with pytest.raises(StorageError):
        streams.named("no function")


def foreign_header(stream):
    """Another maker's header: a magic, the number of entries, then text."""
    assert stream.read(8) == b"FOREIGN1"
    n = int(stream.read(4))
    return [tuple(map(int, stream.read(24).split())) for _ in range(n)]


def test_header_hook(spark, where, tmp_path):
    raw = pathlib.Path(where["zip"]).read_bytes()
    entries = archive.read_header(raw)
    head = b"FOREIGN1" + f"{len(entries):4d}".encode() + b"".join(f"{a:12d}{n:12d}".encode() for a, n in entries)
    (tmp_path / "f.zip").write_bytes(head.ljust(archive.HEADER, b" ") + raw[archive.HEADER :])
    with pytest.raises(FormatError):
        treecat.load(str(tmp_path / "f.zip"), spark=spark)
    assert treecat.load(str(tmp_path / "f.zip"), spark=spark, header=f"{__name__}:foreign_header").levels[1].count() == 36


def test_many_archives(spark, where, monkeypatch):
    """Footers read by the driver or by tasks give the same rows."""
    monkeypatch.setattr(archive, "FEW", 0)
    assert [type(p.groups) for p in archive._Reader([[where["zip"], *archive.entries_of(where["zip"])[0]]], ["id"], None).partitions()] == [type(None)]
    d = treecat.load([where["zip"], where["zip"]], spark=spark)
    assert d.n == 24 and d.levels[2].count() == 144
    assert archive.requests(where["zip"]) == [[0, 1, 2, 3]]


def test_archive_header():
    entries = [(256, 10), (266, 0), (300, 5)]
    assert archive.read_header(archive.pack_header(entries)) == entries
    with pytest.raises(FormatError):
        archive.read_header(b"\0" * 256)
    with pytest.raises(FormatError):
        archive.pack_header([(0, 1)] * 20)


def test_pointers_lead_to_bytes(spark, load, where):
    root, offset, size = paths.parse_subfile(load("zip").levels[2].select(q(C.GDAL_VSI)).where(q(C.CURRENT_ID) == 7).first()[0])
    with open(root, "rb") as f:
        f.seek(offset)
        assert f.read(size) == b"block00007"
    moved = load("parts", base_path="s3://bucket/data").levels[0].select(q(C.GDAL_VSI)).first()[0]
    assert moved.endswith(",/vsis3/bucket/data/a.zip") or moved.endswith(",/vsis3/bucket/data/b.zip")
    got = {r["id"]: r[C.GDAL_VSI] for r in load("nested").levels[0].collect()}
    assert got["po"] == where["nested"] + "/DATA/po/__meta__"
    got = load("deep").levels[1].select(q(C.GDAL_VSI)).where(q(C.CURRENT_ID) == 0).first()[0]
    assert got == where["deep"] + "/DATA/cruise_000/inshore/__meta__"


def test_padding_is_hidden(spark):
    rows = spark.sql(f"SELECT * FROM VALUES ('a', 'FILE', 0L), ('{C.PADDING_PREFIX}1', 'FILE', 1L), (CAST(NULL AS STRING), 'FILE', 2L) AS t(id, type, `{C.CURRENT_ID}`)")
    d = treecat.from_levels(spark, fx.document(C.FILE, 3, {}, "p"), {0: rows}, C.PLAIN, "/p", "/p")
    assert ids(d) == ["a"]


# --- filters ---------------------------------------------------------------------


def test_boxes(load):
    flat = load("flat")
    near = lambda n, half=1: fx.around(*fx.spot(n), half)
    assert ids(flat.filter_bbox(*near(2))) == ["buoy_charlie"]
    assert ids(flat.filter_bbox(100, 80, 101, 81)) == []
    x, y = fx.spot(2)
    beside = (x + 0.1, y + 0.1, x + 3, y + 3)  # meets the box, not its centre
    assert ids(flat.filter_bbox(*beside)) == ["buoy_charlie"] and ids(flat.filter_bbox(*beside, geometry_col=fx.CENTRE)) == []
    assert ids(flat.filter_bbox(x + 0.25, y, x + 1, y + 1)) == ["buoy_charlie"]  # touching counts
    assert ids(load("nested").filter_bbox(*near(0))) == ["loire"]
    assert ids(load("nested").filter_bbox(*near(6), level=1)) == ["ebro"]
    with pytest.raises(QueryError):
        load("deep").filter_bbox(0, 0, 1, 1, level=1)
    with pytest.raises(QueryError):
        flat.filter_bbox(0, 0, 1, 1, geometry_col="none")


def test_dates(load):
    flat = load("flat")
    assert ids(flat.filter_datetime("2021-06-01/2021-06-17")) == ["buoy_alpha"]  # the next one is out on the 18th
    assert ids(flat.filter_datetime("2021-06-01/2021-06-18")) == ["buoy_alpha", "buoy_bravo"]
    assert ids(flat.filter_datetime("2021-06-18")) == ["buoy_bravo"]
    assert ids(load("nested").filter_datetime("2021-07-12/2021-07-13", level=1)) == ["ebro", "po"]  # days 41 and 42
    box = fx.around(*fx.spot(3), 20)
    one = flat.filter_bbox(*box).filter_datetime("2021-06-01/2021-07-10")
    other = flat.filter_datetime("2021-06-01/2021-07-10").filter_bbox(*box)
    assert ids(one) == ids(other) == ["buoy_charlie"]
    with pytest.raises(QueryError):
        flat.filter_datetime("2021-06-01", time_col="none")
    with pytest.raises(QueryError):
        flat.filter_datetime("2021-06-01", level=1)


def test_date_filter_reaches_the_scan(load, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = load("flat").filter_datetime("2021-06-01/2021-06-15").current.select("id")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(`istac:time_start`" in plan


@pytest.mark.parametrize("bad", ["", "x", "2023-02-01/2023-01-01", "a/b", "2023-01-01/2023-01-02/2023-01-03", 5, None, ("2023-01-01", "2023-01-02")])
def test_bad_dates(bad):
    with pytest.raises(QueryError):
        temporal.parse_range(bad)


def test_date_arguments():
    from datetime import date, datetime, timedelta, timezone

    assert temporal.parse_range("2023-01-01T23:30:00-02:00") == (date(2023, 1, 2), None)
    assert temporal.parse_range("2023-01-01T10:00:00Z/2023-01-03") == (date(2023, 1, 1), date(2023, 1, 3))
    east = timezone(timedelta(hours=9))
    assert temporal.parse_range((datetime(2023, 1, 1, 1, tzinfo=east), datetime(2023, 1, 5))) == (date(2022, 12, 31), date(2023, 1, 5))


def test_date_like_strings(spark):
    texts = ["2023-01-15", "2023-1-5", "2023-01-15T10:00:00Z", "2023", "2023-01", "2023-01-15 junk", "2023/01/15", " 2023-01-15 ", "", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [str(r[0]) if r[0] else None for r in df.select(temporal.as_day(df, "t")).collect()]
    assert got == ["2023-01-15", "2023-01-05", "2023-01-15", None, None, None, "2023-01-15", "2023-01-15", None, None, None]
    assert df.select(temporal.as_day(df.select(F.lit(5).alias("t")), "t")).first()[0] is None


def wkb(kind, *body, order="<", extra=0):
    return struct.pack(order + "BI", order == "<", kind) + b"".join(body)


def ring(*xy, order="<"):
    return struct.pack(f"{order}I{2 * len(xy)}d", len(xy), *(v for p in xy for v in p))


def test_geometries():
    box = (0.0, 0.0, 1.0, 1.0)
    around = ring((-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5))
    hole = ring((-2, -2), (2, -2), (2, 2), (-2, 2), (-2, -2))
    n = struct.pack("<I", 1)
    cases = [
        (geo.point_wkb(0.5, 0.5), True), (geo.point_wkb(1, 1), True), (geo.point_wkb(1.01, 1), False), (wkb(1, struct.pack("<2d", float("nan"), float("nan"))), False),
        (wkb(2, ring((-1, 0.5), (2, 0.5))), True), (wkb(2, ring((-1, 2), (2, 2))), False), (wkb(2, ring((-1, 1), (1, 3))), False), (wkb(2, ring((-1, 0), (1, 2))), True),
        (wkb(3, n, around), True), (wkb(3, struct.pack("<I", 2), around, hole), False), (wkb(3, n, ring((1, 1), (2, 1), (2, 2), (1, 1))), True),
        (wkb(3, struct.pack("<I", 0)), False), (wkb(4, n, geo.point_wkb(0.1, 0.1)), True), (wkb(6, n, wkb(3, n, around)), True), (wkb(7, n, geo.point_wkb(9, 9)), False),
        (struct.pack(">BI2d", 0, 1, 0.5, 0.5), True), (struct.pack("<BI3d", 1, 1001, 0.5, 0.5, 7), True), (struct.pack("<BII3d", 1, 0xA0000001, 4326, 0.5, 0.5, 7), True), (None, False), (b"", False),
    ]
    for raw, want in cases:
        assert geo.intersects(raw, box) is want, raw


def test_geometry_column_matches_single_tests(spark):
    rng = np.random.default_rng(3)
    raws = [geo.point_wkb(*rng.uniform(-3, 3, 2)) for _ in range(50)]
    raws += [geo.box_wkb(x, y, x + 1, y + 1) for x, y in rng.uniform(-3, 3, (50, 2))]
    raws += [wkb(3, struct.pack("<I", 1), ring((0, 0), (3, 0), (0, 3), (0, 0))), None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, g binary")
    box = (0.2, 0.2, 1.5, 1.5)
    got = {r["i"] for r in df.where(geo.wkb_meets(F.col("g"), box)).collect()}
    assert got == {i for i, r in enumerate(raws) if geo.intersects(r, box)}


# --- SQL -------------------------------------------------------------------------


def test_sql_chains_and_scopes(load):
    flat = load("flat")
    d = flat.sql("SELECT * FROM data WHERE depth_m < 60").sql("WITH x AS (SELECT * FROM DATA) SELECT * FROM x JOIN (SELECT id AS i FROM data) y ON x.id = y.i WHERE owner LIKE 'p%';")
    assert ids(d) == ["buoy_bravo"] and d.extent_modified and ids(flat) == [f"buoy_{b}" for b in fx.BUOYS]
    assert flat.sql('SELECT "internal:current_id" AS k FROM data').current.columns == ["k"]
    for bad in ("DROP TABLE data", "CREATE TABLE x AS SELECT 1", "SELEC 1"):
        with pytest.raises(QueryError):
            flat.sql(bad)


def test_sql_marks_what_is_no_longer_homogeneous(load):
    deep = load("deep")
    assert deep.is_rsut() and deep.sql("SELECT * FROM data").is_rsut()
    assert not deep.sql("SELECT id FROM data").is_rsut()
    for text in ("SELECT d.* FROM data d, level1 l WHERE l.`internal:parent_id` = d.`internal:current_id`", "SELECT * FROM data WHERE `internal:current_id` IN (SELECT `internal:parent_id` FROM level1)"):
        d = deep.sql(text)
        assert not d.is_rsut() and d.joined == {1}


def test_order_by_sets_positions(load):
    d = load("flat").sql("SELECT * FROM data ORDER BY depth_m DESC")
    assert d.data.read(0).endswith("/DATA/buoy_foxtrot")
    assert [r["id"] for r in d.data.head(2).collect()] == ["buoy_foxtrot", "buoy_echo"]
    assert C.ORDER not in d.data.columns


# --- cascade and homogeneity -------------------------------------------------------


def test_cascade_over_parts_uses_the_source(load):
    d = load("parts").sql("SELECT * FROM data WHERE id = 'cruise_003'")
    d = d.filter_datetime("2021-06-28")
    assert ids(d) == ["cruise_003"]
    kids = d.data_raw.read("cruise_003")
    assert len(kids) == 3 and {r["internal:source_file"] for r in kids.df.collect()} == {"a.zip"}
    assert len(d.data_raw.children().children()) == 6


def test_cascade_keeps_children_and_composes(load):
    d = load("nested").filter_datetime("2021-07-01/2021-09-29", level=1)  # days 30 to 120: gauges 1 and 2
    assert len(d.data.read("po")) == 2 and len(d.data.read("loire")) == 1 and len(d.data.read("tisza")) == 2
    assert C.CURRENT_ID in d.data.columns
    x, y = fx.spot(3)  # gauges 0 to 3 are those of the Loire and the Po's first two
    narrowed = d.filter_bbox(-31, -11, x, y, level=1)
    assert ids(narrowed) == ["loire", "po"] and len(narrowed.data.read("po")) == 1
    root = d.filter_bbox(*fx.around(*fx.spot(0)))
    assert ids(root) == ["loire"] and root.filtered[1].count() == 1
    assert d.sql("SELECT * FROM data").filtered == {}


def test_homogeneity(load):
    assert load("deep").verify_rsut() and load("flat").verify_rsut() and not load("nested").verify_rsut()
    first_days = load("nested").filter_datetime("2021-06-01/2021-06-10", level=1)  # one gauge of each river
    assert ids(first_days) == sorted(fx.RIVERS) and first_days.is_rsut()
    assert not load("nested").filter_datetime("2021-06-01/2021-12-31", level=1).is_rsut()
    assert not load("nested").filter_bbox(100, 80, 101, 81, level=1).is_rsut()


def test_homogeneity_by_digests(spark):
    """Ids in any order, repeated ids, and separators inside ids."""
    kids = {0: ["a", "b"], 1: ["b", "a"], 2: ["a|b"], 3: ["a", "a"], 4: [], 5: [None], 6: ["a", "b", None]}
    parent = spark.createDataFrame([(k,) for k in kids], f"`{C.CURRENT_ID}` long")
    child = spark.createDataFrame([(k, i) for k, names in kids.items() for i in names], f"`{C.PARENT_ID}` long, id string")
    found = {r[C.CURRENT_ID]: (r["n"], r["h"], r["g"]) for r in homogeneity.child_digests(parent, child).collect()}
    assert found[0] == found[1] == found[6] and len({found[k] for k in (0, 2, 3)}) == 3 and found[4] == found[5] == (None, None, None)
    some = lambda *which: parent.where(q(C.CURRENT_ID).isin(*which))
    assert homogeneity.is_homogeneous(some(0, 1, 4, 5, 6), child) and not homogeneity.is_homogeneous(some(0, 2), child)
    assert not homogeneity.is_homogeneous_after_cascade(some(0, 4), child) and homogeneity.is_homogeneous_after_cascade(some(4, 5), child)


# --- statistics ----------------------------------------------------------------------


def test_statistics_known_answers(load):
    flat = load("flat")
    w, means = np.array([200.0 * (i + 1) for i in range(6)]), np.array([8.0 + i for i in range(6)])
    mean = (w * means).sum() / w.sum()
    assert flat.stats_mean(0) == pytest.approx(mean) and flat.stats_min(0) == 8 - 12 and flat.stats_max(1) == 30 + 14
    assert flat.stats_p25(0) == pytest.approx(means.mean() - 2) and flat.stats_median(0) == flat.stats_p50(0) == pytest.approx(means.mean() + 0.5)
    assert list(flat.stats_p75([1, 0])) == pytest.approx([25.0 + 3, means.mean() + 3]) and flat.stats_p95(0) == pytest.approx(means.mean() + 9)
    want = math.sqrt((((w - 1) * 9).sum() + (w * (means - mean) ** 2).sum()) / (w.sum() - 1))
    assert flat.stats_std(0) == pytest.approx(want, rel=1e-5)
    one = flat.sql("SELECT * FROM data WHERE id = 'buoy_delta'")
    assert one.stats_mean(0) == 11.0 and one.stats_mean(0, scope="all") == pytest.approx(mean)


def test_deviation_of_large_means(spark):
    """Means near 1e8 with a deviation of one: squares around zero would lose it."""
    far = [1e8 + 8 * k for k in range(-3, 4)]  # exact in float32
    df = _cells(spark, [([fx.cell(m, 1.0)], [1, 10, 10]) for m in far])
    w, m = 100.0, np.array(far)
    want = math.sqrt((7 * (w - 1) + w * ((m - m.mean()) ** 2).sum()) / (7 * w - 1))
    assert stats.continuous(df, "std").first()["value"] == pytest.approx(want, rel=1e-9)


def test_statistics_below_a_parent(load):
    nested = load("nested")
    assert list(nested.stats_categorical(0, level=1, id="ebro")) == pytest.approx([0.1, 0.7, 0.2])
    assert nested.stats_mean(0, level=1, id="po") == pytest.approx(51.5)
    for call in (lambda: nested.stats_mean(0, level=1, id="tisza"), lambda: nested.stats_mean(0, level=1, id="ebro"), lambda: nested.stats_categorical(0, level=1, id="po"), lambda: nested.stats_mean(0, level=1), lambda: nested.stats_mean(0), lambda: nested.stats_mean(5, level=1, id="po"), lambda: nested.stats_mean(0, level=1, id="none"), lambda: nested.stats_mean(0, scope="x")):
        with pytest.raises(QueryError):
            call()
    assert load("parts").stats_mean(0, level=2, id="shelf") == pytest.approx(5.5 + 0.25)


def _cells(spark, rows):
    return spark.createDataFrame(rows, f"`{C.STATS_COLUMNS[0]}` array<array<float>>, `{C.SHAPE_COLUMN}` array<bigint>")


def test_statistics_weights_and_odd_cells(spark):
    df = _cells(spark, [([fx.cell(40.0)], [1, 100, 100]), ([fx.cell(60.0)], [1, 300, 300]), (None, [1, 9, 9]), ([], [1, 9, 9])])
    assert stats.aggregate(df, "mean")[0] == pytest.approx(58.0)
    assert [r[0] for r in df.select(stats.pixel_weight(df)).limit(2).collect()] == [10000.0, 90000.0]
    single = _cells(spark, [([fx.cell(40.0)], [100])])
    assert single.select(stats.pixel_weight(single)).first()[0] == 1.0 and np.isnan(stats.aggregate(single, "std")[0])
    nan = _cells(spark, [([[float("nan")] * 9], [1, 1, 2]), ([fx.cell(1.0)], [1, 1, 2])])
    assert np.isnan(stats.aggregate(nan, "min")[0]) and np.isnan(stats.aggregate(nan, "max")[0])
    both = _cells(spark, [([[0.6, 0.3, 0.1]], [1, 2, 2]), ([[0.2, 0.5, 0.3]], [1, 2, 2])])
    assert list(stats.aggregate(both, "categorical")[0]) == pytest.approx([0.4, 0.4, 0.2])


# --- concat --------------------------------------------------------------------------


def test_concat_of_filtered_datasets(load):
    a = load("deep").sql("SELECT * FROM data WHERE id = 'cruise_001'")
    b = load("zip").sql("SELECT * FROM data WHERE id = 'cruise_009'")
    with pytest.raises(SchemaError):
        treecat.concat([a, b])
    c = treecat.concat([a, load("deep").sql("SELECT * FROM data WHERE id = 'cruise_009'")])
    assert ids(c) == ["cruise_001", "cruise_009"] and c.levels[1].count() == 6 and c.levels[2].count() == 12
    assert c.pit_schema.root["n"] == 2 and c.path == "<concatenated>" and c.is_rsut() and not c.extent_modified
    again = treecat.concat([c, a])
    assert again.n == 3 and again.levels[2].count() == 18
    none = load("deep").sql("SELECT * FROM data WHERE id = 'none'")
    assert treecat.concat([none, none]).levels[1].count() == 0 and treecat.concat([none, a]).levels[1].count() == 3
    with pytest.raises(QueryError):
        treecat.concat([a])
    with pytest.raises(QueryError):
        treecat.concat([a, a], "other")


def test_concat_columns(load):
    a = load("flat")
    b = a.replace(current=a.current.withColumn("extra", F.lit(1)))
    assert "extra" not in treecat.concat([a, b]).current.columns
    filled = treecat.concat([a, b], "fill_missing").current
    assert filled.where("extra IS NULL").count() == 6 and filled.where("extra = 1").count() == 6
    with pytest.raises(SchemaError, match="extra"):
        treecat.concat([a, b], "strict")
    with pytest.raises(SchemaError, match="dataset 1 lacks"):
        treecat.concat([a, a.replace(current=a.current.drop("type"))])
    text = a.replace(current=a.current.withColumn("depth_m", F.lit("deep")))
    assert treecat.concat([a, text]).current.schema["depth_m"].dataType.simpleString() == "string"
    with pytest.raises(SchemaError):
        treecat.concat([a, load("nested")])
    with pytest.raises(SchemaError):
        treecat.concat([a, a.replace(rsut=False)])
    with pytest.raises(QueryError):
        treecat.concat([a, a.replace(backend="pandas")])


def test_written_catalogs_load_again(load, spark, tmp_path):
    d = load("nested").filter_datetime("2021-07-01/2021-09-29", level=1)
    again = treecat.load(d.write(str(tmp_path / "n")), spark=spark)
    assert again.n == 4 and again.levels[1].count() == 6 and again.format == C.PLAIN and again.schema.root["n"] == 4
    for name in ("parts", "zip"):
        d = load(name).sql("SELECT * FROM data WHERE id >= 'cruise_004'")
        if name == "zip":
            d = d.replace(levels={n: df.withColumn(C.SOURCE_FILE, F.lit("deep.zip")) for n, df in d.levels.items()}, current=d.current.withColumn(C.SOURCE_FILE, F.lit("deep.zip")))
        again = treecat.load(d.write(str(tmp_path / name)), spark=spark)
        assert (again.n, again.levels[1].count(), again.levels[2].count(), again.format) == (8, 24, 48, C.CONSOLIDATED)


# --- frames --------------------------------------------------------------------------


def test_navigation(load):
    f = load("deep").data
    assert f.read(0).level == 1 and len(f.read("cruise_000")) == 3
    leaf = f.read(3).read("slope").read(1)
    assert leaf.endswith("/DATA/cruise_003/slope/oxygen")
    for bad in (-1, 12, "none", None, True):
        with pytest.raises(NavigationError):
            f.read(bad)
    flat = load("flat").data
    assert flat.read("buoy_charlie").endswith("/DATA/buoy_charlie")
    with pytest.raises(NavigationError):
        flat.children()
    with pytest.raises(NavigationError):
        load("flat").sql("SELECT depth_m FROM data").data.read("x")


def test_frame_operations(load):
    f = load("flat").data
    assert f.shape == (6, len(f.columns)) and not any(c.startswith("internal:") and c != C.GDAL_VSI for c in f.columns)
    names = [f"buoy_{b}" for b in fx.BUOYS]
    assert [r["id"] for r in f.tail(2).collect()] == names[-2:]
    assert [r["id"] for r in f[1:3].collect()] == names[1:3]
    assert f["id"].columns == ["id"] and len(f[F.col("depth_m") > 50]) == 4 and len(f.query("depth_m > 50")) == 4
    assert [r["id"] for r in f.loc[[names[4], names[0]]].collect()] == [names[0], names[4]]
    assert f.sort("depth_m", ascending=False).limit(1).df.first()["id"] == names[-1]
    assert f.with_columns(x=F.lit(1)).df.first()["x"] == 1
    f["y"] = F.lit(2)
    assert f.iloc[1].first()["y"] == 2 and f.iloc[3:].count() == 3 and f.loc[names[1]].count() == 1
    with pytest.raises(ValueError):
        f["id"] = F.lit(1)
    with pytest.raises(ValueError):
        f.assign(id=F.lit(1))
    with pytest.raises(KeyError):
        f.select("none")
    assert f.group_by("type").count().first()["count"] == 6
    assert f.to_arrow().num_rows == 6 and len(f.to_pandas()) == 6
    assert {r["id"]: r["position"] for r in f.with_position().collect()} == {x: i for i, x in enumerate(names)}
    assert names[0] in repr(f)


def test_positions_of_many_wide_rows(spark):
    """As many positions as row numbers, where the sort has more partitions than a small table would show."""
    n = 500_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias(C.CURRENT_ID), F.lit(C.FILE).alias(C.TYPE), F.concat(F.lit("s"), F.col("id") * 7919 % n).alias(C.ID), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        d = treecat.from_levels(spark, fx.document(C.FILE, n, {}, "many"), {0: rows}, C.PLAIN, "/m", "/m")
        found = d.data_raw.with_position()
        assert found.where(q("position") != q(C.CURRENT_ID)).count() == 0 and found.select("position").distinct().count() == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_backends(load):
    assert isinstance(load("flat").data.collect(), pa.Table)
    treecat.register_backend("count", lambda df: df.count())
    assert load("flat", backend="count").data.collect() == 6
    treecat.use("pandas")
    assert treecat.get_backend() == "pandas" and len(load("flat").data.collect()) == 6
    treecat.use("arrow")
    with pytest.raises(BackendError):
        treecat.use("none")


# --- plain functions -----------------------------------------------------------------


def test_paths():
    assert paths.to_vsi("s3://b/k") == "/vsis3/b/k" and paths.to_vsi("azure://b") == "/vsiaz/b" and paths.to_vsi("https://h/x") == "/vsicurl/https://h/x"
    assert paths.to_vsi("relative").startswith("/") and paths.to_vsi("ftp://x") == "ftp://x"
    for p in ("s3://b/k", "gs://b", "oss://b", "swift://b", "http://h/x", "az://b"):
        assert paths.from_vsi(paths.to_vsi(p)) == p
    assert paths.parse_subfile("/vsisubfile/5_7,/a,b") == ("/a,b", 5, 7)
    for bad in ("/x", "/vsisubfile/5,/a", "/vsisubfile/a_b,/c", "/vsisubfile/5_6"):
        with pytest.raises(FormatError):
            paths.parse_subfile(bad)


def test_tree_schema():
    tree = TreeSchema.from_dict(fx.cruises()[0][C.TREE_KEY])
    assert tree.max_depth == 2 and tree.with_n(3).root["n"] == 3 and tree.root["n"] == 12
    both = merge([tree, tree])
    assert both.root["n"] == 24 and both.hierarchy["2"][1]["n"] == 48 and tree.hierarchy["2"][1]["n"] == 24
    assert tree.is_compatible(tree.with_n(0)) and not tree.is_compatible(TreeSchema.from_dict(fx.rivers()[0][C.TREE_KEY]))
    bad = [({"type": "X"}, {}), ({"type": C.FILE}, {"a": []}), ({"type": C.FILE}, {"1": [{"type": [C.FILE], "id": []}]}), ({"type": C.FILE}, {"1": [{"type": [C.FILE], "id": ["a", "b"]}]}), ({"type": C.FILE}, {"1": [{"type": ["X"], "id": ["a"]}]})]
    for root, hierarchy in bad:
        with pytest.raises(SchemaError):
            TreeSchema(root, hierarchy)


def test_ranges():
    mb = 1 << 20
    assert plan_ranges([(0, 10 * mb), (11 * mb, 10 * mb), (26 * mb, 100 * mb), (0, 0), (127 * mb, 1)]) == [[0, 1], [2, 4]]
    assert plan_ranges([(0, 10), (26, 10)]) == [[0], [1]] and plan_ranges([(0, 10), (20, 10)]) == [[0, 1]] and plan_ranges([(0, 0)]) == []


def test_cache(tmp_path, monkeypatch):
    monkeypatch.setenv(cache.ENVIRONMENT, str(tmp_path / "c"))
    calls = []
    get = lambda n: calls.append(n) or n.encode()
    for remote, want in (({"etag": "1"}, 1), ({"etag": "1"}, 1), ({"etag": "2"}, 2), (None, 2), ({"size": 5}, 2)):
        assert cache.fetch("s3://x", ["a"], get, remote)["a"].read_bytes() == b"a" and len(calls) == want
    assert cache.stats()["entries"] == 1
    cache.clear()
    assert cache.stats() == {"entries": 0, "bytes": 0}


def test_remote_documents_are_cached_on_disk(spark, monkeypatch, tmp_path):
    monkeypatch.setenv(cache.ENVIRONMENT, str(tmp_path / "c"))
    reads, state = [], {"size": 2, "etag": "1"}
    monkeypatch.setattr(files, "read_range", lambda spark, path, *a: reads.append(path) or b"{}")
    monkeypatch.setattr(files, "version", lambda spark, path: dict(state))
    for want in (1, 1):
        collection.forget()
        assert collection.read(spark, "s3a://b/c/COLLECTION.json") == {} and len(reads) == want
    state["etag"] = "2"
    collection.forget()
    assert collection.read(spark, "s3a://b/c/COLLECTION.json") == {} and len(reads) == 2


def test_text_and_html(load):
    d = load("deep").filter_datetime("2021-06-01/2021-06-28")
    assert "(filtered)" in repr(d) and "root samples: 4" in repr(d)
    page = load("deep")._repr_html_()
    assert all(x in page for x in ("<svg", "inshore", "oxygen", "cruises, made up"))
    assert load("deep").navigation_columns(describe=True)["id"] and load("zip").navigation_columns()[0] == "id"
    with load("flat", persist=True) as d:
        assert d.collection["id"] == "buoys" and d.field_schema
    with pytest.raises(ValueError):
        treecat.verbose("loud")
    treecat.verbose(False)


def test_cells_of_orders_against_plain_statistics(spark, tmp_path):
    """Percentiles between two values, ties, nulls, one row, one large group, an order without customer; lines are shuffled once and narrow."""
    from treecat import catalog_queries as cq

    rng = np.random.default_rng(6)
    groups = {1: [5.0], 2: [1.0, 2.0], 3: [7.0, 7.0, None, 9.0], 4: rng.normal(size=5_000).tolist(), 5: [None], 6: [3.0, 1.0, 2.0, 10.0, 4.0]}
    lines = [(k, v, None if v is None else v * 100) for k, vs in groups.items() for v in vs]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_extendedprice double").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, 70 + k) for k in (1, 2, 3, 4, 5)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    cells = cq._order_cells(spark, str(tmp_path))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "percentile" not in plan
    found = {r["l_orderkey"]: r for r in cells.collect()}
    assert {k: r["o_custkey"] for k, r in found.items()} == {1: 71, 2: 72, 3: 73, 4: 74, 5: 75, 6: None}
    for k, vs in groups.items():
        assert found[k][C.SHAPE_COLUMN] == [2, len(vs), 1]
        for band, times in enumerate((1, 100)):
            v, got = np.array([x for x in vs if x is not None]) * times, found[k][C.STATS_COLUMNS[0]][band]
            if not len(v):
                assert got == [None, None, None, 0.0, 100.0, None, None, None, None]
                continue
            want = [v.min(), v.max(), v.mean(), v.std(ddof=1) if len(v) > 1 else 0.0, 100.0, *np.quantile(v, (0.25, 0.5, 0.75, 0.95))]
            assert got == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_archive_levels_are_written_by_several_tasks(spark, tmp_path):
    """No task writes a whole level: each partition has row groups of its own, in order."""
    from treecat.sources.export import write_archive

    place = "CAST(0 AS LONG) AS `internal:offset`, CAST(1 AS LONG) AS `internal:size`"
    rows = spark.range(0, 5_000, 1, 5).selectExpr("concat('s', id) AS id", "'FILE' AS type", "id AS `internal:current_id`", place.split(", CAST")[0], "CAST" + place.split(", CAST")[1], "IF(id % 7 = 0, NULL, id * 0.5) AS x")
    path = write_archive(spark, str(tmp_path / "a.zip"), [rows, rows.limit(0)], {"id": "a", "dataset_version": "1.0.0", "description": "", C.TREE_KEY: {"root": {"n": 0, "type": "FILE"}, "hierarchy": {}}})
    (offset, size), (at, long), _ = archive.entries_of(path)
    with open(path, "rb") as f:
        raw = f.read()
    file = archive.pq.ParquetFile(archive.pa.BufferReader(raw[offset : offset + size]))
    assert file.num_row_groups == 5 and file.read().column("internal:current_id").to_pylist() == list(range(5_000))
    assert file.read().column("x").to_pylist() == [None if i % 7 == 0 else i * 0.5 for i in range(5_000)]
    assert archive.pq.ParquetFile(archive.pa.BufferReader(raw[at : at + long])).metadata.num_rows == 0
