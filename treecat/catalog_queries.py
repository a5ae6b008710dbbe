"""The engine's operators over the driver's tables, each with the SQL that gives the same rows.

Trees built from the tables: H1 region > nation > customer, H2 customer >
orders > lineitem, H3 like H2 in three consolidated parts with row numbers per
part, H4 the flat events.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from . import constants as C
from .dataset import Dataset, from_levels
from .errors import TreecatError
from .functions import geo
from .functions.paths import subfile, subfile_parts
from .legacy.container import BARE, KIND, LENGTH, NAME, OFFSET, POINTER, load as load_containers
from .legacy.sanity import sanity_check
from .legacy.text import points
from .loader import load
from .operators import homogeneity, stats
from .operators.concat import concat
from .operators.levels import q, with_pointer, without_padding
from .operators.ranges import coalesce_ranges, running_offset
from .sources import files
from .sources.export import write_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A made-up input table, written once in a session, so that queries over it run their own operator alone."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = files.scratch(spark, name)
        make().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


# --- trees -------------------------------------------------------------------


def _document(root: str, depths: list[str]) -> dict:
    hierarchy = {str(n + 1): [{"n": 0, "type": [t], "id": ["item"]}] for n, t in enumerate(depths)}
    return {"id": "driver-tables", "dataset_version": "1.0.0", "description": "", C.TREE_KEY: {"root": {"n": 0, "type": root}, "hierarchy": hierarchy}}


def _node(kind: str, id_: str, current: str, parent: str | None = None) -> list:
    cols = [F.expr(id_).alias(C.ID), F.lit(kind).alias(C.TYPE), F.expr(current).cast("long").alias(C.CURRENT_ID)]
    return [*cols, F.expr(parent).cast("long").alias(C.PARENT_ID)] if parent else cols


def h1(spark: SparkSession, sf_dir: str) -> Dataset:
    t = lambda n: read(spark, sf_dir, n)
    levels = {
        0: t("region").select(*_node(C.FOLDER, "r_name", "r_regionkey")),
        1: t("nation").select(*_node(C.FOLDER, "n_name", "n_nationkey", "n_regionkey")),
        2: t("customer").select(*_node(C.FILE, "c_name", "c_custkey", "c_nationkey"), "c_acctbal", "c_mktsegment"),
    }
    return from_levels(spark, _document(C.FOLDER, [C.FOLDER, C.FILE]), levels, C.PLAIN, "/h1", "/h1")


def h2(spark: SparkSession, sf_dir: str) -> Dataset:
    t = lambda n: read(spark, sf_dir, n)
    levels = {
        0: t("customer").select(*_node(C.FOLDER, "c_name", "c_custkey"), "c_acctbal", "c_mktsegment"),
        1: t("orders").select(*_node(C.FOLDER, "concat('o', o_orderkey)", "o_orderkey", "o_custkey"), F.expr("concat('orders/', o_orderkey, '/')").alias(C.RELATIVE_PATH), F.col("o_orderdate").alias("istac:time_start"), "o_totalprice"),
        2: t("lineitem").select(*_node(C.FILE, "concat('l', l_orderkey, '_', l_linenumber)", "l_orderkey * 10 + l_linenumber", "l_orderkey"), F.expr("concat('orders/', l_orderkey, '/', l_linenumber)").alias(C.RELATIVE_PATH), F.col("l_shipdate").alias("istac:time_start"), "l_quantity"),
    }
    return from_levels(spark, _document(C.FOLDER, [C.FOLDER, C.FILE]), levels, C.PLAIN, "/h2", "/h2")


def h3(spark: SparkSession, sf_dir: str) -> Dataset:
    """Customers and orders in three parts; ids are row numbers within a part and so repeat across parts."""
    part = "concat('part', {} % 3)"
    number = lambda by: (F.row_number().over(Window.partitionBy(C.SOURCE_FILE).orderBy(by)) - 1).cast("long")
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.expr(part.format("c_custkey")).alias(C.SOURCE_FILE))
    customer = customer.withColumn(C.CURRENT_ID, number("c_custkey"))
    orders = read(spark, sf_dir, "orders").withColumn(C.SOURCE_FILE, F.expr(part.format("o_custkey")))
    keys = customer.select(F.col("c_custkey").alias("o_custkey"), q(C.CURRENT_ID).alias(C.PARENT_ID))
    orders = orders.join(keys, "o_custkey").withColumn(C.CURRENT_ID, number("o_orderkey"))
    place = [F.lit(200).cast("long").alias(C.OFFSET), F.lit(10).cast("long").alias(C.SIZE)]
    levels = {
        0: customer.select(F.expr("concat('c', c_custkey)").alias(C.ID), F.lit(C.FOLDER).alias(C.TYPE), q(C.CURRENT_ID), *place, q(C.SOURCE_FILE)),
        1: orders.select(F.expr("concat('o', o_orderkey)").alias(C.ID), F.lit(C.FILE).alias(C.TYPE), q(C.CURRENT_ID), q(C.PARENT_ID), *place, q(C.SOURCE_FILE), F.col("o_orderdate").alias("istac:time_start")),
    }
    return from_levels(spark, _document(C.FOLDER, [C.FILE]), levels, C.CONSOLIDATED, "/h3/.tacocat", "/h3")


def h4(spark: SparkSession, sf_dir: str) -> Dataset:
    rows = read(spark, sf_dir, "events").select(*_node(C.FILE, "concat('e', event_id)", "event_id"), F.col("ts").alias("istac:time_start"), "event_type", "value")
    return from_levels(spark, _document(C.FILE, []), {0: rows}, C.PLAIN, "/h4", "/h4")


LON, LAT = "({k} * 7919 % 36000) / {u} - 180", "({k} * 104729 % 18000) / {u} - 90"
LON_SQL, LAT_SQL = (x.format(k="{k}", u="100.0") for x in (LON, LAT))


def _points(df: DataFrame, key: str, boxes: bool = False) -> DataFrame:
    """``df`` with a WKB point for each key, or a box of two degrees around it."""

    @F.pandas_udf(T.BinaryType())
    def wkb(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = x.to_numpy(), y.to_numpy()
        corners = [(x - 1, y - 1), (x + 1, y - 1), (x + 1, y + 1), (x - 1, y + 1), (x - 1, y - 1)] if boxes else [(x, y)]
        head = np.frombuffer((geo.box_wkb(0, 0, 0, 0)[:13] if boxes else geo.point_wkb(0, 0)[:5]), np.uint8)
        body = np.stack([c for xy in corners for c in xy], axis=1).astype("<f8").view(np.uint8)
        rows = np.concatenate([np.tile(head, (len(x), 1)), body], axis=1)
        return pd.Series(list(map(bytes, rows)))

    lon, lat = (F.expr(x.format(k=key, u="100D")) for x in (LON, LAT))
    return df.withColumn("istac:geometry", wkb(lon, lat))


def spatial_h2(spark: SparkSession, sf_dir: str) -> Dataset:
    d = h2(spark, sf_dir)
    levels = {n: stored(spark, sf_dir, f"points{n}", lambda df=df: _points(df, f"`{C.CURRENT_ID}`")) for n, df in d.levels.items()}
    return d.replace(levels=levels, current=levels[0])


# --- padding, pointers, output -------------------------------------------------


@query("SELECT n_name AS id FROM nation WHERE n_name NOT LIKE '__TACOPAD__%'")
def padding_filter(spark, sf_dir):
    ids = read(spark, sf_dir, "nation").select(F.col("n_name").alias(C.ID))
    pads = spark.sql("SELECT * FROM VALUES ('__TACOPAD__0'), ('xyTACOPADzw1'), (CAST(NULL AS STRING)) AS t(id)")
    return without_padding(ids.union(pads))


@query("SELECT o_orderkey, '/vsisubfile/' || (o_orderkey * 100) || '_' || 100 || ',/data/a.zip' AS pointer FROM orders")
def vsi_pointer_archive(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 100).alias(C.OFFSET), F.lit(100).alias(C.SIZE))
    return with_pointer(rows, C.ARCHIVE, "/data/a.zip", 0).select("o_orderkey", q(C.GDAL_VSI).alias("pointer"))


@query("""
SELECT id, CASE WHEN folder THEN '/data/DATA/' || below || '/__meta__' ELSE '/data/DATA/' || below END AS pointer
FROM (SELECT r_name AS id, r_name AS below, true AS folder FROM region
      UNION ALL SELECT n_name, r_name || '/' || n_name, false FROM nation JOIN region ON r_regionkey = n_regionkey)""")
def vsi_pointer_folder(spark, sf_dir):
    regions, nations = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    top = regions.select(F.col("r_name").alias(C.ID), F.lit(C.FOLDER).alias(C.TYPE))
    below = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    below = below.select(F.col("n_name").alias(C.ID), F.lit(C.FILE).alias(C.TYPE), F.concat_ws("/", "r_name", "n_name").alias(C.RELATIVE_PATH))
    out = lambda df, level: with_pointer(df, C.PLAIN, "/data", level).select(C.ID, q(C.GDAL_VSI).alias("pointer"))
    return out(top, 0).union(out(below, 1))


@query("SELECT 'c' || c_custkey AS id, '/vsisubfile/200_10,/h3/part' || (c_custkey % 3) AS pointer FROM customer")
def vsi_pointer_consolidated(spark, sf_dir):
    return h3(spark, sf_dir).levels[0].select(C.ID, q(C.GDAL_VSI).alias("pointer"))


@query("SELECT o_orderkey, '/data/' || o_orderstatus || ',x' AS root, o_orderkey * 7 AS at, 12 AS size FROM orders")
def vsi_parse(spark, sf_dir):
    root = F.concat(F.lit("/data/"), "o_orderstatus", F.lit(",x"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", subfile(F.col("o_orderkey") * 7, F.lit(12), root).alias("pointer"))
    back, at, size = subfile_parts(F.col("pointer"))
    return rows.select("o_orderkey", back.alias("root"), at.alias("at"), size.alias("size"))


@query("SELECT c_name AS id, 'FOLDER' AS type, c_acctbal, c_mktsegment, '/h2/DATA/' || c_name || '/__meta__' AS pointer FROM customer")
def clean_output(spark, sf_dir):
    return h2(spark, sf_dir).data.df.withColumnRenamed(C.GDAL_VSI, "pointer")


@query("SELECT c_name AS id, c_custkey AS current_id, 'FOLDER' AS type, c_acctbal, c_mktsegment FROM customer")
def raw_output(spark, sf_dir):
    return h2(spark, sf_dir).data_raw.df.withColumnRenamed(C.CURRENT_ID, "current_id").drop(C.GDAL_VSI)


# --- SQL -----------------------------------------------------------------------


@query("SELECT c_name AS id, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_mktsegment = 'BUILDING'")
def sql_chain(spark, sf_dir):
    d = h2(spark, sf_dir).sql("SELECT * FROM data WHERE c_acctbal > 1000").sql("SELECT * FROM DATA WHERE c_mktsegment = 'BUILDING'")
    return d.current.select(C.ID, "c_acctbal")


@query("SELECT c_custkey AS k, upper(c_mktsegment) AS s FROM customer WHERE c_name LIKE '%1'")
def sql_columns(spark, sf_dir):
    return h2(spark, sf_dir).sql("""SELECT "internal:current_id" AS k, upper(c_mktsegment) AS s FROM data WHERE id LIKE '%1'""").current


@query("""
SELECT c_name AS id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey
WHERE c_mktsegment = 'MACHINERY' GROUP BY c_name""")
def sql_join_level(spark, sf_dir):
    d = h2(spark, sf_dir).sql("SELECT * FROM data WHERE c_mktsegment = 'MACHINERY'")
    return d.sql("""
        SELECT d.id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM data d
        JOIN level1 o ON o."internal:parent_id" = d."internal:current_id" GROUP BY d.id""").current


@query("""
SELECT id, p, r FROM (SELECT 'o' || o_orderkey AS id, o_totalprice AS p,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def sql_window(spark, sf_dir):
    return h2(spark, sf_dir).sql("""
        SELECT id, p, r FROM (SELECT id, o_totalprice AS p,
          row_number() OVER (PARTITION BY "internal:parent_id" ORDER BY o_totalprice DESC, "internal:current_id") AS r FROM level1) WHERE r <= 3""").current


@query("""
SELECT n_name AS nation, c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 4) AS mean
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY GROUPING SETS ((n_name, c_mktsegment), (n_name), ())""")
def sql_grouping_sets(spark, sf_dir):
    return h1(spark, sf_dir).sql("""
        SELECT n.id AS nation, c.c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 4) AS mean
        FROM level2 c JOIN level1 n ON n."internal:current_id" = c."internal:parent_id"
        GROUP BY GROUPING SETS ((n.id, c.c_mktsegment), (n.id), ())""").current


@query("""
SELECT c_name AS id FROM customer WHERE c_acctbal > 0 INTERSECT SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING'
EXCEPT SELECT c_name FROM customer WHERE c_custkey % 2 = 0""")
def sql_set_operations(spark, sf_dir):
    return h2(spark, sf_dir).sql("""
        SELECT id FROM data WHERE c_acctbal > 0 INTERSECT SELECT id FROM data WHERE c_mktsegment = 'BUILDING'
        EXCEPT SELECT id FROM data WHERE "internal:current_id" % 2 = 0""").current


@query("SELECT c_name AS id, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5")
def sql_order_limit(spark, sf_dir):
    return h2(spark, sf_dir).sql("""SELECT id, c_acctbal FROM data ORDER BY c_acctbal DESC, "internal:current_id" LIMIT 20 OFFSET 5""").data.df


@query("""
SELECT c_name AS id FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)
AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1993-01-01')""")
def sql_subqueries(spark, sf_dir):
    return h2(spark, sf_dir).sql("""
        SELECT id FROM data d WHERE EXISTS (SELECT 1 FROM level1 o WHERE o."internal:parent_id" = d."internal:current_id" AND o_totalprice > 200000)
        AND d."internal:current_id" NOT IN (SELECT "internal:parent_id" FROM level1 WHERE "istac:time_start" < DATE '1993-01-01')""").current


# --- time and space --------------------------------------------------------------


@query("SELECT 'e' || event_id AS id, event_type, value FROM events WHERE CAST(ts AS DATE) BETWEEN (SELECT CAST(min(ts) AS DATE) + 1 FROM events) AND (SELECT CAST(min(ts) AS DATE) + 3 FROM events)")
def datetime_range_l0(spark, sf_dir):
    first = read(spark, sf_dir, "events").agg(F.min("ts").cast("date").alias("d")).select(F.date_add("d", 1).cast("string").alias("a"), F.date_add("d", 3).cast("string").alias("b")).first()
    return h4(spark, sf_dir).filter_datetime(f"{first['a']}T12:00:00Z/{first['b']}").current.select(C.ID, "event_type", "value")


@query("SELECT 'o' || o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-01-17'")
def datetime_point_l0(spark, sf_dir):
    d = h2(spark, sf_dir)
    return d.replace(current=d.levels[1]).filter_datetime("1995-01-17").current.select(C.ID)


@query("SELECT 'o' || o_orderkey AS id FROM orders WHERE TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'no date' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || 'T10:00:00' END AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-01-31'")
def datetime_string_col(spark, sf_dir):
    d = h2(spark, sf_dir)
    text = F.when(q(C.CURRENT_ID) % 3 == 0, "no date").otherwise(F.concat(q("istac:time_start").cast("date").cast("string"), F.lit("T10:00:00")))
    return d.replace(current=d.levels[1].withColumn("istac:time_start", text)).filter_datetime("1995-01-01/1995-01-31").current.select(C.ID)


BOX = (-30.0, -20.0, 60.0, 45.0)
_IN_BOX = f"{LON_SQL} BETWEEN -30 AND 60 AND {LAT_SQL} BETWEEN -20 AND 45"
SMALL = (-3.0, -2.0, 6.0, 4.5)
_IN_SMALL = f"{LON_SQL} BETWEEN -3 AND 6 AND {LAT_SQL} BETWEEN -2 AND 4.5"


@query(f"SELECT c_name AS id FROM customer WHERE {_IN_BOX.format(k='c_custkey')}")
def bbox_l0(spark, sf_dir):
    return spatial_h2(spark, sf_dir).filter_bbox(*BOX).current.select(C.ID)


@query(f"SELECT c_name AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {_IN_SMALL.format(k='o_orderkey')})")
def bbox_cascade_l1(spark, sf_dir):
    return spatial_h2(spark, sf_dir).filter_bbox(*SMALL, level=1).current.select(C.ID)


@query(f"SELECT c_name AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {_IN_SMALL.format(k='(l_orderkey * 10 + l_linenumber)')})")
def bbox_cascade_l2(spark, sf_dir):
    return spatial_h2(spark, sf_dir).filter_bbox(*SMALL, level=2).current.select(C.ID)


@query(f"SELECT c_name AS id FROM customer WHERE {LON_SQL.format(k='c_custkey')} BETWEEN -31 AND 61 AND {LAT_SQL.format(k='c_custkey')} BETWEEN -21 AND 46")
def bbox_polygons(spark, sf_dir):
    """Boxes of two degrees that meet the box, not points in it."""
    d = h2(spark, sf_dir)
    rows = _points(d.levels[0], f"`{C.CURRENT_ID}`", boxes=True)
    return d.replace(levels={**d.levels, 0: rows}, current=rows).filter_bbox(*BOX).current.select(C.ID)


# --- cascades ----------------------------------------------------------------------

_JANUARY = "CAST({} AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-01-10'"


@query(f"SELECT DISTINCT c_name AS id, c_acctbal FROM customer JOIN orders ON o_custkey = c_custkey WHERE {_JANUARY.format('o_orderdate')}")
def cascade_datetime_l1(spark, sf_dir):
    return h2(spark, sf_dir).filter_datetime("1995-01-01/1995-01-10", level=1).current.select(C.ID, "c_acctbal")


@query(f"SELECT DISTINCT c_name AS id, c_acctbal FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE {_JANUARY.format('l_shipdate')}")
def cascade_datetime_l2(spark, sf_dir):
    return h2(spark, sf_dir).filter_datetime("1995-01-01/1995-01-10", level=2).current.select(C.ID, "c_acctbal")


@query(f"SELECT DISTINCT 'c' || o_custkey AS id, 'part' || (o_custkey % 3) AS source FROM orders WHERE {_JANUARY.format('o_orderdate')}")
def cascade_composite_key(spark, sf_dir):
    return h3(spark, sf_dir).filter_datetime("1995-01-01/1995-01-10", level=1).current.select(C.ID, q(C.SOURCE_FILE).alias("source"))


@query(f"SELECT DISTINCT c_name AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND {_JANUARY.format('o_orderdate')}")
def cascade_after_sql(spark, sf_dir):
    return h2(spark, sf_dir).sql("SELECT * FROM data WHERE c_mktsegment = 'BUILDING'").filter_datetime("1995-01-01/1995-01-10", level=1).current.select(C.ID)


@query(f"SELECT 'o' || o_orderkey AS id, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE {_JANUARY.format('o_orderdate')} AND c_acctbal > 0")
def cascade_children(spark, sf_dir):
    d = h2(spark, sf_dir).sql("SELECT * FROM data WHERE c_acctbal > 0").filter_datetime("1995-01-01/1995-01-10", level=1)
    return d.data_raw.children().df.select(C.ID, "o_totalprice")


@query(f"""
SELECT DISTINCT c_name AS id FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-03-31' AND {_JANUARY.format('l_shipdate')}""")
def cascade_twice(spark, sf_dir):
    return h2(spark, sf_dir).filter_datetime("1995-01-01/1995-03-31", level=1).filter_datetime("1995-01-01/1995-01-10", level=2).current.select(C.ID)


# --- homogeneity ---------------------------------------------------------------------


@query("SELECT r_regionkey AS parent, string_agg(n_name, '|' ORDER BY n_name) AS signature FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def rsut_signature(spark, sf_dir):
    d = h1(spark, sf_dir)
    return homogeneity.child_signatures(d.levels[0], d.levels[1]).select(q(C.CURRENT_ID).alias("parent"), "signature")


@query("SELECT count(DISTINCT s) <= 1 AS homogeneous FROM (SELECT string_agg(n_name, '|' ORDER BY n_name) AS s FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey)")
def rsut_flag(spark, sf_dir):
    return spark.createDataFrame([(h1(spark, sf_dir).verify_rsut(),)], "homogeneous boolean")


@query(f"""
WITH o AS (SELECT * FROM orders WHERE {_JANUARY.format('o_orderdate')}),
s AS (SELECT o_custkey, string_agg('o' || o_orderkey, '|' ORDER BY 'o' || o_orderkey) AS s FROM o GROUP BY o_custkey)
SELECT count(DISTINCT s) = 1 AS homogeneous FROM s""")
def cascade_rsut(spark, sf_dir):
    return spark.createDataFrame([(h2(spark, sf_dir).filter_datetime("1995-01-01/1995-01-10", level=1).is_rsut(),)], "homogeneous boolean")


# --- statistics ------------------------------------------------------------------------


def _cells(rows: DataFrame, key: str) -> DataFrame:
    """One row per key with the nine statistics of quantity and price, and a shape of as many pixels as rows.

    Rows are shuffled once, by key. Percentiles are interpolated between the
    two values beside their place in the order of a window, where nulls come
    last, so no list or map of a group's values is held in an aggregate.
    """
    columns = ("l_quantity", "l_extendedprice")
    rows = rows.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).repartition(key)
    whole = Window.partitionBy(key)
    for c in columns:
        rows = rows.withColumn(f"{c}_place", F.row_number().over(whole.orderBy(F.col(c).asc_nulls_last())) - 1)
        rows = rows.withColumn(f"{c}_n", F.count(c).over(whole))

    def cell(c: str):
        def at(p: float):
            place = (F.col(f"{c}_n") - 1) * F.lit(p)
            near = F.lit(1.0) - F.abs(F.col(f"{c}_place") - place)  # share of the value in the percentile
            low, high = (F.max(F.when(F.col(f"{c}_place") == f(place), F.col(c))) for f in (F.floor, F.ceil))
            share = F.max(F.when(F.col(f"{c}_place") == F.floor(place), near))
            return F.when(low == high, low).otherwise(share * low + (1 - share) * high)

        return F.array(*(x.cast("float") for x in (F.min(c), F.max(c), F.avg(c), F.coalesce(F.stddev_samp(c), F.lit(0.0)), F.lit(100.0), at(0.25), at(0.5), at(0.75), at(0.95))))

    made = rows.groupBy(key).agg(F.array(*map(cell, columns)).alias(C.STATS_COLUMNS[0]), F.count("*").alias("__n"))
    return made.withColumn(C.SHAPE_COLUMN, F.array(F.lit(2).cast("long"), F.col("__n"), F.lit(1).cast("long"))).drop("__n")


def _order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of orders with their customers, which are null where ``orders`` lacks the order; cells are not shuffled for it."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return _cells(read(spark, sf_dir, "lineitem"), "l_orderkey").join(orders, "l_orderkey", "left")


def stats_tree(spark: SparkSession, sf_dir: str) -> Dataset:
    cells = stored(spark, sf_dir, "cells", lambda: _order_cells(spark, sf_dir))
    rows = cells.select(*_node(C.FILE, "concat('o', l_orderkey)", "l_orderkey", "o_custkey"), q(C.STATS_COLUMNS[0]), q(C.SHAPE_COLUMN))
    top = read(spark, sf_dir, "customer").select(*_node(C.FOLDER, "c_name", "c_custkey"))
    return from_levels(spark, _document(C.FOLDER, [C.FILE]), {0: top, 1: rows}, C.PLAIN, "/s", "/s")


_CELLS_SQL = """
WITH o AS (
  SELECT l_orderkey, b AS band, count(*) AS w, CAST(CAST(min(x) AS FLOAT) AS DOUBLE) AS mn, CAST(CAST(max(x) AS FLOAT) AS DOUBLE) AS mx,
         CAST(CAST(avg(x) AS FLOAT) AS DOUBLE) AS m, CAST(CAST(coalesce(stddev_samp(x), 0) AS FLOAT) AS DOUBLE) AS s,
         CAST(CAST(quantile_cont(x, 0.25) AS FLOAT) AS DOUBLE) AS p25, CAST(CAST(quantile_cont(x, 0.5) AS FLOAT) AS DOUBLE) AS p50,
         CAST(CAST(quantile_cont(x, 0.75) AS FLOAT) AS DOUBLE) AS p75, CAST(CAST(quantile_cont(x, 0.95) AS FLOAT) AS DOUBLE) AS p95
  FROM (SELECT l_orderkey, 0 AS b, CAST(l_quantity AS DOUBLE) AS x FROM lineitem UNION ALL SELECT l_orderkey, 1, CAST(l_extendedprice AS DOUBLE) FROM lineitem)
  GROUP BY l_orderkey, b)
"""
_AGGREGATES_SQL = {
    "min": "min(mn)", "max": "max(mx)", "mean": "sum(w * m) / sum(w)",
    "std": "sqrt((sum((w - 1) * s * s) + sum(w * m * m) - sum(w * m) * sum(w * m) / sum(w)) / (sum(w) - 1))",
    "p25": "avg(p25)", "p50": "avg(p50)", "p75": "avg(p75)", "p95": "avg(p95)",
}


def _stats_query(what: str):
    def run(spark, sf_dir):
        return stats.continuous(stats_tree(spark, sf_dir).levels[1], what).select("band", F.round("value", 3).alias("value"))

    run.__name__ = f"stats_{what}"
    return run


for _what, _sql in _AGGREGATES_SQL.items():
    query(f"{_CELLS_SQL} SELECT band, round({_sql}, 3) AS value FROM o GROUP BY band")(_stats_query(_what))


@query(f"{_CELLS_SQL} SELECT band, round(avg(p50), 3) AS value FROM o GROUP BY band")
def stats_median(spark, sf_dir):
    """The method's own name for the 50th percentile, all bands in one list."""
    d = stats_tree(spark, sf_dir)
    found = d.replace(current=d.levels[1]).stats_median([0, 1])
    return spark.createDataFrame([(n, round(float(v), 3)) for n, v in enumerate(found)], "band int, value double").withColumn("value", F.round("value", 3))


@query(f"{_CELLS_SQL} SELECT 1 - band AS place, min(mn) AS value FROM o GROUP BY band")
def stats_band_order(spark, sf_dir):
    """Bands in the order they are asked for."""
    d = stats_tree(spark, sf_dir)
    found = d.replace(current=d.levels[1]).stats_min([1, 0])
    return spark.createDataFrame([(n, float(v)) for n, v in enumerate(found)], "place int, value double")


@query(f"""{_CELLS_SQL} SELECT band, round(sum(w * m) / sum(w), 3) AS value FROM o JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey WHERE c_name = (SELECT min(c_name) FROM customer) GROUP BY band""")
def stats_by_parent(spark, sf_dir):
    first = read(spark, sf_dir, "customer").agg(F.min("c_name")).first()[0]
    return stats.continuous(stats_tree(spark, sf_dir).stats_frame(1, id=first), "mean").select("band", F.round("value", 3).alias("value"))


def _class_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").withColumn(C.STATS_COLUMNS[0], F.array("embedding"))
    return rows.withColumn(C.SHAPE_COLUMN, F.array(F.lit(1).cast("long"), (F.col("label") + 1).cast("long"), F.lit(1).cast("long")))


@query("""
SELECT 0 AS band, i AS class, round(sum((label + 1) * CAST(embedding[i + 1] AS DOUBLE)) / sum(label + 1), 6) AS value
FROM embeddings, (SELECT unnest(range(0, 64)) AS i) GROUP BY i""")
def stats_weighted_bands(spark, sf_dir):
    return stats.categorical(_class_cells(spark, sf_dir)).select("band", "class", F.round("value", 6).alias("value"))


@query("""
SELECT 0 AS band, i AS class, round(sum((label + 1) * CAST(embedding[i + 1] AS DOUBLE)) / sum(label + 1), 6) AS value
FROM embeddings, (SELECT unnest(range(0, 64)) AS i) WHERE label > 1 GROUP BY i""")
def stats_null_filter(spark, sf_dir):
    cell = C.STATS_COLUMNS[0]
    rows = _class_cells(spark, sf_dir)
    empty = F.array().cast(rows.schema[cell].dataType)
    rows = rows.withColumn(cell, F.when(F.col("label") > 1, q(cell)).when(F.col("label") == 1, empty))
    return stats.categorical(rows).select("band", "class", F.round("value", 6).alias("value"))


# --- concat ------------------------------------------------------------------------------


def _halves(spark: SparkSession, sf_dir: str) -> tuple[Dataset, Dataset]:
    """H2 twice, under two roots; the second has a column more at the root."""
    a, b = h2(spark, sf_dir), h2(spark, sf_dir).replace(path="/h2b", root="/h2b")
    levels = {**b.levels, 0: b.levels[0].withColumn("extra", F.lit("b"))}
    return a.sql("SELECT * FROM data WHERE c_mktsegment = 'BUILDING'"), b.replace(levels=levels, current=levels[0]).sql("SELECT * FROM data WHERE c_mktsegment = 'MACHINERY'")


_HALVES_SQL = """
SELECT {} FROM (SELECT *, '/h2' AS source, CAST(NULL AS VARCHAR) AS extra FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT *, '/h2b', 'b' FROM customer WHERE c_mktsegment = 'MACHINERY')"""


@query(_HALVES_SQL.format("c_name AS id, c_acctbal, source, source || '/DATA/' || c_name || '/__meta__' AS pointer"))
def concat_intersection(spark, sf_dir):
    d = concat(_halves(spark, sf_dir))
    assert "extra" not in d.current.columns
    return d.current.select(C.ID, "c_acctbal", q(C.SOURCE_PATH).alias("source"), q(C.GDAL_VSI).alias("pointer"))


@query(_HALVES_SQL.format("c_name AS id, extra, source"))
def concat_fill_missing(spark, sf_dir):
    return concat(_halves(spark, sf_dir), "fill_missing").current.select(C.ID, "extra", q(C.SOURCE_PATH).alias("source"))


@query(f"SELECT DISTINCT c_name AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND {_JANUARY.format('o_orderdate')}")
def concat_prefiltered(spark, sf_dir):
    return concat(_halves(spark, sf_dir)).filter_datetime("1995-01-01/1995-01-10", level=1).current.select(C.ID)


@query("""
SELECT 'o' || o_orderkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN '/h2' ELSE '/h2b' END AS source
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def concat_children(spark, sf_dir):
    return concat(_halves(spark, sf_dir)).levels[1].select(C.ID, q(C.SOURCE_PATH).alias("source"))


@query("SELECT CAST(2 * (SELECT count(*) FROM region) AS BIGINT) AS root, CAST(2 * (SELECT count(*) FROM nation) AS BIGINT) AS below")
def schema_merge_counts(spark, sf_dir):
    d = h1(spark, sf_dir)
    tree = d.schema.to_dict()
    tree["root"]["n"] = d.levels[0].count()
    tree["hierarchy"]["1"][0]["n"] = d.levels[1].count()
    both = type(d.schema).from_dict(tree) + type(d.schema).from_dict(tree)
    return spark.createDataFrame([(both.root["n"], both.hierarchy["1"][0]["n"])], "root long, below long")


# --- frames --------------------------------------------------------------------------------


@query("SELECT n_name AS id FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def navigate_by_id(spark, sf_dir):
    return h1(spark, sf_dir).data_raw.read("ASIA").df.select(C.ID)


@query("SELECT c_name AS id, c_acctbal FROM customer WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region ORDER BY r_regionkey LIMIT 1 OFFSET 2) ORDER BY n_nationkey LIMIT 1 OFFSET 1)")
def navigate_by_position(spark, sf_dir):
    return h1(spark, sf_dir).data_raw.read(2).read(1).df.select(C.ID, "c_acctbal")


@query("SELECT c_name AS id FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name LIKE 'A%'")
def bulk_children(spark, sf_dir):
    return h1(spark, sf_dir).data_raw.filter("id LIKE 'A%'").children().children().df.select(C.ID)


@query("SELECT 'o' || o_orderkey AS id, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def frame_head(spark, sf_dir):
    d = h2(spark, sf_dir)
    return d.replace(current=d.levels[1]).data.head().select(C.ID, "o_totalprice")


@query("SELECT 'o' || o_orderkey AS id, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def frame_tail(spark, sf_dir):
    d = h2(spark, sf_dir)
    return d.replace(current=d.levels[1]).data.tail().select(C.ID, "o_totalprice")


@query("SELECT c_name AS id, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def frame_sort_limit(spark, sf_dir):
    return h2(spark, sf_dir).data.sort(F.desc("c_acctbal")).limit(10).df.select(C.ID, "c_acctbal")


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment")
def frame_group_by(spark, sf_dir):
    return h2(spark, sf_dir).data.group_by("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT c_name AS id, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal < 0")
def frame_filter_with_columns(spark, sf_dir):
    return h2(spark, sf_dir).data.filter("c_acctbal < 0").with_columns(twice=F.col("c_acctbal") * 2).df.select(C.ID, "twice")


@query("SELECT 'o' || o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders")
def frame_positions(spark, sf_dir):
    d = h2(spark, sf_dir)
    return d.replace(current=d.levels[1]).data.with_position().select(C.ID, "position")


# --- catalogs on disk -----------------------------------------------------------------------


@query("""
SELECT 'o' || o_orderkey AS id, o_totalprice, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000""")
def scan_folder(spark, sf_dir):
    """A selection written as a folder catalog, loaded again, joined by SQL."""
    d = h2(spark, sf_dir).sql("SELECT * FROM data WHERE c_mktsegment = 'BUILDING'")
    again = load(d.write(files.scratch(spark, "folder")), spark=spark)
    return again.sql("""SELECT o.id, o_totalprice, c_mktsegment FROM data d JOIN level1 o ON o."internal:parent_id" = d."internal:current_id" WHERE o_totalprice > 100000""").current


@query(f"SELECT 'o' || o_orderkey AS id, 'part' || (o_custkey % 3) AS source, '/vsisubfile/200_10,s3://bucket/x/part' || (o_custkey % 3) AS pointer FROM orders WHERE {_JANUARY.format('o_orderdate')}")
def scan_consolidated(spark, sf_dir):
    """A cascade's selection written as a consolidated catalog and loaded with another base path."""
    d = h3(spark, sf_dir).filter_datetime("1995-01-01/1995-01-10", level=1)
    again = load(d.write(files.scratch(spark, "parts")), base_path="s3://bucket/x", spark=spark)
    pointer = F.replace(q(C.GDAL_VSI), F.lit("/vsis3/"), F.lit("s3://"))
    return again.levels[1].select(C.ID, q(C.SOURCE_FILE).alias("source"), pointer.alias("pointer"))


@query("""
SELECT 'o' || o_orderkey AS id, o_totalprice, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_totalprice > 150000 GROUP BY o_orderkey, o_totalprice""")
def scan_archive(spark, sf_dir):
    """Orders and line items in one archive, read by row groups and byte ranges, with the columns that are named."""
    place = [F.lit(0).cast("long").alias(C.OFFSET), F.lit(1).cast("long").alias(C.SIZE)]
    orders = read(spark, sf_dir, "orders").select(*_node(C.FOLDER, "concat('o', o_orderkey)", "o_orderkey"), *place, "o_totalprice", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").select(*_node(C.FILE, "concat('l', l_orderkey, '_', l_linenumber)", "l_orderkey * 10 + l_linenumber", "l_orderkey"), *place, "l_linenumber", "l_quantity", "l_shipdate")
    path = write_archive(spark, files.scratch(spark, "archive") + ".zip", [orders, lines], _document(C.FOLDER, [C.FILE]), row_group=1 << 20)
    d = load(path, spark=spark, columns={0: ["o_totalprice"], 1: ["l_linenumber"]})
    return d.sql("""
        SELECT o.id, o_totalprice, count(*) AS n, sum(l_linenumber) AS total FROM data o JOIN level1 l ON l."internal:parent_id" = o."internal:current_id"
        WHERE o_totalprice > 150000 GROUP BY o.id, o."internal:current_id", o_totalprice""").current


@query("SELECT n_name AS id, CAST(n_regionkey AS INTEGER) AS region, CAST(3 * length(n_name) AS INTEGER) AS size FROM nation ORDER BY n_name")
def v1_load(spark, sf_dir):
    """Nations in one first-generation container for each region, loaded together; an unreadable file is left out."""
    nations = read(spark, sf_dir, "nation").select("n_name", "n_regionkey", (3 * F.length("n_name")).alias("size")).orderBy("n_nationkey").toPandas()
    paths = []
    for region, rows in nations.groupby("n_regionkey"):
        footer = pa.table({NAME: rows["n_name"], KIND: ["BYTES"] * len(rows), OFFSET: np.cumsum(rows["size"]).to_numpy() - rows["size"].to_numpy() + 200, LENGTH: rows["size"].astype("int64"), "region": [int(region)] * len(rows)})
        raw, at = io.BytesIO(), 200 + int(rows["size"].sum())
        pq.write_table(footer, raw)
        body = (BARE + struct.pack("<QQ", at, len(raw.getvalue()))).ljust(at, b"\0") + raw.getvalue()
        paths.append(files.scratch(spark, "container") + ".tortilla")
        files.write(spark, paths[-1], body)
    paths.append(files.scratch(spark, "broken") + ".tortilla")
    files.write(spark, paths[-1], b"nothing of the kind, at some length")
    found = load_containers(paths, spark)
    return found.select(q(NAME).alias("id"), F.col("region").cast("int").alias("region"), subfile_parts(q(POINTER))[2].cast("int").alias("size"))


@query("SELECT 'o' || o_orderkey AS id, 'ValueError: odd' AS error FROM orders WHERE o_orderkey % 100 = 7")
def v1_sanity_check(spark, sf_dir):
    """A user's function over every pointer, in tasks."""
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias(NAME), F.col("o_orderkey").cast("string").alias(POINTER))

    def check(pointer: str) -> None:
        if int(pointer) % 100 == 7:
            raise ValueError("odd")

    return sanity_check(rows, check)


# --- metadata, checks, flags -------------------------------------------------------------------


def _values(columns: str, rows: list[tuple]) -> str:
    said = lambda v: "true" if v is True else "false" if v is False else f"'{v}'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) AS t({columns})"


_NAVIGATION = [("folder", c) for c in ("id", "internal:current_id", "type")] + [("parts", c) for c in ("id", "internal:current_id", "internal:offset", "internal:size", "internal:source_file", "type")]


@query(_values("layout, name", _NAVIGATION))
def navigation_columns(spark, sf_dir):
    made = {"folder": h2(spark, sf_dir), "parts": h3(spark, sf_dir)}
    return spark.createDataFrame([(k, c) for k, d in made.items() for c in d.navigation_columns()], "layout string, name string")


@query(_values("level, name", [("0", c) for c in ("id", "type", "internal:current_id", "internal:gdal_vsi")] + [("1", c) for c in ("id", "type", "internal:current_id", "internal:parent_id", "internal:gdal_vsi")] + [("2", c) for c in ("id", "type", "internal:current_id", "internal:parent_id", "internal:gdal_vsi", "c_acctbal", "c_mktsegment")]))
def level_columns(spark, sf_dir):
    d = h1(spark, sf_dir)
    return spark.createDataFrame([(str(n), c) for n in range(d.max_depth + 1) for c in d.columns(n)], "level string, name string")


@query("SELECT n_name AS id FROM nation WHERE n_nationkey % 5 <> 0")
def display_padding(spark, sf_dir):
    """Rows with the padding mark anywhere in the id are not shown."""
    d = h1(spark, sf_dir)
    named = F.when(q(C.CURRENT_ID) % 5 == 0, F.concat(F.lit("x"), F.lit(C.PADDING_PREFIX), q(C.ID))).otherwise(q(C.ID))
    return d.replace(current=d.levels[1].withColumn(C.ID, named)).data.without_padding().df.select(C.ID)


_FLAGS = {"loaded": True, "filtered by sql": True, "sql without a navigation column": False, "sql over a deeper level": False, "sub-query over a deeper level": False, "date filter at the root": True, "root filter after a deeper level": False}


@query(_values('"case", homogeneous', list(_FLAGS.items())))
def rsut_flags(spark, sf_dir):
    d = h2(spark, sf_dir)
    joined = d.sql("""SELECT d.* FROM data d JOIN level1 o ON o."internal:parent_id" = d."internal:current_id" """)
    made = [
        d, d.sql("SELECT * FROM data WHERE c_acctbal > 0"), d.sql("SELECT id, c_acctbal FROM data"), joined,
        d.sql("""SELECT * FROM data WHERE "internal:current_id" IN (SELECT "internal:parent_id" FROM level1)"""),
        h4(spark, sf_dir).filter_datetime("2024-01-01/2024-12-31"), joined.sql("SELECT * FROM data"),
    ]
    return spark.createDataFrame([(k, x.is_rsut()) for k, x in zip(_FLAGS, made)], "case string, homogeneous boolean")


@query(_values('"case", levels', [("none", ""), ("join", "1"), ("sub-query", "2"), ("cascade", "1,2"), ("join then cascade", "1,2")]))
def joined_levels(spark, sf_dir):
    d = h2(spark, sf_dir)
    join = d.sql("""SELECT d.* FROM data d JOIN level1 o ON o."internal:parent_id" = d."internal:current_id" """)
    deep = """SELECT * FROM data WHERE EXISTS (SELECT 1 FROM level2 WHERE l_quantity > 49)"""
    made = {"none": d, "join": join, "sub-query": d.sql(deep), "cascade": d.filter_datetime("1995-01-01/1995-01-10", level=2), "join then cascade": join.filter_datetime("1995-01-01/1995-01-10", level=2)}
    return spark.createDataFrame([(k, ",".join(map(str, sorted(x.joined)))) for k, x in made.items()], "case string, levels string")


_RAISED = [
    ("band out of range", "QueryError"), ("box level too deep", "QueryError"), ("concat of one", "QueryError"), ("concat of other trees", "SchemaError"), ("concat without a critical column", "SchemaError"),
    ("categories as numbers", "QueryError"), ("date level too deep", "QueryError"), ("mixed cells", "QueryError"), ("no statistics column", "QueryError"), ("parent not named", "QueryError"), ("strict columns", "SchemaError"), ("unknown column mode", "QueryError"),
]


@query(_values('"case", error', _RAISED))
def checks_raise(spark, sf_dir):
    """What each misuse raises."""
    two, one, cells = h2(spark, sf_dir), h1(spark, sf_dir), stats_tree(spark, sf_dir)
    extra = two.replace(current=two.current.withColumn("extra", F.lit(1)))
    shares = spark.createDataFrame([([[0.5, 0.5]],), ([[0.2, 0.3, 0.5]],), ([[0.0] * 9],)], f"`{C.STATS_COLUMNS[0]}` array<array<float>>")
    made = {
        "band out of range": lambda: stats.pick(np.zeros(2), 2), "box level too deep": lambda: spatial_h2(spark, sf_dir).filter_bbox(0, 0, 1, 1, level=3),
        "concat of one": lambda: concat([two]), "concat of other trees": lambda: concat([two, h4(spark, sf_dir)]), "concat without a critical column": lambda: concat([two, two.replace(current=two.current.drop(C.TYPE))]),
        "categories as numbers": lambda: stats.check_kind(shares.limit(1), True), "date level too deep": lambda: two.filter_datetime("1995-01-01", level=3), "mixed cells": lambda: stats.check_kind(shares, False),
        "no statistics column": lambda: two.stats_mean(0), "parent not named": lambda: cells.stats_mean(0, level=1), "strict columns": lambda: concat([two, extra], "strict"), "unknown column mode": lambda: concat([one, one], "x"),
    }
    found = []
    for case, call in made.items():
        try:
            call()
            found.append((case, "none"))
        except TreecatError as e:
            found.append((case, type(e).__name__))
    return spark.createDataFrame(found, "case string, error string")


# --- byte ranges and legacy ------------------------------------------------------------------


@query("""
SELECT o_orderkey, CAST(coalesce(sum(o_orderkey % 97) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 200 AS BIGINT) AS new_offset
FROM orders""")
def v1_running_offset(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 97).alias("len"))
    return running_offset(rows, "o_orderkey", "len", partition=["o_custkey"]).select("o_orderkey", "new_offset")


@query("""
WITH e AS (SELECT l_orderkey AS archive, l_linenumber AS entry, CAST(l_linenumber * 6000000 + l_partkey AS BIGINT) AS place, CAST(l_quantity AS BIGINT) % 7 * 1000000 AS size FROM lineitem),
g AS (SELECT *, place - lag(place + size) OVER w AS gap, size + lag(size) OVER w AS useful FROM e WHERE size > 0 WINDOW w AS (PARTITION BY archive ORDER BY entry, place, size)),
s AS (SELECT *, CASE WHEN gap < 4194304 AND gap <= 0.5 * useful THEN 0 ELSE 1 END AS starts FROM g)
SELECT archive, entry, CAST(sum(starts) OVER (PARTITION BY archive ORDER BY entry, place, size ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS range_group FROM s""")
def range_groups(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("archive"), F.col("l_linenumber").alias("entry"),
        (F.col("l_linenumber") * 6000000 + F.col("l_partkey")).cast("long").alias("offset"), (F.col("l_quantity").cast("long") % 7 * 1000000).alias("size"),
    )
    return coalesce_ranges(rows, ["archive"]).select("archive", "entry", F.col("range_group").cast("long").alias("range_group"))


@query(f"SELECT c_custkey, round({LON_SQL.format(k='c_custkey')}, 2) AS lon, round({LAT_SQL.format(k='c_custkey')}, 2) AS lat FROM customer")
def wkt_points(spark, sf_dir):
    lon, lat = (F.round(F.expr(x.format(k="c_custkey", u="100D")), 2) for x in (LON, LAT))
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")).alias("wkt"))
    x, y = points(F.col("wkt"))
    return rows.select("c_custkey", x.alias("lon"), y.alias("lat"))
