"""SQL over a dataset: the query sees ``data`` and ``level0 ... levelN`` as common table expressions."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import ORDER
from ..errors import QueryError

_QUOTES = "spark.sql.ansi.doubleQuotedIdentifiers"
#: The setting belongs to the session: one query at a time is analysed with it.
_analysing = threading.Lock()


def _parsed(spark: SparkSession, query: str) -> str | None:
    """The parser's tree as text; None where there is no JVM to ask."""
    session = getattr(spark, "_jsparkSession", None)
    if session is None:
        return None
    try:
        return session.sessionState().sqlParser().parsePlan(query).treeString()
    except Exception as e:
        raise QueryError(f"the query does not parse: {e}") from e


def relations(spark: SparkSession, query: str) -> set[str]:
    """Lower-case names of the tables a query refers to, sub-queries included."""
    tree = _parsed(spark, query)
    found = re.findall(r"UnresolvedRelation \[([^\],]+)\]", tree) if tree else re.findall(r"\b(?:from|join|,)\s+(\w+)", query, re.I)
    return {x.strip("`").lower() for x in found}


def referenced_levels(spark: SparkSession, query: str) -> frozenset[int]:
    """Levels below the root that a query reads."""
    names = (re.fullmatch(r"level(\d+)", r) for r in relations(spark, query))
    return frozenset(int(m[1]) for m in names if m and int(m[1]))


def run(spark: SparkSession, query: str, tables: dict[str, DataFrame]) -> tuple[DataFrame, frozenset[int]]:
    """The query's lazy result, and the deeper levels it refers to.

    Double quotes hold identifiers, as in ANSI SQL. The names bind inside this
    query alone. A final ORDER BY is kept as a hidden order column.
    """
    with _analysing:
        return _run(spark, query.strip().rstrip(";").strip(), tables)


def _run(spark: SparkSession, query: str, tables: dict[str, DataFrame]) -> tuple[DataFrame, frozenset[int]]:
    was = spark.conf.get(_QUOTES, "false")
    spark.conf.set(_QUOTES, "true")
    views = {name: f"treecat_{uuid.uuid4().hex}" for name in tables}
    try:
        tree = _parsed(spark, query)
        if tree is not None and re.match(r"\s*'?(Create|Drop|Insert|Alter|Truncate|Set|Delete|Update|Merge|Show|Describe|Explain|Use|Cache|Refresh|Repair|Load|Add)\w*", tree):
            raise QueryError("only a SELECT can be run on a dataset")
        for name, view in views.items():
            tables[name].createOrReplaceTempView(view)
        scope = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in views.items())
        found = spark.sql(f"WITH {scope} SELECT * FROM (\n{query}\n)")
        found.schema  # noqa: B018  analysed here, so that errors show now
        if tree is not None and re.match(r"(?:\s*[:+-]*\s*'?(?:GlobalLimit|LocalLimit|Offset|WithCTE|CTE|UnresolvedWith)[^\n]*\n)*\s*[:+-]*\s*'?Sort\b", tree):
            found = found.drop(ORDER).withColumn(ORDER, F.monotonically_increasing_id())
        return found, referenced_levels(spark, query)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
        spark.conf.set(_QUOTES, was)
