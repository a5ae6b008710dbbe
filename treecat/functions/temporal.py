"""Date filters with day granularity."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import TIME_COLUMNS
from ..errors import QueryError

# Strings that both strict engines read as a date: a day, alone or with a time of day.
_DAY = r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}\s*$|^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}[T ]\d{1,2}:.*$"


def time_column(columns: list[str]) -> str:
    for name in TIME_COLUMNS:
        if name in columns:
            return name
    raise QueryError(f"no time column among {columns}; one of {TIME_COLUMNS} is looked for")


def _moment(value: str | datetime) -> datetime:
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.strip())
        except ValueError as e:
            raise QueryError(f"{value!r} is not an ISO date or time") from e
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


def parse_range(value: str | datetime | tuple) -> tuple[date, date | None]:
    """(first day, last day), or (day, None) for a point.

    Takes ``"a/b"``, ``"a"``, a datetime or a pair of them; what has no zone is UTC.
    """
    if isinstance(value, str) and "/" in value:
        ends = value.split("/")
    elif isinstance(value, (str, datetime)):
        return _moment(value).date(), None
    elif isinstance(value, tuple) and len(value) == 2 and all(isinstance(x, datetime) for x in value):
        ends = value
    else:
        raise QueryError(f"a date is text, a datetime or a pair of datetimes, not {value!r}")
    if len(ends) != 2:
        raise QueryError(f"{value!r} is not a pair of dates")
    first, last = map(_moment, ends)
    if first > last:
        raise QueryError(f"the range starts after its end: {value!r}")
    return first.date(), last.date()


def as_day(df: DataFrame, column: str) -> Column:
    """The day of a date, timestamp or date-like string column; null for what is none."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(_DAY), F.regexp_replace(F.trim(c), "^(\\d{4})/(\\d{1,2})/", "$1-$2-").try_cast("date"))
    return F.lit(None).cast("date")


def in_days(df: DataFrame, column: str, value: str | datetime | tuple) -> Column:
    """Whether the column's day is the given one, or lies in the closed range.

    On timestamps the test is a half-open interval of the column itself, so
    that it reaches the Parquet scan.
    """
    first, last = parse_range(value)
    last = last or first
    if isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType)):
        kind = df.schema[column].dataType.simpleString()
        day = lambda d: F.lit(str(d)).cast("date").cast(kind)
        c = F.col(f"`{column}`")
        return (c >= day(first)) & (c < F.date_add(F.lit(str(last)).cast("date"), 1).cast(kind))
    return as_day(df, column).between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date"))
