"""Column expressions shared by the reports (JVM-side, codegen friendly)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Relative standard deviation of the HyperLogLog++ sketch used when exact=False.
APPROX_RSD = 0.05


def distinct_count(col: str, exact: bool = True) -> Column:
    """Exact ``count(distinct col)``, or with ``exact=False`` a HyperLogLog++ estimate.

    Exact distinct counts make Catalyst expand every row once per distinct column and shuffle
    on (group, value); the sketch keeps one fixed-size buffer per group and is fully
    map-side combinable, the cheaper choice for dashboards over very large ranges.
    """
    return F.count_distinct(col) if exact else F.approx_count_distinct(col, APPROX_RSD)


def impressions(exact: bool = True) -> Column:
    """``imp``: number of distinct impressions."""
    return distinct_count("impression_id", exact)


def clicks() -> Column:
    """``clk``: clicks, 0 when the group has none."""
    return F.coalesce(F.sum("clicked"), F.lit(0)).cast("long")


def unique_users(exact: bool = True) -> Column:
    return distinct_count("user_id", exact)


def unique_news(exact: bool = True) -> Column:
    return distinct_count("news_id", exact)


def avg_dwell() -> Column:
    """``dw``: mean dwell time over all rows (unclicked rows count with dwell 0); 0 if none."""
    return F.coalesce(F.avg("dwell_time"), F.lit(0.0))


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / max(den, 1)`` as a double: never raises on an empty group under ANSI mode."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return num.cast("double") / F.greatest(den, F.lit(1)).cast("double")


def engagement_score(clk: Column | str, dw: Column | str, imp: Column | str) -> Column:
    """``(clicks * 2 + avg_dwell / 30) / max(impressions, 1)``."""
    clk = F.col(clk) if isinstance(clk, str) else clk
    dw = F.col(dw) if isinstance(dw, str) else dw
    return ratio(clk * 2 + dw / 30.0, imp)


def ts_literal(df: DataFrame, column: str, value: dt.datetime | dt.date | str) -> Column:
    """A timestamp literal typed like ``df[column]``.

    Comparing a column with a literal of its own type keeps the predicate a plain
    column-vs-constant comparison, which Catalyst pushes into the parquet scan (a mixed
    TIMESTAMP / TIMESTAMP_NTZ comparison would wrap the column in a cast instead).
    """
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast(df.schema[column].dataType)


PARTITION_COLUMN = "_part"


def _partition_bound(value: dt.datetime | dt.date | str) -> Column:
    """The bound as a time-partition value: ``yyyy-MM-dd-HH`` cut to the partition's own length,
    so it works for hour, day, month or year partitions."""
    day = F.lit(as_datetime(value).strftime("%Y-%m-%d-%H"))
    return day.substr(F.lit(1), F.length(_partition_text()))


def _partition_text() -> Column:
    """The partition value as text (Spark may have inferred a DATE type for day folders)."""
    return F.col(PARTITION_COLUMN).cast("string")


def between_inclusive(
    df: DataFrame,
    column: str,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
) -> DataFrame:
    """Optional closed range ``start <= column <= end``; either bound may be omitted.

    On a stored exposure table (time-partitioned, partition column ``_part``) the same range
    is also stated on the partition column, which Spark evaluates against the partition
    values at planning time: folders outside the range are never listed or read.
    """
    pruned = column in ("timestamp", "window_start", "pane") and PARTITION_COLUMN in df.columns
    if start is not None:
        df = df.where(F.col(column) >= ts_literal(df, column, start))
        if pruned:
            df = df.where(_partition_text() >= _partition_bound(start))
    if end is not None:
        df = df.where(F.col(column) <= ts_literal(df, column, end))
        if pruned:
            df = df.where(_partition_text() <= _partition_bound(end))
    return df


def trunc_like(unit: str, column: str, df: DataFrame) -> Column:
    """``date_trunc(unit, column)`` cast back to the column's own timestamp type."""
    return F.date_trunc(unit, F.col(column)).cast(df.schema[column].dataType)


# Accepted text formats of event times besides ISO-8601 (tried in this order; fixed values).
TIME_FORMATS = ("M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy")


def parse_time(c: Column | str) -> Column:
    """Text → TIMESTAMP: ISO-8601 first, then the US-style formats above; NULL when none fits
    (never fails the job, unlike an ANSI cast)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(c, F.lit(f)) for f in TIME_FORMATS])


def as_datetime(value: dt.datetime | dt.date | str) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(value)
