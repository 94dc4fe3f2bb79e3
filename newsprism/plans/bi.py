"""Ad-hoc SQL over the keyed tables (U2) and the five example BI questions."""

from __future__ import annotations

import datetime as dt
import json
import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as m

# The statement timeout of ad-hoc SQL, in seconds (fixed value).
TIMEOUT = 60.0

# Functions that leave the engine (they call Java methods) and may not be used.
_OUTSIDE = re.compile(r"\b(reflect|java_method|try_reflect)\s*\(", re.I)


def _strip_literals(sql: str) -> str:
    sql = re.sub(r"--[^\n]*", " ", sql)
    sql = re.sub(r"/\*.*?\*/", " ", sql, flags=re.S)
    sql = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", sql)
    return re.sub(r'"(?:[^"\\]|\\.)*"', '""', sql)


def check_read_only(spark: SparkSession, sql: str, views: dict[str, str]) -> str:
    """The query to run for ``sql`` over ``views`` (name in the statement -> temp view).

    The statement becomes a subquery, and Spark's grammar allows nothing but a query there: commands,
    DML and several statements do not parse. Its parsed plan (``EXPLAIN`` plans, it does not run)
    may name no relation but the given tables and its own CTEs, so no file path and no other
    view; functions that call Java methods are refused first.
    """
    text = sql.strip().rstrip(";").strip()
    if _OUTSIDE.search(_strip_literals(text).replace("`", "")):
        raise ValueError("functions that call Java methods are not allowed")
    named = ", ".join(f"`{name}` AS (SELECT * FROM `{view}`)" for name, view in views.items())
    query = f"{'WITH ' + named if named else ''} SELECT * FROM (\n{text}\n) AS q"
    try:
        plan = spark.sql(f"EXPLAIN EXTENDED {query}").collect()[0]["plan"]
    except Exception as exc:
        raise ValueError(f"only one SELECT query is allowed: {str(exc).splitlines()[0]}") from None
    parsed = plan.split("== Analyzed Logical Plan ==")[0]
    if parsed.strip() == "" or "Exception" in plan.split("\n", 1)[0]:
        raise ValueError("only one SELECT query is allowed")
    own = {n.strip().lower() for names in re.findall(r"CTE \[([^\]]*)\]", parsed) for n in names.split(",")}
    own |= {v.lower() for v in views.values()}
    for name in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", parsed):
        if name.strip().lower() not in own:
            raise ValueError(f"unknown table {name}")
    return query


def run_sql(
    spark: SparkSession, sql: str, tables: dict[str, DataFrame], *, max_rows: int | None = 10
) -> DataFrame:
    """Run a read-only SQL string over the given tables.

    Returns the first ``max_rows`` rows (all rows with ``None``) as a DataFrame. The tables are
    registered under names of their own, so the caller's views of the same names stay.
    """
    views = {name: f"_sql_{uuid.uuid4().hex}" for name in tables}
    for name, view in views.items():
        tables[name].createOrReplaceTempView(view)
    try:
        df = spark.sql(check_read_only(spark, sql, views))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    return df.limit(max_rows) if max_rows is not None else df


def _decoded(value):
    """JSON objects and lists held as text become values."""
    if isinstance(value, str) and value[:1] in "{[" and value[-1:] in "}]":
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def sql_records(
    spark: SparkSession, sql: str, tables: dict[str, DataFrame], *, max_rows: int = 10,
    timeout: float = TIMEOUT,
) -> list[dict]:
    """U2 as the service answers: at most ``max_rows`` rows as dicts, JSON cells decoded; a
    statement that takes longer than ``timeout`` seconds is cancelled (TimeoutError)."""
    df = run_sql(spark, sql, tables, max_rows=max_rows)
    tag = f"sql-{uuid.uuid4().hex}"
    late = threading.Event()

    def cancel():
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout, cancel)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return [{k: _decoded(v) for k, v in row.asDict(recursive=True).items()} for row in df.collect()]
    except Exception:
        if late.is_set():
            raise TimeoutError(f"the statement took longer than {timeout:g} s") from None
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


# --------------------------------------------------------------------------- R24
def popular_last_week(
    exposures: DataFrame, news: DataFrame, *, as_of: dt.datetime | str, days: int = 7, limit: int = 10
) -> DataFrame:
    """Most exposed articles of the last ``days`` before ``as_of``, with headlines."""
    as_of = m.as_datetime(as_of)
    e = m.between_inclusive(exposures, "timestamp", as_of - dt.timedelta(days=days), as_of)
    counts = e.groupBy("news_id").agg(F.count(F.lit(1)).alias("view_count"))
    return (
        counts.join(news.select("news_id", "headline", "category"), "news_id")
        .orderBy(F.col("view_count").desc(), "news_id")
        .limit(limit)
    )


def category_ctr_top(exposures: DataFrame, news: DataFrame, *, limit: int = 3) -> DataFrame:
    """Categories with the highest click-through rate (clicks / exposures)."""
    j = exposures.join(news.select("news_id", "category"), "news_id")
    return (
        j.groupBy("category")
        .agg(F.count(F.lit(1)).alias("exposures"), m.clicks().alias("clicks"))
        .withColumn("ctr", m.ratio("clicks", "exposures"))
        .orderBy(F.col("ctr").desc(), "category")
        .limit(limit)
    )


def trending_in_category(
    exposures: DataFrame, news: DataFrame, *, category: str, as_of: dt.datetime | str,
    days: int = 7, limit: int = 10,
) -> DataFrame:
    """Headlines of one category with the most clicks in the last ``days``."""
    as_of = m.as_datetime(as_of)
    e = m.between_inclusive(exposures, "timestamp", as_of - dt.timedelta(days=days), as_of)
    arts = news.where(F.col("category") == category).select("news_id", "headline")
    return (
        e.join(arts.select("news_id"), "news_id", "left_semi")
        .groupBy("news_id")
        .agg(m.clicks().alias("clicks"), F.count(F.lit(1)).alias("exposures"))
        .join(arts, "news_id")
        .orderBy(F.col("clicks").desc(), F.col("exposures").desc(), "news_id")
        .limit(limit)
    )


def engagement_by_category(exposures: DataFrame, news: DataFrame) -> DataFrame:
    """Per category: exposures, clicks, distinct users, mean dwell and CTR."""
    j = exposures.join(news.select("news_id", "category"), "news_id")
    return (
        j.groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("exposures"),
            m.clicks().alias("clicks"),
            m.unique_users().alias("unique_users"),
            m.avg_dwell().alias("avg_dwell_time"),
        )
        .withColumn("ctr", m.ratio("clicks", "exposures"))
    )


def longest_dwell(exposures: DataFrame, news: DataFrame, *, limit: int = 5) -> DataFrame:
    """Articles with the longest mean dwell time of their clicks."""
    clicked = exposures.where(F.col("clicked") == 1)
    per = clicked.groupBy("news_id").agg(
        F.avg("dwell_time").alias("avg_dwell_time"), F.count(F.lit(1)).alias("clicks")
    )
    return (
        per.join(news.select("news_id", "headline"), "news_id")
        .orderBy(F.col("avg_dwell_time").desc(), "news_id")
        .limit(limit)
    )
