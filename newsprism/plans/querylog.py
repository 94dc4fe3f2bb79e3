"""Query-log analytics (R17–R23) and the timed-run wrapper that feeds the log."""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..session import scratch_dir
from ..functions import metrics as m


def _since(q: DataFrame, as_of, hours) -> DataFrame:
    if as_of is None or hours is None:
        return q
    # on the stored log the bound is stated on the date folders, too
    return m.between_inclusive(q, "timestamp", m.as_datetime(as_of) - dt.timedelta(hours=hours))


def query_performance(q: DataFrame, *, as_of: dt.datetime | str, hours: float = 24) -> DataFrame:
    """Per query type over ``timestamp >= as_of - hours``: count, avg/max/min time,
    failures and success rate in percent. (No upper bound, as in the reference.)"""
    failed = F.coalesce(F.sum((~F.col("success")).cast("int")), F.lit(0)).cast("long")
    return (
        _since(q, as_of, hours)
        .groupBy("query_type")
        .agg(
            F.count("id").alias("total_queries"),
            F.coalesce(F.avg("execution_time"), F.lit(0.0)).alias("avg_execution_time"),
            F.coalesce(F.max("execution_time"), F.lit(0.0)).alias("max_execution_time"),
            F.coalesce(F.min("execution_time"), F.lit(0.0)).alias("min_execution_time"),
            failed.alias("failed_queries"),
        )
        .withColumn(
            "success_rate",
            m.ratio(F.col("total_queries") - F.col("failed_queries"), "total_queries") * 100.0,
        )
    )


def perf_summary(q: DataFrame, *, as_of=None, hours: float | None = None) -> DataFrame:
    """One row: total, mean and max execution time, success rate (fraction), errors."""
    return _since(q, as_of, hours).agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.coalesce(F.avg("execution_time"), F.lit(0.0)).alias("avg_execution_time"),
        F.coalesce(F.max("execution_time"), F.lit(0.0)).alias("max_execution_time"),
        m.ratio(F.count_if(F.col("success")), F.count(F.lit(1))).alias("success_rate"),
        F.count_if(~F.col("success")).alias("error_count"),
    )


def perf_time_series(
    q: DataFrame, *, bucket: str = "1 hour", as_of=None, hours: float | None = None
) -> DataFrame:
    """Per time bucket (epoch-aligned tumbling window) mean execution time and count."""
    return (
        _since(q, as_of, hours)
        .groupBy(F.window("timestamp", bucket).alias("w"))
        .agg(
            F.avg("execution_time").alias("avg_execution_time"),
            F.count(F.lit(1)).alias("query_count"),
        )
        .select(F.col("w.start").alias("bucket_start"), "avg_execution_time", "query_count")
        .orderBy("bucket_start")
    )


def perf_histogram(
    q: DataFrame,
    *,
    width_ms: int = 50,
    edges: list[float] | None = None,
    as_of=None,
    hours=None,
) -> DataFrame:
    """Number of queries per execution-time range ``[range_start_ms, range_end_ms)``.

    Equal ``width_ms`` buckets by default; with ``edges`` (ascending, in ms) the ranges are
    ``[e0, e1), [e1, e2), …, [e_last, ∞)`` (``range_end_ms`` NULL for the last one) and times
    below ``e0`` fall in ``(-∞, e0)`` (``range_start_ms`` NULL).
    """
    ms = F.col("execution_time") * 1000.0
    base = _since(q, as_of, hours).where(F.col("execution_time").isNotNull())
    if edges is None:
        b = F.floor(ms / width_ms).cast("long")
        return (
            base.groupBy((b * width_ms).alias("range_start_ms"))
            .agg(F.count(F.lit(1)).alias("query_count"))
            .withColumn("range_end_ms", F.col("range_start_ms") + width_ms)
            .orderBy("range_start_ms")
        )
    bounds = sorted(float(e) for e in edges)
    start = F.lit(None).cast("double")
    end = F.lit(bounds[0]) if bounds else F.lit(None).cast("double")
    for lo, hi in zip(bounds, bounds[1:] + [None]):
        start = F.when(ms >= lo, F.lit(lo)).otherwise(start)
        end = F.when(ms >= lo, F.lit(hi).cast("double")).otherwise(end)
    return (
        base.groupBy(start.alias("range_start_ms"), end.alias("range_end_ms"))
        .agg(F.count(F.lit(1)).alias("query_count"))
        .orderBy(F.col("range_start_ms").asc_nulls_first())
    )


def perf_status(q: DataFrame, *, as_of=None, hours=None) -> DataFrame:
    """Number of queries per status (``success`` / ``failed``)."""
    status = F.when(F.col("success"), F.lit("success")).otherwise(F.lit("failed"))
    return (
        _since(q, as_of, hours)
        .groupBy(status.alias("status"))
        .agg(F.count(F.lit(1)).alias("query_count"))
    )


def slow_queries(q: DataFrame, *, n: int = 10, as_of=None, hours=None) -> DataFrame:
    """The ``n`` slowest queries (ties by id)."""
    return (
        _since(q, as_of, hours)
        .select("id", "query_type", "execution_time", "timestamp", "success", "error_message")
        .orderBy(F.col("execution_time").desc_nulls_last(), "id")
        .limit(n)
    )


def error_types(q: DataFrame, *, n: int = 10, as_of=None, hours=None) -> DataFrame:
    """Most common error messages of failed queries."""
    return (
        _since(q, as_of, hours)
        .where(~F.col("success"))
        .groupBy("error_message")
        .agg(F.count(F.lit(1)).alias("error_count"))
        .orderBy(F.col("error_count").desc(), F.col("error_message").asc_nulls_last())
        .limit(n)
    )


# --------------------------------------------------------------------------- U3 / K3
def _jsonable(value: Any) -> Any:
    """Parameters as JSON: date-times in ISO format, recursively through lists and dicts."""
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): _jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_jsonable(v) for v in value]
    if isinstance(value, (str, int, float, bool)) or value is None:
        return value
    return str(value)


def encode_params(params: dict[str, Any]) -> str:
    return json.dumps(_jsonable(params), sort_keys=True)


def append_query_log(spark: SparkSession, rows: list[dict[str, Any]], path: str) -> None:
    """K3: append query-log rows (one small driver-made batch) to the parquet log at ``path``, in a
    folder for each date.

    Every append is a small file; :func:`compact_query_log` joins those of a date.
    """
    df = spark.createDataFrame(
        [tuple(r.get(f.name) for f in schemas.QUERY_LOG.fields) for r in rows],
        schema=schemas.QUERY_LOG,
    )
    _dated(df).coalesce(1).write.mode("append").partitionBy(m.PARTITION_COLUMN).parquet(path)


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn(m.PARTITION_COLUMN, F.date_format("timestamp", "yyyy-MM-dd"))


def read_query_log(spark: SparkSession, path: str, *, keep_partition: bool = True) -> DataFrame:
    """The log; its date column lets the reports' time bounds prune folders. A row that was copied by
    a compaction and still stands in its old file counts once, which is looked at within a
    date, so the bounds reach the scan."""
    schema = T.StructType([*schemas.QUERY_LOG.fields, T.StructField(m.PARTITION_COLUMN, T.StringType())])
    q = spark.read.schema(schema).parquet(path).dropDuplicates(["id", m.PARTITION_COLUMN])
    return q if keep_partition else q.drop(m.PARTITION_COLUMN)


def compact_query_log(spark: SparkSession, path: str, *, before: str | None = None, most_files: int = 1,
                      retention: float = 6 * 3600.0) -> int:
    """Join the files of each date (before ``before``) that has more than ``most_files``: its rows are
    appended as one file. The files they came from are marked and removed by a call ``retention``
    seconds later, so a report planned before finishes; until then a reader meets both copies and
    counts each row once (:func:`read_query_log`). Other dates are left alone. Returns how many
    files were joined."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    joined = 0
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        day = name.removeprefix(f"{m.PARTITION_COLUMN}=")
        if day == name:
            continue
        _forget(spark, fs, status.getPath(), retention)
        if before is not None and day >= before:
            continue
        marks = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), RETIRED)
        done = {f.getPath().getName() for f in fs.listStatus(marks)} if fs.exists(marks) else set()
        files = [f.getPath() for f in fs.listStatus(status.getPath())
                 if f.getPath().getName().endswith(".parquet") and f.getPath().getName() not in done]
        if len(files) <= most_files:
            continue
        rows = spark.read.schema(schemas.QUERY_LOG).parquet(*[f.toString() for f in files]).dropDuplicates(["id"])
        _dated(rows).repartition(1).write.mode("append").partitionBy(m.PARTITION_COLUMN).parquet(path)
        for f in files:
            _retire(spark, fs, f)
        joined += len(files)
    return joined


RETIRED = "_retired"


def _retire(spark: SparkSession, fs, file) -> None:
    """Mark a joined file; it stays where planned readers look for it."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(file.getParent(), RETIRED)
    fs.mkdirs(marks)
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(marks, file.getName()), True).close()


def _forget(spark: SparkSession, fs, folder, retention: float) -> None:
    """Remove the files of a date that were joined longer than ``retention`` seconds ago."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(folder, RETIRED)
    if not fs.exists(marks):
        return
    for mark in fs.listStatus(marks):
        if mark.getModificationTime() / 1000 <= time.time() - retention:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, mark.getPath().getName()), False)
            fs.delete(mark.getPath(), False)


class QueryLogger:
    """Time a report, count its rows, log the run (also failed ones) and return the result.

    The rows are written once below the shared checkpoint dir, counted there and returned from
    there: the plan runs once, a result of any size fits, and a lost executor loses nothing. The
    copies of the last hours are kept (``session.scratch_dir``), older ones are removed.
    Nested timed calls each write their own log row.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def timed(self, query_type: str, fn: Callable[..., DataFrame], **params: Any) -> DataFrame:
        started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        t0 = time.perf_counter()
        row = {
            "id": (time.time_ns() << 8 | uuid.uuid4().int & 0xFF) & ((1 << 63) - 1),
            "query_type": query_type,
            "query_params": encode_params(params),
            "timestamp": started,
        }
        try:
            result = fn(**params)
            path = scratch_dir(self.spark, "timed")
            result.write.parquet(path)
            result = self.spark.read.schema(result.schema).parquet(path)
            count = result.count()
        except Exception as exc:
            row.update(
                execution_time=time.perf_counter() - t0, result_count=0, success=False,
                error_message=str(exc),
            )
            append_query_log(self.spark, [row], self.path)
            raise
        row.update(
            execution_time=time.perf_counter() - t0, result_count=int(count), success=True,
            error_message=None,
        )
        append_query_log(self.spark, [row], self.path)
        return result

    def table(self) -> DataFrame:
        return read_query_log(self.spark, self.path)
