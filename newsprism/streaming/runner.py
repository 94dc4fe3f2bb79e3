"""Starting, tracking and stopping streaming queries."""

from __future__ import annotations

import collections
import threading
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.ingest import CORRUPT, cast_event_times, stamp_processed
from ..session import STATE_PARTITIONS_KEY, shared_dir
from ..sinks.keyed import KeyedTable, exposure_table, upsert_batch_fn
from ..sinks.store import ExposureStore
from ..sources.files import stream_exposures_dir
from . import windows as W


def _trigger(writer, trigger: str | None, available_now: bool):
    if available_now:
        return writer.trigger(availableNow=True)
    if trigger:
        return writer.trigger(processingTime=trigger)
    return writer


_START_LOCK = threading.Lock()


def _start_stateful(writer, spark: SparkSession, state_partitions: int | None) -> StreamingQuery:
    """Start a stateful query with ``state_partitions`` shuffle (= state store) partitions.

    The query runs on a copy of the session's settings taken at ``start()``, and a restarted
    query takes the count from its checkpoint, so the session setting is changed only around
    ``start()`` (under a lock) and put back at once. Without a count (argument or
    ``spark.newsprism.streaming.statePartitions``) the session's own setting is used.
    """
    n = state_partitions or spark.conf.get(STATE_PARTITIONS_KEY, None)
    if not n:
        return writer.start()
    with _START_LOCK:
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            return writer.start()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def start_console(
    df: DataFrame, *, name: str, trigger: str | None = None, checkpoint: str | None = None,
    available_now: bool = False, state_partitions: int | None = None,
) -> StreamingQuery:
    """K6: update-mode console sink, rows not truncated; state sized as for the monitors."""
    writer = df.writeStream.outputMode("update").format("console").option("truncate", "false")
    writer = writer.queryName(name)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return _start_stateful(_trigger(writer, trigger, available_now), df.sparkSession, state_partitions)


def start_keyed_table(
    df: DataFrame,
    table: KeyedTable,
    *,
    name: str,
    checkpoint: str,
    trigger: str | None = None,
    available_now: bool = False,
    order: Sequence[str] = (),
    unique: bool = False,
    state_partitions: int | None = None,
) -> StreamingQuery:
    """K7: every micro-batch of an update-mode stream is upserted into a keyed parquet table.

    The checkpoint (offsets + aggregation state) and the table both live on shared storage;
    a restarted query replays the last uncommitted batch into the same batch folder. ``state_partitions`` sizes the aggregation state (see
    :func:`_start_stateful`).
    """
    writer = (
        df.writeStream.outputMode("update")
        .foreachBatch(upsert_batch_fn(table, stream=checkpoint, order=order, unique=unique))
        .option("checkpointLocation", checkpoint)
        .queryName(name)
    )
    return _start_stateful(_trigger(writer, trigger, available_now), df.sparkSession, state_partitions)


def monitor_table(spark: SparkSession, spec: W.WindowSpec, path: str) -> KeyedTable:
    """Keyed table of a monitor's stage-1 rows, partitioned by the pane's day; files are sorted by
    pane, so their min/max statistics tell hours apart within a day."""
    return KeyedTable(
        spark, path, W.pane_key(spec), F.date_format(W.PANE, "yyyy-MM-dd"), movable=False, ranged=False
    )


def start_monitor(
    spark: SparkSession,
    exposures: DataFrame,
    name: str,
    *,
    table_path: str | None = None,
    checkpoint: str | None = None,
    available_now: bool = False,
    query_name: str | None = None,
    state_partitions: int | None = None,
) -> tuple[StreamingQuery, KeyedTable]:
    """Start monitor ``name`` (trend / user_behavior / anomaly / content) on an exposure stream.

    Returns the query and its stage-1 table; the report is ``windows.monitor_report`` over
    ``table.read()`` at any time.
    """
    spec = W.SPECS[name]
    qname = query_name or f"{name}_monitor"
    table_path = table_path or shared_dir(spark, "monitors", qname, "table")
    checkpoint = checkpoint or shared_dir(spark, "monitors", qname, "checkpoint")
    table = monitor_table(spark, spec, table_path)
    partials = W.pane_partials(exposures, spec)
    # an aggregation's update output holds each (pane, key, value) once per micro-batch
    q = start_keyed_table(
        partials, table, name=qname, checkpoint=checkpoint, trigger=spec.trigger,
        available_now=available_now, unique=True, state_partitions=state_partitions,
    )
    return q, table


class StreamRegistry:
    """Named running queries: list, stop one (False when unknown), stop all."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._queries: dict[str, StreamingQuery] = {}
        self._lock = threading.Lock()

    def add(self, name: str, query: StreamingQuery) -> str:
        with self._lock:
            self._queries[name] = query
        return name

    def get(self, name: str) -> StreamingQuery | None:
        with self._lock:
            return self._queries.get(name)

    def list(self) -> list[dict]:
        with self._lock:
            items = list(self._queries.items())
        return [
            {"name": n, "id": str(q.id), "active": q.isActive, "status": q.status.get("message")}
            for n, q in items
        ]

    def stop(self, name: str) -> bool:
        with self._lock:
            q = self._queries.pop(name, None)
        if q is None:
            return False
        q.stop()
        return True

    def stop_all(self) -> int:
        with self._lock:
            items = list(self._queries.values())
            self._queries.clear()
        for q in items:
            q.stop()
        return len(items)


class StreamLog:
    """What happened to the session's streaming queries: progress of each trigger and ends.

    A listener on the driver (one small record a trigger, the last ``keep`` are held) that works as
    a context manager. :meth:`events` has a row an event, :meth:`status` a row a run: rows read,
    rows that the watermark dropped (of an aggregation: groups, as the state operator counts
    them), the largest event time, state rows, failures and the last error.
    """

    EVENTS = (
        "event string, name string, query_id string, run_id string, batch_id long, at string, input_rows long, "
        "late_rows long, state_rows long, state_updates long, watermark string, max_event_time string, "
        "duration_ms long, error string"
    )

    def __init__(self, spark: SparkSession, *, keep: int = 10_000):
        self.spark = spark
        self._records: collections.deque[dict] = collections.deque(maxlen=keep)
        self._names: dict[str, str] = {}
        log = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                log._names[str(event.runId)] = event.name
                log._add("started", event.name, event.id, event.runId, at=event.timestamp)

            def onQueryProgress(self, event):
                p = event.progress
                ops = p.stateOperators
                log._add(
                    "progress", p.name, p.id, p.runId, batch_id=p.batchId, at=p.timestamp, input_rows=p.numInputRows,
                    late_rows=sum(o.numRowsDroppedByWatermark for o in ops), state_rows=sum(o.numRowsTotal for o in ops),
                    state_updates=sum(o.numRowsUpdated for o in ops), watermark=p.eventTime.get("watermark"),
                    max_event_time=p.eventTime.get("max"), duration_ms=p.batchDuration)

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                error = event.exception
                log._add("failed" if error else "ended", log._names.get(str(event.runId)), event.id, event.runId, error=error)

        self._listener = Listener()

    def _add(self, event: str, name, query_id, run_id, **values) -> None:
        self._records.append({"event": event, "name": name, "query_id": str(query_id), "run_id": str(run_id), **values})

    def __enter__(self) -> "StreamLog":
        self.spark.streams.addListener(self._listener)
        return self

    def __exit__(self, *exc) -> None:
        self.spark.streams.removeListener(self._listener)

    def records(self) -> list[dict]:
        """The records so far, those of triggers that have finished included: events arrive on a bus
        of their own, which is drained first."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return list(self._records)

    def events(self) -> DataFrame:
        fields = [f.strip().split(" ")[0] for f in self.EVENTS.split(",")]
        return self.spark.createDataFrame([tuple(r.get(f) for f in fields) for r in self.records()], self.EVENTS)

    def status(self) -> DataFrame:
        e = self.events()
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
        return e.groupBy("name", "query_id", "run_id").agg(
            F.count_if(F.col("event") == "progress").alias("triggers"),
            F.count_if(F.col("input_rows") > 0).alias("batches_with_input"),
            total("input_rows"), total("late_rows"),
            F.max_by("state_rows", "batch_id").alias("state_rows"),
            F.max("max_event_time").cast("timestamp").alias("max_event_time"),
            F.max("watermark").cast("timestamp").alias("watermark"),
            F.count_if(F.col("event") == "failed").alias("failures"),
            F.max("error").alias("last_error"),
        )


class Monitors:
    """The start / list / stop surface of the monitoring service on one exposure stream.

    ``start(kind)`` starts a monitor and returns its id (``<kind>_<epoch seconds>``); the
    report of a running monitor is ``report(id)``. Ids are tracked in a :class:`StreamRegistry`.
    """

    def __init__(self, spark: SparkSession, exposures: DataFrame, *, news: DataFrame | None = None):
        self.spark = spark
        self.exposures = exposures
        self.news = news
        self.registry = StreamRegistry(spark)
        self._tables: dict[str, tuple[str, KeyedTable]] = {}

    def start(self, kind: str, **kwargs) -> str:
        qid = f"{kind}_{int(time.time())}"
        while qid in self._tables:
            qid += "_"
        q, table = start_monitor(self.spark, self.exposures, kind, query_name=qid, **kwargs)
        self._tables[qid] = (kind, table)
        return self.registry.add(qid, q)

    def start_trend_analysis(self, **kw) -> str:
        return self.start("trend", **kw)

    def start_user_behavior_analysis(self, **kw) -> str:
        return self.start("user_behavior", **kw)

    def start_anomaly_detection(self, **kw) -> str:
        return self.start("anomaly", **kw)

    def start_content_analysis(self, **kw) -> str:
        return self.start("content", **kw)

    def report(self, qid: str, *, since=None, until=None, **kwargs) -> DataFrame:
        """The monitor's report over the windows starting in ``[since, until]`` (only their
        partitions are read); ``content`` reports carry the articles' current headlines."""
        kind, table = self._tables[qid]
        if kind == "content" and self.news is not None:
            kwargs.setdefault("news", self.news)
        spec = W.SPECS[kind]
        panes = table.read(keep_partition=True, start=since, end=W.last_pane(spec, until))
        return W.monitor_report(panes, kind, since=since, until=until, **kwargs)

    def list(self) -> list[dict]:
        return self.registry.list()

    def stop(self, qid: str) -> bool:
        return self.registry.stop(qid)

    def stop_all(self) -> int:
        return self.registry.stop_all()


# --------------------------------------------------------------------------- W8
def ingest_stream(
    spark: SparkSession,
    spool_dir: str,
    table_path: str,
    *,
    checkpoint: str,
    name: str = "exposure_ingest",
    trigger: str | None = "10 seconds",
    available_now: bool = False,
    clean_source: str | None = None,
    max_files_per_trigger: int | None = None,
    rejects_path: str | None = None,
    store: ExposureStore | None = None,
) -> tuple[StreamingQuery, KeyedTable]:
    """Spool folder of JSON lines → parsed, time-cast, stamped → exposure table upserts.

    Records without a complete primary key and malformed ones (not a JSON object, or a field of
    the wrong type, as in :func:`parse_json_records`) are not stored; they go, with their text, to
    the JSON-lines folder ``rejects_path`` (``<checkpoint>-rejects`` by default), one sub-folder an
    epoch. Within a micro-batch the record read last (file modification time, file path,
    position) wins. With a ``store`` the batch goes into all its layouts (``table_path`` is then the
    store's own log and ignored).
    """
    raw = stream_exposures_dir(
        spark, spool_dir, clean_source=clean_source, max_files_per_trigger=max_files_per_trigger
    )
    rejects_path = rejects_path or f"{checkpoint.rstrip('/')}-rejects"
    good = (
        F.col("impression_id").isNotNull() & F.col("user_id").isNotNull()
        & F.col("news_id").isNotNull() & F.col(CORRUPT).isNull()
    )
    rows = stamp_processed(cast_event_times(raw.drop("processed_timestamp")))
    rows = rows.withColumn("_file_t", F.col("_metadata.file_modification_time")).withColumn(
        "_file_p", F.col("_metadata.file_path")
    )
    # a record may be sent again with a corrected (or first parsable) time: keys can move
    table = store.log if store else exposure_table(spark, table_path)
    arrival = ["_file_t", "_file_p", "_line"]

    upsert_numbered = upsert_batch_fn(store or table, stream=checkpoint, order=arrival, drop=arrival)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # inside foreachBatch the micro-batch is a plain DataFrame: number its rows in read order
        numbered = batch.withColumn("_line", F.monotonically_increasing_id())
        upsert_numbered(numbered.where(good).drop(CORRUPT), batch_id)
        bad = batch.where(~good).drop(*arrival)
        bad.write.mode("overwrite").json(f"{rejects_path}/epoch={batch_id}")

    writer = rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).queryName(name)
    return _trigger(writer, trigger, available_now).start(), table
