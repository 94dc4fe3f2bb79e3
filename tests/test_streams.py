"""Streaming monitors: batch = stream, late data, restart, registry; SQL guard; query log."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from newsprism.plans import bi as BI
from newsprism.plans import querylog as QL
from newsprism.session import fresh_dir
from newsprism.sinks import keyed as K
from newsprism.sources import bindings as B
from newsprism.sources import kafka as KF
from newsprism.streaming import runner as SR
from newsprism.streaming import windows as W

SF = "/root/testdata/sf0.001"
DDL = "impression_id string, user_id string, news_id string, timestamp timestamp, clicked int, dwell_time double"


def _sorted(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("name", ["trend", "user_behavior", "anomaly", "content"])
def test_stream_equals_batch(spark, name):
    news = {"news": B.event_news(spark, SF)} if name == "content" else {}
    q, table = SR.start_monitor(
        spark, B.event_exposure_stream(spark, SF), name, available_now=True,
        table_path=fresh_dir(spark, "t"), checkpoint=fresh_dir(spark, "c"), query_name=f"eq_{name}",
    )
    q.awaitTermination()
    kwargs = {"threshold": 0.001} if name == "anomaly" else {}
    streamed = W.monitor_report(table.read(), name, **news, **kwargs)
    batch_in = B.event_exposures(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    batch = W.batch_report(batch_in, name, **news, **kwargs)
    cols = sorted(batch.columns)
    assert streamed.count() > 0
    assert _sorted(streamed.select(cols), cols) == _sorted(batch.select(cols), cols)


def test_monitor_state_partitions(spark):
    """A monitor starts with its own state partition count: the checkpoint records it, the
    session keeps its own setting, and the result still equals the batch report."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    ckpt = fresh_dir(spark, "sp-ckpt")
    q, table = SR.start_monitor(
        spark, B.event_exposure_stream(spark, SF), "trend", available_now=True,
        table_path=fresh_dir(spark, "sp-table"), checkpoint=ckpt, query_name="state_parts",
        state_partitions=3,
    )
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    q.awaitTermination()
    offsets = os.path.join(ckpt, "offsets", "0")
    with open(offsets.removeprefix("file:")) as fh:
        assert '"spark.sql.shuffle.partitions":"3"' in fh.read()
    stores = [d for d in os.listdir(os.path.join(ckpt.removeprefix("file:"), "state", "0")) if d.isdigit()]
    assert sorted(stores) == ["0", "1", "2"]
    batch_in = B.event_exposures(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    batch = W.batch_report(batch_in, "trend")
    cols = sorted(batch.columns)
    streamed = W.monitor_report(table.read(), "trend")
    assert _sorted(streamed.select(cols), cols) == _sorted(batch.select(cols), cols)


def test_late_rows_are_dropped_and_restart_is_idempotent(spark):
    src = fresh_dir(spark, "late-src")
    t = dt.datetime(2024, 1, 1, 10, 0)
    first = [("a%d" % i, "u%d" % (i % 3), "n1", t + dt.timedelta(minutes=i), i % 2, 10.0) for i in range(21)]
    late = [("late", "u9", "n1", t - dt.timedelta(hours=1), 1, 50.0), ("fresh", "u9", "n1", t + dt.timedelta(minutes=25), 1, 50.0)]
    spark.createDataFrame(first, DDL).coalesce(1).write.parquet(os.path.join(src, "f1"))
    stream = (
        spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    )
    ckpt, path = fresh_dir(spark, "late-ckpt"), fresh_dir(spark, "late-table")
    q, table = SR.start_monitor(spark, stream, "trend", available_now=True, table_path=path, checkpoint=ckpt, query_name="late1")
    q.awaitTermination()
    spark.createDataFrame(late, DDL).coalesce(1).write.parquet(os.path.join(src, "f2"))
    # restart from the same checkpoint: only the new file is read; the old row is behind the watermark
    q, table = SR.start_monitor(spark, stream, "trend", available_now=True, table_path=path, checkpoint=ckpt, query_name="late2")
    q.awaitTermination()
    rep = W.monitor_report(table.read(), "trend")
    starts = {r.window_start for r in rep.collect()}
    assert min(starts) >= t - dt.timedelta(minutes=4)  # nothing from 09:00
    assert t + dt.timedelta(minutes=25) in starts  # the fresh row counted
    total = rep.where(F.col("window_start") == t + dt.timedelta(minutes=10)).first()
    assert total.impression_count == 5  # minutes 10..14, counted once despite the restart


def test_state_is_a_row_a_pane_and_the_log_counts(spark):
    """An exposure is in one pane's state, not in five windows; the status log says so, and names failures."""
    e = B.event_exposures(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    panes = e.select(F.window("timestamp", "1 minute"), "news_id", "user_id").distinct().count()
    windows = e.select(F.window("timestamp", "5 minutes", "1 minute"), "news_id", "user_id").distinct().count()
    with SR.StreamLog(spark) as log:
        q, table = SR.start_monitor(
            spark, B.event_exposure_stream(spark, SF), "trend", available_now=True,
            table_path=fresh_dir(spark, "t"), checkpoint=fresh_dir(spark, "c"), query_name="pane_state")
        q.awaitTermination()
        boom = spark.readStream.format("rate").load().writeStream.foreachBatch(
            lambda df, i: (_ for _ in ()).throw(ValueError("boom"))).queryName("fails").start()
        with pytest.raises(Exception):
            boom.awaitTermination(60)
        status = {r["name"]: r for r in log.status().collect()}
    updates = max(r.get("state_updates", 0) for r in log.records() if r["name"] == "pane_state")
    assert updates == panes and 5 * panes >= windows > 4 * panes
    assert status["pane_state"].input_rows == e.count() and status["pane_state"].failures == 0
    assert status["fails"].failures == 1 and "boom" in status["fails"].last_error
    assert log.events().where("event = 'started'").count() == 2


def test_registry_list_and_stop(spark):
    reg = SR.StreamRegistry(spark)
    stream = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    q = stream.writeStream.format("noop").queryName("reg_test").start()
    reg.add("reg_test", q)
    assert [x["name"] for x in reg.list()] == ["reg_test"]
    assert reg.stop("nope") is False
    assert reg.stop("reg_test") is True
    assert not q.isActive
    q2 = stream.writeStream.format("noop").queryName("reg_test2").start()
    reg.add("reg_test2", q2)
    assert reg.stop_all() == 1 and not q2.isActive


def test_run_sql_guard(spark):
    e = B.event_exposures(spark, SF)
    ok = BI.run_sql(spark, "select count(*) as n from exposure_logs -- drop table x", {"exposure_logs": e})
    assert ok.first().n == 1000
    for bad in ("drop table exposure_logs", "select 1; drop table x", "insert into t select 1",
                "with a as (select 1) insert into t select * from a", "create table x as select 1"):
        with pytest.raises(ValueError):
            BI.run_sql(spark, bad, {})
    assert BI.run_sql(spark, "select 'drop' as w", {}).first().w == "drop"


def test_query_logger_records_failures(spark):
    log = QL.QueryLogger(spark, fresh_dir(spark, "qlog"))
    out = log.timed("ok", lambda n: spark.range(n), n=5)
    assert out.count() == 5
    with pytest.raises(Exception):
        log.timed("bad", lambda when: spark.sql("select * from missing_table_zz"), when=dt.datetime(2024, 1, 2))
    rows = {r.query_type: r for r in log.table().collect()}
    assert rows["ok"].success and rows["ok"].result_count == 5
    assert not rows["bad"].success and rows["bad"].error_message
    assert rows["bad"].query_params == '{"when": "2024-01-02T00:00:00"}'
    perf = {r.query_type: r for r in QL.query_performance(log.table(), as_of=dt.datetime.now(), hours=24 * 365).collect()}
    assert perf["bad"].failed_queries == 1 and perf["bad"].success_rate == 0.0


def test_kafka_options():
    assert KF.stream_options("b:9092")["startingOffsets"] == "latest"
    assert KF.stream_options("b:9092")["failOnDataLoss"] == "false"
    assert KF.batch_options("b:9092", "t") == {
        "kafka.bootstrap.servers": "b:9092", "subscribe": "t",
        "startingOffsets": "earliest", "endingOffsets": "latest",
    }


def test_kafka_value_roundtrip(spark):
    from newsprism.operators.ingest import cast_event_times, parse_json_records

    e = spark.createDataFrame([("i", "u", "n", dt.datetime(2019, 1, 1, 1, 2, 3), 1, 2.5)], DDL)
    back = cast_event_times(parse_json_records(KF.kafka_value(e))).first()
    assert (back.impression_id, back.timestamp, back.dwell_time) == ("i", dt.datetime(2019, 1, 1, 1, 2, 3), 2.5)


def test_sources_and_console_sink(spark):
    from newsprism.sources import files as S

    root = fresh_dir(spark, "tables")
    e = B.event_exposures(spark, SF)
    K.upsert_exposures(spark, e, os.path.join(root, "exposure_logs"))
    K.upsert_news(spark, B.event_news(spark, SF), os.path.join(root, "news"))
    got = S.load_tables(spark, root)
    assert set(got) == {"exposure_logs", "news"}
    assert spark.sql("select count(*) c from exposure_logs").first().c == 1000

    spool = fresh_dir(spark, "spool")
    S.write_jsonl(e.limit(30), spool)
    with open(os.path.join(spool.removeprefix("file:"), "bad.json"), "w") as fh:
        fh.write("{not json\n")
    stream = S.stream_exposures_dir(spark, spool)
    q = SR.start_console(stream.groupBy("clicked").count(), name="console_test", available_now=True,
                         checkpoint=fresh_dir(spark, "console-ckpt"))
    q.awaitTermination()
    assert sum(p["numInputRows"] for p in q.recentProgress) == 31  # 30 records + 1 malformed line


def test_monitor_report_window_bound_prunes(spark, capsys):
    q, table = SR.start_monitor(
        spark, B.event_exposure_stream(spark, SF), "trend", available_now=True,
        table_path=fresh_dir(spark, "t"), checkpoint=fresh_dir(spark, "c"), query_name="bound_trend",
    )
    q.awaitTermination()
    since = dt.datetime(2024, 1, 20)
    recent = W.window_partials(table.read(keep_partition=True), W.TREND, since=since)
    recent.explain("formatted")
    assert "PartitionFilters: [isnotnull(_part" in capsys.readouterr().out
    rep = W.trend_report(recent)
    full = W.monitor_report(table.read(), "trend").where(F.col("window_start") >= since)
    cols = sorted(rep.columns)
    assert _sorted(rep.select(cols), cols) == _sorted(full.select(cols), cols)


def test_monitor_facade(spark):
    m = SR.Monitors(spark, B.event_exposure_stream(spark, SF), news=B.event_news(spark, SF))
    qid = m.start_anomaly_detection(available_now=True)
    assert qid.startswith("anomaly_")
    m.registry.get(qid).awaitTermination()
    assert m.report(qid, threshold=0.001).count() > 0
    cid = m.start_content_analysis(available_now=True)
    assert {x["name"] for x in m.list()} == {qid, cid}
    assert m.stop(cid) is True and m.stop(cid) is False
    assert m.stop_all() == 1


def test_monitor_on_rocksdb_state_store(spark):
    from newsprism.session import CLUSTER_CONF

    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, CLUSTER_CONF[key])
    try:
        q, table = SR.start_monitor(
            spark, B.event_exposure_stream(spark, SF), "trend", available_now=True,
            table_path=fresh_dir(spark, "t"), checkpoint=fresh_dir(spark, "c"), query_name="rocks_trend",
        )
        q.awaitTermination()
    finally:
        spark.conf.set(key, old)
    batch_in = B.event_exposures(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    assert W.monitor_report(table.read(), "trend").count() == W.batch_report(batch_in, "trend").count()


def test_perf_histogram_edges(spark):
    q = spark.createDataFrame(
        [(i, "t", t, True) for i, t in enumerate([0.001, 0.004, 0.012, 0.2, 0.9])],
        "id long, query_type string, execution_time double, success boolean",
    )
    got = [(r.range_start_ms, r.range_end_ms, r.query_count) for r in QL.perf_histogram(q, edges=[2, 10, 100]).collect()]
    assert got == [(None, 2.0, 1), (2.0, 10.0, 1), (10.0, 100.0, 1), (100.0, None, 2)]
    fixed = [(r.range_start_ms, r.query_count) for r in QL.perf_histogram(q, width_ms=100).collect()]
    assert fixed == [(0, 3), (200, 1), (900, 1)]


def _exposure(i, t, clicked=0, news="n1", user="u"):
    return (i, user, news, t, clicked, 1.0)


def test_micro_batches_append_and_late_rows(spark):
    """One file a micro-batch: earlier batch folders stay as they were, a row behind the watermark
    is dropped, and a headline that changes neither splits nor loses exposures."""
    src, path = fresh_dir(spark, "mb-src"), fresh_dir(spark, "mb-table")
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    batches = [
        [_exposure("a", t0), _exposure("b", t0, 1)],
        [_exposure("c", t0 + dt.timedelta(minutes=1)), _exposure("x", t0 + dt.timedelta(days=1), news="n2")],
        [_exposure("late", t0), _exposure("y", t0 + dt.timedelta(days=1, minutes=1), news="n2")],
    ]
    ckpt, seen = fresh_dir(spark, "mb-ckpt"), []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", "1").parquet(src)
        q, table = SR.start_monitor(spark, stream, "content", available_now=True, table_path=path,
                                    checkpoint=ckpt, query_name=f"mb_{k}")
        q.awaitTermination()
        files = sorted(spark.read.option("basePath", path).parquet(path).inputFiles())
        assert set(seen) <= set(files)  # nothing that was written is rewritten
        seen = files
    for title in ("old title", "new title"):
        news = spark.createDataFrame([("n1", title), ("n2", "x")], "news_id string, headline string")
        got = {(r.news_id, r.window_start): (r.impressions, r.headline)
               for r in W.monitor_report(table.read(), "content", news=news).collect()}
        assert got[("n1", t0)] == (3, title) and len(got) == 2


def test_corrected_times_keep_keys_unique_and_rejects_are_kept(spark):
    import json

    spool, path = fresh_dir(spark, "fix-spool"), fresh_dir(spark, "fix-table")
    ckpt = fresh_dir(spark, "fix-ckpt")
    rec = lambda i, t, c=0: json.dumps(dict(impression_id=i, user_id="u", news_id="n", timestamp=t, clicked=c, dwell_time=1.0))
    lines = [
        [rec("a", "2024-01-01T10:00:00"), rec("b", "not a time"), "{broken", rec("c", "2024-01-01T10:00:00", "yes")],
        [rec("a", "2024-01-02T10:00:00", 1), rec("b", "2024-01-03T10:00:00")],
    ]
    os.makedirs(spool.removeprefix("file:"))
    for k, own in enumerate(lines):
        with open(os.path.join(spool.removeprefix("file:"), f"f{k}.json"), "w") as fh:
            fh.write("\n".join(own) + "\n")
        q, table = SR.ingest_stream(spark, spool, path, checkpoint=ckpt, name=f"fix_{k}", available_now=True)
        q.awaitTermination()
    got = {r.impression_id: (r.timestamp, r.clicked) for r in table.read().collect()}
    assert table.read().count() == 2
    assert got == {"a": (dt.datetime(2024, 1, 2, 10), 1), "b": (dt.datetime(2024, 1, 3, 10), 0)}
    # a reader of one day does not see the stale row
    day = K.exposure_log(spark, path).where("_part = '2024-01-01'")
    assert day.count() == 0
    assert spark.read.json(ckpt + "-rejects").count() == 2


def test_sql_guard_on_the_plan(spark):
    t = {"news": spark.createDataFrame([("n1", '{"a": [1]}')], "news_id string, extra string")}
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("news")
    assert BI.run_sql(spark, "select 1 as load", t).first()[0] == 1
    assert BI.run_sql(spark, "with a as (select news_id from news) select * from a order by 1;", t).count() == 1
    assert spark.table("news").columns == ["x"]  # the caller's view is still there
    for bad in ("drop table x", "select 1; select 2", "select reflect('java.lang.System', 'exit', 0)",
                "select * from parquet.`/tmp`", "insert into news values (1)", "select * from other_view",
                "select java_method('java.util.UUID', 'randomUUID')", "set a=b", ""):
        with pytest.raises(ValueError):
            BI.run_sql(spark, bad, t)
    assert BI.sql_records(spark, "select * from news", t) == [{"news_id": "n1", "extra": {"a": [1]}}]
    slow = "select count(*) from range(100000000) a join range(1000000) b on a.id % 7 = b.id % 7"
    with pytest.raises(TimeoutError):
        BI.sql_records(spark, slow, t, timeout=2.0)
