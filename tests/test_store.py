"""The exposure store (log, layout by user, article totals) and the dated query log."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from newsprism.operators import ingest as I
from newsprism.plans import querylog as QL
from newsprism.plans import reports as R
from newsprism.session import fresh_dir, scratch_dir
from newsprism.sinks import keyed as K
from newsprism.sinks.store import ExposureStore
from newsprism.streaming import runner as SR

DDL = "impression_id string, user_id string, news_id string, timestamp timestamp, clicked int, dwell_time double"
T0 = dt.datetime(2024, 1, 1, 10)


def news(spark):
    return spark.createDataFrame(
        [(f"n{k}", f"c{k % 3}", f"t{k % 2}", f"h{k}", "b") for k in range(12)],
        "news_id string, category string, topic string, headline string, news_body string")


def random_batches(spark, n, seed=1):
    rng, out = random.Random(seed), []
    for b in range(n):
        rows = {}
        for _ in range(120):
            i = rng.randrange(200)
            user, art = f"u{i % 17}", f"n{i % 12}"
            rows[(f"i{i}", user, art)] = (rng.choice([0, 1, None]), T0 + dt.timedelta(days=rng.randrange(4)), rng.choice([None, 1.5, 40.0]))
        out.append(spark.createDataFrame([(*k, t, c, d) for k, (c, t, d) in rows.items()], DDL))
    return out


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_totals_follow_corrections_and_replays(spark):
    store = ExposureStore(spark, fresh_dir(spark, "store"), user_buckets=4)
    for k, batch in enumerate(random_batches(spark, 4)):
        store.upsert(batch, name="s", epoch=k)
        store.upsert(batch, name="s", epoch=k)  # a replay changes nothing
    log = store.exposures().drop("_part")
    assert as_rows(log) == as_rows(store.users.read())
    want = log.groupBy("news_id", F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("clicked"), F.lit(0)).alias("clicks"), F.count("clicked").alias("rated"),
        F.coalesce(F.sum("dwell_time"), F.lit(0.0)).alias("dwell_sum"), F.count("dwell_time").alias("dwell_n"))
    got = store.articles.read().select(*want.columns).where("n > 0")
    assert as_rows(got) == as_rows(want)
    n = news(spark)
    assert as_rows(store.popular_news(n)) == as_rows(R.popular_news(log, n))
    for user in ("u3", "u9", "nobody"):
        args = dict(user=user, as_of=T0 + dt.timedelta(days=2), cold_hours=48, cold_min_impressions=2)
        assert as_rows(store.recommend(n, **args)) == as_rows(R.recommend(log, n, **args))
    store.tidy()
    store.articles.compact()
    assert as_rows(store.articles.read().select(*want.columns).where("n > 0")) == as_rows(want)
    some = store.article_totals(start="2024-01-02T00:00:00", end="2024-01-03T00:00:00").agg(F.sum("n")).first()[0]
    assert some == log.where("to_date(timestamp) between '2024-01-02' and '2024-01-03'").count()


def test_failure_between_the_layouts_is_replayed(spark, monkeypatch):
    store = ExposureStore(spark, fresh_dir(spark, "store"), user_buckets=4)
    first, second = random_batches(spark, 2, seed=5)
    store.upsert(first, name="s", epoch=0)
    upsert = store.log.upsert
    monkeypatch.setattr(store.log, "upsert", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.upsert(second, name="s", epoch=1)
    monkeypatch.setattr(store.log, "upsert", upsert)
    store.upsert(second, name="s", epoch=1)
    assert store.articles.read().agg(F.sum("n")).first()[0] == store.exposures().count() == store.users.read().count()


def test_one_user_reads_one_bucket(spark):
    store = ExposureStore(spark, fresh_dir(spark, "store"), user_buckets=32)
    rows = [(f"i{k}", f"u{k % 300}", f"n{k % 12}", T0 + dt.timedelta(days=k % 5), k % 2, 1.0) for k in range(6000)]
    store.upsert(spark.createDataFrame(rows, DDL))
    n = news(spark)
    own = store.user_exposures("u7")
    assert len(own.inputFiles()) * 8 <= len(store.users.read().inputFiles())
    assert own.count() == 20
    assert as_rows(store.user_interests(n, user="u7")) == as_rows(R.user_interests(store.exposures(), n, user="u7"))
    assert as_rows(store.user_preferences(n, user="u7")) == as_rows(R.user_preferences(store.exposures(), n, user="u7"))


def test_spool_stream_feeds_the_store(spark):
    spool, ckpt = fresh_dir(spark, "store-spool").removeprefix("file:"), fresh_dir(spark, "store-ckpt")
    os.makedirs(spool)
    store = ExposureStore(spark, fresh_dir(spark, "store"), user_buckets=4)
    line = lambda i, c: json.dumps(dict(impression_id=i, user_id="u1", news_id="n1", timestamp="2024-01-01T10:00:00", clicked=c, dwell_time=2.0))
    for k, lines in enumerate([[line("a", 0), line("b", 1)], [line("a", 1), line("c", 0)]]):
        with open(os.path.join(spool, f"f{k}.json"), "w") as fh:
            fh.write("\n".join(lines) + "\n")
        q, table = SR.ingest_stream(spark, spool, "", checkpoint=ckpt, name=f"store_{k}", available_now=True, store=store)
        q.awaitTermination()
    assert table is store.log and table.read().count() == 3
    t = store.articles.read().first()
    assert (t.n, t.clicks, t.dwell_sum) == (3, 2, 6.0)


def test_query_log_by_date(spark, capsys):
    path = fresh_dir(spark, "qlog")
    row = lambda i, day: dict(id=i, query_type="q", query_params="{}", execution_time=1.0, result_count=1,
                              timestamp=dt.datetime(2024, 1, day, 12), success=True, error_message=None)
    for i in range(6):
        QL.append_query_log(spark, [row(i, 1 + i // 3)], path)
    log = QL.read_query_log(spark, path)
    recent = QL.query_performance(log, as_of=dt.datetime(2024, 1, 2, 13), hours=2)
    recent.explain("formatted")
    assert "PartitionFilters: [isnotnull(_part" in capsys.readouterr().out
    assert recent.first().total_queries == 3
    old = QL.read_query_log(spark, path)
    assert QL.compact_query_log(spark, path, before="2024-01-02") == 3
    assert QL.compact_query_log(spark, path, before="2024-01-02") == 0
    assert old.count() == 6 and QL.read_query_log(spark, path).count() == 6  # planned before, and after
    days = {d: [f for f in os.listdir(os.path.join(path.removeprefix("file:"), d)) if f.endswith(".parquet")]
            for d in os.listdir(path.removeprefix("file:")) if d.startswith("_part=")}
    assert {d: len(f) for d, f in days.items()} == {"_part=2024-01-01": 4, "_part=2024-01-02": 3}
    QL.compact_query_log(spark, path, before="2024-01-02", retention=0.0)
    left = [f for f in os.listdir(os.path.join(path.removeprefix("file:"), "_part=2024-01-01")) if f.endswith(".parquet")]
    assert len(left) == 1 and QL.read_query_log(spark, path).count() == 6


def test_scratch_folders_are_swept(spark):
    made = []
    for _ in range(3):
        made.append(scratch_dir(spark, "sweep-test"))
        spark.range(3).write.parquet(made[-1])
    assert all(os.path.isdir(p.removeprefix("file:")) for p in made)
    scratch_dir(spark, "sweep-test", keep_hours=0.0)
    assert not any(os.path.isdir(p.removeprefix("file:")) for p in made)


def test_ids_of_files_need_no_sort(spark):
    path = fresh_dir(spark, "raw")
    spark.range(5000).repartitionByRange(7, "id").sortWithinPartitions("id").write.option("header", True).csv(path)
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # several blocks of a file
    try:
        got = I.assign_impression_ids(spark.read.option("header", True).csv(path))
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    # the only sort is of the offsets, a row for each block
    assert plan.count("Sort") <= 1 and "RDDScan" not in plan and "ExistingRDD" not in plan
    assert sorted((r.impression_id, int(r.id)) for r in rows) == [(f"imp_{i + 1:07d}", i) for i in range(5000)]
