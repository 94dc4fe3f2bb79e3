"""The keyed table: snapshot reads, partial compaction, the key index, replays, the manifest."""

import contextlib
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from newsprism.plans import reports as R
from newsprism.session import fresh_dir
from newsprism.sinks import keyed as K

DDL = "impression_id string, user_id string, news_id string, timestamp timestamp, clicked int, dwell_time double"
DAY = dt.datetime(2024, 1, 1, 10)


def rows(spark, ids, day=0, clicked=0, news="n1"):
    t = DAY + dt.timedelta(days=day)
    return spark.createDataFrame([(f"i{i}", "u", news, t, clicked, 1.0) for i in ids], DDL)


def files(path):
    """Data files below the table, by partition."""
    out = {}
    for base, _, names in os.walk(path.removeprefix("file:")):
        for n in names:
            if n.endswith(".parquet") and "/_part=" in base:
                out.setdefault(base.rsplit("_part=", 1)[1], set()).add(os.path.join(base, n))
    return out


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_report_planned_before_compaction_finishes_after_it(spark):
    path = fresh_dir(spark, "snap")
    t = K.exposure_table(spark, path)
    for k in range(3):
        t.upsert(rows(spark, range(k, k + 5), clicked=k % 2))
    before = t.read().orderBy("impression_id")
    report = R.insights_overview(K.exposure_log(spark, path), as_of=DAY, hours=1)
    t.compact()
    assert [len(b) for b in t.batches().values()] == [1]
    want = [("i0", 0), ("i1", 1), ("i2", 0), ("i3", 0), ("i4", 0), ("i5", 0), ("i6", 0)]
    for df in (before, t.read().orderBy("impression_id")):
        assert [(r.impression_id, r.clicked) for r in df.collect()] == want
    assert report.first().total_impressions == 7 and report.first().total_clicks == 1
    # past the retention the old files go, the table stays
    old = len(files(path)["2024-01-01"])
    K.KeyedTable(spark, path, t.key, t.partition, retention=0.0).clean()
    assert len(files(path)["2024-01-01"]) < old
    assert len(t.manifest.versions()) == 2  # the last one, and the one without the removed folders
    assert [(r.impression_id, r.clicked) for r in t.read().orderBy("impression_id").collect()] == want


def test_tidy_rewrites_the_busy_partition_only(spark, monkeypatch):
    monkeypatch.setattr(K, "MOST_BATCHES", 3)
    path = fresh_dir(spark, "tidy")
    t = K.KeyedTable(spark, path, ("impression_id", "user_id", "news_id"), F.date_format("timestamp", "yyyy-MM-dd"))
    whole = spark.range(100_000).selectExpr(
        "concat('i', id) as impression_id", "'u' as user_id", "'n1' as news_id",
        "timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, cast(id div 20000 as int)) as timestamp",
        "0 as clicked", "1D as dwell_time")
    t.upsert(whole)
    for k in range(5):
        t.upsert(rows(spark, [k], 3, clicked=1))  # i0 .. i4 move from the first day to the fourth
    held = {p: set(b) for p, b in t.batches().items()}
    before = files(path)
    t.tidy()
    now = t.batches()
    for day in ("2024-01-02", "2024-01-03", "2024-01-05"):
        assert set(now[f"_part={day}"]) == held[f"_part={day}"]
    new = {p: files(path)[p] - before[p] for p in before}
    # the first day holds tombstones, the fourth the moved rows; each had six batches
    assert {p for p in new if new[p]} == {"2024-01-01", "2024-01-04"}
    # the small batches were joined, the large first one was not read or written
    assert [len(now[f"_part=2024-01-0{d}"]) for d in (1, 4)] == [2, 2]
    first = min(held["_part=2024-01-04"])
    assert first in now["_part=2024-01-04"]
    got = t.read().groupBy(F.to_date("timestamp").alias("d")).agg(F.count("*").alias("n"), F.sum("clicked").alias("c"))
    assert sorted((r.d.day, r.n, r.c) for r in got.collect()) == [
        (1, 19995, 0), (2, 20000, 0), (3, 20000, 0), (4, 20005, 5), (5, 20000, 0)]
    t.compact()
    assert all(len(b) == 1 for b in t.batches().values())
    assert sorted((r.d.day, r.n, r.c) for r in got.collect()) == sorted((r.d.day, r.n, r.c) for r in t.read().groupBy(
        F.to_date("timestamp").alias("d")).agg(F.count("*").alias("n"), F.sum("clicked").alias("c")).collect())


def test_one_event_compacts_one_partition(spark, monkeypatch):
    monkeypatch.setattr(K, "MOST_BATCHES", 1)
    path = fresh_dir(spark, "one")
    t = K.exposure_table(spark, path)
    for day in range(4):
        t.upsert(rows(spark, range(10 * day, 10 * day + 10), day))
    before = files(path)
    t.upsert(rows(spark, [100], 2))
    t.tidy()
    new = {p: len(f - before[p]) for p, f in files(path).items()}
    assert new == {"2024-01-01": 0, "2024-01-02": 0, "2024-01-03": 2, "2024-01-04": 0}  # the event, the joined file
    assert t.read().count() == 41


def test_partition_with_one_batch_is_read_as_it_is(spark):
    path = fresh_dir(spark, "direct")
    t = K.exposure_table(spark, path)
    t.upsert(rows(spark, range(100)).unionByName(rows(spark, range(100, 200), 1)))
    assert "Window" not in plan(t.read()) and "Join" not in plan(t.read())
    t.upsert(rows(spark, [1], 1, clicked=1).unionByName(rows(spark, [150], 1, clicked=1)))
    late = t.read(keep_partition=True)
    assert "Window" in plan(late)
    one_day = K.exposure_log(spark, path, start=DAY - dt.timedelta(hours=1), end=DAY + dt.timedelta(hours=1))
    # the first day has a tombstone for i1; a day that no later batch touched needs nothing
    t.upsert(rows(spark, range(300, 310), 5))
    other = K.exposure_log(spark, path, start=DAY + dt.timedelta(days=5), end=DAY + dt.timedelta(days=6))
    assert "Window" not in plan(other) and "Join" not in plan(other) and other.count() == 10
    assert one_day.count() == 99 and one_day.where("impression_id = 'i1'").count() == 0
    # the first, large batch of a touched day is filtered by the later keys, not sorted with them
    executed = late._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in executed and "LeftAnti" in executed
    assert sorted((r.impression_id, r.clicked) for r in late.where("clicked = 1").collect()) == [("i1", 1), ("i150", 1)]
    assert late.count() == 200


def test_key_index_reads_the_buckets_of_the_batch(spark, monkeypatch):
    monkeypatch.setattr(K, "KEYS_PER_BUCKET", 50)
    path = fresh_dir(spark, "index")
    t = K.exposure_table(spark, path)
    t.upsert(rows(spark, range(3000)))
    about = list(t.manifest.load()["index"].values())
    assert about == [{"buckets": 64, "keys": 3000}]  # as many as the keys need
    read = []
    lookup = t._lookup
    monkeypatch.setattr(t, "_lookup", lambda *a: read.append(lookup(*a)) or read[-1])
    t.upsert(rows(spark, range(2990, 3002), 1, clicked=1))  # ten of them move, two are new
    assert 1 <= len(read[-1].inputFiles()) <= 12 < 64
    t.upsert(rows(spark, [5], 2, clicked=1))
    assert len(read[-1].inputFiles()) == 2  # one bucket of the first batch, the one file of the second
    got = t.read().groupBy(F.to_date("timestamp").alias("d")).count()
    assert sorted((r.d.day, r["count"]) for r in got.collect()) == [(1, 2989), (2, 12), (3, 1)]
    t.compact()
    assert [i["keys"] for i in t.manifest.load()["index"].values()] == [3013]
    t.upsert(rows(spark, [5], 0, clicked=1))  # back again: found in the joined index
    assert sorted((r.timestamp, r.clicked) for r in t.read().where("impression_id = 'i5'").collect()) == [(DAY, 1)]
    assert t.read().count() == 3002


def test_replayed_epochs_are_skipped(spark):
    path = fresh_dir(spark, "epochs")
    t = K.exposure_table(spark, path)
    run = K.upsert_batch_fn(t, stream="some/checkpoint")
    run(rows(spark, [1, 2]), 0)
    run(rows(spark, [2, 3], clicked=1), 1)
    version = t.manifest.load()["version"]
    run(rows(spark, [2, 3], clicked=1), 1)
    assert t.manifest.load()["version"] == version
    K.upsert_batch_fn(t, stream="another")(rows(spark, [9]), 0)
    assert sorted((r.impression_id, r.clicked) for r in t.read().collect()) == [("i1", 0), ("i2", 1), ("i3", 1), ("i9", 0)]


def test_writers_that_collide_retry(spark, monkeypatch):
    path = fresh_dir(spark, "race")
    monkeypatch.setattr(K.Manifest, "_lock", contextlib.nullcontext())
    a, b = K.Manifest(spark, path), K.Manifest(spark, path)
    seen = []

    def change(m):
        seen.append(m["version"])
        if len(seen) == 1:
            b.commit(lambda other: other["epochs"].update(b=1))
        m["epochs"]["a"] = 1

    a.commit(change)
    assert seen == [0, 1] and a.load()["epochs"] == {"a": 1, "b": 1} and a.load()["version"] == 2


def test_empty_batches_null_keys_and_types(spark):
    path = fresh_dir(spark, "odd")
    t = K.exposure_table(spark, path)
    t.upsert(rows(spark, []))
    assert t.exists() and t.read().count() == 0 and t.read().columns == DDL.replace(",", "").split()[::2]
    null = spark.createDataFrame([(None, "u", None, None, 0, 1.0), ("i1", "u", "n", None, 0, 1.0)], DDL)
    t.upsert(null)
    t.upsert(null.withColumn("clicked", F.lit(1)))
    assert sorted((str(r.impression_id), r.clicked) for r in t.read().collect()) == [("None", 1), ("i1", 1)]
    with pytest.raises(ValueError, match="clicked"):
        t.upsert(rows(spark, [7]).withColumn("clicked", F.lit("yes")))
    t.compact()
    assert t.read().count() == 2


def test_news_last_row_wins_without_an_order(spark):
    ddl = "news_id string, category string, headline string"
    path = fresh_dir(spark, "last")
    got = K.upsert_news(spark, spark.createDataFrame([("n1", "z", "first"), ("n2", "b", "x"), ("n1", "a", "last")], ddl).coalesce(1), path)
    assert sorted(tuple(r) for r in got.collect()) == [("n1", "a", "last"), ("n2", "b", "x")]
    # from files: the last file, and the last row in it
    src = fresh_dir(spark, "last-src").removeprefix("file:")
    os.makedirs(src)
    for name, lines in (("a.csv", ["n1,z,one", "n3,y,one"]), ("b.csv", ["n1,c,two", "n1,b,three"])):
        with open(os.path.join(src, name), "w") as fh:
            fh.write("\n".join(lines) + "\n")
    got = K.upsert_news(spark, spark.read.schema(ddl).csv(src), path)
    assert sorted(tuple(r) for r in got.collect()) == [("n1", "b", "three"), ("n2", "b", "x"), ("n3", "y", "one")]


def test_moved_keys_are_found_before_their_rows_are_read(spark, monkeypatch):
    t = K.exposure_table(spark, fresh_dir(spark, "moved"))
    t.upsert(rows(spark, range(5)))
    t.upsert(rows(spark, [1], day=1))
    t.upsert(rows(spark, [1, 2], day=2, clicked=1))
    got = sorted((r.impression_id, r.timestamp.day, r.clicked) for r in t.read().collect())
    assert got == [("i0", 1, 0), ("i1", 3, 1), ("i2", 3, 1), ("i3", 1, 0), ("i4", 1, 0)]
    m = t.manifest.load()
    pairs = t._lookup(m, rows(spark, [1]).select(F.xxhash64(*t.key).alias("_h"), F.lit("x").alias("_part")), {b: 20 for b in range(1 << 16)})
    assert pairs.count() >= 3 and "Aggregate" not in plan(pairs)
