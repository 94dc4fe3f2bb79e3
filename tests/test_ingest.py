"""Ingest transforms and keyed upserts on hand-made rows."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from newsprism.operators import ingest as I
from newsprism.session import fresh_dir
from newsprism.sinks import keyed as K


def test_explode_uneven_lists_and_blanks(spark):
    raw = spark.createDataFrame(
        [
            ("imp_1", "U1", " N1  N2 N3 ", "30 40", "N4  N5", "2019-06-20 10:00:00"),
            ("imp_2", "U2", "N6", "12 99", "", "2019-06-20T11:00:00"),
            ("imp_3", "U3", "", "", None, "not a time"),
            ("imp_4", "U4", "N7", "8", None, "6/19/2019 5:10:01 PM"),
        ],
        "impression_id string, UserID string, pos string, dwelltime_pos string, neg string, start string",
    )
    got = sorted(
        (r.impression_id, r.news_id, r.clicked, r.dwell_time, r.timestamp)
        for r in I.explode_impressions(raw).collect()
    )
    t1, t2 = dt.datetime(2019, 6, 20, 10), dt.datetime(2019, 6, 20, 11)
    assert got == [
        ("imp_1", "N1", 1, 30.0, t1),
        ("imp_1", "N2", 1, 40.0, t1),  # N3 has no dwell → dropped (pairing stops)
        ("imp_1", "N4", 0, 0.0, t1),
        ("imp_1", "N5", 0, 0.0, t1),
        ("imp_2", "N6", 1, 12.0, t2),  # extra dwell value ignored
        ("imp_4", "N7", 1, 8.0, dt.datetime(2019, 6, 19, 17, 10, 1)),
    ]


def test_parse_json_malformed_and_bad_times(spark):
    msgs = spark.createDataFrame(
        [
            ('{"impression_id":"i1","user_id":"u","news_id":"n","timestamp":"2019-07-03 06:43:49","clicked":1,"dwell_time":34}',),
            ('{"impression_id":"i2","user_id":"u","news_id":"n","timestamp":"yesterday","clicked":0}',),
            ("not json at all",),
            ('{"impression_id":"i3"',),
        ],
        "value string",
    )
    parsed = I.cast_event_times(I.parse_json_records(msgs))
    got = {r.impression_id: r for r in parsed.collect()}
    assert set(got) == {"i1", "i2"}
    assert got["i1"].timestamp == dt.datetime(2019, 7, 3, 6, 43, 49)
    assert got["i1"].dwell_time == 34.0
    assert got["i2"].timestamp is None and got["i2"].dwell_time is None
    assert I.parse_json_records(msgs, keep_malformed=True).where(F.col("_corrupt_record").isNotNull()).count() == 2


def test_latest_by_key_and_ids(spark):
    df = spark.createDataFrame(
        [("k1", 1, "a"), ("k1", 3, "b"), ("k1", 2, "c"), ("k2", 5, "x"), ("k2", 5, "y")],
        "k string, seq int, v string",
    )
    got = {r.k: r.v for r in I.latest_by_key(df, ["k"], ["seq"]).collect()}
    assert got == {"k1": "b", "k2": "y"}  # ties fall to the larger remaining value

    raw = spark.range(0, 1000, numPartitions=7).withColumn("o", (F.col("id") * 7919) % 1000)
    ids = I.assign_impression_ids(raw, order_by=["o"]).collect()
    assert sorted(r._seq for r in ids) == list(range(1, 1001))
    assert all(r.impression_id == f"imp_{r.o + 1:07d}" for r in ids)
    first = I.first_n_impressions(
        spark.createDataFrame(
            [("U1", "N1", "5", "N2", "2019-06-20 10:00:00", 1), ("U2", "N3", "1", "", "2019-06-20 10:00:00", 2)],
            "UserID string, pos string, dwelltime_pos string, neg string, start string, _seq long",
        ).withColumn("impression_id", F.format_string("imp_%07d", "_seq")),
        1,
    )
    assert sorted(r.news_id for r in first.collect()) == ["N1", "N2"]


def _exposures(spark, rows):
    return spark.createDataFrame(
        rows,
        "impression_id string, user_id string, news_id string, timestamp timestamp, clicked int, dwell_time double, seq int",
    )


def test_upsert_exposures_replace_move_and_replay(spark):
    path = fresh_dir(spark, "test-exposures")
    d1, d2 = dt.datetime(2019, 6, 20, 10), dt.datetime(2019, 6, 21, 9)
    b1 = _exposures(spark, [("i1", "u", "n1", d1, 0, 0.0, 1), ("i1", "u", "n2", d1, 0, 0.0, 1), ("i2", "u", "n1", d1, 1, 5.0, 1)])
    K.upsert_exposures(spark, b1, path, order=["seq"], drop=["seq"])
    # batch 2: i1/n1 clicked (two versions, last wins) and i2 moves to the next day
    b2 = _exposures(
        spark,
        [("i1", "u", "n1", d1, 1, 9.0, 2), ("i1", "u", "n1", d1, 1, 7.0, 3), ("i2", "u", "n1", d2, 1, 6.0, 2)],
    )
    out = K.upsert_exposures(spark, b2, path, order=["seq"], drop=["seq"])
    got = sorted((r.impression_id, r.news_id, r.timestamp, r.clicked, r.dwell_time) for r in out.collect())
    expected = [("i1", "n1", d1, 1, 7.0), ("i1", "n2", d1, 0, 0.0), ("i2", "n1", d2, 1, 6.0)]
    assert got == expected
    assert "seq" not in out.columns
    # replaying the same batch leaves the table unchanged
    again = K.upsert_exposures(spark, b2, path, order=["seq"], drop=["seq"])
    assert sorted((r.impression_id, r.news_id, r.timestamp, r.clicked, r.dwell_time) for r in again.collect()) == expected


def test_upsert_news(spark):
    path = fresh_dir(spark, "test-news")
    ddl = "news_id string, category string, headline string"
    K.upsert_news(spark, spark.createDataFrame([("n1", "a", "old"), ("n2", "b", "keep")], ddl), path)
    out = K.upsert_news(spark, spark.createDataFrame([("n1", "a", "new"), ("n3", "c", "add")], ddl), path)
    assert sorted((r.news_id, r.headline) for r in out.collect()) == [("n1", "new"), ("n2", "keep"), ("n3", "add")]


def test_upsert_moving_the_last_row_out_of_a_partition(spark):
    path = fresh_dir(spark, "test-move")
    d1, d2 = dt.datetime(2019, 6, 20, 10), dt.datetime(2019, 6, 22, 9)
    K.upsert_exposures(spark, _exposures(spark, [("i9", "u", "n1", d1, 0, 0.0, 1)]), path, order=["seq"], drop=["seq"])
    out = K.upsert_exposures(spark, _exposures(spark, [("i9", "u", "n1", d2, 1, 3.0, 2)]), path, order=["seq"], drop=["seq"])
    assert [(r.impression_id, r.timestamp) for r in out.collect()] == [("i9", d2)]
    assert K.exposure_log(spark, path).count() == 1
    # the emptied day can be filled again later
    out = K.upsert_exposures(spark, _exposures(spark, [("i8", "u", "n1", d1, 0, 0.0, 1)]), path, order=["seq"], drop=["seq"])
    assert sorted(r.impression_id for r in out.collect()) == ["i8", "i9"]


def test_upsert_leaves_no_staging_folders(spark):
    """An upsert's staging folders are removed once the table write is done."""
    import os

    from newsprism.session import shared_dir

    def staging():
        return {d for d in os.listdir(shared_dir(spark).removeprefix("file:")) if d.startswith("staging-")}

    before = staging()
    ddl = "news_id string, category string, topic string, headline string, news_body string"
    path = fresh_dir(spark, "news-staging")
    K.upsert_news(spark, spark.createDataFrame([("n1", "a", "t", "h", "b")], ddl), path)
    out = K.upsert_news(spark, spark.createDataFrame([("n1", "c", "t", "h2", "b2"), ("n2", "a", "t", "h", "b")], ddl), path)
    assert sorted((r.news_id, r.category) for r in out.collect()) == [("n1", "c"), ("n2", "a")]
    assert staging() == before


def test_upsert_keeps_rows_without_a_time(spark):
    """Rows with a NULL timestamp live in the NULL partition; a later upsert into that partition
    keeps the rows already there."""
    path = fresh_dir(spark, "test-null-part")
    d1 = dt.datetime(2019, 6, 20, 10)
    K.upsert_exposures(spark, _exposures(spark, [("i1", "u", "n1", None, 0, 0.0, 1), ("i2", "u", "n1", d1, 1, 2.0, 1)]), path, order=["seq"], drop=["seq"])
    out = K.upsert_exposures(spark, _exposures(spark, [("i3", "u", "n1", None, 1, 4.0, 1)]), path, order=["seq"], drop=["seq"])
    got = sorted((r.impression_id, r.timestamp, r.clicked) for r in out.collect())
    assert got == [("i1", None, 0), ("i2", d1, 1), ("i3", None, 1)]


def test_failed_write_and_replay_lose_nothing(spark, monkeypatch):
    path = fresh_dir(spark, "test-replay")
    d = dt.datetime(2019, 6, 20, 10)
    t = K.exposure_table(spark, path)
    old = [(f"i{k}", "u", "n1", d, 0, 0.0, 1) for k in range(5)]
    t.upsert(_exposures(spark, old), order=["seq"], drop=["seq"], name="first")
    new = _exposures(spark, [("i0", "u", "n1", d, 1, 9.0, 2), ("i9", "u", "n1", d, 0, 0.0, 2)])
    write = t._write

    def broken(df, folder):
        df.limit(1).write.mode("overwrite").partitionBy("_part").parquet(f"{path}/{folder}")
        raise OSError("the write failed midway")

    monkeypatch.setattr(t, "_write", broken)
    with pytest.raises(OSError):
        t.upsert(new, order=["seq"], drop=["seq"], name="second")
    assert t.read().count() == 5 and t.read().where("clicked = 1").count() == 0
    monkeypatch.setattr(t, "_write", write)
    for _ in range(2):  # the replay, and a replay of the replay
        t.upsert(new, order=["seq"], drop=["seq"], name="second")
        assert sorted((r.impression_id, r.clicked) for r in t.read().collect()) == [
            ("i0", 1), ("i1", 0), ("i2", 0), ("i3", 0), ("i4", 0), ("i9", 0)]
    assert [len(b) for b in t.batches().values()] == [2]
    t.compact()
    assert [len(b) for b in t.batches().values()] == [1] and t.read().count() == 6


def test_new_columns_and_last_row_of_a_batch(spark):
    path = fresh_dir(spark, "test-columns")
    K.upsert_news(spark, spark.createDataFrame([("n1", "a")], "news_id string, category string"), path)
    rows = [("n2", "b", "x", 1), ("n2", "b", "y", 2)]
    out = K.upsert_news(
        spark, spark.createDataFrame(rows, "news_id string, category string, title_entity string, seq int"), path,
        order=["seq"], drop=["seq"])
    assert sorted((r.news_id, r.title_entity) for r in out.collect()) == [("n1", None), ("n2", "y")]


def test_missing_header_column_raises(spark):
    from newsprism.sources import files as S

    path = fresh_dir(spark, "tsv")
    S.write_tsv(spark.createDataFrame([("a", "b")], "`News ID` string, Category string"), path)
    with pytest.raises(ValueError, match="Topic"):
        S.read_news_tsv(spark, path)


def test_stored_reports_prune_partitions(spark, capsys):
    from newsprism.plans import reports as R

    path = fresh_dir(spark, "prune")
    rows = [(f"i{k}", "u", "n1", dt.datetime(2019, 6, 1 + k, 10), 1, 1.0, 1) for k in range(10)]
    for part in (rows[:5], rows[5:]):  # two batches: the filter goes below the resolution
        K.upsert_exposures(spark, _exposures(spark, part), path, order=["seq"], drop=["seq"])
    e = K.exposure_log(spark, path)
    n = spark.createDataFrame([("n1", "c", "t", "h", "b")], "news_id string, category string, topic string, headline string, news_body string")
    for df in (R.hot_news(e, n, as_of="2019-06-10T12:00:00", hours=24, min_impressions=1),
               R.recommend_cold_start(e, n, as_of="2019-06-10T12:00:00", min_impressions=1)):
        df.explain("formatted")
        assert "PartitionFilters: [isnotnull(_part" in capsys.readouterr().out
        assert df.first().impressions == 1
