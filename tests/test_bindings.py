"""The order binding on large tables: tasks by rows, the same rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsprism.operators import ingest as I
from newsprism.plans import reports as R
from newsprism.sinks import keyed as K
from newsprism.sources import bindings as B
from newsprism.session import fresh_dir

LINES = "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_linenumber int, l_shipdate date, l_extendedprice double"


@pytest.fixture
def tables(spark, tmp_path):
    d = str(tmp_path)
    lines = [(o, p, float(p), "R" if (o + p) % 3 else "N") for o in range(60) for p in (1, 2, 2, 3)]
    lines += [(7, None, 1.0, "R"), (None, 1, 1.0, "N"), (8, 9, None, None)]
    lines = [(*x, i % 5, dt.date(1997, 1, 1 + i % 9), float(i)) for i, x in enumerate(lines)]
    spark.createDataFrame(lines, LINES).write.parquet(f"{d}/lineitem.parquet")
    orders = [(o, None if o == 5 else o % 7, "1997-01-02 00:00:00") for o in [*range(50), 3]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, t string").select(
        "o_orderkey", "o_custkey", F.col("t").cast("timestamp_ntz").alias("o_orderdate")
    ).write.parquet(f"{d}/orders.parquet")
    parts = [(p, f"Brand#{p % 2}", "T", f"part {p}") for p in (1, 2, 3, 9)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_name string").write.parquet(f"{d}/part.parquet")
    return d


def held(df):
    return sorted(df.collect(), key=repr)


def test_large_order_tables_are_dealt_by_rows(spark, tables, monkeypatch):
    small = [held(B.order_exposures(spark, tables)), held(B.order_raw_impressions(spark, tables))]
    assert B.order_tasks(spark, tables) is None
    monkeypatch.setattr(B, "TASK_ROWS", 10)
    tasks = B.order_tasks(spark, tables)
    assert tasks == 25
    exposures, raw = B.order_exposures(spark, tables), B.order_raw_impressions(spark, tables)
    assert [held(exposures), held(raw)] == small
    # AQE would join partitions this small into one
    assert exposures.rdd.getNumPartitions() == raw.rdd.getNumPartitions() == tasks
    # the raw impressions take the partitioning of the join on
    plan = raw._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") <= 2


def test_user_interests_dealt_by_group_and_impression(spark, tables):
    e, n = B.order_exposures(spark, tables), B.order_news(spark, tables)
    got = R.user_interests(e, n, tasks=25)
    assert held(got) == held(R.user_interests(e, n))
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "impression_id" in x]
    assert len(dealt) == 1 and ", 25)" in dealt[0]


def test_key_index_holds_a_pair_once(spark, monkeypatch):
    monkeypatch.setattr(K, "KEYS_PER_BUCKET", 4)
    t = K.exposure_table(spark, fresh_dir(spark, "index"))
    pairs = spark.createDataFrame([(h, p) for h in range(20) for p in ("a", "a", "b", None, None)], "_h long, _part string")
    folder, about = t._write_index(pairs.repartition(5), 20)
    found = spark.read.schema("_h long, _part string").option("recursiveFileLookup", "true").parquet(f"{t.path}/{folder}")
    assert about["buckets"] > 1 and held(found) == held(pairs.distinct())


def test_order_lines_are_collapsed_where_they_are_joined(spark, tables, monkeypatch):
    keys, order = ["impression_id", "user_id", "news_id"], ["l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice"]
    lines = B.order_lines(spark, tables)
    small = held(lines)
    li, od = B.table(spark, tables, "lineitem"), B.table(spark, tables, "orders")
    assert len(small) == li.join(od, li.l_orderkey == od.o_orderkey).count()
    best = {}
    for r in small:
        k, v = tuple(r[c] for c in keys), tuple((r[c] is not None, r[c]) for c in order)
        if k not in best or v > best[k]:
            best[k] = v
    monkeypatch.setattr(B, "TASK_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = I.latest_by_key(B.order_lines(spark, tables), keys, order)
        rows = got.collect()
        assert {tuple(r[c] for c in keys): tuple((r[c] is not None, r[c]) for c in order) for r in rows} == best
        assert len(rows) == len(best) and held(B.order_lines(spark, tables)) == small
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
