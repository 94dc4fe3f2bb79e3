"""The production path: bindings loaded once into the keyed layout, reports over stored tables.

``load_bindings`` is the ETL step (K1/K2 first loads: range-clustered, time-partitioned
exposures; hash-bucketed articles). ``STORED_REPORTS`` are the headline reports run on the
stored tables, where time ranges prune partition folders.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession

from ..sinks import keyed as K
from ..sources import bindings as B
from . import reports as R


def load_bindings(spark: SparkSession, sf_dir: str, root: str) -> dict[str, float]:
    """Write both bindings under ``root``; returns seconds per table."""
    import time

    jobs = {
        "event_exposures": lambda p: K.exposure_table(spark, p, grain="day").upsert(B.event_exposures(spark, sf_dir)),
        "event_news": lambda p: K.news_table(spark, p).upsert(B.event_news(spark, sf_dir)),
        "order_exposures": lambda p: K.exposure_table(spark, p, grain="month").upsert(B.order_exposures(spark, sf_dir)),
        "order_news": lambda p: K.news_table(spark, p).upsert(B.order_news(spark, sf_dir)),
    }
    took = {}
    for name, job in jobs.items():
        t0 = time.perf_counter()
        job(os.path.join(root, name))
        took[name] = round(time.perf_counter() - t0, 4)
    return took


def open_stored(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {
        "ee": K.exposure_log(spark, os.path.join(root, "event_exposures")),
        "en": K.news_table(spark, os.path.join(root, "event_news")).read(),
        "oe": K.exposure_log(spark, os.path.join(root, "order_exposures")),
        "on": K.news_table(spark, os.path.join(root, "order_news")).read(),
    }


STORED_REPORTS = {
    "news_lifecycle": lambda t: R.news_lifecycle(t["ee"], news_id="N7"),
    "category_trends": lambda t: R.category_trends(
        t["oe"], t["on"], start=dt.datetime(1997, 1, 1), end=dt.datetime(1997, 3, 31)
    ),
    "category_trends_event": lambda t: R.category_trends(t["ee"], t["en"]),
    "user_interests": lambda t: R.user_interests(t["oe"], t["on"]),
    "hot_news": lambda t: R.hot_news(t["oe"], t["on"], as_of=dt.datetime(2001, 8, 1), hours=8760, min_impressions=4),
    "hot_news_event": lambda t: R.hot_news(t["ee"], t["en"], as_of=dt.datetime(2024, 1, 31), hours=240, min_impressions=20),
    "recommend": lambda t: R.recommend(t["ee"], t["en"], user="U5", as_of=dt.datetime(2024, 1, 31)),
    "recommend_order": lambda t: R.recommend(t["oe"], t["on"], user="U5", as_of=dt.datetime(2001, 8, 1)),
    "overview": lambda t: R.overview(
        t["oe"], t["on"], as_of=dt.datetime(2001, 8, 1), start=dt.datetime(1997, 1, 1),
        end=dt.datetime(1997, 3, 31), trending_hours=8760, trending_min_impressions=4,
    ),
    "insights_overview": lambda t: R.insights_overview(t["ee"], as_of=dt.datetime(2024, 1, 15, 12), hours=24),
    "insights_trending": lambda t: R.insights_trending(t["ee"], as_of=dt.datetime(2024, 1, 15, 12), hours=24),
    "popular_news": lambda t: R.popular_news(t["ee"], t["en"]),
}
