"""Windowed monitoring reports W1–W4, usable on streaming and batch exposures alike.

Exact distinct counts per window cannot be kept by Spark's streaming aggregation, and keeping
each window's set of users in state (``collect_set``) would put a whole hot group into one
state row. Each report is therefore split in two Spark-native stages:

* **stage 1** (``pane_partials``): the streaming aggregation, grouped by pane (a tumbling window as
  long as the slide), report key *and* the distinct column (user or article), with the watermark
  dropping late rows and evicting old panes. An exposure is in one pane, not in the 5 or 3 windows
  that overlap there: state is one small row per (pane, key, distinct value), spread over all
  partitions by hash, so no hot key lands whole in one task. Its update-mode output is upserted
  by key into a keyed parquet table (:mod:`newsprism.streaming.runner`).
* **stage 2** (``window_partials``, ``*_report``): batch aggregations over the stage-1 rows: the
  panes of each window are summed by (window, key, distinct value), then by (window, key); sums
  and counts are combinable, so Spark pre-aggregates map-side before the shuffles and a distinct
  count is simply the number of summed rows.

Watermark: a row is late for a window once the window's end is behind the watermark, so a pane is
needed until its *last* window closes, ``size - slide`` after the pane itself. The watermark of the
panes is that much longer, which keeps a pane exactly as long as the last window it is in: a row that
any of its windows would take is counted (in all of them), a row that none would take is dropped.

On a batch DataFrame ``batch_report(E, name)`` is the whole report in one plan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions.text import headline_sentiment


@dataclass(frozen=True)
class WindowSpec:
    name: str
    key: str
    distinct: str | None
    size: str
    slide: str | None
    watermark: str
    trigger: str

    @property
    def group_columns(self) -> list[str]:
        return [self.key] + ([self.distinct] if self.distinct else [])


# Window shapes of the four monitors (fixed values: size, slide, watermark, trigger).
TREND = WindowSpec("trend", "news_id", "user_id", "5 minutes", "1 minute", "10 minutes", "30 seconds")
USER_BEHAVIOR = WindowSpec(
    "user_behavior", "user_id", "news_id", "10 minutes", "2 minutes", "15 minutes", "60 seconds"
)
ANOMALY = WindowSpec("anomaly", "news_id", "user_id", "15 minutes", "5 minutes", "20 minutes", "2 minutes")
CONTENT = WindowSpec("content", "news_id", None, "5 minutes", None, "10 minutes", "60 seconds")
SPECS = {s.name: s for s in (TREND, USER_BEHAVIOR, ANOMALY, CONTENT)}

PARTIAL_COLUMNS = ("n", "clicks", "dwell_sum", "dwell_n")
PANE = "pane"
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def seconds(duration: str) -> int:
    """``"5 minutes"`` in seconds."""
    n, unit = duration.split()
    return int(n) * _UNITS[unit.removesuffix("s")]


def pane_watermark(spec: WindowSpec) -> str:
    """The watermark of the panes: longer by what the last window of a pane ends after it."""
    extra = seconds(spec.size) - seconds(spec.slide or spec.size)
    return f"{seconds(spec.watermark) + extra} seconds"


def pane_partials(exposures: DataFrame, spec: WindowSpec) -> DataFrame:
    """Stage 1: per (pane, key[, distinct value]) exposure count, clicks and dwell sums.

    ``timestamp`` must be a TIMESTAMP (the watermark rejects TIMESTAMP_NTZ). Articles are not
    joined here: a hot article's exposures are pre-aggregated, and the report attaches the
    headline (J4) to one row per window and article.
    """
    if seconds(spec.size) % seconds(spec.slide or spec.size):
        raise ValueError(f"{spec.name}: the window must hold a whole number of slides")
    e = exposures.withWatermark("timestamp", pane_watermark(spec))
    agg = e.groupBy(F.window("timestamp", spec.slide or spec.size).alias("w"), *spec.group_columns).agg(
        F.count("impression_id").alias("n"),
        F.coalesce(F.sum("clicked"), F.lit(0)).cast("long").alias("clicks"),
        F.sum("dwell_time").alias("dwell_sum"),
        F.count("dwell_time").alias("dwell_n"),
    )
    return agg.select(F.col("w.start").alias(PANE), *spec.group_columns, *PARTIAL_COLUMNS)


def pane_key(spec: WindowSpec) -> list[str]:
    return [PANE, *spec.group_columns]


def last_pane(spec: WindowSpec, until: dt.datetime | str | None) -> dt.datetime | None:
    """Start of the last pane of the window that starts at ``until``."""
    if until is None:
        return None
    return m.as_datetime(until) + dt.timedelta(seconds=seconds(spec.size) - seconds(spec.slide or spec.size))


def window_partials(
    panes: DataFrame,
    spec: WindowSpec,
    since: dt.datetime | str | None = None,
    until: dt.datetime | str | None = None,
) -> DataFrame:
    """Stage-1 rows combined into windows: one row per (window, key[, distinct value]), of the windows
    starting in ``[since, until]``. On a monitor table read with its partition column the bounds
    prune pane-day folders, so a long-running monitor's report reads only the recent days."""
    size, slide = seconds(spec.size), seconds(spec.slide or spec.size)
    panes = m.between_inclusive(panes, PANE, since, last_pane(spec, until)).drop(m.PARTITION_COLUMN)
    starts = [F.col(PANE) - F.expr(f"interval {k} seconds") for k in range(0, size, slide)]
    start = F.explode(F.array(*starts)) if size > slide else F.col(PANE)
    rows = panes.select(start.alias("window_start"), *spec.group_columns, *PARTIAL_COLUMNS)
    rows = m.between_inclusive(rows, "window_start", since, until)
    if size > slide:
        rows = rows.groupBy("window_start", *spec.group_columns).agg(
            F.sum("n").alias("n"), F.sum("clicks").alias("clicks"), F.sum("dwell_sum").alias("dwell_sum"),
            F.sum("dwell_n").alias("dwell_n"),
        )
    end = F.col("window_start") + F.expr(f"interval {size} seconds")
    return rows.select("window_start", end.alias("window_end"), *spec.group_columns, *PARTIAL_COLUMNS)


def _totals(partials: DataFrame, spec: WindowSpec, imp: str, clk: str) -> DataFrame:
    aggs: list[Column] = [
        F.sum("n").cast("long").alias(imp),
        F.sum("clicks").cast("long").alias(clk),
        (F.sum("dwell_sum") / F.sum("dwell_n")).alias("avg_dwell_time"),
    ]
    if spec.distinct:
        aggs.append(F.count(spec.distinct).alias("_distinct"))
    return partials.groupBy("window_start", "window_end", spec.key).agg(*aggs)


def _virtual_time(df: DataFrame, as_of: dt.datetime | str | None) -> DataFrame:
    if as_of is None:
        return df
    return df.withColumn(
        "virtual_time", F.lit(m.as_datetime(as_of).strftime("%Y-%m-%d %H:%M:%S"))
    )


def trend_report(partials: DataFrame, *, as_of: dt.datetime | str | None = None) -> DataFrame:
    """Per 5-minute window (sliding by 1) and article: exposures, clicks, users, dwell,
    ``click_rate`` and ``trend_score = click_rate·0.4 + users/exposures·0.3 + dwell/100·0.3``."""
    t = _totals(partials, TREND, "impression_count", "click_count").withColumnRenamed(
        "_distinct", "unique_users"
    )
    t = t.withColumn("click_rate", m.ratio("click_count", "impression_count")).withColumn(
        "trend_score",
        F.col("click_rate") * 0.4
        + m.ratio("unique_users", "impression_count") * 0.3
        + (F.col("avg_dwell_time") / 100.0) * 0.3,
    )
    return _virtual_time(t, as_of)


def user_behavior_report(partials: DataFrame, *, as_of: dt.datetime | str | None = None) -> DataFrame:
    """Per 10-minute window (sliding by 2) and user: exposures, clicks, dwell, distinct
    articles, ``engagement_score`` and ``diversity_score``. The viewed articles themselves are
    the window partials (see :func:`viewed_news`), not a list column."""
    t = _totals(partials, USER_BEHAVIOR, "total_impressions", "total_clicks").withColumnRenamed(
        "_distinct", "unique_news_count"
    )
    imp = F.col("total_impressions")
    t = t.withColumn(
        "engagement_score",
        F.when(imp > 0, (F.col("total_clicks") * 2.0 + F.col("avg_dwell_time") / 30.0) / imp).otherwise(
            F.lit(0.0)
        ),
    ).withColumn("diversity_score", m.ratio("unique_news_count", "total_impressions"))
    return _virtual_time(t, as_of)


def viewed_news(partials: DataFrame) -> DataFrame:
    """W2 companion: the articles each user saw per window, with the number of exposures."""
    return partials.select(
        "window_start", "window_end", "user_id", "news_id", F.col("n").alias("views")
    )


def anomaly_report(partials: DataFrame, *, threshold: float = 10.0) -> DataFrame:
    """Per 15-minute window (sliding by 5) and article; ``virality_score = exposures ×
    click_rate × users / window seconds``; rows above ``threshold`` only."""
    t = _totals(partials, ANOMALY, "impressions", "clicks").withColumnRenamed("_distinct", "unique_users")
    seconds = F.col("window_end").cast("long") - F.col("window_start").cast("long")
    t = t.withColumn("click_rate", m.ratio("clicks", "impressions")).withColumn(
        "virality_score",
        F.col("impressions") * F.col("click_rate") * F.col("unique_users") / seconds.cast("double"),
    )
    return t.where(F.col("virality_score") > threshold)


def content_report(partials: DataFrame, *, news: DataFrame | None = None) -> DataFrame:
    """Per tumbling 5-minute window and article: exposures, clicks, dwell,
    ``engagement_rate``; with ``news`` also the article's ``headline`` (J4) and
    ``headline_sentiment`` (U1). A headline that changes does not split or lose exposures."""
    t = partials.groupBy("window_start", "window_end", "news_id").agg(
        F.sum("n").cast("long").alias("impressions"),
        F.sum("clicks").cast("long").alias("clicks"),
        (F.sum("dwell_sum") / F.sum("dwell_n")).alias("avg_dwell_time"),
    )
    t = t.withColumn("engagement_rate", m.ratio("clicks", "impressions"))
    if news is not None:
        t = t.join(news.select("news_id", "headline"), "news_id", "left").withColumn(
            "headline_sentiment", headline_sentiment(F.col("headline"))
        )
    return t


REPORTS = {
    "trend": trend_report,
    "user_behavior": user_behavior_report,
    "anomaly": anomaly_report,
    "content": content_report,
}


def batch_report(exposures: DataFrame, name: str, **kwargs) -> DataFrame:
    """The full report on a batch DataFrame (``timestamp`` as TIMESTAMP)."""
    spec = SPECS[name]
    return REPORTS[name](window_partials(pane_partials(exposures, spec), spec), **kwargs)


def monitor_report(
    panes: DataFrame, name: str, *, since: dt.datetime | str | None = None,
    until: dt.datetime | str | None = None, **kwargs,
) -> DataFrame:
    """The report of monitor ``name`` over its stage-1 rows (``table.read()``)."""
    return REPORTS[name](window_partials(panes, SPECS[name], since, until), **kwargs)
