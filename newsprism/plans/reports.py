"""Batch reports over the exposure (``E``), news (``N``) tables: DataFrame in, DataFrame out.

Every report is lazy (no action inside unless stated), takes keyword-only parameters and an
explicit ``as_of`` instead of a wall clock. Ties are broken by the entity key so results are
deterministic. Shuffle notes per report are in the docstrings.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..session import scratch_dir

# Data-set bounds used by the dashboard range defaults (fixed values of the reference
# data set; callers pass their own for other data).
DATASET_START = dt.datetime(2019, 6, 14)
DATASET_END = dt.datetime(2019, 7, 5)


# --------------------------------------------------------------------------- R1 / R2
def news_lifecycle(
    exposures: DataFrame,
    *,
    news_id: str,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    exact: bool = True,
) -> DataFrame:
    """Hourly time series of one article (hours without exposures are absent)."""
    e = exposures.where((F.col("news_id") == news_id) & F.col("timestamp").isNotNull())
    e = m.between_inclusive(e, "timestamp", start, end)
    return (
        e.groupBy(m.trunc_like("hour", "timestamp", e).alias("timestamp"))
        .agg(
            m.impressions(exact).alias("impressions"),
            m.clicks().alias("clicks"),
            m.avg_dwell().alias("avg_dwell_time"),
            m.unique_users(exact).alias("unique_users"),
        )
        .withColumn("click_rate", m.ratio("clicks", "impressions"))
        .orderBy("timestamp")
    )


def lifecycle_summary(lifecycle: DataFrame) -> DataFrame:
    """R2: totals of an R1 series: impressions, clicks, CTR in percent, peak hourly impressions."""
    agg = lifecycle.agg(
        F.coalesce(F.sum("impressions"), F.lit(0)).cast("long").alias("total_impressions"),
        F.coalesce(F.sum("clicks"), F.lit(0)).cast("long").alias("total_clicks"),
        F.coalesce(F.max("impressions"), F.lit(0)).cast("long").alias("peak_impressions"),
        F.count(F.lit(1)).alias("hours"),
    )
    ctr = F.when(
        F.col("total_impressions") > 0,
        F.col("total_clicks") / F.col("total_impressions") * 100.0,
    ).otherwise(F.lit(0.0))
    return agg.withColumn("ctr", ctr)


# --------------------------------------------------------------------------- R3 / R4
def category_trends(
    exposures: DataFrame,
    news: DataFrame,
    *,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    exact: bool = True,
) -> DataFrame:
    """Per category and day: impressions, clicks, users, articles, click rate.

    Clicks and articles need no distinct count over exposures: they are summed per (article, day)
    first, so one row per article and day meets the article table. Impressions and users are kept
    once per (category, day, value), with map-side partial aggregation before the shuffle, so a
    hot category-day is pre-combined; only ``news_id`` / ``category`` of the article table reach the
    joins. With ``exact=False`` one pass over the joined rows keeps sketches instead.
    """
    e = m.between_inclusive(exposures, "timestamp", start, end)
    e = e.withColumn("date", m.trunc_like("day", "timestamp", e))
    categories = news.select("news_id", "category")
    if not exact:
        t = e.join(categories, "news_id").groupBy("category", "date").agg(
            m.impressions(exact).alias("impressions"), m.clicks().alias("clicks"),
            m.unique_users(exact).alias("unique_users"), m.unique_news(exact).alias("unique_news"))
    else:
        per_article = e.groupBy("news_id", "date").agg(F.sum("clicked").alias("clicks"))
        sums = per_article.join(categories, "news_id").groupBy("category", "date").agg(
            F.sum("clicks").alias("clicks"), F.count("news_id").alias("unique_news"))
        seen = e.select("news_id", "date", "impression_id", "user_id").join(categories, "news_id")
        distinct = seen.groupBy("category", "date").agg(
            m.impressions().alias("impressions"), m.unique_users().alias("unique_users"))
        # one row of each side per category and day; NULL categories are a group as any other
        t = sums.unionByName(distinct, allowMissingColumns=True).groupBy("category", "date").agg(
            F.max("impressions").alias("impressions"),
            F.coalesce(F.max("clicks"), F.lit(0)).cast("long").alias("clicks"),
            F.max("unique_users").alias("unique_users"), F.max("unique_news").alias("unique_news"))
    return t.withColumn("click_rate", m.ratio("clicks", "impressions")).orderBy(
        F.col("click_rate").desc(), "category", "date")


ROLLUP_METRICS = ("impressions", "clicks", "ctr")


def category_rollup(trends: DataFrame, *, metric: str = "impressions") -> DataFrame:
    """Per category sums of the daily R3 rows, CTR in percent, 1-based rank by ``metric``.

    The rank window has no partition key, but it runs on the already aggregated rows, one per
    category, so its input is bounded by the category domain, not by the data volume.
    """
    if metric not in ROLLUP_METRICS:
        raise ValueError(f"metric must be one of {ROLLUP_METRICS}")
    agg = trends.groupBy("category").agg(
        F.sum("impressions").cast("long").alias("impressions"),
        F.sum("clicks").cast("long").alias("clicks"),
    )
    agg = agg.withColumn(
        "ctr",
        F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions") * 100.0).otherwise(
            F.lit(0.0)
        ),
    )
    w = Window.orderBy(F.col(metric).desc(), F.col("category"))
    return agg.withColumn("rank", F.row_number().over(w).cast("long"))


# --------------------------------------------------------------------------- R5 / R6 / R7
def user_interests(
    exposures: DataFrame,
    news: DataFrame,
    *,
    user: str | None = None,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    exact: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """Per user, category and topic: impressions, clicks, mean dwell, engagement score.

    ``tasks``: among how many tasks the rows of the distinct count are dealt, by group and
    impression (a large group is split); without it Spark's settings decide.
    """
    e = exposures if user is None else exposures.where(F.col("user_id") == user)
    e = m.between_inclusive(e, "timestamp", start, end)
    j = e.join(news.select("news_id", "category", "topic"), "news_id")
    if tasks is not None:
        j = j.select("user_id", "category", "topic", "impression_id", "clicked", "dwell_time").repartition(
            tasks, "user_id", "category", "topic", "impression_id")
    return (
        j.groupBy("user_id", "category", "topic")
        .agg(
            m.impressions(exact).alias("impressions"),
            m.clicks().alias("clicks"),
            m.avg_dwell().alias("avg_dwell_time"),
        )
        .where(F.col("impressions") > 0)
        .withColumn(
            "engagement_score", m.engagement_score("clicks", "avg_dwell_time", "impressions")
        )
    )


def interest_timeline(
    exposures: DataFrame,
    news: DataFrame,
    *,
    user: str,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    categories: list[str] | None = None,
    wide: bool = False,
) -> DataFrame:
    """Per day and category the user's clicks, zero-filled over the user's days × categories.

    Built as a pivot (one row per day, one column per category, missing cells 0), which is the
    map the dashboard draws; ``wide=False`` unpivots it back to ``(timestamp, category,
    interest)``, so the zero-filled grid appears without a cross join. The long form without
    ``categories`` needs no lookup: the user's days and categories are gathered as one array a
    user (bounded by the calendar and the category domain); the wide form needs ``categories``,
    which name its columns.
    """
    e = exposures.where(F.col("user_id") == user)
    e = m.between_inclusive(e, "timestamp", start, end)
    j = e.join(news.select("news_id", "category"), "news_id").where(F.col("category").isNotNull())
    j = j.withColumn("timestamp", m.trunc_like("day", "timestamp", j))
    if categories is None:
        if wide:
            raise ValueError("the wide timeline needs the categories: they are its columns")
        cells = j.groupBy("timestamp", "category").agg(F.sum("clicked").alias("v"))
        days = cells.groupBy("timestamp").agg(F.map_from_entries(F.collect_list(
            F.struct("category", F.coalesce("v", F.lit(0)).alias("v")))).alias("by"))
        days = days.withColumn("all", F.collect_set(F.map_keys("by")).over(Window.partitionBy()))
        domain = F.array_distinct(F.flatten("all"))
        return days.withColumn("category", F.explode(domain)).select(
            "timestamp", "category",
            F.coalesce(F.col("by")[F.col("category")], F.lit(0)).cast("long").alias("interest"),
        ).orderBy("timestamp", "category")
    grid = j.groupBy("timestamp").pivot("category", categories).agg(
        F.coalesce(F.sum("clicked"), F.lit(0)).cast("long")
    )
    grid = grid.na.fill(0, subset=list(categories))
    if wide:
        return grid.orderBy("timestamp")
    if not categories:
        return j.select("timestamp", "category", F.lit(0).cast("long").alias("interest")).limit(0)
    return grid.unpivot(
        ["timestamp"], list(categories), "category", "interest"
    ).orderBy("timestamp", "category")


def interest_stats(timeline: DataFrame, *, top_n: int = 5, rising_n: int = 3) -> DataFrame:
    """Per category over an R6 (long) timeline: total, occurrences, average, trend.

    ``trend`` = value of the latest day − value of the earliest day. ``top_rank`` ranks by
    average (kept for the first ``top_n``), ``rising_rank`` ranks rising categories (trend > 0)
    by trend (first ``rising_n``). Ranks run over one row per category.
    """
    stats = timeline.groupBy("category").agg(
        F.sum("interest").cast("long").alias("total"),
        F.count(F.lit(1)).alias("occurrences"),
        (F.max_by("interest", "timestamp") - F.min_by("interest", "timestamp"))
        .cast("long")
        .alias("trend"),
    )
    stats = stats.withColumn("average", m.ratio("total", "occurrences"))
    top = F.row_number().over(Window.orderBy(F.col("average").desc(), "category")).cast("long")
    # the rising list is a stable re-sort of the list by average: ties go by average, then name
    rising_order = Window.orderBy(
        (F.col("trend") > 0).desc(), F.col("trend").desc(), F.col("average").desc(), "category"
    )
    rising = F.row_number().over(rising_order).cast("long")
    return (
        stats.withColumn("top_rank", F.when(top <= top_n, top))
        .withColumn("rising_rank", F.when((F.col("trend") > 0) & (rising <= rising_n), rising))
    )


# --------------------------------------------------------------------------- R8
def hot_news(
    exposures: DataFrame,
    news: DataFrame,
    *,
    as_of: dt.datetime | str,
    hours: float = 24,
    min_impressions: int = 50,
    limit: int = 50,
    bounded: bool = True,
    exact: bool = True,
) -> DataFrame:
    """Articles with at least ``min_impressions`` in the last ``hours`` before ``as_of``.

    Aggregates exposures by ``news_id`` before joining the articles (``news_id`` is the
    article key, so this equals grouping the joined rows), keeps the article body out of the
    shuffle and the top-k, and attaches it to the ``limit`` winners only. ``bounded=False``
    drops the ``timestamp <= as_of`` bound (rows after ``as_of`` then count too).
    """
    as_of = m.as_datetime(as_of)
    cutoff = as_of - dt.timedelta(hours=hours)
    e = m.between_inclusive(exposures, "timestamp", cutoff, as_of if bounded else None)
    per_news = (
        e.groupBy("news_id")
        .agg(
            m.impressions(exact).alias("impressions"),
            m.clicks().alias("clicks"),
            m.unique_users(exact).alias("unique_users"),
            m.avg_dwell().alias("avg_dwell_time"),
        )
        .where(F.col("impressions") >= min_impressions)
    )
    ranked = (
        per_news.join(news.select("news_id", "category", "topic", "headline"), "news_id")
        .withColumn("click_rate", m.ratio("clicks", "impressions"))
        .withColumn("user_diversity", m.ratio("unique_users", "impressions"))
        .orderBy(F.col("click_rate").desc(), F.col("news_id"))
        .limit(limit)
    )
    hotness = (
        F.col("click_rate") * 0.4
        + F.col("user_diversity") * 0.3
        + F.least(F.col("avg_dwell_time") / 100.0, F.lit(1.0)) * 0.3
    )
    return (
        ranked.join(news.select("news_id", "news_body"), "news_id")
        .withColumn("hotness_score", hotness)
        .select(
            "news_id", "category", "topic", "headline", "news_body", "impressions", "clicks",
            "unique_users", "avg_dwell_time", "click_rate", "user_diversity", "hotness_score",
        )
        .orderBy(F.col("click_rate").desc(), F.col("news_id"))
    )


# --------------------------------------------------------------------------- R9 – R12
def user_preferences(
    exposures: DataFrame, news: DataFrame, *, user: str, limit: int = 5
) -> DataFrame:
    """The user's top (category, topic) pairs by number of clicked exposures."""
    clicked = exposures.where((F.col("user_id") == user) & (F.col("clicked") == 1))
    return (
        clicked.join(news.select("news_id", "category", "topic"), "news_id")
        .groupBy("category", "topic")
        .agg(F.count("clicked").alias("clicks"))
        .orderBy(F.col("clicks").desc(), "category", "topic")
        .limit(limit)
    )


def recommend_for_preferences(
    exposures: DataFrame,
    news: DataFrame,
    *,
    user: str,
    limit: int = 10,
    until: dt.datetime | str | None = None,
    preferences: list[tuple[str, str]] | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Unseen articles in the user's preferred categories and topics, by click rate.

    Category and topic filters are applied independently (any preferred category combined
    with any preferred topic). ``preferences`` are the user's R9 rows as (category, topic)
    pairs when the caller already has them (``recommend`` does): they become two IN-lists of
    at most 5 literals each, which reach the article scan as pushed filters. Without them the
    R9 plan is joined in (semi joins against its ≤ 5 rows). Articles the user was ever shown
    are removed with an anti join (never SQL ``NOT IN``). Exposures are reduced to the
    candidate articles by a semi join before the per-article aggregation. ``until``
    optionally ignores exposures after that time (off by default). With ``totals`` (per article
    ``n``, ``clicks``, ``rated``: a maintained aggregate) the exposures are only read for the user,
    so they may be the user's own.
    """
    if totals is not None and until is not None:
        raise ValueError("totals are over all time: they cannot be cut at until")
    e = m.between_inclusive(exposures, "timestamp", None, until)
    articles = news.select("news_id", "category", "topic", "headline")
    if preferences is None:
        prefs = user_preferences(e, news, user=user)
        preferred = articles.join(prefs.select("category"), "category", "left_semi").join(
            prefs.select("topic"), "topic", "left_semi"
        )
    else:
        # NULL never equals anything, as in the semi joins: leave it out of the lists
        categories = sorted({c for c, _ in preferences if c is not None})
        topics = sorted({t for _, t in preferences if t is not None})
        preferred = articles.where(F.col("category").isin(categories) & F.col("topic").isin(topics))
    # distinct first: a very active user's rows collapse map-side to one per article
    seen = e.where(F.col("user_id") == user).select("news_id").distinct()
    candidates = preferred.join(seen, "news_id", "left_anti")
    if totals is not None:
        stats = totals.select(
            "news_id", F.col("n").alias("popularity"), m.ratio("clicks", "rated").alias("predicted_interest"))
    else:
        stats = (
            e.join(candidates.select("news_id"), "news_id", "left_semi")
            .groupBy("news_id")
            .agg(
                m.impressions().alias("popularity"),
                F.coalesce(F.avg(F.col("clicked").cast("double")), F.lit(0.0)).alias(
                    "predicted_interest"
                ),
            )
        )
    return (
        candidates.join(stats, "news_id")
        .select("news_id", "category", "topic", "headline", "popularity", "predicted_interest")
        .orderBy(F.col("predicted_interest").desc(), F.col("popularity").desc(), "news_id")
        .limit(limit)
    )


def preference_pairs(
    exposures: DataFrame, news: DataFrame, *, user: str, until: dt.datetime | str | None = None
) -> list[tuple[str, str]]:
    """The user's R9 (category, topic) pairs on the driver: one job, at most 5 rows."""
    e = m.between_inclusive(exposures, "timestamp", None, until)
    return [(r["category"], r["topic"]) for r in user_preferences(e, news, user=user).collect()]


def recommend(
    exposures: DataFrame,
    news: DataFrame,
    *,
    user: str,
    as_of: dt.datetime | str,
    limit: int = 10,
    until: dt.datetime | str | None = None,
    cold_hours: float = 6,
    cold_min_impressions: int = 50,
) -> DataFrame:
    """R10 with the R11 cold start: a user without preferences (no clicked article) gets the
    current hot news.

    The user's top-5 preferences are fetched first (a bounded job); they are handed to R10 as
    literals, so the user's clicks are not scanned twice. Both branches have R10's columns; a
    cold-start row has its impressions as ``popularity`` and no ``predicted_interest`` (use
    :func:`recommend_cold_start` for all of R8's columns).
    """
    prefs = preference_pairs(exposures, news, user=user, until=until)
    if prefs:
        return recommend_for_preferences(
            exposures, news, user=user, limit=limit, until=until, preferences=prefs
        )
    cold = recommend_cold_start(
        exposures, news, as_of=as_of, limit=limit, hours=cold_hours,
        min_impressions=cold_min_impressions,
    )
    return as_recommendations(cold)


def as_recommendations(cold: DataFrame) -> DataFrame:
    """Cold-start rows with the columns of R10."""
    return cold.select(
        "news_id", "category", "topic", "headline", F.col("impressions").alias("popularity"),
        F.lit(None).cast("double").alias("predicted_interest"),
    )


def hours_before(as_of: dt.datetime | str, hours: float) -> dt.datetime:
    return m.as_datetime(as_of) - dt.timedelta(hours=hours)


def recommend_cold_start(
    exposures: DataFrame,
    news: DataFrame,
    *,
    as_of: dt.datetime | str,
    limit: int = 10,
    hours: float = 6,
    min_impressions: int = 50,
) -> DataFrame:
    """Hot news of the last ``hours`` (R8 with its own defaults), first ``limit`` rows."""
    hot = hot_news(exposures, news, as_of=as_of, hours=hours, min_impressions=min_impressions)
    return hot.limit(limit)


def decorate_recommendations(recs: DataFrame) -> DataFrame:
    """Display fields of a recommendation list (bounded by its ``limit``).

    ``relevance_score`` = predicted interest, 0.5 when it is 0 or missing;
    ``category_affinity`` = popularity / 100 rounded to 2 places; ``distinct_categories`` =
    number of categories in the list, and ``rank`` the 1-based position.
    """
    everything = Window.partitionBy()
    p = F.col("predicted_interest")
    order = Window.orderBy(p.desc_nulls_last(), F.col("popularity").desc(), "news_id")
    return (
        recs.withColumn("relevance_score", F.when(p.isNull() | (p == 0), F.lit(0.5)).otherwise(p))
        .withColumn("category_affinity", F.round(F.col("popularity") / 100.0, 2))
        .withColumn("distinct_categories", F.size(F.collect_set("category").over(everything)).cast("long"))
        .withColumn("rank", F.row_number().over(order).cast("long"))
    )


# --------------------------------------------------------------------------- R13
def dashboard_range(
    as_of: dt.datetime | str,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    *,
    data_start: dt.datetime = DATASET_START,
    data_end: dt.datetime = DATASET_END,
) -> tuple[dt.datetime, dt.datetime]:
    """Default start = data start; default end = min(as_of, data end); explicit end kept."""
    s = m.as_datetime(start) if start is not None else data_start
    e = m.as_datetime(end) if end is not None else min(m.as_datetime(as_of), data_end)
    return s, e


def overview(
    exposures: DataFrame,
    news: DataFrame,
    *,
    as_of: dt.datetime | str,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    data_start: dt.datetime = DATASET_START,
    data_end: dt.datetime = DATASET_END,
    trending_hours: float = 24,
    trending_min_impressions: int = 50,
    exact: bool = True,
) -> DataFrame:
    """One summary row of the dashboard.

    Category totals come from R3 over the P6 range (sums over category-days, so impressions
    spanning days or categories count once per category-day); ``trending_news_count`` is the
    row count of R8. The two single-row aggregates are combined by a union + aggregate.
    """
    s, e = dashboard_range(as_of, start, end, data_start=data_start, data_end=data_end)
    trends = category_trends(exposures, news, start=s, end=e, exact=exact)
    hot = hot_news(
        exposures, news, as_of=as_of, hours=trending_hours,
        min_impressions=trending_min_impressions, exact=exact,
    )
    return overview_of(trends, hot, period=(s, e))


def overview_of(
    trends: DataFrame, hot: DataFrame, *, period: tuple[dt.datetime, dt.datetime]
) -> DataFrame:
    """The R13 summary row from an R3 result over ``period`` and an R8 result."""
    s, e = period
    totals = trends.agg(
        F.count_distinct("category").alias("total_categories"),
        F.coalesce(F.sum("impressions"), F.lit(0)).cast("long").alias("total_impressions"),
        F.coalesce(F.sum("clicks"), F.lit(0)).cast("long").alias("total_clicks"),
    )
    trending = hot.agg(F.count(F.lit(1)).alias("trending_news_count"))
    both = totals.unionByName(trending, allowMissingColumns=True).agg(
        F.max("total_categories").alias("total_categories"),
        F.max("total_impressions").alias("total_impressions"),
        F.max("total_clicks").alias("total_clicks"),
        F.max("trending_news_count").alias("trending_news_count"),
    )
    return both.withColumn("overall_ctr", m.ratio("total_clicks", "total_impressions")).select(
        F.lit(s.isoformat(sep=" ")).cast("timestamp_ntz").alias("period_start"),
        F.lit(e.isoformat(sep=" ")).cast("timestamp_ntz").alias("period_end"),
        "total_categories", "total_impressions", "total_clicks", "overall_ctr",
        "trending_news_count",
    )


def overview_sections(
    exposures: DataFrame,
    news: DataFrame,
    query_log: DataFrame | None = None,
    *,
    as_of: dt.datetime | str,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    trends_rows: int = 50,
    hot_rows: int = 5,
    data_start: dt.datetime = DATASET_START,
    data_end: dt.datetime = DATASET_END,
    trending_hours: float = 24,
    trending_min_impressions: int = 50,
    exact: bool = True,
) -> dict[str, DataFrame]:
    """The whole dashboard payload of R13: summary row, first ``trends_rows`` category-days
    (R3 order), first ``hot_rows`` hot articles (R8) and, given a query log, R17 of the last day.

    R3 and R8 run once for the page: both results are bounded (one row per category and day of
    the range; at most 50 articles), so they are written to a fresh folder under the shared
    checkpoint dir and the summary row and both sections read them from there, instead of each
    section scanning the exposures again.
    """
    s, e = dashboard_range(as_of, start, end, data_start=data_start, data_end=data_end)
    trends = _written(category_trends(exposures, news, start=s, end=e, exact=exact), "dashboard-trends")
    hot = _written(
        hot_news(
            exposures, news, as_of=as_of, hours=trending_hours,
            min_impressions=trending_min_impressions, exact=exact,
        ),
        "dashboard-hot",
    )
    out = {
        "summary": overview_of(trends, hot, period=(s, e)),
        "category_trends": trends.orderBy(
            F.col("click_rate").desc(), "category", "date"
        ).limit(trends_rows),
        "hot_news": hot.orderBy(F.col("click_rate").desc(), "news_id").limit(hot_rows),
    }
    if query_log is not None:
        from .querylog import query_performance

        out["performance"] = query_performance(query_log, as_of=as_of, hours=24)
    return out


def _written(df: DataFrame, prefix: str) -> DataFrame:
    """``df`` written once to a fresh folder under the shared checkpoint dir, read back."""
    path = scratch_dir(df.sparkSession, prefix)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --------------------------------------------------------------------------- R14 / R15
def recent(
    exposures: DataFrame, *, as_of: dt.datetime | str, hours: float = 1
) -> DataFrame:
    """P5: closed window ``[as_of - hours, as_of]``."""
    as_of = m.as_datetime(as_of)
    return m.between_inclusive(exposures, "timestamp", as_of - dt.timedelta(hours=hours), as_of)


def insights_overview(
    exposures: DataFrame, *, as_of: dt.datetime | str, hours: float = 1, exact: bool = True
) -> DataFrame:
    """One row: exposures (not distinct), clicks, users, articles, dwell, CTR percent."""
    r = recent(exposures, as_of=as_of, hours=hours)
    agg = r.agg(
        F.count("impression_id").alias("total_impressions"),
        m.clicks().alias("total_clicks"),
        m.unique_users(exact).alias("unique_users"),
        m.unique_news(exact).alias("unique_news"),
        m.avg_dwell().alias("avg_dwell_time"),
    )
    return agg.withColumn(
        "overall_ctr", m.ratio("total_clicks", "total_impressions") * 100.0
    )


def insights_trending(
    exposures: DataFrame,
    *,
    as_of: dt.datetime | str,
    hours: float = 1,
    limit: int = 10,
    exact: bool = True,
) -> DataFrame:
    """Top articles of the recent window by ``click rate × distinct users``."""
    r = recent(exposures, as_of=as_of, hours=hours)
    return (
        r.groupBy("news_id")
        .agg(
            F.count("impression_id").alias("impressions"),
            m.clicks().alias("clicks"),
            m.unique_users(exact).alias("unique_users"),
        )
        .withColumn("trend_score", m.ratio("clicks", "impressions") * F.col("unique_users"))
        .orderBy(F.col("trend_score").desc(), "news_id")
        .limit(limit)
    )


# --------------------------------------------------------------------------- R16
def popular_news(exposures: DataFrame, news: DataFrame, *, limit: int = 10) -> DataFrame:
    """Most exposed articles (``count(e.news_id)``), aggregated before the article join."""
    return popular_of(exposures.groupBy("news_id").agg(F.count("news_id").alias("view_count")), news, limit=limit)


def popular_of(counts: DataFrame, news: DataFrame, *, limit: int = 10) -> DataFrame:
    """The R16 rows of ``counts(news_id, view_count)``."""
    return (
        counts.join(news.select("news_id", "headline", "category"), "news_id")
        .select("news_id", "headline", "category", "view_count")
        .orderBy(F.col("view_count").desc(), "news_id")
        .limit(limit)
    )
