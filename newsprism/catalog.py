"""Registry of named queries: each binds the driver tables and runs one library operator.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE_SQL[name]`` (DuckDB SQL over the
same parquet tables). Floating columns are rounded to 6 places on both sides so the two
engines' last-bit differences in sums and averages do not matter; everything else is compared
as is. Parameters are those of FIXTURES.md §B4 (they give non-empty results).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.metrics import ts_literal
from .functions.text import headline_sentiment
from .operators import filters as P
from .operators import ingest as I
from .plans import bi as BI
from .plans import querylog as QL
from .plans import reports as R
from .plans.oracle import ORDER_EXPOSURES, ORDER_LINES, ORDER_NEWS, with_tables
from .schemas import NEWS_TSV_COLUMNS
from .session import fresh_dir
from .sinks import keyed as K
from .sinks.store import ExposureStore
from .sources import bindings as B
from .sources import files as S
from .streaming import runner as SR
from .streaming import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every DOUBLE column (comparison hygiene, applied to registered queries only).

    The value is first fixed to 9 decimals, then rounded in decimal arithmetic, so a value
    that sits on a 6-decimal half (e.g. 0.4719825) rounds the same way in both engines even
    when their sums differ in the last bit.
    """
    cols = [
        F.round(F.col(f.name).cast("decimal(38,9)"), places).cast("double").alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return deco


def _event(spark, sf_dir):
    return B.event_exposures(spark, sf_dir), B.event_news(spark, sf_dir)


def _order(spark, sf_dir):
    return B.order_exposures(spark, sf_dir), B.order_news(spark, sf_dir)


def r6(x: str) -> str:
    return f"cast(round(cast({x} as decimal(38, 9)), 6) as double)"


# --------------------------------------------------------------------------- R1 / R2
LIFECYCLE_NEWS = "N7"

_LIFECYCLE_SQL = f"""
select date_trunc('hour', "timestamp") as "timestamp",
       count(distinct impression_id) as impressions,
       cast(coalesce(sum(clicked), 0) as bigint) as clicks,
       coalesce(avg(dwell_time), 0.0) as avg_dwell_time,
       count(distinct user_id) as unique_users
from e where news_id = '{LIFECYCLE_NEWS}' and "timestamp" is not null
group by 1
"""


@register(
    "news_lifecycle",
    with_tables(
        "event",
        f"""select "timestamp", impressions, clicks, {r6('avg_dwell_time')} as avg_dwell_time,
        unique_users, {r6('clicks / greatest(impressions, 1)')} as click_rate
        from ({_LIFECYCLE_SQL}) t""",
        names=("e",),
    ),
)
def q_news_lifecycle(spark, sf_dir):
    """R1 on the event binding, article N7, full range."""
    e, _ = _event(spark, sf_dir)
    return R.news_lifecycle(e, news_id=LIFECYCLE_NEWS)


# --------------------------------------------------------------------------- R3
TRENDS_START = dt.datetime(1997, 1, 1)
TRENDS_END = dt.datetime(1997, 3, 31)

_TRENDS_SQL = """
select category, date_trunc('day', e."timestamp") as date,
       count(distinct impression_id) as impressions,
       cast(coalesce(sum(clicked), 0) as bigint) as clicks,
       count(distinct user_id) as unique_users,
       count(distinct e.news_id) as unique_news
from e join n on e.news_id = n.news_id
{where}
group by 1, 2
"""


def _trends_sql(binding: str, where: str = "") -> str:
    body = f"""select category, date, impressions, clicks, unique_users, unique_news,
        {r6('clicks / greatest(impressions, 1)')} as click_rate
        from ({_TRENDS_SQL.format(where=where)}) t"""
    return with_tables(binding, body)


@register(
    "category_trends",
    _trends_sql(
        "order",
        "where e.\"timestamp\" >= timestamp '1997-01-01' and e.\"timestamp\" <= timestamp '1997-03-31'",
    ),
)
def q_category_trends(spark, sf_dir):
    """R3 on the order binding, 1997-01-01 … 1997-03-31."""
    e, n = _order(spark, sf_dir)
    return R.category_trends(e, n, start=TRENDS_START, end=TRENDS_END)


@register("category_trends_event", _trends_sql("event"))
def q_category_trends_event(spark, sf_dir):
    """R3 on the event binding, full range."""
    e, n = _event(spark, sf_dir)
    return R.category_trends(e, n)


# --------------------------------------------------------------------------- R2 / R4
@register(
    "lifecycle_summary",
    with_tables(
        "event",
        f"""select cast(coalesce(sum(impressions), 0) as bigint) as total_impressions,
        cast(coalesce(sum(clicks), 0) as bigint) as total_clicks,
        cast(coalesce(max(impressions), 0) as bigint) as peak_impressions,
        count(*) as hours,
        {r6('case when sum(impressions) > 0 then sum(clicks) / sum(impressions) * 100.0 else 0.0 end')} as ctr
        from ({_LIFECYCLE_SQL}) t""",
        names=("e",),
    ),
)
def q_lifecycle_summary(spark, sf_dir):
    """R2 over R1 (event binding, N7)."""
    e, _ = _event(spark, sf_dir)
    return R.lifecycle_summary(R.news_lifecycle(e, news_id=LIFECYCLE_NEWS))


_TRENDS_RANGE = (
    "where e.\"timestamp\" >= timestamp '1997-01-01' and e.\"timestamp\" <= timestamp '1997-03-31'"
)


@register(
    "category_rollup",
    with_tables(
        "order",
        f"""select category, cast(sum(impressions) as bigint) as impressions,
        cast(sum(clicks) as bigint) as clicks,
        {r6('case when sum(impressions) > 0 then sum(clicks) / sum(impressions) * 100.0 else 0.0 end')} as ctr,
        row_number() over (order by sum(impressions) desc, category) as rank
        from ({_TRENDS_SQL.format(where=_TRENDS_RANGE)}) t group by category""",
    ),
)
def q_category_rollup(spark, sf_dir):
    """R4 by impressions over R3 (order binding, Q1 1997)."""
    e, n = _order(spark, sf_dir)
    trends = R.category_trends(e, n, start=TRENDS_START, end=TRENDS_END)
    return R.category_rollup(trends, metric="impressions")


# --------------------------------------------------------------------------- R5 / R6 / R7
@register(
    "user_interests",
    with_tables(
        "order",
        f"""select user_id, category, topic, impressions, clicks,
        {r6('avg_dwell_time')} as avg_dwell_time,
        {r6('(clicks * 2 + avg_dwell_time / 30.0) / greatest(impressions, 1)')} as engagement_score
        from (select e.user_id, category, topic, count(distinct impression_id) as impressions,
                     cast(coalesce(sum(clicked), 0) as bigint) as clicks,
                     coalesce(avg(dwell_time), 0.0) as avg_dwell_time
              from e join n on e.news_id = n.news_id
              group by 1, 2, 3 having count(distinct impression_id) > 0) t""",
    ),
)
def q_user_interests(spark, sf_dir):
    """R5 for all users (order binding, full range)."""
    e, n = _order(spark, sf_dir)
    return R.user_interests(e, n, tasks=B.order_tasks(spark, sf_dir))


TIMELINE_USER = "U5"
_TIMELINE_SQL = f"""
with j as (select date_trunc('day', e."timestamp") as ts, category, clicked
           from e join n on e.news_id = n.news_id
           where e.user_id = '{TIMELINE_USER}' and category is not null),
days as (select distinct ts from j), cats as (select distinct category from j),
agg as (select ts, category, sum(clicked) as v from j group by 1, 2)
select d.ts as "timestamp", c.category, cast(coalesce(a.v, 0) as bigint) as interest
from days d cross join cats c left join agg a on a.ts = d.ts and a.category = c.category
"""


@register("interest_timeline", with_tables("order", _TIMELINE_SQL))
def q_interest_timeline(spark, sf_dir):
    """R6 (long form) for user U5 (order binding)."""
    e, n = _order(spark, sf_dir)
    return R.interest_timeline(e, n, user=TIMELINE_USER)


STATS_USER = "U7"  # has rising categories


@register(
    "interest_stats",
    with_tables(
        "order",
        f"""select category, total, occurrences, trend, {r6('average')} as average,
        case when row_number() over (order by average desc, category) <= 5
             then row_number() over (order by average desc, category) end as top_rank,
        case when trend > 0 and row_number() over (order by trend > 0 desc, trend desc, average desc, category) <= 3
             then row_number() over (order by trend > 0 desc, trend desc, average desc, category) end as rising_rank
        from (select category, cast(sum(interest) as bigint) as total, count(*) as occurrences,
                     cast(arg_max(interest, "timestamp") - arg_min(interest, "timestamp") as bigint) as trend,
                     sum(interest) / greatest(count(*), 1) as average
              from ({_TIMELINE_SQL.replace(TIMELINE_USER, STATS_USER)}) tl group by category) s""",
    ),
)
def q_interest_stats(spark, sf_dir):
    """R7 over R6 for a user with rising categories (order binding)."""
    e, n = _order(spark, sf_dir)
    return R.interest_stats(R.interest_timeline(e, n, user=STATS_USER))


# --------------------------------------------------------------------------- R8
def _hot_sql(as_of: dt.datetime, hours: float, min_imp: int, limit: int = 50) -> str:
    cutoff = as_of - dt.timedelta(hours=hours)
    return f"""
with agg as (
  select news_id, count(distinct impression_id) as impressions,
         cast(coalesce(sum(clicked), 0) as bigint) as clicks,
         count(distinct user_id) as unique_users, coalesce(avg(dwell_time), 0.0) as avg_dwell_time
  from e where "timestamp" >= timestamp '{cutoff}' and "timestamp" <= timestamp '{as_of}'
  group by news_id having count(distinct impression_id) >= {min_imp}),
ranked as (
  select a.*, n.category, n.topic, n.headline, n.news_body,
         clicks / greatest(impressions, 1) as click_rate,
         unique_users / greatest(impressions, 1) as user_diversity
  from agg a join n on a.news_id = n.news_id
  order by click_rate desc, a.news_id limit {limit})
select news_id, category, topic, headline, news_body, impressions, clicks, unique_users,
       {r6('avg_dwell_time')} as avg_dwell_time, {r6('click_rate')} as click_rate,
       {r6('user_diversity')} as user_diversity,
       {r6('click_rate * 0.4 + user_diversity * 0.3 + least(avg_dwell_time / 100.0, 1.0) * 0.3')} as hotness_score
from ranked
"""


HOT_ORDER = dict(as_of=dt.datetime(2001, 8, 1), hours=8760, min_impressions=4)
HOT_EVENT = dict(as_of=dt.datetime(2024, 1, 31), hours=240, min_impressions=20)


@register(
    "hot_news",
    with_tables("order", _hot_sql(HOT_ORDER["as_of"], HOT_ORDER["hours"], HOT_ORDER["min_impressions"])),
)
def q_hot_news(spark, sf_dir):
    """R8 on the order binding: as_of 2001-08-01, 8760 h, ≥ 4 impressions."""
    e, n = _order(spark, sf_dir)
    return R.hot_news(e, n, **HOT_ORDER)


@register(
    "hot_news_event",
    with_tables("event", _hot_sql(HOT_EVENT["as_of"], HOT_EVENT["hours"], HOT_EVENT["min_impressions"])),
)
def q_hot_news_event(spark, sf_dir):
    """R8 on the event binding: as_of 2024-01-31, 240 h, ≥ 20 impressions."""
    e, n = _event(spark, sf_dir)
    return R.hot_news(e, n, **HOT_EVENT)


# --------------------------------------------------------------------------- R9 – R12
PREF_USER = "U5"


def _prefs_sql(user: str) -> str:
    return f"""select category, topic, count(clicked) as clicks
    from e join n on e.news_id = n.news_id where e.user_id = '{user}' and clicked = 1
    group by 1, 2 order by clicks desc, category, topic limit 5"""


def _recommend_sql(user: str, limit: int = 10) -> str:
    return f"""
with prefs as ({_prefs_sql(user)}),
cand as (select news_id, category, topic, headline from n
         where category in (select category from prefs) and topic in (select topic from prefs)
           and news_id not in (select news_id from e where user_id = '{user}')),
stats as (select news_id, count(distinct impression_id) as popularity,
                 coalesce(avg(cast(clicked as double)), 0.0) as predicted_interest
          from e where news_id in (select news_id from cand) group by news_id)
select c.news_id, c.category, c.topic, c.headline, s.popularity, s.predicted_interest
from cand c join stats s on c.news_id = s.news_id
order by predicted_interest desc, popularity desc, c.news_id limit {limit}
"""


@register("user_preferences", with_tables("event", _prefs_sql(PREF_USER)))
def q_user_preferences(spark, sf_dir):
    """R9 for U5 (event binding)."""
    e, n = _event(spark, sf_dir)
    return R.user_preferences(e, n, user=PREF_USER)


@register(
    "user_preferences_order", with_tables("order", _prefs_sql(PREF_USER))
)
def q_user_preferences_order(spark, sf_dir):
    """R9 for U5 (order binding)."""
    e, n = _order(spark, sf_dir)
    return R.user_preferences(e, n, user=PREF_USER)


@register(
    "recommend",
    with_tables(
        "event",
        f"select news_id, category, topic, headline, popularity, {r6('predicted_interest')} as predicted_interest from ({_recommend_sql(PREF_USER)}) r",
    ),
)
def q_recommend(spark, sf_dir):
    """R10 for U5 (event binding); U5 has clicks, so no cold start."""
    e, n = _event(spark, sf_dir)
    return R.recommend(e, n, user=PREF_USER, as_of=HOT_EVENT["as_of"])


@register(
    "recommend_order",
    with_tables(
        "order",
        f"select news_id, category, topic, headline, popularity, {r6('predicted_interest')} as predicted_interest from ({_recommend_sql(PREF_USER)}) r",
    ),
)
def q_recommend_order(spark, sf_dir):
    """R10 for U5 (order binding)."""
    e, n = _order(spark, sf_dir)
    return R.recommend(e, n, user=PREF_USER, as_of=HOT_ORDER["as_of"])


COLD_USER = "U_unknown"


@register(
    "recommend_cold_start",
    with_tables(
        "order",
        f"""select news_id, category, topic, headline, impressions as popularity,
        cast(null as double) as predicted_interest
        from ({_hot_sql(HOT_ORDER['as_of'], HOT_ORDER['hours'], HOT_ORDER['min_impressions'])}) h
        order by click_rate desc, news_id limit 10""",
    ),
)
def q_recommend_cold_start(spark, sf_dir):
    """A user without clicks gets hot news (order binding, R8 parameters as above)."""
    e, n = _order(spark, sf_dir)
    return R.recommend(
        e, n, user=COLD_USER, as_of=HOT_ORDER["as_of"], cold_hours=HOT_ORDER["hours"],
        cold_min_impressions=HOT_ORDER["min_impressions"],
    )


@register(
    "decorate_recommendations",
    with_tables(
        "order",
        f"""select news_id, category, topic, headline, popularity, {r6('predicted_interest')} as predicted_interest,
        {r6('case when predicted_interest is null or predicted_interest = 0 then 0.5 else predicted_interest end')} as relevance_score,
        round(popularity / 100.0, 2) as category_affinity,
        (select count(distinct category) from ({_recommend_sql(PREF_USER)}) x) as distinct_categories,
        row_number() over (order by predicted_interest desc, popularity desc, news_id) as rank
        from ({_recommend_sql(PREF_USER)}) r""",
    ),
)
def q_decorate_recommendations(spark, sf_dir):
    """R12 over R10 for U5 (order binding)."""
    e, n = _order(spark, sf_dir)
    recs = R.recommend_for_preferences(e, n, user=PREF_USER)
    return R.decorate_recommendations(recs)


# --------------------------------------------------------------------------- R13 – R16
OVERVIEW = dict(
    as_of=dt.datetime(2001, 8, 1), start=TRENDS_START, end=TRENDS_END,
    trending_hours=HOT_ORDER["hours"], trending_min_impressions=HOT_ORDER["min_impressions"],
)


@register(
    "overview",
    with_tables(
        "order",
        f"""with t as ({_TRENDS_SQL.format(where=_TRENDS_RANGE)}),
        h as ({_hot_sql(HOT_ORDER['as_of'], HOT_ORDER['hours'], HOT_ORDER['min_impressions'])})
        select timestamp '1997-01-01' as period_start, timestamp '1997-03-31' as period_end,
               (select count(distinct category) from t) as total_categories,
               (select cast(coalesce(sum(impressions), 0) as bigint) from t) as total_impressions,
               (select cast(coalesce(sum(clicks), 0) as bigint) from t) as total_clicks,
               {r6('(select coalesce(sum(clicks), 0) from t) / greatest((select coalesce(sum(impressions), 0) from t), 1)')} as overall_ctr,
               (select count(*) from h) as trending_news_count""",
    ),
)
def q_overview(spark, sf_dir):
    """R13 on the order binding (Q1 1997 range, trending as hot_news above)."""
    e, n = _order(spark, sf_dir)
    return R.overview(e, n, **OVERVIEW)


DEFAULT_RANGE = dict(
    as_of=dt.datetime(1997, 2, 15), data_start=dt.datetime(1997, 1, 1), data_end=dt.datetime(1997, 3, 31),
    trending_hours=HOT_ORDER["hours"], trending_min_impressions=HOT_ORDER["min_impressions"],
)
_DEFAULT_WHERE = (
    "where e.\"timestamp\" >= timestamp '1997-01-01' and e.\"timestamp\" <= timestamp '1997-02-15'"
)
_DEFAULT_HOT = _hot_sql(DEFAULT_RANGE["as_of"], HOT_ORDER["hours"], HOT_ORDER["min_impressions"])


@register(
    "overview_default_range",
    with_tables(
        "order",
        f"""with t as ({_TRENDS_SQL.format(where=_DEFAULT_WHERE)}), h as ({_DEFAULT_HOT})
        select timestamp '1997-01-01' as period_start, timestamp '1997-02-15' as period_end,
               (select count(distinct category) from t) as total_categories,
               (select cast(coalesce(sum(impressions), 0) as bigint) from t) as total_impressions,
               (select cast(coalesce(sum(clicks), 0) as bigint) from t) as total_clicks,
               {r6('(select coalesce(sum(clicks), 0) from t) / greatest((select coalesce(sum(impressions), 0) from t), 1)')} as overall_ctr,
               (select count(*) from h) as trending_news_count""",
    ),
)
def q_overview_default_range(spark, sf_dir):
    """R13 without bounds (P6): from the data's start to ``as_of``, which comes before its end."""
    e, n = _order(spark, sf_dir)
    return R.overview(e, n, **DEFAULT_RANGE)


@register(
    "overview_sections",
    with_tables(
        "order",
        f"""select 'trends' as section, category as name, impressions as value from (
          select * from ({_TRENDS_SQL.format(where=_DEFAULT_WHERE)}) t
          order by clicks / greatest(impressions, 1) desc, category, date limit 50) a
        union all select 'hot', news_id, impressions from (
          select * from ({_DEFAULT_HOT}) h order by click_rate desc, news_id limit 5) b""",
    ),
)
def q_overview_sections(spark, sf_dir):
    """R13's sections: the first category-days and hot articles of the page."""
    e, n = _order(spark, sf_dir)
    page = R.overview_sections(e, n, **DEFAULT_RANGE)
    trends = page["category_trends"].select(
        F.lit("trends").alias("section"), F.col("category").alias("name"), F.col("impressions").alias("value"))
    hot = page["hot_news"].select(
        F.lit("hot").alias("section"), F.col("news_id").alias("name"), F.col("impressions").alias("value"))
    return trends.unionByName(hot)


INSIGHTS_AS_OF = dt.datetime(2024, 1, 15, 12, 0, 0)
INSIGHTS_HOURS = 24
_RECENT = (
    f"where \"timestamp\" >= timestamp '{INSIGHTS_AS_OF - dt.timedelta(hours=INSIGHTS_HOURS)}' "
    f"and \"timestamp\" <= timestamp '{INSIGHTS_AS_OF}'"
)


@register(
    "insights_overview",
    with_tables(
        "event",
        f"""select count(impression_id) as total_impressions,
        cast(coalesce(sum(clicked), 0) as bigint) as total_clicks,
        count(distinct user_id) as unique_users, count(distinct news_id) as unique_news,
        {r6('coalesce(avg(dwell_time), 0.0)')} as avg_dwell_time,
        {r6('coalesce(sum(clicked), 0) / greatest(count(impression_id), 1) * 100.0')} as overall_ctr
        from e {_RECENT}""",
        names=("e",),
    ),
)
def q_insights_overview(spark, sf_dir):
    """R14 on the event binding: 24 h before 2024-01-15 12:00."""
    e, _ = _event(spark, sf_dir)
    return R.insights_overview(e, as_of=INSIGHTS_AS_OF, hours=INSIGHTS_HOURS)


@register(
    "insights_trending",
    with_tables(
        "event",
        f"""select news_id, impressions, clicks, unique_users,
        {r6('clicks / greatest(impressions, 1) * unique_users')} as trend_score
        from (select news_id, count(impression_id) as impressions,
                     cast(coalesce(sum(clicked), 0) as bigint) as clicks,
                     count(distinct user_id) as unique_users
              from e {_RECENT} group by news_id) t
        order by clicks / greatest(impressions, 1) * unique_users desc, news_id limit 10""",
        names=("e",),
    ),
)
def q_insights_trending(spark, sf_dir):
    """R15 on the event binding, same window as R14."""
    e, _ = _event(spark, sf_dir)
    return R.insights_trending(e, as_of=INSIGHTS_AS_OF, hours=INSIGHTS_HOURS)


@register(
    "popular_news",
    with_tables(
        "event",
        """select n.news_id, n.headline, n.category, count(e.news_id) as view_count
        from n join e on n.news_id = e.news_id group by 1, 2, 3
        order by view_count desc, n.news_id limit 10""",
    ),
)
def q_popular_news(spark, sf_dir):
    """R16 on the event binding."""
    e, n = _event(spark, sf_dir)
    return R.popular_news(e, n)


# --------------------------------------------------------------------------- maintained layouts


def _corrected_store(spark, sf_dir) -> tuple[ExposureStore, DataFrame]:
    """The exposure store after two batches: all events, every seventh with a wrong click, dwell time
    and day; then these again as they should be."""
    e, n = _event(spark, sf_dir)
    wrong = F.expr("cast(substr(impression_id, 2) as bigint)") % 7 == 0
    first = e.withColumn("clicked", F.when(wrong, 1 - F.col("clicked")).otherwise(F.col("clicked")))
    first = first.withColumn("dwell_time", F.when(wrong, F.lit(99.0)).otherwise(F.col("dwell_time")))
    first = first.withColumn("timestamp", F.when(wrong, F.col("timestamp") + F.expr("interval 1 day")).otherwise(F.col("timestamp")))
    store = ExposureStore(spark, fresh_dir(spark, "store"), user_buckets=16)
    store.upsert(first)
    store.upsert(e.where(wrong))
    return store, n


@register("recommend_maintained", ORACLE_SQL["recommend"])
def q_recommend_maintained(spark, sf_dir):
    """R10 from the article totals and the user layout of a store that has been corrected."""
    store, n = _corrected_store(spark, sf_dir)
    return store.recommend(n, user=PREF_USER, as_of=HOT_EVENT["as_of"])


@register("popular_news_maintained", ORACLE_SQL["popular_news"])
def q_popular_news_maintained(spark, sf_dir):
    """R16 from the article totals of a store that has been corrected."""
    store, n = _corrected_store(spark, sf_dir)
    return store.popular_news(n)


@register(
    "article_days",
    with_tables(
        "event",
        f"""select news_id, cast("timestamp" as date) as day, count(*) as n, cast(sum(clicked) as bigint) as clicks,
               count(clicked) as rated, {r6('sum(dwell_time)')} as dwell_sum, count(dwell_time) as dwell_n
        from e group by 1, 2""",
        names=("e",),
    ),
)
def q_article_days(spark, sf_dir):
    """The maintained (article, day) totals: rows added, replaced ones subtracted."""
    store, _ = _corrected_store(spark, sf_dir)
    return store.articles.read().where("n > 0")


@register(
    "user_interests_by_user",
    with_tables(
        "event",
        f"""select user_id, category, topic, impressions, clicks,
        {r6('avg_dwell_time')} as avg_dwell_time,
        {r6('(clicks * 2 + avg_dwell_time / 30.0) / greatest(impressions, 1)')} as engagement_score
        from (select e.user_id, category, topic, count(distinct impression_id) as impressions,
                     cast(coalesce(sum(clicked), 0) as bigint) as clicks,
                     coalesce(avg(dwell_time), 0.0) as avg_dwell_time
              from e join n on e.news_id = n.news_id where e.user_id = '{PREF_USER}'
              group by 1, 2, 3 having count(distinct impression_id) > 0) t""",
    ),
)
def q_user_interests_by_user(spark, sf_dir):
    """R5 of one user from the layout by user."""
    store, n = _corrected_store(spark, sf_dir)
    return store.user_interests(n, user=PREF_USER)


# --------------------------------------------------------------------------- P10 / P11

LIST_CATEGORY = "Brand#11"


@register(
    "list_news",
    with_tables(
        "order",
        f"""select news_id, category, topic, headline, news_body,
        case when length(news_body) > 150 then concat(substring(news_body, 1, 150), '...') else news_body end as news_body_preview,
        count(*) over () = 20 as has_more
        from (select * from n where category = '{LIST_CATEGORY}' order by news_id limit 20 offset 10) p""",
        names=("n",),
    ),
)
def q_list_news(spark, sf_dir):
    """P10: second page (offset 10, 20 rows) of one category (order binding)."""
    _, n = _order(spark, sf_dir)
    return P.list_news(n, category=LIST_CATEGORY, limit=20, offset=10)


@register(
    "list_news_documents",
    with_tables(
        "event",
        """select news_id, category, topic, headline, news_body,
        case when length(news_body) > 150 then concat(substring(news_body, 1, 150), '...') else news_body end as news_body_preview,
        count(*) over () = 50 as has_more
        from (select * from n order by news_id limit 50 offset 0) p""",
        names=("n",),
    ),
)
def q_list_news_documents(spark, sf_dir):
    """P10: first page of all articles (event binding: multilingual bodies)."""
    _, n = _event(spark, sf_dir)
    return P.list_news(n)


FILTER = dict(
    start=dt.datetime(2024, 1, 3), end=dt.datetime(2024, 1, 20, 12),
    categories=None, topics=None, headline_length=(5, 60), body_length=(200, None),
)


@register(
    "filter_exposures",
    with_tables(
        "event",
        f"""select impression_id, user_id, news_id, "timestamp", clicked, {r6('dwell_time')} as dwell_time
        from e where "timestamp" >= timestamp '{FILTER['start']}' and "timestamp" <= timestamp '{FILTER['end']}'
        and news_id in (select news_id from n where length(headline) >= 5 and length(headline) <= 60
                        and length(news_body) >= 200)""",
    ),
)
def q_filter_exposures(spark, sf_dir):
    """Time range + headline and body length ranges (event binding)."""
    e, n = _event(spark, sf_dir)
    return P.filter_exposures(e, n, **FILTER)


@register(
    "filter_exposures_users",
    with_tables(
        "order",
        f"""select impression_id, user_id, news_id, "timestamp", clicked, {r6('dwell_time')} as dwell_time
        from e where user_id in ('U5', 'U7', 'U11')
        and news_id in (select news_id from n where category in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7', 'Brand#8', 'Brand#9', 'Brand#10')
                        and topic in ('ECONOMY', 'SMALL', 'STANDARD'))""",
    ),
)
def q_filter_exposures_users(spark, sf_dir):
    """User list × category list × topic list (order binding)."""
    e, n = _order(spark, sf_dir)
    return P.filter_exposures(
        e, n, users=["U5", "U7", "U11"], categories=[f"Brand#{i}" for i in range(1, 11)],
        topics=["ECONOMY", "SMALL", "STANDARD"],
    )


# --------------------------------------------------------------------------- R17 – R23

QLOG_AS_OF = dt.datetime(2024, 1, 31)
QLOG_HOURS = 24 * 30


def _qlog(spark, sf_dir):
    return B.event_query_log(spark, sf_dir)


_QSINCE = f"where \"timestamp\" >= timestamp '{QLOG_AS_OF - dt.timedelta(hours=QLOG_HOURS)}'"


@register(
    "query_performance",
    with_tables(
        "event",
        f"""select query_type, count(id) as total_queries,
        {r6('coalesce(avg(execution_time), 0.0)')} as avg_execution_time,
        {r6('coalesce(max(execution_time), 0.0)')} as max_execution_time,
        {r6('coalesce(min(execution_time), 0.0)')} as min_execution_time,
        cast(coalesce(sum(cast(not success as integer)), 0) as bigint) as failed_queries,
        {r6('(count(id) - coalesce(sum(cast(not success as integer)), 0)) / greatest(count(id), 1) * 100.0')} as success_rate
        from q {_QSINCE} group by query_type""",
        names=("q",),
    ),
)
def q_query_performance(spark, sf_dir):
    """R17 over the event query log, 30 days before 2024-01-31."""
    return QL.query_performance(_qlog(spark, sf_dir), as_of=QLOG_AS_OF, hours=QLOG_HOURS)


@register(
    "perf_summary",
    with_tables(
        "event",
        f"""select count(*) as total_queries, {r6('coalesce(avg(execution_time), 0.0)')} as avg_execution_time,
        {r6('coalesce(max(execution_time), 0.0)')} as max_execution_time,
        {r6('count_if(success) / greatest(count(*), 1)')} as success_rate,
        cast(count_if(not success) as bigint) as error_count from q""",
        names=("q",),
    ),
)
def q_perf_summary(spark, sf_dir):
    """R18 over the whole event query log."""
    return QL.perf_summary(_qlog(spark, sf_dir))


@register(
    "perf_time_series",
    with_tables(
        "event",
        f"""select time_bucket(interval '6 hours', "timestamp") as bucket_start,
        {r6('avg(execution_time)')} as avg_execution_time, count(*) as query_count
        from q group by 1""",
        names=("q",),
    ),
)
def q_perf_time_series(spark, sf_dir):
    """6-hour buckets over the event query log."""
    return QL.perf_time_series(_qlog(spark, sf_dir), bucket="6 hours")


@register(
    "perf_histogram",
    with_tables(
        "event",
        """select cast(floor(execution_time * 1000.0 / 50) as bigint) * 50 as range_start_ms,
        count(*) as query_count,
        cast(floor(execution_time * 1000.0 / 50) as bigint) * 50 + 50 as range_end_ms
        from q where execution_time is not null group by 1, 3""",
        names=("q",),
    ),
)
def q_perf_histogram(spark, sf_dir):
    """50 ms buckets over the event query log."""
    return QL.perf_histogram(_qlog(spark, sf_dir), width_ms=50)


@register(
    "perf_status",
    with_tables(
        "event",
        """select case when success then 'success' else 'failed' end as status, count(*) as query_count
        from q group by 1""",
        names=("q",),
    ),
)
def q_perf_status(spark, sf_dir):
    """R21 over the event query log."""
    return QL.perf_status(_qlog(spark, sf_dir))


@register(
    "slow_queries",
    with_tables(
        "event",
        f"""select id, query_type, {r6('execution_time')} as execution_time, "timestamp", success, error_message
        from q order by execution_time desc nulls last, id limit 10""",
        names=("q",),
    ),
)
def q_slow_queries(spark, sf_dir):
    """Ten slowest entries of the event query log."""
    return QL.slow_queries(_qlog(spark, sf_dir), n=10)


@register(
    "error_types",
    with_tables(
        "event",
        """select error_message, count(*) as error_count from q where not success
        group by error_message order by error_count desc, error_message nulls last limit 10""",
        names=("q",),
    ),
)
def q_error_types(spark, sf_dir):
    """R23 over the event query log."""
    return QL.error_types(_qlog(spark, sf_dir), n=10)


# --------------------------------------------------------------------------- ingest T1 – T7

_EXPOSURE_COLS = ("impression_id", "user_id", "news_id", "timestamp", "clicked", "dwell_time")
_EXPOSURE_SQL = f"""select impression_id, user_id, news_id, "timestamp", clicked, {r6('dwell_time')} as dwell_time"""


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    """TIMESTAMP columns back to the naive (NTZ) type of the driver tables."""
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@register("explode_impressions", with_tables("order", f"{_EXPOSURE_SQL} from e", names=("e",)))
def q_explode_impressions(spark, sf_dir):
    """T4: raw impressions derived from the order binding, exploded back into exposures."""
    raw = B.order_raw_impressions(spark, sf_dir)
    return _ntz(I.explode_impressions(raw), "timestamp")


@register(
    "read_impressions_tsv",
    with_tables(
        "order",
        """select user_id as "UserID",
        coalesce(string_agg(case when clicked = 1 then news_id end, ' ' order by cast(substr(news_id, 2) as bigint)), '') as pos,
        coalesce(string_agg(case when clicked = 0 then news_id end, ' ' order by cast(substr(news_id, 2) as bigint)), '') as neg,
        coalesce(string_agg(case when clicked = 1 then cast(cast(dwell_time as integer) as varchar) end, ' ' order by cast(substr(news_id, 2) as bigint)), '') as dwelltime_pos,
        strftime("timestamp", '%Y-%m-%d %H:%M:%S') as start, strftime("timestamp", '%Y-%m-%d %H:%M:%S') as "end"
        from e group by impression_id, user_id, "timestamp" """,
        names=("e",),
    ),
)
def q_read_impressions_tsv(spark, sf_dir):
    """Raw impressions written as TSV by Spark and read back by header name."""
    raw = B.order_raw_impressions(spark, sf_dir).drop("impression_id")
    path = fresh_dir(spark, "impressions-tsv")
    S.write_tsv(raw, path)
    back = S.read_impressions_tsv(spark, path)
    return back.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in back.columns])


_RAW_SEQ_SQL = """
select printf('imp_%07d', row_number() over (order by l_orderkey)) as impression_id,
       l_orderkey as seq
from (select distinct l_orderkey from lineitem join orders on l_orderkey = o_orderkey) o
"""


def _raw_unnumbered(spark, sf_dir):
    raw = B.order_raw_impressions(spark, sf_dir)
    return raw.withColumn("seq", F.substring("impression_id", 5, 1 << 20).cast("long")).drop(
        "impression_id"
    )


@register("assign_impression_ids", _RAW_SEQ_SQL)
def q_assign_impression_ids(spark, sf_dir):
    """T5: sequence ids imp_0000001… over the raw impressions in order-key order."""
    raw = _raw_unnumbered(spark, sf_dir)
    return I.assign_impression_ids(raw, order_by=["seq"]).select("impression_id", "seq")


@register("assign_impression_ids_files", _RAW_SEQ_SQL)
def q_assign_impression_ids_files(spark, sf_dir):
    """T5 over several TSV files (S2), in file order: no sort and no copy of the rows."""
    raw = _raw_unnumbered(spark, sf_dir)
    path = fresh_dir(spark, "raw-tsv")
    # a range of order keys a file, so the file order is the key order
    files = max(5, B.order_tasks(spark, sf_dir) or 0)
    S.write_tsv(raw.repartitionByRange(files, "seq").sortWithinPartitions("seq").withColumn("note", F.col("seq").cast("string")), path)
    read = spark.read.options(**S.TSV_OPTIONS).csv(path)
    return I.assign_impression_ids(read).select("impression_id", F.col("note").cast("long").alias("seq"))


FIRST_N = 500


@register(
    "first_n_impressions",
    f"""with ids as ({_RAW_SEQ_SQL}), e as ({ORDER_EXPOSURES.replace("concat('imp_', cast(l_orderkey as varchar)) as impression_id", "l_orderkey as seq")})
    select ids.impression_id, user_id, news_id, "timestamp", clicked, {r6('dwell_time')} as dwell_time
    from e join ids on e.seq = ids.seq where ids.seq in (select seq from ids order by seq limit {FIRST_N})""",
)
def q_first_n_impressions(spark, sf_dir):
    """The first 500 impressions (by sequence id) exploded into exposures."""
    raw = _raw_unnumbered(spark, sf_dir)
    return _ntz(I.first_n_impressions(raw, FIRST_N, order_by=["seq"]), "timestamp")


_LAST_WINS_SQL = f"""
select impression_id, user_id, news_id, "timestamp", clicked, {r6('dwell_time')} as dwell_time from (
  select *, row_number() over (partition by impression_id, user_id, news_id
     order by l_shipdate desc, l_linenumber desc, l_quantity desc, l_extendedprice desc,
              "timestamp" desc, clicked desc, dwell_time desc) as rn
  from ({ORDER_LINES}) l) t where rn = 1
"""
_ARRIVAL = ["l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice"]


@register("latest_by_key", _LAST_WINS_SQL)
def q_latest_by_key(spark, sf_dir):
    """Last write wins over the uncollapsed order lines, arrival = ship date, line, …"""
    lines = B.order_lines(spark, sf_dir)
    return I.latest_by_key(lines, ["impression_id", "user_id", "news_id"], _ARRIVAL).select(
        *_EXPOSURE_COLS
    )


@register(
    "parse_json_records",
    f"""with ev as (select * from events where event_type <> 'error')
    select concat('e', cast(event_id as varchar)) as impression_id, concat('U', cast(user_id as varchar)) as user_id,
           concat('N', cast(cast(json_extract_string(props, '$.k') as integer) as varchar)) as news_id,
           ts as "timestamp", case when event_type = 'click' then 1 else 0 end as clicked,
           {r6("case when event_type = 'click' then value else 0.0 end")} as dwell_time
    from ev""",
)
def q_parse_json_records(spark, sf_dir):
    """T1 + T2: exposures serialised to JSON (error events truncated, i.e. malformed), parsed
    back by the fixed schema; malformed payloads are dropped."""
    ev = B.table(spark, sf_dir, "events")
    rows = B.event_exposures_of(ev, keep=("event_type",)).withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
    payload = F.to_json(F.struct(*_EXPOSURE_COLS))
    msgs = rows.select(
        F.when(F.col("event_type") == "error", F.substring(payload, 1, 25)).otherwise(payload).alias("value")
    )
    parsed = I.cast_event_times(I.parse_json_records(msgs))
    return _ntz(parsed.select(*_EXPOSURE_COLS), "timestamp")


@register(
    "stamp_processed",
    with_tables("event", 'select impression_id, "timestamp", true as stamped_now from e', names=("e",)),
)
def q_stamp_processed(spark, sf_dir):
    """Every exposure carries the time it was processed (within the hour of the call)."""
    now = dt.datetime.now(dt.timezone.utc).timestamp()
    stamped = I.stamp_processed(B.event_exposures(spark, sf_dir))
    age = F.abs(F.unix_timestamp("processed_timestamp") - F.lit(now))
    return stamped.select("impression_id", "timestamp", (age < 3600).alias("stamped_now"))


# --------------------------------------------------------------------------- sinks K1 / K2
SHIP_CUTOFF = dt.datetime(1998, 5, 24)


@register("upsert_exposures", _LAST_WINS_SQL)
def q_upsert_exposures(spark, sf_dir):
    """K2: order lines arrive in two batches (shipped before / after 1998-05-24) and are
    upserted into a date-partitioned exposure table; the table ends as last-write-wins."""
    lines = B.order_lines(spark, sf_dir)
    path = fresh_dir(spark, "exposure_logs")
    cut = F.col("l_shipdate") <= ts_literal(lines, "l_shipdate", SHIP_CUTOFF)
    # seven years of day-grained orders: a month partition grain keeps files large
    kw = dict(order=_ARRIVAL, drop=_ARRIVAL, grain="month")
    K.upsert_exposures(spark, lines.where(cut), path, **kw)
    out = K.upsert_exposures(spark, lines.where(~cut), path, **kw)
    return out.select(*_EXPOSURE_COLS)


@register(
    "upsert_news",
    f"""with docs as ({with_tables('event', 'select * from n', names=('n',))}),
    parts as ({with_tables('order', 'select * from n', names=('n',))})
    select * from docs union all
    select * from parts where news_id not in (select news_id from docs)""",
)
def q_upsert_news(spark, sf_dir):
    """K1: the part catalogue is loaded, then the document catalogue is upserted over it."""
    path = fresh_dir(spark, "news")
    K.upsert_news(spark, B.order_news(spark, sf_dir), path)
    return K.upsert_news(spark, B.event_news(spark, sf_dir), path)


@register("report_across_compaction", ORACLE_SQL["insights_overview"])
def q_report_across_compaction(spark, sf_dir):
    """K2 / K7: R14 planned over three batches of the stored log, which is compacted before the report
    runs; the files it was planned on are still there."""
    e = B.event_exposures(spark, sf_dir)
    table = K.exposure_table(spark, fresh_dir(spark, "exposure_logs"))
    third = F.pmod(F.xxhash64("impression_id"), F.lit(3))
    for k in range(3):
        table.upsert(e.where(third == k))
    report = R.insights_overview(table.read(keep_partition=True), as_of=INSIGHTS_AS_OF, hours=INSIGHTS_HOURS)
    table.compact()
    return report


@register("read_news_tsv", with_tables("event", "select * from n", names=("n",)))
def q_read_news_tsv(spark, sf_dir):
    """The document catalogue written as TSV (quoted, multi-line bodies) and read back."""
    news = B.event_news(spark, sf_dir)
    headers = {v: k for k, v in NEWS_TSV_COLUMNS.items()}
    path = fresh_dir(spark, "news-tsv")
    S.write_tsv(news.select(*[F.col(c).alias(headers[c]) for c in news.columns]), path)
    return S.read_news_tsv(spark, path).select(*news.columns)


# --------------------------------------------------------------------------- streams W1 – W4, W8


def _run_monitor(spark, sf_dir, name):
    """Run monitor ``name`` as a real stream (file source, availableNow) into its keyed table; its
    window partials."""
    return _run_stream(spark, B.event_exposure_stream(spark, sf_dir), name)


def _run_stream(spark, stream, name):
    q, table = SR.start_monitor(
        spark, stream, name, available_now=True,
        table_path=fresh_dir(spark, f"{name}-table"), checkpoint=fresh_dir(spark, f"{name}-ckpt"),
        query_name=f"{name}_{fresh_dir(spark, 'q').rsplit('-', 1)[-1]}",
    )
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return W.window_partials(table.read(), W.SPECS[name])


def _windows_sql(size: int, slide: int | None) -> str:
    """Exposures replicated into each (sliding) window they fall in, DuckDB side."""
    if slide is None:
        return f"""select time_bucket(interval '{size} minutes', "timestamp") as window_start, * from e"""
    return f"""select time_bucket(interval '{slide} minutes', "timestamp") - i * interval '{slide} minutes' as window_start, *
               from e, range(0, {size // slide}) t(i)"""


def _stream_sql(size, slide, key, distinct, names, select, where="", rows="true"):
    """``rows``: the exposures that count."""
    imp, clk, dst = names
    dcol = f", count(distinct {distinct}) as {dst}" if distinct else ""
    return with_tables(
        "event",
        f"""select * from (select window_start, window_start + interval '{size} minutes' as window_end, {key},
               count(impression_id) as {imp}, cast(coalesce(sum(clicked), 0) as bigint) as {clk},
               sum(dwell_time) / count(dwell_time) as avg_dwell_time {dcol}
        from ({_windows_sql(size, slide)}) w where {rows} group by window_start, {key}) a {where}""".replace("select * from", f"select {select} from", 1),
        names=("e",),
    )


@register(
    "trend_stream",
    _stream_sql(
        5, 1, "news_id", "user_id", ("impression_count", "click_count", "unique_users"),
        f"""window_start, window_end, news_id, impression_count, click_count, unique_users,
        {r6('avg_dwell_time')} as avg_dwell_time,
        {r6('click_count / greatest(impression_count, 1)')} as click_rate,
        {r6('click_count / greatest(impression_count, 1) * 0.4 + unique_users / greatest(impression_count, 1) * 0.3 + (avg_dwell_time / 100.0) * 0.3')} as trend_score""",
    ),
)
def q_trend_stream(spark, sf_dir):
    """W1 as a stream over events.parquet (availableNow), report over the stage-1 table."""
    return _ntz(W.trend_report(_run_monitor(spark, sf_dir, "trend")), "window_start", "window_end")


# every 20th event of the first two weeks comes again to a monitor that has seen the whole month
LATE_SQL = "cast(substr(impression_id, 2) as bigint) % 20 = 0 and \"timestamp\" < timestamp '2024-01-15'"
SPOOL_DAYS = 6


def _spooled(spark, sf_dir):
    """The exposures as files of ``SPOOL_DAYS`` days each, delivered one after the other, without the
    late ones, which are the last file; the folder is read with one file a trigger."""
    e = B.event_exposures(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    late = (F.expr("cast(substr(impression_id, 2) as bigint)") % 20 == 0) & (F.col("timestamp") < F.lit(dt.datetime(2024, 1, 15)))
    path = fresh_dir(spark, "spool")
    slot = F.floor(F.datediff("timestamp", F.lit(dt.date(2024, 1, 1))) / SPOOL_DAYS)
    for own in [*[~late & (slot == k) for k in range(-(-31 // SPOOL_DAYS))], late]:
        e.where(own).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", "1").parquet(path)


@register(
    "late_rows_stream",
    _stream_sql(
        5, 1, "news_id", "user_id", ("impression_count", "click_count", "unique_users"),
        f"""window_start, window_end, news_id, impression_count, click_count, unique_users,
        {r6('avg_dwell_time')} as avg_dwell_time,
        {r6('click_count / greatest(impression_count, 1)')} as click_rate,
        {r6('click_count / greatest(impression_count, 1) * 0.4 + unique_users / greatest(impression_count, 1) * 0.3 + (avg_dwell_time / 100.0) * 0.3')} as trend_score,
        '2024-01-31 00:00:00' as virtual_time""",
        rows=f"not ({LATE_SQL})",
    ),
)
def q_late_rows_stream(spark, sf_dir):
    """W1 and W5 over several triggers: the watermark drops the rows that come weeks too late; the
    report carries its virtual time."""
    partials = _run_stream(spark, _spooled(spark, sf_dir), "trend")
    return _ntz(W.trend_report(partials, as_of=dt.datetime(2024, 1, 31)), "window_start", "window_end")


@register(
    "stream_status",
    with_tables(
        "event",
        f"""select 'trend' as kind, count(*) as input_rows,
        (select count(*) from (select distinct time_bucket(interval '1 minutes', "timestamp"), news_id, user_id
                               from e where {LATE_SQL})) as late_groups,
        (select count(distinct floor(date_diff('day', date '2024-01-01', cast("timestamp" as date)) / {SPOOL_DAYS}))
                + max(case when {LATE_SQL} then 1 else 0 end) from e) as batches_with_input,
        date_trunc('second', max("timestamp")) as max_event_time, cast(0 as bigint) as failures from e""",
        names=("e",),
    ),
)
def q_stream_status(spark, sf_dir):
    """What the status log recorded of a monitor's run: rows read, groups dropped by the
    watermark, triggers with input, event-time progress, failures."""
    with SR.StreamLog(spark) as log:
        before = {r["run_id"] for r in log.records()}
        _run_stream(spark, _spooled(spark, sf_dir), "trend")
        status = log.status().where(~F.col("run_id").isin(sorted(before)) & F.col("name").startswith("trend_"))
    return _ntz(status.select(
        F.lit("trend").alias("kind"), "input_rows", F.col("late_rows").alias("late_groups"),
        "batches_with_input", F.date_trunc("second", "max_event_time").alias("max_event_time"), "failures"), "max_event_time")


@register(
    "user_behavior_stream",
    _stream_sql(
        10, 2, "user_id", "news_id", ("total_impressions", "total_clicks", "unique_news_count"),
        f"""window_start, window_end, user_id, total_impressions, total_clicks, unique_news_count,
        {r6('avg_dwell_time')} as avg_dwell_time,
        {r6('case when total_impressions > 0 then (total_clicks * 2.0 + avg_dwell_time / 30.0) / total_impressions else 0.0 end')} as engagement_score,
        {r6('unique_news_count / greatest(total_impressions, 1)')} as diversity_score""",
    ),
)
def q_user_behavior_stream(spark, sf_dir):
    """W2 as a stream over events.parquet (availableNow)."""
    return _ntz(
        W.user_behavior_report(_run_monitor(spark, sf_dir, "user_behavior")), "window_start", "window_end"
    )


@register(
    "user_viewed_news",
    with_tables(
        "event",
        f"""select window_start, window_start + interval '10 minutes' as window_end, user_id, news_id,
        count(impression_id) as views from ({_windows_sql(10, 2)}) w group by window_start, user_id, news_id""",
        names=("e",),
    ),
)
def q_user_viewed_news(spark, sf_dir):
    """W2 companion: articles viewed per user and window (the reference's list, as rows)."""
    return _ntz(W.viewed_news(_run_monitor(spark, sf_dir, "user_behavior")), "window_start", "window_end")


ANOMALY_THRESHOLD = 0.001


@register(
    "anomaly_stream",
    _stream_sql(
        15, 5, "news_id", "user_id", ("impressions", "clicks", "unique_users"),
        f"""window_start, window_end, news_id, impressions, clicks, unique_users,
        {r6('avg_dwell_time')} as avg_dwell_time,
        {r6('clicks / greatest(impressions, 1)')} as click_rate,
        {r6('impressions * (clicks / greatest(impressions, 1)) * unique_users / 900.0')} as virality_score""",
        where=f"where impressions * (clicks / greatest(impressions, 1)) * unique_users / 900.0 > {ANOMALY_THRESHOLD}",
    ),
)
def q_anomaly_stream(spark, sf_dir):
    """W3 as a stream (threshold 0.001: on this data score = clicks × users / 900)."""
    partials = _run_monitor(spark, sf_dir, "anomaly")
    return _ntz(W.anomaly_report(partials, threshold=ANOMALY_THRESHOLD), "window_start", "window_end")


_SENTIMENT_SQL = """case when {h} is null or {h} = '' then 0.0 else
  cast((contains(lower({h}), 'good')::int + contains(lower({h}), 'great')::int + contains(lower({h}), 'amazing')::int
   + contains(lower({h}), 'excellent')::int + contains(lower({h}), 'success')::int + contains(lower({h}), 'win')::int
   + contains(lower({h}), 'best')::int)
  - (contains(lower({h}), 'bad')::int + contains(lower({h}), 'terrible')::int + contains(lower({h}), 'worst')::int
   + contains(lower({h}), 'fail')::int + contains(lower({h}), 'crisis')::int + contains(lower({h}), 'disaster')::int
   + contains(lower({h}), 'problem')::int) as double)
  / greatest(len(list_filter(string_split_regex(lower({h}), '\\s+'), lambda x: x <> '')), 1) end"""


@register(
    "content_stream",
    with_tables(
        "event",
        f"""select window_start, window_start + interval '5 minutes' as window_end, w.news_id, n.headline,
        count(impression_id) as impressions, cast(coalesce(sum(clicked), 0) as bigint) as clicks,
        {r6('sum(dwell_time) / count(dwell_time)')} as avg_dwell_time,
        {r6('coalesce(sum(clicked), 0) / greatest(count(impression_id), 1)')} as engagement_rate,
        {r6(_SENTIMENT_SQL.format(h='n.headline'))} as headline_sentiment
        from ({_windows_sql(5, None)}) w left join n on w.news_id = n.news_id
        group by window_start, w.news_id, n.headline""",
    ),
)
def q_content_stream(spark, sf_dir):
    """W4 as a stream, enriched by a stream-static join with the articles (J4) + U1."""
    partials = _run_monitor(spark, sf_dir, "content")
    return _ntz(W.content_report(partials, news=B.event_news(spark, sf_dir)), "window_start", "window_end")


@register(
    "headline_sentiment",
    with_tables(
        "event",
        f"select news_id, headline, {r6(_SENTIMENT_SQL.format(h='headline'))} as sentiment from n",
        names=("n",),
    ),
)
def q_headline_sentiment(spark, sf_dir):
    """U1 over every document headline."""
    n = B.event_news(spark, sf_dir)
    return n.select("news_id", "headline", headline_sentiment(F.col("headline")).alias("sentiment"))


@register("ingest_stream", with_tables("event", f"{_EXPOSURE_SQL} from e", names=("e",)))
def q_ingest_stream(spark, sf_dir):
    """Exposures written as JSON-lines files (K4), ingested by the spool-folder stream
    into the keyed exposure table."""
    spool = fresh_dir(spark, "spool")
    S.write_jsonl(B.event_exposures(spark, sf_dir).repartition(4), spool)
    q, table = SR.ingest_stream(
        spark, spool, fresh_dir(spark, "exposure_logs"), checkpoint=fresh_dir(spark, "ingest-ckpt"),
        name=f"ingest_{fresh_dir(spark, 'q').rsplit('-', 1)[-1]}", available_now=True,
    )
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return _ntz(table.read().select(*_EXPOSURE_COLS), "timestamp")


# --------------------------------------------------------------------------- U2 / R24 / U3

POPULAR_SQL = """
SELECT n.headline, n.category, COUNT(e.news_id) AS view_count
FROM news n JOIN exposure_logs e ON n.news_id = e.news_id
GROUP BY n.news_id, n.headline, n.category
ORDER BY view_count DESC, n.news_id LIMIT 10
"""


@register(
    "run_sql",
    with_tables(
        "event",
        POPULAR_SQL.replace("FROM news n JOIN exposure_logs e", "FROM n JOIN e"),
    ),
)
def q_run_sql(spark, sf_dir):
    """The canned 'most popular news' SQL run over the event tables as views."""
    e, n = _event(spark, sf_dir)
    return BI.run_sql(spark, POPULAR_SQL, {"news": n, "exposure_logs": e})


BI_AS_OF = dt.datetime(2024, 1, 31)
BI_CATEGORY = "src3"


@register(
    "bi_popular_last_week",
    with_tables(
        "event",
        f"""select e.news_id, n.headline, n.category, count(*) as view_count from e join n on e.news_id = n.news_id
        where "timestamp" >= timestamp '{BI_AS_OF - dt.timedelta(days=7)}' and "timestamp" <= timestamp '{BI_AS_OF}'
        group by 1, 2, 3 order by view_count desc, e.news_id limit 10""",
    ),
)
def q_bi_popular_last_week(spark, sf_dir):
    """R24 (1): most popular articles of the last week."""
    e, n = _event(spark, sf_dir)
    return BI.popular_last_week(e, n, as_of=BI_AS_OF)


@register(
    "bi_category_ctr_top",
    with_tables(
        "event",
        f"""select category, count(*) as exposures, cast(coalesce(sum(clicked), 0) as bigint) as clicks,
        {r6('coalesce(sum(clicked), 0) / greatest(count(*), 1)')} as ctr
        from e join n on e.news_id = n.news_id group by category
        order by coalesce(sum(clicked), 0) / greatest(count(*), 1) desc, category limit 3""",
    ),
)
def q_bi_category_ctr_top(spark, sf_dir):
    """R24 (2): the three categories with the highest click-through rate."""
    e, n = _event(spark, sf_dir)
    return BI.category_ctr_top(e, n)


@register(
    "bi_trending_in_category",
    with_tables(
        "event",
        f"""select e.news_id, cast(coalesce(sum(clicked), 0) as bigint) as clicks, count(*) as exposures, n.headline
        from e join n on e.news_id = n.news_id
        where n.category = '{BI_CATEGORY}' and "timestamp" >= timestamp '{BI_AS_OF - dt.timedelta(days=7)}'
          and "timestamp" <= timestamp '{BI_AS_OF}'
        group by e.news_id, n.headline order by clicks desc, exposures desc, e.news_id limit 10""",
    ),
)
def q_bi_trending_in_category(spark, sf_dir):
    """R24 (3): trending headlines of one category (last week, by clicks)."""
    e, n = _event(spark, sf_dir)
    return BI.trending_in_category(e, n, category=BI_CATEGORY, as_of=BI_AS_OF)


@register(
    "bi_engagement_by_category",
    with_tables(
        "event",
        f"""select category, count(*) as exposures, cast(coalesce(sum(clicked), 0) as bigint) as clicks,
        count(distinct user_id) as unique_users, {r6('coalesce(avg(dwell_time), 0.0)')} as avg_dwell_time,
        {r6('coalesce(sum(clicked), 0) / greatest(count(*), 1)')} as ctr
        from e join n on e.news_id = n.news_id group by category""",
    ),
)
def q_bi_engagement_by_category(spark, sf_dir):
    """R24 (4): engagement statistics per category."""
    e, n = _event(spark, sf_dir)
    return BI.engagement_by_category(e, n)


@register(
    "bi_longest_dwell",
    with_tables(
        "event",
        f"""select e.news_id, {r6('avg(dwell_time)')} as avg_dwell_time, count(*) as clicks, n.headline
        from e join n on e.news_id = n.news_id where clicked = 1
        group by e.news_id, n.headline order by avg(dwell_time) desc, e.news_id limit 5""",
    ),
)
def q_bi_longest_dwell(spark, sf_dir):
    """R24 (5): the five articles with the longest mean dwell of their clicks."""
    e, n = _event(spark, sf_dir)
    return BI.longest_dwell(e, n)


_QLOG_TRENDS_COUNT = f"(select count(*) from ({_TRENDS_SQL.format(where=_TRENDS_RANGE)}) t)"
_QLOG_HOT_COUNT = (
    f"(select count(*) from ({_hot_sql(HOT_ORDER['as_of'], HOT_ORDER['hours'], HOT_ORDER['min_impressions'])}) h)"
)


@register(
    "query_log_roundtrip",
    with_tables(
        "order",
        f"""select 'category_trends' as query_type,
               '{{"end": "1997-03-31T00:00:00", "start": "1997-01-01T00:00:00"}}' as query_params,
               cast({_QLOG_TRENDS_COUNT} as bigint) as result_count, true as success, false as failed_with_message
        union all
        select 'hot_news', '{{"as_of": "2001-08-01T00:00:00", "hours": 8760, "min_impressions": 4}}',
               cast({_QLOG_HOT_COUNT} as bigint), true, false
        union all
        select 'missing_table', '{{}}', 0, false, true""",
    ),
)
def q_query_log_roundtrip(spark, sf_dir):
    """U3 + K3: three timed runs (two reports and one failing statement) logged to a query-log
    table, read back without the timing columns."""
    e, n = _order(spark, sf_dir)
    log = QL.QueryLogger(spark, fresh_dir(spark, "query_logs"))
    log.timed("category_trends", lambda start, end: R.category_trends(e, n, start=start, end=end),
              start=TRENDS_START, end=TRENDS_END)
    log.timed("hot_news", lambda **kw: R.hot_news(e, n, **kw), **HOT_ORDER)
    try:
        log.timed("missing_table", lambda: spark.sql("select * from no_such_table_here"))
    except Exception:  # noqa: BLE001 - the failure is what gets logged
        pass
    return log.table().select(
        "query_type", "query_params", "result_count", "success",
        (F.col("error_message").isNotNull()).alias("failed_with_message"),
    )


# --------------------------------------------------------------------------- stored layout
def stored_order_tables(spark, sf_dir):
    """ETL the order binding into the keyed layout (K1 / K2 first load) and open it."""
    e_path, n_path = fresh_dir(spark, "exposure_logs"), fresh_dir(spark, "news")
    K.exposure_table(spark, e_path, grain="month").upsert(B.order_exposures(spark, sf_dir))
    K.news_table(spark, n_path).upsert(B.order_news(spark, sf_dir))
    return K.exposure_log(spark, e_path), K.news_table(spark, n_path).read()


@register(
    "category_trends_stored",
    _trends_sql(
        "order",
        "where e.\"timestamp\" >= timestamp '1997-01-01' and e.\"timestamp\" <= timestamp '1997-03-31'",
    ),
)
def q_category_trends_stored(spark, sf_dir):
    """R3 over the stored, month-partitioned exposure table (partition pruning on the range)."""
    e, n = stored_order_tables(spark, sf_dir)
    return R.category_trends(e, n, start=TRENDS_START, end=TRENDS_END)


WIDE_CATEGORIES = [f"Brand#{i}" for i in range(1, 26)]


@register(
    "interest_timeline_wide",
    with_tables(
        "order",
        "select date_trunc('day', e.\"timestamp\") as \"timestamp\", "
        + ", ".join(
            f"cast(sum(case when category = '{c}' then clicked else 0 end) as bigint) as \"{c}\""
            for c in WIDE_CATEGORIES
        )
        + f" from e join n on e.news_id = n.news_id where e.user_id = '{TIMELINE_USER}'"
        " and category is not null group by 1",
    ),
)
def q_interest_timeline_wide(spark, sf_dir):
    """R6 as the dashboard map: one row per day, one zero-filled column per category (pivot)."""
    e, n = _order(spark, sf_dir)
    return R.interest_timeline(e, n, user=TIMELINE_USER, wide=True, categories=WIDE_CATEGORIES)


@register(
    "decorate_cold_start",
    with_tables(
        "order",
        f"""with hot as (select news_id, category, topic, headline, impressions as popularity
               from ({_hot_sql(HOT_ORDER['as_of'], HOT_ORDER['hours'], HOT_ORDER['min_impressions'])}) h
               order by click_rate desc, news_id limit 10)
        select *, cast(null as double) as predicted_interest, cast(0.5 as double) as relevance_score,
               round(popularity / 100.0, 2) as category_affinity,
               (select count(distinct category) from hot) as distinct_categories,
               row_number() over (order by popularity desc, news_id) as rank
        from hot""",
    ),
)
def q_decorate_cold_start(spark, sf_dir):
    """R12 over an R11 cold-start list (order binding)."""
    e, n = _order(spark, sf_dir)
    recs = R.recommend(
        e, n, user=COLD_USER, as_of=HOT_ORDER["as_of"], cold_hours=HOT_ORDER["hours"],
        cold_min_impressions=HOT_ORDER["min_impressions"],
    )
    return R.decorate_recommendations(recs)


@register(
    "load_tables",
    with_tables("event", "select category, count(*) as exposures from e join n on e.news_id = n.news_id group by 1"),
)
def q_load_tables(spark, sf_dir):
    """Both keyed tables written below one root (the exposures twice: a replay by key), opened
    as views, and counted by category."""
    root = fresh_dir(spark, "tables")
    e = B.event_exposures(spark, sf_dir)
    K.upsert_exposures(spark, e, f"{root}/exposure_logs")
    K.upsert_exposures(spark, e, f"{root}/exposure_logs")
    K.upsert_news(spark, B.event_news(spark, sf_dir), f"{root}/news")
    t = S.load_tables(spark, root)
    return t["exposure_logs"].join(t["news"], "news_id").groupBy("category").agg(F.count("*").alias("exposures"))


@register(
    "upsert_moved_keys",
    with_tables(
        "event",
        f"""select impression_id, user_id, news_id,
               case when clicked = 1 then "timestamp" + interval '1 day' else "timestamp" end as "timestamp",
               clicked, dwell_time from e""",
        names=("e",),
    ),
)
def q_upsert_moved_keys(spark, sf_dir):
    """K2 with keys that change partition: clicked exposures are sent again one day later."""
    e = B.event_exposures(spark, sf_dir)
    path = fresh_dir(spark, "exposure_logs")
    K.upsert_exposures(spark, e, path)
    moved = e.where("clicked = 1").withColumn("timestamp", F.col("timestamp") + F.expr("interval 1 day"))
    return K.upsert_exposures(spark, moved, path).select(*_EXPOSURE_COLS)
