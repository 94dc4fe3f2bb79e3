"""Hand-made micro-fixtures for the batch reports (values worked out by hand)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsprism.operators import filters as P
from newsprism.plans import reports as R

T0 = dt.datetime(2019, 6, 20, 10, 0, 0)
EXPOSURE_DDL = (
    "impression_id string, user_id string, news_id string, timestamp timestamp, "
    "clicked int, dwell_time double"
)
NEWS_DDL = "news_id string, category string, topic string, headline string, news_body string"


def h(hours=0.0, minutes=0.0):
    return T0 + dt.timedelta(hours=hours, minutes=minutes)


@pytest.fixture(scope="module")
def tables(spark):
    e = spark.createDataFrame(
        [
            # impression i1 shows two sports articles, one clicked
            ("i1", "u1", "n1", h(0), 1, 40.0),
            ("i1", "u1", "n2", h(0), 1, 200.0),
            ("i2", "u2", "n1", h(0.5), 0, 0.0),
            ("i3", "u1", "n3", h(1), None, 0.0),  # null click
            ("i4", "u3", "n1", h(2), 0, 0.0),
            ("i5", "u3", "n4", h(30), 1, 10.0),  # after as_of
            ("i6", "u2", "n9", h(0), 1, 5.0),  # article missing from the catalogue
            ("i7", "u2", "n1", None, 1, 1.0),  # no timestamp
        ],
        EXPOSURE_DDL,
    )
    n = spark.createDataFrame(
        [
            ("n1", "sports", "soccer", "Great win", "x" * 150),
            ("n2", "sports", "tennis", "Bad loss", "y" * 151),
            ("n3", "news", None, "Crisis", "z"),
            ("n4", "news", "world", "Goodness! Crisis averted", "w"),
            ("n5", "news", "world", "Never shown", "v"),
        ],
        NEWS_DDL,
    )
    return e, n


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_news_lifecycle_hours_and_bounds(tables):
    e, _ = tables
    out = R.news_lifecycle(e, news_id="n1", start=h(0), end=h(2))
    got = rows(out, "timestamp", "impressions", "clicks", "unique_users", "click_rate", "avg_dwell_time")
    assert got == [
        (h(0), 2, 1, 2, 0.5, 20.0),  # i1 (10:00) + i2 (10:30) in hour 10; both range ends inclusive
        (h(2), 1, 0, 1, 0.0, 0.0),
    ]
    assert R.news_lifecycle(e, news_id="n1", start=h(0, 1), end=h(1.9)).count() == 1


def test_lifecycle_summary(tables):
    e, _ = tables
    s = R.lifecycle_summary(R.news_lifecycle(e, news_id="n1")).first()
    assert (s.total_impressions, s.total_clicks, s.peak_impressions) == (3, 1, 2)
    assert s.ctr == pytest.approx(100 / 3)
    empty = R.lifecycle_summary(R.news_lifecycle(e, news_id="nope")).first()
    assert (empty.total_impressions, empty.ctr) == (0, 0.0)


def test_category_trends_click_rate_can_exceed_one(tables):
    e, n = tables
    out = R.category_trends(e, n, start=h(0), end=h(2))
    got = {(r.category, r.date): r for r in out.collect()}
    sports = got[("sports", dt.datetime(2019, 6, 20))]
    assert (sports.impressions, sports.clicks, sports.unique_users, sports.unique_news) == (3, 2, 3, 2)
    news = got[("news", dt.datetime(2019, 6, 20))]
    assert (news.impressions, news.clicks) == (1, 0)  # a null click counts as 0
    # one impression holding two clicked articles of one category
    one = R.category_trends(e.where(F.col("impression_id") == "i1"), n).first()
    assert one.click_rate == 2.0


def test_category_rollup_rank(tables):
    e, n = tables
    roll = R.category_rollup(R.category_trends(e, n), metric="clicks").orderBy("rank").collect()
    assert [(r.category, r.rank) for r in roll] == [("sports", 1), ("news", 2)]
    # sports: 3 impressions on 2019-06-20 plus the undated i7 (its own NULL-day group)
    assert roll[0].ctr == pytest.approx(3 / 4 * 100)
    with pytest.raises(ValueError):
        R.category_rollup(R.category_trends(e, n), metric="nope")


def test_user_interests_engagement(tables):
    e, n = tables
    out = {(r.user_id, r.category, r.topic): r for r in R.user_interests(e, n, user="u1").collect()}
    soccer = out[("u1", "sports", "soccer")]
    assert soccer.engagement_score == pytest.approx((1 * 2 + 40 / 30) / 1)
    assert ("u1", "news", None) in out


def test_hot_news_cap_bound_and_body(tables):
    e, n = tables
    out = R.hot_news(e, n, as_of=h(2), hours=3, min_impressions=1).collect()
    by = {r.news_id: r for r in out}
    assert set(by) == {"n1", "n2", "n3"}  # n9 has no article, n4 is after as_of
    assert by["n2"].hotness_score == pytest.approx(1.0 * 0.4 + 1.0 * 0.3 + 1.0 * 0.3)  # dwell capped
    assert by["n2"].news_body == "y" * 151
    assert [r.news_id for r in out] == ["n2", "n1", "n3"]  # click_rate desc
    unbounded = R.hot_news(e, n, as_of=h(2), hours=3, min_impressions=1, bounded=False)
    assert "n4" in {r.news_id for r in unbounded.collect()}
    assert R.hot_news(e, n, as_of=h(2), hours=3, min_impressions=3).count() == 1


def test_preferences_and_recommendations(spark, tables):
    e, n = tables
    prefs = rows(R.user_preferences(e, n, user="u1"), "category", "topic", "clicks")
    assert prefs == [("sports", "soccer", 1), ("sports", "tennis", 1)]
    # u2 clicked n1 (sports/soccer) and n9 (no article): the only unseen sports/soccer
    # article does not exist, so nothing is recommended
    recs = R.recommend(e, n, user="u2", as_of=h(2)).collect()
    assert [r.news_id for r in recs] == []
    recs_u3 = R.recommend(e, n, user="u3", as_of=h(40), cold_hours=48, cold_min_impressions=1)
    # u3 clicked n4 (news/world): candidates news/world unseen → n5 has no exposures → empty
    assert recs_u3.count() == 0
    cold = R.recommend(e, n, user="ghost", as_of=h(2), cold_hours=3, cold_min_impressions=1, limit=2)
    assert [r.news_id for r in cold.collect()] == ["n2", "n1"]


def test_recommend_cold_start_when_clicks_have_no_article(spark, tables):
    """Preferences come from clicked articles found in the catalogue: a user whose only click
    is on a missing article has none and gets the hot news, like a user without clicks."""
    e, n = tables
    e9 = e.unionByName(spark.createDataFrame([("i8", "u9", "n9", h(1), 1, 3.0)], EXPOSURE_DDL))
    assert R.preference_pairs(e9, n, user="u9") == []
    cold = R.recommend(e9, n, user="u9", as_of=h(2), cold_hours=3, cold_min_impressions=1, limit=2)
    assert [r.news_id for r in cold.collect()] == ["n2", "n1"]
    # with preferences given as literals the plan matches the joined-in R9 plan
    prefs = R.preference_pairs(e, n, user="u1")
    assert prefs == [("sports", "soccer"), ("sports", "tennis")]
    literal = R.recommend_for_preferences(e, n, user="u1", preferences=prefs)
    planned = R.recommend_for_preferences(e, n, user="u1")
    assert rows(literal, "news_id", "popularity") == rows(planned, "news_id", "popularity")


def test_decorate_recommendations(spark):
    recs = spark.createDataFrame(
        [("a", "c1", 0.0, 123), ("b", "c2", 0.25, 50), ("c", "c1", None, 7)],
        "news_id string, category string, predicted_interest double, popularity long",
    )
    out = {r.news_id: r for r in R.decorate_recommendations(recs).collect()}
    assert out["a"].relevance_score == 0.5 and out["c"].relevance_score == 0.5
    assert out["b"].relevance_score == 0.25
    assert out["a"].category_affinity == 1.23
    assert {r.distinct_categories for r in out.values()} == {2}
    assert out["b"].rank == 1


def test_insights_empty_window_gives_zeros(tables):
    e, _ = tables
    r = R.insights_overview(e, as_of=dt.datetime(2030, 1, 1), hours=1).first()
    assert (r.total_impressions, r.total_clicks, r.overall_ctr, r.avg_dwell_time) == (0, 0, 0.0, 0.0)


def test_interest_timeline_zero_fill_and_stats(tables):
    e, n = tables
    tl = R.interest_timeline(e, n, user="u3")
    got = rows(tl, "timestamp", "category", "interest")
    d1, d2 = dt.datetime(2019, 6, 20), dt.datetime(2019, 6, 21)
    assert got == [(d1, "news", 0), (d1, "sports", 0), (d2, "news", 1), (d2, "sports", 0)]
    stats = {r.category: r for r in R.interest_stats(tl).collect()}
    assert stats["news"].trend == 1 and stats["news"].rising_rank == 1
    assert stats["sports"].rising_rank is None
    wide = R.interest_timeline(e, n, user="u3", wide=True, categories=["news", "sports"]).collect()
    assert wide[1]["news"] == 1


def test_list_news_preview_and_paging(tables):
    _, n = tables
    page = P.list_news(n, limit=2, offset=0).collect()
    assert [r.news_id for r in page] == ["n1", "n2"]
    assert page[0].news_body_preview == "x" * 150  # exactly 150: unchanged
    assert page[1].news_body_preview == "y" * 150 + "..."
    assert page[0].has_more is True
    last = P.list_news(n, limit=2, offset=4).collect()
    assert [r.news_id for r in last] == ["n5"] and last[0].has_more is False


def test_filter_exposures_combinations(tables):
    e, n = tables
    out = P.filter_exposures(e, n, categories=["sports"], topics=["soccer", "tennis"], users=["u1", "u2"])
    assert sorted(rows(out, "impression_id", "news_id")) == [("i1", "n1"), ("i1", "n2"), ("i2", "n1"), ("i7", "n1")]
    out = P.filter_exposures(e, n, body_length=(151, None), start=h(0), end=h(0))
    assert rows(out, "news_id") == [("n2",)]
    with pytest.raises(ValueError):
        P.filter_exposures(e, categories=["x"])


def test_popular_news(tables):
    e, n = tables
    got = rows(R.popular_news(e, n, limit=2), "news_id", "view_count")
    assert got == [("n1", 4), ("n2", 1)]


def test_approximate_distinct_mode_is_close(spark):
    from newsprism.sources import bindings as B

    e, n = B.event_exposures(spark, "/root/testdata/sf0.01"), B.event_news(spark, "/root/testdata/sf0.01")
    exact = {(r.category, r.date): r for r in R.category_trends(e, n).collect()}
    approx = {(r.category, r.date): r for r in R.category_trends(e, n, exact=False).collect()}
    assert exact.keys() == approx.keys()
    for k, r in exact.items():
        # 3 standard errors of a sketch with 5% relative standard deviation
        assert abs(approx[k].unique_users - r.unique_users) <= max(3, 0.15 * r.unique_users)
        assert approx[k].clicks == r.clicks


def test_overview_sections(spark):
    from newsprism.sources import bindings as B

    sf = "/root/testdata/sf0.001"
    e, n, q = B.order_exposures(spark, sf), B.order_news(spark, sf), B.event_query_log(spark, sf)
    parts = R.overview_sections(
        e, n, q, as_of=dt.datetime(2001, 8, 1), start=dt.datetime(1997, 1, 1), end=dt.datetime(1997, 3, 31),
        trending_hours=8760, trending_min_impressions=4,
    )
    summary = parts["summary"].first()
    assert summary.trending_news_count == parts["hot_news"].count() + 45  # 50 hot, 5 shown
    assert parts["category_trends"].count() == 50
    assert set(parts) == {"summary", "category_trends", "hot_news", "performance"}


def test_list_news_keyset_paging(tables):
    _, n = tables
    first = P.list_news(n, limit=2).collect()
    second = P.list_news(n, limit=2, after=first[-1].news_id).collect()
    assert [r.news_id for r in second] == ["n3", "n4"]
    assert [r.news_id for r in P.list_news(n, limit=2, offset=2).collect()] == ["n3", "n4"]
