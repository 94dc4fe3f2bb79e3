"""Predicates over exposures and articles (P1–P12), composed as plain ``where`` clauses.

All predicates are column-vs-literal comparisons on stored columns where possible, so
Catalyst pushes them into the parquet scan; article-attribute filters are turned into a semi
join of the exposures against the (filtered) article keys.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as m

PREVIEW_CHARS = 150


def list_news(
    news: DataFrame,
    *,
    category: str | None = None,
    limit: int = 50,
    offset: int = 0,
    after: str | None = None,
) -> DataFrame:
    """P10: one page of articles in ``news_id`` order, with a 150-character body preview.

    ``news_body_preview`` is the body cut to 150 characters plus ``...`` only when longer.
    ``has_more`` is true when the page is full (the reference's rule). The page is a top-k
    with offset (``TakeOrderedAndProject``): each task keeps ``offset + limit`` rows, fine for
    the first pages; for deep paging pass the last ``news_id`` seen as ``after`` (keyset
    paging: a pushed-down ``news_id > after`` filter, then a top-``limit``).
    """
    n = news if category is None else news.where(F.col("category") == category)
    if after is not None:
        n = n.where(F.col("news_id") > after)
    body = F.col("news_body")
    preview = F.when(
        F.length(body) > PREVIEW_CHARS, F.concat(F.substring(body, 1, PREVIEW_CHARS), F.lit("..."))
    ).otherwise(body)
    page = (
        n.select("news_id", "category", "topic", "headline", "news_body")
        .orderBy("news_id")
        .offset(offset)
        .limit(limit)
    )
    return page.withColumn("news_body_preview", preview).withColumn(
        "has_more", F.count(F.lit(1)).over(Window.partitionBy()) == F.lit(limit)
    )


def _length_between(col: str, bounds: tuple[int | None, int | None] | None):
    if not bounds:
        return None
    lo, hi = bounds
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.length(col) >= lo)
    if hi is not None:
        cond = cond & (F.length(col) <= hi)
    return cond


def filter_exposures(
    exposures: DataFrame,
    news: DataFrame | None = None,
    *,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    user: str | None = None,
    users: Iterable[str] | None = None,
    categories: Iterable[str] | None = None,
    topics: Iterable[str] | None = None,
    headline_length: tuple[int | None, int | None] | None = None,
    body_length: tuple[int | None, int | None] | None = None,
) -> DataFrame:
    """Exposures matching any combination of time, user and article conditions.

    Time range is closed on both ends (P3). Article conditions (category / topic lists,
    headline and body length ranges) filter the article table first; exposures are then kept
    by a semi join on ``news_id``, so no article column is carried through the shuffle.
    """
    e = m.between_inclusive(exposures, "timestamp", start, end)
    if user is not None:
        e = e.where(F.col("user_id") == user)
    if users is not None:
        e = e.where(F.col("user_id").isin(list(users)))
    article_conds = []
    if categories is not None:
        article_conds.append(F.col("category").isin(list(categories)))
    if topics is not None:
        article_conds.append(F.col("topic").isin(list(topics)))
    for c in (_length_between("headline", headline_length), _length_between("news_body", body_length)):
        if c is not None:
            article_conds.append(c)
    if article_conds:
        if news is None:
            raise ValueError("article conditions need the news table")
        cond = article_conds[0]
        for c in article_conds[1:]:
            cond = cond & c
        e = e.join(news.where(cond).select("news_id"), "news_id", "left_semi")
    return e.drop(m.PARTITION_COLUMN)
