"""The exposure store: one log in three layouts, each for the reports that need it.

* ``exposure_logs``: by time (K2); ranges prune days.
* ``exposure_users``: by hash bucket of the user, sorted by user; one user's history is one bucket
  folder, and in it the files and row groups whose statistics admit the user.
* ``article_days``: totals per article and day (rows, clicks, dwell sums), additive: a batch adds the
  totals of its rows and subtracts those of the rows that it replaces. Reports over all time read it
  in place of every exposure.

A batch goes to the totals first, then to the two layouts. With a stream's tag and epoch (or a
``name``) each step is done once, however often the batch is replayed; the rows that a batch replaces
are looked up in the log, which is written last, so a replay finds the same ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..operators.ingest import latest_by_key
from ..plans import reports as R
from ..session import fresh_dir
from .keyed import GRAIN_FORMATS, HASH, PART, KeyedTable, _remove_dir, exposure_table

TOTALS = ("n", "clicks", "rated", "dwell_sum", "dwell_n")


class SumTable(KeyedTable):
    """A keyed table of sums: the rows of one key in several batches are added up, not replaced."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], partition: Column, sums: Sequence[str], **kw):
        super().__init__(spark, path, key, partition, movable=False, **kw)
        self.sums = list(sums)

    def add(self, rows: DataFrame, *, name: str | None = None, epoch: int | None = None) -> None:
        totals = rows.groupBy(*self.key).agg(*[F.sum(c).alias(c) for c in self.sums])
        self.upsert(totals, unique=True, name=name, epoch=epoch)

    def _resolved(self, manifest: dict, parts: dict[str, list[str]]) -> DataFrame:
        cols = [*self.key, *self.sums, PART]
        single = self._files(manifest, [(b[0], p) for p, b in parts.items() if len(b) == 1]).select(*cols)
        several = [(batch, p) for p, b in parts.items() if len(b) > 1 for batch in b]
        if not several:
            return single
        rows = self._files(manifest, several).groupBy(*self.key, PART).agg(*[F.sum(c).alias(c) for c in self.sums])
        return rows.select(*cols) if not any(len(b) == 1 for b in parts.values()) else single.unionByName(rows.select(*cols))


def user_table(spark: SparkSession, path: str, *, buckets: int = 256) -> KeyedTable:
    """Exposures by hash bucket of the user (part of the key, so keys never move)."""
    return KeyedTable(
        spark, path, ("impression_id", "user_id", "news_id"), F.pmod(F.xxhash64("user_id"), F.lit(buckets)),
        movable=False, sort=("user_id",), bloom=("user_id",),
    )


def totals_of(exposures: DataFrame, sign: int = 1) -> DataFrame:
    """Per exposure the columns of ``article_days``, with ``sign`` -1 for a row that is taken back."""
    dwell = F.col("dwell_time").cast("double")
    return exposures.select(
        "news_id", F.to_date("timestamp").alias("day"), F.lit(sign).cast("long").alias("n"),
        (F.coalesce(F.col("clicked"), F.lit(0)) * sign).cast("long").alias("clicks"),
        (F.col("clicked").isNotNull().cast("long") * sign).alias("rated"),
        (F.coalesce(dwell, F.lit(0.0)) * sign).alias("dwell_sum"),
        (dwell.isNotNull().cast("long") * sign).alias("dwell_n"),
    )


class ExposureStore:
    """The three layouts below ``root`` and the reports that read them."""

    def __init__(self, spark: SparkSession, root: str, *, grain: str = "day", user_buckets: int = 256):
        self.spark, self.root = spark, root.rstrip("/")
        self.user_buckets = user_buckets
        self.log = exposure_table(spark, f"{self.root}/exposure_logs", grain=grain)
        self.users = user_table(spark, f"{self.root}/exposure_users", buckets=user_buckets)
        self.articles = SumTable(
            spark, f"{self.root}/article_days", ("news_id", "day"), F.date_format("day", GRAIN_FORMATS["month"]), TOTALS)

    def upsert(
        self, rows: DataFrame, *, order: Sequence[str] = (), drop: Sequence[str] = (),
        name: str | None = None, epoch: int | None = None,
    ) -> None:
        """Insert-or-replace exposures by primary key, in all three layouts."""
        if epoch is not None and epoch <= self.log.manifest.load()["epochs"].get(name, -1):
            return
        rows = latest_by_key(rows, self.log.key, order)
        rows = rows.select(*[c for c in rows.columns if c not in set(drop)])
        path = fresh_dir(self.spark, "staging")
        rows.write.parquet(path)  # read once by each layout
        rows = self.spark.read.schema(rows.schema).parquet(path)
        name = name or f"u{uuid.uuid4().hex[:12]}"
        how = dict(name=name, epoch=epoch)
        change = totals_of(rows)
        replaced = self.replaced(rows)
        if replaced is not None:
            change = change.unionByName(totals_of(replaced, -1))
        self.articles.add(change, **how)
        self.users.upsert(rows, unique=True, **how)
        self.log.upsert(rows, unique=True, **how)
        _remove_dir(self.spark, path)

    def replaced(self, rows: DataFrame) -> DataFrame | None:
        """The stored rows with the keys of ``rows``: the key index names the partitions that can
        hold them, and no other is read; None if no key has been seen before."""
        if not self.log.exists():
            return None
        own = rows.select(*self.log.key, F.xxhash64(*self.log.key).alias(HASH))
        known = self.log.known(own)
        if known is None:
            return None
        # one row a partition that holds one of the keys
        parts = [r[0] for r in known.join(own, HASH, "left_semi").select(PART).distinct().collect()]
        if not parts:
            return None
        held = self.log.read(only=parts)
        keys = own.drop(HASH)
        same = [held[c].eqNullSafe(keys[c]) for c in self.log.key]
        return held.join(keys, same, "left_semi")

    def tidy(self) -> None:
        for table in (self.articles, self.users, self.log):
            table.tidy()

    # ------------------------------------------------------------------ reports
    def exposures(self, *, start=None, end=None) -> DataFrame:
        return self.log.read(keep_partition=True, start=start, end=end)

    def user_exposures(self, user: str) -> DataFrame:
        """One user's exposures, from the user's bucket only."""
        bucket = F.pmod(F.xxhash64(F.lit(user)), F.lit(self.user_buckets))
        value = self.spark.sql("select 1").select(bucket).first()[0]  # folded on the driver, no job
        return self.users.read(only=[str(value)]).where(F.col("user_id") == user)

    def article_totals(self, *, start=None, end=None) -> DataFrame:
        """Totals per article over the days in ``[start, end]`` (all days by default)."""
        days = self.articles.read(start=start, end=end)
        if start is not None:
            days = days.where(F.col("day") >= F.lit(m.as_datetime(start).date()))
        if end is not None:
            days = days.where(F.col("day") <= F.lit(m.as_datetime(end).date()))
        return days.groupBy("news_id").agg(*[F.sum(c).alias(c) for c in TOTALS]).where("n > 0")

    def popular_news(self, news: DataFrame, *, limit: int = 10) -> DataFrame:
        """R16 from the totals: as many rows as article days, whatever the number of exposures."""
        return R.popular_of(self.article_totals().select("news_id", F.col("n").alias("view_count")), news, limit=limit)

    def user_interests(self, news: DataFrame, *, user: str, start=None, end=None) -> DataFrame:
        """R5 of one user, from the user's bucket."""
        return R.user_interests(self.user_exposures(user), news, user=user, start=start, end=end)

    def user_preferences(self, news: DataFrame, *, user: str, limit: int = 5) -> DataFrame:
        """R9, from the user's bucket."""
        return R.user_preferences(self.user_exposures(user), news, user=user, limit=limit)

    def recommend(
        self, news: DataFrame, *, user: str, as_of, limit: int = 10, cold_hours: float = 6,
        cold_min_impressions: int = 50,
    ) -> DataFrame:
        """R10 with the R11 cold start: the user's clicks and seen articles from the user's bucket, the
        candidates' popularity from the totals, hot news from the last hours of the log. An
        impression belongs to one user, so an article's impressions are its rows."""
        own = self.user_exposures(user)
        prefs = R.preference_pairs(own, news, user=user)
        if prefs:
            return R.recommend_for_preferences(
                own, news, user=user, limit=limit, preferences=prefs, totals=self.article_totals())
        recent = self.exposures(start=R.hours_before(as_of, cold_hours), end=as_of)
        return R.as_recommendations(R.recommend_cold_start(
            recent, news, as_of=as_of, limit=limit, hours=cold_hours, min_impressions=cold_min_impressions))
