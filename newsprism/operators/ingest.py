"""Ingest transforms (T1–T7): raw records → exposure rows.

All of them are narrow, per-row column expressions except ``latest_by_key`` (one hash
aggregation with map-side combine) and ``assign_impression_ids`` (a sort plus a tiny
per-partition count table).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from .. import schemas
from ..functions.metrics import parse_time
from ..session import shared_dir

CORRUPT = "_corrupt_record"


# --------------------------------------------------------------------------- T1 / T2 / T3
def parse_json_records(
    df: DataFrame,
    *,
    value_col: str = "value",
    schema: T.StructType = schemas.EXPOSURE_JSON,
    keep_malformed: bool = False,
) -> DataFrame:
    """bytes/string JSON payloads → flat columns of ``schema``.

    Malformed payloads (not JSON, or not an object) are dropped; with ``keep_malformed`` they
    are kept with their raw text in ``_corrupt_record`` so the caller can count them.
    """
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    parsed = df.select(
        F.from_json(
            F.col(value_col).cast("string"),
            full,
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
        ).alias("data")
    ).select("data.*")
    if keep_malformed:
        return parsed
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def cast_event_times(
    df: DataFrame, columns: Sequence[str] = ("timestamp", "processed_timestamp")
) -> DataFrame:
    """Time strings (ISO-8601 or ``M/d/yyyy h:mm:ss AM``) → TIMESTAMP; unparsable values
    become NULL instead of failing the job."""
    for c in columns:
        if c in df.columns:
            df = df.withColumn(c, parse_time(c))
    return df


def stamp_processed(df: DataFrame) -> DataFrame:
    """Add the processing time."""
    return df.withColumn("processed_timestamp", F.current_timestamp())


# --------------------------------------------------------------------------- T4
def _tokens(c: str) -> Column:
    """Whitespace-separated tokens of a string column, without empty tokens."""
    return F.filter(F.split(F.trim(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda x: x != "")


def explode_impressions(raw: DataFrame, *, id_col: str = "impression_id") -> DataFrame:
    """T4: one raw impression → one exposure row per shown article.

    Clicked articles (``pos``) pair with ``dwelltime_pos`` position by position; the pairing
    stops at the shorter list. Unclicked articles (``neg``) get dwell 0. Every row takes the
    impression's ``start`` time. Both lists become one array of structs and one ``explode``,
    so each raw row is read and parsed once (a union of two explodes would evaluate the input
    twice).
    """
    r = raw.select(
        F.col(id_col).alias("impression_id"),
        F.col("UserID").alias("user_id"),
        parse_time("start").alias("timestamp"),
        _tokens("pos").alias("pos"),
        _tokens("dwelltime_pos").alias("dw"),
        _tokens("neg").alias("neg"),
    )
    n = F.least(F.size("pos"), F.size("dw"))
    pairs = F.arrays_zip(F.slice("pos", 1, n).alias("news_id"), F.slice("dw", 1, n).alias("dwell"))
    clicked = F.transform(
        pairs,
        lambda p: F.struct(
            p["news_id"].alias("news_id"),
            F.lit(1).alias("clicked"),
            p["dwell"].try_cast("int").cast("double").alias("dwell_time"),
        ),
    )
    unclicked = F.transform(
        "neg",
        lambda x: F.struct(
            x.alias("news_id"), F.lit(0).alias("clicked"), F.lit(0.0).alias("dwell_time")
        ),
    )
    return r.select(
        "impression_id", "user_id", "timestamp", F.explode(F.concat(clicked, unclicked)).alias("x")
    ).select("impression_id", "user_id", "x.news_id", "timestamp", "x.clicked", "x.dwell_time")


# --------------------------------------------------------------------------- T5 / T7
def in_file_order(raw: DataFrame) -> tuple[DataFrame, list[str]]:
    """``raw`` with columns that sort it in input order when it is read from files (file path,
    block in the file, row in the block; Spark packs splits by size, so partitions are not in that
    order), and their names; a frame that is not a file scan is returned as it is."""
    try:
        raw.select("_metadata.file_path")
    except AnalysisException:
        return raw, []
    cols = ["_file", "_block", "_row"]
    return raw.select(
        "*", F.col("_metadata.file_path").alias(cols[0]),
        F.col("_metadata.file_block_start").alias(cols[1]),
        F.monotonically_increasing_id().alias(cols[2]),
    ), cols


def assign_impression_ids(
    raw: DataFrame,
    *,
    order_by: Sequence[str | Column] | None = None,
    prefix: str = "imp_",
    width: int = 7,
    id_col: str = "impression_id",
) -> DataFrame:
    """T5: dense 1-based sequence ids ``imp_0000001, …`` in the order of the input files (path, block
    in the file, row in the block), or else in ``order_by`` order.

    Input that is read from files is neither sorted nor copied: one narrow pass counts the rows of
    each block, a running sum over the blocks (one row each) gives their offsets, and the numbering
    pass adds a row's place in its block. Both passes scan the files in the same splits. With
    ``order_by``, or for rows that do not come from files, the rows are (range-)sorted and cut from
    their lineage with ``checkpoint()`` (reliable storage), so that partition numbers are stable,
    and partitions take the part of the blocks.
    """
    block = ["_file", "_block"]
    df = raw if order_by else in_file_order(raw)[0]
    if df is raw:
        shared_dir(raw.sparkSession)  # make sure the session has a (shared) checkpoint dir
        df = (raw.orderBy(*order_by) if order_by else raw).checkpoint(eager=True)
        block = ["_block"]
        df = df.withColumn("_block", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    # the row ids rise within a task; a block's rows are consecutive in the task that reads it
    counts = df.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.orderBy(*block)) - F.col("_n")
    offsets = counts.select(*block, (before - F.col("_first")).alias("_offset"))
    numbered = df.join(offsets, block)
    seq = F.col("_offset") + F.col("_row") + 1
    return numbered.withColumn(
        id_col, F.format_string(f"{prefix}%0{width}d", seq)
    ).withColumn("_seq", seq).drop(*block, "_row", "_offset")


def first_n_impressions(
    raw: DataFrame,
    n: int,
    *,
    seq_col: str = "_seq",
    order_by: Sequence[str | Column] | None = None,
    prefix: str = "imp_",
    width: int = 7,
) -> DataFrame:
    """The first ``n`` impressions (not rows), exploded into exposures.

    Numbered input is cut by its sequence id. With ``order_by`` the input need not be numbered:
    a top-``n`` (each task keeps ``n`` rows) comes first and only those rows get their ids.
    """
    if order_by is None:
        return explode_impressions(raw.where(F.col(seq_col) <= n))
    first = raw.orderBy(*order_by).limit(n)
    seq = F.row_number().over(Window.orderBy(*order_by))  # n rows at most
    first = first.withColumn("impression_id", F.format_string(f"{prefix}%0{width}d", seq.cast("long")))
    return explode_impressions(first)


# --------------------------------------------------------------------------- T6
def latest_by_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Last-write-wins collapse: per key, the row that is greatest by ``order``.

    Written as ``max(struct(order..., other columns...))`` per key: an aggregation (by sorting,
    as the structs hold text) with map-side partial aggregation, so a key holding a large share
    of all rows is reduced in every task before the shuffle (a ``row_number`` window would sort
    the whole key in one task). Remaining columns act as the final tie-breaker, which makes the pick deterministic.
    """
    keys = list(keys)
    order = list(order)
    values = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c).alias(c) for c in order + values])
    best = df.groupBy(*keys).agg(F.max(packed).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in order + values])
