"""File sources (S1, S2, S3, S6) and the JSON-lines writer (K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

CORRUPT = "_corrupt_record"

TSV_OPTIONS = {
    "sep": "\t",
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
JSON_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _require(df: DataFrame, columns, path: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: header columns not found: {', '.join(missing)}")


def read_news_tsv(
    spark: SparkSession, path: str, *, optional: tuple[str, ...] = ("Title entity", "Entity content")
) -> DataFrame:
    """The article TSV, columns selected by header name and renamed to snake_case.

    A header column that is not found is an error, unless it is in ``optional`` (then NULL).

    No schema is given (every column is read as a string): an explicit schema would bind by
    position and silently shift columns of a file with a different column order. Bodies may
    hold quoted newlines, hence ``multiLine`` (one task per file; a one-off dimension load).
    """
    df = spark.read.options(**TSV_OPTIONS).option("multiLine", "true").csv(path)
    wanted = [c for c in schemas.NEWS_TSV_COLUMNS if c not in optional]
    _require(df, wanted, path)
    return df.select([
        (F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")).alias(name)
        for c, name in schemas.NEWS_TSV_COLUMNS.items()
    ])


def read_impressions_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Raw impression TSV (``UserID, pos, neg, dwelltime_pos, start, end``), splittable."""
    df = spark.read.options(**TSV_OPTIONS).csv(path)
    _require(df, schemas.IMPRESSION_TSV_COLUMNS, path)
    return df.select(*schemas.IMPRESSION_TSV_COLUMNS)


def write_tsv(df: DataFrame, path: str) -> None:
    """Write a DataFrame as TSV with a header (quoted fields, doubled quotes)."""
    df.write.mode("overwrite").options(**TSV_OPTIONS).option("quoteAll", "true").csv(path)


def stream_exposures_dir(
    spark: SparkSession,
    path: str,
    *,
    clean_source: str | None = None,
    archive_dir: str | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """S3: watch a spool folder of JSON-lines exposure files.

    ``clean_source='delete'`` removes consumed files (Spark does it lazily, in a later batch);
    ``'archive'`` moves them to ``archive_dir``. Records that are not JSON objects, or hold a field
    of the wrong type, carry their text in ``_corrupt_record`` (as in ``parse_json_records``).
    """
    full = T.StructType([*schemas.EXPOSURE_JSON.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.readStream.schema(full).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT
    )
    if clean_source:
        reader = reader.option("cleanSource", clean_source)
        if archive_dir:
            reader = reader.option("sourceArchiveDir", archive_dir)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.json(path)


def write_jsonl(df: DataFrame, path: str, *, mode: str = "append") -> None:
    """K4: append exposures as JSON lines (ISO timestamps with microseconds)."""
    df.write.mode(mode).option("timestampFormat", JSON_TIME_FORMAT).option(
        "timestampNTZFormat", JSON_TIME_FORMAT
    ).json(path)


def load_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The keyed tables (resolved rows) and the query log under ``root`` as temp views.

    A table that was never written is left out; one that cannot be read raises.
    """
    from ..sinks import keyed

    out: dict[str, DataFrame] = {}
    root = root.rstrip("/")
    for name, table in (
        ("news", keyed.news_table(spark, f"{root}/news")),
        ("exposure_logs", keyed.exposure_table(spark, f"{root}/exposure_logs")),
    ):
        if table.exists():
            out[name] = table.read()
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/query_logs")
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        from ..plans.querylog import read_query_log

        out["query_logs"] = read_query_log(spark, f"{root}/query_logs", keep_partition=False)
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out
