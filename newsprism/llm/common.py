"""Shared helpers of the llm operators: tables on shared storage, Arrow text columns, label folds."""

from __future__ import annotations

import atexit
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir

# Text handled at once inside a task, in bytes. Batches are cut to about this size, so the
# working arrays of a task stay at some tens of MB (and in the cache) whatever the lengths of the
# documents; a single longer document is handled alone.
CHUNK_BYTES = 1 << 19

_made: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remove_scratch() -> None:
    """Remove the folders of this process at its end (the shared storage is not ours to fill)."""
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is None:
                continue
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already; scratch folders are then left
            return


atexit.register(_remove_scratch)


def stored(spark: SparkSession, df: DataFrame, prefix: str) -> DataFrame:
    """Write ``df`` as parquet below ``spark.checkpoint.dir`` and read it back.

    The lineage is cut by files every executor can read, so a lost executor costs a task retry
    and never a recomputation of the whole plan.
    """
    path = fresh_dir(spark, f"llm-{prefix}")
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_chunks(
    batch: pa.RecordBatch | pa.Table, column: str = "text", max_bytes: int = CHUNK_BYTES
) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of ``batch`` holding about ``max_bytes`` of text (one row at least)."""
    col = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    lo = acc = 0
    for i, s in enumerate(sizes.tolist()):
        if i > lo and acc + s > max_bytes:
            yield lo, i
            lo, acc = i, 0
        acc += s
    if lo < len(sizes):
        yield lo, len(sizes)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets in them (null and empty: no bytes)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if col.buffers()[2] is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def map_batches(
    fn: Callable, schema: str, df: DataFrame, *, at_end: Callable | None = None
) -> DataFrame:
    """``mapInArrow`` over record batches: ``fn(batch)`` yields dicts of columns; ``at_end`` is
    called when a task has read its last batch, and may yield dicts, too."""
    from pyspark.sql.types import _parse_datatype_string  # DDL text to a Spark type
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(out: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for out in fn(batch):
                yield columns(out)
        for out in (at_end() if at_end else None) or ():
            yield columns(out)

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 3 is 1; such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str, rows: int
) -> DataFrame:
    """(h, text, y) of at most ``rows`` labelled, not held-out documents of each class.

    The sample is the rows with the smallest hash ``h`` of doc_id, so it is the same whatever the
    partitioning; its ids are broadcast (``2 * rows`` at most), so no text is shuffled. Rows with
    a null id, a label other than 0 and 1, or null text are left out.
    """
    y = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .withColumn("h", F.xxhash64("doc_id"))
    )
    ids = y.where("y = 0").orderBy("h").limit(rows).unionByName(y.where("y = 1").orderBy("h").limit(rows))
    ids = stored(spark, ids, "sample")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return text.join(F.broadcast(ids), "doc_id").select("h", "text", "y")
