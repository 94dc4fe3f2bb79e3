"""Keyed parquet tables: insert-or-replace by primary key (K1, K2, K7).

Parquet has no MERGE. An upsert only appends: the rows of a batch (collapsed to one per key, last
write wins, T6) go to a folder of their own, ``_batch=<number>.<name>/_part=<partition>``, and no
existing file is read for the data or rewritten. Of the rows with one key in one partition the one
of the last batch counts.

* **Manifest.** ``_manifest/<version>.json`` lists, for each batch, the partitions whose rows
  count, and the schema. A write becomes visible by one rename of the next version; readers plan
  on the version they found. Files that a version no longer lists stay for ``retention`` seconds,
  so a report planned before a compaction finishes after it.
* **Reads.** A partition with one batch is read as it is. Where later batches wait, their rows,
  resolved among themselves, replace those of the partition's first batch by an anti join on the
  key: the large first batch is not sorted, and not shuffled while Spark finds the later keys small
  enough to broadcast.
* **Keys that change partition** (``movable=True``: a record's time was corrected). A key index
  says where a key has been: (64 hash bits of the key, partition), in bucket folders whose number
  follows the number of keys, so a batch lists and reads the buckets of its own keys only. The batch writes
  a tombstone row into every other partition the key may have been in, so a reader that prunes
  partitions by time never sees the stale row (a tombstone for a key that is not there is harmless).
* **Compaction.** :meth:`KeyedTable.tidy` joins batches of similar size in the partitions that hold
  more than ``MOST_BATCHES``, and leaves all other partitions alone; streams run it.
  :meth:`KeyedTable.compact` joins all batches of every partition that has several. Index batches are joined
  by the same rule.
* **Replay.** A stream's batch carries the stream's tag and its epoch; the manifest keeps the last
  epoch of each stream, and a batch that is already in is not written again. An upsert given the
  ``name`` of an earlier one takes its place.
* **New columns** of later batches are kept (older rows read as NULL there).

One writer at a time per table and process tree is assumed, as for a stream and its checkpoint; two
writers whose renames collide retry on the newer version.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import as_datetime
from ..operators.ingest import in_file_order, latest_by_key
from ..session import fresh_dir

PART = "_part"
BATCH = "_batch"
DELETED = "_deleted"
MANIFEST = "_manifest"
KEYS = "_keys"
HASH = "_h"

RETENTION = 6 * 3600.0  # seconds that files stay after the manifest has dropped them
MOST_BATCHES = 8  # of a partition, before a tidy joins some
TIER = 4  # an older batch joins if it is at most so many times the newer ones together
KEYS_PER_BUCKET = 20_000
MOST_BUCKETS = 1 << 16


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove_dir(spark: SparkSession, path: str) -> None:
    """Delete one of our own folders through Hadoop's FileSystem API (any storage)."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def _children(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, modification time in seconds) of the entries of a folder; none if it is missing."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(p))


def _bloom(columns: Sequence[str]) -> dict[str, str]:
    """Writer options for bloom filters on ``columns``, sized by what a file holds (64 KB at least, else 1 MB each)."""
    on = {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}
    return on | {"parquet.bloom.filter.adaptive.enabled": "true"} if on else {}


def _size(spark: SparkSession, path: str) -> int:
    p, fs = _path(spark, path)
    return fs.getContentSummary(p).getLength()


class Manifest:
    """What counts in a table, as small JSON files of rising version.

    ``live``: {batch folder: [partition folders]}; ``index``: {index folder: {buckets, keys}};
    ``dropped``: {folder: time it was dropped}; ``epochs``: {stream tag: last epoch};
    ``last``: the highest batch number; ``schema``: of the rows, as Spark's JSON.
    """

    EMPTY = {"live": {}, "index": {}, "dropped": {}, "epochs": {}, "last": 0, "schema": None}
    _lock = threading.Lock()

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.path = spark, f"{table}/{MANIFEST}"

    def versions(self) -> list[str]:
        return [n for n, _ in _children(self.spark, self.path) if n.endswith(".json") and n[0].isdigit()]

    def load(self) -> dict:
        found = self.versions()
        return self._read(found[-1]) if found else json.loads(json.dumps(self.EMPTY)) | {"version": 0}

    def _read(self, name: str) -> dict:
        p, fs = _path(self.spark, f"{self.path}/{name}")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"version": int(name.removesuffix(".json"))}

    def commit(self, change: Callable[[dict], None]) -> dict:
        """Apply ``change`` to the newest version and publish the next one by a rename."""
        with self._lock:
            while True:
                m = self.load()
                change(m)
                m["version"] += 1
                to, fs = _path(self.spark, f"{self.path}/{m['version']:012d}.json")
                part, _ = _path(self.spark, f"{self.path}/.{uuid.uuid4().hex}")
                out = fs.create(part, True)
                try:
                    out.write(bytearray(json.dumps(m).encode()))
                finally:
                    out.close()
                if not fs.exists(to) and fs.rename(part, to):
                    return m
                fs.delete(part, False)


def _drop(m: dict, batch: str, part: str) -> None:
    """Take a partition of a batch out of a manifest."""
    m["live"][batch].remove(part)
    if not m["live"][batch]:
        del m["live"][batch]
    m["dropped"][f"{batch}/{part}"] = time.time()


def _by_part(m: dict) -> dict[str, list[str]]:
    """The batches of each partition, oldest first."""
    out: dict[str, list[str]] = {}
    for batch in sorted(m["live"]):
        for part in m["live"][batch]:
            out.setdefault(part, []).append(batch)
    return out


def _run(sizes: Sequence[int]) -> int:
    """How many of the newest batches (``sizes``: oldest first) to join: the newest, and before
    them each that is at most ``TIER`` times those after it together."""
    total, n = sizes[-1], 1
    for size in reversed(sizes[:-1]):
        if size > TIER * total:
            break
        total, n = total + size, n + 1
    return n


class KeyedTable:
    """A parquet table at ``path`` with primary key ``key``, partitioned by ``partition``.

    ``partition`` is a column expression over the row (e.g. the event date, or a hash bucket
    of the key); it is stored as column ``_part``. ``movable=False`` promises that a key never
    changes partition (true when the partition derives from the key), which saves the key index.
    Files are sorted by ``sort`` (the key by default) within a partition, so parquet min/max
    statistics prune lookups by it; columns in ``bloom`` get a parquet bloom filter. ``ranged=False``
    deals a batch by hash within its partitions in place of sampled ranges, for stream epochs: sampling
    would run the epoch's plan twice.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        key: Sequence[str],
        partition: Column,
        *,
        movable: bool = True,
        sort: Sequence[str] = (),
        bloom: Sequence[str] = (),
        ranged: bool = True,
        retention: float = RETENTION,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.key = list(key)
        self.partition = partition
        self.movable = movable
        self.sort = [*sort, *[k for k in key if k not in sort]]
        self.options = _bloom(bloom)
        self.ranged = ranged
        self.retention = retention
        self.manifest = Manifest(spark, self.path)

    def exists(self) -> bool:
        return bool(self.manifest.versions())

    def batches(self) -> dict[str, list[str]]:
        """The batch folders of each partition folder, oldest first."""
        return _by_part(self.manifest.load())

    # ------------------------------------------------------------------ reading
    def read(
        self, *, keep_partition: bool = False, start=None, end=None, only: Sequence[str | None] | None = None
    ) -> DataFrame:
        """The table; ``keep_partition`` keeps ``_part`` so time filters can prune folders. Of a
        table partitioned by time, ``start`` and ``end`` leave out the partitions before and after
        these times from the plan: they are not listed, and waiting batches outside do not matter.
        ``only`` names the partition values to read."""
        m = self.manifest.load()
        if not m["version"]:
            raise ValueError(f"no table at {self.path}")
        parts = _by_part(m)
        if start is not None or end is not None:
            lo, hi = (None if t is None else as_datetime(t).strftime("%Y-%m-%d-%H") for t in (start, end))
            value = {p: p.removeprefix(f"{PART}=") for p in parts if "__HIVE_" not in p}
            parts = {p: parts[p] for p, v in value.items()
                     if (lo is None or v >= lo[: len(v)]) and (hi is None or v <= hi[: len(v)])}
        if only is not None:
            folders = {f"{PART}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for v in only}
            parts = {p: b for p, b in parts.items() if p in folders}
        df = self._resolved(m, parts)
        if DELETED in df.columns:
            df = df.where(~F.coalesce(F.col(DELETED), F.lit(False))).drop(DELETED)
        df = df.drop(BATCH)
        return df if keep_partition else df.drop(PART)

    def _files(self, m: dict, folders: Sequence[tuple[str, str]]) -> DataFrame:
        """The rows of (batch, partition) folders. The manifest's schema is given, so no file is
        opened to plan a read; a batch that is wanted whole is named once."""
        schema = T.StructType.fromJson(m["schema"])
        schema = T.StructType([*schema.fields, T.StructField(BATCH, T.StringType()), T.StructField(PART, T.StringType())])
        if not folders:
            return self.spark.createDataFrame([], schema)
        wanted: dict[str, list[str]] = {}
        for batch, part in folders:
            wanted.setdefault(batch, []).append(part)
        paths = []
        for batch, parts in wanted.items():
            gone = any(d.startswith(f"{batch}/") for d in m["dropped"])
            if len(parts) == len(m["live"][batch]) and not gone:
                paths.append(f"{self.path}/{batch}")
            else:
                paths += [f"{self.path}/{batch}/{part}" for part in parts]
        reader = self.spark.read.schema(schema).option("basePath", self.path)
        return reader.parquet(*paths)

    def _resolved(self, m: dict, parts: dict[str, list[str]]) -> DataFrame:
        """The last row of each key in the (partition, batches) given; tombstones are rows, too."""
        single = self._files(m, [(b[0], p) for p, b in parts.items() if len(b) == 1])
        several = {p: b for p, b in parts.items() if len(b) > 1}
        if not several:
            return single
        first = self._files(m, [(b[0], p) for p, b in several.items()])
        later = self._files(m, [(batch, p) for p, b in several.items() for batch in b[1:]])
        # by key and partition, so a filter on the partition reaches the scan
        last = Window.partitionBy(*self.key, PART).orderBy(F.col(BATCH).desc())
        newest = later.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")
        names = [*self.key, PART]
        keys = later.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)])
        same = [first[c].eqNullSafe(keys[f"_k{i}"]) for i, c in enumerate(names)]
        kept = first.join(keys, same, "left_anti")
        several_rows = kept.unionByName(newest)
        return several_rows if len(several) == len(parts) else single.unionByName(several_rows)

    # ------------------------------------------------------------------ writing
    def upsert(
        self,
        incoming: DataFrame,
        *,
        order: Sequence[str] = (),
        drop: Sequence[str] = (),
        unique: bool = False,
        name: str | None = None,
        epoch: int | None = None,
    ) -> None:
        """Insert-or-replace ``incoming`` rows by key; within the batch the last by ``order``
        wins (all columns break ties). Columns in ``drop`` (arrival helpers) are not stored.
        ``unique=True`` declares the batch keys already unique (e.g. an aggregation's output)
        and skips the collapse and its shuffle. A batch with the ``name`` of an earlier one
        takes its place; with an ``epoch`` the name is a stream's tag, and an epoch that the table
        has already is skipped."""
        m = self.manifest.load()
        if epoch is not None and epoch <= m["epochs"].get(name, -1):
            return
        rows = incoming if unique else latest_by_key(incoming, self.key, order)
        kept = [c for c in incoming.columns if c not in set(drop)]
        rows = rows.select(*kept).withColumn(PART, self.partition.cast("string"))
        label = name or f"u{uuid.uuid4().hex[:12]}"
        label = label.replace(".", "_") if epoch is None else f"{label}e{epoch}"
        earlier = [b for b in m["live"] if b.split(".")[1] == label]
        number = int(earlier[0].removeprefix(f"{BATCH}=").split(".")[0]) if earlier else None
        staged: list[str] = []
        index = None
        if self.movable:
            rows, index = self._with_tombstones(m, rows, staged)
        # numbered when it is published; until then the folder counts for nobody
        folder = f"{BATCH}={number if number is not None else m['last'] + 1:012d}.{label}.{uuid.uuid4().hex[:8]}"
        schema = self._schema(m, rows)
        self._write(rows, folder)
        parts = [n for n, _ in _children(self.spark, f"{self.path}/{folder}") if n.startswith(f"{PART}=")]

        def add(m: dict) -> None:
            m["schema"] = schema
            for old in earlier:
                for part in list(m["live"].get(old, ())):
                    _drop(m, old, part)
            if parts:
                m["live"][folder] = parts
            if index:
                m["index"][index[0]] = index[1]
            m["last"] = max(m["last"], int(folder.removeprefix(f"{BATCH}=").split(".")[0]))
            if epoch is not None:
                m["epochs"][name] = max(epoch, m["epochs"].get(name, -1))

        self.manifest.commit(add)
        for path in staged:
            _remove_dir(self.spark, path)

    def _schema(self, m: dict, rows: DataFrame) -> dict:
        """The table's schema with the batch's new columns; a column cannot change its type."""
        fields = T.StructType.fromJson(m["schema"]).fields if m["schema"] else []
        known = {f.name: f for f in fields}
        for f in rows.schema.fields:
            if f.name == PART:
                continue
            if f.name in known and known[f.name].dataType != f.dataType:
                raise ValueError(
                    f"column {f.name} is {known[f.name].dataType.simpleString()} in {self.path}, not {f.dataType.simpleString()}")
            if f.name not in known:
                known[f.name] = T.StructField(f.name, f.dataType)
        return T.StructType([T.StructField(f.name, f.dataType) for f in known.values()]).jsonValue()

    def _write(self, rows: DataFrame, folder: str) -> None:
        """Write a batch folder, range-partitioned by (partition, sort columns), or else by hash: a
        large partition value is split over several tasks (no single task holds a whole day or a hot
        bucket); AQE joins small ones. Rows are sorted within files."""
        by = [F.col(PART), *[F.col(c) for c in self.sort]]
        if self.ranged:
            rows = rows.repartitionByRange(*by)
        else:
            rows = rows.repartition(PART, F.pmod(F.xxhash64(*self.key), F.lit(64)))
        rows = rows.sortWithinPartitions(*by)
        rows.write.options(**self.options).partitionBy(PART).parquet(f"{self.path}/{folder}")

    # ------------------------------------------------------------------ key index
    def _with_tombstones(
        self, m: dict, rows: DataFrame, staged: list[str]
    ) -> tuple[DataFrame, tuple[str, dict] | None]:
        """The rows, and a deleted row in every other partition that a key may have been in; and
        the index batch of the rows' keys, which is published together with them."""
        spark = self.spark
        path = fresh_dir(spark, "staging")
        staged.append(path)
        rows.write.parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path)
        own = rows.select(*self.key, PART, F.xxhash64(*self.key).alias(HASH))
        rows = rows.withColumn(DELETED, F.lit(False))
        touched = self._buckets(own)
        if not touched:
            return rows, None
        known = self._lookup(m, own, touched)
        if known is not None:
            was = known.withColumnRenamed(PART, "_was")
            elsewhere = ~F.col("_was").eqNullSafe(F.col(PART))
            # the hashes of moved keys first, by two narrow columns: most often few or none, and then
            # the keys themselves are not shuffled
            moved = was.join(own.select(HASH, PART), HASH).where(elsewhere).select(HASH, "_was").distinct()
            staged.append(fresh_dir(spark, "staging"))
            moved.write.parquet(staged[-1])
            moved = spark.read.schema(moved.schema).parquet(staged[-1])
            stones = moved.join(own, HASH).where(elsewhere).select(*self.key, F.col("_was").alias(PART), F.lit(True).alias(DELETED))
            rows = rows.unionByName(stones, allowMissingColumns=True)
        return rows, self._write_index(own.select(HASH, PART), sum(touched.values()))

    @staticmethod
    def _buckets(own: DataFrame) -> dict[int, int]:
        """How many keys fall in which bucket, of the most buckets there can be (MOST_BUCKETS rows)."""
        bucket = F.pmod(F.col(HASH), F.lit(MOST_BUCKETS)).cast("int")
        return {r[0]: r[1] for r in own.groupBy(bucket).count().collect()}

    def known(self, own: DataFrame) -> DataFrame | None:
        """(hash, partition) where keys with the hashes of ``own`` may have been, pairs may repeat; None
        if nowhere."""
        return self._lookup(self.manifest.load(), own, self._buckets(own))

    def _lookup(self, m: dict, own: DataFrame, touched: dict[int, int]) -> DataFrame | None:
        """(hash, partition) of the index buckets that the batch's keys fall in; a pair may repeat."""
        paths = []
        for folder, about in m["index"].items():
            mine = {b % about["buckets"] for b in touched}
            names = {n for n, _ in _children(self.spark, f"{self.path}/{folder}")}
            paths += [f"{self.path}/{folder}/_bucket={b}" for b in sorted(mine) if f"_bucket={b}" in names]
        if not paths:
            return None
        known = self.spark.read.schema(f"{HASH} long, {PART} string").parquet(*paths)
        if sum(touched.values()) <= 10:  # as literals they reach the files' bloom filters
            known = known.where(F.col(HASH).isin([r[0] for r in own.select(HASH).collect()]))
        return known

    def _write_index(self, pairs: DataFrame, keys: int) -> tuple[str, dict]:
        buckets = 1
        while buckets < MOST_BUCKETS and buckets * KEYS_PER_BUCKET < keys:
            buckets *= 2
        folder = f"{KEYS}/{uuid.uuid4().hex[:12]}"
        pairs = pairs.withColumn("_bucket", F.pmod(F.col(HASH), F.lit(buckets)).cast("int"))
        # a bucket is one file: tasks of whole buckets, which hold all rows of a pair
        if buckets > 1:
            pairs = pairs.repartition(min(buckets, 1000), "_bucket").dropDuplicates(["_bucket", HASH, PART])
        else:
            pairs = pairs.distinct().coalesce(1)
        writer = pairs.sortWithinPartitions("_bucket", HASH).write.options(**_bloom([HASH]))
        writer.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return folder, {"buckets": buckets, "keys": keys}

    # ------------------------------------------------------------------ compaction
    def compact(self) -> None:
        """Join all batches of every partition that has several, and all index batches."""
        m = self.manifest.load()
        self._join(m, {p: len(b) for p, b in _by_part(m).items() if len(b) > 1})
        self._join_index(m, len(m["index"]))
        self.clean()

    def tidy(self) -> None:
        """Join batches of similar size in the partitions that have more than ``MOST_BATCHES``."""
        m = self.manifest.load()
        runs = {}
        for part, batches in _by_part(m).items():
            if len(batches) > MOST_BATCHES:
                n = _run([_size(self.spark, f"{self.path}/{b}/{part}") for b in batches])
                if n > 1:
                    runs[part] = n
        self._join(m, runs)
        if len(m["index"]) > MOST_BATCHES:
            self._join_index(m, _run(sorted((i["keys"] for i in m["index"].values()), reverse=True)))
        self.clean()

    def _join(self, m: dict, runs: dict[str, int]) -> None:
        """Write the resolved rows of the newest ``runs[partition]`` batches as one batch."""
        if not runs:
            return
        every = _by_part(m)
        own = {p: every[p][-n:] for p, n in runs.items()}
        rows = self._resolved(m, own).drop(BATCH)
        if DELETED in rows.columns:
            # a tombstone is kept while an older batch of its partition may hold the stale row
            names = [p.removeprefix(f"{PART}=") for p, b in own.items() if len(b) == len(every[p])]
            whole = F.col(PART).isin(names) | (F.col(PART).isNull() if "__HIVE_DEFAULT_PARTITION__" in names else F.lit(False))
            rows = rows.where(~(F.coalesce(F.col(DELETED), F.lit(False)) & F.coalesce(whole, F.lit(False))))
        folder = f"{BATCH}={m['last']:012d}.z{uuid.uuid4().hex[:12]}.{uuid.uuid4().hex[:8]}"
        self._write(rows, folder)
        written = {n for n, _ in _children(self.spark, f"{self.path}/{folder}") if n.startswith(f"{PART}=")}

        def swap(now: dict) -> None:
            live = _by_part(now)
            for part, batches in own.items():
                if not set(batches) <= set(live.get(part, ())):
                    if part in written:  # replaced meanwhile: the old batches stay
                        now["dropped"][f"{folder}/{part}"] = time.time()
                    continue
                for batch in batches:
                    _drop(now, batch, part)
                if part in written:
                    now["live"].setdefault(folder, []).append(part)

        self.manifest.commit(swap)

    def _join_index(self, m: dict, n: int) -> None:
        """Join the ``n`` smallest index batches."""
        own = sorted(m["index"], key=lambda f: m["index"][f]["keys"])[:n]
        if len(own) < 2:
            return
        pairs = self.spark.read.schema(f"{HASH} long, {PART} string").parquet(
            *[f"{self.path}/{f}/{b}" for f in own for b, _ in _children(self.spark, f"{self.path}/{f}") if b.startswith("_bucket=")])
        folder, about = self._write_index(pairs, sum(m["index"][f]["keys"] for f in own))

        def swap(now: dict) -> None:
            for f in own:
                now["index"].pop(f, None)
                now["dropped"][f] = time.time()
            now["index"][folder] = about

        self.manifest.commit(swap)

    def clean(self) -> None:
        """Remove what no reader can need any more: folders dropped, or left by failed writes, and
        manifest versions, longer than ``retention`` ago."""
        before = time.time() - self.retention
        m = self.manifest.load()
        gone = [d for d, t in m["dropped"].items() if t <= before]
        for d in gone:
            _remove_dir(self.spark, f"{self.path}/{d}")
        known = set(m["live"]) | {d.split("/")[0] for d in m["dropped"] if d not in gone}
        for name, t in _children(self.spark, self.path):
            if name.startswith(f"{BATCH}=") and name not in known and t <= before:
                _remove_dir(self.spark, f"{self.path}/{name}")
        for name, t in _children(self.spark, f"{self.path}/{KEYS}"):
            if f"{KEYS}/{name}" not in {**m["index"], **m["dropped"]} and t <= before:
                _remove_dir(self.spark, f"{self.path}/{KEYS}/{name}")
        newest = self.manifest.versions()[-1:]
        for name, t in _children(self.spark, self.manifest.path):
            if name not in newest and t <= before:
                _remove_dir(self.spark, f"{self.manifest.path}/{name}")
        if gone:
            self.manifest.commit(lambda now: [now["dropped"].pop(d, None) for d in gone])


GRAIN_FORMATS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def exposure_table(
    spark: SparkSession, path: str, *, movable: bool = True, grain: str = "day"
) -> KeyedTable:
    """K2 table: exposures keyed by (impression, user, article), partitioned by event time
    at ``grain`` (day for a log of recent traffic; month for a long, sparse history)."""
    return KeyedTable(
        spark, path, ("impression_id", "user_id", "news_id"),
        F.date_format(F.col("timestamp"), GRAIN_FORMATS[grain]), movable=movable,
        sort=("news_id",), bloom=("user_id",),
    )


def news_table(spark: SparkSession, path: str, *, buckets: int = 64) -> KeyedTable:
    """K1 table: articles keyed by ``news_id``, hash-bucketed (the bucket derives from the key, so
    keys never move)."""
    return KeyedTable(
        spark, path, ("news_id",), F.pmod(F.xxhash64("news_id"), F.lit(buckets)), movable=False
    )


def upsert_news(
    spark: SparkSession, news: DataFrame, path: str, *, order: Sequence[str] = (), drop: Sequence[str] = ()
) -> DataFrame:
    """K1: insert-or-replace articles by ``news_id``; returns the table after the upsert. Without
    an ``order`` the last of the rows with one ``news_id`` wins, in the order they are read (of
    files: path, block, row in the block)."""
    if not order:
        news, order = in_file_order(news)
        if not order:
            news, order = news.withColumn("_row", F.monotonically_increasing_id()), ["_row"]
        drop = [*drop, *order]
    t = news_table(spark, path)
    t.upsert(news, order=order, drop=drop)
    return t.read()


def upsert_exposures(
    spark: SparkSession, exposures: DataFrame, path: str, *, order: Sequence[str] = (),
    drop: Sequence[str] = (), movable: bool = True, grain: str = "day",
) -> DataFrame:
    """K2: insert-or-replace exposures by primary key; returns the table after the upsert."""
    t = exposure_table(spark, path, movable=movable, grain=grain)
    t.upsert(exposures, order=order, drop=drop)
    return t.read()


def exposure_log(spark: SparkSession, path: str, *, start=None, end=None) -> DataFrame:
    """The stored exposure table for reports: keeps the time-partition column, so the range
    filters of the reports prune partitions (see ``metrics.between_inclusive``). With ``start`` and
    ``end`` only the partitions of that range are planned at all."""
    return exposure_table(spark, path).read(keep_partition=True, start=start, end=end)


def upsert_batch_fn(
    table, *, stream: str, order: Sequence[str] = (), drop: Sequence[str] = (),
    unique: bool = False, tidy_every: int = 10,
):
    """A ``foreachBatch`` function that upserts every micro-batch into ``table`` (or an exposure store).

    The batch carries a tag of ``stream`` (its checkpoint folder names it for good) and the epoch, so
    a replay of an epoch that is in the table is skipped. Every ``tidy_every`` epochs partitions
    with many batches are tidied; the others are left as they are.
    """
    tag = f"s{hashlib.blake2b(stream.encode(), digest_size=6).hexdigest()}"

    def run(batch: DataFrame, batch_id: int) -> None:
        given = {"unique": True} if unique else {}
        table.upsert(batch, order=order, drop=drop, name=tag, epoch=batch_id, **given)
        if batch_id and batch_id % tidy_every == 0:
            table.tidy()

    return run
