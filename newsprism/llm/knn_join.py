"""Exact top-k inner products by a Voronoi kNN join (operator 13).

A component of a vector becomes the long ``floor(1024 c)``; the score of a pair is the inner
product of these. With M the largest norm, a candidate p is lifted to ``(p, sqrt(M^2 - |p|^2))``
and a query q to ``(q, 0)``: then ``|q - p|^2 = |q|^2 + M^2 - 2 q.p``, and the highest scores are
the nearest neighbours of a metric space.

1. Pivots, a sample of at most ``PIVOTS`` rows (the square root of the number of rows), cut the
   candidates into Voronoi cells. Of each cell a summary is kept: the number of rows, and the
   smallest k + 1 distances to the pivot (one more for the query's own row).
2. A query's distances to the pivots and the summaries bound the distance of its k-th neighbour
   from above. Queries are grouped by their pivots' cells, cells joined to neighbouring ones;
   of each group are kept the largest such bound and, for every pivot, the range of its distances
   and the least distance to the cell's border.
3. A candidate at distance d from its pivot goes to a group only if the group's range, widened by
   its bound, holds d and the border is within the bound. Groups of many queries, and the
   candidates sent to a group, are cut by hash into parts that meet in a task of bounded size each,
   so a hot cell is spread. Each task solves its part exactly in integers; a last ranking joins the
   parts' lists (k + 1 rows a query and part).

How much is pruned depends on the vectors: clustered ones are sent to few groups, isotropic
ones of many dimensions to nearly all, which is what an exact search must then read.
Only pivots, summaries and group bounds reach the driver, each bounded by the pivots.

Results for odd rows: a vector that is null or holds null or non-finite components takes no part,
nor does a null vec_id, nor a vector whose integer norm is 2^31 or more (scores of the others fit
a long). A shorter vector counts as padded with zeros, an empty one as the zero vector. Repeated rows
are candidates each, a query excludes one row equal to it (its own), and a repeated query row gives
its result rows once for every row. With fewer than ten other rows all are returned; an empty
table, or one without queries, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

K = 10
EVERY = 100  # queries: vec_id divisible by it
PIVOTS = 1024
LEAST_GROUPS = 4  # of queries, if there are as many cells
PART_BYTES = 16 << 20  # of queries, and of candidates, in one task
TILE = 512  # queries scored at once
OUT = "query_id long, rank int, vec_id long, score long"


def integer_vectors(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """(rows, int32 bytes of floor(1024 c)) of the vectors that take part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    known = pc.is_valid(column).to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    value = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(size)])
    fits = np.abs(value) < 2.0**21  # false for NaN; with it floor(1024 c) fits in 32 bits
    x = np.floor(1024.0 * np.where(fits, value, 0.0))
    lost = np.concatenate([[0], np.cumsum(~fits)])
    square = np.concatenate([[0.0], np.cumsum(x * x)])
    rows = np.flatnonzero(known & (lost[at[1:]] == lost[at[:-1]]))
    x = x.astype("<i4")
    parts = [x[at[r] : at[r + 1]] for r in rows.tolist()]
    if square[-1] >= 2.0**60:  # some norm may be too large
        keep = [sum(int(v) * int(v) for v in p) < 2**62 for p in parts]
        rows, parts = rows[np.array(keep, bool)], [p for p, k in zip(parts, keep) if k]
    return rows, [p.tobytes() for p in parts]


def matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """int32 rows as a matrix of doubles (exact), shorter ones padded with zeros."""
    if all(len(r) == 4 * dim for r in raw):
        return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), dim).astype(float)
    return np.frombuffer(b"".join(r.ljust(4 * dim, b"\0") for r in raw), "<i4").reshape(len(raw), dim).astype(float)


class Pivots:
    """Lifted pivots: distances of lifted vectors to them, with a margin for rounding."""

    def __init__(self, raw: list[bytes], dim: int, norm: float):
        self.dim, self.norm = dim, norm
        self.at = self.lift(matrix(raw, dim))
        self.square = (self.at * self.at).sum(1)
        self.slack = 1e-6 * (norm + 1)
        apart = self.distances(self.at)
        self.apart = np.maximum(apart, 0)

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        up = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0.0))
        return np.hstack([x, up[:, None]])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        square = (lifted * lifted).sum(1)[:, None] + self.square[None, :] - 2 * lifted @ self.at.T
        return np.sqrt(np.maximum(square, 0.0))


class Groups:
    """Groups of query cells and what a candidate of each cell must satisfy to be sent to one."""

    def __init__(self, cells: np.ndarray, sizes: np.ndarray, bound, low, high, border, pivots: Pivots, counts: np.ndarray):
        number = min(len(cells), max(LEAST_GROUPS, int(np.ceil(np.sqrt(len(cells))))))
        # farthest-first centres among the cells, the others join the nearest centre
        near = pivots.apart[cells][:, cells]
        centres = [int(np.argmax(sizes))]
        while len(centres) < number:
            centres.append(int(np.argmax(near[:, centres].min(1))))
        of = near[:, centres].argmin(1)
        _, of = np.unique(of, return_inverse=True)
        self.cells, self.of = cells, of
        self.n = int(of.max()) + 1
        self.queries = np.bincount(of, sizes).astype(int)
        merge = lambda f, v: np.stack([f(v[of == g], axis=0) for g in range(self.n)])
        self.bound = merge(np.max, bound[:, None])[:, 0] + pivots.slack
        self.low = merge(np.min, low) - self.bound[:, None]
        self.high = merge(np.max, high) + self.bound[:, None]
        self.open = merge(np.min, border) <= self.bound[:, None]
        rows = max(1, PART_BYTES // (8 * max(1, pivots.dim)))
        self.query_parts = np.maximum(1, -(-self.queries // rows))
        most = np.where(self.open, counts[None, :], 0).sum(1)  # candidates of a group at most
        self.data_parts = np.maximum(1, -(-most // rows)).astype(int)


def _vectors(spark: SparkSession, table: DataFrame) -> DataFrame:
    """(id, square, x) of all rows that take part."""

    def run(batches):
        for batch in batches:
            rows, raw = integer_vectors(batch.column("embedding"))
            square = [float(np.square(np.frombuffer(r, "<i4").astype(float)).sum()) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), pa.array(square, pa.float64()), pa.array(raw, pa.binary())],
                names=["id", "square", "x"])

    table = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    return stored(spark, table.mapInArrow(run, "id long, square double, x binary"), "vectors")


def _best(ids: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` highest scores, equal ones by smaller id."""
    if len(ids) > keep:
        least = np.partition(score, len(score) - keep)[len(score) - keep]
        place = np.flatnonzero(score >= least)
    else:
        place = np.arange(len(ids))
    return place[np.lexsort((ids[place], -score[place]))][:keep]


def top_inner_products(spark: SparkSession, table: DataFrame, *, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows of ``table(vec_id, embedding)`` for
    each row whose vec_id is divisible by ``every``."""
    rows = _vectors(spark, table)
    n, norm, size = rows.agg(F.count("*"), F.max("square"), F.max(F.length("x"))).first()
    # equal query rows are searched once
    queries = rows.where(F.col("id") % every == 0).groupBy("id", "x").agg(F.count("*").alias("copies"))
    queries = stored(spark, queries.withColumn("q", F.monotonically_increasing_id()), "queries")
    if not n or queries.isEmpty():
        return spark.createDataFrame([], OUT)
    dim = size // 4
    count = min(PIVOTS, int(np.ceil(np.sqrt(n))))
    chosen = rows.select("x").orderBy(F.xxhash64("id", "x"), "x").limit(count).collect()
    pivots = Pivots(sorted({bytes(r["x"]) for r in chosen}), dim, float(np.sqrt(norm)))
    sent = spark.sparkContext.broadcast(pivots)
    p = len(pivots.at)

    def assign(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                far = sent.value.distances(sent.value.lift(matrix(part.column("x").to_pylist(), dim)))
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell]), part.column("id"), part.column("x")],
                    names=["cell", "d", "id", "x"])

    data = stored(spark, rows.select("id", "x").mapInArrow(assign, "cell int, d double, id long, x binary"), "cells")
    # summaries of the candidates' cells
    counts = np.zeros(p, np.int64)
    for r in data.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("d"))
    near = data.select("cell", "d").withColumn("nth", nth).where(F.col("nth") <= k + 1).collect()
    near_cell, near_d = np.array([r["cell"] for r in near]), np.array([r["d"] for r in near])
    own_near = spark.sparkContext.broadcast((near_cell, near_d))

    def summarise(batches):
        """Of each cell of queries: their number, the largest bound, and by pivot the least and
        largest distance and the least distance to the border."""
        v = sent.value
        near_cell, near_d = own_near.value
        held: dict[int, list] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                far = v.distances(v.lift(matrix(batch.column("x")[lo : lo + 1024].to_pylist(), dim), query=True))
                cell = far.argmin(1)
                reach = far[:, near_cell] + near_d
                most = min(k, reach.shape[1] - 1)  # the (k + 1)-th: one of them may be the query's own row
                bound = np.partition(reach, most, axis=1)[:, most] if reach.shape[1] > k else np.full(len(far), np.inf)
                apart = v.apart[cell]
                with np.errstate(divide="ignore", invalid="ignore"):
                    border = (far**2 - far.min(1)[:, None] ** 2) / (2 * apart)
                border = np.where(apart > 0, border, 0.0) - v.slack
                for c in np.unique(cell).tolist():
                    own = cell == c
                    new = [int(own.sum()), float(bound[own].max()), far[own].min(0), far[own].max(0), border[own].min(0)]
                    old = held.get(c)
                    held[c] = new if old is None else [
                        old[0] + new[0], max(old[1], new[1]), np.minimum(old[2], new[2]), np.maximum(old[3], new[3]),
                        np.minimum(old[4], new[4])]
        for c, (m, bound, low, high, border) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.int32()), pa.array([m], pa.int64()), pa.array([bound]),
                 *[pa.array([b.astype("<f8").tobytes()], pa.binary()) for b in (low, high, border)]],
                names=["cell", "n", "bound", "low", "high", "border"])

    summary = "cell int, n long, bound double, low binary, high binary, border binary"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for r in batch.to_pylist():
                arrays = [np.frombuffer(r[c], "<f8") for c in ("low", "high", "border")]
                if total is None:
                    total = [r["cell"], r["n"], r["bound"], *arrays]
                else:
                    total = [total[0], total[1] + r["n"], max(total[2], r["bound"]), np.minimum(total[3], arrays[0]),
                             np.maximum(total[4], arrays[1]), np.minimum(total[5], arrays[2])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([total[0]], pa.int32()), pa.array([total[1]], pa.int64()), pa.array([total[2]], pa.float64()),
             *[pa.array([a.astype("<f8").tobytes()], pa.binary()) for a in total[3:]]],
            names=["cell", "n", "bound", "low", "high", "border"])

    cells = queries.select("x").mapInArrow(summarise, summary).groupBy("cell").applyInArrow(merge, summary)
    cells = sorted(cells.collect(), key=lambda r: r["cell"])  # PIVOTS rows at most
    stack = lambda c: np.stack([np.frombuffer(r[c], "<f8") for r in cells])
    groups = Groups(np.array([r["cell"] for r in cells]), np.array([r["n"] for r in cells]),
                    np.array([r["bound"] for r in cells]), stack("low"), stack("high"), stack("border"), pivots, counts)
    table_of = np.full(p, -1)
    table_of[groups.cells] = groups.of
    plan = spark.sparkContext.broadcast((groups, table_of))
    task = "g int, qp int, dp int, q long, id long, x binary"

    def part_of(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int32)

    def place(batch, row, g, qp, dp, q):
        return pa.RecordBatch.from_arrays(
            [pa.array(g.astype(np.int32)), pa.array(qp.astype(np.int32)), pa.array(dp.astype(np.int32)),
             pa.array(q, pa.int64()), batch.column("id").take(pa.array(row)), batch.column("x").take(pa.array(row))],
            names=["g", "qp", "dp", "q", "id", "x"])

    def send_queries(batches):
        groups, table_of = plan.value
        v = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                far = v.distances(v.lift(matrix(part.column("x").to_pylist(), dim), query=True))
                g = table_of[far.argmin(1)]
                q = part.column("q").to_numpy()
                qp = part_of(q, groups.query_parts[g])
                for d in range(int(groups.data_parts[g].max())):
                    row = np.flatnonzero(groups.data_parts[g] > d)
                    yield place(part, row, g[row], qp[row], np.full(len(row), d), q[row])

    def send_data(batches):
        groups, _ = plan.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                cell, d = part.column("cell").to_numpy(), part.column("d").to_numpy()
                ids = part.column("id").to_numpy()
                for g in range(groups.n):
                    row = np.flatnonzero(groups.open[g, cell] & (d >= groups.low[g, cell]) & (d <= groups.high[g, cell]))
                    if len(row):
                        dp = part_of(ids[row], np.full(len(row), groups.data_parts[g]))
                        for qp in range(int(groups.query_parts[g])):
                            yield place(part, row, np.full(len(row), g), np.full(len(row), qp), dp, np.full(len(row), -1))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        q = table.column("q").to_numpy()
        x = matrix(table.column("x").to_pylist(), dim)
        ids = table.column("id").to_numpy()
        ask, own = np.flatnonzero(q >= 0), np.flatnonzero(q < 0)
        if not len(ask) or not len(own):
            return
        cand, cand_ids = x[own], ids[own]
        most = np.sqrt((x[ask] ** 2).sum(1).max() * (cand**2).sum(1).max())
        if most >= 2**52:  # doubles would round: in longs, which hold every score
            x, cand = x.astype(np.int64), cand.astype(np.int64)
        for a in range(0, len(ask), TILE):
            found = []
            for b in range(0, len(own), 16 * TILE):
                score = (x[ask[a : a + TILE]] @ cand[b : b + 16 * TILE].T).astype(np.int64)
                for i, row in enumerate(score):
                    best = _best(cand_ids[b : b + len(row)], row, k + 1)
                    found.append((np.full(len(best), i), cand_ids[b + best], row[best], b + best))
            i, c, s, at = (np.concatenate(f) for f in zip(*found))
            order = np.lexsort((c, -s, i))
            i, c, s, at = i[order], c[order], s[order], at[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) <= k
            i, c, s, at = i[keep], c[keep], s[keep], at[keep]
            same = (c == ids[ask[a + i]]) & (cand[at] == x[ask[a + i]]).all(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q[ask[a + i]]), pa.array(c), pa.array(s), pa.array(same)], names=["q", "vec_id", "score", "same"])

    sent_rows = queries.select("q", "id", "x").mapInArrow(send_queries, task).unionByName(data.mapInArrow(send_data, task))
    found = sent_rows.groupBy("g", "qp", "dp").applyInArrow(solve, "q long, vec_id long, score long, same boolean")
    order = [F.col("score").desc(), F.col("vec_id")]
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("nth") <= k + 1)
    # of the rows equal to the query's one is its own
    whole = Window.partitionBy("q").orderBy(*order)
    best = best.withColumn("own", F.col("same") & (F.sum(F.col("same").cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, 0)) == 1))
    best = best.where("not own").withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    named = best.join(queries.select("q", F.col("id").alias("query_id"), "copies"), "q")
    named = named.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return named.select("query_id", "rank", "vec_id", "score")
