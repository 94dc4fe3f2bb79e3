"""Embedding near-duplicates by a subspace pigeonhole join (operator 10).

Unit vectors with cosine >= t differ by a squared distance of at most ``2 - 2 t``. After a fixed
rotation the coordinates are cut into ``BLOCKS`` subspaces; in at least one of them the pair's
squared distance is within its proportional share, ``(2 - 2 t) / BLOCKS``. Each subspace is joined
by range on its own: its first coordinates form a grid of cells twice as wide as the range, and a
vector's coordinates in the block (not the vector) are sent to its own cell and to the neighbours
within reach. Inside a cell the vectors that have a partner within the share there are candidates;
they alone meet again, in the same cells, as whole vectors. Every candidate pair is verified
exactly, by its cosine in double precision on the unrotated vectors.

A pair is looked at in the home cell of its smaller id only, and counted in the first subspace
that admits it, so links are counted once and no pairs leave a cell: a cell puts out link counts
by vector and a spanning set of links. Cells of more than ``CELL_ROWS`` home rows are split into
parts that meet pairwise, each meeting a task of its own. The number of grid coordinates follows
the size of the largest label group. Equal vectors of a label are joined once, as one class.

Results for odd rows: a null label, and a vector that is null, zero, or holds null or non-finite
components, links with nothing (also vectors of different lengths); a null vec_id links with
nothing and has a null component; repeated rows give repeated result rows and count as one vector;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .graph import components, local_roots

BLOCKS = 8
CELL_ROWS = 8000
VECTOR_ROWS = 2000  # whole vectors of a side in one task
TILE = 512  # rows compared at once

ROW = "grp long, block int, cell long, home boolean, id long, share double, at binary"


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation (orthogonal matrix) of ``dim`` coordinates."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def cuts(dim: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    # scaled by the largest component first, so that no square over- or underflows
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, label, vec binary) of all rows; vec is null where the vector cannot link."""
    values = F.transform("embedding", lambda v: v.cast("double"))
    sound = (
        F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(values, lambda v: v != 0)
    )

    def pack(batches):
        for batch in batches:
            vec = [None if v is None else np.array(v, "<f8").tobytes() for v in batch.column("e").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(vec, pa.binary())],
                names=["vec_id", "label", "vec"])

    keep = table.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.when(F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), values).alias("e"))
    return keep.mapInArrow(pack, "vec_id long, label string, vec binary")


def cells(x: np.ndarray, block: tuple[int, int], radius: float, dims: int):
    """(row, cell, home): the cells each row is sent to, by its first coordinates of a block."""
    width = 2 * radius
    g = min(dims, block[1] - block[0])
    scaled = x[:, block[0] : block[0] + g] / width
    base = np.floor(scaled).astype(np.int64)
    side = np.where(scaled - base < 0.5, -1, 1)
    row, cell, home = [], [], []
    for m in range(1 << g):
        at = base.copy()
        for d in range(g):
            if m >> d & 1:
                at[:, d] += side[:, d]
        key = np.zeros(len(x), np.int64)
        for d in range(g):  # coordinates of unit vectors: less than 2^12 cells a side
            key = key * 4096 + (at[:, d] + 2048)
        row.append(np.arange(len(x)))
        cell.append(key)
        home.append(np.full(len(x), m == 0))
    return np.concatenate(row), np.concatenate(cell), np.concatenate(home)


def shares(dim: int, t: float) -> float:
    """The squared block distance that a pair of cosine ``t`` or more stays within in some block."""
    return (2 - 2 * t) / len(cuts(dim)) + 1e-9


def _near(at: np.ndarray, ids: np.ndarray, homes: np.ndarray, others: np.ndarray, share: float) -> np.ndarray:
    """Which rows have a partner within the share (and rounding) of a block's coordinates ``at``."""
    out = np.zeros(len(at), bool)
    for a in range(0, len(homes), 2 * TILE):
        h = homes[a : a + 2 * TILE]
        for b in range(0, len(others), 2 * TILE):
            o = others[b : b + 2 * TILE]
            i, j = np.nonzero(_squared(at[h], at[o]) <= share + 1e-9)
            ok = ids[h[i]] < ids[o[j]]
            out[h[i[ok]]] = out[o[j[ok]]] = True
    return out


def _tile_links(vec: np.ndarray, ids: np.ndarray, copies: np.ndarray, homes: np.ndarray, others: np.ndarray,
                block: int, t: float):
    """Links between home rows and others (places into vec): link counts by place, links (u, v)."""
    dim = vec.shape[1]
    parts = cuts(dim)
    share = shares(dim, t)
    turned = vec @ rotation(dim)
    count = np.zeros(len(vec), np.int64)
    us, vs = [], []
    lo, hi = parts[block]
    for a in range(0, len(homes), TILE):
        h = homes[a : a + TILE]
        for b in range(0, len(others), TILE):
            o = others[b : b + TILE]
            near = _squared(turned[h, lo:hi], turned[o, lo:hi]) <= share + 1e-9
            near &= ids[h][:, None] < ids[o][None, :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            u, v = h[i], o[j]
            ok = np.einsum("ij,ij->i", vec[u], vec[v]) >= t
            u, v = u[ok], v[ok]
            # counted in the first subspace that admits the pair, by one expression for all subspaces
            d = np.square(turned[u] - turned[v])
            admits = np.stack([d[:, x:y].sum(1) <= share for x, y in parts], 1)
            own = admits.argmax(1) == block
            own &= admits[:, block]
            u, v = u[own], v[own]
            np.add.at(count, u, copies[v])
            np.add.at(count, v, copies[u])
            us.append(u)
            vs.append(v)
    empty = np.zeros(0, np.int64)
    return count, np.concatenate(us) if us else empty, np.concatenate(vs) if vs else empty


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T


def near_duplicates(spark: SparkSession, table: DataFrame, *, t: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``table(vec_id, embedding, label)``."""
    rows = stored(spark, vectors(table), "vectors")
    sound = rows.where("vec is not null").distinct()
    classes = sound.groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = stored(spark, classes.withColumn("grp", F.xxhash64("label", F.length("vec"))), "classes")
    most = classes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    # a grid coordinate cuts a group to less than half: one more each time the largest doubles
    dims = 1 + max(0, int(np.ceil(np.log2(max(1, most / CELL_ROWS)))))

    def send(batches):
        for batch in batches:
            grp, ids = batch.column("grp").to_numpy(), batch.column("id").to_numpy()
            raw = batch.column("vec").to_pylist()
            for size in {len(v) for v in raw}:
                own = np.array([i for i, v in enumerate(raw) if len(v) == size])
                dim = size // 8
                turned = _unit([raw[i] for i in own]) @ rotation(dim)
                radius = float(np.sqrt(shares(dim, t)))
                for b, part in enumerate(cuts(dim)):
                    row, cell, home = cells(turned, part, radius, dims)
                    at = np.ascontiguousarray(turned[:, part[0] : part[1]])
                    width = at.shape[1] * 8
                    flat = at.tobytes()
                    coords = [flat[k * width : (k + 1) * width] for k in range(len(own))]
                    for lo in range(0, len(row), 20_000):
                        s = row[lo : lo + 20_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(grp[own[s]]), pa.array(np.full(len(s), b, np.int32)), pa.array(cell[lo : lo + 20_000]),
                             pa.array(home[lo : lo + 20_000]), pa.array(ids[own[s]]), pa.array(np.full(len(s), radius**2)),
                             pa.array([coords[k] for k in s.tolist()], pa.binary())],
                            names=["grp", "block", "cell", "home", "id", "share", "at"])

    key = ["grp", "block", "cell"]
    sent = stored(spark, classes.select("grp", "id", "vec").mapInArrow(send, ROW), "sent")

    def meeting(rows, most, what):
        """Rows dealt to the meetings of their cells' parts: a home row to every meeting of its home
        part, any row to every meeting of its part."""
        sizes = rows.groupBy(*key).agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("n"))
        sizes = stored(spark, sizes.where("homes > 0 and n > 1").select(
            *key, F.ceil(F.col("homes") / most).cast("int").alias("hp"), F.ceil(F.col("n") / most).cast("int").alias("np")), "cells")
        salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        return rows.join(sizes, key).withColumn("as", F.explode(F.concat(
            F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("np") - 1), lambda q: F.struct(
                salt("hp").alias("h"), q.alias("o"), F.lit(True).alias("first")))).otherwise(F.array()),
            F.transform(F.sequence(F.lit(0), F.col("hp") - 1), lambda h: F.struct(
                h.alias("h"), salt("np").alias("o"), F.lit(False).alias("first"))),
        ))).select(*key, "as.h", "as.o", "as.first", *what)

    # many small cells share a task
    tasks = max(1, -(-sent.count() // (4 * CELL_ROWS)))
    spread = F.pmod(F.xxhash64(*key, "h", "o"), F.lit(tasks)).cast("int")
    first_round = meeting(sent, CELL_ROWS, ["home", "id", "share", "at"]).withColumn("task", spread)

    def near(_, table):
        names = ("grp", "block", "cell", "h", "o", "first", "home", "id", "share")
        grp, block, cell, h, o, first, home, ids, share = (
            np.asarray(table.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for c in names)
        raw = table.column("at").to_pylist()
        order = np.lexsort((ids, o, h, cell, block, grp))
        cut = np.flatnonzero(np.any([np.diff(x[order]) != 0 for x in (grp, block, cell, h, o)], axis=0)) + 1
        kept = []
        for g in np.split(order, cut):
            if not first[g].any():
                continue
            _, place, of = np.unique(ids[g], return_index=True, return_inverse=True)
            at = np.frombuffer(b"".join(raw[k] for k in g[place].tolist()), np.float64).reshape(len(place), -1)
            homes, others = np.unique(of[first[g]]), np.unique(of[~first[g]])
            hit = _near(at, ids[g][place], homes, others, float(share[g[0]]))
            kept.append(g[place[hit]])
        g = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        return pa.table({"grp": grp[g], "block": block[g], "cell": cell[g], "home": home[g], "id": ids[g]})

    flagged = first_round.groupBy("task").applyInArrow(near, "grp long, block int, cell long, home boolean, id long")
    flagged = stored(spark, flagged.distinct(), "flagged")
    vectors_of = flagged.join(classes.select("id", "grp", "copies", "vec"), ["grp", "id"])
    meet = meeting(vectors_of, VECTOR_ROWS, ["id", "copies", "vec"])

    def compare(key, table):
        vec = _unit(table.column("vec").to_pylist())
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        first = table.column("first").to_numpy(zero_copy_only=False)
        _, place, of = np.unique(ids, return_index=True, return_inverse=True)
        homes, others = np.unique(of[first]), np.unique(of[~first])
        ids, copies = ids[place], copies[place]
        count, u, v = _tile_links(vec[place], ids, copies, homes, others, key[1].as_py(), t)
        hit = np.flatnonzero(count)
        root = local_roots(u, v, len(ids)) if len(u) else np.arange(len(ids))
        return pa.table({"id": ids[hit], "n": count[hit], "root": ids[root[hit]]})

    found = stored(spark, meet.groupBy(*key, "h", "o").applyInArrow(compare, "id long, n long, root long"), "found")
    counts = stored(spark, found.groupBy("id").agg(F.sum("n").alias("n")), "counts")
    comp = stored(spark, components(spark, found.select(F.col("id").alias("a"), F.col("root").alias("b"))), "components")
    named = classes.select("label", "vec", "id", "copies").join(counts, "id", "left").join(
        comp, F.col("id") == comp.node, "left")
    named = stored(spark, named.select(
        F.xxhash64("label", "vec").alias("h"), "label", "vec", F.coalesce("component_id", "id").alias("component_id"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    out = rows.withColumn("h", F.xxhash64("label", "vec")).join(named, ["h", "label", "vec"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
