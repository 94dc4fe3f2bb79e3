"""Quality classifier: naive Bayes support vectors (operator 2).

Features are indicators of byte n-grams (every run of 3 and of 5 bytes of the text, and every pair
of adjacent words of which one repeats the other), hashed to ``2^BITS`` places. Each indicator is
scaled by its log-count ratio between the classes; a linear model with hinge loss is fitted on the
scaled indicators by dual coordinate descent; a logistic curve fitted on rows the linear
model did not see turns its margins into probabilities.

The model is fitted on a bounded sample of the labelled rows, ``sample_rows`` of each class at
most (the rows with the smallest hash of doc_id; rows of the held-out third never), in one task;
every document's whole text is scored, in parallel, with the broadcast weights (``2^BITS`` floats,
whatever the data).

Results for odd rows: null and empty texts are scored by the intercept; a null doc_id is scored,
held_out is false; repeated rows give repeated results; without usable labels of both classes
every score is the share of label 1 (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, map_batches, text_bytes, text_chunks
from .words import mix, word_spans, range_hashes

BITS = 18
SAMPLE_ROWS = 3000
ROUNDS = 12
PENALTY = 1.0


def features(data: np.ndarray, offsets: np.ndarray):
    """Sorted distinct feature places of each document of a chunk."""
    wide = data.astype(np.uint64)
    shift = np.uint64(64 - BITS)
    codes = []
    for n in (3, 5):
        c = np.zeros(max(0, len(data) - n + 1), np.uint64)
        for k in range(n):
            c = (c << np.uint64(8)) | wide[k : k + len(c)]
        codes.append((mix(c + np.uint64(n << 48)) >> shift).astype(np.uint32))
    start, end, doc = word_spans(data, offsets)
    h = range_hashes(data, start, end)
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    repeats = np.bincount(doc[same], minlength=len(offsets) - 1)
    for d in range(len(offsets) - 1):
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        parts = [codes[i][lo : max(lo, hi - n + 1)] for i, n in enumerate((3, 5))]
        if repeats[d]:  # whether words repeat, and how often (by powers of two)
            parts.append(np.arange(int(repeats[d]).bit_length() + 1, dtype=np.uint32))
        yield np.unique(np.concatenate(parts))


def fit(rows: list[np.ndarray], y: np.ndarray) -> dict:
    """Weights by place, intercept and the logistic curve's slope and shift."""
    y = np.asarray(y)
    size = 1 << BITS
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return {"w": np.zeros(size), "slope": 1.0, "shift": float(np.log((share + 1e-3) / (1 - share + 1e-3)))}
    kept = np.arange(len(y)) % 4 != 0  # the others fit the curve
    p, q = np.ones(size), np.ones(size)
    for i in np.flatnonzero(kept).tolist():
        (p if y[i] else q)[rows[i]] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    w, bias = np.zeros(size), 0.0
    train = np.flatnonzero(kept)
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, PENALTY * len(y) / (2 * max(1, (y == 1).sum())),
                    PENALTY * len(y) / (2 * max(1, (y == 0).sum())))
    values = {i: ratio[rows[i]] / max(1.0, np.sqrt(len(rows[i]))) for i in train.tolist()}
    curve = {i: float(v @ v) + 1.0 for i, v in values.items()}
    alpha = np.zeros(len(y))
    rng = np.random.default_rng(2)
    for _ in range(ROUNDS):
        for i in rng.permutation(train).tolist():
            v, at = values[i], rows[i]
            slack = sign[i] * (float(w[at] @ v) + bias) - 1
            new = min(max(0.0, alpha[i] - slack / curve[i]), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[at] += step * v
                bias += step
                alpha[i] = new
    scaled = w * ratio
    model = {"w": scaled, "bias": bias, "slope": 1.0, "shift": 0.0}
    rest = np.flatnonzero(~kept)
    m = np.array([margin(model, rows[i]) for i in rest.tolist()])
    slope, shift = _logistic(m, y[rest])
    return model | {"slope": slope, "shift": shift}


def margin(model: dict, at: np.ndarray) -> float:
    return float(model["w"][at].sum()) / max(1.0, np.sqrt(len(at))) + model.get("bias", 0.0)


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(y = 1) over margins: Newton steps on smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * (a - 1), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        hess = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum()]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str, sample_rows: int) -> dict:
    """The model, fitted in one task over the bounded sample."""
    sample = labelled_sample(spark, docs, labels, target, sample_rows)

    def run(batch: pa.RecordBatch):
        for lo, hi in text_chunks(batch):
            part = batch.slice(lo, hi - lo)
            found = [f.tobytes() for f in features(*text_bytes(part.column("text")))]
            yield {"h": part.column("h"), "y": part.column("y"), "f": found}

    rows = map_batches(run, "h long, y int, f binary", sample)

    def once(key, table):
        table = table.sort_by("h")
        m = fit([np.frombuffer(f, np.uint32) for f in table.column("f").to_pylist()],
                table.column("y").to_numpy())
        line = {"w": m["w"].astype("<f8").tobytes(), "bias": float(m.get("bias", 0.0)),
                "slope": m["slope"], "shift": m["shift"]}
        return pa.table({k: [v] for k, v in line.items()})

    one = rows.groupBy(F.lit(0).alias("g")).applyInArrow(
        once, "w binary, bias double, slope double, shift double").collect()
    if not one:
        return fit([], np.zeros(0))
    return {"w": np.frombuffer(one[0]["w"]), "bias": one[0]["bias"], "slope": one[0]["slope"],
            "shift": one[0]["shift"]}


def score_quality(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, *, target: str = "quality",
    sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text)``."""
    model = spark.sparkContext.broadcast(train(spark, docs, labels, target, sample_rows))

    def run(batch: pa.RecordBatch):
        m = model.value
        for lo, hi in text_chunks(batch):
            part = batch.slice(lo, hi - lo)
            value = np.array([margin(m, f) for f in features(*text_bytes(part.column("text")))])
            p = 1 / (1 + np.exp(-np.clip(m["slope"] * value + m["shift"], -30, 30)))
            yield {"doc_id": part.column("doc_id"), "score": p}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = map_batches(run, "doc_id long, score double", docs)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_accepted(
    spark: SparkSession, docs: DataFrame, source: DataFrame, labels: DataFrame, *,
    target: str = "quality", sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5,
) -> DataFrame:
    """``docs`` without the rows scored below ``threshold`` by a model fitted on ``source`` and
    ``labels``; rows are judged where they are read, all columns are kept."""
    model = spark.sparkContext.broadcast(train(spark, source, labels, target, sample_rows))

    def run(batches):
        m = model.value
        for batch in batches:
            for lo, hi in text_chunks(batch):
                part = batch.slice(lo, hi - lo)
                value = np.array([margin(m, f) for f in features(*text_bytes(part.column("text")))])
                p = 1 / (1 + np.exp(-np.clip(m["slope"] * value + m["shift"], -30, 30)))
                yield part.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
