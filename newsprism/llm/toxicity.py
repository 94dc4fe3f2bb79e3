"""Toxic spans and document toxicity by a linear-chain conditional random field (operator 4).

Tokens are runs of letters, digits and non-ASCII bytes. A token's features are its own hash, the
hashes of its first 4, 5 and 6 bytes, and its neighbours; features and the 2 x 2 transitions are
weighted by a chain over the whole document, trained by gradient ascent on the likelihood of
labelled tokens. Forward-backward works on pieces of ``CHAIN`` tokens, many at once, one array step a
position; messages carried from piece to piece make it exact for the document.

Token labels come from the document labels: in a toxic sample document a token is toxic when its
hash or the hash of its first bytes is significantly more frequent in toxic than in other sample
documents, counting each pair of neighbours once (so that copies of a document do not add up).
Forward-backward marginals give every token's probability; a logistic curve over a document's
largest marginal and its expected number of toxic tokens gives the score, and tokens with a
marginal of one half or more give the offending character offsets.

The chain is fitted on a bounded sample (``sample_rows`` labelled rows of each class at most, never
held-out ones; of these, whole documents of at most ``CHAINS`` pieces with toxic tokens and twice as
many without) in one task; every document's whole text is tagged, in parallel, with the broadcast
weights (``2^BITS`` floats).

Results for odd rows: null, empty and token-less texts get the curve's lowest score and no spans; a
null doc_id is scored, held_out is false; repeated rows give repeated results; without usable
labels of both classes every score is 0 (1 if all labels are 1); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, map_batches, text_bytes, text_chunks
from .words import NOT_ALNUM, mix, range_hashes, word_spans

BITS = 18
CHAIN = 64
SAMPLE_ROWS = 2000
ROUNDS = 60
CHAINS = 6000  # training pieces of documents with a toxic token at most; and twice as many without
STEMS = (4, 5, 6)
EVIDENCE = 12.0  # log likelihood ratio from which a feature marks toxic tokens



def tokens(data: np.ndarray, offsets: np.ndarray):
    """(start, end, document, features) of each token; features has a column for each kind."""
    start, end, doc = word_spans(data, offsets, NOT_ALNUM)
    h = range_hashes(data, start, end)
    cols = [h] + [range_hashes(data, start, np.minimum(end, start + k)) for k in STEMS]
    for k, step in ((4, 1), (5, -1)):  # the tokens before and after, within the document
        near = np.roll(h, step)
        other = np.roll(doc, step) != doc
        if len(h):
            other[0 if step > 0 else -1] = True
        near[other] = 0
        cols.append(near)
    salted = [mix(c + np.uint64(k + 1)) >> np.uint64(64 - BITS) for k, c in enumerate(cols)]
    f = np.stack(salted, 1).astype(np.uint32) if len(h) else np.zeros((0, len(cols)), np.uint32)
    return start, end, doc, f, cols


def chains(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, position) of each token: documents cut every CHAIN tokens."""
    if not len(doc):
        return doc, doc
    first = np.searchsorted(doc, doc)
    place = np.arange(len(doc)) - first
    new = (place % CHAIN) == 0
    return np.cumsum(new) - 1, place % CHAIN


def joined(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each piece continues the document of the piece before."""
    of = doc[np.flatnonzero(at == 0)]
    out = np.zeros(len(of), bool)
    out[1:] = of[1:] == of[:-1]
    return out


def messages(odds: np.ndarray, live: np.ndarray, t: np.ndarray, goes_on: np.ndarray):
    """Forward messages into the first token of each piece and backward messages into its last one,
    from the other pieces of the document (1, 1 at its ends)."""
    n = len(goes_on)
    start, end = np.ones((2, n)), np.ones((2, n))
    if not goes_on.any():
        return start, end
    near = goes_on.copy()
    near[:-1] |= goes_on[1:]
    own, slot = np.flatnonzero(near), np.cumsum(near) - 1
    # the product of each piece's emissions and transitions, up to a factor
    m = np.zeros((2, 2, len(own)))
    m[0, 0], m[1, 1] = 1.0, odds[0, own]
    for i in range(1, len(odds)):
        go = live[i, own]
        q = np.stack([m[:, 0] * t[0, 0] + m[:, 1] * t[1, 0], (m[:, 0] * t[0, 1] + m[:, 1] * t[1, 1]) * odds[i, own]], 1)
        m = np.where(go, q / q.sum((0, 1)), m)
    rank = np.arange(n) - np.maximum.accumulate(np.where(goes_on, 0, np.arange(n)))
    order = np.argsort(rank, kind="stable")
    steps = np.split(order, np.searchsorted(rank[order], np.arange(1, rank.max() + 1)))[1:]
    for k in steps:
        u = np.einsum("rk,rck,cd->dk", start[:, k - 1], m[:, :, slot[k - 1]], t)
        start[:, k] = u / u.sum(0)
    for k in reversed(steps):
        u = np.einsum("dr,rck,ck->dk", t, m[:, :, slot[k]], end[:, k])
        end[:, k - 1] = u / u.sum(0)
    return start, end


def marginals(
    e: np.ndarray, chain: np.ndarray, at: np.ndarray, trans: np.ndarray, pairs: bool = False,
    goes_on: np.ndarray | None = None,
):
    """P(toxic) of each token from its emission odds ``e`` (log); with ``pairs`` also the expected
    transition counts. All chains advance together, one position at a time; ``goes_on`` tells the
    chains that continue the one before."""
    n = int(chain[-1]) + 1 if len(chain) else 0
    width = int(at.max()) + 1 if len(at) else 0
    odds, live = np.ones((width, n)), np.zeros((width, n), bool)
    odds[at, chain] = np.exp(np.clip(e, -30, 30))
    live[at, chain] = True
    t = np.exp(trans)
    goes_on = np.zeros(n, bool) if goes_on is None else goes_on
    start, end = messages(odds, live, t, goes_on)
    f0, f1 = np.zeros((width, n)), np.zeros((width, n))
    a0, a1 = np.full(n, 0.5), np.full(n, 0.5)
    for i in range(width):
        if i:
            n0, n1 = a0 * t[0, 0] + a1 * t[1, 0], a0 * t[0, 1] + a1 * t[1, 1]
        else:
            n0, n1 = start
        n1 = n1 * odds[i]
        s = n0 + n1
        a0, a1 = n0 / s, n1 / s
        f0[i], f1[i] = a0, a1
    p = np.zeros((width, n))
    b0, b1 = end
    count = np.zeros((2, 2))

    def add(g0, g1, w0, w1):
        x = [[g0 * t[0, 0] * w0, g0 * t[0, 1] * w1], [g1 * t[1, 0] * w0, g1 * t[1, 1] * w1]]
        z = x[0][0] + x[0][1] + x[1][0] + x[1][1]
        for r in (0, 1):
            for c in (0, 1):
                count[r, c] += (x[r][c] / z).sum()

    for i in range(width - 1, -1, -1):
        if i < width - 1:
            nxt = live[i + 1]
            w0, w1 = b0, odds[i + 1] * b1
            if pairs:
                add(f0[i][nxt], f1[i][nxt], w0[nxt], w1[nxt])
            n0, n1 = t[0, 0] * w0 + t[0, 1] * w1, t[1, 0] * w0 + t[1, 1] * w1
            s = n0 + n1
            b0, b1 = np.where(nxt, n0 / s, end[0]), np.where(nxt, n1 / s, end[1])
        g0, g1 = f0[i] * b0, f1[i] * b1
        p[i] = g1 / (g0 + g1)
    if pairs and goes_on.any():
        k = np.flatnonzero(goes_on)
        last = np.bincount(chain)[k - 1] - 1
        add(f0[last, k - 1], f1[last, k - 1], b0[k], odds[0, k] * b1[k])
    return (p[at, chain], count) if pairs else p[at, chain]


def token_labels(cols: list[np.ndarray], near: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Whether each token of the sample is toxic. ``near``: hash of its neighbours; ``toxic``:
    whether its document is labelled so."""
    out = np.zeros(len(toxic), bool)
    for h in cols:
        value, at = np.unique(h, return_inverse=True)
        order = np.lexsort((near, at, toxic))
        new = np.ones(len(order), bool)
        new[1:] = (
            (at[order][1:] != at[order][:-1]) | (near[order][1:] != near[order][:-1])
            | (toxic[order][1:] != toxic[order][:-1])
        )
        once = order[new]
        c1 = np.bincount(at[once], weights=toxic[once], minlength=len(value))
        c0 = np.bincount(at[once], weights=~toxic[once], minlength=len(value))
        c, share = c1 + c0, c1.sum() / max(1.0, c1.sum() + c0.sum())
        gain = c1 * np.log(np.maximum(c1, 1e-9) / (c * share)) + c0 * np.log(
            np.maximum(c0, 1e-9) / (c * (1 - share)))
        marks = (gain >= EVIDENCE) & (c1 * max(1.0, c0.sum()) >= 20 * (c0 + 0.1) * max(1.0, c1.sum()))
        out |= marks[at]
    return out & toxic


def fit(data: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> dict:
    """Feature weights, transitions and the document curve."""
    size = 1 << BITS
    flat = {"w": np.zeros(size), "trans": np.zeros((2, 2)), "curve": np.array([0.0, 0.0, -30.0])}
    if len(set(y.tolist())) < 2:
        flat["curve"][2] = 30.0 if len(y) and y[0] == 1 else -30.0
        return flat
    _, _, doc, f, cols = tokens(data, offsets)
    near = mix(cols[-2] + np.uint64(3) * cols[-1])
    label = token_labels(cols[: 1 + len(STEMS)], near, y[doc] == 1).astype(float)
    chain, at = chains(doc)
    goes_on = joined(doc, at)
    pieces = np.bincount(doc[at == 0], minlength=len(y))
    has = np.bincount(doc, weights=label, minlength=len(y)) > 0
    rng = np.random.default_rng(4)
    use = np.arange(len(y)) % 4 != 0  # the other documents fit the curve

    def some(which: np.ndarray, n: int) -> np.ndarray:
        which = rng.permutation(which)
        before = np.cumsum(pieces[which]) - pieces[which]
        return which[(before + pieces[which] <= n) | (before == 0)]

    picked = np.zeros(len(y), bool)
    picked[some(np.flatnonzero(has & use), CHAINS)] = True
    picked[some(np.flatnonzero(~has & use & (y == 0)), 2 * CHAINS)] = True
    rows = np.flatnonzero(picked[doc])
    td, tf, tl, ta = doc[rows], f[rows], label[rows], at[rows]
    tc, tj = np.cumsum(ta == 0) - 1, joined(td, ta)
    w, trans = np.zeros(size), np.zeros((2, 2))
    w[:] = 0.0
    seen_w, seen_t = np.full(size, 1e-8), np.full((2, 2), 1e-8)
    bias = -4.0
    seen_b = 1e-8
    same = td[1:] == td[:-1]
    a, b = tl[:-1][same].astype(int), tl[1:][same].astype(int)
    observed = np.bincount(2 * a + b, minlength=4).reshape(2, 2).astype(float)
    flat_f = tf.ravel()
    for _ in range(ROUNDS):
        p, expected = marginals(w[tf].sum(1) + bias, tc, ta, trans, pairs=True, goes_on=tj)
        diff = tl - p
        g = np.bincount(flat_f, weights=np.repeat(diff, tf.shape[1]), minlength=size) - 0.05 * w
        gt, gb = (observed - expected) - 0.05 * trans, diff.sum()
        seen_w += g * g
        seen_t += gt * gt
        seen_b += gb * gb
        w += 0.5 * g / np.sqrt(seen_w)
        trans += 0.2 * gt / np.sqrt(seen_t)
        bias += 0.2 * gb / np.sqrt(seen_b)
    model = {"w": w, "trans": trans, "bias": bias}
    p = marginals(w[f].sum(1) + bias, chain, at, trans, goes_on=goes_on)
    x = document_features(p, doc, len(y))
    rest = np.arange(len(y)) % 4 == 0
    if len(set(y[rest].tolist())) < 2:
        rest[:] = True
    return model | {"curve": _logistic(x[rest], y[rest])}


def document_features(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(log odds of the largest marginal, log of 1 + expected toxic tokens) of each document."""
    top = np.zeros(n)
    np.maximum.at(top, doc, p)
    top = np.clip(top, 1e-5, 1 - 1e-5)
    return np.stack([np.log(top / (1 - top)), np.log1p(np.bincount(doc, weights=p, minlength=n))], 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (of each column, and the constant) by Newton steps with a light ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    c = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(c))
        step = np.linalg.solve(hess, x.T @ (p - y) + 0.1 * c)
        c = c - step
        if abs(step).max() < 1e-8:
            break
    return c


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str, sample_rows: int) -> dict:
    sample = labelled_sample(spark, docs, labels, target, sample_rows)

    def once(key, table):
        table = table.sort_by("h")
        m = fit(*text_bytes(table.column("text")), table.column("y").to_numpy())
        return pa.table({"w": [m["w"].astype("<f8").tobytes()], "trans": [m["trans"].astype("<f8").tobytes()],
                         "curve": [m["curve"].astype("<f8").tobytes()], "bias": [float(m.get("bias", 0.0))]})

    # long texts would dominate the sample: each gives its tokens, bounded by the sample's rows
    one = sample.groupBy(F.lit(0).alias("g")).applyInArrow(
        lambda key, table: once(key, table), "w binary, trans binary, curve binary, bias double").collect()
    if not one:
        return fit(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, int))
    row = one[0]
    return {"w": np.frombuffer(row["w"]), "trans": np.frombuffer(row["trans"]).reshape(2, 2),
            "curve": np.frombuffer(row["curve"]), "bias": row["bias"]}


def score_toxicity(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, *, target: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, threshold: float = 0.7,
) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_spans, spans) of every row of ``docs(doc_id, text)``.

    spans: "start:end" in code points of each run of toxic tokens, comma-joined.
    """
    model = spark.sparkContext.broadcast(train(spark, docs, labels, target, sample_rows))

    def run(batch: pa.RecordBatch):
        m = model.value
        for lo, hi in text_chunks(batch):
            part = batch.slice(lo, hi - lo)
            data, offsets = text_bytes(part.column("text"))
            start, end, doc, f, _ = tokens(data, offsets)
            chain, at = chains(doc)
            e = np.full(len(doc), m.get("bias", 0.0))
            for k in range(f.shape[1]):
                e += m["w"][f[:, k]]
            p = marginals(e, chain, at, m["trans"], goes_on=joined(doc, at))
            x = np.column_stack([document_features(p, doc, hi - lo), np.ones(hi - lo)])
            score = 1 / (1 + np.exp(-np.clip(x @ m["curve"], -30, 30)))
            spans: list[list[str]] = [[] for _ in range(hi - lo)]
            hit = np.flatnonzero(p >= 0.5)
            if len(hit):
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                open_ = np.ones(len(hit), bool)
                open_[1:] = (hit[1:] != hit[:-1] + 1) | (doc[hit[1:]] != doc[hit[:-1]])
                close = np.append(open_[1:], True)
                for a, b in zip(hit[open_], hit[close]):
                    d = doc[a]
                    base = chars[offsets[d]]
                    spans[d].append(f"{chars[start[a]] - base}:{chars[end[b]] - base}")
            yield {"doc_id": part.column("doc_id"), "score": score, "n_spans": [len(s) for s in spans],
                   "spans": [",".join(s) for s in spans]}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = map_batches(run, "doc_id long, score double, n_spans long, spans string", docs)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "n_spans", "spans",
    )
