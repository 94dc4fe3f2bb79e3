"""Ranked lexical search over a length-stratified index (operator 12).

Every item is a query against all documents; a document's score is the sum, over the item's terms,
of ``w * ((10^9 tf) div (1000 tf + 12 m))``, where m depends on the document's length alone.

1. One pass over the texts writes, of each document, its length and how often it holds the terms
   of the items, and of each task the sums that N, L and the document frequencies are made of.
2. A second pass reads these short rows in blocks of at most ``BLOCK_POSTINGS`` and indexes a
   block: the documents grouped by equal m (a stratum), the postings of a term within a stratum by
   falling tf. The impact of a posting depends on (m, tf) only and is computed once for each such
   pair. The largest tf of each term gives a bound for every item and stratum; an item visits its
   strata by falling bound, in rounds of doubling size, until the next bound is below its 20th
   score, which carries over from block to block of a task.
3. The tasks' lists (20 rows an item at most) are ranked in two steps, so no task reads the lists of
   all others.

Nothing is shuffled but these lists, so a hot stratum or word needs no splitting: it is spread over
the blocks as its documents are. Terms are looked up by 64 hash bits of their bytes; only the terms of
the items can be confused, with probability (distinct words) * (item terms) / 2^64. The items are
read in slices of about ``SLICE_BYTES`` of text and ``SLICE_ITEMS`` items, one pass a slice, so what
is broadcast is bounded whatever the number of items.

Results for odd rows: a null text or one without terms is no document and an item without terms
finds nothing; an empty table gives no rows; a null doc_id is ranked as a document of its own, last
among equal scores; repeated rows of documents are ranked each; equal rows of items count once, and
rows that share an item_id but not the text are ranked each on its own under that item_id. Other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, stored, text_bytes, text_chunks
from .words import NOT_ALNUM, words

BEST = 20
SLICE_BYTES = 8 << 20
SLICE_ITEMS = 20_000
BLOCK_POSTINGS = 2_000_000
CELLS = 2_000_000  # scores held at once in a round
OUT = "item_id long, rank int, doc_id long, score long"
COUNTS = "doc_id long, n long, terms binary, tfs binary, docs long, words long, df binary"


class Items:
    """The items of one slice: their distinct terms (hashes, sorted) and how often each item holds which."""

    def __init__(self, rows: list[tuple[int, str]]):
        data, offsets = text_bytes(pa.array([t for _, t in rows], pa.string()))
        h, at = words(data, offsets, NOT_ALNUM)
        self.ids = [i for i, _ in rows]
        self.terms = np.unique(h)
        item = np.repeat(np.arange(len(rows)), np.diff(at))
        key, times = np.unique(item * max(1, len(self.terms)) + np.searchsorted(self.terms, h), return_counts=True)
        self.item, self.term, self.times = key // max(1, len(self.terms)), key % max(1, len(self.terms)), times

    def weigh(self, n: int, df: np.ndarray) -> None:
        """Weights once N and the document frequencies are known."""
        w = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(f) + 1))) for f in df], np.int64)
        keep = (w[self.term] > 0) & (df[self.term] > 0)
        self.item, self.term = self.item[keep], self.term[keep]
        self.weight = self.times[keep] * w[self.term]
        self.start = np.searchsorted(self.item, np.arange(len(self.ids) + 1))
        # an impact is below 10^6: scores below 2^53 are exact in doubles
        most = np.zeros(len(self.ids))
        np.add.at(most, self.item, self.weight * 1e6)
        self.exact = bool(most.max(initial=0) < 2**53)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of every place in the ranges [lo, hi)."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which]


def _sum(at: np.ndarray, values: np.ndarray, n: int, exact: bool) -> np.ndarray:
    if exact:
        return np.bincount(at, values, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


class Ranking:
    """The best documents of each item so far; ``add`` takes a block of documents."""

    def __init__(self, items: Items, n_docs: int, n_words: int, best: int = BEST):
        self.items, self.n_docs, self.n_words, self.best = items, n_docs, n_words, best
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.least = np.zeros(len(items.ids), np.int64)  # a score below it cannot enter any more
        self.visited = self.strata = 0

    def normaliser(self, n: np.ndarray) -> np.ndarray:
        value, back = np.unique(n, return_inverse=True)
        return np.array([75 + (25 * v * self.n_docs) // self.n_words for v in value.tolist()], np.int64)[back]

    def add(self, doc: np.ndarray, n: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Documents with lengths ``n`` and postings ``at[d]:at[d + 1]`` of (term, tf)."""
        m = self.normaliser(n)
        order = np.lexsort((doc, m))  # strata one after the other
        value, first, stratum = np.unique(m[order], return_index=True, return_inverse=True)
        first = np.append(first, len(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        stratum_of = np.empty(len(order), np.int64)
        stratum_of[order] = stratum
        owner = np.repeat(np.arange(len(doc)), np.diff(at))
        s = len(value)
        key = term.astype(np.int64) * s + stratum_of[owner]
        sort = np.lexsort((place[owner], -tf, key))  # by term and stratum, falling tf
        key, tf, row = key[sort], tf[sort], place[owner][sort]
        # one impact for each (m, tf)
        pair, back = np.unique((key % s) * (int(tf.max(initial=0)) + 1) + tf, return_inverse=True)
        own, times = pair // (int(tf.max(initial=0)) + 1), pair % (int(tf.max(initial=0)) + 1)
        impact = ((1_000_000_000 * times) // (1000 * times + 12 * value[own]))[back]
        runs, begin = np.unique(key, return_index=True)
        end = np.append(begin, len(key))[1:]
        self._visit(doc[order], first, runs, begin, end, row, impact, s)

    def _visit(self, doc, first, runs, begin, end, row, impact, s) -> None:
        items = self.items
        # bounds: the first posting of a run has its largest impact
        run_term, run_stratum, top = runs // s, runs % s, impact[begin]
        by_term = np.searchsorted(run_term, np.arange(len(items.terms) + 1))
        step = max(1, CELLS // max(1, s))
        for a in range(0, len(items.ids), step):
            b = min(a + step, len(items.ids))
            lo, hi = items.start[a], items.start[b]
            which, run = _ranges(by_term[items.term[lo:hi]], by_term[items.term[lo:hi] + 1])
            cell = (items.item[lo:hi][which] - a) * s + run_stratum[run]
            bound = _sum(cell, items.weight[lo:hi][which] * top[run], (b - a) * s, items.exact).reshape(b - a, s)
            visit = np.argsort(-bound, axis=1, kind="stable")
            bound = np.take_along_axis(bound, visit, 1)
            self.strata += int((bound > 0).sum())
            done, take = 0, 1
            while done < s:
                want = bound[:, done : done + take]
                live = (want > 0) & (want >= self.least[a:b, None])
                if not live.any():
                    break  # bounds fall: nothing later can enter either
                i, k = np.nonzero(live)
                self._score(i + a, visit[i, done + k], doc, first, runs, begin, end, row, impact, s)
                done, take = done + take, take * 2

    def _score(self, item, stratum, doc, first, runs, begin, end, row, impact, s) -> None:
        """Scores of (item, stratum) pairs, in portions of about ``CELLS`` documents."""
        items = self.items
        self.visited += len(item)
        size = first[stratum + 1] - first[stratum]
        base = np.cumsum(size) - size
        portion = base // CELLS
        for p in np.unique(portion).tolist():
            own = np.flatnonzero(portion == p)
            which, entry = _ranges(items.start[item[own]], items.start[item[own] + 1])
            key = items.term[entry] * s + stratum[own][which]
            run = np.searchsorted(runs, key)
            ok = run < len(runs)
            ok[ok] = runs[run[ok]] == key[ok]
            which, entry, run = which[ok], entry[ok], run[ok]
            pair, posting = _ranges(begin[run], end[run])
            start = base[own] - base[own[0]]
            at = start[which[pair]] + row[posting] - first[stratum[own]][which[pair]]
            total = int(start[-1] + size[own[-1]])
            score = _sum(at, items.weight[entry[pair]] * impact[posting], total, items.exact)
            hit = np.flatnonzero(score > 0)
            of = np.searchsorted(start, hit, "right") - 1
            found = item[own][of]
            good = score[hit] >= self.least[found]
            hit, of, found = hit[good], of[good], found[good]
            self._keep(found, score[hit], doc[first[stratum[own][of]] + hit - start[of]])

    def _keep(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(v) for v in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        keep = nth < self.best
        last = nth == self.best - 1
        self.least[item[last]] = score[last]
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]


def count_terms(docs: DataFrame, items) -> DataFrame:
    """Of each document with terms: its length and the terms of ``items`` in it; and of each task
    a row of sums (documents, words, document frequencies)."""
    state: dict = {}

    def run(batch: pa.RecordBatch):
        terms = items.value.terms
        if not state:
            state.update(docs=0, words=0, df=np.zeros(len(terms), np.int64))
        for lo, hi in text_chunks(batch):
            part = batch.slice(lo, hi - lo)
            h, at = words(*text_bytes(part.column("text")), NOT_ALNUM)
            n = np.diff(at)
            doc = np.repeat(np.arange(len(n)), n)
            where = np.minimum(np.searchsorted(terms, h), max(0, len(terms) - 1))
            hit = terms[where] == h if len(terms) else np.zeros(len(h), bool)
            key, tf = np.unique(doc[hit] * max(1, len(terms)) + where[hit], return_counts=True)
            term, owner = (key % max(1, len(terms))).astype("<i4"), key // max(1, len(terms))
            tf = tf.astype("<i4")
            state["docs"] += int((n > 0).sum())
            state["words"] += int(n.sum())
            state["df"] += np.bincount(term, minlength=len(terms))
            some = np.unique(owner)
            cut = np.searchsorted(owner, np.append(some, len(n)))
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
            blank = [None] * len(some)
            yield {"doc_id": part.column("doc_id").take(pa.array(some)), "n": n[some],
                   "terms": [term[i:j].tobytes() for i, j in spans], "tfs": [tf[i:j].tobytes() for i, j in spans],
                   "docs": blank, "words": blank, "df": blank}

    def last():
        if state:
            one = {"doc_id": [None], "n": [None], "terms": [None], "tfs": [None], "docs": [state["docs"]],
                   "words": [state["words"]], "df": [state["df"].astype("<i8").tobytes()]}
            state.clear()
            yield one

    return map_batches(run, COUNTS, docs, at_end=last)


def _statistics(spark: SparkSession, counts: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(N, L, df by term) over all documents; the driver reads one row a term of the items."""
    n = counts.agg(F.sum("docs"), F.sum("words")).first()

    def unpack(batch: pa.RecordBatch):
        total = np.zeros(size, np.int64)
        for raw in batch.column("df").to_pylist():
            total += np.frombuffer(raw, "<i8")
        some = np.flatnonzero(total)
        yield {"term": some.astype(np.int32), "df": total[some]}

    df = np.zeros(size, np.int64)
    rows = map_batches(unpack, "term int, df long", counts.where("df is not null").select("df"))
    for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return n[0] or 0, n[1] or 0, df


def _rank_slice(spark: SparkSession, docs: DataFrame, rows: list[tuple[int, str]], best: int) -> DataFrame | None:
    items = Items(rows)
    sent = spark.sparkContext.broadcast(items)
    counts = stored(spark, count_terms(docs, sent), "term-counts")
    n_docs, n_words, df = _statistics(spark, counts, len(items.terms))
    if not n_docs:
        return None
    items.weigh(n_docs, df)
    sent = spark.sparkContext.broadcast(items)

    def search(batches):
        ranking = Ranking(sent.value, n_docs, n_words, best)
        held, postings = [], 0

        def flush():
            doc, n, terms, tfs, size = (list(c) for c in zip(*held))
            ranking.add(np.concatenate(doc), np.concatenate(n), np.concatenate([[0], np.cumsum(np.concatenate(size))]),
                        np.frombuffer(b"".join(terms), "<i4"), np.frombuffer(b"".join(tfs), "<i4").astype(np.int64))
            held.clear()

        for batch in batches:
            terms = batch.column("terms").to_pylist()
            size = np.array([len(t) // 4 for t in terms], np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // BLOCK_POSTINGS)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(terms)]):
                if hi == lo:
                    continue
                # a null id sorts after all others and comes back as null
                doc = np.array([NO_ID if d is None else d for d in batch.column("doc_id")[lo:hi].to_pylist()], np.int64)
                held.append((doc, batch.column("n")[lo:hi].to_numpy(), b"".join(terms[lo:hi]),
                             b"".join(batch.column("tfs")[lo:hi].to_pylist()), size[lo:hi]))
                postings += int(size[lo:hi].sum())
                if postings >= BLOCK_POSTINGS:
                    flush()
                    postings = 0
        if held:
            flush()
        ids = sent.value.ids
        for a in range(0, len(ranking.item), 50_000):
            own = ranking.item[a : a + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array([ids[i] for i in own.tolist()], pa.int64()),
                 pa.array([None if d == NO_ID else d for d in ranking.doc[a : a + 50_000].tolist()], pa.int64()),
                 pa.array(ranking.score[a : a + 50_000])], names=["item", "item_id", "doc_id", "score"])

    found = counts.where("terms is not null").select("doc_id", "n", "terms", "tfs").mapInArrow(
        search, "item long, item_id long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    part = part.withColumn("nth", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
    part = part.where(F.col("nth") <= best).drop("nth", "part")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return part.withColumn("rank", rank).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


NO_ID = np.iinfo(np.int64).max


def rank_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of ``docs(doc_id, text)`` for each
    row of ``benchmark(item_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    items = stored(spark, items, "items")
    count, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    out = None
    slices = max(-(-count // SLICE_ITEMS), -(-(size or 0) // SLICE_BYTES))
    for k in range(slices):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").collect()
        found = _rank_slice(spark, docs, [(r["item_id"], r["text"]) for r in own], best) if own else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], OUT)
