"""Benchmark decontamination by BM25 retrieval with block-max WAND (operator 9).

The test items are indexed: an inverted list for each word, holding the items with that word and
its BM25 impact divided by the item's own total, so a passage with every word of an item scores 1
against it. Items longer than ``PART_WORDS`` words are indexed in equal parts, for retrieval only.
Every document is cut into overlapping passages, each twice as long as the longest item part and starting halfway through
the one before, so that any copy of a part lies whole in one passage.

Every passage is a query and all items scoring at least ``threshold`` are retrieved. First the
essential words (those an item cannot reach the threshold without, rarest first) give every
(passage, item) an upper bound, as array operations over a chunk of documents; the passages with a
bound above the threshold then go through block-max WAND over the inverted lists. A retrieved item
counts as a leak if the passage also holds enough of the item's question (all before the
last sentence that holds a letter or digit) and of its answer (the rest), by distinct runs of three words. The item of a
retrieved part is held against the words around the passage where the rest of the item would lie.

The index is broadcast in slices of ``SLICE_WORDS`` item words at most; each slice makes one pass
over the documents, so its size is bounded whatever the benchmark's. Document frequencies and
lengths are those of the whole benchmark.

Results for odd rows: null and empty texts have no passages and leak nothing; null or empty items
are never retrieved; doc_id and item_id may be null and are passed through; repeated documents or
items give repeated rows; an item of one word leaks in every document that holds the word, and a
one-word answer is found wherever the word stands in the passage; other columns are ignored
(``clean`` keeps them).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stored, text_bytes, text_chunks
from .words import NOT_ALNUM, ngrams
from .words import words as split_words

THRESHOLD = 0.6
OVERLAP = 0.5  # share of the question's and of the answer's runs that must be in the passage
PART_WORDS = 128
SLICE_WORDS = 2_000_000
BLOCK = 16  # postings of one block
K1, B = 1.2, 0.75
_SENTENCE = re.compile(r"(?<=[.?!])\s+(?=\S)")


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes without punctuation or case, so that marks glued to a copy do not hide it."""
    return split_words(data, offsets, NOT_ALNUM)


def part_numbers(place, size):
    """Number of the part that the word at ``place`` of an item of ``size`` words is in: as few
    parts as ``PART_WORDS`` allows, equal but for one word."""
    return place * -(-size // PART_WORDS) // size


def question_and_answer(text: str) -> tuple[str, str]:
    """What stands before the last sentence that holds a letter or digit, and the rest from there
    (blanks and marks after it included); if one of them has none, the whole text is both."""
    text = text.strip()
    for cut in reversed([m.end() for m in _SENTENCE.finditer(text)]):
        if any(map(str.isalnum, text[cut:])):
            return (text[:cut], text[cut:]) if any(map(str.isalnum, text[:cut])) else (text, text)
    return text, text


def _runs(text: str) -> np.ndarray:
    h, _ = words(*text_bytes(pa.array([text])))
    return np.unique(ngrams(h, min(3, len(h)))) if len(h) else np.zeros(0, np.uint64)


class Index:
    """Inverted lists of a slice of the item parts, and what verification needs."""

    def __init__(self, items, stats: dict, part_words: int, threshold: float):
        self.threshold, self.stride = threshold, part_words
        self.ids, self.runs, self.whole = [], [], []
        term, part, tf = [], [], []
        for item_id, text in items:
            h, _ = words(*text_bytes(pa.array([text])))
            if not len(h):
                continue
            number = part_numbers(np.arange(len(h)), len(h))
            starts = np.searchsorted(number, np.arange(number[-1] + 2)).tolist()
            for lo, hi in zip(starts, starts[1:]):
                value, count = np.unique(h[lo:hi], return_counts=True)
                term.append(value)
                part.append(np.full(len(value), len(self.ids)))
                tf.append(count)
                self.ids.append(item_id)
                self.whole.append((len(self.runs), lo, len(h)))  # item, place of the part, words
            self.runs.append(tuple(map(_runs, question_and_answer(text))))
        n = len(self.ids)
        empty = np.zeros(0, np.uint64)
        term = np.concatenate(term) if term else empty
        part = np.concatenate(part).astype(np.int64) if n else np.zeros(0, np.int64)
        tf = np.concatenate(tf).astype(float) if n else np.zeros(0)
        self.terms, at = np.unique(term, return_inverse=True)
        df = np.array([stats["df"][int(t)] for t in self.terms.tolist()], float)[at] if n else tf
        length = np.bincount(part, weights=tf, minlength=n)
        idf = np.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
        impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[part] / stats["mean"])) if n else tf
        impact = impact / np.bincount(part, weights=impact, minlength=n)[part] if n else tf
        order = np.lexsort((part, at))
        self.item, self.impact = part[order], impact[order]
        self.start = np.searchsorted(at[order], np.arange(len(self.terms) + 1))
        # essential postings: without any of them an item stays below the threshold
        essential = np.zeros(len(order), bool)
        self.rest = np.zeros(n)
        rank = np.lexsort((self.impact, -df[order], self.item))
        bounds = np.searchsorted(self.item[rank], np.arange(n + 1))
        for i in range(n):
            own = rank[bounds[i] : bounds[i + 1]]
            low = np.cumsum(self.impact[own]) < 0.75 * threshold
            self.rest[i] = self.impact[own[low]].sum()
            essential[own[~low]] = True
        self.e_item, self.e_impact = self.item[essential], self.impact[essential]
        self.e_start = np.concatenate([[0], np.cumsum(essential)])[self.start]
        # lists and block maxima for WAND
        self.top = [float(self.impact[a:b].max()) if b > a else 0.0 for a, b in zip(self.start[:-1], self.start[1:])]
        self.lists = []
        for a, b in zip(self.start[:-1].tolist(), self.start[1:].tolist()):
            own, imp = self.item[a:b].tolist(), self.impact[a:b].tolist()
            last = [own[min(k + BLOCK, b - a) - 1] for k in range(0, b - a, BLOCK)]
            best = [max(imp[k : k + BLOCK]) for k in range(0, b - a, BLOCK)]
            self.lists.append((own, imp, last, best))

    def search(self, query: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every (part, score) with score >= threshold for these term numbers."""
        need = self.threshold - 1e-9
        # a cursor: [current item, place, term]
        cursors = [[self.lists[t][0][0], 0, t] for t in query]
        found = []

        def seek(c, target):
            own, place = self.lists[c[2]][0], c[1]
            last, block = self.lists[c[2]][2], c[1] // BLOCK
            while block < len(last) and last[block] < target:
                block += 1
            place = max(place, block * BLOCK)
            while place < len(own) and own[place] < target:
                place += 1
            c[1] = place
            c[0] = own[place] if place < len(own) else -1

        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.top[c[2]]
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block_bound, reach = 0.0, -1
            for c in cursors[: pivot + 1]:
                _, _, last, best = self.lists[c[2]]
                b = c[1] // BLOCK
                while b < len(last) and last[b] < item:
                    b += 1
                if b < len(last):
                    block_bound += best[b]
                    reach = last[b] if reach < 0 else min(reach, last[b])
            if block_bound < need:
                # no item up to the nearest block end can reach the threshold
                target = max(item, reach) + 1
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, item + 1)
                for c in cursors[: pivot + 1]:
                    if c[0] < target:
                        seek(c, target)
            elif cursors[0][0] == item:
                score = sum(self.lists[c[2]][1][c[1]] for c in cursors if c[0] == item)
                if score >= need:
                    found.append((item, score))
                for c in cursors[: pivot + 1]:
                    seek(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    if c[0] < item:
                        seek(c, item)
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def leaks(self, data: np.ndarray, offsets: np.ndarray):
        """(row, part, score, question share, answer share) of every part found in a chunk of documents."""
        h, at = words(data, offsets)
        if not len(h) or not len(self.terms):
            return []
        where = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[where] == h)
        doc = np.searchsorted(at, hit, "right") - 1
        blocks = -(-np.diff(at) // self.stride)
        count = np.maximum(1, blocks - 1)
        base = np.concatenate([[0], np.cumsum(count)])
        block = (hit - at[doc]) // self.stride
        # a word lies in the passage that starts with its block and in the one before
        early, late = np.maximum(block - 1, 0), np.minimum(block, count[doc] - 1)
        two = early < late
        window = np.concatenate([base[doc] + late, base[doc[two]] + early[two]])
        term = np.concatenate([where[hit], where[hit[two]]])
        key = np.unique(window * len(self.terms) + term)
        window, term = key // len(self.terms), key % len(self.terms)
        # upper bounds from essential postings
        size = self.e_start[term + 1] - self.e_start[term]
        has = np.flatnonzero(size)
        size = size[has]
        place = np.repeat(self.e_start[term[has]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        pair = np.repeat(window[has], size) * len(self.ids) + self.e_item[place]
        pairs, which = np.unique(pair, return_inverse=True)
        bound = np.bincount(which, weights=self.e_impact[place]) + self.rest[pairs % len(self.ids)]
        out, held = [], {}

        def shares(d: int, lo: int, hi: int, item: int) -> list[float]:
            """Shares of the item's question and answer runs in the document's words [lo, hi)."""
            own = h[at[d] + max(0, lo) : min(at[d + 1], at[d] + hi)]
            runs = {n: ngrams(own, n) for n in (1, 2, 3)}
            out = []
            for side in self.runs[item]:
                here = runs[3] if len(side) > 1 else np.concatenate(list(runs.values()))
                out.append(float(np.isin(side, here).mean()))
            return out

        first = np.searchsorted(window, np.arange(base[-1] + 1))
        for w in np.unique(pairs[bound >= self.threshold - 1e-9] // len(self.ids)).tolist():
            found = self.search(term[first[w] : first[w + 1]].tolist())
            if not found:
                continue
            d = int(np.searchsorted(base, w, "right") - 1)
            lo = int(w - base[d]) * self.stride
            for part, score in found:
                item, place, size = self.whole[part]
                if size <= self.stride:
                    a, b = lo, lo + 2 * self.stride
                else:
                    # a copy starts in the three strides from here on; one more on either side. In
                    # whole strides, so that the parts of a copy share a few ranges
                    a = (lo - place) // self.stride * self.stride
                    a, b = a - self.stride, a + 4 * self.stride + size
                if (d, a, item) not in held:
                    held[d, a, item] = shares(d, a, b, item)
                out.append((d, part, score, *held[d, a, item]))
        return out


def _slices(spark: SparkSession, benchmark: DataFrame, threshold: float):
    """Broadcast indexes over the whole benchmark, slice by slice."""

    def count(batch: pa.RecordBatch):
        for lo, hi in text_chunks(batch):
            h, at = words(*text_bytes(batch.slice(lo, hi - lo).column("text")))
            row = np.repeat(np.arange(hi - lo), np.diff(at))
            # a part's words, once each; parts are told apart by row and place
            place = np.arange(len(h)) - at[row]
            part = row * (1 << 32) + part_numbers(place, np.diff(at)[row])
            order = np.lexsort((h, part))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (part[order][1:] != part[order][:-1])
            value, df = np.unique(h[order][new], return_counts=True)
            yield {"term": value.view(np.int64), "df": df, "words": np.zeros(len(df), np.int64), "parts": np.zeros(len(df), np.int64), "most": np.zeros(len(df), np.int64)}
            sizes = np.diff(at)
            yield {"term": [None], "df": [0], "words": [int(sizes.sum())], "parts": [int((-(-sizes // PART_WORDS)).sum())], "most": [int(sizes.max(initial=0))]}

    items = stored(spark, benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null"), "items")
    counted = stored(spark, map_batches(count, "term long, df long, words long, parts long, most long", items), "item-words")
    total = counted.where("term is null").agg(F.sum("words"), F.sum("parts"), F.max("most")).first()
    if not total[0]:
        return
    n_slices = -(-total[0] // SLICE_WORDS)
    df = counted.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    part_words = min(PART_WORDS, total[2])
    for k in range(n_slices):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)) == k).orderBy("item_id", "text").collect()
        value, _ = words(*text_bytes(pa.array([r["text"] for r in own], pa.string())))
        mine = df
        if n_slices > 1:
            terms = spark.createDataFrame([(int(t),) for t in np.unique(value).view(np.int64)], "term long")
            mine = df.join(terms, "term", "left_semi")
        stats = {"df": {int(np.int64(r["term"]).view(np.uint64)): r["df"] for r in mine.collect()},
                 "n": total[1], "mean": total[0] / total[1]}
        yield spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in own], stats, part_words, threshold))


def find_leaks(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *,
    threshold: float = THRESHOLD, overlap: float = OVERLAP,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for every document and
    item leaked in it, with the best passage's figures."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in _slices(spark, benchmark, threshold):

        def run(batch: pa.RecordBatch, index=index):
            for lo, hi in text_chunks(batch):
                part = batch.slice(lo, hi - lo)
                best: dict[tuple, tuple] = {}
                for d, item, score, q, a in index.value.leaks(*text_bytes(part.column("text"))):
                    if min(q, a) >= overlap:
                        key = (d, index.value.ids[item])
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (round(score, 9), q, a))
                ids = part.column("doc_id").to_pylist()
                yield {"doc_id": [ids[d] for d, _ in best], "item_id": [i for _, i in best],
                       "score": [v[0] for v in best.values()],
                       "question_overlap": [v[1] for v in best.values()],
                       "answer_overlap": [v[2] for v in best.values()]}

        found = map_batches(run, schema, docs)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *,
    threshold: float = THRESHOLD, overlap: float = OVERLAP,
) -> DataFrame:
    """``docs`` without the documents that leak an item; rows are judged where they are read."""
    for index in _slices(spark, benchmark, threshold):

        def run(batches, index=index):
            for batch in batches:
                for lo, hi in text_chunks(batch):
                    part = batch.slice(lo, hi - lo)
                    keep = np.ones(hi - lo, bool)
                    for d, _, _, q, a in index.value.leaks(*text_bytes(part.column("text"))):
                        keep[d] &= min(q, a) < overlap
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
