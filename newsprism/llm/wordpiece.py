"""Greedy word-piece counts by a linear longest-match automaton (operator 5).

The vocabulary is a trie over bytes. A node's failure link leads to the node reached after the
longest vocabulary pieces have been cut off the front of its string, and ``popped`` says how many
pieces that cuts. Matching reads each byte once: where the trie has no edge, popped counts are
added and links followed, and no piece is ever built.

A text's words are its maximal runs of bytes other than space and 0x09-0x0D; every word but one
that opens the text is matched with one space byte before it, as byte-level vocabularies store
word starts. A word that the vocabulary cannot cover counts as one unknown piece.

Results for odd rows: null, empty and word-less texts have 0 words and 0 pieces; doc_id may be
null or repeated and is passed through; other columns are ignored.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_chunks

CACHE_WORDS = 1 << 19
CACHE_LENGTH = 64

_automata: dict[str, LongestMatch] = {}


class LongestMatch:
    """Trie with failure links and popped-piece counts over a set of byte strings."""

    def __init__(self, pieces):
        edges: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in pieces:
            node = 0
            for b in piece:
                nxt = edges[node].get(b)
                if nxt is None:
                    nxt = edges[node][b] = len(edges)
                    edges.append({})
                    is_piece.append(False)
                node = nxt
            is_piece[node] = node > 0
        link, popped = [-1] * len(edges), [0] * len(edges)
        level = [0]
        while level:  # breadth first: links of shorter strings are ready
            below = []
            for u in level:
                for b, v in edges[u].items():
                    below.append(v)
                    if is_piece[v]:
                        link[v], popped[v] = 0, 1
                        continue
                    z, n = link[u], popped[u]
                    while z >= 0 and b not in edges[z]:
                        n += popped[z]
                        z = link[z]
                    if z >= 0:
                        link[v], popped[v] = edges[z][b], n
            level = below
        self.edges, self.link, self.popped = edges, link, popped
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of one word under greedy longest match; 1 if it cannot be covered."""
        edges, link, popped = self.edges, self.link, self.popped
        node = n = 0
        for b in word:
            nxt = edges[node].get(b)
            while nxt is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 1
                nxt = edges[node].get(b)
            node = nxt
        while node > 0:
            n += popped[node]
            node = link[node]
        return n if node == 0 else 1

    def count_words(self, words: list[bytes]) -> int:
        known, total = self.known, 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.count(w)
                if len(w) <= CACHE_LENGTH:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[w] = n
            total += n
        return total


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a ``.tiktoken`` file (base64 piece and rank on each line)."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def _automaton(path: str) -> LongestMatch:
    if path not in _automata:
        _automata[path] = LongestMatch(read_ranks(path))
    return _automata[path]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of ``docs(doc_id, text)``."""

    def run(batch: pa.RecordBatch):
        match = _automaton(vocabulary)
        for lo, hi in text_chunks(batch):
            part = batch.slice(lo, hi - lo)
            n_words, n_tokens = [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                n_words.append(len(words))
                if words:
                    opens = text.startswith(words[0])
                    words = [b" " + w for w in words]
                    if opens:
                        words[0] = words[0][1:]
                n_tokens.append(match.count_words(words))
            yield {"doc_id": part.column("doc_id"), "n_words": n_words, "n_tokens": n_tokens}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(run, "doc_id long, n_words long, n_tokens long", docs,
                       at_end=lambda: _automaton(vocabulary).known.clear())
