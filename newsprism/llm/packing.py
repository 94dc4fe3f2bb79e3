"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities (operator 6).

Each document becomes token ids plus one end id and is cut every ``capacity`` ids; a cut is never
made elsewhere. The pieces are dealt to randomised groups (a hash of the document, about
``group_pieces`` in each, so the number of groups follows the input) and every group is packed by
itself: pieces in descending length each go to the first bin that still has room. The bins'
remaining capacities are the leaves of a tournament tree whose inner nodes hold the larger of
their children, so the first fitting bin is found on one path from the root.

Results for odd rows: null and empty texts give one piece holding the end id alone; a null doc_id
is kept as null; repeated rows are packed as documents of their own; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stored, text_chunks

CAPACITY = 2048
END_ID = 1
GROUP_PIECES = 4096
TOGETHER = 64  # words encoded as one text
CACHE_WORDS = 1 << 19  # distinct words remembered by a worker
MARKS = ".,;:!?%&$#*|)]}\"-"
CACHE_LENGTH = 64  # longer words are encoded each time

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)

_encoders: dict[str, tuple] = {}


class Encoder:
    """Token ids of whole texts (little-endian uint32), word by word.

    Only for tokenizers that drop white space, and that cut letters and digits from marks before
    merging (as the registered one does): then no token reaches across a space, tab or line break,
    or from a letter to the marks behind it, case of ASCII letters does not matter, and the ids
    of a text are those of its words and their trailing marks, each encoded once and remembered.
    Marks are set apart only where the tokenizer does so itself: behind a character that it
    rewrites to end in something else than a letter or digit (such as the dot above of a
    lower-cased capital dotted I) the word stays whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {"": b""}
        self.apart: dict[str, bool] = {}

    def _cut_after(self, c: str) -> bool:
        """Whether the tokenizer cuts between ``c`` and a mark: it says so itself, for each character once."""
        if c.isascii():
            return c.isalnum()
        cut = self.apart.get(c)
        if cut is None:
            text = f"a{c}."
            if self.tokenizer.normalizer is not None:
                text = self.tokenizer.normalizer.normalize_str(text)
            words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
            alone = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(".")]
            cut = self.apart[c] = c.isalnum() and text.endswith(".") and words[-1:] == alone
        return cut

    def forget(self) -> None:
        """Empty the caches: at their bound, and when a task ends (its worker lives on)."""
        for kept in (self.known, self.stems):
            kept.clear()
            kept[""] = b""

    def _learn(self, words: list[str]) -> None:
        split = []
        for w in words:
            stem = w.rstrip(MARKS)
            if len(stem) == len(w) or not stem or not self._cut_after(stem[-1]):
                stem = w
            marks = w[len(stem) :]
            if stem.isascii() and stem.isalnum():
                stem = stem.lower()
            split.append((stem, marks))
        stems = self.stems
        new = [s for s in dict.fromkeys(x for pair in split for x in pair) if s not in stems]
        # words of letters are encoded many at a time: each gives one id that ends a word
        letters = [s for s in new if s.isalpha()]
        groups = [letters[lo : lo + TOGETHER] for lo in range(0, len(letters), TOGETHER)]
        for group, e in zip(groups, self._encoded([" ".join(g) for g in groups])):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group):  # else a word is not one run of letters to the tokenizer
                raw, at = ids.tobytes(), 0
                for s, end in zip(group, (4 * ends).tolist()):
                    stems[s] = raw[at:end]
                    at = end
        new = [s for s in new if s not in stems]
        for s, e in zip(new, self._encoded(new)):
            stems[s] = np.array(e.ids, "<u4").tobytes()
        for w, (stem, marks) in zip(words, split):
            self.known[w] = stems[stem] + stems[marks]

    def _encoded(self, texts: list[str]):
        for lo in range(0, len(texts), 1024):
            yield from self.tokenizer.encode_batch_fast(texts[lo : lo + 1024], add_special_tokens=False)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [
            (t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts
        ]
        if max(len(self.known), len(self.stems)) > CACHE_WORDS:
            self.forget()
        known = self.known
        new = [w for w in set().union(*split) if w not in known]
        self._learn(new)
        out = [b"".join([known[w] for w in ws]) for ws in split]
        for w in new:
            if len(w) > CACHE_LENGTH:
                del known[w]
                self.stems.pop(w, None)
        return out


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch):
        for lo, hi in text_chunks(batch):
            part = batch.slice(lo, hi - lo)
            out = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            encoded = _encoder(tokenizer).encode(part.column("text").to_pylist())
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoded):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    out["doc_id"].append(doc)
                    out["start"].append(start)
                    out["length"].append(len(piece) // 4)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(n)
                    out["ids"].append(piece if with_ids else None)
            yield out

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(run, PIECE, docs, at_end=lambda: _encoder(tokenizer).forget())


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each piece; pieces of equal length keep their order."""
    n = len(lengths)
    leaves = 1
    while leaves < n:
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def pack(
    spark: SparkSession,
    docs: DataFrame,
    *,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece with its sequence and place; ``with_ids`` adds the ids themselves."""
    cut = stored(spark, pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    cut = cut.withColumn(
        "grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(groups))
    )

    def fill(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        sequence = pa.array(bins + (key[0].as_py() << 32), pa.int64())
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        return pa.table(
            [table.column(c) for c in names] + [sequence, pa.array(offsets), table.column("ids")],
            names=[*names, "sequence_id", "offset", "ids"],
        )

    out = cut.groupBy("grp").applyInArrow(fill, PACKED)
    return out if with_ids else out.drop("ids")
