"""N-gram Jaccard join by multiple-global-order prefix filtering (operator 7).

Documents are sets of word shingles. Two sets with Jaccard similarity >= t share, under any global
order of the tokens, at least one token among the first ``n - ceil(t n) + 1`` of each. Candidates
must pass that filter under two orders (rarest first by exact document frequency; and a random
permutation, tokens of one document alone first) before their sets are compared.

Plan:

1. one pass over the texts gives each document's set size and 128-bit set digest (stored). Equal
   sets form a class, represented by its smallest doc_id, so copies are compared once.
2. a second pass sends (token, document) entries, packed as arrays, to token partitions (their
   number follows the number of tokens), which count document frequencies and answer only with
   tokens that two or more documents share. Tokens held by a fixed fraction of all documents
   (at most ``HOT_SHARE`` times the mean set size of them exist) are recognised in pass 1 and go
   straight to the documents, so no token's entries gather in one task.
3. shared tokens are renamed to their places in their partition, which pack well. Documents whose
   shared tokens reach t of their set remain (an ordinary document has few), later copies of a
   class are left out there; the prefixes of the others meet by token.
4. links: every document is first compared with a few pivots of some of its prefix tokens, and
   links merge into components. Then the prefix lists are looked at whole: tokens with the very same
   list (those of one passage) count once, by the first of them in the order, and lists within one component
   not at all. A list, cut into parts that meet pairwise if it is long, puts out the pairs of different
   components that pass the length filter, the position filter (what follows the shared token must
   suffice for the overlap) and the sketch filter: a sketch has the parity of a set's tokens in each of
   a few bits a token, and two sets differ in at least as many tokens as their sketches in bits.
5. a candidate pair goes to the task of its one end, which is dealt by the smallest of its partners:
   near copies have the same partners and meet in one task, so a document's tokens go to its own
   task and, where it is a partner, once to each task that names it. Large groups are split by hash.
   There the second order's prefixes must meet, too, before the sets are compared. Every pair that
   the filters admit is compared unless its ends are already connected, so components are exact.

Results for odd rows: null, empty and word-less texts have the empty set and link with nothing;
a null doc_id links with nothing and has a null component; repeated rows give repeated result
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, text_bytes, text_chunks
from .graph import components
from .words import mix, shingle_sets

BLOCK_BYTES = 8 << 20  # text of one packed block
PART_TOKENS = 2_000_000  # tokens of one token partition
PART_DOCS = 5_000  # documents of one document partition
HOT_SHARE = 1_000  # a token in more than 1/HOT_SHARE of all documents is hot
PIVOTS = 2  # documents of a token's list that the others are compared with first
LIST_DOCS = 4_096  # documents of a part of a list
TASK_ROWS = 100_000  # list entries in a task, about
GROUP_DOCS = 1_000  # documents with one smallest partner that are compared together
TASK_TOKENS = 2_000_000  # tokens sent to a comparing task, about
TASK_PAIRS = 50_000  # and pairs
SKETCH_BITS = (512, 32_768)  # of a document's sketch, at least and at most; between, 4 to 8 a token
TASK_SKETCHES = 64 << 20  # bytes of sketches sent to a task, about

DOC_ROWS = "doc_id long, n_shingles long, d1 long, d2 long, token long, held long"
PACKED = "kind int, part int, docs binary, sizes binary, runs binary, lo binary, mid binary, df binary"
_ARROW_DOC = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_shingles", "d1", "d2", "token", "held")])
_ARROW_PACKED = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32())]
    + [(c, pa.binary()) for c in ("docs", "sizes", "runs", "lo", "mid", "df")]
)
SETS = "id long, n long, m int, q int, toks binary, head array<long>, sketch binary"
_ARROW_SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("m", pa.int32()), ("q", pa.int32()),
                         ("toks", pa.binary()), ("head", pa.list_(pa.int64())), ("sketch", pa.binary())])
_ODD = 0x6A09E667F3BCC909  # the sketch's bits are independent of the second order
_LOW48 = np.uint64((1 << 48) - 1)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _blocks(batches: Iterator[pa.RecordBatch], n: int):
    """(ids, tokens, offsets) of about BLOCK_BYTES of text at a time; ids is a pyarrow array."""
    ids, toks, counts, size = [], [], [], 0

    def block():
        return (
            pa.concat_arrays(ids),
            np.concatenate(toks),
            np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64),
        )

    for batch in batches:
        for lo, hi in text_chunks(batch):
            part = batch.slice(lo, hi - lo)
            data, offsets = text_bytes(part.column("text"))
            value, at = shingle_sets(data, offsets, n)
            ids.append(part.column("doc_id").cast(pa.int64()))
            toks.append(value)
            counts.append(np.diff(at))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield block()
                ids, toks, counts, size = [], [], [], 0
    if ids:
        yield block()


def _first_copies(ids: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a block to send: of rows with equal sets only the smallest id; no empty set."""
    best: dict[tuple[int, int], int] = {}
    for i in np.flatnonzero(np.diff(at)).tolist():
        key = _digest(tokens[at[i] : at[i + 1]])
        if key not in best or ids[i] < ids[best[key]]:
            best[key] = i
    return np.array(sorted(best.values()), np.int64)


def _gather(tokens: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of some rows, and for each the place of its row in ``rows``."""
    count = np.diff(at)[rows]
    place = np.repeat(np.arange(len(rows)), count)
    start = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return tokens[start + np.arange(len(place))], place


def document_sets(spark: SparkSession, docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, n_shingles, d1, d2) of each document, and rows (token, held) of tokens
    that occur in many documents of a block (held: in how many)."""

    def run(batches):
        for ids, tokens, at in _blocks(batches, n):
            digests = [_digest(tokens[at[i] : at[i + 1]]) for i in range(len(ids))]
            valid = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            rows = valid[_first_copies(np.asarray(ids.take(pa.array(valid))), *_rows_of(tokens, at, valid))]
            sent, _ = _gather(tokens, at, rows)
            value, held = np.unique(sent, return_counts=True)
            many = held >= max(8, len(rows) // HOT_SHARE)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(at)), pa.array([d[0] for d in digests], pa.int64()),
                 pa.array([d[1] for d in digests], pa.int64()), none, none], schema=_ARROW_DOC)
            if many.any():
                none = pa.nulls(int(many.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, none, none, pa.array(value[many].view(np.int64)),
                     pa.array(held[many].astype(np.int64))], schema=_ARROW_DOC)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DOC_ROWS)
    return stored(spark, out, "sets")


def _rows_of(tokens: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(rows) == len(at) - 1:
        return tokens, at
    sent, _ = _gather(tokens, at, rows)
    return sent, np.concatenate([[0], np.cumsum(np.diff(at)[rows])]).astype(np.int64)


def _pack(kind: int, part: np.ndarray, doc: np.ndarray, size: np.ndarray, token: np.ndarray,
          df: np.ndarray | None) -> pa.RecordBatch:
    """One row per part: its documents (id, set size, run length) and their tokens in order."""
    order = np.argsort(part, kind="stable")
    part, doc, size, token = part[order], doc[order], size[order], token[order]
    first = np.ones(len(part), bool)
    first[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(first)
    length = np.diff(np.append(run, len(part))).astype(np.uint32)
    parts, token_at = np.unique(part, return_index=True)
    run_at = np.searchsorted(run, token_at)
    token_at, run_at = np.append(token_at, len(part)), np.append(run_at, len(run))
    rd, rs = doc[run].astype(np.int64), size[run].astype(np.uint32)
    lo, mid = token.astype(np.uint32), ((token & _LOW48) >> np.uint64(32)).astype(np.uint16)
    cols: list[list] = [[] for _ in range(6)]
    full = token if kind else None
    for k in range(len(parts)):
        a, b, c, d = token_at[k], token_at[k + 1], run_at[k], run_at[k + 1]
        cols[0].append(planes(rd[c:d]))
        cols[1].append(planes(rs[c:d]))
        cols[2].append(planes(length[c:d]))
        cols[3].append(planes(full[a:b]) if kind else lo[a:b].tobytes())
        cols[4].append(b"" if kind else mid[a:b].tobytes())
        cols[5].append(planes(df[order[a:b]].astype(np.uint32)) if kind else b"")
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(parts), kind, np.int32)), pa.array(parts.astype(np.int32))]
        + [pa.array(c, pa.binary()) for c in cols], schema=_ARROW_PACKED)


def planes(x: np.ndarray) -> bytes:
    """An integer array byte by byte: all first bytes, all second bytes and so on. The upper bytes
    are mostly zero, and in this order the shuffle's compression removes them."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(b: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _joined(table: pa.Table, column: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype=dtype)


def _joined_planes(table: pa.Table, column: str, dtype) -> np.ndarray:
    parts = [_from_planes(b, dtype) for b in table.column(column).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    runs = _joined_planes(table, "runs", np.uint32)
    return (np.repeat(_joined_planes(table, "docs", np.int64), runs),
            np.repeat(_joined_planes(table, "sizes", np.uint32), runs), runs)


def _doc_part(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def token_part(t: np.ndarray, parts: int) -> np.ndarray:
    return (((t >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)


def token_name(t: np.ndarray, part) -> np.ndarray:
    """What is left of a token once it is packed: its low bits and its partition."""
    return (t & _LOW48) | ((np.asarray(part).astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(48))


def token_place(place: np.ndarray, part) -> np.ndarray:
    """A shared token's name by its place among the shared tokens of its partition."""
    return place.astype(np.uint64) | (np.asarray(part).astype(np.uint64) << np.uint64(32))


def shared_only(key, table: pa.Table, doc_parts: int, places: bool = False) -> pa.Table:
    """Of a token partition's entries those of tokens in two or more documents, dealt to document
    partitions, with the document frequency; entries that are on their way there pass through.
    ``places``: tokens are named by their places."""
    if key[0].as_py() == 1:
        return table
    doc, size, _ = _unpack(table)
    token = _joined(table, "lo", np.uint32).astype(np.uint64)
    token |= _joined(table, "mid", np.uint16).astype(np.uint64) << np.uint64(32)
    order = np.lexsort((doc, token))
    doc, size, token = doc[order], size[order], token[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    doc, size, token = doc[new], size[new], token[new]
    edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    count = np.diff(edge)
    df = np.repeat(count, count)
    del order, new, edge, count
    keep = df > 1
    if not keep.any():
        return table.slice(0, 0)
    token, doc, size, df = token[keep], doc[keep], size[keep], df[keep]
    if places:
        token = token_place(np.cumsum(np.append(False, token[1:] != token[:-1])), key[1].as_py())
    else:
        token = token_name(token, key[1].as_py())
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    return pa.Table.from_batches(
        [_pack(1, _doc_part(doc, doc_parts), doc, size[order], token[order], df[order])])


def hot_tokens(spark: SparkSession, held: DataFrame, count: int):
    """Broadcast (tokens, frequencies) of the tokens in more than 1/HOT_SHARE of the documents; at
    most HOT_SHARE times the mean set size of them exist."""
    hot = (
        held.groupBy("token").agg(F.sum("held").alias("df"))
        .where(F.col("df") > max(64, count // HOT_SHARE))
    ).toPandas()
    token = hot["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return spark.sparkContext.broadcast((token[order], hot["df"].to_numpy(np.int64)[order]))


def is_in(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each of ``x`` is in the sorted values, its place there)."""
    if not len(sorted_values):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x, at


def sketch(toks: np.ndarray) -> np.ndarray:
    """Parity of the tokens in each of a power of two of bits; folding halves onto each other gives
    the sketch of fewer bits."""
    least, most = SKETCH_BITS
    bits = min(most, max(least, 1 << (4 * len(toks) - 1).bit_length()))
    count = np.bincount((mix(toks ^ np.uint64(_ODD)) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def shared_tokens(
    spark: SparkSession, docs: DataFrame, sets: DataFrame, copies: DataFrame, n: int, num: int, den: int
) -> DataFrame:
    """(id, n, m, q, toks, head, sketch) of documents whose shared tokens reach num/den of their set,
    but not of ``copies(id)``.

    toks: the m tokens in two or more documents, rarest first, byte by byte; q: how many of them are
    in the prefix (tokens of one document alone come before them in either order); head: these.
    """
    total, count = sets.agg(F.sum("n_shingles"), F.count("n_shingles")).first()
    if not total:
        return spark.createDataFrame([], SETS)
    parts = max(16, -(-total // PART_TOKENS))
    doc_parts = max(16, -(-count // PART_DOCS))
    hot_all = hot_tokens(spark, sets.where("token is not null"), count)

    def send(batches):
        hot_t, hot_df = hot_all.value
        for ids, tokens, at in _blocks(batches, n):
            valid = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            own = np.asarray(ids.take(pa.array(valid))).astype(np.int64)
            tokens, at = _rows_of(tokens, at, valid)
            rows = _first_copies(own, tokens, at)
            sent, place = _gather(tokens, at, rows)
            if not len(sent):
                continue
            doc, size = own[rows][place], np.diff(at)[rows][place]
            part = token_part(sent, parts)
            is_hot, where = is_in(hot_t, sent)
            if is_hot.any():
                yield _pack(1, _doc_part(doc[is_hot], doc_parts), doc[is_hot], size[is_hot],
                            token_place(where[is_hot], parts), hot_df[where[is_hot]])
            cold = ~is_hot
            if cold.any():
                yield _pack(0, part[cold], doc[cold], size[cold], sent[cold], None)

    def counted(key, table):
        return shared_only(key, table, doc_parts, places=True)

    def send_copies(batches):
        for batch in batches:
            doc = batch.column("id").to_numpy()
            part = _doc_part(doc, doc_parts)
            order = np.argsort(part, kind="stable")
            found, at = np.unique(part[order], return_index=True)
            cut = np.split(doc[order], at[1:]) if len(found) else []
            none = pa.array([b""] * len(found), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), 2, np.int32)), pa.array(found.astype(np.int32)),
                 pa.array([planes(d) for d in cut], pa.binary())] + [none] * 5, schema=_ARROW_PACKED)

    def collected(key, table):
        is_copy = pc.equal(table.column("kind"), 2)
        later = _joined_planes(table.filter(is_copy), "docs", np.int64)
        table = table.filter(pc.invert(is_copy))
        doc, size, _ = _unpack(table)
        token, df = _joined_planes(table, "lo", np.uint64), _joined_planes(table, "df", np.uint32)
        order = np.lexsort((token, df, doc))
        doc, size, token, df = doc[order], size[order], token[order], df[order]
        ids, first, count = np.unique(doc, return_index=True, return_counts=True)
        need = -(-size[first].astype(np.int64) * num // den)
        out = {c: [] for c in _ARROW_SETS.names}
        for k in np.flatnonzero((count >= need) & ~np.isin(ids, later)).tolist():
            toks = token[first[k] : first[k] + count[k]]
            q = int(count[k] - need[k] + 1)
            out["id"].append(int(ids[k]))
            out["n"].append(int(size[first[k]]))
            out["m"].append(len(toks))
            out["q"].append(q)
            out["toks"].append(planes(toks))
            out["head"].append(toks[:q].view(np.int64))
            out["sketch"].append(sketch(toks).tobytes())
        return pa.table([pa.array(out[f.name], f.type) for f in _ARROW_SETS], schema=_ARROW_SETS)

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(send, PACKED)
    answers = packed.groupBy("kind", "part").applyInArrow(counted, PACKED)
    answers = answers.unionByName(copies.select("id").mapInArrow(send_copies, PACKED))
    return answers.groupBy("part").applyInArrow(collected, SETS)


class _Set:
    """A document in a comparing task; the sets are made when first needed."""

    def __init__(self, n: int, q: int, toks: np.ndarray):
        self.n, self.q, self.toks = n, q, toks

    def __getattr__(self, name: str):
        if name == "first":
            value = set(self.toks[: self.q].tolist())
        elif name == "second":  # the first tokens under the other order, a random permutation
            order = np.argsort(mix(self.toks), kind="stable")
            value = set(self.toks[order[: self.q]].tolist())
        elif name == "all":
            value = set(self.toks.tolist())
        else:
            raise AttributeError(name)
        setattr(self, name, value)
        return value


def similar(x: _Set, y: _Set, num: int, den: int) -> bool:
    """Length filter, both prefix filters, then the sets themselves."""
    if den * min(x.n, y.n) < num * max(x.n, y.n) or x.first.isdisjoint(y.first) or x.second.isdisjoint(y.second):
        return False
    common = len(x.all & y.all)
    return den * common >= num * (x.n + y.n - common)


def compared(spark: SparkSession, s: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among distinct ``pairs(a, b, ca, cb)`` of documents with components: of two
    components one link is enough in a task."""
    pairs = stored(spark, pairs, "pairs")
    docs, tokens = s.agg(F.count("*"), F.sum("m")).first()
    count = pairs.count()
    sent = 2 * count * (tokens or 0) // max(1, docs)  # if no document had two pairs in a task
    tasks = max(1, -(-sent // TASK_TOKENS), -(-count // TASK_PAIRS))
    label = pairs.groupBy("b").agg(F.min("a").alias("label"))
    parts = label.groupBy("label").agg(F.ceil(F.count("*") / GROUP_DOCS).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("b", F.lit(5)), F.coalesce("parts", F.lit(1)))
    dealt = pairs.join(label, "b").join(parts, "label", "left").withColumn("cell", F.xxhash64("label", part))
    dealt = dealt.withColumn("task", F.pmod("cell", F.lit(tasks)).cast("int")).drop("label", "parts")
    dealt = stored(spark, dealt, "dealt")
    ends = dealt.select("task", F.col("a").alias("id")).unionByName(dealt.select("task", F.col("b").alias("id")))
    sets = ends.distinct().join(s, "id").select("task", "id", "n", "q", "toks")
    rows = sets.unionByName(dealt, allowMissingColumns=True)

    def check(key, table):
        held = table.filter(pc.is_valid(table.column("id")))
        doc, n, q = (held.column(c).to_numpy() for c in ("id", "n", "q"))
        toks = held.column("toks")
        place = {int(d): k for k, d in enumerate(doc)}
        pairs = table.filter(pc.is_null(table.column("id"))).select(["a", "b", "ca", "cb", "cell"]).sort_by("cell")
        linked: set[tuple[int, int]] = set()
        a, b, own, now = [], [], {}, None

        def made(d):
            if d not in own:
                k = place[d]
                own[d] = _Set(int(n[k]), int(q[k]), _from_planes(toks[k].as_py(), np.uint64))
            return own[d]

        for x, y, cx, cy, cell in zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "ca", "cb", "cell"))):
            if cell != now:  # the sets of one group at a time
                own, now = {}, cell
            if (cx, cy) not in linked and similar(made(x), made(y), num, den):
                linked |= {(cx, cy), (cy, cx)}
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return stored(spark, rows.groupBy("task").applyInArrow(check, "a long, b long"), "links")


class Sketches:
    """Sketches of the documents of a list, as wide as each pair has them."""

    def __init__(self, own: list[np.ndarray]):
        self.words = np.array([len(x) for x in own], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by width: place of a document, sketches
        above, upper = np.zeros(0, np.int64), None
        width = int(self.words.max())
        while width >= self.words.min():
            here = np.flatnonzero(self.words == width)
            rows = np.array([own[k] for k in here.tolist()], np.uint64).reshape(len(here), width)
            if upper is not None:
                rows = np.concatenate([rows, upper[:, :width] ^ upper[:, width:]])
            above, upper = np.concatenate([here, above]), rows
            place = np.full(len(own), -1)
            place[above] = np.arange(len(above))
            self.folded[width] = place, rows
            width //= 2

    def differing(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """For pairs (u, v) of places in the list, a lower bound of the tokens in which they differ."""
        out = np.zeros(len(u), np.int64)
        width = np.minimum(self.words[u], self.words[v])
        for w in np.unique(width).tolist():
            place, rows = self.folded[w]
            at = np.flatnonzero(width == w)
            for k in range(0, len(at), max(1, (1 << 20) // w)):
                some = at[k : k + max(1, (1 << 20) // w)]
                x = rows[place[u[some]]] ^ rows[place[v[some]]]
                out[some] = np.bitwise_count(x).sum(1, dtype=np.int64)
        return out


def listed_pairs(ids, comp, n, rest, part, m, sketches: Sketches, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one list, or of two parts of it (``part`` 0 and 1; else all 2), of different components
    that pass the length, position and sketch filters. ``rest``: tokens from the shared one to the end."""
    order = np.lexsort((ids, n))
    ids, comp, n, rest, part, m = ids[order], comp[order], n[order], rest[order], part[order], m[order]
    # every pair has an end outside the largest component
    name, first = np.unique(comp, return_inverse=True)
    left = np.flatnonzero(first != np.bincount(first).argmax())
    inner = np.zeros(len(ids), bool)
    inner[left] = True
    us, vs = [], []
    for lo in range(0, len(left), 128):
        x = left[lo : lo + 128]
        # sorted by size: partners stand in a range
        a = int(np.searchsorted(n, -(-num * n[x[0]] // den)))
        b = int(np.searchsorted(n, den * n[x[-1]] // num, "right"))
        for c in range(a, b, 4096):
            y = np.arange(c, min(c + 4096, b))
            nx, ny = n[x][:, None], n[y][None, :]
            ok = (comp[x][:, None] != comp[y][None, :]) & (den * np.minimum(nx, ny) >= num * np.maximum(nx, ny))
            ok &= (num + den) * np.minimum(rest[x][:, None], rest[y][None, :]) >= num * (nx + ny)
            ok &= ~inner[y][None, :] | (x[:, None] < y[None, :])  # a pair of two such ends once
            ok &= (part[x][:, None] != part[y][None, :]) | (part[x][:, None] == 2)
            i, j = np.nonzero(ok)
            u, v = x[i], y[j]
            common = m[u] + m[v] - sketches.differing(order[u], order[v])  # twice, at most
            ok = (num + den) * common >= 2 * num * (n[u] + n[v])
            us.append(u[ok])
            vs.append(v[ok])
    u, v = (np.concatenate(w) if w else np.zeros(0, np.int64) for w in (us, vs))
    return ids[u], ids[v]


def candidates(spark: SparkSession, s: DataFrame, named: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b, ca, cb), a < b, of documents in different components that meet in a
    prefix list and pass its filters. ``s``: id, m, sketch; ``named``: id, t, n, rest, c."""
    about = named.groupBy("t").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("id", F.lit(3))).alias("x1"),
        F.bit_xor(F.xxhash64("id", F.lit(4))).alias("x2"), F.min("c").alias("lo"), F.max("c").alias("hi"),
        F.sum("rest").alias("after"))
    # the first in the order has the most tokens after it, in each of its documents
    lists = about.where("lo <> hi").groupBy("size", "x1", "x2").agg(F.max_by("t", "after").alias("t"))
    lists = stored(spark, lists.select(
        "t", F.ceil(F.col("size") / LIST_DOCS).cast("int").alias("parts"), "size"), "lists")
    total = lists.agg(F.sum(F.col("size") * F.col("parts"))).first()[0] or 0
    own = F.pmod(F.xxhash64("id", F.lit(6)), F.col("parts")).cast("int")
    # a part of a long list meets itself and every other part
    rows = named.join(lists.drop("size"), "t").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("t", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "rest", "c")
    wide = s.agg(F.avg(F.length("sketch"))).first()[0] or 0
    tasks = max(1, -(-total // TASK_ROWS), -(-total * int(wide) // TASK_SKETCHES))
    rows = rows.withColumn("task", F.pmod(F.xxhash64("t", "i", "j"), F.lit(tasks)).cast("int"))
    rows = stored(spark, rows, "entries")
    drawn = rows.select("task", "id").distinct().join(s.select("id", "m", "sketch"), "id")
    rows = rows.unionByName(drawn, allowMissingColumns=True)

    def meet(key, table):
        is_own = pc.is_valid(table.column("sketch"))
        sent, table = table.filter(is_own), table.filter(pc.invert(is_own))
        holder, size, drawn = sent.column("id").to_numpy(), sent.column("m").to_numpy().astype(np.int64), sent.column("sketch")
        by_id = np.argsort(holder, kind="stable")
        holder = holder[by_id]
        t, i, j, own, ids, n, rest, c = (table.column(x).to_numpy() for x in ("t", "i", "j", "own", "id", "n", "rest", "c"))
        order = np.lexsort((j, i, t))
        cut = np.flatnonzero(np.any([np.diff(x[order]) != 0 for x in (t, i, j)], axis=0)) + 1
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in np.split(order, cut):
            if (c[g] == c[g[0]]).all():
                continue
            part = np.where(i[g] == j[g], 2, (own[g] == i[g]).astype(np.int64))
            of = by_id[np.searchsorted(holder, ids[g])]
            sketches = Sketches([np.frombuffer(drawn[k].as_py(), np.uint64) for k in of.tolist()])
            u, v = listed_pairs(ids[g], c[g], n[g], rest[g], part, size[of], sketches, num, den)
            us.append(np.minimum(u, v))
            vs.append(np.maximum(u, v))
        u, v = np.concatenate(us), np.concatenate(vs)
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        u, v = u[new], v[new]
        at = np.argsort(ids, kind="stable")
        comp = lambda x: c[at[np.searchsorted(ids[at], x)]]
        return pa.table({"a": u, "b": v, "ca": comp(u), "cb": comp(v)})

    schema = "a long, b long, ca long, cb long"
    return rows.groupBy("task").applyInArrow(meet, schema).distinct()


def jaccard_links(spark: SparkSession, s: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect exactly the documents connected by pairs of similarity >= num/den."""
    post = stored(spark, s.select(
        "id", "n", "q", "m", F.posexplode("head").alias("k", "t"),
    ).select("id", "n", "t", (F.col("m") - F.col("k")).cast("long").alias("rest"),
             ((F.col("k") < 8) | (F.col("q") - F.col("k") <= 2)).alias("few")), "postings")
    # every document against a few pivots of some of its tokens
    few = post.where("few")
    slot = F.pmod(F.xxhash64("id", F.lit(0)), F.lit(PIVOTS)).alias("slot")
    pivots = few.groupBy("t", slot).agg(
        F.min(F.struct(F.xxhash64("id", F.lit(1)), F.col("id").alias("key"), F.col("n").alias("m"))).alias("p"))
    pivots = stored(spark, pivots.select("t", "p.key", "p.m"), "pivots")
    pairs = few.join(pivots, "t").where(
        (F.col("id") != F.col("key")) & (den * F.least("n", "m") >= num * F.greatest("n", "m"))
    ).select(F.col("key").alias("a"), F.col("id").alias("b")).distinct()
    links = compared(spark, s, pairs.withColumn("ca", F.col("a")).withColumn("cb", F.col("b")), num, den)
    comp = stored(spark, components(spark, links), "components")
    # then the prefix lists, without the pairs that are connected already
    named = stored(spark, post.select("id", "t", "n", "rest").join(comp, post.id == comp.node, "left").select(
        "id", "t", "n", "rest", F.coalesce("component_id", "id").alias("c")), "named")
    return links.unionByName(compared(spark, s, candidates(spark, s, named, num, den), num, den))


def jaccard_components(
    spark: SparkSession, docs: DataFrame, *, n: int = 5, num: int = 75, den: int = 100
) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row of ``docs(doc_id, text)``."""
    sets = document_sets(spark, docs, n)
    rows = sets.where("token is null").select("doc_id", "n_shingles", "d1", "d2")
    classes = (
        rows.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    )
    classes = stored(spark, classes.where("copies > 1").select("d1", "d2", "class_id"), "classes")
    copies = rows.join(classes, ["d1", "d2"]).where("doc_id <> class_id").select(F.col("doc_id").alias("id"))
    s = stored(spark, shared_tokens(spark, docs, sets, copies, n, num, den), "candidates")
    comp = components(spark, jaccard_links(spark, s, num, den))
    comp = stored(spark, comp, "components")
    member = rows.join(classes, ["d1", "d2"], "left").withColumn(
        "class_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(),
                           F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")))
    out = member.join(comp, member.class_id == comp.node, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "class_id").alias("component_id"), "class_id")


def keep_one(spark: SparkSession, docs: DataFrame, *, n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest
    doc_id, and one row of those that share it. Rows with a null doc_id all stay."""
    groups = jaccard_components(spark, docs, n=n, num=num, den=den)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = stored(spark, gone, "gone")
    kept = docs.join(gone, docs.doc_id == gone.gone_id, "left_anti")
    repeated = stored(
        spark, groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
        .select(F.col("doc_id").alias("repeated_id")), "repeated")
    if repeated.isEmpty():
        return kept
    several = kept.join(repeated, kept.doc_id == repeated.repeated_id, "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, kept.doc_id == repeated.repeated_id, "left_anti").unionByName(several)
