"""Repeated substrings across documents, by suffix arrays (operator 3).

A byte is removed when it lies in a string of ``length`` bytes that also starts in a document with
a smaller doc_id. Equal strings must meet, and nothing else has to: every string of ``length``
bytes is keyed by the smallest hash among its ``KEY``-byte substrings (equal strings have equal
keys), and a document is cut into fragments, its maximal runs of strings with one key.

1. One pass gives each document's size and digest. Copies of a whole document need no comparing:
   only the one with the smallest id goes on.
2. A second pass sends (key, document) entries, packed as arrays, to key partitions, which answer
   with the keys that two or more documents share.
3. Only documents with shared keys go on, and only their fragments with shared keys are sent, each
   distinct fragment of a block once, with its smallest document in the block (a later document of
   the block loses the fragment at once). For every key the distinct fragments that meet are joined
   into one text and its suffix array is built by linear grouping (:mod:`.suffix_array`); suffixes
   that agree in ``length`` bytes are neighbours there, and each such group of strings has its
   smallest document. A lone fragment needs no sorting, nor does a key all of whose fragments stand in
   one document; of the others only the part from a fragment's first to its last string that, by its
   hash, another fragment has, and equal parts once. A key in more than a fixed share of all documents, or in more than ``SPLIT_DOCS``
   of them, is split: its strings are keyed by themselves.
4. The removed intervals return to their documents, where they are merged and the remaining bytes
   are hashed. Strings are always judged on the input.

Results for odd rows: null and empty texts have 0 bytes and the digest of nothing; a null doc_id
is neither a source nor cut; repeated rows (equal doc_id) do not cut each other and give repeated
results, and rows of one doc_id with different texts are each cut for themselves; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, stored, text_bytes, text_chunks
from .ngram_join import (
    HOT_SHARE, PACKED, PART_DOCS, _doc_part, _joined, _joined_planes, _pack, _unpack,
    hot_tokens, is_in, shared_only, token_name, token_part,
)
from .suffix_array import suffix_array
from .words import mix, powers

LENGTH = 50
KEY = 20
BLOCK_BYTES = 4 << 20
PART_KEYS = 500_000  # keys of one key partition
SPLIT_DOCS = 20_000  # documents whose fragments with one key may meet whole
SORT_BYTES = 1 << 14  # fragments sorted in one suffix array, at least
RANGE_BYTES = 1 << 18  # fragments whose strings are hashed together, at least
FRAGMENT_BYTES = 1 << 20  # fragment bytes of one partition, about

_EXACT = np.random.default_rng(30).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

DOC_ROWS = "doc_id long, n_bytes long, sha string, keys long, token long, held long"
_ARROW_DOC = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()),
                        ("keys", pa.int64()), ("token", pa.int64()), ("held", pa.int64())])
FRAGMENTS = "kind int, part int, names binary, sizes binary, bytes binary, frag binary, docs binary, rows binary, starts binary"
_ARROW_FRAGMENTS = pa.schema([("kind", pa.int32()), ("part", pa.int32())] + [
    (c, pa.binary()) for c in ("names", "sizes", "bytes", "frag", "docs", "rows", "starts")])


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(key, document, start, end) of each fragment: strings start..end-length of a document have
    this key. Starts and ends are places in ``data``."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none.astype(np.uint64), none, none, none
    p, q = powers(n)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(_EXACT[data] * p[:n], out=acc[1:])
    h = mix((acc[KEY:] - acc[:-KEY]) * q[: n - KEY + 1])
    width, reach = length - KEY + 1, 1
    low = h
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    # strings must end in their document
    size = np.diff(offsets)
    valid = np.zeros(n + 1, np.int64)
    has = size >= length
    np.add.at(valid, offsets[:-1][has], 1)
    np.add.at(valid, offsets[1:][has] - length + 1, -1)
    valid = np.cumsum(valid)[: len(low)] > 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    starts_doc = np.zeros(n + 1, bool)
    starts_doc[offsets[:-1]] = True
    begins |= valid & starts_doc[: len(low)]
    start = np.flatnonzero(begins)
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | begins[1:]
    end = np.flatnonzero(ends) + length
    return low[start], np.searchsorted(offsets, start, "right") - 1, start, end


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Lists of (slice of a batch, its bytes and offsets) of about BLOCK_BYTES; the text is in
    column ``text`` or, compressed, in ``z`` with its length in ``size``."""
    out, size = [], 0
    for batch in batches:
        packed = "z" in batch.schema.names
        if packed:
            sizes = batch.column("size").to_numpy()
            cut = np.searchsorted(np.cumsum(sizes), np.arange(1, sizes.sum() // CHUNK_BYTES + 2) * CHUNK_BYTES, "right")
            edges = np.unique(np.concatenate([[0], cut, [len(sizes)]])).tolist()
            ranges = list(zip(edges[:-1], edges[1:]))
        else:
            ranges = text_chunks(batch)
        for lo, hi in ranges:
            part = batch.slice(lo, hi - lo)
            if packed:
                raw = b"".join(_unpacked(z, n) for z, n in zip(part.column("z").to_pylist(), sizes[lo:hi].tolist()))
                data = np.frombuffer(raw, np.uint8)
                offsets = np.concatenate([[0], np.cumsum(sizes[lo:hi])]).astype(np.int64)
            else:
                data, offsets = text_bytes(part.column("text"))
            out.append((part, data, offsets))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield out
                out, size = [], 0
    if out:
        yield out


def document_rows(spark: SparkSession, docs: DataFrame, length: int) -> DataFrame:
    """Rows (doc_id, n_bytes, sha, keys) of each document, and rows (token, held) of keys that many
    documents of a block hold."""

    def run(batches):
        for block in _blocks(batches):
            seen = []
            for part, data, offsets in block:
                raw, at = data.tobytes(), offsets.tolist()
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
                key, doc, _, _ = runs(data, offsets, length)
                none = pa.nulls(len(part), pa.int64())
                keys = np.bincount(doc, minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(sha), pa.array(keys), none, none],
                    schema=_ARROW_DOC)
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                seen.append(key[new])
            value, held = np.unique(np.concatenate(seen), return_counts=True)
            n = sum(len(part) for part, _, _ in block)
            many = held >= max(8, n // HOT_SHARE)
            if many.any():
                none = pa.nulls(int(many.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, pa.nulls(len(none), pa.string()), none, pa.array(value[many].view(np.int64)),
                     pa.array(held[many].astype(np.int64))], schema=_ARROW_DOC)

    return stored(spark, docs.mapInArrow(run, DOC_ROWS), "documents")


def shared_keys(spark: SparkSession, docs: DataFrame, rows: DataFrame, length: int, parts: int, doc_parts: int, hot_all):
    """(doc_id, anchors, split): the sorted names of a document's keys that other documents share, and
    those of them that more than SPLIT_DOCS documents hold."""

    def send(batches):
        hot, _ = hot_all.value
        for block in _blocks(batches):
            keys, docs_ = [], []
            first: dict[bytes, int] = {}
            for part, data, offsets in block:
                ids = part.column("doc_id")
                key, doc, _, _ = runs(data, offsets, length)
                own = np.asarray(ids.fill_null(-1)).astype(np.int64)
                # one copy of a document is enough to tell which keys are shared: the smallest id
                raw, at = data.tobytes(), offsets.tolist()
                use = np.asarray(ids.is_valid())
                for i in np.flatnonzero(use).tolist():
                    d = hashlib.blake2b(raw[at[i] : at[i + 1]], digest_size=16).digest()
                    if first.setdefault(d, own[i]) < own[i]:
                        use[i] = False
                    else:
                        first[d] = own[i]
                ok = use[doc]
                keys.append(key[ok])
                docs_.append(own[doc[ok]])
            key, doc = np.concatenate(keys), np.concatenate(docs_)
            if not len(key):
                continue
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[new], doc[new]
            part = token_part(key, parts)
            one = np.ones(len(key), np.int64)
            is_hot, _ = is_in(hot, key)
            if is_hot.any():
                yield _pack(1, _doc_part(doc[is_hot], doc_parts), doc[is_hot], one[is_hot],
                            token_name(key[is_hot], part[is_hot]), one[is_hot])
            if not is_hot.all():
                c = ~is_hot
                yield _pack(0, part[c], doc[c], one[c], key[c], None)

    def counted(key, table):
        return shared_only(key, table, doc_parts)

    most = SPLIT_DOCS

    def collected(key, table):
        doc, _, _ = _unpack(table)
        token, df = _joined_planes(table, "lo", np.uint64), _joined_planes(table, "df", np.uint32)
        order = np.lexsort((token, doc))
        doc, token, large = doc[order], token[order], df[order] > most
        ids, first = np.unique(doc, return_index=True)
        runs = list(zip(first, np.append(first[1:], len(doc))))
        return pa.table({"doc_id": pa.array(ids), "anchors": pa.array([token[a:b].tobytes() for a, b in runs], pa.binary()),
                         "split": pa.array([token[a:b][large[a:b]].tobytes() for a, b in runs], pa.binary())})

    answers = docs.mapInArrow(send, PACKED).groupBy("kind", "part").applyInArrow(counted, PACKED)
    return answers.groupBy("part").applyInArrow(collected, "doc_id long, anchors binary, split binary")


def _send_intervals(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, doc_parts: int) -> pa.RecordBatch:
    """Removed intervals, packed by document partition (kind 1)."""
    part = _doc_part(doc, doc_parts)
    order = np.lexsort((start, row, doc, part))
    part, doc, row, start, end = part[order], doc[order], row[order], start[order], end[order]
    parts, at = np.unique(part, return_index=True)
    at = np.append(at, len(part))
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
    none = pa.array([b""] * len(parts), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ones(len(parts), np.int32)), pa.array(parts.astype(np.int32)), none, none, none,
         cut(end.astype(np.int64)), cut(doc.astype(np.int64)), cut(row.astype(np.int64)), cut(start.astype(np.int64))],
        schema=_ARROW_FRAGMENTS)


def fragments(texts: DataFrame, length: int, parts: int, frag_parts: int, doc_parts: int, hot_all) -> DataFrame:
    """Distinct fragments with shared keys by key partition (kind 0), and intervals that a smaller
    document of the same block removes at once (kind 1). ``texts``: doc_id, row, size, z, anchors, split."""

    def run(batches):
        hot, _ = hot_all.value
        for block in _blocks(batches):
            number: dict[tuple[int, bytes], int] = {}
            frag, doc_of, row_of, start_of = [], [], [], []
            for part, data, offsets in block:
                key, doc, start, end = runs(data, offsets, length)
                name = token_name(key, token_part(key, parts))
                split, _ = is_in(hot, key)
                anchors = [np.frombuffer(a, np.uint64) for a in part.column("anchors").to_pylist()]
                large = [np.frombuffer(a, np.uint64) for a in part.column("split").to_pylist()]
                ids, rows = part.column("doc_id").to_numpy(), part.column("row").to_numpy()
                raw = data.tobytes()
                edge = np.searchsorted(doc, np.arange(len(part) + 1))
                for d in range(len(part)):
                    a, b = edge[d], edge[d + 1]
                    if a == b:
                        continue
                    shared, _ = is_in(anchors[d], name[a:b])
                    if len(large[d]):
                        split[a:b] |= is_in(large[d], name[a:b])[0]
                    base, me, row = int(offsets[d]), int(ids[d]), int(rows[d])
                    for i in (np.flatnonzero(shared) + a).tolist():
                        s, e = int(start[i]), int(end[i])
                        if split[i]:  # a key of very many documents: each string by itself
                            pieces = [(0, x, x + length) for x in range(s, e - length + 1)]
                        else:
                            pieces = [(int(name[i]), s, e)]
                        for k, x, y in pieces:
                            f = number.setdefault((k, raw[x:y]), len(number))
                            frag.append(f)
                            doc_of.append(me)
                            row_of.append(row)
                            start_of.append(x - base)
            if not number:
                continue
            frag, doc, row, start = np.array(frag), *(np.array(x, np.int64) for x in (doc_of, row_of, start_of))
            keys = list(number)
            size = np.array([len(k[1]) for k in keys], np.int64)
            least = np.full(len(keys), np.iinfo(np.int64).max)
            np.minimum.at(least, frag, doc)
            later = doc > least[frag]
            if later.any():
                yield _send_intervals(doc[later], row[later], start[later], start[later] + size[frag[later]], doc_parts)
            frag, doc, row, start = frag[~later], doc[~later], row[~later], start[~later]
            names = np.array([k or int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for k, t in keys], np.uint64)
            where = (mix(names) % np.uint64(frag_parts)).astype(np.int64)
            by_part = np.argsort(where, kind="stable")
            at = np.searchsorted(where[by_part], np.arange(frag_parts + 1))
            new_number = np.empty(len(keys), np.int64)
            new_number[by_part] = np.arange(len(keys)) - at[where[by_part]]
            of = where[frag]
            order = np.argsort(of, kind="stable")
            frag, doc, row, start, of = frag[order], doc[order], row[order], start[order], of[order]
            occ = np.searchsorted(of, np.arange(frag_parts + 1))
            cols: list[list] = [[] for _ in range(8)]
            for p in np.unique(where).tolist():
                own = by_part[at[p] : at[p + 1]]
                o = slice(occ[p], occ[p + 1])
                cols[0].append(p)
                cols[1].append(names[own].tobytes())
                cols[2].append(size[own].astype(np.uint32).tobytes())
                cols[3].append(b"".join([keys[i][1] for i in own.tolist()]))
                cols[4].append(new_number[frag[o]].astype(np.uint32).tobytes())
                cols[5].append(doc[o].tobytes())
                cols[6].append(row[o].tobytes())
                cols[7].append(start[o].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(cols[0]), np.int32)), pa.array(cols[0], pa.int32())]
                + [pa.array(c, pa.binary()) for c in cols[1:]], schema=_ARROW_FRAGMENTS)

    return texts.mapInArrow(run, FRAGMENTS)


def smallest_documents(texts: list[bytes], least: list[int], length: int) -> list[np.ndarray]:
    """For every string of ``length`` bytes of every fragment the smallest document that holds it,
    by the suffix array of all fragments together (strings of different keys differ, so the
    fragments of several keys may be sorted at once)."""
    sizes = np.array([len(t) + 1 for t in texts])
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols = joined.astype(np.int64) + 2
    symbols[np.cumsum(sizes) - 1] = 1  # ends a fragment
    order = np.array(suffix_array([*symbols.tolist(), 0]))
    # the suffixes that start a string of their fragment, in order
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    of = np.repeat(np.arange(len(texts)), sizes)
    room = (starts + sizes - 1)[of] - np.arange(len(of))
    order = order[order < len(of)]
    order = order[room[order] >= length]
    strings = np.lib.stride_tricks.sliding_window_view(joined, length)
    same = np.zeros(len(order), bool)
    for lo in range(1, len(order), 4096):
        at = slice(lo, lo + 4096)
        same[at] = (strings[order[at]] == strings[order[lo - 1 : lo - 1 + len(order[at])]]).all(1)
    group = np.cumsum(~same) - 1
    low = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, group, np.array(least, np.int64)[of[order]])
    found = np.empty(len(of), np.int64)
    found[order] = low[group]
    return [found[a : a + n - length] for a, n in zip(starts.tolist(), sizes.tolist())]


def shared_ranges(texts: list[bytes], length: int) -> list[tuple[int, int]]:
    """For each text the range of its bytes from the first to the last string of ``length`` bytes whose
    hash another of the texts has, too; (0, 0) if there is none."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    p, q = powers(len(data))
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_EXACT[data] * p[: len(data)], out=acc[1:])
    of = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(of[: len(of) - length + 1] == of[length - 1 :])
    h = mix((acc[at + length] - acc[at]) * q[at])
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(first, len(h)))
    several = of[at[first]] != of[at[first + count - 1]]  # places rise in a group
    at = at[np.repeat(several, count)]
    begin = np.cumsum(sizes) - sizes
    lo, hi = np.full(len(texts), len(data)), np.zeros(len(texts), np.int64)
    np.minimum.at(lo, of[at], at)
    np.maximum.at(hi, of[at], at + length)
    return [(a, b) if b > 0 else (0, 0) for a, b in zip((lo - begin).tolist(), np.maximum(hi - begin, 0).tolist())]


def compared(key, table: pa.Table, length: int, doc_parts: int) -> pa.Table:
    """Removed intervals of the fragments that meet in a partition."""
    if key[0].as_py() == 1:
        return table
    number: dict[tuple[int, bytes], int] = {}
    by_key: dict[int, list[int]] = {}
    frag, doc, row, start = [], [], [], []
    for r in table.to_pylist():
        size = np.frombuffer(r["sizes"], np.uint32).astype(np.int64)
        end = np.cumsum(size)
        local = np.empty(len(size), np.int64)
        for i, (k, a, b) in enumerate(zip(np.frombuffer(r["names"], np.uint64).tolist(), (end - size).tolist(), end.tolist())):
            own = (k, r["bytes"][a:b])
            f = number.get(own)
            if f is None:
                f = number[own] = len(number)
                by_key.setdefault(k, []).append(f)
            local[i] = f
        frag.append(local[np.frombuffer(r["frag"], np.uint32)])
        doc.append(np.frombuffer(r["docs"], np.int64))
        row.append(np.frombuffer(r["rows"], np.int64))
        start.append(np.frombuffer(r["starts"], np.uint32).astype(np.int64))
    frag, doc, row, start = (np.concatenate(x) for x in (frag, doc, row, start))
    texts = [t for _, t in number]
    size = np.array([len(t) for t in texts], np.int64)
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, frag, doc)
    # a key can cut a document only if one of its other fragments stands in a smaller document
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, frag, doc)
    alone = np.ones(len(texts), bool)
    strings: dict[int, tuple[int, np.ndarray]] = {}  # of a fragment: where its shared part begins, smallest documents
    keys: list[list[int]] = []
    for fs in by_key.values():
        if len(fs) > 1:
            own = np.array(fs)
            order = np.sort(least[own])
            if (most[own] > np.where(least[own] == order[0], order[1], order[0])).any():
                keys.append(fs)
                alone[own] = False

    def sort(parts: list[dict[bytes, list[tuple[int, int]]]]) -> None:
        own = [(t, who) for of_key in parts for t, who in of_key.items()]
        found = smallest_documents([t for t, _ in own], [min(int(least[f]) for f, _ in who) for _, who in own], length)
        strings.update((f, (at, low)) for (_, who), low in zip(own, found) for f, at in who)

    parts: list[dict[bytes, list[tuple[int, int]]]] = []  # by key: the fragments that have a part, and where
    near: list[list[int]] = []
    total = sorting = 0
    for n, fs in enumerate(keys, 1):
        near.append(fs)
        total += int(size[fs].sum())
        if total < RANGE_BYTES and n < len(keys):
            continue
        ranges = iter(shared_ranges([texts[f] for own in near for f in own], length))
        for own in near:
            part: dict[bytes, list[tuple[int, int]]] = {}
            for f, (a, b) in zip(own, ranges):
                if b:
                    part.setdefault(texts[f][a:b], []).append((f, a))
                else:
                    alone[f] = True
            if part:
                parts.append(part)
                sorting += sum(map(len, part))
                if sorting >= SORT_BYTES:
                    sort(parts)
                    parts, sorting = [], 0
        near, total = [], 0
    if parts:
        sort(parts)
    whole = doc > least[frag]  # a smaller document holds the very same fragment
    out_doc, out_row, out_start, out_end = [doc[whole]], [row[whole]], [start[whole]], [(start + size[frag])[whole]]
    rest = np.flatnonzero(~whole & ~alone[frag])
    ds, rs, ss, es = [], [], [], []
    for i in rest.tolist():
        at, low = strings[int(frag[i])]
        hit = low < doc[i]
        if hit.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                ds.append(doc[i])
                rs.append(row[i])
                ss.append(start[i] + at + a)
                es.append(start[i] + at + b - 1 + length)
    out_doc.append(np.array(ds, np.int64))
    out_row.append(np.array(rs, np.int64))
    out_start.append(np.array(ss, np.int64))
    out_end.append(np.array(es, np.int64))
    d, r, s, e = (np.concatenate(x) for x in (out_doc, out_row, out_start, out_end))
    if not len(d):
        return table.slice(0, 0)
    return pa.Table.from_batches([_send_intervals(d, r, s, e, doc_parts)])


def _merged(key, table: pa.Table) -> pa.Table:
    """(doc_id, row, starts, ends): a document's removed runs, overlapping and touching ones merged."""
    doc, row, start, end = (_joined(table, c, np.int64) for c in ("docs", "rows", "starts", "frag"))
    order = np.lexsort((start, row, doc))
    doc, row, start, end = doc[order], row[order], start[order], end[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]))
    out_s, out_e = [], []
    for a, b in zip(first, np.append(first[1:], len(doc))):
        s, e = start[a:b], np.maximum.accumulate(end[a:b])
        new = np.ones(len(s), bool)
        new[1:] = s[1:] > e[:-1]
        out_s.append(s[new].tobytes())
        out_e.append(e[np.append(new[1:], True)].tobytes())
    return pa.table({"doc_id": pa.array(doc[first]), "row": pa.array(row[first]),
                     "starts": pa.array(out_s, pa.binary()), "ends": pa.array(out_e, pa.binary())})


def _packed_text(docs: DataFrame) -> DataFrame:
    """(doc_id, row, size, z): texts compressed for the shuffle."""

    def run(batches):
        for batch in batches:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array([len(x) for x in raw], pa.int64()),
                 pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary())],
                names=["doc_id", "row", "size", "z"])

    return docs.where("doc_id is not null and text is not null and text <> ''").mapInArrow(
        run, "doc_id long, row long, size long, z binary")


def _unpacked(z: bytes, size: int) -> bytes:
    return pa.decompress(z, size, "zstd", asbytes=True)


def removed_spans(spark: SparkSession, docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of
    ``docs(doc_id, text)``; spans: "start:end" in bytes of each removed run, comma-joined."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = document_rows(spark, docs, length)
    own = rows.where("token is null").select("doc_id", "n_bytes", "sha", "keys")
    # rows of one doc_id with different texts are told apart by their digest; row is 0 for all others
    differ = own.where("doc_id is not null").groupBy("doc_id").agg(F.min("sha").alias("a"), F.max("sha").alias("b"))
    differ = stored(spark, differ.where("a <> b").select("doc_id", F.lit(True).alias("differs")), "differ")
    if differ.isEmpty():
        own, named = own.withColumn("row", F.lit(0).cast("long")), docs.withColumn("row", F.lit(0).cast("long"))
    else:
        row = lambda sha: F.when(F.col("differs"), F.xxhash64(sha)).otherwise(F.lit(0)).alias("row")
        own = own.join(differ, "doc_id", "left").select("doc_id", "n_bytes", "sha", "keys", row("sha"))
        text = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
        named = docs.join(differ, "doc_id", "left").select("doc_id", "text", row(text))
    classes = own.where(f"doc_id is not null and n_bytes >= {length}").groupBy("sha").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    classes = stored(spark, classes.where("first_id < last_id").select("sha", "first_id"), "classes")
    total, count = own.agg(F.sum("keys"), F.count("*")).first()
    parts = max(16, -(-(total or 0) // PART_KEYS))
    doc_parts = max(16, -(-(count or 0) // PART_DOCS))
    hot = hot_tokens(spark, rows.where("token is not null"), count or 0)
    anchors = shared_keys(spark, docs, rows, length, parts, doc_parts, hot)
    copies = own.join(classes, "sha").where("doc_id > first_id").select("doc_id", "row").distinct()
    if differ.isEmpty():
        anchors = anchors.withColumn("row", F.lit(0).cast("long"))
    else:
        anchors = anchors.join(own.where("doc_id is not null").select("doc_id", "row").distinct(), "doc_id")
    anchors = stored(spark, anchors.join(copies, ["doc_id", "row"], "left_anti"), "anchors")
    shared = anchors.agg(F.sum(F.length("anchors"))).first()[0] or 0
    # a fragment has about 70 bytes for each 8 bytes of its key's name
    frag_parts = max(16, -(-shared * 9 // FRAGMENT_BYTES))

    texts = _packed_text(named).join(anchors, ["doc_id", "row"])
    packed = fragments(texts, length, parts, frag_parts, doc_parts, hot)
    cuts = packed.groupBy("kind", "part").applyInArrow(
        lambda key, table: compared(key, table, length, doc_parts), FRAGMENTS)
    cuts = stored(spark, cuts.groupBy("part").applyInArrow(
        lambda key, table: _merged(key, table), "doc_id long, row long, starts binary, ends binary"), "cuts")

    def hashed(batches):
        for batch in batches:
            out = {"doc_id": [], "row": [], "n_removed": [], "n_spans": [], "kept": [], "spans": []}
            for lo in range(0, batch.num_rows, 512):
                for r in batch.slice(lo, 512).to_pylist():
                    raw = _unpacked(r["z"], r["size"])
                    s, e = (np.frombuffer(r[c], np.int64).tolist() for c in ("starts", "ends"))
                    kept, at = hashlib.sha256(), 0
                    for a, b in zip(s, e):
                        kept.update(raw[at:a])
                        at = b
                    kept.update(raw[at:])
                    out["doc_id"].append(r["doc_id"])
                    out["row"].append(r["row"])
                    out["n_removed"].append(sum(e) - sum(s))
                    out["n_spans"].append(len(s))
                    out["kept"].append(kept.hexdigest())
                    out["spans"].append(",".join(f"{a}:{b}" for a, b in zip(s, e)))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("doc_id", pa.int64()), ("row", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                ("kept", pa.string()), ("spans", pa.string())]))

    done = _packed_text(named).join(cuts, ["doc_id", "row"]).mapInArrow(
        hashed, "doc_id long, row long, n_removed long, n_spans long, kept string, spans string")
    done = stored(spark, done.dropDuplicates(["doc_id", "row"]), "done")
    out = own.join(classes, "sha", "left").join(done, ["doc_id", "row"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(copy, F.concat(F.lit("0:"), "n_bytes")).otherwise(F.coalesce("spans", F.lit(""))).alias("spans"),
    )
