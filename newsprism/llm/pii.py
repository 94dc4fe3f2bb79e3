"""Personal data with offset-preserving deobfuscation (operator 8).

Base identifiers are found in the text as it is. Then transducers rewrite the text and carry, for
every character they put out, the source range it came from. They are chained: homoglyphs
(compatibility forms, other scripts' digits, look-alike letters, zero-width characters), then
"at"/"dot" disguises, then runs of spoken numbers (digit names, "dot" and "plus" among them).
Identifiers found in a rewritten text are mapped back to source characters and added if a
transducer changed something in them and no span of their kind covers them already: a base span
that is only part of a disguised one stays, and the wider span is added to it.

A bare "at" between words counts with a spelled dot after it only ("meet me at example.com" is not
an address); "@" with blanks around it, and "at" in brackets, count before any domain.

Results for odd rows: null and empty texts have no spans; doc_id may be null or repeated and is
passed through; matches never depend on other rows; other columns are ignored (``mask`` keeps
them). Every detector is linear in the length of the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_bytes, text_chunks
from .words import NOT_ALNUM, range_hashes, word_spans

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its first digit only: no other start can match where that fails.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "·": ".", "․": ".", "。": ".",
}
ZERO_WIDTH = "​‌‍⁠﻿­"

# Digit names.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}
_NAME = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_AT = r"(?:at|arobase|arroba|ät)"
_DOT = r"(?:dot|punkt|point|punto)"
_PLUS = r"(?:plus|más|mas)"
# spoken numbers: digit names, "plus" and "dot" among names or digits, up to three separators between
_GAP = r"[ \t\r\n,.()-]{1,3}"
_ITEM = rf"(?:(?:{_NAME}|{_DOT}|{_PLUS})(?![^\W_])|[0-9]++(?![^\W_]))"
_SPOKEN = re.compile(rf"(?i)(?<![^\W_]){_ITEM}(?:{_GAP}{_ITEM})++")
_SPOKEN_ITEM = re.compile(rf"(?i)(?P<name>{_NAME})(?![^\W_])|(?P<dot>{_DOT})(?![^\W_])|(?P<plus>{_PLUS})(?![^\W_])|[0-9]+")
LEAST_ITEMS = 4  # names and numbers in a row
_BLANK = r"[ \t\r\n]"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_MARKED_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9]){_BLANK}*+{_OPEN}{_BLANK}*+(?:{_AT}|@){_BLANK}*+{_CLOSE}{_BLANK}*+(?=[A-Za-z0-9])")
_MARKED_DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9]){_BLANK}*+{_OPEN}{_BLANK}*+(?:{_DOT}|\.){_BLANK}*+{_CLOSE}{_BLANK}*+(?=[A-Za-z0-9])")
# without brackets only as a whole: name (dot name) at host dot domain, found from the "at" outwards
_BARE_AT = re.compile(rf"(?i)(?<!{_BLANK}){_BLANK}++(?:{_AT}|@){_BLANK}++|(?<!{_BLANK})@(?!{_BLANK})")
_BARE_DOT = re.compile(rf"(?i){_BLANK}++{_DOT}{_BLANK}++")
_HOST = re.compile(rf"(?i)[A-Za-z0-9-]++(?:(?:{_BLANK}++{_DOT}{_BLANK}++|\.)[A-Za-z0-9-]++)++")
_BACK_DOT = rf"(?:{'|'.join(w[::-1] for w in _DOT[3:-1].split('|'))})"
_BACK_LOCAL = re.compile(  # the name, read from the "at" to the left
    rf"(?i)[A-Za-z0-9_%+-]++(?:(?:{_BLANK}++{_BACK_DOT}{_BLANK}++|\.)[A-Za-z0-9_%+-]++)*+")
_BRACKET = re.compile(r"[\[({<]")


def _hashes(names) -> np.ndarray:
    spell = [v.encode() for n in names for v in {n, n.upper()}]
    data = np.frombuffer(b"".join(spell), np.uint8)
    end = np.cumsum([len(v) for v in spell])
    return range_hashes(data, np.concatenate([[0], end[:-1]]), end)


_NAME_HASHES = _hashes(DIGIT_WORDS)
_DOT_HASHES = _hashes(_DOT[3:-1].split("|"))
_PLUS_HASHES = _hashes(_PLUS[3:-1].split("|"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end), by kind as in KINDS, then start."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 3 else p) <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


class Mapped:
    """A text with the source range [start, end) of each of its characters."""

    def __init__(self, text: str, start=None, end=None):
        self.text = text
        self.start = range(len(text)) if start is None else start
        self.end = range(1, len(text) + 1) if end is None else end

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """With ranges replaced, left to right; each new character stands for its whole range."""
        if not edits:
            return self
        parts, starts, ends, at = [], [], [], 0
        for lo, hi, new in edits:
            parts += [self.text[at:lo], new]
            starts += self.start[at:lo]
            ends += self.end[at:lo]
            starts += [self.start[lo]] * len(new)
            ends += [self.end[hi - 1]] * len(new)
            at = hi
        parts.append(self.text[at:])
        starts += self.start[at:]
        ends += self.end[at:]
        return Mapped("".join(parts), starts, ends)


def _plain(c: str) -> str | None:
    """The ASCII character that ``c`` looks like, "" for nothing visible, None to keep it."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in ZERO_WIDTH:
        return ""
    value = unicodedata.decimal(c, None)
    if value is not None:
        return str(value)
    form = unicodedata.normalize("NFKC", c)
    return form if len(form) == 1 and form.isascii() and form != c else None


_plain_known: dict[str, str | None] = {}


def homoglyphs(m: Mapped) -> Mapped:
    if m.text.isascii():
        return m
    known, odd = _plain_known, set()
    for c in set(m.text):
        if c > "\x7f":
            if c not in known:
                known[c] = _plain(c)
            if known[c] is not None:
                odd.add(c)
    if not odd:
        return m
    return m.rewritten([(i, i + 1, known[c]) for i, c in enumerate(m.text) if c in odd])


def spoken_numbers(m: Mapped, gaps: str) -> Mapped:
    """Runs of spoken numbers as digits, "." and "+". ``gaps``: "keep" what stands between numbers,
    "dots" to drop it but for a single dot, "none" to drop it whole."""
    edits = []
    for run in _SPOKEN.finditer(m.text):
        items = list(_SPOKEN_ITEM.finditer(m.text, run.start(), run.end()))
        if sum(not i["dot"] and not i["plus"] for i in items) < LEAST_ITEMS or not any(i["name"] for i in items):
            continue
        before = None
        for i in items:
            if before is not None:
                lo, hi = before.end(), i.start()
                touching = before["dot"] or i["dot"] or before["plus"]
                if touching or gaps == "none" or gaps == "dots" and m.text[lo:hi] != ".":
                    edits.append((lo, hi, ""))
            before = i
            if i["name"]:
                edits.append((i.start(), i.end(), DIGIT_WORDS[i.group().lower()]))
            elif i["dot"] or i["plus"]:
                edits.append((i.start(), i.end(), "." if i["dot"] else "+"))
    return m.rewritten(edits)


def at_and_dot(m: Mapped) -> Mapped:
    m = m.rewritten([(g.start(), g.end(), "@") for g in _MARKED_AT.finditer(m.text)])
    m = m.rewritten([(g.start(), g.end(), ".") for g in _MARKED_DOT.finditer(m.text)])
    edits, last = [], 0
    for at in _BARE_AT.finditer(m.text):
        host = _HOST.match(m.text, at.end())
        name = _BACK_LOCAL.match(m.text[last : at.start()][::-1]) if host else None
        if name:
            dots = list(_BARE_DOT.finditer(m.text, at.start() - name.end(), at.start()))
            beyond = list(_BARE_DOT.finditer(m.text, host.start(), host.end()))
            if beyond or "@" in at.group():
                edits += [(d.start(), d.end(), ".") for d in dots]
                edits.append((at.start(), at.end(), "@"))
                edits += [(d.start(), d.end(), ".") for d in beyond]
                last = host.end()
                continue
        last = at.end()
    return m.rewritten([e for e in edits if m.text[e[0] : e[1]] != e[2]])


def may_hide(texts: pa.Array) -> np.ndarray:
    """For each text which transducers could change it: 1 for digit names in a row, 2 for a dot
    name (supersets; the exact patterns decide)."""
    data, offsets = text_bytes(texts)
    start, end, doc = word_spans(data, offsets, NOT_ALNUM)
    out = np.zeros(len(offsets) - 1, np.int64)
    if not len(start):
        return out
    h = range_hashes(data, start, end)
    name, dot = np.isin(h, _NAME_HASHES), np.isin(h, _DOT_HASHES)
    item = name | dot | np.isin(h, _PLUS_HASHES) | ((data[start] >= 48) & (data[start] <= 57))
    if len(h) >= 4:
        four = item[:-3] & item[1:-2] & item[2:-1] & item[3:] & (doc[:-3] == doc[3:])
        four &= name[:-3] | name[1:-2] | name[2:-1] | name[3:]
        out[doc[:-3][four]] |= 1
    out[doc[dot]] |= 2
    return out


def find_disguised(
    text: str, base: list[tuple[str, int, int]], hints: int = 3
) -> list[tuple[str, int, int]]:
    """Spans that show only after the transducers, in source characters."""
    views = []
    source = Mapped(text)
    plain = homoglyphs(source)
    if plain is not source:
        hints = 3
        views.append(plain)
    dotted = plain
    if hints & 2 or "@" in plain.text or _BRACKET.search(plain.text):
        dotted = at_and_dot(plain)
        if dotted is not plain:
            views.append(dotted)
    if hints & 1:
        spoken = [spoken_numbers(dotted, gaps) for gaps in ("keep", "dots", "none")]
        views += [v for v in spoken if v is not dotted]
    taken = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in KINDS}
    added: set[tuple[str, int, int]] = set()
    for view in views:
        for kind, a, b in find(view.text):
            lo, hi = view.start[a], view.end[b - 1]
            if text[lo:hi] == view.text[a:b]:
                continue  # as the text stands: what the base rules make of it holds
            spans = taken[kind]
            i = bisect_left(spans, (lo, hi))
            # spans of a kind lie side by side, but for a base span inside an added one
            if any(x <= lo and y >= hi for x, y in spans[max(0, i - 2) : i + 1]):
                continue
            while i and spans[i - 1][0] >= lo:
                i -= 1
            j = i
            while j < len(spans) and spans[j][0] < hi:
                j += 1
            # added spans inside the new one give way to it
            kept = [v for v in spans[i:j] if v[1] > hi or (kind, *v) not in added]
            added -= {(kind, *v) for v in spans[i:j] if v not in kept}
            spans[i:j] = sorted([*kept, (lo, hi)])
            added.add((kind, lo, hi))
    return sorted(added)


def spans_of(text: str | None, hints: int = 3) -> tuple[list, list]:
    """(base spans, all spans), each by kind as in KINDS, then start."""
    if not text:
        return [], []
    base = find(text)
    added = find_disguised(text, base, hints)
    if not added:
        return base, base
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts and digest of base spans, and all spans."""

    def run(batch: pa.RecordBatch):
        for lo, hi in text_chunks(batch):
            part = batch.slice(lo, hi - lo)
            out = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": [], "n_added": []}
            hints = may_hide(part.column("text")).tolist()
            for text, hint in zip(part.column("text").to_pylist(), hints):
                base, spans = spans_of(text, hint)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(spans))
                out["n_added"].append(len(spans) - len(base))
            yield out | {"doc_id": part.column("doc_id")}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_batches(run, schema, docs)


def masked(text: str | None, hints: int = 3) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    _, spans = spans_of(text, hints)
    if not spans:
        return text
    parts, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data of ``text`` masked; other columns and rows are unchanged."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo, hi in text_chunks(batch):
                part = batch.slice(lo, hi - lo)
                hints = may_hide(part.column("text")).tolist()
                new = [masked(t, h) for t, h in zip(part.column("text").to_pylist(), hints)]
                field = part.schema.field(at)
                yield part.set_column(at, field, pa.array(new, field.type))

    return docs.mapInArrow(run, docs.schema)
