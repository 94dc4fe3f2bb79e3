"""Main text of web pages by wrapper induction over the pages of a host (operator 1).

Pages of one host meet in groups of about ``GROUP_PAGES``. Each page becomes a tree in which
neighbouring siblings of one label (tag, class and id) form one repeated node. The trees of a
group are aligned one by one with a growing wrapper by simple tree matching (the largest set of
matching nodes that keeps labels, order and ancestors); nodes without a partner become new slots of
the wrapper. Every slot counts in how many different pages each text stands in it: a text that most
pages share is template, everything else in the slot is content.

Elements that are not the article by their own account (navigation, forms, scripts, adverts,
comments and the like, by tag, role, or a whole class or id token) are dropped; names never drop
html, body, main, article or headings, and a name that only holds such a word ("no-sidebar") or may
be a topic ("legal"), or one of a menu around paragraphs, drops an element only where the wrapper
finds it constant. A form or a named part (but comments) that holds the main element, or most of the
page's text and every article, is a frame around the page and is kept. If a page marks its article
or main part, only that part is read. Blocks are joined by an empty line, white space inside a
block becomes one space; a dropped element inside a line does not end the block.

Trees may be of any depth; elements nested deeper than ``DEPTH`` become
siblings, each ending and dropped as it would be, and only the wrapper sees them as one level.

The n pages of a host are dealt to n / GROUP_PAGES groups (rounded down, one at least) by a hash of
the page, whatever the table holds besides. For hosts with more than 1/HOT_HOSTS of all pages the
number is broadcast (there are at most HOT_HOSTS such hosts), and each group is shuffled by itself;
smaller hosts are shuffled whole, and counted and dealt where they arrive. A group is read as a
stream, sorted by page_id: of more than 2 * GROUP_PAGES pages, GROUP_PAGES at a time are read, so
none is held whole and the last read has GROUP_PAGES at least. Results for odd rows: null and empty html gives an empty text; null url and page_id are
passed through; repeated rows give repeated results, and copies and versions of a text, told by
their content, count once in the wrapper; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

GROUP_PAGES = 24
HOT_HOSTS = 10_000
LEAST_PAGES = 4  # pages that must share a text before it can be template
SHARE = 0.6  # and their share of the pages that have the slot
VERSION_RUNS = 32  # least runs of words by which two pages are told to be versions of one text

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
DROPPED = frozenset(
    "script style noscript template iframe head title nav footer aside form button input select "
    "option textarea svg canvas object embed audio video dialog menu".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
               "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl td th article section div body html main aside nav".split())
# words of class, id and role that name a part other than the article. A token of nothing but these
# and PLAIN words names one (unless a topic); any other token only gives a hint
PART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promoted promotion "
    "nav navbar navigation menu menubar topbar breadcrumb breadcrumbs pagination pager toc "
    "footer foot siteheader masthead topnav sidebar sidenav aside rail widget widgets related recommended "
    "comment comments commentlist disqus reply replies respond discussion cookie cookies consent notice notices "
    "gdpr alert popup modal overlay newsletter subscribe subscription signup login social share sharing "
    "toolbar search searchbox skip hidden copyright legal disclaimer complementary contentinfo dialog".split()
)
TOPICS = frozenset(  # also what a passage of the article may be about
    "discussion search legal notice notices disclaimer copyright social share sharing alert promotion recommended "
    "related replies reply respond rail skip toc banner signup login subscription consent cookie cookies".split()
)
PLAIN = frozenset("area bar block box container inner item items list section site wrap wrapper".split())
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split()
)
MENUS = frozenset(
    "nav navbar navigation menu menubar topbar topnav sidenav breadcrumb breadcrumbs pagination pager toc toolbar".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())  # stand in the head
DEPTH = 256
NEVER = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())  # not dropped by a name
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[A-Za-z][^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?+")
_UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


NAMED, SURE = 1, 2  # why an element is no part of the article: its name (or it is a form), or its tag


class Node:
    """An element: children are elements and strings, in page order; ``part``: 0, NAMED or SURE."""

    __slots__ = ("tag", "label", "children", "part", "hint")

    def __init__(self, tag: str, label: str, part: int = 0, hint: bool = False):
        self.tag, self.label, self.part, self.hint = tag, label, part, hint
        self.children: list = []


def _names_part(token: str) -> tuple[bool, bool]:
    """Whether a class or id token names a part other than the article, and whether it may."""
    words = {w.lower() for w in _WORD.findall(token)}
    named = words & PART_WORDS
    certain = bool(named) and words <= PART_WORDS | PLAIN and not (len(named) == 1 and named <= TOPICS)
    return certain, bool(named) or "header" in words


def _element(tag: str, attrs: str) -> Node:
    label, part, hint = tag, NAMED if tag == "form" else SURE if tag in DROPPED else 0, False
    if attrs and not attrs.isspace():
        named = []
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role"):
                named.append(value)
                if tag in NEVER:
                    continue
                for token in value.split():
                    certain, may = (token.lower() in ROLES, False) if name == "role" else _names_part(token)
                    part, hint = max(part, NAMED if certain else 0), hint or may
            elif name == "hidden" or name == "style" and _UNSEEN.search(value):
                part = SURE if tag not in ("html", "body") else part
        label = f"{tag} {' '.join(named)}" if named else tag
    return Node(tag, label, part, hint)


def parse(page: str) -> Node:
    """A tree with implied end tags; never fails, and reads each character a bounded number of times."""
    root = Node("#root", "#root")
    # open elements, the node that takes their children, and how many of a tag are open
    stack, into = [root], [root]
    open_: dict[str, int] = {}

    def close(k: int) -> None:
        for node, taker in zip(stack[k:], into[k:]):
            open_[node.tag] -= 1
            if taker is not node and node.tag in BLOCKS:
                taker.children.append(Node("div", "div"))  # a flattened block ends here
        del stack[k:], into[k:]

    at = 0
    lower = None
    n = len(page)
    while at < n:
        lt = page.find("<", at)
        text = page[at:] if lt < 0 else page[at:lt]
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                close(len(stack) - 1)
            into[-1].children.append(text)
        if lt < 0:
            break
        m = _TOKEN.match(page, lt)
        if not m:
            into[-1].children.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if m.group("end"):
            if tag == "br":
                into[-1].children.append(Node("br", "br"))
            elif open_.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag == "p" and stack[k].tag in SCOPE:
                        break
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            close(len(stack) - 1)  # its end tag may be left out
        closing = SAME_CLOSES.get(tag, ())
        if tag in CLOSES_P and open_.get("p") or any(open_.get(t) for t in closing):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" and tag in CLOSES_P or stack[k].tag in closing:
                    close(k)
                    if stack[-1].tag not in closing:
                        break
                elif stack[k].tag in SCOPE:
                    break
        node = _element(tag, m.group("attrs"))
        into[-1].children.append(node)
        if tag in RAW:
            lower = lower if lower is not None else page.lower()
            end = lower.find(f"</{tag}", at) if len(lower) == n else page.find(f"</{tag}", at)
            if end < 0:
                break
            node.children.append(page[at:end])
            gt = page.find(">", end)
            at = n if gt < 0 else gt + 1
        elif tag not in VOID and not m.group("attrs").endswith("/"):
            # what is no part of the article holds its own children at any depth
            into.append(node if len(stack) < DEPTH or node.part else into[-1])
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1
    _settle(root)
    return root


def _settle(root: Node) -> None:
    """Keep frames: forms and named parts around the page are no parts of it, and a menu's name
    around paragraphs is a hint only."""
    order, todo = [], [(root, False)]
    while todo:
        x, linked = todo.pop()
        linked = linked or x.tag in ("a", "label", "legend")
        order.append((x, linked))
        if x.part < SURE:
            todo += [(c, linked) for c in x.children if isinstance(c, Node)]
    letters: dict[int, int] = {}  # of text outside links and labels
    marked: dict[int, int] = {}  # articles and main elements
    prose: dict[int, bool] = {}  # paragraphs with such text
    mains: dict[int, bool] = {}
    for x, linked in reversed(order):
        sure = x.part == SURE
        own = 0 if linked or sure else sum(len(c) - c.count(" ") for c in x.children if isinstance(c, str) and not c.isspace())
        below = [] if sure else [id(c) for c in x.children if isinstance(c, Node)]
        letters[id(x)] = own + sum(letters[c] for c in below)
        marked[id(x)] = (x.tag in ("article", "main")) + sum(marked[c] for c in below)
        mains[id(x)] = x.tag == "main" or any(mains[c] for c in below)
        prose[id(x)] = x.tag == "p" and letters[id(x)] > 0 or any(prose[c] for c in below)
    for x, _ in order:
        if x.part != NAMED:
            continue
        words = {w.lower() for w in _WORD.findall(x.label)} & PART_WORDS
        frame = not words & COMMENTS and 2 * letters[id(x)] > letters[id(root)] and marked[id(x)] == marked[id(root)]
        if mains[id(x)] or frame:
            x.part, x.hint = 0, False
        elif words and words <= MENUS and prose[id(x)] and x.tag not in DROPPED:
            x.part, x.hint = 0, True


class Slot:
    """A wrapper node: texts seen here by how many different pages, and child slots in order."""

    __slots__ = ("label", "pages", "texts", "children", "size")

    def __init__(self, label: str):
        self.label, self.pages = label, 0
        self.texts: dict[str, int] = {}
        self.children: list[Slot] = []


def _text(node: Node) -> str:
    """The node's whole text, white space collapsed."""
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            todo += reversed(x.children)
    return " ".join("".join(parts).split())


def _groups(nodes: list[Node]) -> list[tuple[str, list[Node]]]:
    """Element children of some repeated siblings, neighbours of one label together."""
    out: list[tuple[str, list[Node]]] = []
    for node in nodes:
        for c in node.children:
            if isinstance(c, Node) and c.tag != "br" and c.tag not in RAW:
                if out and out[-1][0] == c.label:
                    out[-1][1].append(c)
                else:
                    out.append((c.label, [c]))
    return out


class Plan:
    """Weights of a page's simple tree matching with the wrapper. ``below``: the repeated children of
    repeated siblings; ``pairs``: the child pairs of a slot and repeated siblings of its label."""

    def __init__(self):
        self.below: dict[int, list] = {}
        self.pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def groups(self, nodes: list[Node]) -> list:
        if id(nodes) not in self.below:
            self.below[id(nodes)] = _groups(nodes)
        return self.below[id(nodes)]

    def weight(self, slot: Slot, nodes: list[Node]) -> int:
        """Nodes of the largest matching of the two subtrees: their roots and all below."""
        groups = self.groups(nodes) if slot.children else []
        if not groups:
            return 1
        total, self.pairs[id(slot), id(nodes)] = _heaviest(slot.children, groups, self.weight)
        return 1 + total


def _heaviest(slots: list[Slot], groups: list, weigh) -> tuple[int, list[tuple[int, int]]]:
    n, m = len(slots), len(groups)
    labels = [s.label for s in slots]
    if n == m and labels == [g[0] for g in groups] and len(set(labels)) == n:
        return sum(weigh(s, g[1]) for s, g in zip(slots, groups)), [(i, i) for i in range(n)]
    best = [[0] * (m + 1)]
    weight = {}
    for i in range(n):
        above, row = best[-1], [0]
        for j in range(m):
            most = above[j + 1] if above[j + 1] > row[j] else row[j]
            if labels[i] == groups[j][0]:
                weight[i, j] = w = weigh(slots[i], groups[j][1])
                most = max(most, above[j] + w)
            row.append(most)
        best.append(row)
    pairs, i, j = [], n, m
    while i and j:
        if (i - 1, j - 1) in weight and best[i][j] == best[i - 1][j - 1] + weight[i - 1, j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[n][m], pairs[::-1]


def match(slots: list[Slot], groups: list) -> list[tuple[int, int]]:
    """Simple tree matching of two child lists: pairs (slot, group) of the heaviest alignment that
    keeps labels and order. A pair weighs the nodes of the largest matching of its subtrees."""
    return _heaviest(slots, groups, Plan().weight)[1]


def align(slot: Slot, nodes: list[Node], where: dict[int, Slot], fresh: bool, plan: Plan | None = None) -> None:
    """Align repeated siblings with a slot; ``where`` gets the slot of every node. ``fresh`` pages
    add to the counts (a page that is a copy of another in the group does not)."""
    if plan is None:
        plan = Plan()
        plan.weight(slot, nodes)
    for node in nodes:
        where[id(node)] = slot
    if fresh:
        slot.pages += 1
        for t in {_text(x) for x in nodes}:
            slot.texts[t] = slot.texts.get(t, 0) + 1
    groups = plan.groups(nodes)
    if not groups:
        return
    partner = {j: slot.children[i] for i, j in plan.pairs.get((id(slot), id(nodes)), ())}
    place = 0
    for j, (label, own) in enumerate(groups):
        if j in partner:
            place = slot.children.index(partner[j]) + 1
            align(partner[j], own, where, fresh, plan)
        else:
            new = Slot(label)
            slot.children.insert(place, new)
            place += 1
            align(new, own, where, fresh, plan)


def _template(slot: Slot | None, node: Node) -> bool:
    if slot is None or slot.pages < LEAST_PAGES:
        return False
    n = slot.texts.get(_text(node), 0)
    return n >= max(LEAST_PAGES, SHARE * slot.pages)


def _elsewhere(slot: Slot | None, node: Node) -> bool:
    """Whether the text stands in the slot in another page too."""
    return slot is not None and slot.texts.get(_text(node), 0) > 1


def _letters(text: str) -> str:
    return "".join(re.findall(r"\w+", entities.unescape(text)))


def blocks(root: Node, where: dict[int, Slot]) -> list[str]:
    """The page's blocks of text that are neither template nor dropped; of these, the ones in
    outermost articles, else in main, if they hold at least half of the varying text. The page's
    title at the start of a block in these makes it their headline or opening, and no template."""
    out, line = [], []
    marks: dict[str, Node | None] = {"article": None, "main": None}
    constant = {None: False}
    name = _letters(_title(root)) if where else ""

    def flush():
        text = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append((text, marks["article"], marks["main"]))

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif isinstance(x, tuple):  # the end of a mark
            flush()
            marks[x[0]] = None
        elif x.tag == "br":
            line.append(" ")
        elif x.part or (x.tag == "header" and not (marks["article"] or marks["main"])):
            if x.tag in BLOCKS:
                flush()
        elif marks.get(x.tag, x) is None:
            flush()
            marks[x.tag] = x
            constant[x] = _template(where.get(id(x)), x)
            todo.append((x.tag,))
            todo += reversed(x.children)
        elif (x.tag in BLOCKS or x.hint) and _template(where.get(id(x)), x) and not (
                (marks["article"] or marks["main"]) and name and _letters(_text(x)).startswith(name)):
            if x.tag in BLOCKS:
                flush()
        else:
            if x.tag in BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    varying = [0 if constant[a] or constant[m] else len(t) for t, a, m in out]
    for k in (1, 2):
        own = [i for i, b in enumerate(out) if b[k]]
        if own and 2 * sum(varying[i] for i in own) >= sum(varying):
            some = any(varying[i] for i in own)
            return [out[i][0] for i in own if varying[i] or not some]
    # the main text is outside the articles: cards that other pages show too are no part of it
    cards = {a for _, a, _ in out if a and (constant[a] or _elsewhere(where.get(id(a)), a))}
    return [t for (t, a, m), v in zip(out, varying) if v and a not in cards]


def _runs(text: str) -> set:
    words = text.split()
    return set(zip(words, words[1:], words[2:])) or {text}


def _copy(own: dict[str, set], runs: set, others: list[tuple[dict[str, set], set]]) -> bool:
    """Whether a page's blocks (with their runs of three words) are another page's, or a version of
    them: the blocks that only one of the two has are long and hold mostly the same runs."""
    for other, y in others:
        x, a, b = runs, own.keys() - other.keys(), other.keys() - own.keys()
        if not a and not b:
            return True
        if len(a) < len(own):
            x, y = set().union(*(own[t] for t in a)), set().union(*(other[t] for t in b))
        less = min(len(x), len(y))
        if less >= VERSION_RUNS and len(x & y) >= SHARE * less:
            return True
    return False


def _title(root: Node) -> str:
    todo = [root]
    while todo:
        x = todo.pop()
        if x.tag == "title":
            return _text(x)
        if x.tag in ("#root", "html", "head"):
            todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    return ""


def extract(pages: list[str | None]) -> list[str]:
    """Main texts of pages of one host."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 16 * DEPTH))  # trees are compared level by level
    wrapper, seen, out = Slot("#root"), [], []
    trees, wheres = [], []
    for page in pages:
        where: dict[int, Slot] = {}
        tree = parse(page or "")
        if page:
            own = {t: _runs(t) for t in blocks(tree, where) or [page]}  # as read without a wrapper
            runs = set().union(*own.values())
            fresh = not _copy(own, runs, seen)
            align(wrapper, [tree], where, fresh)
            if fresh:
                seen.append((own, runs))
        trees.append(tree)
        wheres.append(where)
    for tree, where in zip(trees, wheres):
        out.append("\n\n".join(blocks(tree, where)))
    return out


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html)``."""
    codec = "zstd"
    schema = "page_id long, url string, host string, h long, size long, z binary"

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if x is None else x.encode() for x in batch.column("html").to_pylist()]
            z = [None if x is None else pa.compress(x, codec, asbytes=True) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("page_id", "url", "host", "h")]
                + [pa.array([0 if x is None else len(x) for x in raw], pa.int64()), pa.array(z, pa.binary())],
                names=["page_id", "url", "host", "h", "size", "z"])

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(host, F.lit("")).alias("host"), "html",
        F.xxhash64("page_id", "url").alias("h"))
    counts = stored(spark, keyed.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(GROUP_PAGES, total // HOT_HOSTS)).select(
        "host", F.floor(F.col("n") / GROUP_PAGES).alias("groups"))
    sent = keyed.mapInArrow(shrink, schema).join(F.broadcast(hot), "host", "left")
    sent = sent.withColumn("grp", F.coalesce(F.pmod("h", F.col("groups")), F.lit(0)))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = sent.repartition(parts, "host", "grp").withColumn(
        "n", F.when(F.col("groups").isNull(), F.count("*").over(Window.partitionBy("host", "grp"))))
    own = F.pmod("h", F.greatest(F.lit(1), F.floor(F.col("n") / GROUP_PAGES)))
    sent = sent.withColumn("grp", F.when(F.col("groups").isNull(), own).otherwise(F.col("grp"))).drop("groups", "h", "n")
    sent = sent.sortWithinPartitions("host", "grp", "page_id", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done(rows):
            texts = extract([r["html"] for r in rows])
            return pa.RecordBatch.from_arrays(
                [pa.array([r["page_id"] for r in rows], pa.int64()), pa.array([r["url"] for r in rows], pa.string()),
                 pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for r in batch.slice(lo, 256).to_pylist():
                    own = (r["host"], r["grp"])
                    if rows and own != key:
                        yield done(rows)
                        rows = []
                    elif len(rows) >= 2 * GROUP_PAGES:
                        yield done(rows[:GROUP_PAGES])
                        rows = rows[GROUP_PAGES:]
                    key = own
                    r["html"] = None if r["z"] is None else pa.decompress(r["z"], r["size"], codec, asbytes=True).decode() if r["size"] else ""
                    del r["z"]
                    rows.append(r)
        if rows:
            yield done(rows)

    return sent.mapInArrow(run, "page_id long, url string, text string, n_chars long")
