"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on small
fixtures and on the smallest driver tables."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from newsprism.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def frame(spark, rows, ddl="doc_id long, text string"):
    return spark.createDataFrame(rows, ddl)


# rows every operator must take: null, empty, blank, very long, repeated, null id
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a b c d e f g h i j"),
       (6, "a b c d e f g h i j"), (6, "a b c d e f g h i j"), (None, "a b c d e f g h i j"),
       (7, "long " * 60000), (8, "x" * 200000)]


# ------------------------------------------------------------------- op1
def test_html_matches_article_of_driver_pages(spark):
    got = {r.page_id: r for r in Q.op1_html_extraction(spark, SF).collect()}
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    assert len(got) == len(pages)
    for pid, page in zip(pages.page_id, pages.html):
        art = re.search(r"<article>(.*?)</article>", page, re.S).group(1).replace("<br>", " ")
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", art)]
        want = "\n\n".join(b for b in want if b)
        assert got[pid].text == want and got[pid].n_chars == len(want)


def test_html_drops_what_is_not_the_article():
    from newsprism.llm.html_extraction import extract

    page = """<!doctype html><html><head><title>T{0}</title><script>var a="</p>";</script></head><body>
      <header><a href=/>Home</a></header><div class="menu"><ul><li>One<li>Two</ul></div>
      <p>Site motto for all</p>
      <div id=main-col><h1>Head &amp; {0}</h1><p>First   <b>para</b>
      {0}.<p>Second<br>para {0} &eacute;<ul><li>item {0}</ul><form><input name=q>Search</form></div>
      <div class="cookie-notice">We use cookies</div><aside>Related</aside>
      <section id="comments"><p>Nice {0}!</p></section><footer>&copy; us</footer></body></html>"""
    texts = extract([page.format(i) for i in range(6)])
    for i, t in enumerate(texts):
        assert t == f"Head & {i}\n\nFirst para {i}.\n\nSecond para {i} é\n\nitem {i}"  # motto is template


def test_html_names_do_not_drop_the_article():
    from newsprism.llm.html_extraction import extract

    page = '''<html class="has-nav"><body class="single-post no-sidebar" style="visibility:hidden"><div class="site-nav">Home {0}</div>
      <article class="hentry comments-open"><div class="post-header"><h1 class="header">Head {0}</h1></div>
      <section id="discussion"><h2 id="search">Search {0}</h2><p id="legal">Legal {0}</p></section>
      <p title="the hidden side" aria-hidden="false" data-class="ad">Titled {0}</p><p hidden>Unseen {0}</p>
      <div class="Ad-Box">Buy {0}</div><div class="x widget">W {0}</div><div role="search">Find {0}</div>
      <p class="share-line">Tell <span class="share-button">Share</span> {0}</p><div class="legal">Same</div></article></body></html>'''
    for n in (1, 6):
        for i, t in enumerate(extract([page.format(i) for i in range(n)])):
            same = ["Same"] if n == 1 else []
            tell = f"Tell Share {i}" if n == 1 else f"Tell {i}"
            assert t.split("\n\n") == [f"Head {i}", f"Search {i}", f"Legal {i}", f"Titled {i}", tell, *same]


def test_html_frames_left_out_end_tags_and_depth():
    from newsprism.llm.html_extraction import DEPTH, extract

    text = lambda i: " ".join(f"w{(i * 31 + j * 7) % 997}" for j in range(30))
    for n in (1, 5):
        want = [f"H {i}\n\n{text(i)}" for i in range(n)]
        body = [f"<h1>H {i}</h1><p>{text(i)}</p>" for i in range(n)]
        # the end tag of the head may be left out, and its start tag too
        assert extract([f"<html><head><title>T{i}</title><meta a=b><body>{b}</body></html>" for i, b in enumerate(body)]) == want
        assert extract([f"<head><link x><title>T{i}</title>{b}" for i, b in enumerate(body)]) == want
        # forms and named parts around the page
        for frame, end in (('<form id="aspnetForm"><input name=a><select><option>x</select>', "<button>Go</button></form>"),
                           ("<div class=widget>", "</div>"), ("<div class=modal><div class='overlay box'>", "</div></div>")):
            assert extract([f"<body>{frame}{b}{end}</body>" for b in body]) == want
            assert extract([f"<body>{frame}<div>Top {i}</div><article>{b}</article>{end}</body>" for i, b in enumerate(body)]) == want
        # but comments and cards stay out, however long
        assert extract([f"<body><article>{b}</article><section id=comments><article class=comment><p>{text(i + 9) * 3}</p>"
                        f"</article></section><form><label>Name</label><p>Say it</p></form></body>" for i, b in enumerate(body)]) == want
        assert extract([f"<body><div>{b}</div><div class=comments><p>{text(i + 9) * 3}</p></div></body>" for i, b in enumerate(body)]) == want
        menu = [f'<article>{b}<div class="menu-list"><p>The menu {i}: soup</p></div><div class=menu><a>Home {i}</a></div></article>'
                for i, b in enumerate(body)]
        assert extract(menu) == [f"{w}\n\nThe menu {i}: soup" for i, w in enumerate(want)]
    # dropped elements inside a line
    line = "<p>One <script>x()</script>sentence <svg><path/></svg>and <button>b</button>more<p>Two"
    assert extract([line]) == ["One sentence and more\n\nTwo"]
    # at any depth elements end and are dropped
    for depth in (210, DEPTH - 1, DEPTH, 4 * DEPTH):
        deep = "<div>" * depth + "<nav>Home</nav>a<p>deep <b>text</b></p>b<ul><li>more<li>and</ul>" + "</div>" * depth
        assert extract([f"<body><p>top</p>{deep}<div>end</div>"] * 2) == ["top\n\na\n\ndeep text\n\nb\n\nmore\n\nand\n\nend"] * 2


def test_html_varying_slots_choose_the_content():
    from newsprism.llm.html_extraction import extract

    text = lambda i, k: " ".join(f"w{(i * 31 + j * 7 + k * 13) % 997}" for j in range(40))
    card = lambda i: f'<article><h3>Card {i % 3}</h3><p>More of card {i % 3}</p></article>'
    page = ("<html><body><div class=text><h1>Head {0}</h1><p>{1}</p><p>{2}</p></div>{3}"
            "<article>The same for all</article></body></html>")
    pages = [page.format(i, text(i, 0), text(i, 1), card(i) + card(i + 1)) for i in range(12)]
    assert extract(pages) == [f"Head {i}\n\n{text(i, 0)}\n\n{text(i, 1)}" for i in range(12)]
    main = [p.replace("<div class=text>", "<main>").replace("</div>", "</main>") for p in pages]
    assert extract(main) == extract(pages)
    # most of the text in the article: the tag decides
    page = "<body><div>Teaser {0}</div><article><h1>Head {0}</h1><p>{1}</p></article></body>"
    assert extract([page.format(i, text(i, 2)) for i in range(6)]) == [f"Head {i}\n\n{text(i, 2)}" for i in range(6)]
    assert extract([page.format(1, text(1, 2))]) == [f"Head 1\n\n{text(1, 2)}"]


def test_simple_tree_matching_weighs_whole_subtrees():
    from newsprism.llm.html_extraction import Slot, align, match, parse

    def same(page, label):
        slot = Slot("#root")
        align(slot, [parse(page)], {}, True)
        return [c for c in slot.children if c.label == label]

    def node(page):
        return [c for c in parse(page).children]

    deep = "<div><p><b><i>x</i><u>y</u></b></p></div>"
    slots = same(f"{deep}", "div")
    # equal labels one level down; only deeper nodes tell which div is the partner
    assert match(slots, [("div", node("<div><p><em>x</em></p></div>")), ("a", []), ("div", node(deep))]) == [(0, 2)]
    # what the slot holds stands in the fifth sibling only
    more = "<div><s>q</s></div>" * 4 + deep
    assert match(slots, [("div", node("<div><p>x</p></div>")), ("a", []), ("div", node(more))]) == [(0, 2)]


def test_html_copies_are_told_by_content():
    from newsprism.llm.html_extraction import extract

    rng = random.Random(9)
    page = "<html><title>{2}</title><body><div>Motto of the house</div><div id=top>Plain {3}</div><div><p>{0}</p><p>{1}</p></div></body></html>"
    text = lambda n: " ".join(f"w{rng.randint(0, 999)}" for _ in range(n))
    bodies = [(text(30), text(60)) for _ in range(6)]
    assert extract([page.format(*b, "Site", "head") for b in bodies]) == ["\n\n".join(b) for b in bodies]
    assert extract([page.format(f"Story {i}", "Short.", "Site", "head") for i in range(6)]) == [f"Story {i}" for i in range(6)]
    # copies, and versions with a word changed, are one page, whatever their title: nothing is template
    a, b = bodies[0]
    versions = [page.format(a, b.replace(" ", f" v{i} ", 1), f"Site {i}", "head") for i in range(6)]
    assert all(t.split("\n\n")[2] == a for t in extract(versions + [page.format(a, b, "T", "head")] * 3))


def test_html_odd_rows(spark):
    from newsprism.llm.html_extraction import main_text

    rows = [(1, None, None), (2, "http://h/x", None), (3, "http://h/y", ""), (4, "nonsense", "plain <b>text"),
            (None, "http://h/z", "<p>a<p>b"), (5, "http://h/d", "<div>" * 3000 + "deep"), (5, "http://h/d", "<div>" * 3000 + "deep"),
            (6, "http://h/u", "<a \"" * 2000 + "< <p>end"), (7, "http://h/s", "<script>never closed")]
    df = frame(spark, rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "0 as grp", "1 as n")
    got = collections.Counter((r.page_id, r.text) for r in main_text(spark, df).collect())
    assert got[(1, "")] == got[(2, "")] == got[(3, "")] == got[(7, "")] == 1
    assert got[(4, "plain text")] == 1 and got[(None, "a\n\nb")] == 1 and got[(5, "deep")] == 2
    assert main_text(spark, df.limit(0)).count() == 0


def test_html_groups_do_not_depend_on_the_table(spark):
    from newsprism.llm import html_extraction as H

    page = "<body><div>Motto of the house</div><p>Story number {0} on host {1}</p></body>"
    rows = [(1000 * n + i, f"http://h{n}.org/{i}", page.format(i, n)) for n in (49, 50, 51, 97) for i in range(n)]
    ddl = "page_id long, url string, html string"
    want = {r[0]: f"Story number {r[0] % 1000} on host {r[0] // 1000}" for r in rows}
    for hot in (H.HOT_HOSTS, 1):  # with 1, no host is hot, as in a table of many pages
        with pytest.MonkeyPatch.context() as m:
            m.setattr(H, "HOT_HOSTS", hot)
            got = {r.page_id: r.text for r in H.main_text(spark, frame(spark, rows, ddl)).collect()}
        assert got == want
    # one hash for all pages: read GROUP_PAGES at a time, none short
    rows = [(7, "http://one.org/", page.format(i, 1)) for i in range(49)]
    got = [r.text for r in H.main_text(spark, frame(spark, rows, ddl)).collect()]
    assert len(got) == 49 and not any("Motto" in t for t in got)


def test_simple_tree_matching_keeps_labels_and_order():
    from newsprism.llm.html_extraction import Slot, match

    slots = [Slot(x) for x in "abca"]
    assert match(slots, [(x, []) for x in "bca"]) == [(1, 0), (2, 1), (3, 2)]
    assert match(slots, [(x, []) for x in "cb"]) in ([(1, 1)], [(2, 0)])
    assert match([], [("a", [])]) == []


# ------------------------------------------------------------------- op2, op4
def labels_frame(spark, rows):
    return frame(spark, rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name,column,threshold", [
    ("op2_quality_classifier", "quality", 0.5), ("op4_toxicity", "toxic", 0.7)])
def test_classifiers_on_held_out_rows(spark, name, column, threshold):
    sf = "/root/testdata/sf0.01"
    got = Q.QUERIES[name](spark, sf).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert ((got.score >= threshold).astype(int) == got.predicted).all()
    crc = [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    assert got.held_out.tolist() == crc
    m = got[got.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert (m[column] == m.predicted).mean() >= 0.95


@pytest.mark.parametrize("module,function", [("quality", "score_quality"), ("toxicity", "score_toxicity")])
def test_classifiers_odd_rows(spark, module, function):
    score = getattr(__import__(f"newsprism.llm.{module}", fromlist=["x"]), function)
    df = frame(spark, ODD).selectExpr("*", "0 as quality", "1 as y", "2 as h", "'z' as score")
    for labels in ([], [(1, 1, 1), (2, 0, 0)], [(4, 1, 1), (5, 0, 0), (6, None, None), (7, 1, 0), (8, 0, 1), (None, 1, 1), (99, 7, 7)]):
        got = score(spark, df, labels_frame(spark, labels)).toPandas()
        assert len(got) == len(ODD) and got.score.between(0, 1).all()
        assert not got[got.doc_id.isna()].held_out.any()
        same = got[got.doc_id == 6].score.tolist()
        assert same[0] == same[1]
    assert score(spark, df.limit(0), labels_frame(spark, [])).count() == 0


def test_forward_backward_equals_enumeration():
    from itertools import product

    from newsprism.llm.toxicity import marginals

    rng = np.random.default_rng(1)
    e, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    chain, at = np.array([0, 0, 0, 0, 1, 1, 1]), np.array([0, 1, 2, 3, 0, 1, 2])
    p, pairs = marginals(e, chain, at, trans, pairs=True)
    want, total = np.zeros(7), np.zeros((2, 2))
    for lo, hi in ((0, 4), (4, 7)):
        z = 0.0
        part, cnt = np.zeros(7), np.zeros((2, 2))
        for y in product((0, 1), repeat=hi - lo):
            w = np.exp(sum(e[lo + i] * v for i, v in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += w
            for i, v in enumerate(y):
                part[lo + i] += w * v
            for a, b in zip(y, y[1:]):
                cnt[a, b] += w
        want += part / z
        total += cnt / z
    assert np.allclose(p, want) and np.allclose(pairs, total)


def test_forward_backward_over_whole_documents():
    from newsprism.llm.toxicity import CHAIN, chains, joined, marginals

    rng = np.random.default_rng(2)
    sizes = [1, 5, CHAIN, CHAIN + 1, 3 * CHAIN, 700, 2]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    e, trans = rng.normal(size=len(doc)) * 3, np.array([[1.5, -2.0], [-1.0, 2.0]])
    whole = np.concatenate([np.arange(n) for n in sizes])  # each document as one chain
    want, total = marginals(e, doc, whole, trans, pairs=True)
    chain, at = chains(doc)
    assert at.max() < CHAIN
    p, pairs = marginals(e, chain, at, trans, pairs=True, goes_on=joined(doc, at))
    assert np.allclose(p, want) and np.allclose(pairs, total)
    assert np.allclose(total.sum(), len(doc) - len(sizes))
    # a span keeps its marginals wherever it stands
    span = np.array([-4.0] * 30 + [3.0, -0.5, -0.5, 3.0] + [-4.0] * 30)
    for shift in range(0, CHAIN, 7):
        d = np.zeros(shift + len(span), int)
        p = marginals(np.concatenate([np.full(shift, -4.0), span]), *(c := chains(d)), trans, goes_on=joined(d, c[1]))
        assert np.allclose(p[shift + 30 : shift + 34], want_span := p[shift + 30 : shift + 34] if shift == 0 else want_span)


def test_quality_fit_equals_plain_dual_descent():
    """The fit against a dense support vector machine on log-count-scaled indicators, solved to the end."""
    from newsprism.llm.quality import PENALTY, fit

    rng = np.random.default_rng(4)
    places, n = 60, 240
    y = (rng.random(n) < 0.3).astype(int)
    odds = np.where(np.arange(places) % 2, 0.15, 0.35)
    x = (rng.random((n, places)) < np.where(y[:, None] == 1, odds, odds[::-1])).astype(float)
    x[:, 0] = 1
    model = fit([np.flatnonzero(r).astype(np.uint32) for r in x], y)
    train = np.arange(n) % 4 != 0
    a, t = x[train], y[train]
    p, q = np.ones(len(model["w"])), np.ones(len(model["w"]))
    p[:places] += a[t == 1].sum(0)
    q[:places] += a[t == 0].sum(0)
    ratio = (np.log(p / p.sum()) - np.log(q / q.sum()))[:places]
    z = np.hstack([a * ratio / np.sqrt(a.sum(1, keepdims=True)), np.ones((len(a), 1))])
    sign = np.where(t == 1, 1.0, -1.0)
    cost = np.where(t == 1, PENALTY * n / (2 * y.sum()), PENALTY * n / (2 * (1 - y).sum()))

    def loss(w):
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - sign * (z @ w))).sum()

    alpha, w = np.zeros(len(a)), np.zeros(places + 1)
    for _ in range(3000):  # plain dual coordinate descent, row after row
        for i in range(len(a)):
            new = min(max(0.0, alpha[i] - (sign[i] * (z[i] @ w) - 1) / (z[i] @ z[i])), cost[i])
            w += (new - alpha[i]) * sign[i] * z[i]
            alpha[i] = new
    dual = alpha.sum() - 0.5 * w @ w
    assert loss(w) - dual < 1e-3 * loss(w)  # solved
    own = np.append(model["w"][:places] / ratio, model["bias"])
    assert loss(own) <= 1.05 * loss(w)
    assert np.corrcoef(z @ own, z @ w)[0, 1] > 0.99


# ------------------------------------------------------------------- op3
def cut_brute(docs, length=50):
    """doc_id -> (bytes, removed, spans, digest of the rest)."""
    first, out = {}, {}
    for i, text in sorted(docs, key=lambda r: r[0]):
        b = (text or "").encode()
        hit = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if first.setdefault(b[p : p + length], i) < i:
                hit[p] += 1
                hit[p + length] -= 1
        m = np.cumsum(hit)[:-1] > 0
        spans = int((m[1:] & ~m[:-1]).sum() + (m[0] if len(m) else 0))
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        out[i] = (len(b), int(m.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def cut_rows(df):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return {r[0]: tuple(r[1:]) for r in df.select(*cols).toPandas().itertuples(index=False)}


def test_substrings_equal_brute_force(spark, docs):
    got = cut_rows(Q.op3_suffix_array_dedup(spark, SF))
    assert got == cut_brute(list(zip(docs.doc_id, docs.text)))


def test_substrings_edges(spark):
    from newsprism.llm.substring_dedup import removed_spans

    rng = random.Random(5)
    base = "".join(rng.choice("abé ") for _ in range(400))
    rows = [(1, base), (2, base[100:160]), (3, base[100:148]), (4, "zz" + base[:60] + "yy" + base[30:90]),
            (5, "ab" * 300), (6, "ab" * 90), (7, None), (8, ""), (9, base), (10, base[:200] + "Q" + base[200:])]
    rows += [(100 + i, base[i : i + 80] + str(i) * 3) for i in range(0, 90, 7)]  # many with one key
    df = frame(spark, rows).selectExpr("*", "1 as keys", "'s' as sha", "2 as size")
    got = removed_spans(spark, df).toPandas()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()} == cut_brute(rows)
    odd = [(None, base), (20, base), (20, base), (21, base)]
    got = removed_spans(spark, frame(spark, odd)).toPandas()
    n = len(base.encode())
    assert got[got.doc_id.isna() | (got.doc_id == 20)].n_removed.tolist() == [0, 0, 0]
    assert got[got.doc_id == 21].n_removed.tolist() == [n]
    assert removed_spans(spark, frame(spark, [])).count() == 0


def test_substrings_of_one_id_with_several_texts(spark):
    from newsprism.llm.substring_dedup import removed_spans

    rng = random.Random(15)
    base = "".join(rng.choice("abé ") for _ in range(500))
    rows = [(1, base), (2, "x" + base[:120] + "1"), (2, base[300:460] + "2"), (2, base[300:460] + "2"), (2, base), (3, "new" * 30 + base[40:90]),
            (3, "new" * 30 + "q"), (4, "new" * 30 + "q"), (2, None), (2, "short")]
    want = []
    for i, text in sorted(rows, key=lambda r: r[0]):
        want.append((i, *cut_brute([(j, t) for j, t in rows if j < i] + [(i, text)])[i]))
    got = removed_spans(spark, frame(spark, rows).repartition(3)).toPandas()
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got[cols].itertuples(index=False))) == sorted(want)


@pytest.mark.parametrize("most", [3, 60])
def test_keys_of_many_documents_are_split(spark, monkeypatch, most):
    from newsprism.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "SPLIT_DOCS", most)
    line = "this line is common, it stands in half of the documents here, word for word"
    rows = [(i, f"{i} head {i * 7} " + (line if i % 2 else line[:60]) + f" tail {i * 13} of {i}") for i in range(1, 100)]
    assert cut_rows(substring_dedup.removed_spans(spark, frame(spark, rows))) == cut_brute(rows)


def test_split_keys_equal_brute_force(spark, monkeypatch):
    """Keys of very many documents are keyed by their strings; the result is the same."""
    from newsprism.llm import ngram_join, substring_dedup

    monkeypatch.setattr(ngram_join, "HOT_SHARE", 2)
    line = "this very common line is in nearly all of the documents here, word for word"
    rows = [(i, f"{i} head {i * 7} " + line + f" tail {i * 13} of {i}") for i in range(1, 200)]
    got = substring_dedup.removed_spans(spark, frame(spark, rows))
    assert cut_rows(got) == cut_brute(rows)


def test_only_shared_parts_are_sorted(spark, monkeypatch):
    from newsprism.llm import substring_dedup

    rng = random.Random(12)
    letters = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    passage = letters(300)
    texts = [(letters(400) + passage + letters(400)).encode() for _ in range(4)] + [letters(200).encode()]
    got = substring_dedup.shared_ranges(texts, 50)
    assert [t[a:b] for t, (a, b) in zip(texts, got)][4] == b"" and all(a <= 400 and b >= 700 for a, b in got[:4])
    assert all(b - a < 310 for a, b in got[:4])
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 100)
    rows = [(i, t.decode()) for i, t in enumerate(texts)] + [(9, letters(60) + passage[:120] + letters(60) + passage[100:])]
    df = frame(spark, rows)
    assert cut_rows(substring_dedup.removed_spans(spark, df)) == cut_brute(rows)


def test_suffix_array_by_linear_grouping():
    from newsprism.llm.suffix_array import suffix_array

    rng = random.Random(3)
    for _ in range(3000):
        a = rng.choice([1, 2, 3, 6])
        t = [rng.randint(1, a) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    assert suffix_array([1] * 5000 + [0]) == list(range(5000, -1, -1))


# ------------------------------------------------------------------- op5
def test_token_counts_equal_greedy_matching(spark, docs):
    from newsprism.llm.wordpiece import read_ranks

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in Q.op5_token_counts(spark, SF).collect()}
    vocabulary = set(read_ranks(Q.vocabulary_file(Q.BYTE_RANKS)))
    longest = max(map(len, vocabulary))

    def greedy(w):
        n = i = 0
        while i < len(w):
            j = min(len(w), i + longest)
            while w[i:j] not in vocabulary:
                j -= 1
            n, i = n + 1, j
        return n

    for i, text in zip(docs.doc_id, docs.text):
        words = text.encode().split()
        n = sum(greedy((b"" if k == 0 and text.encode().startswith(w) else b" ") + w) for k, w in enumerate(words))
        assert got[i] == (len(words), n)


def test_longest_match_automaton_on_random_vocabularies():
    from newsprism.llm.wordpiece import LongestMatch

    rng = random.Random(9)
    for _ in range(300):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        match = LongestMatch(sorted(pieces))
        for _ in range(20):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
            n = i = 0
            while i < len(w):
                j = len(w)
                while j > i and w[i:j] not in pieces:
                    j -= 1
                if j == i:
                    n = 1
                    break
                n, i = n + 1, j
            assert match.count(w) == n


def test_token_counts_odd_rows(spark):
    from newsprism.llm.wordpiece import count_tokens

    got = count_tokens(frame(spark, ODD).selectExpr("*", "1 as n_tokens"), Q.vocabulary_file(Q.BYTE_RANKS)).toPandas()
    assert len(got) == len(ODD)
    assert got[got.doc_id.isin([1, 2, 3])].n_tokens.tolist() == [0, 0, 0]
    assert got[got.doc_id == 7].n_words.tolist() == [60000]


# ------------------------------------------------------------------- op6
def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.vocabulary_file(Q.WORD_TOKENIZER))
    for key, own in rows.groupby("doc_id"):
        ids = np.array(tok.encode(texts[key] or "", add_special_tokens=False).ids + [1], "<u4")
        own = own.sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        at = 0
        for s, n, crc in zip(own.start, own.length, own.ids_crc32):
            assert s == at and zlib.crc32(ids[s : s + n].tobytes()) == crc
            at += n
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.length.sum() <= 2048
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]


def test_packing_round_trip(spark, docs):
    rows = Q.op6_packing(spark, SF).toPandas()
    check_packing(rows, dict(zip(docs.doc_id, docs.text)))
    total, used = rows.sequence_id.nunique() * 2048, rows.length.sum()
    assert (total - used) / used < 0.05


def test_packing_odd_rows(spark):
    from newsprism.llm.packing import pack

    odd = [r for r in ODD if r != (6, "a b c d e f g h i j")] + [(9, "İstanbul ﬁ <|endoftext|>x don't!? 　é́ 12.5%")]
    df = frame(spark, odd).selectExpr("*", "1 as start", "2 as grp", "3 as length")
    rows = pack(spark, df, tokenizer=Q.vocabulary_file(Q.WORD_TOKENIZER)).toPandas()
    check_packing(rows, dict(odd))
    assert rows[rows.doc_id.isin([1, 2, 3])].length.tolist() == [1, 1, 1]
    assert rows.doc_id.isna().sum() == 1
    assert pack(spark, frame(spark, []), tokenizer=Q.vocabulary_file(Q.WORD_TOKENIZER)).count() == 0


def test_first_fit_decreasing_equals_plain_search():
    from newsprism.llm.packing import first_fit_decreasing

    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 200):
        size = rng.integers(1, 100, n)
        bins, at = first_fit_decreasing(size, 100)
        room, want = [], {}
        for i in np.argsort(-size, kind="stable"):
            k = next((b for b, r in enumerate(room) if r >= size[i]), len(room))
            if k == len(room):
                room.append(100)
            want[i] = (k, 100 - room[k])
            room[k] -= size[i]
        assert [(b, a) for b, a in zip(bins, at)] == [want[i] for i in range(n)]


def test_packing_ids_equal_encoding_whole_texts():
    import unicodedata

    from tokenizers import Tokenizer

    from newsprism.llm.packing import Encoder

    path = Q.vocabulary_file(Q.WORD_TOKENIZER)
    tokenizer, encoder = Tokenizer.from_file(path), Encoder(path)
    rng = random.Random(6)
    pool = [chr(c) for c in range(0x20, 0x3000) if unicodedata.category(chr(c))[0] in "LMNPSZ"]
    pool += list("abcABC019.,!?\"'-)]}") * 40 + [" "] * 400 + ["İ", "İ.", ".", "I", "i̇"] * 60
    pool += ["ß", "ŉ", "ǰ", "ΐ", "ﬁ", "é", "가", "ᄀ", "ᅡ", "ᆨ", "can't"] * 20
    texts = ["BELEDİYESİ.", "ANKARA SERGİSİ, 2024", "İ) İ"] + [
        "".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(20_000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    wrong = [t for t, a, b in zip(texts, encoder.encode(texts), want) if a != b]
    assert wrong == []


# ------------------------------------------------------------------- op7
def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_components_equal_brute_force(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op7_ngram_jaccard_join(spark, SF).collect()}
    assert got == components_brute(list(zip(docs.doc_id, docs.text)))


@pytest.mark.parametrize("docs_a_task", [2000, 7])
def test_jaccard_edited_copies(spark, monkeypatch, docs_a_task):
    from newsprism.llm import ngram_join

    for bound in ("LIST_DOCS", "TASK_ROWS", "GROUP_DOCS", "TASK_TOKENS", "TASK_PAIRS"):
        monkeypatch.setattr(ngram_join, bound, docs_a_task)
    rng = random.Random(2)
    rows = []
    for g in range(6):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([4, 12, 60, 150]))]
        for k in range(rng.choice([1, 5, 40])):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
            rows.append((1000 * g + k, " ".join(w).title()))
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, " "), (9005, "one two"), (9006, "ONE\ttwo")]
    df = frame(spark, rows).selectExpr("*", "1 as n", "2 as id", "3 as token", "4 as component_id")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark, df).collect()}
    assert got == components_brute(rows)


def test_jaccard_pairs_below_the_threshold_are_not_sent():
    """Documents that share half of their tokens pass the length and position filters only."""
    from newsprism.llm.ngram_join import Sketches, listed_pairs, sketch

    rng = np.random.default_rng(9)
    common = np.arange(100, dtype=np.uint64)
    sets = [np.concatenate([common, rng.integers(1000, 1 << 40, 100, dtype=np.uint64)]) for _ in range(60)]
    sets[31] = np.append(sets[30][:190], sets[31][190:])  # one pair is similar
    ids, n = np.arange(60), np.full(60, 200)
    u, v = listed_pairs(ids, ids, n, n - 1, np.full(60, 2), n, Sketches([sketch(x) for x in sets]), 75, 100)
    assert (30, 31) in set(zip(u.tolist(), v.tolist())) | set(zip(v.tolist(), u.tolist()))
    assert len(u) < 60  # of 1770


def test_sketches_bound_the_difference():
    from newsprism.llm.ngram_join import Sketches, sketch

    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 40, 3000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 2, 60, 100, 130, 300, 900, 2500, 2500)]
    sets.append(sets[5][3:])
    u, v = np.triu_indices(len(sets), 1)
    least = Sketches([sketch(x) for x in sets]).differing(u, v)
    true = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(u, v)])
    assert (least <= true).all() and (least[(u == 5) & (v == 9)] == 3).all()
    assert (least[true > 100] > 50).all()


def test_tokens_of_a_document_pack_small():
    from newsprism.llm.ngram_join import _from_planes, planes, token_place

    place = np.arange(1000)
    name = token_place(place, 70_000)
    assert len(set(name.tolist())) == 1000 and (_from_planes(planes(name), np.uint64) == name).all()
    assert not set(name.tolist()) & set(token_place(place, 70_001).tolist())


def test_jaccard_odd_rows(spark):
    from newsprism.llm.ngram_join import jaccard_components, keep_one

    got = jaccard_components(spark, frame(spark, ODD)).toPandas()
    assert len(got) == len(ODD)
    assert got[got.doc_id == 6].component_id.tolist() == [5, 5]
    assert got[got.doc_id.isna()].component_id.isna().all()
    kept = [r.doc_id for r in keep_one(spark, frame(spark, ODD + [(2, "")])).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, 5, 7, 8, None], key=str)
    assert jaccard_components(spark, frame(spark, [])).count() == 0


def test_components_on_random_links(spark):
    from newsprism.llm.graph import components

    rng = random.Random(8)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(230)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 80)] + [(None, 5), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component_id for r in components(spark, frame(spark, links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# ------------------------------------------------------------------- op8
BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def base_spans(text):
    from newsprism.llm.pii import luhn

    out = []
    for kind, pattern in BASE:
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                  "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark, docs):
    got = {r.doc_id: r for r in Q.op8_pii(spark, SF).collect()}
    for i, text in zip(docs.doc_id, docs.text):
        want = base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k, _ in BASE] == [sum(s[0] == k for s in want) for k, _ in BASE]
        assert set(joined.split(",")) - {""} <= set(got[i].spans.split(","))


def test_pii_random_texts_equal_patterns():
    from newsprism.llm.pii import find

    rng = random.Random(1)
    for _ in range(8000):
        x = "".join(rng.choice("a1.@+- (9)b4_%2") for _ in range(rng.randint(0, 60)))
        assert find(x) == base_spans(x)


@pytest.mark.parametrize("text,kind,span", [
    ("write to john dot doe at example dot com now", "email", "john dot doe at example dot com"),
    ("jane [at] mail (dot) example (dot) org!", "email", "jane [at] mail (dot) example (dot) org"),
    ("x ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ y", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("see jоhn@exаmple.com", "email", "jоhn@exаmple.com"),  # two Cyrillic letters
    ("call +one two three four five six seven eight nine zero ok", "phone", "+one two three four five six seven eight nine zero"),
    ("card four one one one 1111 1111 one one one one.", "card", "four one one one 1111 1111 one one one one"),
    ("at ١٩٢.١٦٨.١.١ there", "ip", "١٩٢.١٦٨.١.١"),
])
def test_pii_disguises_map_back_to_the_source(text, kind, span):
    from newsprism.llm.pii import masked, spans_of

    base, spans = spans_of(text)
    assert base == [] and [(k, text[a:b]) for k, a, b in spans] == [(kind, span)]
    assert masked(text) == text.replace(span, f"[{kind.upper()}]")


@pytest.mark.parametrize("text, base, spans, mask", [
    ("pаul.smith@example.com", ["email:2:22"], ["email:0:22", "email:2:22"], "[EMAIL]"),
    ("x pa\u200bul@example.com y", ["email:5:19"], ["email:2:19", "email:5:19"], "x [EMAIL] y"),
    ("one nine two dot one six eight dot zero dot one", [], ["ip:0:47"], "[IP]"),
    ("at 192 [dot]\t168 (punto) 0 [dot] 1", [], ["ip:3:34"], "at [IP]"),
    ("plus four nine one seven two three four five six seven", [], ["phone:0:54"], "[PHONE]"),
    ("to john @ example.com.", [], ["email:3:21"], "to [EMAIL]."),
    ("a dot b dot c dot d dot e dot f at host dot example dot org", [], ["email:0:59"], "[EMAIL]"),
    ("john\n[at]     example (dot)\ncom", [], ["email:0:31"], "[EMAIL]"),
    ("meet me at example.com, point un deux, one two three", [], [], "meet me at example.com, point un deux, one two three"),
    ("mail bob@example.com, or al@b.de [at] home", ["email:5:20", "email:25:32"], ["email:5:20", "email:25:32"],
     "mail [EMAIL], or [EMAIL] [at] home"),
])
def test_pii_transducers_are_chained_and_wider_spans_added(text, base, spans, mask):
    from newsprism.llm.pii import masked, spans_of

    joined = lambda s: [f"{k}:{a}:{b}" for k, a, b in s]
    got = spans_of(text)
    assert (joined(got[0]), joined(got[1]), masked(text)) == (base, spans, mask)


def test_pii_is_linear():
    import time

    from newsprism.llm.pii import spans_of

    for unit in ("а@b.c ", "a @ b.c ", "one dot ", "one two three four x ", " (", "a dot b at ", "[at] ", "a.", "@ "):
        took = []
        for n in (4000, 16000):
            t0 = time.perf_counter()
            spans_of(unit * n)
            took.append(time.perf_counter() - t0)
        assert took[1] < 12 * took[0] + 0.5, unit


def test_pii_leaves_clean_text_and_odd_rows(spark):
    from newsprism.llm.pii import find_pii, mask, spans_of

    for text in ("look at example.com", "five five five one two", "meet at the dot", "1.2.3", "(at) noon", "un deux trois"):
        assert spans_of(text) == ([], [])
    df = frame(spark, ODD).selectExpr("*", "1 as spans", "2 as n_email")
    assert find_pii(df).count() == len(ODD)
    kept = mask(df)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert find_pii(df.limit(0)).count() == 0


# ------------------------------------------------------------------- op9
def test_leaks_equal_containment(spark, docs):
    got = {(r.doc_id, r.item_id) for r in Q.op9_decontamination(spark, SF).collect()}
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    word = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    want = {(i, k) for i, t in zip(docs.doc_id, docs.text) for k, b in zip(items.item_id, items.text)
            if f" {word(b)} " in f" {word(t)} "}
    assert want and got == want


def test_wand_equals_exhaustive_scores():
    from newsprism.llm.decontamination import Index, words
    from newsprism.llm.common import text_bytes

    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab[: rng.choice([10, 60])]) for _ in range(rng.randint(3, 30)))) for i in range(90)]
    df = collections.Counter(int(h) for _, t in items for h in set(words(*text_bytes(pa.array([t])))[0].tolist()))
    mean = sum(len(t.split()) for _, t in items) / len(items)
    for threshold in (0.3, 0.6, 0.9):
        index = Index(items, {"df": df, "n": len(items), "mean": mean}, 128, threshold)
        for _ in range(60):
            query = sorted(rng.sample(range(len(index.terms)), rng.randint(0, 30)))
            score = np.zeros(len(items))
            for t in query:
                own, imp, _, _ = index.lists[t]
                score[own] += imp
            want = {i: s for i, s in enumerate(score) if s >= threshold - 1e-9}
            got = dict(index.search(query))
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_leaks_odd_rows_and_edited_copies(spark):
    from newsprism.llm.decontamination import clean, find_leaks

    rng = random.Random(7)
    text = lambda n: " ".join(f"t{rng.randint(0, 3000)}" for _ in range(n))
    item = text(18).capitalize() + ". " + text(10).capitalize() + "."
    long = text(400)
    w = item.split()
    w[5], w[20] = "changed", "also"
    rows = ODD + [(50, text(300) + " " + item.upper() + "%% " + text(300)), (51, text(80) + " " + " ".join(w)),
                  (52, text(500)), (53, long), (54, " ".join(item.split()[:9]))]
    bench = [(1, item), (1, item), (2, None), (3, ""), (4, long), (None, "never here at all in any of them")]
    b = frame(spark, bench, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as df")
    df = frame(spark, rows).selectExpr("*", "5 as item_id", "6 as score")
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark, df, b).collect()}
    assert got == {(50, 1), (51, 1), (53, 4)}
    left = clean(spark, df, b)
    assert left.columns == df.columns and left.count() == len(rows) - 3
    assert find_leaks(spark, df.limit(0), b).count() == 0
    assert find_leaks(spark, df, b.limit(0)).count() == 0 and clean(spark, df, b.limit(0)).count() == len(rows)


def test_leaks_of_long_items_need_question_and_answer(spark):
    from newsprism.llm.decontamination import clean, find_leaks

    rng = random.Random(8)
    text = lambda n, v: " ".join(f"{v}{rng.randint(0, 9000)}" for _ in range(n))
    items = {n: text(n - 12, "q").capitalize() + ". " + text(12, "a").capitalize() + "." for n in (129, 258, 1000)}
    w = {n: t.split() for n, t in items.items()}
    rows = [(10 * n + 0, text(200, "x") + " " + t + " " + text(300, "x")) for n, t in items.items()]
    rows += [(10 * n + 1, text(90, "x") + " " + w[n][-1] + " " + text(90, "x")) for n in items]  # the last word
    rows += [(10 * n + 2, text(150, "x") + " " + " ".join(w[n][:-12]) + " " + text(50, "x")) for n in items]  # no answer
    rows += [(10 * n + 3, " ".join(w[n][-110:])) for n in (258, 1000)]  # the answer, little of the question
    rows += [(10 * n + 4, text(777, "x") + " " + " ".join(x for k, x in enumerate(w[n]) if k % 11)) for n in items]
    b = frame(spark, list(items.items()), "item_id long, text string")
    want = {(10 * n + k, n) for n in items for k in (0, 4)}
    assert {(r.doc_id, r.item_id) for r in find_leaks(spark, frame(spark, rows), b).collect()} == want
    assert {r.doc_id for r in clean(spark, frame(spark, rows), b).collect()} == {i for i, _ in rows} - {i for i, _ in want}


@pytest.mark.parametrize("item", [
    "The capital of that far old northern land is which city? ____", "Name the longest river that crosses seven lands! It is the ( ). ( )",
    'He asked who wrote the first book of the nine? "', "?! Which of the seven seas has the most salt in it",
    "Wer schrieb das erste der neun Bücher dort oben? ”", "... ! A single sentence after marks that holds all words. \n\n -- ."])
def test_leaks_of_items_with_a_side_without_words(spark, item):
    from newsprism.llm.decontamination import clean, find_leaks

    b = frame(spark, [(1, item), (2, "other words make up this second item. Fully so.")], "item_id long, text string")
    rows = [(1, "Before it some text. " + item + " And after it some more."), (2, "Nothing of the kind in here."),
            (3, " ".join(re.findall(r"\w+", item)[:3]))]
    got = [(r.doc_id, r.item_id) for r in find_leaks(spark, frame(spark, rows), b).collect()]
    assert got == [(1, 1)] and {r.doc_id for r in clean(spark, frame(spark, rows), b).collect()} == {2, 3}


def test_question_and_answer_of_an_item():
    from newsprism.llm.decontamination import question_and_answer

    assert question_and_answer(" Who? Me. ") == ("Who? ", "Me.")
    assert question_and_answer("Who is it? He is. ( )") == ("Who is it? ", "He is. ( )")
    assert question_and_answer("It is? ____") == ("It is? ____",) * 2
    assert question_and_answer("! It is") == ("! It is",) * 2


# ------------------------------------------------------------------- op10
def near_brute(rows, t=0.98):
    out = {}
    sound = {}
    for i, v, label in rows:
        out[i] = [0, i]
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / np.abs(v).max()
            sound[i] = (label, x / np.sqrt(x @ x))
    root = {i: i for i in out}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in sound.items():
        for j, (b, y) in sound.items():
            if i < j and a == b and len(x) == len(y) and x @ y >= t:
                out[i][0] += 1
                out[j][0] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (n, find(i), find(i) == i) for i, (n, _) in out.items()}


def near_rows(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("cell", [2000, 5])
def test_near_vectors_equal_brute_force(spark, monkeypatch, cell):
    from newsprism.llm import embedding_join

    monkeypatch.setattr(embedding_join, "CELL_ROWS", cell)
    monkeypatch.setattr(embedding_join, "VECTOR_ROWS", cell)
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(6):
            c = rng.normal(size=16)
            for _ in range(rng.integers(1, 12)):
                rows.append((n, (c + rng.normal(size=16) * rng.choice([0, 0.05, 0.14])).tolist(), label))
                n += 1
    rows += [(900, [0.0] * 16, 0), (901, None, 0), (902, [], 0), (903, [float("nan")] * 16, 0), (904, [None] + [1.0] * 15, 0),
             (905, [float("inf")] * 16, 0), (906, [1e-30] * 16, 0), (907, [1e30] * 16, 0), (908, [1.0] * 8, 0)]
    df = frame(spark, rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as grp", "2 as n", "3 as id")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], b) for i, v, b in rows]
    assert near_rows(embedding_join.near_duplicates(spark, df)) == near_brute(rows)


def test_near_vectors_driver_table_and_odd_rows(spark):
    from newsprism.llm.embedding_join import near_duplicates

    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    want = near_brute([(i, v.tolist(), b) for i, v, b in zip(e.vec_id, e.embedding, e.label)])
    assert near_rows(Q.op10_embedding_near_dedup(spark, SF)) == want
    ddl = "vec_id long, embedding array<float>, label int"
    got = near_duplicates(spark, frame(spark, [(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1)], ddl)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == [("3", 0, "3"), ("3", 0, "3"), ("None", 0, "None")]
    assert near_duplicates(spark, frame(spark, [], ddl)).count() == 0


# ------------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, docs):
    import corpus_pipeline as C
    from newsprism.llm.common import stored

    assert C.ORACLE_SQL is None and len(C.STAGES) == 5
    df = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [df]
    for _, stage in C.STAGES:
        steps.append(stored(spark, stage(spark, steps[-1], SF), "stage"))
    assert all(s.columns == df.columns for s in steps[:-1])
    ids = [set(r.doc_id for r in s.select("doc_id").collect()) for s in steps]
    scored = Q.op2_quality_classifier(spark, SF).where("predicted = 1")
    assert ids[1] == {r.doc_id for r in scored.collect()}
    text = dict(zip(docs.doc_id, docs.text))
    comp = components_brute([(i, text[i]) for i in ids[1]])
    assert ids[2] == {i for i in ids[1] if comp[i][1] == i}
    leaks = {r.doc_id for r in Q.op9_decontamination(spark, SF).collect()}
    assert ids[3] == ids[2] - leaks and ids[4] == ids[3]
    from newsprism.llm.pii import masked

    final = {r.doc_id: r.text for r in steps[4].collect()}
    assert all(final[i] == masked(text[i]) for i in ids[4])
    check_packing(steps[5].toPandas(), final)
    assert C.run(spark, SF).count() == steps[5].count()


def test_pipeline_odd_rows(spark):
    import corpus_pipeline as C
    from newsprism.llm.common import stored

    df = frame(spark, [(*r, "en", "s", None) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        df = stored(spark, stage(spark, df, SF), "odd")
    assert "sequence_id" in df.columns
