"""Whitening, ranked lexical search and exact top-k search against brute-force versions; the two
searches are also held against their SQL on the smallest driver tables."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from newsprism.llm import queries as Q
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    got, want = Q.QUERIES[name](spark, SF).toArrow(), duck(SF).sql(Q.ORACLE_SQL[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    ok, msg = compare(got.to_pandas(), want.to_pandas())
    assert ok, msg


# ------------------------------------------------------------------ op11
def matrices():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((40, 40))
    q, _ = np.linalg.qr(a)
    yield a @ a.T
    yield q @ np.diag([5.0] * 6 + [5 - 1e-12] * 6 + [1.0] * 28) @ q.T  # clusters of equal eigenvalues
    yield np.diag([3.0, 3, 3, 2, 1])
    yield np.ones((6, 6))
    yield np.array([[2.0]])
    yield np.diag([1e12, 1.0, 1e-2])
    yield np.kron(np.eye(5), [[2.0, 1], [1, 2]])  # a tridiagonal matrix that falls apart


@pytest.mark.parametrize("v", list(matrices()), ids=lambda v: f"{len(v)}x{len(v)}")
def test_eigenvectors(v):
    from newsprism.llm.whitening import leading_eigenvalues, principal_components, sturm_count, tridiagonal

    d, e, q = tridiagonal(v)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    norm = np.abs(v).max() * len(v)
    assert np.allclose(q @ t @ q.T, v, atol=1e-13 * norm) and np.allclose(q.T @ q, np.eye(len(v)), atol=1e-13)
    every = np.linalg.eigvalsh(v)
    x = np.linspace(every[0] - 1, every[-1] + 1, 13) + 0.01234
    assert sturm_count(d, e, x).tolist() == [(every < b).sum() for b in x]
    assert np.allclose(leading_eigenvalues(d, e, len(v)), every[::-1], atol=1e-13 * norm)
    values, z = principal_components(v)
    want = every[::-1][:8]
    assert len(values) == (want > 1e-9).sum()
    assert np.allclose(values, want[: len(values)], atol=1e-13 * norm)
    assert np.allclose(z.T @ z, np.eye(len(values)), atol=1e-12) and np.allclose(v @ z, z * values, atol=1e-13 * norm)


def check_whitening(rows, got):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows], dtype=object)
    n = len(x)
    s = x.sum(0)
    deviation = collections.Counter((i, int(((n * a - s) ** 2).sum())) for (i, _), a in zip(rows, x))
    d = ((n * x - s) / n).astype(float)
    v = d.T @ d / n
    e = np.linalg.eigvalsh(v)[::-1]
    k = int((e[:8] > 1e-9 * e[0]).sum())
    assert len(got) == n * k
    by = collections.defaultdict(list)
    for r in got:
        by[r.component].append(r)
    assert sorted(by) == list(range(1, k + 1))
    white = []
    for c, own in by.items():
        assert collections.Counter((r.vec_id, r.deviation) for r in own) == deviation
        assert {r.n for r in own} == {n} and len({r.identity_error for r in own}) == 1
        assert own[0].identity_error < 1e-10
        assert abs(own[0].explained - e[c - 1] / np.trace(v)) < 1e-12
        if len({i for i, _ in rows}) == n:
            at = {r.vec_id: r.whitened for r in own}
            w = np.array([at[i] for i, _ in rows])
            assert abs(w @ w / n - 1) < 1e-10
            # the projection on an eigenvector: v applied to d'w gives the eigenvalue back
            z = d.T @ w / n
            assert np.allclose(v @ z, z * e[c - 1], atol=1e-9 * e[0] * np.abs(z).max())
            white.append(w)
    if white:
        assert np.allclose(np.array(white) @ np.array(white).T / n, np.eye(k), atol=1e-9)


def test_whitening_against_numpy(spark):
    from newsprism.llm.whitening import whiten

    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(12) * np.arange(1, 13) / 9).astype(np.float32).tolist()) for i in range(300)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], VEC).repartition(5)
    check_whitening(rows, whiten(spark, table).collect())


def test_whitening_odd_rows(spark):
    from newsprism.llm.whitening import whiten

    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -0.25, 1.0]), (2, [0.0, 0.75, -1.0]), (2, [0.0, 0.75, -1.0]), (None, [3.0, 0.1, 0.2]), (4, [9.0, 1.0, 2.0])]
    odd = [(5, None), (6, [nan, 1.0, 2.0]), (7, [inf, 1.0, 2.0]), (8, [1.0, None, 2.0]), (9, []), (10, [1.0, 2.0]),
           (11, [1.0, 2.0, 3.0, 4.0]), (12, [3e38, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in good + odd], VEC)
    table = table.withColumnsRenamed({"label": "component"}).selectExpr("*", "1 as n", "2 as deviation", "'x' as i")
    check_whitening(good, whiten(spark, table).collect())
    for rows in ([], good[:1], good[1:3], odd[:5]):  # nothing, no variance, nothing sound
        got = whiten(spark, spark.createDataFrame([(i, v, 0) for i, v in rows], VEC))
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_exact_sums():
    from newsprism.llm.whitening import centred

    x = np.array([[2**40, 5], [7, -(2**40)]])
    small, large = centred(x, 2, [2**40 + 7, 5 - 2**40]), centred(x, 2**30, [int(v) * 2**30 for v in x[0]])
    assert small[1].tolist() == [sum((2 * int(a) - s) ** 2 for a, s in zip(r, [2**40 + 7, 5 - 2**40])) for r in x]
    assert large[1][0] == 0 and large[1][1] == sum((2**30 * (int(a) - int(b))) ** 2 for a, b in zip(x[1], x[0]))
    assert large[0][1].tolist() == [float(7 - 2**40), float(-(2**40) - 5)]


# ------------------------------------------------------------------ op12
def lexical(docs, items, best=20):
    """Brute force: ``docs`` and ``items`` as (id, text) rows."""
    def words(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)

    held = [(d, collections.Counter(words(t)), len(words(t))) for d, t in docs if words(t)]
    n, total = len(held), sum(h[2] for h in held)
    df = collections.Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c, size in held:
            m = 75 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
                    for w in words(text) if w in c)
            if s > 0:
                scores.append((-s, math.inf if d is None else d))
        for r, (s, d) in enumerate(sorted(scores)[:best]):
            out.append((item, r + 1, None if d == math.inf else d, -s))
    return sorted(out, key=str)


def ranked(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD_DOCS = [(1, None), (2, ""), (3, " .,;\n"), (4, "Word"), (5, "a b c d e, a b"), (6, "a b c d e, a b"), (6, "a b c d e, a b"),
            (None, "a b c Ünï x"), (7, "long " * 60000 + "b"), (8, "x" * 200000 + " İstanbul É é"), (9, "b\x00c\x7fd 12a")]
ODD_ITEMS = [(1, "a WORD b É istanbul"), (1, "a WORD b É istanbul"), (1, "é b b b 12A"), (2, None), (3, ""), (4, "?!"), (None, "long c"),
             (5, "nowhere to be found")]


def test_lexical_odd_rows(spark):
    from newsprism.llm.lexical_search import rank_documents

    docs = spark.createDataFrame([(d, t, 9, 1) for d, t in ODD_DOCS], "doc_id long, text string, score int, item_id int")
    items = spark.createDataFrame([(i, t, 3) for i, t in ODD_ITEMS], "item_id long, text string, doc_id int")
    want = lexical(ODD_DOCS, [(i, t) for i, t in ODD_ITEMS if t is not None])
    assert ranked(rank_documents(spark, docs.repartition(3), items)) == want and len(want) > 10
    assert ranked(rank_documents(spark, docs.limit(0), items)) == []
    assert ranked(rank_documents(spark, docs, items.limit(0))) == []
    assert ranked(rank_documents(spark, docs.where("doc_id < 4"), items)) == []


def test_lexical_slices_ties_and_pruning(spark, monkeypatch):
    from newsprism.llm import lexical_search as L

    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(300)]
    common = 1 / np.arange(1, 301)
    docs = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 90)), p=common / common.sum()))) for i in range(700)]
    docs += [(i + 700, docs[i % 40][1]) for i in range(120)]  # copies: ties at every rank
    items = [(i, " ".join(rng.choice(vocabulary, 12))) for i in range(30)]
    monkeypatch.setattr(L, "SLICE_ITEMS", 7)
    monkeypatch.setattr(L, "CELLS", 500)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ranked(L.rank_documents(spark, frame, spark.createDataFrame(items, "item_id long, text string")))
    assert got == lexical(docs, items)

    # the same index by hand: strata are visited by bound, and not all of them
    held = L.Items(items)
    from newsprism.llm.common import text_bytes
    from newsprism.llm.words import NOT_ALNUM, words

    h, at = words(*text_bytes(pa.array([t for _, t in docs])), NOT_ALNUM)
    own = np.isin(h, held.terms)
    doc = np.repeat(np.arange(len(docs)), np.diff(at))[own]
    key, tf = np.unique(doc * len(held.terms) + np.searchsorted(held.terms, h[own]), return_counts=True)
    n, doc = np.diff(at), key // len(held.terms)
    held.weigh(len(docs), np.bincount(key % len(held.terms), minlength=len(held.terms)))
    ranking = L.Ranking(held, len(docs), int(n.sum()))
    for lo in range(0, len(docs), 205):  # blocks
        part = (doc >= lo) & (doc < lo + 205)
        size = np.bincount(doc[part] - lo, minlength=205)
        ranking.add(np.arange(lo, lo + 205), n[lo : lo + 205], np.concatenate([[0], np.cumsum(size)]),
                    key[part] % len(held.terms), tf[part])
    place = np.arange(len(ranking.item)) - np.searchsorted(ranking.item, ranking.item) + 1
    assert sorted(zip(ranking.item.tolist(), place.tolist(), ranking.doc.tolist(), ranking.score.tolist()), key=str) == got
    assert ranking.visited < ranking.strata


def test_lexical_scores_beyond_doubles():
    from newsprism.llm.lexical_search import Items, Ranking

    text = "q " * 500_000 + "r"
    items = Items([(1, text)])
    df = np.array([1, 9])
    items.weigh(10**9, df)
    assert not items.exact
    ranking = Ranking(items, 10**9, 10**12)
    ranking.add(np.array([3, 4]), np.array([1000, 10]), np.array([0, 2, 3]), np.array([0, 1, 1]), np.array([5, 7, 2]))
    order = {int(t): i for i, t in enumerate(items.terms)}
    from newsprism.llm.common import text_bytes
    from newsprism.llm.words import NOT_ALNUM, words

    q = order[int(words(*text_bytes(pa.array(["q"])), NOT_ALNUM)[0][0])]
    w = [math.floor(1000 * math.log((2 * 10**9 + 2) / (2 * int(df[i]) + 1))) * (500_000 if i == q else 1) for i in (0, 1)]
    impact = lambda tf, m: (10**9 * tf) // (1000 * tf + 12 * m)
    assert ranking.doc.tolist() == sorted([3, 4], key=lambda d: -(w[0] * impact(5, 100) + w[1] * impact(7, 100) if d == 3 else w[1] * impact(2, 75)))
    assert set(ranking.score.tolist()) == {w[0] * impact(5, 100) + w[1] * impact(7, 100), w[1] * impact(2, 75)}


# ------------------------------------------------------------------ op13
def topk(rows, k=10, every=100):
    x = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows]
    out = []
    for a, (i, v) in enumerate(x):
        if i % every:
            continue
        best = sorted((-sum(p * q for p, q in zip(v, w)), j) for b, (j, w) in enumerate(x) if b != a)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], VEC)


def test_topk_odd_rows(spark):
    from newsprism.llm.knn_join import top_inner_products

    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0]), (100, [0.5, -1.0]), (100, [0.5, -1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (200, [0.25]), (9, []),
            (300, [4.0, 4.0, 4.0]), (-100, [-0.001, 0.3]), (11, [0.0, 0.0])] + [(20 + i, [1.0, 2.0, float(i % 3)]) for i in range(30)]
    odd = [(400, None), (500, [nan, 1.0]), (501, [inf, 0.0]), (600, [1.0, None]), (None, [1.0, 1.0]), (700, [3e38, 1.0])]
    table = vectors_frame(spark, good + odd).selectExpr("*", "1 as id", "2 as score", "3 as cell", "4 as x")
    got = top_inner_products(spark, table)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == topk(good)
    for rows in ([], odd, [(1, [1.0])], [(0, [1.0])]):
        assert top_inner_products(spark, vectors_frame(spark, rows)).count() == 0
    few = [(0, [1.0, 1.0]), (100, [2.0, 1.0]), (3, [-1.0, -1.0])]
    assert sorted(tuple(r) for r in top_inner_products(spark, vectors_frame(spark, few)).collect()) == topk(few)


def test_topk_groups_prune_clustered_vectors(spark, monkeypatch):
    from newsprism.llm import knn_join as J

    rng = np.random.default_rng(13)
    centre = rng.standard_normal((12, 8)) * 6
    rows = [(i, (centre[i % 12] + rng.standard_normal(8) / 9).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[0][1]) for i in range(1200)]  # a hot vector
    monkeypatch.setattr(J, "PART_BYTES", 8 * 8 * 150)  # several parts of queries and of candidates
    seen = {}
    plain = J.Groups.__init__

    def spy(self, *args):
        plain(self, *args)
        seen["groups"], seen["open"], seen["counts"] = self.n, self.open, args[-1]
        seen["parts"] = self.query_parts.max(), self.data_parts.max()

    monkeypatch.setattr(J.Groups, "__init__", spy)
    table = vectors_frame(spark, rows).repartition(4)
    got = sorted(tuple(r) for r in J.top_inner_products(spark, table, every=10).collect())
    x = np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64)
    ids = np.array([i for i, _ in rows])
    want = []
    for a in np.flatnonzero(ids % 10 == 0):
        s = x @ x[a]
        order = [b for b in np.lexsort((ids, -s)) if b != a][:10]
        want += [(int(ids[a]), r + 1, int(ids[b]), int(s[b])) for r, b in enumerate(order)]
    assert got == sorted(want)
    assert seen["groups"] >= 4 and min(seen["parts"]) > 1
    # cells that no group needs whole: candidates sent fall short of all times all
    assert (seen["open"] * seen["counts"][None, :]).sum() < 0.7 * seen["groups"] * len(rows)


def test_topk_in_longs(spark):
    from newsprism.llm.knn_join import top_inner_products

    rng = np.random.default_rng(2)
    rows = [(i * 50, (rng.standard_normal(4) * 2e5).astype(np.float32).tolist()) for i in range(40)]
    assert sorted(tuple(r) for r in top_inner_products(spark, vectors_frame(spark, rows)).collect()) == topk(rows)
