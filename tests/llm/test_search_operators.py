"""Lexical search, whitening and decontamination against brute force."""
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from guardspark.llm import fm_index, nra_search, whitening
from guardspark.llm.terms import text_terms

from .conftest import BASE, TEXTS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

ITEMS = [(1, " ".join(f"alpha{i}" for i in range(20, 45))), (2, "one two three"), (3, "ONE, two"), (4, None), (5, " !! "),
         (6, "a b"), (7, "日本語 текст"), (8, "w0 w13 w26 w39"), (9, "x"), (None, "one two three"), (10, "never seen words here"),
         (2, "tail endoftext"), (11, " ".join(f"alpha{i}" for i in range(20, 45)))]


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_terms_are_cut_as_the_pattern_says():
    texts = [t for _, t in TEXTS if t is not None]
    h, starts, ends, first = text_terms(pa.array(texts, pa.string()))
    data = "".join(texts).encode()
    got = [[data[starts[j]:ends[j]].decode() for j in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert [[w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in g] for g in got] == [terms(t) for t in texts]
    same = {}
    for w, x in zip((w for t in texts for w in terms(t)), h.tolist()):
        assert same.setdefault(w, x) == x
    assert len(set(same.values())) == len(same)


@pytest.fixture(scope="module")
def items(spark):
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item", T.StringType())])
    return spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], schema)


# --- ranked search ------------------------------------------------------------

def brute_ranks(docs, asked, k):
    words = [terms(t) for _, t in docs]
    big_n, big_l = sum(1 for w in words if w), sum(map(len, words))
    counts = [Counter(w) for w in words]
    df = Counter(t for c in counts for t in c)
    of = {}
    for i, t in asked:
        of.setdefault(i, Counter()).update(terms(t))
    out = {}
    for i, query in of.items():
        scored = []
        for (doc, _), w, c in zip(docs, words, counts):
            m = 25 + (75 * len(w) * big_n // big_l if big_l else 0)
            s = sum(n * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, n in query.items() if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        for rank, (s, null, doc) in enumerate(sorted(scored)[:k], 1):
            out[i, rank] = (None if null else doc, -s)
    return out


@pytest.mark.parametrize("blocks, shard", [(8 << 20, 1 << 21), (100, 40)])
def test_search_matches_brute_force(odd, items, blocks, shard):
    got = nra_search.ranked_search(odd, items, k=5, block_bytes=blocks, shard_postings=shard).collect()
    assert {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got} == brute_ranks(TEXTS, ITEMS, 5)
    assert len(got) == len({(r["item_id"], r["rank"]) for r in got})


def test_an_item_of_very_many_terms_is_answered_in_parts(monkeypatch):
    """The flags of which list met which document are bounded."""
    monkeypatch.setattr(nra_search, "CELLS", 30)
    from guardspark.llm.nra_search import Shard, _Best
    rng = np.random.default_rng(2)
    term, doc = np.repeat(np.arange(20), 50), np.concatenate([rng.permutation(200)[:50] for _ in range(20)])
    value = rng.integers(1, 50, 1000)
    full = np.zeros(200, np.int64)
    np.add.at(full, doc, value * (term + 1))
    best = _Best(7)
    Shard(np.arange(200) * 3, np.zeros(200, bool), doc, term, value, 20).search(np.arange(20), np.arange(1, 21), best)
    order = np.lexsort((np.arange(200), -full))[:7]
    assert best.rows == [(int(full[i]), False, int(i) * 3) for i in order]


def test_nra_keeps_all_that_can_be_among_the_best():
    rng = np.random.default_rng(5)
    for trial in range(60):
        n, k = int(rng.integers(1, 3000)), int(rng.integers(1, 12))
        full, lists = np.zeros(n, np.int64), []
        for _ in range(int(rng.integers(1, 9))):
            docs = rng.permutation(n)[:int(rng.integers(0, n + 1))]
            value = rng.integers(1, 4 if trial % 2 else 1000, len(docs))
            order = np.argsort(-value, kind="stable")
            lists.append((docs[order], value[order].astype(np.int64)))
            full[docs] += value
        floor = int(rng.integers(0, full.max() + 2)) if trial % 3 == 0 else 0
        kth = max(1, floor, sorted(full.tolist())[-k] if n >= k else 0)
        got, scores = nra_search.nra(lists, n, k, floor)
        assert sorted(got.tolist()) == np.flatnonzero(full >= kth).tolist()
        assert (scores == full[got]).all()


def test_nra_stops_before_the_ends_of_the_lists():
    class Counting(np.ndarray):
        read = 0

        def __getitem__(self, key):
            if isinstance(key, slice):
                Counting.read += len(range(*key.indices(len(self))))
            return super().__getitem__(key)

    n = 200_000
    value = np.concatenate([np.full(20, 10_000), np.ones(n - 20, np.int64)]).astype(np.int64)
    lists = [(np.arange(n).view(Counting), value), (np.roll(np.arange(n), 5).view(Counting), value)]
    nra_search.nra(lists, n, 10)
    assert Counting.read < 10_000


def test_search_on_empty_tables(spark, odd, none, items):
    assert nra_search.ranked_search(none, items).count() == 0
    assert nra_search.ranked_search(odd, items.limit(0)).count() == 0


# --- whitening ------------------------------------------------------------------

def vectors(spark, rows):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                           *(T.StructField(c, T.StringType()) for c in ("x", "n", "component", "m"))])
    return spark.createDataFrame([(i, v, *["clash"] * 4) for i, v in rows], schema)


def brute_whitening(rows, count):
    rows = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in rows}), float)
    n, sums = len(fit), [sum(x) for x in zip(*{tuple(x) for _, x in rows})]
    c = fit - fit.mean(axis=0)
    values, vecs = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:count]
    values, vecs, trace = values[order], vecs[:, order], values.sum()
    out = []
    for i, x in rows:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        w = (np.array(x, float) - np.array(sums) / n) @ vecs / np.sqrt(np.maximum(values, 1e-300))
        out.append((i, dev, w))
    return n, out, values, values / trace


def test_whitening_matches_a_dense_eigensolver(spark):
    rng = np.random.default_rng(7)
    base = (rng.normal(size=(400, 24)) * np.geomspace(3, 0.2, 24)) @ np.linalg.qr(rng.normal(size=(24, 24)))[0]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(None, rows[4][1]), (7, rows[5][1]), (2000, None), (2001, [None] * 24),
                                                           (2002, [float("nan")] * 24), (2003, [float("inf")] * 24), (2004, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, rows).repartition(5)).collect()
    n, want, values, share = brute_whitening([r for r in rows if r[1] and len(r[1]) == 24], 16)
    assert len(got) == 16 * len(want) and {r["n"] for r in got} == {n} == {400}
    mine = sorted(((-1 if r["vec_id"] is None else r["vec_id"]), r["component"], r["deviation"], r["whitened"]) for r in got)
    theirs = sorted(((-1 if i is None else i), c + 1, dev, w[c]) for i, dev, w in want for c in range(16))
    assert [x[:3] for x in mine] == [x[:3] for x in theirs]
    for c in range(1, 17):
        a, b = (np.array([x[3] for x in rows if x[1] == c]) for rows in (mine, theirs))
        b *= np.sign(a @ b)
        assert np.abs(a - b).max() < 1e-6
        assert {r["explained"] for r in got if r["component"] == c}.pop() == pytest.approx(share[c - 1], rel=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_by_rank_and_on_too_little(spark):
    flat = [(i, [float(i % 5), float(i % 5) * 2, 1.0]) for i in range(40)]
    got = whitening.whiten(vectors(spark, flat)).collect()
    assert {r["component"] for r in got} == {1} and {r["n"] for r in got} == {5} and len(got) == 40
    assert abs(got[0]["explained"] - 1) < 1e-12
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (7, 7), (12, 5), (33, 33)):
        f = rng.normal(size=(rank, d)) * np.geomspace(1, 1e-3, d)
        a = f.T @ f
        lower, order = whitening.pivoted_cholesky(a)
        assert lower.shape == (d, rank) and np.allclose(np.triu(lower[:rank], 1), 0)
        assert np.abs(lower @ lower.T - a[np.ix_(order, order)]).max() < 1e-12 * np.abs(a).max() * d
        values, vecs = whitening.components(a)
        assert np.allclose(vecs.T @ vecs, np.eye(rank), atol=1e-11)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-8, atol=1e-14 * values[0])


def test_deviations_are_exact_or_null():
    x = np.array([[10**6, 3], [10**6 + 5, 4]])
    assert whitening.deviations(x, 2, [2 * 10**6 + 5, 7]) == [26, 26]
    assert whitening.deviations(np.array([[1 << 40], [1]]), 1 << 20, [1 << 60])[0] == 0
    assert whitening.deviations(np.array([[1 << 40], [1]]), 1 << 20, [1 << 60])[1] is None


# --- decontamination --------------------------------------------------------------

def brute_contamination(docs, asked, window):
    wins = {}
    for i, t in asked:
        w = terms(t)
        if i is not None and w:
            m = min(window, len(w))
            for p in range(len(w) - m + 1):
                wins.setdefault(tuple(w[p:p + m]), set()).add(str(i))
    out = []
    for doc, t in docs:
        w, hit, names = terms(t), set(), set()
        for m in {len(x) for x in wins}:
            for p in range(len(w) - m + 1):
                if (x := tuple(w[p:p + m])) in wins:
                    hit |= set(range(p, p + m))
                    names |= wins[x]
        out.append((doc, len(w), tuple(sorted(hit)), tuple(sorted(names))))
    return out


def found(df):
    return sorted(((r["doc_id"], r["n_words"], tuple(x for s in r["spans"] for x in range(s["start"], s["end"])), tuple(r["items"]))
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("blocks, piece", [(8 << 20, 1 << 18), (150, 64)])
def test_contamination_matches_brute_force(odd, items, blocks, piece):
    df = fm_index.contamination(odd, items, block_bytes=blocks, piece_words=piece)
    assert found(df) == sorted(brute_contamination(TEXTS, ITEMS, 10), key=str)
    assert all(r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in df.collect())


def test_contamination_of_copies_and_repeats(spark):
    docs = [(i, BASE + " " + "go on and " * 50 + str(i % 3)) for i in range(200)] + [(500, "go on and " * 4000)]
    asked = [(1, "on and go on and go on and go on and"), (2, "alpha3 alpha4"), (3, BASE)]
    df = fm_index.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                                spark.createDataFrame(asked, "item_id long, text string"), piece_words=700)
    assert found(df) == sorted(brute_contamination(docs, asked, 10), key=str)


def test_contamination_without_items_or_documents(spark, odd, none, items):
    rows = fm_index.contamination(odd, items.limit(0)).collect()
    assert len(rows) == len(TEXTS) and not any(r["n_hit"] or r["items"] for r in rows)
    assert fm_index.contamination(none, items).count() == 0


def test_suffix_array_and_index_against_plain_search():
    rng = np.random.default_rng(11)
    for trial in range(40):
        size = int(rng.integers(2, 40))
        texts = [rng.integers(1, 2 + trial % 9, int(rng.integers(1, 60))) for _ in range(size)]
        texts += texts[:size // 2]
        sym = np.concatenate([np.append(t, 0) for t in texts])
        inside = np.concatenate([np.arange(len(t) + 1) for t in texts])
        ends = np.flatnonzero(sym == 0)

        def suffix(p):
            e = ends[np.searchsorted(ends, p)]
            return (*sym[p:e].tolist(), -len(sym) + e)

        sa = fm_index.suffix_array(sym)
        assert sa.tolist() == sorted(range(len(sym)), key=suffix)
        index = fm_index.FMIndex(sym, inside % 4 == 0)
        assert sorted(index.locate(np.arange(len(sym))).tolist()) == list(range(len(sym)))
        patterns = rng.integers(1, 12, (30, 3))
        lengths = rng.integers(1, 4, 30)
        lo, hi = index.search(patterns, lengths)
        for p, n, a, b in zip(patterns, lengths, lo, hi):
            p = p[3 - n:].tolist()
            want = [i for i in range(len(sym) - n + 1) if sym[i:i + n].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
