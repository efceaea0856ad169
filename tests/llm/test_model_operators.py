"""Classifier, language mixtures, mixing and vector search."""
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from guardspark.llm import cover_tree, language_mix, mixing, quality_model
from guardspark.llm.common import Stage
from guardspark.llm.queries import mixing_levels

from .conftest import TEXTS


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def prose(rnd, n=120):
    return " ".join(rnd.choice("the of and river stone winter garden letter morning quiet walked seemed over light".split()) for _ in range(n)) + "."


def junk(rnd, n=120):
    return " ".join(rnd.choice("BUY!! NOW$$ %%% ### click|| FREE!!!".split()) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(1)
    docs = [(i, junk(rnd) if i % 4 == 0 else prose(rnd)) for i in range(400)]
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int"))


def test_classifier_separates_held_out_rows(labelled):
    docs, labels = labelled
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == 400
    for r in got:
        assert r["held_out"] == (fold(r["doc_id"], 5) == 0)
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["doc_id"] % 4 != 0)


def test_classifier_never_learns_from_the_held_out_fold(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0,
                                                  1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in quality_model.classify(docs, labels).collect()}
    assert a == {r["doc_id"]: r["score"] for r in quality_model.classify(docs, flipped).collect()}


def test_classifier_on_odd_rows(odd, none, labelled, spark):
    got = quality_model.classify(odd, labelled[1].limit(10)).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    no_labels = spark.createDataFrame([(None, None), (1, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality_model.classify(odd, no_labels).collect()} == {0.5}
    assert quality_model.classify(none, labelled[1]).count() == 0


def test_flat_trees_equal_walking_each_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_model.fit(x, y, trees=30)
    b = m.bins(x)

    def walk(row):
        total = m.prior
        for f, c, v in zip(m.feature, m.cut, m.value):
            at = 0
            for _ in range(quality_model.DEPTH):
                at = 2 * at + 1 + int(row[f[at]] > c[at])
            total += v[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in b], m.score(x))
    assert ((m.score(x) > 0.5) == y).mean() > 0.95


def test_statistics_do_not_depend_on_slicing():
    arr = pa.array([t or "" for _, t in TEXTS])
    whole = quality_model.statistics(arr)
    for i in range(len(arr)):
        assert np.allclose(whole[i], quality_model.statistics(arr.slice(i, 1))[0])
    assert np.isfinite(whole).all()


def test_languages_and_mixtures(spark):
    rnd = random.Random(2)
    words = {"en": "the of and river walked through with light".split(), "de": "der die und fluss über straße nicht schön".split(),
             "fr": "le la et rivière où été garçon très".split()}
    text = {k: lambda k=k, n=60: " ".join(rnd.choice(words[k]) for _ in range(n)) for k in words}
    docs = [(i, text[k](), k) for i, k in enumerate(list(words) * 60)]
    docs += [(1000, text["de"](n=40) + " " + text["fr"](n=120), None), (1001, None, "en"), (1002, "123 !!", "de"), (1003, "", None), (None, text["en"](), None)]
    got = {r["doc_id"]: r for r in language_mix.detect(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(docs)
    for d, _, k in docs[:180]:
        assert got[d]["lang_pred"] == k and got[d]["languages"] == 1 and got[d]["held_out"] == (fold(d, 4) == 2)
    assert got[1000]["lang_pred"] == "fr" and got[1000]["languages"] == 2 and 0.6 < got[1000]["score"] < 0.9
    assert [got[i]["lang_pred"] for i in (1001, 1002, 1003)] == ["und"] * 3 and got[1002]["score"] == 0
    assert got[None]["lang_pred"] == "en"


def test_screening_by_slope_loses_no_mixture():
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.full(language_mix.BUCKETS, 0.05), 3).astype(np.float32) + 1e-7
    p /= p.sum(axis=1, keepdims=True)
    c = np.stack([rng.multinomial(400, (w[0] * p[0] + w[1] * p[1] + w[2] * p[2]).astype(float) / (w @ p).astype(float).sum())
                  for w in rng.dirichlet([0.3] * 3, 60)]).astype(np.float32)
    pi, _ = language_mix.infer(c, p)
    full, _ = language_mix.proportions(c, p, np.ones((60, 3), np.float32), 200)
    assert (pi.argmax(axis=1) == full.argmax(axis=1)).mean() > 0.95


def py_em(c, p, rounds=3000):
    """Proportions of one text, cell by cell, to convergence."""
    k = len(p)
    pi = [1.0 / k] * k
    cells = [(j, n) for j, n in enumerate(c) if n]
    for _ in range(rounds):
        new = [0.0] * k
        for j, n in cells:
            mix = sum(pi[i] * p[i][j] for i in range(k))
            for i in range(k):
                new[i] += n * pi[i] * p[i][j] / mix
        total = sum(new)
        new = [x / total for x in new]
        if max(abs(x - y) for x, y in zip(new, pi)) < 1e-10:
            break
        pi = new
    return pi


def test_proportions_equal_a_plain_em():
    rng = np.random.default_rng(6)
    p = rng.dirichlet(np.full(200, 0.2), 3) + 1e-6
    p /= p.sum(axis=1, keepdims=True)
    c = np.stack([rng.multinomial(800, w @ p / (w @ p).sum()) for w in ([0.7, 0.3, 0.0], [0.1, 0.2, 0.7], [1.0, 0.0, 0.0])])
    got, ll = language_mix.proportions(c.astype(float), p, np.ones((3, 3)), 3000)
    want = [py_em(row.tolist(), p.tolist()) for row in c]
    assert np.abs(got - np.array(want)).max() < 1e-4
    assert np.allclose(ll, [sum(n * np.log(np.array(w) @ p[:, j]) for j, n in enumerate(row) if n) for w, row in zip(want, c)], rtol=1e-6)


def test_held_out_languages_are_never_learnt_from(spark):
    """Other languages on all held-out rows, and texts there: same predictions
    for the rest, and a language that only they have is never predicted."""
    rnd = random.Random(3)
    words = {"en": "the of and river walked".split(), "de": "der die und nicht schön".split()}
    docs = [(i, " ".join(rnd.choice(words[k]) for _ in range(40)), k) for i, k in enumerate(["en", "de"] * 60)]
    changed = [(i, t, "xx" if fold(i, 4) == 2 else k) for i, t, k in docs]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_mix.detect(frame(x)).collect()} for x in (docs, changed))
    assert a == b and {x for x, _ in b.values()} == {"en", "de"}


def test_only_the_largest_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(language_mix, "MAX_LANGUAGES", 2)
    docs = [(i, f"{k * 5} {k * 3}", k) for i, k in enumerate(["aa", "bb"] * 30 + ["cc"] * 10)]
    got = language_mix.detect(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} == {"aa", "bb"}


def test_first_split_equals_an_exhaustive_search():
    """Gain of every (statistic, cut) from its definition; and the leaves' values."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5))
    y = (x[:, 3] + 0.3 * rng.normal(size=300) > 0.4).astype(float)
    m = quality_model.fit(x, y, trees=1)
    b, p = m.bins(x), y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    gains = {}
    for f in range(5):
        for cut in range(int(b[:, f].max())):
            left = b[:, f] <= cut
            if min(h[left].sum(), h[~left].sum()) >= quality_model.MIN_HESSIAN:
                gains[f, cut] = sum(g[s].sum() ** 2 / (h[s].sum() + quality_model.L2) for s in (left, ~left))
    best = max(gains.values())
    assert gains[int(m.feature[0, 0]), int(m.cut[0, 0])] == pytest.approx(best) and m.feature[0, 0] == 3
    at = np.zeros(len(y), int)
    for _ in range(quality_model.DEPTH):
        at = 2 * at + 1 + (b[np.arange(len(y)), m.feature[0, at]] > m.cut[0, at])
    for leaf in np.unique(at):
        own = at == leaf
        assert m.value[0, leaf] == pytest.approx(-quality_model.RATE * g[own].sum() / (h[own].sum() + quality_model.L2))


def test_languages_on_odd_rows(odd, none):
    got = language_mix.detect(odd).collect()
    assert len(got) == len(TEXTS) and {r["lang_pred"] for r in got} <= {"en", "de", "und"}
    assert language_mix.detect(none).count() == 0
    nothing = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_mix.detect(nothing).collect()} == {"und"}


def py_fill(budget, children):
    """Shares of (name, weight, capacity) children, in rounds."""
    out, left = {n: 0.0 for n, _, _ in children}, [c for c in children if c[1] > 0 and c[2] > 0]
    rest = min(budget, sum(c for _, _, c in left))
    while left and rest > 0:
        total = sum(w for _, w, _ in left)
        dry = [c for c in left if c[2] * total <= rest * c[1]]
        if not dry:
            return out | {n: rest * w / total for n, w, _ in left}
        for n, _, c in dry:
            out[n], rest = c, rest - c
        left = [c for c in left if c not in dry]
    return out


def py_budgets(supply, target, weights, epochs):
    depth = len(next(iter(supply), ()))
    cap = {p[:i]: sum(n for q, n in supply.items() if q[:i] == p[:i]) * epochs for p in supply for i in range(depth + 1)}
    given = {(): min(target, cap.get((), 0))}
    for i in range(1, depth + 1):
        for parent in {p[:i - 1] for p in supply}:
            kids = sorted({p[:i] for p in supply if p[:i - 1] == parent}, key=str)
            given |= py_fill(given[parent], [(k, weights.get(k, mixing.DEFAULT_WEIGHT), cap[k]) for k in kids])
    return {p: int(given[p] + 1e-6) for p in supply}


@pytest.mark.parametrize("share, epochs", [(0.0, 1), (0.4, 1), (0.9, 2), (3.0, 2), (2.0, 3)])
def test_budget_tables_equal_plain_python(spark, share, epochs):
    rnd = random.Random(int(share * 10) + epochs)
    supply = {(d, x, s): rnd.choice([0, 1, 7, 500, rnd.randint(1, 10_000)])
              for d in ("web", "forum", None) for x in ("en", "de", None) for s in [f"s{i}" for i in range(rnd.randint(1, 40))] + [None]}
    weights = {("web",): 6.0, ("forum",): 0.0, ("web", "en"): 5.0, ("web", "en", "s1"): 40.0, ("absent",): 3.0}
    leaves = spark.createDataFrame([(list(p), n, 1) for p, n in supply.items()], "path array<string>, tokens long, rows long").repartition(3)
    got = mixing.budgets(leaves, share, weights, epochs, 3, Stage(spark, "budgets"))
    assert {tuple(r["path"]): r["given"] for r in got.collect()} == py_budgets(supply, share * sum(supply.values()), weights, epochs)


def test_mixing_of_very_many_sources(spark):
    """A leaf for every document: all that is one row per leaf stays a table."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"),
                                      F.concat(F.lit("host"), "id").alias("source"))
    got = mixing.mix(docs, [F.lit("web"), F.col("source")], mixing.word_tokens(F.col("text")), 0.5, {}, max_epochs=1)
    assert got.count() == 0                       # a leaf's share is half of its one document
    got = mixing.mix(docs, [F.lit("web"), F.col("source")], mixing.word_tokens(F.col("text")), 1.0, {}, max_epochs=1)
    assert got.count() == 60_000


def test_fill_gives_shortages_to_siblings():
    assert py_fill(100, [("a", 1, 10), ("b", 1, 1000), ("c", 2, 1000)]) == {"a": 10, "b": 30, "c": 60}
    assert py_fill(100, [("a", 1, 10), ("b", 0, 50)]) == {"a": 10, "b": 0}
    assert py_fill(0, [("a", 1, 10)]) == {"a": 0}


def test_shortages_reach_ancestors_only_after_siblings():
    supply = {("d0", "en", "s0"): 10, ("d0", "en", "s1"): 500, ("d0", "de", "s2"): 500, ("d1", "en", "s3"): 500}
    got = py_budgets(supply, 400, {}, 1)
    assert got == {("d0", "en", "s0"): 10, ("d0", "en", "s1"): 90, ("d0", "de", "s2"): 100, ("d1", "en", "s3"): 200}
    short = py_budgets({**supply, ("d1", "en", "s3"): 50}, 400, {}, 1)
    assert short[("d1", "en", "s3")] == 50 and sum(short.values()) == 400


def py_mix(docs, share, weights, epochs, seed=mixing.SEED):
    supply = {}
    for _, path, n in docs:
        supply[path] = supply.get(path, 0) + n
    out = []
    for path, budget in py_budgets(supply, share * sum(supply.values()), weights, epochs).items():
        own, e = [d for d in docs if d[1] == path], 0
        while e < epochs and supply[path] and budget >= supply[path]:
            out += [(d[0], e) for d in own]
            budget, e = budget - supply[path], e + 1
        if e == epochs:
            continue
        units = {}
        for d in own:
            h = int(hashlib.md5(f"{seed}|{e}|{'' if d[0] is None else d[0]}".encode()).hexdigest()[:13], 16)
            units.setdefault((h, "" if d[0] is None else str(d[0])), []).append(d)
        for key in sorted(units):
            n = sum(d[2] for d in units[key])
            if n > budget:
                break
            budget -= n
            out += [(d[0], e) for d in units[key]]
    return sorted(out, key=str)


@pytest.mark.parametrize("share,epochs,bucket", [(0.5, 1, 3), (1.4, 3, 2), (5.0, 2, 100), (0.0, 1, 2)])
def test_mixing_matches_plain_python(spark, odd, share, epochs, bucket):
    rnd = random.Random(7)
    extra = spark.createDataFrame([(1000 + i, "w " * rnd.randint(0, 30), rnd.choice(["en", "de", None]), f"src{min(4, rnd.randint(0, 9))}")
                                   for i in range(300)], "doc_id long, text string, lang string, source string")
    docs = odd.select("doc_id", "text", "lang", "source", "path", "h").unionByName(extra, allowMissingColumns=True)
    got = mixing.mix(docs, mixing_levels(), mixing.word_tokens(F.col("text")), share, None, max_epochs=epochs, bucket_rows=bucket)
    flat = docs.select("doc_id", F.array(*mixing_levels()).alias("p"), mixing.word_tokens(F.col("text")).alias("n")).collect()
    want = py_mix([(r[0], tuple(r[1]), r[2]) for r in flat], share, mixing.WEIGHTS, epochs)
    assert sorted(((r[0], r[1]) for r in got.select("_row.doc_id", "epoch").collect()), key=str) == want


def test_mixing_on_an_empty_table(none):
    assert mixing.mix(none, mixing_levels(), mixing.word_tokens(F.col("text"))).count() == 0


def py_topk(vectors, every, k):
    clean = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in clean), default=0)
    clean = [(i, v + [0] * (width - len(v))) for i, v in clean]
    out = []
    for q in sorted({i for i, _ in clean if i % every == 0}):
        best = {}
        for qi, qv in clean:
            if qi == q:
                for i, v in clean:
                    if i != q:
                        s = sum(a * b for a, b in zip(qv, v))
                        best[i] = max(s, best.get(i, s))
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


@pytest.mark.parametrize("shard,block,pivots", [(8192, 4096, 64), (60, 3, 5), (7, 1, 2)])
def test_topk_matches_brute_force(spark, shard, block, pivots):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(6, 12))
    vectors = [(i, [float(x) for x in np.round(centers[i % 6] + rng.normal(scale=0.1, size=12), 2)]) for i in range(500)]
    vectors += [(600 + i, vectors[i][1]) for i in range(30)]                     # ties
    vectors += [(3, vectors[3][1]), (20, vectors[21][1]), (None, vectors[0][1]), (700, None), (701, [1.0, None]),
                (702, [float("nan")] * 12), (703, [float("inf")]), (704, [0.5, -0.5]), (705, []), (800, [0.0] * 12), (801, [3e5] * 12)]
    table = spark.createDataFrame([(i, v, "clash") for i, v in vectors], "vec_id long, embedding array<double>, vec string").repartition(5)
    got = cover_tree.exact_topk(table, every=20, shard_rows=shard, block_queries=block, pivots=pivots)
    assert sorted(map(tuple, got.collect())) == sorted(py_topk(vectors, 20, 10))


def test_topk_with_few_candidates_and_none(spark):
    some = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in cover_tree.exact_topk(some).orderBy("rank").collect()] == [(0, 1, 1, 2097152), (0, 2, 2, 2097152)]
    assert cover_tree.exact_topk(some.where("vec_id < 0")).count() == 0
    assert cover_tree.exact_topk(some.where("vec_id = 0")).count() == 0


def test_large_integers_are_scored_exactly():
    q = np.array([[2 ** 30, 1]], np.int64)
    x = np.array([[2 ** 30, 1], [2 ** 30, 2], [2 ** 30, 0]], np.int64)
    s = cover_tree.DualSearch(np.array([100]), q, np.array([1, 2, 3]), x, np.array([-np.inf]), 2).run()
    assert s.ids.tolist() == [[2, 1]] and s.scores.tolist() == [[2 ** 60 + 2, 2 ** 60 + 1]]


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(1)
    x = np.round(np.concatenate([rng.normal(size=(400, 4)) + c for c in np.eye(4) * 60]) * 100).astype(np.int64)
    seen = []

    def check(node):
        d = np.sqrt(((x[node.rows] - node.center) ** 2).sum(axis=1))
        assert d.max() <= node.radius + 1e-9
        seen.extend(node.rows.tolist() if not node.children else [])
        for c in node.children:
            check(c)

    check(cover_tree.build(x.astype(float)))
    assert sorted(seen) == list(range(len(x)))
    calls = []
    ids = np.arange(len(x))
    search = cover_tree.DualSearch(ids[:20], x[:20], ids, x, np.full(20, -np.inf), 10)
    plain = search.leaves
    search.leaves = lambda a, b: (calls.append(len(a) * len(b)), plain(a, b))
    search.run()
    assert sum(calls) < 0.7 * 20 * len(x)


def test_bounds_hold_for_all_pairs_and_close_regions_on_clusters():
    """No pair of nodes scores above its bound; on tight clusters most pairs
    are ruled out."""
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(30, 32))
    x = np.repeat(centers / np.linalg.norm(centers, axis=1)[:, None], 40, axis=0) + rng.normal(size=(1200, 32)) * 0.02
    x = np.floor(1024 * x).astype(np.int64)
    ids = np.arange(len(x))
    s = cover_tree.DualSearch(ids, x, ids, x, np.full(len(x), -np.inf), 5)
    a, b = cover_tree.build(s.q), cover_tree.build(s.x)
    stack, nodes = [a], []
    while stack:
        n = stack.pop()
        nodes.append(n)
        stack.extend(n.children)
    for n in nodes:
        for m in (b, *b.children):
            assert s.bound(n, m) >= (s.q[n.rows] @ s.x[m.rows].T).max()
    seen = []
    scored = cover_tree.DualSearch.leaves
    s.leaves = lambda qr, xr: (seen.append(len(qr) * len(xr)), scored(s, qr, xr))
    s.run()
    assert sum(seen) < 0.5 * len(s.q) * len(s.x)
    full = (x @ x.T).astype(float)
    full[ids, ids] = -np.inf
    assert (s.scores == np.sort(full, axis=1)[:, ::-1][:, :5]).all()


def test_bins_hold_neighbouring_regions():
    centers = np.arange(8.0)[:, None] * np.ones((1, 3))
    asking = np.array([3, 3, 3, 3, 3, 3, 9, 0])
    bins = cover_tree.region_bins(centers, asking, 6)
    assert sorted(x for x in np.bincount(bins, weights=asking).tolist() if x) == [6, 6, 6, 9] and bins[0] == bins[1]
