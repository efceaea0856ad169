"""Exact top-k against numpy brute force."""
import numpy as np
import pytest

from guardspark.operators import pruned_topk as PT
from guardspark.operators import retrieval as R

from .conftest import SF_SMALL


def _brute(vecs, ids, k, thr):
    m = np.asarray(vecs, dtype=np.float64)
    n = np.einsum("ij,ij->i", m, m)
    s = (m @ m.T) / np.sqrt(np.outer(n, n))
    out = set()
    for qi, q in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (-s[qi, j], ids[j]))[:k]
        for rank, j in enumerate(order):
            if s[qi, j] >= thr:
                out.add((q, ids[j], rank, round(float(s[qi, j]), 9)))
    return out


@pytest.mark.parametrize("shards", [None, 3, 5])
def test_topk_groups(spark, shards):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").limit(120)
    rows = e.collect()
    want = _brute([r.embedding for r in rows], [r.vec_id for r in rows], 7, 0.2)
    hits = R.cosine_topk(e, e, k=7, threshold=0.2, query_id="vec_id", query_vec="embedding", corpus_id="vec_id",
                         corpus_vec="embedding", shards=shards)
    got = {(r.query_id, r.id, r.rank, round(r.score, 9)) for r in hits.collect()}
    assert got == want


def test_ties_break_on_id(spark):
    df = spark.createDataFrame([(i, [1, 0, 0]) for i in range(6)] + [(9, [0, 1, 0])], "id long, v array<int>")
    q = spark.createDataFrame([(100, [1, 0, 0])], "query_id long, v array<int>")
    got = [(r.id, r.rank) for r in R.cosine_topk(q, df, k=3, threshold=0.0, query_vec="v", corpus_vec="v",
                                               shards=2).orderBy("rank").collect()]
    assert got == [(0, 0), (1, 1), (2, 2)]


def test_repeated_ids_give_exactly_k_rows(spark):
    corpus = spark.createDataFrame([(5, [1.0, 0.0], "a"), (5, [1.0, 0.0], "a"), (6, [0.9, 0.1], "b")],
                                   "id long, v array<double>, content string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, v array<double>")
    hits = R.cosine_topk(q, corpus, k=2, query_vec="v", corpus_vec="v", payload=["content"]).collect()
    assert [(h.id, h.content) for h in hits] == [(5, "a"), (5, "a")]


def test_each_query_may_ask_for_its_own_number(spark):
    corpus = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "id long, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0], 2), (2, [1.0, 1.0], 4), (3, [0.0, 1.0], None)], "query_id long, v array<double>, want int")
    hits = R.cosine_topk(q, corpus, k=5, threshold=-1.0, query_vec="v", corpus_vec="v", k_col="want")
    assert {r.query_id: r["count"] for r in hits.groupBy("query_id").count().collect()} == {1: 2, 2: 4, 3: 5}


def test_kernel_memory_is_one_tile():
    """5,000 queries x 20,000 vectors: the product would take 800 MB."""
    import tracemalloc
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(5000, 32)), rng.normal(size=(20_000, 32))
    shard = PT.Shard(np.arange(20_000), c)
    tracemalloc.start()
    got = [shard.search(q[t:t + PT.TILE_QUERIES], 10) for t in range(0, 5000, PT.TILE_QUERIES)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    s = (q[:5] @ c.T) / np.sqrt(np.outer((q[:5] ** 2).sum(1), (c ** 2).sum(1)))
    assert (got[0][1][:50].reshape(5, 10) == np.argsort(-s, axis=1, kind="stable")[:, :10]).all()


def _counts(rng, n, dim, tokens):
    m = np.zeros((n, dim))
    for i in range(n):
        np.add.at(m[i], rng.zipf(1.4, tokens) % dim, 1)
    return m


@pytest.mark.parametrize("signed", [False, True])
def test_blocks_that_cannot_reach_the_kth_score_are_left_out(signed):
    """Ties, copies, zero vectors and floors, against a full sort."""
    rng = np.random.default_rng(4)
    c = _counts(rng, 4000, 256, 30)
    c[1000:2500] = c[5]                       # a hot copy
    c[2600:2620] = 0
    q = np.vstack([_counts(rng, 60, 256, 8), c[5:6], np.zeros((1, 256))])
    if signed:
        c, q = c - 0.25 * (c > 2), q * np.where(rng.random(q.shape) < 0.2, -1, 1)
    ids = rng.permutation(4000)
    for k, floor in ((1, -np.inf), (10, 0.0), (10, 0.6), (5000, 0.2)):
        shard = PT.Shard(ids, c)
        query, got, score = shard.search(q, k, floor)
        qn, cn = (q * q).sum(1), (c * c).sum(1)
        full = PT.scores(q, qn, c, cn)
        for i in range(len(q)):
            order = np.lexsort((ids, -full[i]))[:k]
            want = [(ids[j], full[i, j]) for j in order if full[i, j] >= floor]
            assert [x for x, _ in want] == got[query == i].tolist()
            assert np.allclose([x for _, x in want], score[query == i], rtol=1e-12)
        if k == 1 and not signed:
            assert shard.met < 0.7 * shard.pairs


def test_single_precision_bounds_decide_no_score():
    """Rows that differ by less than float32 can tell, and rows without a score."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=64)
    c = np.vstack([base + 1e-8 * rng.normal(size=(3000, 64)), rng.normal(size=(6000, 64))])
    c[10, 3], c[11, 4] = np.nan, np.inf
    q = np.vstack([base, rng.normal(size=(40, 64)), np.full((1, 64), np.nan)])
    ids = rng.permutation(len(c))
    shard = PT.Shard(ids, c)
    query, got, score = shard.search(q, 10, -1.0)
    s = np.einsum("qd,cd->qc", q, np.where(np.isfinite(c), c, np.nan))
    s = s / np.sqrt((q * q).sum(1)[:, None] * (c * c).sum(1))
    for i in range(len(q) - 1):
        assert np.allclose(np.sort(score[query == i]), np.sort(s[i][~np.isnan(s[i])])[-10:], rtol=1e-12, atol=0)
    assert not (query == len(q) - 1).any() and not {ids[10], ids[11]} & set(got.tolist())


def test_few_pairs_are_scored_in_double_precision(monkeypatch):
    """Unprunable vectors: the exact step sees a small share of all pairs."""
    rng = np.random.default_rng(8)
    c, q, seen = rng.normal(size=(40_000, 64)), rng.normal(size=(512, 64)), []
    exact = PT._exact
    monkeypatch.setattr(PT, "_exact", lambda q, *rest: seen.append(len(q)) or exact(q, *rest))
    PT.Shard(np.arange(len(c)), c).search(q, 10)
    assert sum(seen) < 0.02 * len(q) * len(c)


@pytest.mark.parametrize("kind", [np.int32, np.float32, np.float64])
def test_dense_vectors_are_bounded_once(kind, monkeypatch):
    """A shard whose blocks nearly all reach the k-th score meets its further
    queries without bounds; rows stay in their own type; ties are exact."""
    rng = np.random.default_rng(9)
    c, q = rng.poisson(1.0, (9000, 32)).astype(kind), rng.poisson(0.6, (300, 32)).astype(kind)
    c[50:90], c[100:120], q[7] = c[3], 0, 0
    ids, calls, bounds = rng.permutation(len(c)), [], PT.Shard.bounds
    monkeypatch.setattr(PT.Shard, "bounds", lambda self, unit: calls.append(len(unit)) or bounds(self, unit))
    shard = PT.Shard(ids, c)
    assert shard.m.dtype == kind
    full = PT.scores(*(x for m in (q.astype(float), c.astype(float)) for x in (m, (m * m).sum(1))))
    for k, floor in ((5, 0.3), (40, -1.0), (9500, 0.5)):
        for lo in range(0, len(q), 100):
            query, got, score = shard.search(q[lo:lo + 100], k, floor)
            for i in range(100):
                order = np.lexsort((ids, -full[lo + i]))[:k]
                assert got[query == i].tolist() == [ids[j] for j in order if full[lo + i, j] >= floor]
    assert len(calls) == 1 and shard.wide


def test_own_k_works_out_the_chunks_once(spark, monkeypatch):
    from guardspark.plans import chunk_queries as CQ
    made = []
    monkeypatch.setattr(CQ, "stored", lambda df, name: made.append(name) or df)
    CQ.retrieve_own_k_q(spark, SF_SMALL)
    assert made == ["prompts", "chunks"]


def test_two_models_from_one_factory(spark):
    from pyspark.sql import functions as F

    from guardspark.functions.vectors import model_embeddings

    def factory(i):
        class Constant:
            def embed(self, texts):
                return [[float(j == i) for j in range(3)] for _ in texts]
        return lambda: Constant()

    df = spark.createDataFrame([(str(i),) for i in range(20)], "t string").repartition(2)
    for i in range(3):
        got = df.select(model_embeddings("t", factory(i), 3).alias("v")).distinct().collect()
        assert [list(r.v) for r in got] == [[float(j == i) for j in range(3)]]


def test_format_context_cap(spark):
    hits = spark.createDataFrame([(1, 0, "f", 0, "a" * 300), (1, 1, "g", 1, "b" * 900), (1, 2, "h", 2, "c" * 10)],
                                 "query_id long, rank long, source_file string, chunk_index long, content string")
    qs = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r.query_id: r.context for r in R.format_context(hits, qs, max_length=600).collect()}
    first = "[Source: f, Chunk 0]\n" + "a" * 300
    second = ("[Source: g, Chunk 1]\n" + "b" * 900)[:600 - (len(first) + 2)] + "..."
    assert got[1] == first + "\n\n" + second
    assert got[2] == "No relevant documents found."


class _ProjectionModel:
    """Stand-in for a sentence model: a fixed random projection of byte counts."""

    def __init__(self):
        self.w = np.random.default_rng(0).normal(size=(256, 16))

    def embed(self, texts):
        m = np.zeros((len(texts), 256))
        for i, t in enumerate(texts):
            for b in t.encode("utf-8"):
                m[i, b] += 1
        return m @ self.w


def test_model_embeddings_plug_in(spark):
    import sys

    from pyspark import cloudpickle
    from pyspark.sql import functions as F

    # The stand-in model lives in this test module, which workers cannot
    # import when pytest runs elsewhere; ship it by value.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    from guardspark.functions.vectors import model_embeddings
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    emb = docs.select("doc_id", model_embeddings("text", _ProjectionModel, 16).alias("v"))
    rows = emb.collect()
    model = _ProjectionModel()
    want = {r.doc_id: model.embed([r.text])[0] for r in docs.collect()}
    for r in rows:
        w = want[r.doc_id] / np.linalg.norm(want[r.doc_id])
        assert np.allclose(r.v, w, atol=1e-6)
    hits = R.cosine_topk(emb, emb, k=3, query_id="doc_id", query_vec="v", corpus_id="doc_id", corpus_vec="v")
    assert hits.where(F.col("rank") == 0).count() == len(rows)


def test_one_model_runs_ingest_retrieval_screening_and_the_guarded_job(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    from guardspark.functions.patterns import ATTACK_SEEDS
    from guardspark.functions.vectors import ModelEmbedder
    from guardspark.operators import screen as SCR
    from guardspark.plans import guarded as G
    from guardspark.sources import corpus as C

    e = ModelEmbedder(_ProjectionModel, 16)
    docs = spark.createDataFrame([(i, f"f{i}", f"Document {i} about rivers and stones. " * 3) for i in range(6)],
                                 "doc_id long, source_file string, text string")
    chunks = C.ingest_corpus(docs, embedder=e).cache()
    assert {len(r.vector) for r in chunks.collect()} == {16}
    prompts = spark.createDataFrame([(1, "Document 3 about rivers and stones. " * 3, None), (2, ATTACK_SEEDS[0][1], None)],
                                    "prompt_id long, query string, system_prompt string")
    hits = G.retrieve_for(prompts.where("prompt_id = 1"), chunks, 2, embedder=e).collect()
    assert len(hits) == 2 and hits[0].score > 0.99
    sem = {r.prompt_id: r for r in SCR.semantic_similarity(prompts, "query", e).collect()}
    assert sem[2].sem_score > 0.999999 and sem[2].sem_example == ATTACK_SEEDS[0][1]
    assert all(v > 0 for v in sem[1].sem_per_category.values())
    answers = spark.createDataFrame([(1, "Rivers have stones.")], "prompt_id long, raw_answer string")
    out = {r.prompt_id: r for r in G.guarded_batch(prompts, chunks, answers, embedder=e).collect()}
    assert len(out) == 2 and out[2].blocked


def test_shards_fill_whole_rounds_of_task_slots(spark, monkeypatch):
    slots = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(R, "GROUP_BYTES", 8)
    for n, want in ((slots, slots), (slots + 1, 2 * slots), (2 * slots, 2 * slots)):
        assert R._shards(spark.createDataFrame([(i, [1.0]) for i in range(n)], "id long, v array<double>")) == want


def test_products_of_all_tiles_share_one_buffer(monkeypatch):
    """Also where a later tile is smaller, and after a wider one."""
    rng = np.random.default_rng(5)
    c, q = rng.normal(size=(1000, 8)), rng.normal(size=(70, 8))
    monkeypatch.setattr(PT, "TILE_ROWS", 64)
    for wide in (False, True):
        shard, seen, products = PT.Shard(np.arange(1000), c), [], PT.Shard._products
        monkeypatch.setattr(PT.Shard, "_products", lambda self, u, r: seen.append(products(self, u, r)) or seen[-1])
        shard.wide = wide
        got = [shard.search(part, 3) for part in (q[:40], q)]
        monkeypatch.setattr(PT.Shard, "_products", products)
        assert sum(not np.shares_memory(x, shard.products) for x in seen) <= len(seen) // 2
        s = (q @ c.T) / np.sqrt(np.outer((q * q).sum(1), (c * c).sum(1)))
        want = np.argsort(-s, axis=1, kind="stable")[:, :3]
        assert (got[0][1].reshape(40, 3) == want[:40]).all() and (got[1][1].reshape(70, 3) == want).all()


@pytest.mark.parametrize("rows, dim", [(9000, 64), (1, 64), (1023, 7), (2049, 3)])
def test_counts_are_met_two_in_one(rows, dim, monkeypatch):
    """Exact against a full sort: ties, copies, empty rows and queries, an odd
    number of rows, long texts whose dot products do not fit a half, and
    queries that are no counts."""
    rng = np.random.default_rng(rows)
    c, q = rng.poisson(1.2, (rows, dim)).astype(np.int32), rng.poisson(0.6, (120, dim)).astype(float)
    c[40:90], c[100:120] = c[0], 0
    c[200:230] *= 300
    q[5], q[6], q[7] = 0, q[6] * 4000, q[8]
    ids, packed, products = rng.permutation(rows), [], []
    dots, plain = PT.Packed._dots, PT.Shard._products
    monkeypatch.setattr(PT.Packed, "_dots", lambda self, a, b: packed.append(len(a) * len(b)) or dots(self, a, b))
    monkeypatch.setattr(PT.Shard, "_products", lambda self, a, b: products.append(len(a) * len(b)) or plain(self, a, b))
    shard = PT.Shard(ids, c)
    shard.wide = True
    assert shard.tile == PT.PACKED_QUERIES
    for part in (q, q - 0.25, np.abs(q - 0.25)):
        full = PT.scores(*(x for m in (part, c.astype(float)) for x in (m, (m * m).sum(1))))
        for k, floor in ((5, 0.3), (1, -1.0), (40, -1.0), (rows + 5, 0.5)):
            packed.clear()
            products.clear()
            query, got, score = shard.search(part, k, floor)
            for i in range(len(part)):
                order = np.lexsort((ids, -full[i]))[:k]
                want = [j for j in order if full[i, j] >= floor]
                assert np.allclose(score[query == i], full[i, want], rtol=1e-12)
                if part is q:                            # whole numbers: equal scores are equal
                    assert got[query == i].tolist() == ids[want].tolist()
            if part is not q:
                assert not packed
            elif rows == 9000:
                assert sum(products) < 0.05 * len(q) * rows and sum(packed) < 0.7 * len(q) * rows


def test_packed_dot_products_at_their_limit():
    """2,047 on both sides is the most that fits; more goes another way."""
    sides = np.array([[2047, 0], [0, 1]], np.int32)
    packed = PT.Packed(sides[[0, 0]], np.full(2, 2047.0 ** 2))
    (rows, two, low, high), = packed.parts
    i, j, d = packed.reaching(PT.Packed.queries(np.array([[1.0, 0.0]])), np.array([2047], np.int32), rows, two)
    assert d.tolist() == [2047, 2047] and sorted(j.tolist()) == [0, 1] and i.tolist() == [0, 0]
    assert PT.Packed.fits(np.array([0.0, 1.0, 4.0]), 2046.0 ** 2).tolist() == [True, True, False]
    assert not PT.Packed.fits(np.array([1.0]), 2047.0 ** 2).any()


def test_shards_count_the_bytes_of_their_own_type(spark, monkeypatch):
    monkeypatch.setattr(R, "GROUP_BYTES", 8)
    slots = spark.sparkContext.defaultParallelism
    df = spark.createDataFrame([(i, [1]) for i in range(2 * slots)], "id long, v array<int>")
    assert R._shards(df, "array<int>") == slots and R._shards(df, "array<double>") == 2 * slots


def test_counts_are_met_five_or_six_in_one(monkeypatch):
    """Exact against a full sort, with far fewer products than pairs; norms
    for either field width, and for none."""
    rng = np.random.default_rng(11)
    rows, dim = 20_000, 32
    c, q = rng.poisson(1.0, (rows, dim)).astype(np.int32), rng.poisson(1.0, (700, dim)).astype(float)
    c[7000:14_000] *= rng.integers(4, 9, (7000, 1), np.int32)
    c[14_000:14_040] *= 400
    c[100:300], c[400:410], q[3], q[4], q[5] = c[0], 0, 0, q[4] * 3000, q[6]
    ids, cells, meeting = rng.permutation(rows), [], PT.Packed.meeting
    monkeypatch.setattr(PT.Packed, "meeting", lambda self, a, limits, flags, rows, n, bits, packed: cells.append((n, len(a) * len(packed)))
                        or meeting(self, a, limits, flags, rows, n, bits, packed))
    shard = PT.Shard(ids, c)
    shard.wide = True
    full = PT.scores(*(x for m in (q, c.astype(float)) for x in (m, (m * m).sum(1))))
    for k, floor in ((5, 0.3), (1, -1.0), (60, 0.0)):
        cells.clear()
        query, got, score = shard.search(q, k, floor)
        for i in range(len(q)):
            order = np.lexsort((ids, -full[i]))[:k]
            want = [j for j in order if full[i, j] >= floor]
            assert got[query == i].tolist() == ids[want].tolist() and (score[query == i] == full[i, want]).all()
        assert {n for n, _ in cells} == {5, 6} and sum(x for _, x in cells) < 0.25 * len(q) * rows


@pytest.mark.parametrize("n, bits", PT.FLAGGED)
def test_fields_at_their_limits(n, bits):
    """Each field shows its row at the limit and not below it, whatever the
    others hold; what may not fit is not asked."""
    half = 1 << bits - 1
    for limit, most in ((half, 2 * half - 1), (half, half), (1, half), (0, half - 1)):
        values = np.array([most, limit, max(limit - 1, 0), 0])
        for shift in range(4):
            m = np.roll(np.resize(values, n * PT.STRETCHES), shift).astype(np.int32)[:, None]
            packed = PT.Packed(m, np.full(len(m), 1.0))
            rows = packed.parts[0][0]
            packed.many[0] = n, bits, None
            fields, (limits, fit) = packed.flagged(0, np.array([float(most)]), np.array([float(limit)]), np.array([limit > 0]))
            assert fields[:2] == (n, bits) and fit.all() and (limits == limit).all()
            (i, j), = packed.meeting(np.array([[1.0, 0.0]]), limits, fit, rows, *fields)
            assert sorted(j.tolist()) == np.flatnonzero(m[:, 0] >= limit).tolist() and not i.any()
    for limit, most in ((1, half + 1), (half, 2 * half), (half + 1, 2 * half)):
        assert not PT.Packed.flags(np.array([float(most)]), np.full((1, n), float(limit)), bits).any()


def test_fields_have_their_own_limits():
    """The least norm of each field decides, so hardly a row is scored in vain."""
    rng = np.random.default_rng(2)
    m = rng.poisson(1.0, (600, 16)).astype(np.int32)
    sq = (m * m).sum(1).astype(float)
    packed = PT.Packed(m, sq)
    assert len(packed.parts) > 1
    for at, (rows, _, low, high) in enumerate(packed.parts):
        for n, _ in PT.FLAGGED:
            width, limits = packed.limits(at, n, np.array([2.0]), np.array([True]))
            assert limits[0, 0] == np.ceil(2 * np.sqrt(low)) and width * n >= len(rows) and (np.diff(limits[0]) >= 0).all()
            for f in range(n):
                assert (limits[0, f] <= np.ceil(2 * np.sqrt(sq[rows[f * width:(f + 1) * width]]))).all()


@pytest.mark.parametrize("counts", [True, False])
def test_scores_of_a_first_shard_reach_the_others(spark, monkeypatch, counts):
    """The same rows as from one shard: ties, repeated ids on both sides,
    queries of few or no hits, each query's own k."""
    rng = np.random.default_rng(3)
    c, q = (rng.poisson(0.7, (n, 8)) if counts else rng.normal(size=(n, 8)).round(1) for n in (900, 60))
    c[300:340], c[500:503], q[4] = c[0], 0, 0
    q[5] = 0
    q[5, 0] = 1 if counts else -1
    kind = "array<int>" if counts else "array<double>"
    rows = [(i % 880, [x.item() for x in v]) for i, v in enumerate(c)]
    asks = [(i % 58, [x.item() for x in v], i % 9) for i, v in enumerate(q)]
    corpus = spark.createDataFrame(rows, f"id long, vector {kind}").cache()
    queries = spark.createDataFrame(asks, f"query_id long, vector {kind}, own int").cache()
    for k, threshold in ((4, 0.3), (8, -1.0), (3, 0.97)):
        want = {(r.query_id, r["rank"], r.id, r.score) for r in R.cosine_topk(queries, corpus, k, threshold, shards=1).collect()}
        names, stored = [], R.stored
        monkeypatch.setattr(R, "GROUP_BYTES", 1 << 10)
        monkeypatch.setattr(R, "stored", lambda df, name: names.append(name) or stored(df, name))
        assert {(r.query_id, r["rank"], r.id, r.score) for r in R.cosine_topk(queries, corpus, k, threshold).collect()} == want
        assert names == ["queries", "first"]
        if k == 8:
            own = {(r.query_id, r["rank"], r.id) for r in R.cosine_topk(queries.where("query_id > 1"), corpus, k, threshold, k_col="own").collect()}
            assert own == {(a, b, i) for a, b, i, _ in want if a > 1 and b < a % 9}
        monkeypatch.undo()


def test_known_scores_leave_few_rows_to_score(monkeypatch):
    rng = np.random.default_rng(4)
    c, q = rng.poisson(1.0, (30_000, 32)).astype(np.int32), rng.poisson(1.0, (300, 32)).astype(float)
    full = PT.scores(*(x for m in (q, c.astype(float)) for x in (m, (m * m).sum(1))))
    floors = np.partition(full[:, ::10], -5, axis=1)[:, -5]              # of a tenth of the rows
    exact, scored = PT._exact, []
    monkeypatch.setattr(PT, "_exact", lambda a, *rest: scored.append(len(a)) or exact(a, *rest))
    monkeypatch.setattr(PT.Packed, "first_kth", None)                    # not asked for then
    shard = PT.Shard(np.arange(len(c)), c)
    shard.wide = True
    query, got, score = shard.search(q, 5, floors)
    for i in range(len(q)):
        want = [j for j in np.lexsort((np.arange(len(c)), -full[i]))[:5] if full[i, j] >= floors[i]]
        assert got[query == i].tolist() == want
    assert sum(scored) < 150 * len(q)
