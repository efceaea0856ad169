"""Quality rules, line dedup and near-dedup against plain Python."""
import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from guardspark.llm import line_dedup, near_dedup, quality_rules

from .conftest import BASE, TEXTS, rows, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def py_rules(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + j for i, g in enumerate(grams) if g in many for j in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, chars, sym, dup = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    base = n < 20 or 100 * len(covered) > 30 * n
    bad = (base or 10 * sym > n or not 2 * n <= chars <= 15 * n or 2 * len(re.findall("[A-Z]", t)) > chars
           or 2 * t.count("!") > n or dup >= 5 and 10 * dup > 3 * (t.count("\n") + 1))
    return n, chars, sym, dup, len(covered), base, not bad


def test_quality_rules_match_plain_python(odd):
    got = quality_rules.cascade(odd, statistics=True).select(
        "_row.doc_id", "_row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("first_failed").isNull().alias("kept")).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert tuple(r[2:]) == py_rules(r[1]), r[0]


def test_short_circuit_keeps_the_same_documents(odd):
    kept = quality_rules.apply_rules(odd)
    assert kept.columns == odd.columns
    want = sorted((str(d), t) for d, t in TEXTS if py_rules(t)[-1])
    assert sorted((str(r[0]), r[1]) for r in kept.select("doc_id", "text").collect()) == want and want


def test_rule_order_is_by_rejection_per_cost(spark):
    docs = spark.createDataFrame([(i, "# " * 30) for i in range(50)], "doc_id long, text string")
    order = [r.name for r in quality_rules.rule_order(docs)]
    assert order[0] == "symbols" and set(order) == {r.name for r in quality_rules.RULES}


def test_greedy_order_counts_shared_steps_once_and_only_new_rejections():
    rules = {r.name: r for r in quality_rules.RULES}
    picked = [rules[n] for n in ("few_words", "repetition", "symbols", "word_length")]
    cost = {s.name: 100.0 for r in picked for s in r.steps}
    # All that "repetition" rejects is rejected by "symbols" too, at a lower cost.
    judged = [("0110", 30), ("0010", 5), ("1000", 1), ("0001", 2), ("0000", 60)]
    assert [r.name for r in quality_rules.greedy_order(picked, judged, cost)] == ["symbols", "few_words", "word_length", "repetition"]
    # Steps that are built anyway cost nothing.
    free = {s.name for s in rules["repetition"].steps}
    assert quality_rules.greedy_order(picked, [("0100", 1), ("0010", 9)], cost, free)[0].name == "repetition"


def test_statistics_do_not_change_the_verdict(spark, odd):
    plain = quality_rules.cascade(odd).select("_row.doc_id", "_row.text", F.col("first_failed").isNull().alias("k"))
    full = quality_rules.cascade(odd, statistics=True).select("_row.doc_id", "_row.text", F.col("first_failed").isNull().alias("k"))
    assert sorted(map(str, plain.collect())) == sorted(map(str, full.collect()))


def test_quality_rules_on_an_empty_table(none):
    assert quality_rules.apply_rules(none).count() == 0


def py_lines(texts, min_docs=10):
    keys = [[lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for t in texts]
    seen = Counter(k for ks in keys for k in set(ks) if k)
    return [("\n".join(x for x, k in zip((t or "").split("\n"), ks) if seen[k] < min_docs), len(ks),
             sum(seen[k] >= min_docs for k in ks)) for t, ks in zip(texts, keys)]


def test_line_dedup_matches_plain_python(spark):
    texts = TEXTS + [(100 + i, f"Own line {i}\n  Shared LINE É\t\nshared line É\n\nnine {i % 9}" + "\nnine" * (i < 9)) for i in range(12)]
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    got = line_dedup.dedup_lines(docs, out_col="kept")
    assert [c for c in docs.columns if c not in got.columns] == []
    have = sorted((str(r[0]), r[1] or "", r[2], r[3], r[4]) for r in got.select("doc_id", "text", "kept", "_n_lines", "_n_dropped").collect())
    want = sorted((str(d), t or "", *x) for (d, t), x in zip(texts, py_lines([t for _, t in texts])))
    assert have == want and any(x[4] for x in want)


def test_line_dedup_with_a_line_in_every_document(spark):
    docs = spark.createDataFrame([(i, f"everywhere\nown {i}") for i in range(3000)], "doc_id long, text string")
    got = line_dedup.dedup_lines(docs)
    assert got.where(F.col("_kept_text") == F.concat(F.lit("own "), F.col("doc_id"))).count() == 3000


def test_line_dedup_on_an_empty_table(none):
    assert line_dedup.dedup_lines(none).count() == 0


def shingles(text):
    w = [lower(x) for x in WORD.findall(text or "")]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def py_components(texts):
    sets = [(d, shingles(t)) for d, t in texts]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1:]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= 75 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in parent}


def test_near_duplicates_match_brute_force(odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(TEXTS)
    want = py_components(TEXTS)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    by_doc = {d: len(shingles(t)) for d, t in TEXTS if d is not None}
    assert all(r["n_shingles"] == by_doc[r["doc_id"]] for r in got if r["doc_id"] is not None)
    nulls = [(r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is None]
    assert sorted(nulls, key=str) == sorted([(56, 0, False), (0, None, True)], key=str)


def test_large_group_of_variants_matches_brute_force(spark):
    """Variants of one text at similarities around the threshold, with
    copies: no link is lost although members are not all paired."""
    import random
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(70)]
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(60)}"
        texts.append((i, " ".join(w)))
    texts += [(200 + i, texts[i % 7][1]) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == py_components(texts)
    assert len(set(got.values())) > 1


def test_long_chain_of_links_is_one_component(spark):
    w = [f"t{i}" for i in range(400)]
    texts = [(i, " ".join(w[i * 4:i * 4 + 80])) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == py_components(texts)


def test_near_dedup_on_an_empty_table(none):
    assert near_dedup.near_duplicates(none).count() == 0


def test_shingle_hashes_do_not_depend_on_slicing():
    import pyarrow as pa
    arr = pa.array([t or "" for _, t in TEXTS])
    u, first = near_dedup.distinct_shingles(arr, 5)
    for i, (_, t) in enumerate(TEXTS):
        one, f = near_dedup.distinct_shingles(pa.array([t or ""]), 5)
        assert (u[first[i]:first[i + 1]] == one).all() and len(one) == len(shingles(t))


def test_line_dedup_of_hot_copies_and_empty_texts(spark):
    """A third exact copies, a third empty texts: same rows as plain Python,
    and no task of a keyed stage holds the copies."""
    hot = "shared header\n" + BASE + "\nshared header"
    texts = [hot] * 400 + [""] * 300 + [None] * 100 + [f"own line {i}\nshared header\n{i % 7}" for i in range(400)]
    docs = spark.createDataFrame([(i % 1100, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, salt string").repartition(8)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "salt", "_kept_text", "_n_lines", "_n_dropped"]
    want = sorted((str(t), *w) for t, w in zip(texts, py_lines(texts)))
    assert sorted((str(r["text"]), r["_kept_text"], r["_n_lines"], r["_n_dropped"]) for r in got.collect()) == want
    spread = got.select("text", F.spark_partition_id().alias("p")).where(F.col("text") == hot).groupBy("p").count()
    assert spread.count() > 1


def test_distinct_texts_count_their_copies(spark):
    docs = spark.createDataFrame([(i, "a\nb" if i % 2 else None) for i in range(100)] + [(None, "")], "doc_id long, text string")
    rows = line_dedup.distinct_texts(docs.repartition(5)).collect()
    assert sorted((r["copies"], len(r["_k"])) for r in rows) == [(50, 2), (51, 1)]


def test_near_dedup_is_the_same_however_keys_are_worked_on(spark, monkeypatch):
    """One large group of near copies, with every key hot and with none."""
    base = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(base[:i % 30] + [f"x{i}"] + base[i % 30 + 1:])) for i in range(150)]
    texts += [(200 + i, " ".join(f"other{i}-{j}" for j in range(30))) for i in range(40)] + [(300 + i, texts[3][1]) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    want = py_components(texts)
    for every, least in ((1, 1), (1, 20), (64, 10**9)):
        monkeypatch.setattr(near_dedup, "SAMPLED", every)
        monkeypatch.setattr(near_dedup, "HOT_LEAST", least)
        monkeypatch.setattr(near_dedup, "HOT_KEYS", 10**9)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
        assert got == want
