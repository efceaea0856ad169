"""Property test: every pattern bank on Spark (Java dialect + flags) agrees
with Python ``re`` on random texts built from pattern fragments."""
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from guardspark.functions import patterns as P
from guardspark.functions.regex import java

FRAGMENTS = [
    "ignore", "all", "previous", "instructions", "you", "are", "now", "a", "pirate", "system", ":", "[system]",
    "<|user|>", "###", "dan", "mode", "bypass", "your", "filters", "reveal", "prompt", "\n", " ", "  ", "-", "*",
    "```", "@", "x.com", "555", "123", "4567", "4111", "1111", "sk", "_", "key", "AKIA", "ABCDEFGHIJKLMNOP",
    "10.0", ".5", "192.168", "eyJabcdefghijk", ".", "password", "=", "how to make a bomb", "kill", "people",
    "as you asked", "my real goal is", "I will now ignore", "jailbreak activated", "according to", "section 4",
    "table 2", "2021", "<b>", "</b>", "act as", "pretend to", "override", "é", " ", "ſ", "ǅ",
]

BANKS = [
    ("input", [p for p, _, _ in P.INPUT_SIGNATURES], re.I | re.M),
    ("plain", [p for p, _, _ in P.SENSITIVE_PATTERNS], re.I),
    ("plain", [p for p, _ in P.HARMFUL_PATTERNS + P.MANIPULATION_PATTERNS], re.I),
    ("plain", [p for p, _, _ in P.TRUST_NEGATIVE + P.TRUST_POSITIVE], re.I),
    ("plain", [p for p, _ in P.OVERRIDE_PATTERNS], re.I),
]

texts = st.lists(st.sampled_from(FRAGMENTS), min_size=0, max_size=30).map("".join)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(texts, min_size=1, max_size=20))
def test_banks_agree_with_python(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "id long, t string")
    exprs = []
    for b, (bank, pats, _) in enumerate(BANKS):
        for j, p in enumerate(pats):
            exprs.append(F.regexp_count("t", F.lit(java(p, bank))).alias(f"c{b}_{j}"))
    for r in df.select("t", *exprs).collect():
        for b, (bank, pats, flags) in enumerate(BANKS):
            for j, p in enumerate(pats):
                want = sum(1 for _ in re.finditer(p, r.t, flags))
                assert r[f"c{b}_{j}"] == want, (p, r.t)


SAN_FRAGMENTS = FRAGMENTS + ["[instruction]", "[/instruction]", "<command>", "</command>", "```prompt\n",
                             "<!--", "-->", "/*", "*/", "{#", "#}", "NOTE TO AI:", "SYSTEM ", "\n\n",
                             "you're", "evil", "uncensored", "DISREGARD", "ABOVE", "FORGET ALL"]
san_texts = st.lists(st.sampled_from(SAN_FRAGMENTS), min_size=0, max_size=40).map("".join)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(san_texts, min_size=1, max_size=20))
def test_sanitizer_deletions_agree_with_python(spark, batch):
    from guardspark.operators.scrub import DELETE_JAVA
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "id long, t string")
    outs = [F.regexp_replace("t", jp, "").alias(f"d{j}") for j, (jp, _) in enumerate(DELETE_JAVA)]
    for r in df.select("t", *outs).collect():
        for j, (p, _) in enumerate(P.SANITIZER_DELETE):
            assert r[f"d{j}"] == re.sub(p, "", r.t, flags=re.I | re.S | re.M), (p, r.t)
