"""Tokens, token files and packing against the tokenizers library."""
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from guardspark.llm import packing, token_codec, token_counts, tokens
from guardspark.llm.common import Stage
from guardspark.llm.tokens import Pretokens, read_tokenizer

from .conftest import TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def _any_character(rnd):
    """From all planes, with the spaces, quotes and scripts that texts have."""
    kind = rnd.random()
    if kind < 0.3:
        return rnd.choice(" \n\t'sreavmld19!\u2003\u3000\u00a0\u2028\u0085\u2019\u2014\u200d\u0301")
    if kind < 0.7:
        return chr(rnd.randrange(*rnd.choice([(0x80, 0x250), (0x370, 0x530), (0x590, 0xE00), (0x2000, 0x3100), (0x4E00, 0xA000), (0x1F300, 0x1FA00)])))
    point = rnd.randrange(0x110000)
    return chr(point) if not 0xD800 <= point < 0xE000 else "x"


def test_every_character_has_the_library_s_class(library):
    """Each code point between letters, digits and marks of its neighbours."""
    enc = Pretokens(read_tokenizer(PATH))
    points = [c for c in range(0x80, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}? " for c in points[i:i + 200]) for i in range(0, len(points), 200)]
    ids, borders = enc.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:])] == [library(t) for t in texts]


def test_pretokens_equal_the_library(library):
    enc = Pretokens(read_tokenizer(PATH))
    rnd = random.Random(1)
    letters = [chr(i) for i in range(0x250)] + list(" \n\t'sreavmld ") * 20
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += [chr(i) + "a " + chr(i) for i in range(0x250)] + [t or "" for _, t in TEXTS]
    proven = enc.whole_tokens()
    assert len(proven) > 40_000
    texts += ["".join(rnd.choice("'stmdrevl a\n") for _ in range(30)) for _ in range(1000)]
    texts += ["".join(_any_character(rnd) for _ in range(rnd.randint(1, 80))) for _ in range(3000)]
    want = [library(t) for t in texts]
    ids, borders = enc.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:])] == want
    assert enc.count(pa.array(texts), proven).tolist() == [len(x) for x in want]
    enc.count(pa.array([""]), proven)
    assert len(enc.encode(pa.array([], pa.string()))[0]) == 0


def test_a_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 50)
    enc = Pretokens(read_tokenizer(PATH))
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(40)) for _ in range(60)]
    for t in texts:
        assert enc.encode(pa.array([t, ""]))[0].tolist() == library(t)
    assert len(enc.known.h1) < 150


def test_other_tokenizers_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, tok = Pretokens(read_tokenizer(path)), Tokenizer.from_file(path)
    texts = ["Hello there  World", "", "<|endoftext|> x"]
    assert enc.count(pa.array(texts), enc.whole_tokens()).tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts(odd, none, library):
    got = token_counts.token_counts(odd, PATH).collect()
    want = [(d, len((t or "").encode()), len(library(t)), len(library(t)) > 512) for d, t in TEXTS]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(none, PATH).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 1000, 70_001, 300_000])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 50_000).astype(np.uint32)
    freq = token_codec.normalised(np.bincount(ids, minlength=1))
    assert n == 0 or freq.sum() == 1 << token_codec.SCALE_BITS
    coder, lanes = token_codec.Coder(freq), token_codec.lanes_for(n)
    words, states, at = coder.encode(ids, lanes)
    assert (coder.decode(words, states, at, n, lanes) == ids).all()


def test_rans_decodes_from_any_checkpoint():
    ids = np.random.default_rng(5).integers(0, 900, 50_000).astype(np.uint32)
    coder = token_codec.Coder(token_codec.normalised(np.bincount(ids)))
    words, states, at = coder.encode(ids, 16, every=64)
    for i in (0, 3, len(at) - 1):
        lo = i * 64 * 16
        n = min(64 * 16, len(ids) - lo)
        assert (coder.decode(words, states[i:i + 1], at[i:i + 1], n, 16, every=64) == ids[lo:lo + n]).all()


def test_normalised_frequencies_keep_rare_ids():
    counts = np.ones(50_000, np.int64)
    counts[0] = 10 ** 12
    freq = token_codec.normalised(counts)
    assert freq.min() == 1 and freq.sum() == 1 << token_codec.SCALE_BITS
    one = token_codec.normalised(np.array([0, 7]))
    assert one.tolist() == [0, 1 << token_codec.SCALE_BITS]
    ids = np.ones(5000, np.uint32)
    coder = token_codec.Coder(one)
    assert (coder.decode(*coder.encode(ids, 8), 5000, 8) == ids).all()


def test_token_files(spark, odd, none, library, monkeypatch):
    monkeypatch.setattr(token_codec, "BLOCK_IDS", 500)
    path = Stage(spark, "test").path("ids")
    token_codec.write_ids(odd, path, PATH)
    got = [tuple(r) for r in token_codec.document_digests(spark, path).collect()]
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, start = [], 0
    for d, t in order:
        ids = library(t) + [0]
        want.append((d, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    empty = Stage(spark, "test").path("ids")
    token_codec.write_ids(none, empty, PATH)
    assert token_codec.document_digests(spark, empty).count() == 0


def test_damaged_token_file_is_noticed(spark, odd):
    path = Stage(spark, "test").path("ids")
    token_codec.write_ids(odd, path, PATH)
    row = max((r.asDict() for r in spark.read.parquet(f"{path}/blocks").collect()), key=lambda r: len(r["words"]))
    freq = np.frombuffer(bytes(spark.read.parquet(f"{path}/table").first()["freq"]), "<u4").astype(np.int64)
    coder = token_codec.Coder(freq)
    assert len(token_codec.decode_block(coder, row)) == row["n_ids"]
    row["words"] = bytes(row["words"][:-8]) + bytes(8)
    with pytest.raises((ValueError, IndexError)):
        token_codec.decode_block(coder, row)


@pytest.mark.parametrize("kind", ["none", "one", "uniform", "small", "large", "equal"])
def test_plan_places_every_piece_once(kind):
    rng = np.random.default_rng(2)
    lengths = {"none": np.zeros(0, int), "one": np.array([7]), "uniform": rng.integers(1, 2049, 3000),
               "small": rng.integers(1, 40, 5000), "large": rng.integers(1025, 2048, 500), "equal": np.full(1000, 700)}[kind]
    counts = np.bincount(lengths, minlength=packing.CAPACITY + 1)
    plan = packing.plan(counts)
    used = np.zeros_like(counts)
    for times, parts in plan:
        assert sum(a * k for a, k in parts) <= packing.CAPACITY
        for a, k in parts:
            used[a] += times * k
    assert (used == counts).all()
    n = sum(t for t, _ in plan)
    bound = -(-int(lengths.sum()) // packing.CAPACITY)
    assert n <= {"none": 0, "one": 1, "uniform": 1.08 * bound, "small": bound, "large": 500, "equal": 500}[kind]


def test_exact_complements_are_used():
    counts = np.bincount([2000, 48, 1000, 1048, 900, 600, 548, 2048, 700, 500, 448, 400], minlength=2049)
    assert sum(t for t, _ in packing.plan(counts)) == 5


def test_packing(odd, none, library):
    got = packing.pack(odd, PATH).collect()
    want = []
    for d, t in TEXTS:
        ids = library(t) + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(d, p, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, PATH).count() == 0
