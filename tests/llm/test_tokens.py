import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from waymill.llm import bpe, packing, secrets

from .conftest import texts_of

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library_on_odd_text(library):
    rng, own = random.Random(3), bpe.WordEncoder(PATH, 50)
    letters = "abcXYZ019'sstrevelld.,!#<|>éÉßÄÀİ \u0085 ́Σ中\U0001f600²½ \t\n\x0b\x0c\x1c\x1f ǅȺ\x00"
    for i in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(13))) + "<|endoftext|>" * (i % 50 == 0)
        assert np.frombuffer(own.text(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_digests_equal_the_library(docs, library):
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(docs, PATH).collect()}
    for doc, text in texts_of(docs).items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[doc] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_encode_then_decode(docs, library):
    for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect():
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_codec_of_odd_rows(odd, none):
    assert bpe.digests(odd, PATH).count() == 6
    assert bpe.digests(none, PATH).count() == 0
    assert bpe.encode(none, PATH).columns == ["doc_id", "ids"]


def check_packing(rows, capacity=4096):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing_holds_every_token_once(docs, library):
    rows = packing.best_fit_packed(docs, PATH).collect()
    bins = check_packing(rows)
    own = {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
    for doc, text in texts_of(docs).items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        for i, r in enumerate(sorted(own[doc], key=lambda r: r.piece)):
            piece = np.array(ids[4096 * i : 4096 * (i + 1)], "<u4").tobytes()
            assert (r.piece, r.start, r.length, r.ids_crc32) == (i, 4096 * i, len(piece) // 4, zlib.crc32(piece))
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 4096) + 1


def test_packing_of_odd_rows(odd, none):
    rows = packing.best_fit_packed(odd, PATH).collect()
    assert len(rows) == 6
    assert len(check_packing(rows)) == 1
    assert packing.best_fit_packed(none, PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_keep_lengths_and_search_never_adds_bins(seed):
    rng = random.Random(seed)
    lengths = Counter(rng.randint(1, 100 if seed % 2 else 60) for _ in range(500))
    fit = packing.best_fit(lengths, 100)
    done = packing.search(fit, 100)
    for bins in (fit, done):
        held = Counter()
        for pattern, m in bins.items():
            assert 0 < sum(pattern) <= 100
            for x in pattern:
                held[x] += m
        assert held == lengths
    assert sum(done.values()) <= sum(fit.values())


def test_search_empties_a_bin_that_best_fit_leaves():
    bins = Counter({(60, 30): 1, (50, 20): 1, (40,): 1})
    assert sum(packing.search(bins, 100).values()) == 2


def left(bins, capacity):
    """Pairs of bins that could still exchange, unless no bin can be spared."""
    if sum((capacity - sum(p)) * m for p, m in bins.items()) < capacity:
        return []
    return [(a, b) for a in bins for b in bins if sum(a) >= sum(b) and (a != b or bins[a] > 1) and packing.exchange(a, b, capacity)]


def test_search_reaches_partners_behind_many_that_can_do_nothing():
    lengths = Counter({x: 2 for x in range(1379, 1521)}) + Counter({1340: 3 * 142})
    done = packing.search(packing.best_fit(lengths, 4096), 4096)
    assert sum(x * m for p, m in done.items() for x in p) == sum(x * m for x, m in lengths.items())
    assert left(done, 4096) == []


@pytest.mark.parametrize("seed", range(6))
def test_search_ends_when_no_pair_can_exchange(seed):
    rng = random.Random(seed)
    lengths = Counter(rng.randint(*[(20, 60), (30, 55), (15, 80)][seed % 3]) for _ in range(300))
    fit = packing.best_fit(lengths, 100)
    done = packing.search(fit, 100)
    held = Counter()
    for pattern, m in done.items():
        assert sum(pattern) <= 100
        for x in pattern:
            held[x] += m
    assert held == lengths and sum(done.values()) <= sum(fit.values())
    assert left(done, 100) == []


@pytest.mark.parametrize(("a", "b"), [((60,), (30, 10)), ((50, 30), (45,)), ((50, 30), (15, 10)), ((40, 40), (90,))])
def test_exchange_fills_the_fuller_bin(a, b):
    moved = packing.exchange(a, b, 100)
    if moved:
        assert sorted(a + b) == sorted(moved[0] + moved[1])
        assert sum(a) < sum(moved[0]) <= 100


def test_ranks_of_a_common_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    pieces = spark.createDataFrame([(i, 0, 0, 5 if i % 3 else 9, i) for i in range(100)], packing.PIECE)
    rows = packing.ranked(pieces, 100).collect()
    for length in (5, 9):
        ranks = sorted(r["rank"] for r in rows if r["length"] == length)
        assert ranks == list(range(len(ranks)))


def test_workers_forget_words_before_tasks_of_other_operators():
    path = public_tokenizers.path("word_bpe_49k.json")
    one = bpe.encoder(path)
    ids = one.encode(b"forgotten")
    assert bpe.encoder(path) is one and one.words
    batch = pa.record_batch([pa.array(["some text"])], names=["_text"])
    assert len(list(secrets.made(iter([batch]), 0, [("text", "string", pa.string())], lambda t: (t,)))) == 1
    assert bpe.encoder(path) is not one and not bpe.encoder(path).words
    assert bpe.encoder(path).encode(b"forgotten") == ids
