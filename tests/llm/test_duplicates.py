import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymill.llm import common, exact, jaccard, lines, phrases

from .conftest import texts_of


def test_phrases_equal_brute_force(docs, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(common, "LIST_BYTES", 0)
    rows = {k: t.encode().split() for k, t in texts_of(docs).items()}
    low = {}
    for k, w in sorted(rows.items()):
        for i in range(len(w) - 12):
            low.setdefault(tuple(w[i : i + 13]), k)
    removed = 0
    for r in phrases.deduplicated(docs).collect():
        w = rows[r.doc_id]
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if low[tuple(w[i : i + 13])] < r.doc_id:
                gone[i : i + 13] = [True] * 13
        removed += sum(gone)
        assert (r.n_words, r.n_removed, r.text) == (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    assert removed > 100


def test_phrases_of_odd_rows(odd, none):
    assert phrases.deduplicated(odd).count() == 6
    assert phrases.deduplicated(none).count() == 0


def test_least_of_neighbours():
    x = np.random.default_rng(0).integers(0, 1000, 200).astype(np.uint64)
    for n in (1, 2, 3, 7, 8, 13):
        assert phrases._least(x, n).tolist() == [x[i : i + n].min() for i in range(len(x) - n + 1)]


@pytest.mark.parametrize("seed", range(8))
def test_automata_locate_every_run(seed):
    rng = random.Random(seed)
    words = [w.encode() for w in ("a b" if seed % 2 else "a b c dé e").split()]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [(rng.randrange(10), draw(rng.randrange(13, 40))) for _ in range(30)]
    docs = []
    for _ in range(20):
        _, p = rng.choice(passages)
        docs.append(draw(rng.randrange(30)) + p[rng.randrange(6) : len(p) - rng.randrange(6)] + draw(rng.randrange(30)))
    docs += [[], [b"a"] * 200, list(passages[0][1])]
    numbers, size = [rng.randrange(12) for _ in docs], 13
    gone = [np.zeros(len(d), bool) for d in docs]
    phrases.locate(passages, docs, numbers, gone, size)
    for number, doc, flags in zip(numbers, docs, gone, strict=True):
        held = {tuple(p[i : i + size]) for low, p in passages if low < number for i in range(len(p) - size + 1)}
        want = [False] * len(doc)
        for i in range(len(doc) - size + 1):
            if tuple(doc[i : i + size]) in held:
                want[i : i + size] = [True] * size
        assert flags.tolist() == want


#: Lengths around lanes of eight bytes and around the longest word that is hashed with the others.
SIZES = (1, 2, 7, 8, 9, 15, 16, 17, 31, 56, 57, 63, 64, 65, 66, 300)


def test_words_of_a_block_are_hashed_at_once(monkeypatch):
    rng, one_by_one = random.Random(3), []
    monkeypatch.setattr(phrases, "_ONCE", 100)
    real = phrases.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(phrases.xxhash, "xxh3_64_intdigest", lambda word: one_by_one.append(word) or real(word))
    known = [bytes(rng.choice(b"\x00\x01ab\xc3\xa9\xff") for _ in range(n)) for n in SIZES for _ in range(9)]
    docs = [[rng.choice(known) for _ in range(n)] for n in (0, 1, 400, 0, 12, 13, 700, 0)]
    words = phrases._Words(b"\n".join(b" ".join(d) for d in docs))
    flat = [w for d in docs for w in d]
    assert [words.raw[i:j] for i, j in zip(words.first.tolist(), words.last.tolist(), strict=True)] == flat
    assert np.diff(words.begin).tolist() == [len(d) for d in docs]
    hashes = words.hashes().tolist()
    assert len(set(zip(flat, hashes, strict=True))) == len(set(flat)) == len(set(hashes))
    assert one_by_one and min(map(len, one_by_one)) > 64
    at, doc = words.windows(13)
    assert list(zip(at.tolist(), doc.tolist(), strict=True)) == [(int(words.begin[d]) + i, d) for d, w in enumerate(docs) for i in range(len(w) - 12)]


@pytest.mark.parametrize("raw", [b"", b"\n", b"\n\na", b"a\n\n"])
def test_words_of_texts_without_words(raw):
    words = phrases._Words(raw)
    assert np.diff(words.begin).tolist() == [len(t) for t in raw.split(b"\n")] and len(words.hashes()) == raw.count(b"a")


def test_only_texts_with_a_seed_are_split():
    class Text(bytes):
        def split(self, *how):
            raise AssertionError("split")

    passage = [b"%d" % i for i in range(20)]
    texts = [Text(b" ".join([b"x"] * 50)), b" ".join([b"y", *passage]), Text(b"x"), Text(b"")]
    found = list(phrases.located([(1, passage)], texts, [5, 6, 7, 8], 13))
    assert found[0] is found[2] is found[3] is None and found[1].tolist() == [False] + [True] * 20


def test_phrases_of_words_of_all_lengths(spark):
    rng = random.Random(4)
    known = ["".join(rng.choice("abé\x01\x85") for _ in range(n)) for n in SIZES for _ in range(2)]
    passages = [[rng.choice(known) for _ in range(20)] for _ in range(6)]
    texts = [(i, "\t\n".join([*(rng.choice(known) for _ in range(rng.randrange(9))), *rng.choice(passages)[rng.randrange(4) :], "", "z"])) for i in range(60)]
    rows, low = {k: t.encode().split() for k, t in texts}, {}
    for k, w in rows.items():
        for i in range(len(w) - 12):
            low.setdefault(tuple(w[i : i + 13]), k)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in phrases.deduplicated(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for k, w in rows.items():
        gone = {j for i in range(len(w) - 12) if low[tuple(w[i : i + 13])] < k for j in range(i, i + 13)}
        assert got[k] == (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    assert sum(n for _, n, _ in got.values()) > 500


def test_lists_of_windows_come_back():
    rng = np.random.default_rng(1)
    rows = phrases._windows(rng.integers(0, 1 << 63, 9), rng.integers(0, 1 << 32, 9), rng.integers(-5, 5, 9), np.sort(rng.integers(0, 99, 9)))
    many = rng.random(9) < 0.5
    back, flags = phrases._window_list(phrases._packed(rows, many))
    assert back.tolist() == rows.tolist() and flags.tolist() == many.tolist()


def jaccard_truth(rows, n, percent):
    sets = {}
    for k, t in rows.items():
        w = t.encode().lower().split()
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {k: k for k in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(rows)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize(("n", "percent", "star"), [(4, 85, 4096), (5, 80, 2)])
def test_links_equal_brute_force(docs, monkeypatch, n, percent, star):
    monkeypatch.setattr(jaccard, "STAR", star)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.clustered(docs, n=n, percent=percent).collect()}
    assert got == jaccard_truth(texts_of(docs), n, percent)


@pytest.mark.parametrize("seed", range(5))
def test_signatures_rule_out_no_similar_pair(seed):
    rng = np.random.default_rng(seed)
    base, sets = rng.integers(0, 1 << 63, 3000).astype(np.uint64), []
    for _ in range(60):
        size = int(rng.integers(1, 700)) if rng.random() < 0.7 else int(rng.integers(1, 12))
        own = base[:size].copy()
        change = rng.random(size) < rng.choice([0.0, 0.04, 0.2])
        own[change] = rng.integers(0, 1 << 63, int(change.sum())).astype(np.uint64)
        sets.append(np.unique(own))
    sets.sort(key=len)
    signed = [jaccard.counts_of(jaccard.signature(x), len(x)) for x in sets]
    assert all(int(c.sum()) == len(x) for c, x in zip(signed, sets, strict=True))
    pairs = jaccard.possible([len(x) for x in sets], signed, 85)
    root = list(range(len(sets)))
    for a, b in pairs:
        root = [root[a] if r == root[b] else r for r in root]
    truth = jaccard_truth_sets([set(x.tolist()) for x in sets], 85)
    for i in range(len(sets)):
        for j in range(i):
            assert truth[i] != truth[j] or root[i] == root[j]
    assert len(pairs) < len(sets)
    assert len(set(root)) > 5


def test_runs_keep_all_that_may_be_similar(monkeypatch):
    rng = np.random.default_rng(3)
    for near in (1, 3, 24):
        monkeypatch.setattr(jaccard, "NEAR", near)
        for _ in range(200):
            n = int(rng.integers(2, 12))
            size = np.sort(rng.integers(10, 20, n))
            place = (rng.random(n) * size * 0.4).astype(np.int64)
            keep = jaccard._near(size, place, np.zeros(n, np.int64), np.full(n, n), 85)
            for i in range(n):
                for j in range(n):
                    if i != j and 185 * min(size[i] - place[i], size[j] - place[j]) >= 85 * (size[i] + size[j]):
                        assert keep[i] and keep[j]


def test_lists_of_prefixes_come_back():
    rng = np.random.default_rng(4)
    rows = {int(g): (rng.integers(0, 1 << 63, int(rng.integers(1, 9))).astype(np.uint64), int(g) % 50 + 9) for g in rng.integers(1, 1 << 62, 30)}
    found = [e for x in jaccard._prefixes(rows, 3) for e in zip(*(c.tolist() for c in jaccard._prefix_list(x)), strict=True)]
    assert sorted(e[1:] for e in found) == sorted((g, size, i) for g, (tokens, size) in rows.items() for i in range(len(tokens)))


def test_rows_with_equal_ids_are_told_apart(spark):
    words = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    texts = [(5, 1, " ".join(words)), (5, 2, " ".join([*words, "more"])), (5, 3, "quite another text of more than five words"), (7, 4, " ".join(words)), (5, 9, "")]
    frame = spark.createDataFrame([(i, 0, p, t) for i, p, t in texts], "doc_id long, f long, p long, text string")
    rows = jaccard.clustered(frame, place=("f", "p")).collect()
    assert {(r.doc_id, r.p): (r.component_id, r["first"]) for r in rows} == {(5, 1): (5, True), (5, 2): (5, False), (5, 3): (5, True), (7, 4): (5, False), (5, 9): (5, True)}


def test_links_of_odd_rows(odd, none):
    rows = jaccard.clustered(odd).collect()
    assert len(rows) == 6
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == {(1, 1, None), (None, 1, None), (None, 0, None), (2, 0, 2), (3, 0, 3)}
    assert jaccard.clustered(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_leaders_find_all_components(seed):
    rng = random.Random(seed)
    base, sets = [np.arange(k * 1000, k * 1000 + 60, dtype=np.uint64) for k in range(3)], []
    for _ in range(40):
        own = set(rng.choice(base).tolist())
        for x in rng.sample(sorted(own), rng.randrange(12)):
            own.discard(x)
        own |= {rng.randrange(10**6, 2 * 10**6) for _ in range(rng.randrange(8))}
        sets.append(np.array(sorted(own), np.uint64))
    sets.sort(key=len)
    truth = jaccard_truth_sets([set(s.tolist()) for s in sets], 85)
    got = jaccard.linked(sets, 85)
    assert len({(a, b) for a, b in zip(truth, got, strict=True)}) == len(set(truth)) == len(set(got))


def jaccard_truth_sets(sets, percent):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    return root


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(7, 105)]
    frame = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in links], "a binary, b binary")
    rows = jaccard.components(frame).collect()
    assert {bytes(r.root) for r in rows} == {b"\x00"}
    assert len(rows) == len({bytes(r.node) for r in rows}) == 21 + 30


def test_lines_equal_brute_force(docs):
    rows = texts_of(docs)
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for k, t in rows.items():
        for x in t.split("\n"):
            holders[key(x)].add(k)
    dropped = 0
    for r in lines.deduplicated(docs).collect():
        own = rows[r.doc_id].split("\n")
        kept = [x for x in own if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == r.doc_id]
        dropped += len(own) - len(kept)
        assert (r.n_lines, r.n_dropped, r.text) == (len(own), len(own) - len(kept), "\n".join(kept))
    assert dropped > 5


def test_lines_of_odd_rows(odd, none, spark):
    out = lines.deduplicated(odd)
    assert out.count() == 6
    assert set(odd.columns) | {"n_dropped"} == set(out.columns)
    assert lines.deduplicated(none).count() == 0
    long = "x" * 50
    frame = spark.createDataFrame([(None, long), (None, long), (1, long), (2, long), (3, long), (4, f"{long}\n{long}")], "doc_id long, text string")
    assert sorted(r.n_dropped for r in lines.deduplicated(frame).collect()) == [0, 1, 1, 1, 1, 1]


def test_runs_are_merged_by_levels(spark):
    runs = lines.Runs(4, fanout=2)
    batch = lambda *x: spark.createDataFrame([(bytes([k]), d) for k, d in x], "key binary, doc long")
    new = [sorted((bytes(r.key)[0], r.n, r.holder) for r in runs.add(b).collect()) for b in (batch((1, 9), (1, 8), (2, 9)), batch((1, 7), (3, 7)), batch((3, 6)))]
    assert new == [[(1, 2, 9), (2, 1, 9)], [(1, 1, None), (3, 1, 7)], [(3, 1, None)]]
    assert [len(x) for x in runs.levels] == [1, 1]
    total = {bytes(r.key)[0]: (r.n, r.holder) for r in runs.merged(runs.runs()).collect()}
    assert total == {1: (3, 9), 2: (1, 9), 3: (2, 7)}


def test_exact_equals_brute_force(docs):
    groups = defaultdict(list)
    rows = texts_of(docs)
    bare = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t)
    for k, t in rows.items():
        groups[bare(t)].append((-len(t), k))
    for r in exact.groups(docs, carry=["lang"]).collect():
        own = groups[bare(rows[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept, r.lang) == (min(own)[1], len(own), r.doc_id == min(own)[1], "en")


def test_texts_are_hashed_in_full_only_where_length_and_prefix_are_shared(spark):
    head = "x" * exact.PREFIX
    frame = spark.createDataFrame([(1, head + "a"), (2, head + "b"), (3, head + " a"), (4, head + "abc"), (5, "y" + head), (6, None), (7, "")], "doc_id long, text string")
    sized = frame.select(exact.bare(F.col("text")).alias("b")).select(F.length("b").alias("_size"), F.xxhash64(F.substring("b", 1, exact.PREFIX)).alias("_head"))
    assert sorted(r["_size"] for r in exact.crowded(sized).collect()) == [0, exact.PREFIX + 1]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.d) for r in exact.groups(frame, digest="d").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[3] == (3, 2, True, sha(head + "a")) and got[1][:3] == (3, 2, False)
    assert got[2] == (2, 1, True, sha(head + "b")) and got[4] == (4, 1, True, sha(head + "abc"))
    assert got[6][:3] == (6, 2, True) and got[7][:3] == (6, 2, False)


@pytest.mark.parametrize("hot", [1, 5, 1000])
def test_hot_groups_of_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    frame = spark.createDataFrame([(i, "all the same " + " " * (i % 3)) for i in range(50)] + [(100 + i, f"text {i // 2}") for i in range(60)], "doc_id long, text string")
    rows = exact.groups(frame).collect()
    assert {(r.keep_id, r.group_size) for r in rows if r.doc_id < 50} == {(2, 50)}
    assert all((r.keep_id, r.group_size, r.kept) == (r.doc_id // 2 * 2, 2, r.doc_id % 2 == 0) for r in rows if r.doc_id >= 100)


def test_a_sieve_never_misses(spark):
    frame = spark.range(4000).selectExpr("id", "xxhash64(id) as h")
    seen = common.sifted(frame, F.col("h"), frame.filter("id % 7 = 0").select("h"))
    rows = {r.id: r["_maybe"] for r in seen.select("id", "_maybe").collect()}
    assert len(rows) == 4000 and all(rows[i] for i in range(0, 4000, 7)) and sum(rows.values()) < 600
    kept = common.without(frame, frame.filter("id % 7 = 0"), ["id", "h"])
    assert sorted(r.id for r in kept.collect()) == [i for i in range(4000) if i % 7]
    assert common.without(frame, frame.limit(0), ["id"]).count() == 4000


def test_exact_of_odd_rows(odd, none):
    rows = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.groups(odd).collect()), key=str)
    assert rows == sorted([(1, None, 3, False), (1, None, 3, False), (None, None, 3, True), (None, None, 3, True), (2, None, 3, False), (3, None, 3, False)], key=str)
    assert exact.groups(none).count() == 0


def test_equal_rows_keep_one(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab ")], "doc_id long, text string")
    rows = exact.groups(frame).collect()
    assert sum(r.kept for r in rows) == 1
    assert {(r.keep_id, r.group_size) for r in rows} == {(1, 3)}
