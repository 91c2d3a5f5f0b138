import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from waymill.llm import hmm

from .conftest import texts_of


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text))


def test_base_scores_and_gain(docs):
    got = {r.doc_id: r for r in hmm.scored(docs, rounds=3).collect()}
    texts = {k: [*words(t), "\n"] for k, t in texts_of(docs).items()}
    counts = Counter(w for k, t in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for k, t in texts.items():
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t)
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(k).encode()) % 7 == 2, len(t), sum(counts[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(odd, none):
    assert hmm.scored(odd, rounds=1).count() == 6
    assert hmm.scored(none, rounds=1).count() == 0


def small_model():
    rng = np.random.default_rng(1)
    emit = np.zeros((hmm.CLASSES, 2))
    emit[:3] = rng.random((3, 2))
    return hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), emit / emit.sum(axis=0))


def test_forward_is_the_sum_over_all_paths():
    from itertools import product

    m, sequence = small_model(), [0, 2, 1, 1, 0]
    total = 0.0
    for path in product(range(2), repeat=5):
        p = m.start[path[0]] * m.emit[sequence[0], path[0]]
        for a, b, x in zip(path, path[1:], sequence[1:], strict=False):
            p *= m.step[a, b] * m.emit[x, b]
        total += p
    got = m.log10(np.array([1, *sequence, 2, 2]), np.array([1, 5, 2]))
    assert got[1] == pytest.approx(math.log10(total))


def test_probabilities_of_all_sequences_sum_to_one():
    from itertools import product

    m = small_model()
    flat = np.array([x for s in product(range(3), repeat=4) for x in s])
    assert (10 ** m.log10(flat, np.full(81, 4))).sum() == pytest.approx(1)


def test_expected_counts_equal_a_plain_forward_backward():
    m, sequences = small_model(), [[0, 1, 2, 2], [1], [2, 0]]
    start, step, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((hmm.CLASSES, 2))
    for s in sequences:
        alpha = [m.start * m.emit[s[0]]]
        for x in s[1:]:
            alpha.append(alpha[-1] @ m.step * m.emit[x])
        beta = [np.ones(2)]
        for x in reversed(s[1:]):
            beta.insert(0, m.step @ (m.emit[x] * beta[0]))
        z = alpha[-1].sum()
        start += alpha[0] * beta[0] / z
        for t, x in enumerate(s):
            emit[x] += alpha[t] * beta[t] / z
            if t:
                step += np.outer(alpha[t - 1], m.emit[x] * beta[t]) * m.step / z
    got = m.expected(np.array([x for s in sequences for x in s]), np.array([4, 1, 2]))
    assert got == pytest.approx(np.concatenate([start, step.ravel(), emit.ravel()]), abs=1e-5)


def test_learning_raises_the_likelihood():
    rng = np.random.default_rng(2)
    flat, lengths = rng.integers(0, 3, 400), np.full(20, 20)
    flat[200:] = np.where(rng.random(200) < 0.8, 2, flat[200:])
    m, last = small_model(), -np.inf
    for _ in range(5):
        m = hmm.Model.of(m.expected(flat, lengths), 2)
        now = m.log10(flat, lengths).sum()
        assert now > last - 1e-6
        last = now


def test_windows_cover_each_token_once():
    owner, size = hmm.windows(np.array([5, 128, 300, 1]), 128)
    assert owner.tolist() == [0, 1, 2, 2, 2, 3]
    assert size.tolist() == [5, 128, 128, 128, 44, 1]
