"""A hidden Markov language model.

Hidden states emit word *classes*, of which there is a fixed number whatever the corpus; a class emits its words
by their smoothed counts. A word of at least one FREQUENT-th of all training tokens has a class of its own (by
hash); others share the class of their last letters; the end of a text has its own. So the parameters have a
proven size, while counts cover every distinct word of the corpus and stay in the exchange of `vocabulary`.

Baum-Welch: every training token is in one window of at most WINDOW tokens; each task sums the expected counts
of its windows, and sums are added before the driver normalises them (STATES x CLASSES numbers). Scores are
exact: the scaled forward recursion runs over the whole sequence of a text, end included.

Null text is empty: its sequence is the end alone. Null ids hash as the empty text. Rows with equal ids or texts
are separate documents. An empty table gives an empty result; with no training text at all, every word is
unseen. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import vocabulary as V

STATES = 8
#: A word with one token in this many has its own class.
FREQUENT = 4096
OWN, SHARED = 8192, 4096
END = OWN + SHARED
CLASSES = END + 1
WINDOW = 128
ROUNDS = 5
#: Windows that run through the recursion side by side.
SIDE_BY_SIDE = 4096
#: Partial sums that reach the driver.
SUMS = 16

COUNTED = "kind int, block long, shard int, data binary, classes binary"
_COUNTED = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("data", pa.binary()), ("classes", pa.binary())])
SEQUENCES = "block long, ids array<long>, counts array<int>, classes binary, sums binary"
_SEQUENCES = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("classes", pa.binary()), ("sums", pa.binary())])
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def held_out(doc) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


def _trained(doc) -> bool:
    return not held_out(doc)


def word_class(word: bytes, count: int, total: int) -> int:
    """Class of a word with this count among total training tokens."""
    if count and count * FREQUENT >= total:
        return zlib.crc32(word) % OWN
    return OWN + zlib.crc32(word[-3:]) % SHARED


def _counter(total: int):
    """Adds up the counts of a shard's words over all blocks, and answers every block; then the sums by class."""

    def answer(shard, lists):
        kept, counts = [], defaultdict(int)
        for block, vocab, weights in lists:
            kept.append((block, vocab))
            for w, n in zip(C.unpack(vocab).split(b"\n"), C.unpack(weights, np.uint32).tolist(), strict=True):
                counts[w] += n
        tokens, distinct, classes = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64), {}
        for w, n in counts.items():
            classes[w] = k = word_class(w, n, total)
            tokens[k] += n
            distinct[k] += n > 0
        yield C.rows(_COUNTED, [(1, None, shard, C.pack(tokens), C.pack(distinct))])
        for block, vocab in kept:
            words = C.unpack(vocab).split(b"\n")
            n = np.fromiter(map(counts.__getitem__, words), np.int64, len(words))
            k = np.fromiter(map(classes.__getitem__, words), np.int16, len(words))
            yield C.rows(_COUNTED, [(0, block, shard, C.pack(n), C.pack(k))])

    return answer


def _sequences(total: int, distinct: int, n_ends: int, class_tokens: np.ndarray, class_words: np.ndarray):
    """Class at every position of a block's texts, end included; per text: known words, base score, words given classes."""
    below = np.log10(total + distinct + 1.0)
    class_below = np.log10(class_tokens + class_words + 1.0)

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SEQUENCES.empty_table()
        found = sorted(zip(*(right.column(c).to_pylist() for c in ("shard", "data", "classes")), strict=True))
        n = np.concatenate([C.unpack(x[1], np.int64) for x in found] or [np.zeros(0, np.int64)])
        k = np.concatenate([C.unpack(x[2], np.int16) for x in found] or [np.zeros(0, np.int16)])
        words = C.unpack(left.column("words")[0].as_py(), np.int32)
        counts = np.array(left.column("counts")[0].as_py(), np.int64)
        at, docs = C.starts(counts), len(counts)
        log = np.log10(n + 1.0)
        one = np.repeat(np.arange(docs), counts)
        add = lambda x: np.bincount(one, x[words], minlength=docs)
        known = add((n > 0).astype(float)) + (n_ends > 0)
        base = add(log) + np.log10(n_ends + 1.0) - (counts + 1) * below
        within = add(log - class_below[k] if len(k) else log)
        classes = np.full(len(words) + docs, END, np.int16)
        classes[C.spans(at[:-1] + np.arange(docs), counts)] = k[words]
        sums = np.stack([known, base, within])
        return pa.Table.from_batches([C.rows(_SEQUENCES, [(left.column("block")[0].as_py(), left.column("ids")[0].as_py(), (counts + 1).astype(np.int32), C.pack(classes, 6), C.pack(sums))])])

    return block


class Model:
    """start: STATES; step: STATES x STATES; emit: CLASSES x STATES (a column sums to one)."""

    def __init__(self, start, step, emit):
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def first(cls, class_tokens: np.ndarray, states: int = STATES) -> Model:
        """Sticky states whose emissions are the class counts, bent at random with a fixed seed."""
        bend = np.random.default_rng(7).random((CLASSES, states)) + 0.25
        return cls(np.full(states, 1 / states), np.where(np.eye(states) > 0, 0.9, 0.1 / max(1, states - 1)), cls._normal((class_tokens[:, None] + 0.01) * bend))

    @staticmethod
    def _normal(x):
        return x / x.sum(axis=0)

    @classmethod
    def of(cls, sums: np.ndarray, states: int = STATES) -> Model:
        """From expected counts; a little is added so that nothing becomes impossible."""
        start, step, emit = np.split(sums, [states, states + states * states])
        start, step = start + 1e-3, step.reshape(states, states) + 1e-3
        return cls(start / start.sum(), step / step.sum(axis=1, keepdims=True), cls._normal(emit.reshape(CLASSES, states) + 1e-3))

    def expected(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected counts over windows (one after the other in classes), by the scaled forward-backward recursion."""
        states = len(self.start)
        start, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states))
        step32, emit32, begin = self.step.astype(np.float32), self.emit.astype(np.float32), C.starts(lengths)
        order = np.argsort(-lengths, kind="stable")
        for part in range(0, len(order), SIDE_BY_SIDE):
            rows = order[part : part + SIDE_BY_SIDE]
            size, first = lengths[rows], begin[rows]
            longest = int(size[0])
            live = [int(np.searchsorted(-size, -t, "left")) for t in range(longest)]  # windows longer than t come first
            alpha, scale, seen = [], [], []
            for t in range(longest):
                m = live[t]
                seen.append(classes[first[:m] + t])
                a = (self.start.astype(np.float32) if t == 0 else alpha[-1][:m] @ step32) * emit32[seen[-1]]
                c = np.maximum(a.sum(axis=1, keepdims=True), np.float32(1e-30))
                alpha.append(a / c)
                scale.append(c)
            beta, gammas = np.ones((live[-1], states), np.float32), []
            for t in range(longest - 1, -1, -1):
                if t < longest - 1:
                    e = emit32[seen[t + 1]] * beta / scale[t + 1]
                    step += (alpha[t][: live[t + 1]].T @ e) * step32
                    beta = np.concatenate([e @ step32.T, np.ones((live[t] - live[t + 1], states), np.float32)])
                gammas.append(alpha[t] * beta)
            start += gammas[-1].sum(axis=0)
            gamma, ks = np.concatenate(gammas[::-1]), np.concatenate(seen)
            for s in range(states):
                emit[:, s] += np.bincount(ks, gamma[:, s], minlength=CLASSES)
        return np.concatenate([start, step.ravel(), emit.ravel()])

    def log10(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each class sequence, by the scaled forward recursion over its whole length."""
        begin, order = C.starts(lengths), np.argsort(-lengths, kind="stable")
        out, size, first = np.zeros(len(lengths)), lengths[order], begin[:-1][order]
        if not len(order):
            return out
        live = np.searchsorted(-size, -np.arange(int(size[0])), "left").tolist()
        alpha = np.broadcast_to(self.start, (len(order), len(self.start)))
        log = np.zeros(len(order))
        for t, m in enumerate(live):
            a = (alpha[:m] if t == 0 else alpha[:m] @ self.step) * self.emit[classes[first[:m] + t]]
            c = a.sum(axis=1)
            alpha = a / c[:, None]
            log[:m] += np.log10(c)
        out[order] = log
        return out


def windows(lengths: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Each length cut into windows of size, the last one shorter: owner and length of each window."""
    n = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), n)
    last = np.cumsum(n) - 1
    out = np.full(len(owner), size, np.int64)
    out[last] = lengths - (n - 1) * size
    return owner, out


def _round(table: DataFrame, model: Model) -> np.ndarray:
    """One Baum-Welch pass over the training texts of all blocks."""

    def task(batches):
        total = None
        for batch in batches:
            for ids, counts, classes in zip(*(batch.column(c).to_pylist() for c in ("ids", "counts", "classes")), strict=True):
                use = np.fromiter(map(_trained, ids), bool, len(ids))
                lengths = np.array(counts, np.int64)
                own = C.unpack(classes, np.int16)[np.repeat(use, lengths)].astype(np.int64)
                if len(own):
                    x = model.expected(own, windows(lengths[use])[1])
                    total = x if total is None else total + x
        if total is not None:
            part = TaskContext.get().partitionId() if TaskContext.get() else 0
            yield pa.record_batch([pa.array([part % SUMS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def add(group: pa.Table) -> pa.Table:
        x = sum(np.frombuffer(b.as_py()) for b in group.column("sums"))
        return pa.table({"sums": pa.array([x.tobytes()], pa.binary())})

    sums = table.select("ids", "counts", "classes").mapInArrow(task, "part int, sums binary").groupBy("part").applyInArrow(add, "sums binary").collect()
    return sum((np.frombuffer(r["sums"]) for r in sums), np.zeros(STATES + STATES * STATES + CLASSES * STATES))


def trained(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> tuple[DataFrame, Model, int]:
    """Class sequences of all texts, the model learnt from those that are not held out, and the training tokens."""
    rows = C.whole(docs, id_col, text)
    n = C.shards_for(docs.sparkSession, C.text_bytes(rows))
    table = V.blocks(rows, n, lower=True, trained=_trained)
    sums = table.agg(F.sum("n_trained"), F.sum("n_ends")).first()
    n_ends = sums[1] or 0
    total = (sums[0] or 0) + n_ends
    back = C.written(V.answers(table, _counter(total), COUNTED))
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    added = _added(back.filter("kind = 1"))
    for x, y in added:
        class_tokens, class_words = class_tokens + x, class_words + y
    distinct = int(class_words.sum()) + (n_ends > 0)
    make = _sequences(total, distinct, n_ends, class_tokens, class_words)
    sequences = C.written(table.select("block", "ids", "counts", "words").groupBy("block").cogroup(back.filter("kind = 0").groupBy("block")).applyInArrow(make, SEQUENCES))
    class_tokens[END] = n_ends
    model = Model.first(class_tokens)
    for _ in range(rounds if n_ends else 0):
        model = Model.of(_round(sequences, model))
    return sequences, model, total


def _added(counted: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sums by class, of at most SUMS groups of shards."""

    def add(group: pa.Table) -> pa.Table:
        x, y = (sum(C.unpack(b.as_py(), np.int64) for b in group.column(c)) for c in ("data", "classes"))
        return pa.table({"data": pa.array([C.pack(x)], pa.binary()), "classes": pa.array([C.pack(y)], pa.binary())})

    parts = counted.select((F.col("shard") % SUMS).alias("part"), "data", "classes").groupBy("part").applyInArrow(add, "data binary, classes binary").collect()
    return [(C.unpack(r["data"], np.int64), C.unpack(r["classes"], np.int64)) for r in parts]


def scored(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    sequences, model, total = trained(docs, id_col, text, rounds)

    def score(batches):
        for batch in batches:
            for ids, counts, classes, sums in zip(*(batch.column(c).to_pylist() for c in ("ids", "counts", "classes", "sums")), strict=True):
                lengths = np.array(counts, np.int64)
                known, base, within = C.unpack(sums, np.float64).reshape(3, -1)
                log = model.log10(C.unpack(classes, np.int16).astype(np.int64), lengths) + within
                yield C.rows(_SCORED, [(i, held_out(i), n, round(k), total, b, s) for i, n, k, b, s in zip(ids, counts, known.tolist(), base.tolist(), log.tolist(), strict=True)])

    return sequences.select("ids", "counts", "classes", "sums").mapInArrow(score, SCORED)
