"""Removal of passages that repeat across documents, by sharded automata.

1. Anchors. Every window of WORDS words has an anchor: the run of ANCHOR words in it with the least hash. Equal
   windows have equal anchors, and neighbouring windows mostly share theirs, so anchors are few. Shards find the
   anchors that two documents or more hold.
2. Passages. Windows with such an anchor are confirmed: shards compare the hash (96 bits) of the whole window. For a
   window that recurs, the block with the smallest id that holds it learns which blocks want it, and spells it:
   windows in a row are one passage, which goes as text to every block that holds some of it under a larger id.
3. Automata. The automata are sharded by block: each compiles the passages that were sent to one block, without
   knowing where they are in it, and all documents of the block stream through. The automaton finds runs of SEED
   words of a passage, of which every window holds one; from there the texts are compared word by word, both ways.
   Where WORDS words or more agree, and the passage comes from a smaller id, the words go.

A block is a bounded run of documents, and a key travels once per block that holds it, so a passage in a third
of all documents costs no task more than its share. Windows are judged on the input.

Null or empty text has no words. A null id counts as smaller than all; rows with equal ids are one document. Texts
may have any length: a very long one is a block of its own. An empty table gives an empty result. Other columns are
left behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .vocabulary import _streamed

WORDS = 13
ANCHOR = 6
_NULL_ID = -(1 << 63)

BLOCK = "block long, ids array<long>, texts binary, anchors array<binary>"
_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.binary()), ("anchors", pa.list_(pa.binary()))])
ANSWER = "block long, shard int, data binary"
_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("data", pa.binary())])
_WINDOW = np.dtype([("a", np.uint64), ("b", np.uint32), ("doc", np.int64), ("at", np.uint32)])


class Hashed:
    """64-bit hashes of words, kept while there are at most remember of them."""

    def __init__(self, remember: int = 400_000):
        self.remember, self.known = remember, {}

    def words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.remember:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words of more bytes are hashed one by one, words at once, and for how many bytes of a lane which of its bits count.
_LONG, _ONCE, _LANE = 64, 1 << 16, np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def hashed(raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words raw[begin:end], in lanes of eight bytes. Equal words have equal ones, wherever they are."""
    lanes, out = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,)), np.empty(len(begin), np.uint64)
    for low in range(0, len(begin), _ONCE):
        first, size = begin[low : low + _ONCE], end[low : low + _ONCE] - begin[low : low + _ONCE]
        x = mixed(size.astype(np.uint64) * _MIX ^ (lanes[first] & _LANE[np.minimum(size, 8)]))
        more = np.flatnonzero(size > 8)
        for at in range(8, _LONG, 8):
            x[more] = mixed(x[more] * _MIX ^ (lanes[first[more] + at] & _LANE[np.minimum(size[more] - at, 8)]))
            more = more[size[more] > at + 8]
        for i in more.tolist():
            x[i] = xxhash.xxh3_64_intdigest(raw[first[i] : first[i] + size[i]])
        out[low : low + _ONCE] = x
    return out


def runs_hash(words: np.ndarray, n: int, factor: int) -> np.ndarray:
    """A hash of every run of n words."""
    m = max(0, len(words) - n + 1)
    out, f = np.zeros(m, np.uint64), np.uint64(factor)
    for i in range(n):
        out = out * f + words[i : i + m]
    return mixed(out)


def anchored(words: np.ndarray, size: int, anchor: int) -> np.ndarray:
    """For every window of size words, the least hash of its runs of anchor words."""
    runs = runs_hash(words, anchor, 0x9E3779B97F4A7C15)
    m = max(0, len(words) - size + 1)
    if not m:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(runs, size - anchor + 1).min(axis=1) if m < 64 else _least(runs, size - anchor + 1)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours, by doubling."""
    done, step = x, 1
    while step * 2 <= n:
        done = np.minimum(done[: len(done) - step], done[step:])
        step *= 2
    m = len(x) - n + 1
    return np.minimum(done[:m], done[n - step : n - step + m])


def window_hash(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for every window."""
    return runs_hash(words, size, 0xD6E8FEB86659FD93), runs_hash(mixed(words ^ _MIX), size, 0xA0761D6478BD642F).astype(np.uint32)


def _shards(keys: np.ndarray, n: int) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(n)).astype(np.int64)


def _each_shard(shards: np.ndarray, n: int) -> list[np.ndarray]:
    """Rows of each shard, in order."""
    order = np.argsort(shards, kind="stable")
    return np.split(order, np.searchsorted(shards[order], np.arange(1, n)))


def _doc_ids(ids: list) -> np.ndarray:
    return np.array([_NULL_ID if i is None else i for i in ids], np.int64)


class _Words:
    """All words of a block, one text after the other: where they begin and end, and which texts they are of.

    raw: a text a line, its words joined by one blank.
    """

    def __init__(self, raw: bytes):
        letters = np.frombuffer(raw, np.uint8)
        gap = np.ones(len(raw) + 2, bool)
        lines = letters == 10
        np.logical_or(letters == 32, lines, out=gap[1:-1])
        self.raw = raw
        self.first, self.last = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        self.begin = np.concatenate([[0], np.searchsorted(self.first, np.flatnonzero(lines)), [len(self.first)]]).astype(np.int64)

    def hashes(self) -> np.ndarray:
        return hashed(self.raw, self.first, self.last)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Every place where a window starts, and its text: at least size words before the end of it."""
        starts = np.maximum(np.diff(self.begin) - size + 1, 0)
        return C.spans(self.begin[:-1], starts), np.repeat(np.arange(len(starts)), starts)


def _block_anchors(ids: list, raw: bytes, size: int, anchor: int):
    """Distinct (anchor, smallest id, more than one id) of a block."""
    words = _Words(raw)
    at, doc = words.windows(size)
    keys, owners = anchored(words.hashes(), size, anchor)[at], _doc_ids(ids)[doc]
    # Neighbouring windows mostly share their anchor.
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])]) if len(keys) else np.zeros(0, bool)
    return _by_key(keys[new], owners[new])


def _by_key(keys: np.ndarray, low: np.ndarray, many: np.ndarray | None = None):
    """For each distinct key: the smallest id, whether there are more ids, and the place of its first row."""
    order = np.lexsort((low, keys))
    keys, low = keys[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.concatenate([first[1:], [len(keys)]]).astype(np.int64) - 1 if len(first) else first
    more = low[first] != low[ends]
    if many is not None and len(first):
        more |= np.maximum.reduceat(many[order], first).astype(bool)
    return keys[first], low[first], more


def blocks(docs: DataFrame, n: int, size: int, anchor: int) -> DataFrame:
    """Blocks of documents as words joined by one blank, with the anchors of each shard."""

    limit = C.block_bytes(n)

    def make(batches):
        for block, ids, texts in C.gathered(batches, limit):
            raw = b"\n".join([b" ".join(t.split()) for t in texts])
            keys, low, many = _block_anchors(ids, raw, size, anchor)
            lists = [C.pack(keys[p].tobytes() + low[p].tobytes() + np.packbits(many[p]).tobytes()) if len(p) else None for p in _each_shard(_shards(keys, n), n)]
            yield C.rows(_BLOCK, [(block, ids, C.pack(raw, 6), lists)])

    return C.written(docs.mapInArrow(make, BLOCK), "block", n)


def _anchor_list(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = C.unpack(data)
    n = len(raw) * 8 // 129
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.int64, n, 8 * n), np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 * n), count=n)


def _repeat_anchors(key, batches):
    """Of one shard: for each block, which of its anchors two documents or more hold."""
    blocks, lists = [], []
    for batch in batches:
        blocks += batch.column("block").to_pylist()
        lists += [_anchor_list(x) for x in batch.column("data").to_pylist()]
    keys, _, more = _by_key(*(np.concatenate([x[i] for x in lists]) for i in range(3)))
    repeated = keys[more]
    del keys
    for block, (own, _, _) in zip(blocks, lists, strict=True):
        flags = _among(own, repeated)
        if flags.any():
            yield C.rows(_ANSWER, [(block, key[0].as_py(), C.pack(own[flags]))])


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x


def _candidates(n: int, size: int, anchor: int):
    """Of a block: its windows whose anchor repeats, with the smallest id that holds them, for each shard."""

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _ANSWER.empty_table()
        repeated = np.sort(np.concatenate([C.unpack(x.as_py(), np.uint64) for x in right.column("data")]))
        ids = left.column("ids")[0].as_py()
        words = _Words(C.unpack(left.column("texts")[0].as_py()))
        hashes, (at, doc) = words.hashes(), words.windows(size)
        use = np.flatnonzero(_among(anchored(hashes, size, anchor)[at], repeated))
        if not len(use):
            return _ANSWER.empty_table()
        x, y = window_hash(hashes, size)
        at = at[use]
        rows, many = _first(_windows(x[at], y[at], _doc_ids(ids)[doc[use]], at))
        order = np.argsort(rows["at"])
        rows, many = rows[order], many[order]
        name = left.column("block")[0].as_py()
        lists = _each_shard(_shards(rows["a"], n), n)
        return pa.Table.from_batches([C.rows(_ANSWER, [(name, i, _packed(rows[p], many[p])) for i, p in enumerate(lists) if len(p)])])

    return block


def _windows(a: np.ndarray, b: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), _WINDOW)
    out["a"], out["b"], out["doc"], out["at"] = a, b, doc, at
    return out


def _new(rows: np.ndarray) -> np.ndarray:
    """Of sorted rows, which start another window."""
    return np.concatenate([[True], (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])]) if len(rows) else np.zeros(0, bool)


def _first(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal windows, the first with the smallest id; and whether they have more ids."""
    rows = rows[np.lexsort((rows["at"], rows["doc"], rows["b"], rows["a"]))]
    first = np.flatnonzero(_new(rows))
    last = np.concatenate([first[1:], [len(rows)]]).astype(np.int64) - 1 if len(first) else first
    return rows[first], rows["doc"][first] != rows["doc"][last]


def _packed(rows: np.ndarray, many: np.ndarray) -> bytes:
    """rows in order of their places, which are kept as steps."""
    steps = np.diff(rows["at"], prepend=np.uint32(0)).astype(np.uint32)
    return C.pack(rows["a"].tobytes() + rows["doc"].tobytes() + rows["b"].tobytes() + steps.tobytes() + np.packbits(many).tobytes())


def _window_list(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = C.unpack(data)
    n = len(raw) * 8 // 193
    out = np.empty(n, _WINDOW)
    out["a"], out["doc"] = np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.int64, n, 8 * n)
    out["b"], out["at"] = np.frombuffer(raw, np.uint32, n, 16 * n), np.cumsum(np.frombuffer(raw, np.uint32, n, 20 * n))
    return out, np.unpackbits(np.frombuffer(raw, np.uint8, offset=24 * n), count=n).astype(bool)


def _confirm(key, batches):
    """Of one shard: to the block with the smallest id of each window that recurs, the window's place there and every block that holds it under a larger id."""
    blocks, lists = [], []
    for batch in batches:
        blocks += batch.column("block").to_pylist()
        lists += [_window_list(x) for x in batch.column("data").to_pylist()]
    every, many = (np.concatenate([x[i] for x in lists]) for i in range(2))
    block = np.repeat(np.array(blocks, np.int64), [len(x) for x, _ in lists])
    del lists
    order = np.lexsort((block, every["doc"], every["b"], every["a"]))
    every, many, block = every[order], many[order], block[order]
    new = _new(every)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    wanted = np.flatnonzero(many | (every["doc"][first] < every["doc"]))
    owner, at, target = block[first[wanted]], every["at"][first[wanted]], block[wanted]
    del every, many, block
    order = np.lexsort((at, target, owner))
    owner, at, target = owner[order], at[order], target[order]
    for begin, end in _ranges(owner):
        targets, many = np.unique(target[begin:end], return_counts=True)
        data = np.array([len(targets)], np.int64).tobytes() + targets.tobytes() + many.astype(np.uint32).tobytes() + at[begin:end].tobytes()
        yield C.rows(_ANSWER, [(int(owner[begin]), key[0].as_py(), C.pack(data))])


def _ranges(x: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the runs of equal values."""
    if not len(x):
        return []
    edges = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return list(zip(edges, edges[1:], strict=False))


def _wanted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The block that wants each place, and the place."""
    raw = C.unpack(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    targets, many = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint32, n, 8 + 8 * n)
    return np.repeat(targets, many), np.frombuffer(raw, np.uint32, offset=8 + 12 * n)


def _spell(size: int):
    """Of a block: the passages of it that other blocks (or larger ids in it) hold, for each of these."""

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _ANSWER.empty_table()
        ids = left.column("ids")[0].as_py()
        words, numbers = _Words(C.unpack(left.column("texts")[0].as_py())), _doc_ids(ids)
        target, at = (np.concatenate(x) for x in zip(*(_wanted(x.as_py()) for x in right.column("data")), strict=True))
        order = np.lexsort((at, target))
        target, at = target[order], at[order].astype(np.int64)
        name, out = left.column("block")[0].as_py(), []
        for low, high in _ranges(target):
            own = at[low:high]
            # Windows that overlap are one passage; they lie in one text, as each of them does.
            cut = np.concatenate([[0], np.flatnonzero(np.diff(own) >= size) + 1, [len(own)]])
            first, last = own[cut[:-1]], own[cut[1:] - 1] + size
            where = np.searchsorted(words.begin, first, "right") - 1
            texts = [words.raw[i:j] for i, j in zip(words.first[first].tolist(), words.last[last - 1].tolist(), strict=True)]
            out.append((int(target[low]), name & 0x7FFFFFFF, C.pack(np.array([len(texts)], np.int64).tobytes() + numbers[where].tobytes() + b"\n".join(texts))))
        return pa.Table.from_batches([C.rows(_ANSWER, out)])

    return block


def _passages(data: bytes) -> list[tuple[int, list[bytes]]]:
    """(id that the passage comes from, words) of every passage of a list."""
    raw = C.unpack(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return list(zip(np.frombuffer(raw, np.int64, n, 8).tolist(), [t.split(b" ") for t in raw[8 + 8 * n :].split(b"\n")], strict=True))


def _rewrite(size: int, finish, arrow: pa.Schema):
    """Of a block: the automaton of the passages that were sent to it, every occurrence in its documents, and what is left."""

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        ids = left.column("ids")[0].as_py()
        texts = C.unpack(left.column("texts")[0].as_py()).split(b"\n")
        passages = [p for x in right.column("data") for p in _passages(x.as_py())] if right.num_rows else []
        out = [(i, *finish(text, gone)) for i, text, gone in zip(ids, texts, located(passages, texts, _doc_ids(ids).tolist(), size), strict=True)]
        return pa.Table.from_batches([C.rows(arrow, out)])

    return block


def _spelt(text: bytes) -> str:
    """Words between blanks, so that a seed is only found at word ends."""
    return f" {text.decode('utf-8', 'surrogateescape')} "


def _counted(text: bytes) -> int:
    """How many words there are in a text that has one blank between them."""
    return text.count(b" ") + 1 if text else 0


def seeded(passages: list[tuple[int, list[bytes]]], size: int) -> ahocorasick.Automaton | None:
    """The automaton of the seeds of passages: every run of size words holds a whole seed. Each tells its (passage, place)s.

    Its letters are characters: with words as letters the root would have as many branches as there are words.
    """
    seed, found = (size + 1) // 2, {}
    for k, (_, words) in enumerate(passages):
        for at in range(0, len(words) - seed + 1, seed):
            found.setdefault(_spelt(b" ".join(words[at : at + seed])), []).append((k, at))
    if not found:
        return None
    automaton = ahocorasick.Automaton()
    for spelt, places in found.items():
        automaton.add_word(spelt, places)
    automaton.make_automaton()
    return automaton


def _agree(a: list[bytes], i: int, b: list[bytes], j: int, most: int) -> int:
    """How many words from a[i] and b[j] on are equal, at most so many."""
    n = 0
    while n < most:
        step = min(64, most - n)
        if a[i + n : i + n + step] != b[j + n : j + n + step]:
            while a[i + n] == b[j + n]:
                n += 1
            return n
        n += step
    return n


def _agree_back(a: list[bytes], i: int, b: list[bytes], j: int) -> int:
    """How many words before a[i] and b[j] are equal."""
    n, most = 0, min(i, j)
    while n < most and a[i - n - 1] == b[j - n - 1]:
        n += 1
    return n


def located(passages: list[tuple[int, list[bytes]]], texts: list[bytes], numbers: list[int], size: int) -> Iterator[np.ndarray | None]:
    """For each text, flags of its words under every run of size words or more that a passage of a smaller id holds too; None where there are none.

    A text has one blank between its words. Only one in which a seed is found is split.
    """
    automaton, seed = seeded(passages, size), (size + 1) // 2
    for doc, text in zip(numbers, texts, strict=True):
        if automaton is None or _counted(text) < size:
            yield None
            continue
        spelt, words, gone, done, blanks, seen = _spelt(text), [], None, {}, 0, 0
        for end, known in automaton.iter(spelt):
            words = words or text.split(b" ")
            # Seeds are found in order of their ends: as many words end there as there are blanks, but for the first one.
            blanks, seen = blanks + spelt.count(" ", seen, end + 1), end + 1
            i = blanks - 1 - seed
            for k, j in known:
                low, own = passages[k]
                # Along a match that is known already there is nothing new.
                if low >= doc or done.get((k, i - j), -1) > i:
                    continue
                right = i + seed + _agree(words, i + seed, own, j + seed, min(len(words) - i, len(own) - j) - seed)
                done[k, i - j] = right
                left = i - _agree_back(words, i, own, j)
                if right - left >= size:
                    if gone is None:
                        gone = np.zeros(len(words), bool)
                    gone[left:right] = True
        yield gone


def locate(passages: list[tuple[int, list[bytes]]], docs: list[list[bytes]], numbers: list[int], gone: list[np.ndarray], size: int) -> None:
    """Flags the words of docs that located tells."""
    for flags, found in zip(gone, located(passages, [b" ".join(words) for words in docs], numbers, size), strict=True):
        if found is not None:
            flags |= found


def _grouped(lists: DataFrame, f) -> DataFrame:
    return lists.groupBy("shard").applyInArrow(_streamed(f), ANSWER)


def _passed(docs: DataFrame, finish, schema: list[tuple], id_col: str, text: str, size: int, anchor: int) -> DataFrame:
    rows = C.whole(docs, id_col, text)
    n = C.shards_for(docs.sparkSession, C.text_bytes(rows))
    table = blocks(rows, n, size, anchor)
    lists = table.select("block", F.posexplode("anchors").alias("shard", "data")).filter("data is not null")
    anchors = _grouped(lists, _repeat_anchors)
    texts = table.select("block", "ids", "texts")
    windows = texts.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(_candidates(n, size, anchor), ANSWER)
    wanted = _grouped(windows, _confirm)
    passages = texts.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_spell(size), ANSWER)
    arrow = pa.schema([("doc_id", pa.int64()), *schema])
    names = {"int64": "long", "string": "string"}
    return texts.groupBy("block").cogroup(passages.groupBy("block")).applyInArrow(_rewrite(size, finish, arrow), ", ".join(f"{f.name} {names[str(f.type)]}" for f in arrow))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WORDS, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and text: the words that are left, joined by one blank."""

    def finish(text, gone):
        kept = text if gone is None else b" ".join(compress(text.split(b" "), (~gone).tolist()))
        return _counted(text), 0 if gone is None else int(gone.sum()), kept.decode("utf-8", "replace")

    return _passed(docs, finish, [("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())], id_col, text, size, anchor)
