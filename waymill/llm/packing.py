"""Best-fit packing with a swap-based local search.

Only lengths matter for a packing, and there are at most `capacity` of them. So the plan is made from the
histogram of lengths, whatever the number of documents: bins with equal contents are one *pattern* with a
multiplicity. Best fit fills the patterns; the local search then exchanges one-for-one, two-for-one or moves
between pairs of underfull patterns, for as many bins of both as can take part at once, whenever that increases
the sum of squared fills; bins that run empty are dropped. Partners are found by room and by the lengths that they
hold, and the search ends when no pair can exchange or no fewer bins can hold the pieces. Pieces find their place by their rank among the
pieces of equal length.

Null text is empty; an empty document has just its end token. Rows with equal ids are separate documents. An
empty table gives an empty packing. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .bpe import encoder

CAPACITY = 4096
END = 1
#: Pieces of one length that one task numbers.
RANKED = 1_000_000

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most capacity tokens of every whole text, its end token included."""
    last = np.array([end], "<u4").tobytes()

    def make(batches):
        encode = encoder(path).text
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + last
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    out.append((doc, i, at // 4, len(piece) // 4, zlib.crc32(piece)))
            if out:
                yield C.rows(_PIECE, out)

    return C.whole(docs, id_col, text).mapInArrow(make, PIECE)


def best_fit(lengths: dict[int, int], capacity: int) -> Counter:
    """Patterns (tuples of lengths, falling) and how many bins have each: lengths fall, each goes where least room is left."""
    bins: Counter = Counter()
    room: defaultdict[int, list[tuple]] = defaultdict(list)  # patterns by the room that is left
    free: list[int] = []  # rooms in use, sorted
    for length in sorted(lengths, reverse=True):
        n = lengths[length]
        while n:
            i = bisect.bisect_left(free, length)
            if i == len(free):
                each = capacity // length  # new bins, filled with this length alone
                many, left = divmod(n, each)
                new = [(each, many), (left, 1)] if left else [(each, many)]
                for k, m in new:
                    if m:
                        _put(bins, room, free, (length,) * k, m, capacity - k * length)
                break
            gap = free[i]
            pattern = room[gap][-1]
            m = bins[pattern]
            k = min(gap // length, max(1, n // m))
            took = min(m, n // k)
            _take(bins, room, free, pattern, took, gap)
            _put(bins, room, free, pattern + (length,) * k, took, gap - k * length)
            n -= took * k
    return bins


def _put(bins, room, free, pattern, m, gap) -> None:
    if pattern not in bins:
        if not room[gap]:
            bisect.insort(free, gap)
        room[gap].append(pattern)
    bins[pattern] += m


def _take(bins, room, free, pattern, m, gap) -> None:
    bins[pattern] -= m
    if not bins[pattern]:
        del bins[pattern]
        room[gap].remove(pattern)
        if not room[gap]:
            free.remove(gap)


def exchange(a: tuple, b: tuple, capacity: int) -> tuple[tuple, tuple] | None:
    """The best move between two bins: of at most two lengths of one for at most one of the other.

    a is the fuller one. Squared fill grows if a grows; the most is gained where a becomes as full as can be.
    """
    room = capacity - sum(a)
    if not room or not b:
        return None
    best, give, get = 0, (), ()
    ones = sorted(set(b))
    # What a may take: one or two lengths of b. What it gives: nothing or one length; or two for one of b.
    taken = [((x,), x) for x in ones] + [((x, y), x + y) for i, x in enumerate(ones) for y in ones[i:] if x != y or b.count(x) > 1]
    own = sorted(set(a))
    given = [((), 0)] + [((x,), x) for x in own]
    pairs = [((x, y), x + y) for i, x in enumerate(own) for y in own[i:] if x != y or a.count(x) > 1]
    for takes, gives in ((taken, given), (taken[: len(ones)], pairs)):
        sums = [s for _, s in gives]
        order = sorted(range(len(gives)), key=sums.__getitem__)
        sums = [sums[i] for i in order]
        for t, s in takes:
            i = bisect.bisect_left(sums, s - room)  # least to give so that it fits: most is gained
            if i < len(sums) and 0 < s - sums[i] <= room and s - sums[i] > best:
                best, get, give = s - sums[i], t, gives[order[i]][0]
                if best == room:
                    break
    return (_swap(a, give, get), _swap(b, get, give)) if best else None


def _swap(bin_: tuple, less: tuple, more: tuple) -> tuple:
    out = list(bin_)
    for x in less:
        out.remove(x)
    return tuple(sorted([*out, *more], reverse=True))


def _pairs(pattern: tuple) -> set[int]:
    """Sums of two lengths of a pattern."""
    own = sorted(set(pattern))
    return {x + y for i, x in enumerate(own) for y in own[i:] if x != y or pattern.count(x) > 1}


class _Underfull:
    """Underfull patterns by the lengths (0: every pattern) and by the sums of two lengths that they hold, each by room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.ones, self.twos = {}, {}
        self.one_keys, self.two_keys = [], []

    def change(self, pattern: tuple, add: bool) -> None:
        entry = (self.capacity - sum(pattern), pattern)
        for lists, keys, own in ((self.ones, self.one_keys, {0, *pattern}), (self.twos, self.two_keys, _pairs(pattern))):
            for k in own:
                if add:
                    if k not in lists:
                        lists[k] = []
                        bisect.insort(keys, k)
                    bisect.insort(lists[k], entry)
                else:
                    held = lists[k]
                    del held[bisect.bisect_left(held, entry)]
                    if not held:
                        del lists[k]
                        del keys[bisect.bisect_left(keys, k)]

    def fuller(self, b: tuple, alone: bool) -> tuple | None:
        """The pattern, no emptier than b, that can take most from it; alone: only one bin has pattern b."""
        room, best, found = self.capacity - sum(b), 0, None
        ones = set(b)
        for takes, tables in ((ones, ((self.ones, self.one_keys), (self.twos, self.two_keys))), (_pairs(b), ((self.ones, self.one_keys),))):
            for x in takes:
                for lists, keys in tables:
                    for i in range(bisect.bisect_left(keys, x - room), bisect.bisect_left(keys, x - best)):
                        held = lists[keys[i]]
                        at = bisect.bisect_left(held, (room + 1,)) - 1
                        if at >= 0 and alone and held[at][1] == b:
                            at -= 1
                        if at >= 0 and held[at][0] >= x - keys[i]:
                            best, found = x - keys[i], held[at][1]
                            break
        return found

    def emptier(self, a: tuple, alone: bool) -> tuple | None:
        """A pattern, no fuller than a, that can give to it; alone: only one bin has pattern a."""
        room = self.capacity - sum(a)
        both, one = ((self.ones, self.one_keys), (self.twos, self.two_keys)), ((self.ones, self.one_keys),)
        for gives, tables in (({0, *a}, both), (_pairs(a), one)):
            for g in gives:
                for lists, keys in tables:
                    for i in range(bisect.bisect_right(keys, g), bisect.bisect_right(keys, g + room)):
                        held = lists[keys[i]]
                        at = len(held) - 1
                        if alone and held[at][1] == a:
                            at -= 1
                        if at >= 0 and held[at][0] >= room:
                            return held[at][1]
        return None


def search(bins: Counter, capacity: int) -> Counter:
    """Empties the least full patterns into the others by exchanges that increase squared fill.

    The least full pattern that is not settled gives to a fuller one, or takes from an emptier one; with neither it
    is settled until it gets more bins. Whatever an exchange makes is unsettled, so at the end no pair can exchange,
    unless less room is left in all than a bin holds, when no bin can be spared.
    """
    bins, index = Counter(bins), _Underfull(capacity)
    free = sum((capacity - sum(p)) * m for p, m in bins.items())
    todo = [(sum(p), p) for p in bins if sum(p) < capacity]
    if free < capacity:
        return bins
    for _, p in todo:
        index.change(p, True)
    heapq.heapify(todo)
    while todo and free >= capacity:
        _, p = heapq.heappop(todo)
        if not bins[p]:
            continue
        alone = bins[p] == 1
        a, b = index.fuller(p, alone), p
        if a is None:
            a, b = p, index.emptier(p, alone)
            if b is None:
                continue
        m = bins[p] // 2 if a == b else min(bins[a], bins[b])
        made = exchange(a, b, capacity)
        for q in (a, b):
            bins[q] -= m
        for q in {a, b}:
            if bins[q]:
                heapq.heappush(todo, (sum(q), q))
            else:
                index.change(q, False)
        for q in made:
            if not q:
                free -= capacity * m
                continue
            if not bins[q] and sum(q) < capacity:
                index.change(q, True)
            bins[q] += m
            if sum(q) < capacity:
                heapq.heappush(todo, (sum(q), q))
    return +bins


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Patterns and multiplicities for a histogram of lengths."""
    return search(best_fit(lengths, capacity), capacity)


def places(bins: Counter) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ranks at which the runs of its places start, and the first sequence and the offset of each run."""
    out: defaultdict[int, tuple[list, list, list]] = defaultdict(lambda: ([0], [], []))
    first = 0
    for pattern, m in sorted(bins.items()):
        at = 0
        for length in pattern:
            begin, sequence, offset = out[length]
            begin.append(begin[-1] + m)
            sequence.append(first)
            offset.append(at)
            at += length
        first += m
    return {k: tuple(np.array(x, np.int64) for x in v) for k, v in out.items()}


def ranked(pieces: DataFrame, n: int) -> DataFrame:
    """pieces with rank: 0, 1, ... among those of equal length. n: how many pieces there are.

    A common length is dealt to buckets of about RANKED pieces, which are numbered on their own; a bucket
    starts where those before it end.
    """
    buckets = max(1, -(-n // RANKED))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = dealt.withColumn("rank", F.row_number().over(own) - 1)
    if buckets == 1:
        return numbered.drop("bucket")
    return numbered.join(begin, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("begin")).drop("bucket", "begin")


def best_fit_packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = C.written(cut(docs, path, capacity, end, id_col, text))
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    where = places(plan(lengths, capacity))

    def put(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                begin, first, at = where[int(k)]
                rows = np.flatnonzero(length == k)
                run = np.searchsorted(begin, rank[rows], "right") - 1
                sequence[rows], offset[rows] = first[run] + rank[rows] - begin[run], at[run]
            kept = [batch.column(f.name) for f in _PIECE]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*_PIECE.names, "sequence_id", "offset"])

    return ranked(pieces, sum(lengths.values())).select(*_PIECE.names, F.col("rank").cast("long").alias("rank")).mapInArrow(put, f"{PIECE}, sequence_id long, offset long")
