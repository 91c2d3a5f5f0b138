"""N-gram Jaccard self-join by grouped prefixes.

Two sets of shingles with a Jaccard similarity of at least `percent` share a token of their prefixes, once all
sets are sorted by one order, rare tokens first. Frequencies for that order come from a sketch of fixed size
that counts every shingle of every document; any order gives the same links.

1. Documents with equal prefixes and equal set sizes are one group, so copies and many near copies are one.
2. Shards of tokens look at the groups that hold a token in their prefix, ordered by size and cut where
   neighbouring sizes differ too much to be similar. In a run, a group is dropped if its size and the place of the
   token allow no link with any other of the run (all pairs up to NEAR places apart are looked at, a bound holds for
   the rest). The others are tied to one group of the run, the centre: as many ties as members.
3. Every similar pair has a common centre. Around each centre the groups are expanded to their distinct texts, of
   which only signatures travel: how many shingles fall into each of some buckets. The sum of the lesser counts is
   at least the size of the intersection, so pairs that it rules out are not similar. What is left makes clusters.
4. Each distinct text of a cluster is read once and verified against the others of its cluster, exactly. Jaccard
   distance is a metric, so texts near a common leader rule out most comparisons, and those that are connected
   already need none. Crowds around a centre or in a cluster of more than STAR texts or STAR_TOKENS shingles are
   dealt to pairs of blocks of them.
5. Links become components by alternating stars, in written tables.

Null text, or text without words, has no shingles and is linked with nothing. A null id counts as smaller than
all. Rows with equal ids are separate if their texts differ. Texts may have any length. An empty table gives an
empty result. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .phrases import Hashed, _each_shard, _shards, mixed, runs_hash
from .vocabulary import _streamed

#: Counters of the sketch, a power of two; parts in which its sums travel.
COUNTERS, PARTS = 1 << 20, 64
#: Texts around a centre, and shingles of them, that make one block of a comparison.
STAR, STAR_TOKENS = 4096, 1 << 22
#: Neighbours in a run that each group is compared with.
NEAR = 24
#: Buckets of a signature, powers of two: the least and the most.
FEWEST, MOST = 8, 4096
_NULL_ID = -(1 << 63)

_SKETCH = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
BLOCK = "block long, ids array<long>, files array<long>, rows array<long>, keys array<binary>, groups array<long>, sizes array<int>, signatures array<binary>, lists array<binary>"
_LONGS, _BINARIES = pa.list_(pa.int64()), pa.list_(pa.binary())
_BLOCK = pa.schema([("block", pa.int64()), ("ids", _LONGS), ("files", _LONGS), ("rows", _LONGS), ("keys", _BINARIES), ("groups", _LONGS), ("sizes", pa.list_(pa.int32())), ("signatures", _BINARIES), ("lists", _BINARIES)])
_TIE = pa.schema([("centre", pa.int64()), ("group", pa.int64())])
_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def shingles(words: list[bytes], n: int, hashed: Hashed) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of all words together if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    k = min(n, len(words))
    found = runs_hash(hashed.words(words), k, 0xA24BAED4963EE407)
    return np.unique(found) if k == n else mixed(found + np.uint64(k))


def split(text: bytes) -> list[bytes]:
    return text.lower().split()


def content(words: list[bytes]) -> bytes:
    """Names a text by its words."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """For each counter, the number of bits of its count."""

    def count(batches):
        C.trimmed()
        counts, hashed, waiting, size = np.zeros(COUNTERS, np.int64), Hashed(), [], 0
        for batch in batches:
            for text in batch.column(1):
                own = shingles(split(text.as_py()), n, hashed) >> np.uint64(44)
                waiting.append(own)
                size += len(own)
                if size > COUNTERS:
                    counts += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=COUNTERS)
                    waiting, size = [], 0
        if waiting:
            counts += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=COUNTERS)
        yield C.rows(_SKETCH, [(i, C.pack(x)) for i, x in enumerate(np.split(counts, PARTS))])

    def add(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([C.rows(_SKETCH, [(group.column("part")[0].as_py(), C.pack(sum(C.unpack(x.as_py(), np.int64) for x in group.column("counts"))))])])

    parts = docs.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    counts = np.zeros(COUNTERS, np.int64)
    for r in parts:
        at = r["part"] * (COUNTERS // PARTS)
        counts[at : at + COUNTERS // PARTS] = C.unpack(r["counts"], np.int64)
    return np.ceil(np.log2(counts + 1)).astype(np.uint8)


def in_order(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Tokens by level, then hash."""
    return found[np.argsort((levels[(found >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (found >> np.uint64(6)), kind="stable")]


def buckets(size: int) -> int:
    """Of the signature of a set of this size: one or two hashes for each."""
    return min(MOST, max(FEWEST, 1 << max(0, (size - 1).bit_length() - 1)))


def signature(found: np.ndarray) -> bytes:
    """How many of a set of hashes fall into each bucket."""
    n = buckets(len(found))
    counts = np.bincount((found & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return C.pack(counts.astype(np.uint8 if counts.max() < 256 else np.uint32), 1)


def counts_of(signature: bytes, size: int) -> np.ndarray:
    """The counts of a signature of a set of this size."""
    raw = C.unpack(signature)
    return np.frombuffer(raw, np.uint8 if len(raw) == buckets(size) else np.uint32)


def _prefixes(rows: dict, shards: int) -> list:
    """For each shard: its prefix tokens (32 bits are enough for candidates), group by group.

    rows: group -> (prefix, size). A list has, for each group, its name, size and number of tokens; then tokens and places.
    """
    lists = [None] * shards
    if not rows:
        return lists
    lengths = np.array([len(p) for p, _ in rows.values()])
    names, sizes = np.array(list(rows), np.uint64), np.array([s for _, s in rows.values()], np.uint32)
    token, owner, place = np.concatenate([p for p, _ in rows.values()]), np.repeat(np.arange(len(rows)), lengths), C.spans(np.zeros(len(lengths)), lengths).astype(np.uint32)
    low = mixed(token ^ np.uint64(0xD1B54A32D192ED03)).astype(np.uint32)
    for i, p in enumerate(_each_shard(_shards(token, shards), shards)):
        if len(p):
            own = owner[p]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            many = np.diff(np.concatenate([first, [len(p)]])).astype(np.uint32)
            columns = (np.array([len(first)], np.uint32), names[own[first]], sizes[own[first]], many, low[p], place[p])
            lists[i] = C.pack(b"".join(x.tobytes() for x in columns))
    return lists


def _prefix_list(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """token, group, size, place of every entry of a list."""
    raw = C.unpack(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    names, sizes, many = np.frombuffer(raw, np.uint64, n, 4), np.frombuffer(raw, np.uint32, n, 4 + 8 * n), np.frombuffer(raw, np.uint32, n, 4 + 12 * n)
    m = (len(raw) - 4 - 16 * n) // 8
    return np.frombuffer(raw, np.uint32, m, 4 + 16 * n), np.repeat(names, many), np.repeat(sizes, many), np.frombuffer(raw, np.uint32, m, 4 + 16 * n + 4 * m)


def _blocks(docs: DataFrame, shards: int, levels: np.ndarray, n: int, percent: int) -> DataFrame:
    """Per block: id, place, text name, group, set size and signature of every document; prefix tokens of distinct groups, for each shard."""
    limit = C.block_bytes(shards)

    def make(batches):
        C.trimmed()
        hashed = Hashed()
        for block, places, texts in C.gathered(_placed(batches), limit):
            keys, groups, sizes, signatures, rows, seen = [], [], [], [], {}, {}
            for text in texts:
                words = split(text)
                key = content(words)
                if key not in seen:
                    found = shingles(words, n, hashed)
                    prefix = in_order(found, levels)[: prefix_length(len(found), percent)] if len(found) else found
                    group = xxhash.xxh3_64_intdigest(prefix.tobytes(), len(found))
                    seen[key] = group, len(found), signature(found) if len(found) else None
                    if len(found):
                        rows[group] = (prefix, len(found))
                group, size, signed = seen[key]
                keys.append(key)
                groups.append(group)
                sizes.append(size)
                signatures.append(signed)
            ids, files, numbers = ([x[c] for x in places] for c in ("id", "file", "row"))
            yield C.rows(_BLOCK, [(block, ids, files, numbers, keys, np.array(groups, np.uint64).astype(np.int64).tolist(), sizes, signatures, _prefixes(rows, shards))])

    return C.written(docs.mapInArrow(make, BLOCK))


def _placed(batches):
    """Batches of (place, text): a place is an id, a file and a row there."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([batch.column(i) for i in (0, 2, 3)], ["id", "file", "row"]), batch.column(1)], names=["place", "text"])


def _near(size: np.ndarray, place: np.ndarray, run: np.ndarray, length: np.ndarray, percent: int) -> np.ndarray:
    """Which entries may have a link within their run. Entries are sorted by run, then size; length: of each entry's run."""
    keep, n = np.zeros(len(size), bool), len(size)
    rest = size - place
    at = np.arange(n)
    for d in range(1, min(NEAR, int(length.max()) if n else 0) + 1):
        at = at[at + d < n]
        at = at[run[at] == run[at + d]]
        if not len(at):
            return keep
        ok = at[(100 + percent) * np.minimum(rest[at], rest[at + d]) >= percent * (size[at] + size[at + d])]
        keep[ok] = keep[ok + d] = True
    # Beyond: the least partner that a group can have is the smallest of its run, or the smallest of a similar size.
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if n else np.zeros(0, np.int64)
    smallest = np.repeat(size[first], np.diff(np.concatenate([first, [n]])))
    least = np.maximum(smallest, -(-percent * size // 100))
    return keep | ((length > NEAR + 1) & ((100 + percent) * rest >= percent * (size + least)))


def _ties(percent: int):
    """Of one shard of tokens: (centre, group) of every run that may hold a link."""

    def shard(key, batches):
        parts = [_prefix_list(x) for batch in batches for x in batch.column("data").to_pylist()]
        token, group, size, place = (np.concatenate(p) for p in zip(*parts, strict=True))
        del parts
        order = np.lexsort((group, size, token))
        token, group, size, place = token[order], group[order], size[order].astype(np.int64), place[order].astype(np.int64)
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])])  # copies from other blocks
        token, group, size, place = token[new], group[new], size[new], place[new]
        cut = np.concatenate([[True], (token[1:] != token[:-1]) | (100 * size[:-1] < percent * size[1:])])
        run = np.cumsum(cut) - 1
        length = np.bincount(run)[run]
        use = length > 1
        group, size, place, run, length = (x[use] for x in (group, size, place, run, length))
        use = _near(size, place, run, length, percent)
        group, run = group[use], run[use]
        if not len(run):
            return
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        centre = np.repeat(np.minimum.reduceat(group, first), np.diff(np.concatenate([first, [len(run)]])))
        pairs = np.unique(np.stack([centre, group], axis=1), axis=0).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_TIE)

    return _streamed(shard)


def possible(sizes: list[int], signed: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j) that connect all sets which may be similar, by their signatures. sizes rise."""
    n, out = len(sizes), []
    size = np.array(sizes, np.int64)
    mine = np.arange(n)  # the component of each set, as far as it is known
    widths = [len(x) for x in signed]
    begin = {w: widths.index(w) for w in sorted(set(widths))}
    end = {w: n - widths[::-1].index(w) for w in begin}
    kind = np.uint8 if all(x.dtype == np.uint8 for x in signed) else np.uint32
    own = {w: np.stack(signed[begin[w] : end[w]]).astype(kind) for w in begin}
    wide = np.uint16 if kind == np.uint8 else np.int64
    folded = {w: m.astype(wide)[:, : w // 2] + m[:, w // 2 :] for w, m in own.items()}  # the same buckets as sets of half the width
    for i in range(n - 1):
        last = int(np.searchsorted(size, 100 * size[i] // percent, "right"))
        for w, table in ((widths[i], own), (2 * widths[i], folded)):
            if w not in begin:
                continue
            low, high = max(i + 1, begin[w]), min(last, end[w])
            if low >= high:
                continue
            at = np.flatnonzero(mine[low:high] != mine[i]) + low
            if len(at):
                both = np.minimum(table[w][at - begin[w]], own[widths[i]][i - begin[widths[i]]]).sum(axis=1, dtype=np.int64)
                for j in at[(100 + percent) * both >= percent * (size[i] + size[at])].tolist():
                    if mine[j] != mine[i]:
                        out.append((i, j))
                        mine[mine == mine[j]] = mine[i]
    return out


def _candidates(percent: int):
    """Of one task: pairs of texts that connect those around a centre which may be similar."""

    def task(key, batches):
        seen = {}
        for batch in batches:
            for name, size, signed in zip(*(batch.column(c).to_pylist() for c in ("key", "size", "signature")), strict=True):
                seen[name] = size, signed
        names = sorted(seen, key=lambda x: (seen[x][0], x))
        sizes = [seen[x][0] for x in names]
        out = [(names[i], names[j]) for i, j in possible(sizes, [counts_of(*seen[x][::-1]) for x in names], percent)]
        if out:
            yield C.rows(_LINK, out)

    return _streamed(task)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def linked(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set, the first member of its component, where sets of at least percent similarity are linked.

    Leaders are sets that no earlier leader is linked with. A set at distance d from a leader can only be linked
    with those of its followers whose distance from it is at least d less the allowed one.
    """
    n = len(sets)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def union(i: int, j: int) -> None:
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)

    allowed, slack = 1 - percent / 100, 1e-9
    leaders: list[int] = []
    followers: dict[int, list[tuple[float, int]]] = {}
    for i, x in enumerate(sets):
        home = None
        for lead in leaders:
            m, k = len(x), len(sets[lead])
            # A follower's size is within percent of its leader's, and so would be this one's.
            if 10_000 * min(m, k) < percent * percent * max(m, k) or find(i) == find(lead) and home is not None:
                continue
            both = _shared(x, sets[lead])
            d = 1 - both / (m + k - both)
            if 100 * both >= percent * (m + k - both):
                union(i, lead)
                if home is None:
                    home = lead
                    followers[lead].append((d, i))
                continue
            for away, j in followers[lead]:
                if away >= d - allowed - slack and find(i) != find(j):
                    y = sets[j]
                    if 100 * min(m, len(y)) >= percent * max(m, len(y)):
                        both = _shared(x, y)
                        if 100 * both >= percent * (m + len(y) - both):
                            union(i, j)
        if home is None:
            leaders.append(i)
            followers[i] = []
    return [find(i) for i in range(n)]


def _verified(n: int, percent: int):
    """Of one task: links that connect the similar texts around a centre."""

    def task(key, batches):
        seen, hashed = {}, Hashed()
        for batch in batches:
            for text in batch.column("text"):
                words = split(text.as_py())
                name = content(words)
                if words and name not in seen:
                    seen[name] = shingles(words, n, hashed)
        names = sorted(seen, key=lambda x: (len(seen[x]), x))
        roots = linked([seen[x] for x in names], percent)
        out = [(names[i], names[r]) for i, r in enumerate(roots) if i != r]
        if out:
            yield C.rows(_LINK, out)

    return _streamed(task)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): the least node that it is connected with, by alternating large and small stars."""
    edges = C.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        edges = C.written(small.filter("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _crowds(rows: DataFrame, by: str, size: str = "size") -> DataFrame:
    """rows (all columns, with by and a key) dealt to tasks (by, i, j), so that any two rows of a crowd meet in one; lone rows go."""
    crowd = rows.groupBy(by).agg(F.count("*").alias("_n"), F.sum(size).alias("_m")).filter("_n > 1")
    pieces = F.ceil(F.greatest(F.col("_n") / STAR, F.col("_m") / STAR_TOKENS)).cast("int")
    one = F.pmod(F.xxhash64("key"), F.col("_p")).cast("int")
    placed = rows.join(crowd.select(by, pieces.alias("_p")), by).select(*rows.columns, one.alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("_j"))
    return placed.select(*rows.columns, F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"))


def clustered(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, place: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row. Links: Jaccard similarity of n-word shingles of at least percent.

    place: two columns of longs that tell rows with equal ids apart. They pass through, and `first` tells the one row
    of each component that has the least id, then the least place.
    """
    places = [F.col(c).alias(f"_{i}") if place else F.lit(0).cast("long").alias(f"_{i}") for i, c in enumerate(place or ("", ""))]
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), *places)
    shards = C.shards_for(docs.sparkSession, C.text_bytes(rows))
    table = _blocks(rows, shards, _sketch(rows, n), n, percent)
    zipped = table.select(F.explode(F.arrays_zip("ids", "files", "rows", "keys", "groups", "sizes", "signatures")).alias("x"))
    members = zipped.select(
        F.struct(F.col("x.ids").alias("doc"), F.col("x.files").alias("file"), F.col("x.rows").alias("row")).alias("at"),
        F.col("x.keys").alias("key"), F.col("x.groups").alias("group"), F.col("x.sizes").alias("size"), F.col("x.signatures").alias("signature"),
    )
    texts = members.filter("size > 0").groupBy("key", "group").agg(F.min("at").alias("rep"), F.first("size").alias("size"), F.count("*").alias("often"))

    lists = table.select(F.posexplode("lists").alias("shard", "data")).filter("data is not null")
    ties = lists.groupBy("shard").applyInArrow(_ties(percent), "centre long, group long")
    texts = C.written(texts)
    own = texts.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("group").alias("centre"), "group")
    ties = C.written(ties.unionByName(own).distinct())
    # Of the texts that are tied to anything, one signature each.
    tied = C.sifted(members.filter("size > 0").select("key", "group", "signature"), F.col("group"), ties.select("group")).filter("_maybe").groupBy("key", "group").agg(F.first("signature").alias("signature"))
    signed = texts.select("key", "group", "size").join(tied, ["key", "group"])
    around = C.written(ties.join(signed, "group").select("centre", "key", "size", "signature"))
    pairs = _crowds(around, "centre").groupBy("centre", "i", "j").applyInArrow(_candidates(percent), "a binary, b binary")
    clusters = C.written(components(pairs).withColumnRenamed("node", "key").withColumnRenamed("root", "cluster"))

    wanted = C.written(texts.select("key", "size", F.col("rep.doc").alias("rep")).join(clusters, "key"))
    read = C.sifted(rows.select("doc_id", "text"), F.xxhash64("doc_id"), wanted.select(F.xxhash64("rep").alias("x"))).filter("_maybe").select(F.col("doc_id").alias("rep"), "text")
    held = _crowds(wanted, "cluster").join(read, "rep").select("cluster", "i", "j", "text")
    links = held.groupBy("cluster", "i", "j").applyInArrow(_verified(n, percent), "a binary, b binary")
    found = components(links)

    named = texts.select("key", "rep").join(found, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    linked_texts = C.written(named.join(least, "root").filter("component <> rep").select("key", "component"))
    alone = members.filter("size = 0").select("at", "size", F.col("at").alias("component"))
    # A text with no earlier one in its component is named by its own first row.
    whose = C.written(texts.select("key", "rep", "often").join(linked_texts, "key", "left").select("key", "often", F.coalesce("component", "rep").alias("component")))
    out = C.met(members.filter("size > 0"), whose, ["key"], "often").select("at", "size", "component").unionByName(alone)
    own_id = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    more = [F.col("at.file").alias(place[0]), F.col("at.row").alias(place[1]), (F.col("at") == F.col("component")).alias("first")] if place else []
    return out.select(own_id("at.doc").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), own_id("component.doc").alias("component_id"), *more)
