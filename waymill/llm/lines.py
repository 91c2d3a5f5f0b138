"""Line deduplication with levelled sorted runs of line hashes.

A run is a table (key, n documents, holder), in buckets sorted by key. Batches of documents come in falling order of
their ids, so the first batch that brings a key holds its largest id: each new batch is merge-anti-joined with the
runs, key by key without an exchange of them; a key that no run has gets its holder, any other only adds to its
count, and the batch becomes a run of its own. A level that has FANOUT runs is merged into one run of the next
level. So a batch reads a logarithmic number of runs and no run is rewritten often. Very frequent lines go where they
stand; other texts move only if a line of theirs may go.

Null or empty text is one empty line. A null id counts as smaller than all, and rows with equal ids are one
document. An empty table gives an empty result. Other columns pass through but for the ones that the operator
adds, whose names it takes over.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .exact import BLANKS

LEAST_CHARS = 40
LEAST_DOCS = 5
BATCHES = 4
FANOUT = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NULL_ID = -(1 << 63)


def key(line: Column) -> Column:
    """The line stripped of white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def keyed(docs: DataFrame, id_col: str, text: str, least_chars: int) -> DataFrame:
    """(doc, key, again): the hash of every key that is long enough, once for each row. Where again is false, no other row has the id."""
    rows = docs.select(_number(id_col).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    repeated = rows.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select(F.xxhash64("doc").alias("x"))
    keys = F.array_distinct(F.filter(F.transform(F.split("t", "\n", -1), key), lambda k: F.length(k) >= least_chars))
    held = C.sifted(rows, F.xxhash64("doc"), repeated).select("doc", F.col("_maybe").alias("again"), F.explode(keys).alias("k"))
    return held.select("doc", F.unhex(F.md5("k")).alias("key"), "again")


def _number(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))


class Runs:
    """Levels of runs sorted by key: (key binary, n long, holder long or null)."""

    def __init__(self, buckets: int, fanout: int = FANOUT):
        self.buckets, self.fanout, self.levels = buckets, fanout, [[]]

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds the run of a batch of distinct (doc, key); returns it: the holder is null where an earlier run has the key."""
        own = batch.groupBy("key").agg(F.count("*").alias("n"), F.max("doc").alias("holder"))
        for earlier in self.runs():
            # An anti-join that keeps what it finds for the counts, and takes its holder away.
            own = own.join(earlier.select("key", F.lit(True).alias("known")).hint("merge"), "key", "left").select("key", "n", F.when(F.col("known").isNull(), F.col("holder")).alias("holder"))
        run = self._sorted(own)
        self.levels[0].append(run)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                merged = self._sorted(self.merged(self.levels[level]))
                self.levels[level] = []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
        return run

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        """One run of all, by merge joins; of a key, one run at most has the holder.

        Not a union: Spark 4.1 takes a union of bucketed scans to be dealt by key, reads them one after the other, and
        groups wrongly.
        """

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            a, b = (x.select("key", *[F.col(c).alias(f"{c}_{i}") for c in ("n", "holder")]) for i, x in enumerate((a, b)))
            n = F.coalesce(F.col("n_0"), F.lit(0)) + F.coalesce(F.col("n_1"), F.lit(0))
            return a.join(b.hint("merge"), "key", "full").select("key", n.alias("n"), F.coalesce("holder_0", "holder_1").alias("holder"))

        return reduce(both, runs)

    def _sorted(self, run: DataFrame) -> DataFrame:
        return C.written(run.select("key", "n", "holder"), "key", self.buckets)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with text lacking the repeated lines, and n_lines (before) and n_dropped."""
    table = C.written(keyed(docs, id_col, text, least_chars))
    all_keys = table.filter("not again").select("doc", "key").unionByName(table.filter("again").select("doc", "key").distinct())
    cuts = table.select("doc").agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    runs = Runs(min(C.MAX_BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):  # falling ids
        own = all_keys if low is None else all_keys.filter(F.col("doc") > low)
        runs.add(own if high is None else own.filter(F.col("doc") <= high))
    common = C.written(runs.merged(runs.runs()).filter(F.col("n") >= least_docs))
    # A key of more than one in HOT of all common lines goes where it stands: there are fewer than HOT such keys.
    least = (common.agg(F.sum("n")).first()[0] or 0) // C.HOT
    hot = {bytes(r.key): r.holder for r in common.filter(F.col("n") > least).select("key", "holder").collect()}
    cold = common.filter(F.col("n") <= least)
    maybe = C.sifted(table.select("doc", "key"), F.xxhash64("key"), cold.select(F.xxhash64("key").alias("x"))).filter("_maybe").select("doc", "key")
    drops = C.written(maybe.join(cold, "key").filter("doc <> holder").groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("key").alias("_drop")))

    kept = [f for f in docs.schema if f.name not in ("n_lines", "n_dropped")]
    at = [f.name for f in kept].index(text)
    joined = docs.select(*[F.col(f"`{f.name}`").alias(f"_{i}") for i, f in enumerate(kept)], _number(id_col).alias("_doc"))
    placed = C.sifted(joined, F.xxhash64("_doc"), drops.select(F.xxhash64("_doc").alias("_x")))
    columns = [*[f"_{i}" for i in range(len(kept))], "_doc"]
    hit = placed.filter("_maybe").join(drops, "_doc", "left").select(*columns, "_drop")
    joined = placed.filter("not _maybe").select(*columns, F.lit(None).cast("array<binary>").alias("_drop")).unionByName(hit)

    def rewrite(batches):
        for batch in batches:
            out, n_lines, n_dropped = [], [], []
            own = (batch.column(i).to_pylist() for i in (at, len(kept), len(kept) + 1))
            for value, doc, drop in zip(*own, strict=True):
                lines = (value or "").split("\n")
                n = len(lines)
                if drop or hot:
                    gone = set(drop or ())
                    lines = [x for x in lines if len(x) < least_chars or not _goes(x, doc, gone, hot, least_chars)]
                out.append("\n".join(lines))
                n_lines.append(n)
                n_dropped.append(n - len(lines))
            columns = [*batch.columns[: len(kept)], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*[f"_{i}" for i in range(len(kept))], "n_lines", "n_dropped"])

    schema = ", ".join([*[f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)], "n_lines long", "n_dropped long"])
    done = joined.mapInArrow(rewrite, schema)
    return done.select(*[F.col(f"_{i}").alias(f.name) for i, f in enumerate(kept)], "n_lines", "n_dropped")


def _goes(line: str, doc: int, gone: set[bytes], hot: dict[bytes, int], least_chars: int) -> bool:
    bare = line.strip(BLANKS)
    if len(bare) < least_chars:
        return False
    name = hashlib.md5(bare.encode().lower()).digest()
    return name in gone or hot.get(name, doc) != doc
