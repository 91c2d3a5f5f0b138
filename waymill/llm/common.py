"""What the operators of this subpackage share.

Three of them (scoring, phrase removal, BPE) need statistics of distinct words or windows over the whole
corpus. They use one exchange pattern: documents are gathered into *blocks* of bounded size and written once;
each block keeps a sorted, compressed list of its distinct keys per *shard* (a hash of the key); shards merge
the lists of all blocks and answer each block; blocks join the answers back by position. So a key costs a few
compressed bytes per block instead of a row per occurrence, and a key that occurs everywhere costs one entry
per block, however many rows hold it.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes gathered into a block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Text bytes that a shard answers for.
SHARD_BYTES = 256 << 20
#: Spark's own bound on the buckets of a table.
MAX_BUCKETS = 100_000
#: Bytes of a block for each shard that it keeps a list for, and the most that a block may have: lists stay worth
#: their row when there are many shards.
LIST_BYTES, MOST_BYTES = 64 << 10, 256 << 20
#: Bits of a sieve, a power of two: 8 MB, whatever the data.
SIEVE_BITS = 1 << 26
#: A key with more than one in this many of all rows is hot; there are fewer than this many.
HOT = 1000
#: White space of the contracts: blank and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"

#: What empties the memories that workers keep from task to task.
FORGETS: list[Callable[[], None]] = []

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, one of this machine if Spark runs here alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="llm-"))
    return f"file://{_own_dir[0]}"


def written(df: DataFrame, bucket: str | None = None, n: int = 0) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here and every later read sees the same rows.

    With bucket, files are dealt by that column without a shuffle and sorted by it, and a later grouping or merge join by
    it needs no exchange either.
    """
    spark, name = df.sparkSession, f"llm_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    out = df.write.option("compression", "zstd")
    if bucket is None:
        out.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    out.bucketBy(n, bucket).sortBy(bucket).option("path", path).saveAsTable(name)
    return spark.table(name)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one scan of one column."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def shards_for(spark: SparkSession, n_bytes: int) -> int:
    """How many shards and buckets: as many as shuffle partitions, more where a shard would be too large."""
    return min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / SHARD_BYTES)))


def block_bytes(shards: int) -> int:
    """Text bytes of a block, so that blocks x shards grows with the data and not with its square."""
    return min(MOST_BYTES, max(BLOCK_BYTES, shards * LIST_BYTES))


def _bit(key: Column) -> Column:
    return F.pmod(key, F.lit(SIEVE_BITS)) + 1


def sifted(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """df with _maybe: false where key (a long) is certainly not among those of wanted (one column of longs).

    The keys become a bitmap of SIEVE_BITS, which goes to every task: its size has a bound that is known. No row
    of df moves. Where the bitmap is full all rows are maybe there, which costs time and changes no result.
    """
    bits = wanted.select(_bit(F.col(wanted.columns[0])).alias("_x")).select(F.bitmap_bucket_number("_x").alias("_bucket"), F.bitmap_bit_position("_x").alias("_at"))
    bits = bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    placed = df.withColumn("_key", _bit(key)).withColumn("_bucket", F.bitmap_bucket_number("_key"))
    joined = placed.join(F.broadcast(bits), "_bucket", "left")
    at = F.bitmap_bit_position("_key")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return joined.withColumn("_maybe", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_key", "_bucket", "_bits")


def without(df: DataFrame, dropped: DataFrame, on: list[str]) -> DataFrame:
    """df less the rows whose columns on are in dropped. Only rows that the sieve cannot clear are exchanged."""
    key = F.xxhash64(*on)
    seen = sifted(df, key, dropped.select(key.alias("_x")))
    unsure = seen.filter("_maybe").join(dropped.select(*on).distinct(), on, "left_anti").select(*df.columns)
    return seen.filter("not _maybe").select(*df.columns).unionByName(unsure)


def met(rows: DataFrame, table: DataFrame, on: list[str], often: str) -> DataFrame:
    """rows joined to the one row that table has for each key. often: the column of table that counts the rows of a key.

    A key with more than one in HOT of all rows meets its row where its rows are: there are fewer than HOT such keys,
    few enough for every task. Only rows of other keys are exchanged.
    """
    least = (table.agg(F.sum(often)).first()[0] or 0) // HOT
    hot, cold = table.filter(F.col(often) > least), table.filter(F.col(often) <= least)
    there = rows.join(F.broadcast(hot), on)
    return there.unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with _file and _row, which name each row: its place in the files that docs is read from.

    Rows that come from no file are written first. Unlike numbers that a task gives, places stay the same when
    rows are read again, by any number of executors.
    """
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    own = [F.col(f"`{c}`") for c in docs.columns]
    try:
        return docs.select(*own, *place)
    except AnalysisException:
        return written(docs).select(*own, *place)


def whole(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text as bytes): null text is empty, other columns are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def pack(data: bytes | np.ndarray, level: int = 3) -> bytes:
    return zstandard.compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes(), level)


def unpack(data: bytes, dtype=None):
    """Bytes, or an array of dtype."""
    raw = zstandard.decompress(data) if data else b""
    return raw if dtype is None else np.frombuffer(raw, dtype)


def gathered(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list, list[bytes]]]:
    """(block number, ids, texts): runs of documents of at most limit bytes, or one longer document.

    Numbers are unique over tasks. They hold only for rows that are written, as a task that runs again may
    read its rows in another order.
    """
    base, n, ids, texts, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0, [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if ids and size + len(text) > limit:
                yield base + n, ids, texts
                n, ids, texts, size = n + 1, [], [], 0
            ids.append(doc)
            texts.append(text)
            size += len(text) + 1
    if ids:
        yield base + n, ids, texts


def starts(counts: np.ndarray) -> np.ndarray:
    """Where each run starts; one more entry for the end."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])


def spans(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions begin[i] .. begin[i] + counts[i] - 1, one run after the other."""
    ends = np.cumsum(counts, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(begin, np.int64) - (ends - counts), counts)


def rows(schema: str | pa.Schema, data: list[tuple]) -> pa.RecordBatch:
    """A batch of these rows."""
    columns = list(zip(*data, strict=True)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def trimmed() -> None:
    """Gives back what earlier tasks of other operators left in this worker: what FORGETS forget, and memory that allocators keep."""
    for forget in FORGETS:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def crc(col: Column) -> Column:
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))
