"""Blocks whose distinct words are dealt to shards: the exchange that LM scoring and BPE share."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK = "block long, ids array<long>, counts array<int>, words binary, vocab array<binary>, weights array<binary>, n_trained long, n_ends long"
_BLOCK = pa.schema(
    [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("words", pa.binary()), ("vocab", pa.list_(pa.binary())), ("weights", pa.list_(pa.binary())), ("n_trained", pa.int64()), ("n_ends", pa.int64())]
)


def indexed(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the word number at every position, and words per text.

    bytes.split() without an argument splits at exactly the blank and the controls 9 to 13.
    """
    seen: dict[bytes, int] = {}
    counts, numbers = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        found = text.split()
        counts[i] = len(found)
        numbers.append(np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int32, len(found)))
    return list(seen), np.concatenate(numbers) if numbers else np.zeros(0, np.int32), counts


def dealt(words: list[bytes], n: int) -> tuple[np.ndarray, list[list[int]]]:
    """New number of each word when the lists of the shards follow each other, and the words of each shard, sorted."""
    parts: list[list[int]] = [[] for _ in range(n)]
    for i in sorted(range(len(words)), key=words.__getitem__):
        parts[zlib.crc32(words[i]) % n].append(i)
    place = np.empty(len(words), np.int32)
    place[[i for p in parts for i in p]] = np.arange(len(words), dtype=np.int32)
    return place, parts


def blocks(docs: DataFrame, n: int, lower: bool = False, trained: Callable[[object], bool] | None = None) -> DataFrame:
    """A written table of blocks (see BLOCK). docs: doc_id, text as bytes.

    words: the number of the word at every position of the block's texts; vocab: the distinct words of each
    shard; weights, with trained: how often each of them occurs in the texts whose id is to be learnt from.
    """

    limit = C.block_bytes(n)

    def make(batches):
        for block, ids, texts in C.gathered(batches, limit):
            words, numbers, counts = indexed([t.lower() for t in texts] if lower else texts)
            place, parts = dealt(words, n)
            weights, n_trained, ends = [], 0, 0
            if trained:
                use = np.fromiter(map(trained, ids), bool, len(ids))
                often = np.bincount(numbers[np.repeat(use, counts)], minlength=len(words)).astype(np.uint32)
                weights, n_trained, ends = [C.pack(often[p]) if p else None for p in parts], int(counts[use].sum()), int(use.sum())
            vocab = [C.pack(b"\n".join([words[i] for i in p])) if p else None for p in parts]
            yield C.rows(_BLOCK, [(block, ids, counts.astype(np.int32), C.pack(place[numbers], 6) if len(numbers) else b"", vocab, weights or [None] * n, n_trained, ends)])

    return C.written(docs.mapInArrow(make, BLOCK), "block", n)


def answers(table: DataFrame, answer: Callable, schema: str) -> DataFrame:
    """answer(shard, iterator over (block, packed words, packed weights)), once per shard, yields batches of schema."""

    def shard(key, batches):
        def lists():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("block", "vocab", "weights")), strict=True)

        yield from answer(key[0].as_py(), lists())

    lists = table.select("block", F.posexplode(F.arrays_zip("vocab", "weights")).alias("shard", "x"))
    return lists.filter("x.vocab is not null").select("block", "shard", "x.vocab", "x.weights").groupBy("shard").applyInArrow(_streamed(shard), schema)


def _streamed(f):
    """The grouped call that takes an iterator of batches is told by its type hints."""
    from collections.abc import Iterator

    def call(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(key, batches)

    # The module postpones annotations; Spark reads them as types.
    call.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return call
