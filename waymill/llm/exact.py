"""Exact deduplication by progressive refinement.

Rows are grouped by length, then by the hash of a prefix; only rows whose length and prefix are shared are read
whole and hashed in full. Texts never move: what is exchanged are lengths, hashes and ids. Which rows share their
length and prefix is told to the second reading by a bitmap of fixed size, so that a row is hashed where it is
read; a row that the bitmap lets through by chance is hashed for nothing and found to be alone.

Texts are equal when identical without white space. Null text is empty, and empty texts equal each other. Of
equal texts the one with most code points stays, then the one with the smallest id (a null id before all), and
of rows that are alike in both, one. Texts may have any length; each is read by one task and hashed there. An
empty table gives an empty result. Columns named in `carry` pass through; others are left behind, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Code points of the prefix.
PREFIX = 128
#: The white space of the contract, for translate and trim.
BLANKS = " \t\n\x0b\x0c\r"


def bare(text: Column) -> Column:
    """text without white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def crowded(sized: DataFrame) -> DataFrame:
    """_size and _head of more than one row, by length first."""
    narrow = C.written(sized.select("_size", "_head"))
    counted = narrow.groupBy("_size", "_head").agg(F.count("*").alias("n"))
    lengths = counted.groupBy("_size").agg(F.sum("n").alias("rows")).filter("rows > 1")
    return counted.join(lengths, "_size", "left_semi").filter("n > 1").select("_size", "_head")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: Sequence[str] = (), digest: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the carried columns, for every row.

    digest: name of a column with the SHA-256 of every text without white space, where that is wanted for all rows.
    """
    names = [f"_c_{c}" for c in carry]
    content = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), bare(F.col(text)).alias("_bare"), *[F.col(c).alias(n) for n, c in zip(names, carry, strict=True)])
    sized = content.withColumns({"_chars": F.length("_text"), "_size": F.length("_bare"), "_head": F.xxhash64(F.substring("_bare", 1, PREFIX))})
    key = F.xxhash64("_size", "_head")
    seen = C.sifted(sized, key, C.written(crowded(sized)).select(key.alias("_x")))
    full = F.sha2("_bare", 256)
    every = [full.alias("_digest")] if digest else []
    hashed = C.written(seen.select("doc_id", "_chars", "_size", F.when(F.col("_maybe"), full).alias("_full"), F.monotonically_increasing_id().alias("_n"), *names, *every))

    out = [F.col(n).alias(c) for n, c in zip([*names, "_digest"], [*carry, digest], strict=True) if c]
    one = hashed.filter("_full is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *out)
    rows = hashed.filter("_full is not null")
    first = F.min(F.struct((-F.col("_chars")).alias("c"), "doc_id", "_n"))
    best = C.written(rows.groupBy("_size", "_full").agg(F.count("*").alias("group_size"), first.alias("_best")))
    many = C.met(rows, best, ["_size", "_full"], "group_size").select("doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("_n") == F.col("_best._n")).alias("kept"), *out)
    return many.unionByName(one)
