"""Quality rules over single documents, and the frequency of lines across the documents of a host.

Only DataFrame functions. A line is normalised by deleting white space, lowering A-Z and writing 0 for every
digit. A line is common on a host when more than LINE_DOCS documents there hold it and more than LINE_SHARE of
them; documents whose normalised lines are all equal, in the same order, are copies and count once, so that a text
is not rejected for having been copied. A document that keeps fewer than LEAST_WORDS words, or less than LEAST_KEPT
of its word characters, once the common lines are removed is depleted and rejected.

Null text has no words and fails the base rules. A null host is a host of its own. Rows with equal ids or texts
are judged as separate rows. An empty table gives an empty result. Other columns are left behind, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .exact import BLANKS

LEAST_WORDS = 50
#: Documents of a host, copies counted once, that may share a line, and the share of them that may.
LINE_DOCS = 6
LINE_SHARE = 0.005
LEAST_KEPT = 0.3
SYMBOLS = "#*$%&|<>"
FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789" + BLANKS
TO = "abcdefghijklmnopqrstuvwxyz000000000"
#: Up to so many distinct repeated windows are looked up in a list; more are found by sorting.
FEW = 48


def _repeated(words: str) -> Column:
    """Words in 3-word windows that occur twice or more."""
    w = F.col(words)
    return F.when(F.size(w) < 4, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
    )


def _covered(at: Column) -> Column:
    """Words under windows at these sorted positions."""
    steps = F.transform(at, lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(at, i - 1))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines (hash, word characters, words) and family (hash of all lines), _c_ and the name of each column of carry."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    more = [f"_c_{c}" for c in carry]
    split = rows.select(
        "doc_id", "host", "t", *more,
        F.filter(F.split("t", C.SPACE + "+", -1), lambda x: x != "").alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("l"),
    )
    hashed = split.select("*", _repeated("w").alias("h"))
    ordered = hashed.select("*", F.sort_array("h").alias("s"))
    dups = ordered.select("*", F.array_distinct(F.filter("s", lambda x, i: (i > 0) & (x == F.get(F.col("s"), i - 1)))).alias("d"))
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    flagged = dups.select("*", F.when(F.size("d") > FEW, pairs).alias("p"))
    p = F.col("p")
    same = lambda e, i, j: F.coalesce(e["h"] == F.get(p, j)["h"], F.lit(False))
    by_sort = F.sort_array(F.transform(F.filter(p, lambda e, i: same(e, i, i - 1) | same(e, i, i + 1)), lambda e: e["i"]))
    by_list = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains(F.col("d"), x), i)), lambda i: i.isNotNull())
    placed = flagged.select("*", F.when(F.size("d") == 0, F.array().cast("array<int>")).when(F.size("d") > FEW, by_sort).otherwise(by_list).alias("at"))
    n_words = F.size("w").cast("long")
    base = placed.select(
        "doc_id", "host", *more, n_words.alias("n_words"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("at")).alias("n_repeat_words"),
        F.transform("l", lambda x: F.translate(x, FROM, TO)).alias("n"),
        F.transform("l", lambda x: F.size(F.split(F.btrim(x, F.lit(BLANKS)), C.SPACE + "+"))).alias("k"),
    )
    lines = F.zip_with("n", "k", lambda x, k: F.struct(F.unhex(F.md5(x)).alias("h"), F.length(x).alias("c"), k.alias("w")))
    family = F.when(F.size("n") > 0, F.unhex(F.md5(F.array_join("n", "\n"))))  # a normalised line holds no line end
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base.select("*", failed.alias("base_failed"), lines.alias("lines"), family.alias("family")).drop("n", "k")


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """The measures of every row, removed_chars and removed_words (of common lines), kept and the columns of carry."""
    own = measured(docs, id_col, text, host, carry)
    table = C.written(own.withColumn("row", F.monotonically_increasing_id()))
    held = table.select("row", "host", "family", F.explode("lines").alias("x")).select("row", "host", "family", "x.h", "x.c", "x.w")
    hosts = table.select("host", "family").filter("family is not null").distinct().groupBy("host").agg(F.count("*").alias("n_docs"))
    often = held.select("host", "h", "family").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > LINE_DOCS)
    same_host = F.col("a.host").eqNullSafe(F.col("b.host"))
    common = often.alias("a").join(hosts.alias("b"), same_host).filter(F.col("n") > LINE_SHARE * F.col("n_docs")).select("a.host", "h")
    removed = held.alias("a").join(common.alias("b"), same_host & (F.col("a.h") == F.col("b.h"))).groupBy("row").agg(F.sum("c").alias("removed_chars"), F.sum("w").alias("removed_words"))
    joined = table.drop("lines", "family").join(removed, "row", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("removed_chars", "removed_words")})
    left, words = F.col("word_chars") - F.col("removed_chars"), F.col("n_words") - F.col("removed_words")
    depleted = (words < LEAST_WORDS) | (left < LEAST_KEPT * F.col("word_chars"))
    measures = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_chars", "removed_words"]
    return joined.select(*measures, (~F.col("base_failed") & ~depleted).alias("kept"), *[F.col(f"_c_{c}").alias(c) for c in carry])
