"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

Every stage works on all rows of its input. Rows are told apart by their place in the files that a stage reads, so
rows with equal ids are judged one by one. Nulls, empty texts, repeated rows, very long texts and empty tables are
handled as the operators say; columns beyond those of documents are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.llm import common, exact, jaccard, packing, quality, secrets
from waymill.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PLACE = ("_file", "_row")


def _kept(docs: DataFrame, verdict: DataFrame, kept: str) -> DataFrame:
    """docs without the rows whose verdict is not kept. Texts move only where a sieve cannot clear their place."""
    dropped = common.written(verdict.filter(~F.col(kept)).select(*PLACE))
    return common.without(docs, dropped, list(PLACE)).select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    docs = common.numbered(docs.select(*COLUMNS))
    return _kept(docs, quality.judged(docs, carry=PLACE), "kept")


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one stays."""
    docs = common.numbered(docs.select(*COLUMNS))
    return _kept(docs, exact.groups(docs, carry=PLACE), "kept")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles of similarity 0.8 or more, the one with the smallest id stays."""
    docs = common.numbered(docs.select(*COLUMNS))
    return _kept(docs, jaccard.clustered(docs, n=5, percent=80, place=PLACE), "first")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; n_chars follows the text."""
    done = secrets.redacted(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.best_fit_packed(docs, TOKENIZER)


STAGES = [("quality_rules", rules), ("exact_dedup", copies), ("ngram_jaccard", near_copies), ("secret_scan", redact), ("best_fit_packing", pack)]

#: Secret scanning and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs)
    return docs
