"""The registered queries of this subpackage: each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, hmm, html_text, jaccard, lines, oracles, packing, phrases, quality, secrets

#: The vocabulary file, by its place in the installed package.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(_documents(spark, sf_dir))


def _joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scanned(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return spans.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packed(_documents(spark, sf_dir), TOKENIZER)


def op4_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = phrases.deduplicated(_documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), TOKENIZER)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.clustered(_documents(spark, sf_dir), n=4, percent=85)


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_documents(spark, sf_dir)).drop("host", "removed_chars", "removed_words")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return done.withColumn("n_chars", F.length("text").cast("long"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.deduplicated(_documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(_documents(spark, sf_dir), digest="text_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_lm_scoring, op2_secret_scan, op3_best_fit_packing, op4_phrase_automata, op5_bpe_codec,
        op6_ngram_jaccard, op7_line_frequency, op8_html_extraction, op9_line_dedup, op10_exact_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_phrase_automata": oracles.PHRASES, "op6_ngram_jaccard": oracles.JACCARD, "op7_line_frequency": oracles.QUALITY, "op9_line_dedup": oracles.LINES, "op10_exact_dedup": oracles.EXACT}
