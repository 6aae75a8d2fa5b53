"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import bpe
from veilwork.llm.base import documents
from veilwork.llm.class_lm import score_texts
from veilwork.llm.exact_dedup import exact_duplicates
from veilwork.llm.language_id import identify, remainder
from veilwork.llm.license_scan import scan_licenses
from veilwork.llm.line_dedup import EVERY_LINE, deduplicate_lines
from veilwork.llm.ngram_join import similar_components
from veilwork.llm.packing import pack
from veilwork.llm.simhash import near_duplicates
from veilwork.llm.spelling import spelling_variants
from veilwork.llm.spot_signatures import edited_fingerprints
from veilwork.llm.substring_dedup import remove_repeated
from veilwork.llm.whitening import whiten

TOKENIZER = tokenizer_path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@_query
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(documents(spark, sf_dir), TOKENIZER), TOKENIZER)


@_query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate_lines(documents(spark, sf_dir), least_chars=EVERY_LINE)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@_query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, remainder("doc_id", 4) != 2)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@_query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir), words=4, percent=85)


@_query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), TOKENIZER)


@_query
def op6_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


@_query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


@_query
def op8_class_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_texts(documents(spark, sf_dir), remainder("doc_id", 10) != 0)
    return found.select(
        "doc_id",
        (remainder("doc_id", 10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "perplexity",
    )


@_query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


@_query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


@_query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


ORACLES["op9_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM t JOIN g USING (text_sha256)
"""
