"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) on a table with the columns of
``documents``; ``run`` writes what it returns as Parquet and reads it back as the next one's input.
All but the last return those columns again.  Edge cases, the same in all stages: a null text
counts as empty, a null id as larger than all others, columns beside id, text and n_chars are
passed through whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from public_tokenizers import path as tokenizer_path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.base import rows_with
from veilwork.llm.language_id import UNKNOWN, identify, remainder
from veilwork.llm.line_dedup import EVERY_LINE, deduplicate_lines
from veilwork.llm.ngram_join import similar_components
from veilwork.llm.packing import pack
from veilwork.llm.substring_dedup import remove_repeated
from veilwork.session import materialized, new_folder

TOKENIZER = tokenizer_path("word_bpe_49k.json")
# A text this far from every language is none; prose of any length scores above 0.3.
LEAST_SCORE = 0.1


def _with_text(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of ``docs`` with another text, ``n_chars`` following it where present."""
    kind = dict(docs.dtypes).get("n_chars")
    return [
        text.alias("text")
        if c == "text"
        else F.length(text).cast(kind).alias(c)
        if c == "n_chars"
        else F.col(f"`{c}`")
        for c in docs.columns
    ]


# Columns of documents; the stages' own columns have none of these names.
_OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _any_columns(stage: Callable) -> Callable:
    """A stage that never sees the names of further columns, so that they can clash with none of its own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        safe = {c: c if c in _OWN else f"further_{k}_of_the_input" for k, c in enumerate(docs.columns)}
        out = stage(spark, docs.select([F.col(f"`{c}`").alias(s) for c, s in safe.items()]), sf_dir)
        return out.select([F.col(s).alias(c) for c, s in safe.items()])

    return run


def _row_number(docs: DataFrame) -> DataFrame:
    """``docs`` stored with a number for each row, which no later read can change."""
    return materialized(docs.withColumn("_row", F.monotonically_increasing_id()))


@_any_columns
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach.

    Profiles are learned from the documents with a language, as in the operator's own query
    without the held-out quarter.  A text without letters goes, and so does one that no
    profile resembles; every row that repeats is judged alike.  Where nothing can be learned,
    there is no language to tell and no row stays.
    """
    found = identify(docs, remainder("doc_id", 4) != 2, keep=docs.columns)
    return found.where((F.col("_lang_pred") != UNKNOWN) & (F.col("_score") >= LEAST_SCORE)).select(
        [F.col(f"`{c}`") for c in docs.columns]
    )


@_any_columns
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand, equal or nearly so, in earlier places.

    Short lines are compared like all others.  A document goes if each of its lines that are
    not blank was removed: it was a copy.
    """
    found = deduplicate_lines(docs, least_chars=EVERY_LINE, mark="_")
    blank = r"(?U)[\s\x1c-\x1f]+"  # what Python's split() cuts at
    left = F.exists(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, blank, "") != "")
    return found.where((F.col("_n_removed") == 0) | left).select(_with_text(docs, F.col("text")))


@_any_columns
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Five words, similarity 0.8.  Of rows that repeat an id with its group's name, one stays;
    a row with a null id stays if its group has no other.
    """
    numbered = _row_number(docs)
    named = similar_components(
        numbered.select(F.col("_row").alias("row"), "text"), id_column="row"
    )
    # rows stand for documents in the join; their ids decide who stays
    slim = numbered.select(F.col("_row").alias("row"), F.col("doc_id").cast("bigint").alias("doc"))
    first = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "row")
    stays = materialized(
        named.join(slim, "row").groupBy("component_id").agg(F.min(first).alias("first")).select(
            F.col("first.row").alias("_row")
        )
    )
    return rows_with(numbered, stays, "_row").select([F.col(f"`{c}`") for c in docs.columns])


@_any_columns
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 13 words or more that earlier documents have.

    Only documents that lose something change, to their words with single spaces between.
    One that loses all its words goes.
    """
    found = remove_repeated(docs, keep=docs.columns)
    text = F.when(F.col("_n_removed") > 0, F.col("_kept")).otherwise(F.col("text"))
    some = (F.col("_n_removed") == 0) | (F.col("_n_removed") < F.col("_n_words"))
    return found.where(some).select(_with_text(docs, text))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens: the operator's rows."""
    return pack(docs, TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: MinHash, matching statistics and the tokenizer are beyond SQL: checked against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
