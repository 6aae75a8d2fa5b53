"""Language identification by rank order of character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from veilwork.llm.base import map_batches, map_rows, whole_text

PROFILE_SIZE = 400
UNKNOWN = "und"
# n-grams counted together in a task before they are summed up
_FLUSH = 1 << 20
_NO_LETTER = re.compile(r"[\W\d_]+")


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of one to three characters of the words.

    A word is a run of letters with a space before and after; a code holds 21 bits
    per character, so n-grams of different length differ.
    """
    plain = _NO_LETTER.sub(" ", f" {text.lower()} ")
    one = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    two = (one[:-1] << 21) | one[1:]
    three = (two[:-1] << 21) | one[2:]
    return np.concatenate([one[one != 32], two, three])


def ranked(text: str, size: int = PROFILE_SIZE) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    codes, counts = np.unique(grams(text), return_counts=True)
    return codes[np.argsort(-counts, kind="stable")[:size]]


def profiles(
    docs: DataFrame, text_column: str, lang_column: str, size: int = PROFILE_SIZE
) -> DataFrame:
    """lang, code, place: the ``size`` most frequent n-grams of each language.

    N-grams are counted over whole texts of all rows with a language; each task adds
    up its own first.  Only the sums of distinct n-grams are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def summed(lang: str) -> pa.RecordBatch:
            codes, counts = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            sizes.pop(lang)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)],
                names=["lang", "code", "n"],
            )

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = grams(text)
                held.setdefault(lang, []).append(codes)
                sizes[lang] = sizes.get(lang, 0) + len(codes)
                if sizes[lang] > _FLUSH:
                    yield summed(lang)
                elif len(sizes) > 64:
                    yield summed(max(sizes, key=sizes.get))
        for lang in list(held):
            yield summed(lang)

    rows = docs.select(whole_text(text_column), F.col(lang_column).alias("lang")).where("lang IS NOT NULL")
    counted = (
        map_batches(rows, count, "lang string, code bigint, n bigint")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return (
        counted.withColumn("place", F.row_number().over(best) - 1)
        .where(F.col("place") < size)
        .select("lang", "code", "place")
    )


def identify(
    docs: DataFrame,
    training: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    size: int = PROFILE_SIZE,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Predicted language of each text: columns id, lang_pred, score.

    With ``keep`` those columns of ``docs`` instead, and _lang_pred and _score.

    Profiles are learned from the rows where ``training`` holds and the language is
    not null.  A text's out-of-place distance to a profile is the sum, over its own most
    frequent n-grams, of how far their places are apart, ``size`` for one the profile lacks.
    The nearest profile wins, ties by name; ``score`` is 1 minus the distance's share of the
    largest possible one.  A null text, one without letters and any text when nothing
    could be learned get ``und`` and 0.  Rows that repeat are predicted each.

    The driver holds the profiles: ``size`` rows for each language.
    """
    learned: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    by_lang: dict[str, list] = {}
    for r in profiles(docs.where(training), text_column, lang_column, size).collect():
        by_lang.setdefault(r["lang"], []).append((r["code"], r["place"]))
    for lang in sorted(by_lang):
        codes, places = np.array(sorted(by_lang[lang]), np.int64).T
        learned[lang] = (codes.copy(), places.copy())

    def predict(text: str | None) -> tuple[str, float]:
        if not learned or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        mine = ranked(text, size)
        own = np.arange(len(mine))
        best, name = None, UNKNOWN
        for lang, (codes, places) in learned.items():
            at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            apart = np.where(codes[at] == mine, np.abs(places[at] - own), size)
            distance = int(apart.sum())
            if best is None or distance < best:
                best, name = distance, lang
        return name, 1.0 - best / (size * len(mine))

    kept = [F.col(id_column).cast("bigint").alias(id_column)] if keep is None else [F.col(f"`{c}`") for c in keep]
    mark = "" if keep is None else "_"
    # a text that is kept is sent once, and predicted where it stands
    own = keep is not None and text_column in keep
    rows = docs.select(*kept) if own else docs.select(*kept, whole_text(text_column).alias("_text"))
    at, passed = (list(keep).index(text_column), len(kept)) if own else (len(kept), len(kept))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at)
        predicted = [predict(t.as_py()) for t in texts] if own else [predict(t) for t in texts.to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                *batch.columns[:passed],
                pa.array([p for p, _ in predicted], pa.string()),
                pa.array([s for _, s in predicted], pa.float64()),
            ],
            names=[*batch.schema.names[:passed], f"{mark}lang_pred", f"{mark}score"],
        )

    schema = StructType([f for f in rows.schema.fields[:passed]])
    schema = schema.add(f"{mark}lang_pred", StringType()).add(f"{mark}score", DoubleType())
    return map_rows(rows, run, schema)


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % modulus, F.lit(-1))
