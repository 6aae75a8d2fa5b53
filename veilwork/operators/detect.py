"""Detection: texts in, one row per detection out (or one array per text)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.constants import (
    NER_BASE,
    NER_CAPS_PERSON,
    NER_LABELS,
    NER_MULTI_WORD,
    NER_SINGLE_CHAR,
    REGEX_TYPES,
)
from veilwork.functions.checks import iban_length_ok, luhn_ok
from veilwork.functions.columns import compute_once, literal, name
from veilwork.functions.overlaps import without_overlaps
from veilwork.functions.regex import SPACE_MEMBERS, SPARK_PATTERNS
from veilwork.functions.spans import (
    DETECTIONS_TYPE,
    match_offsets,
    regex_detections,
)

NER_ENGINE = "nlp"
NER_ORD = 1000  # recognizer spans come after every structured type
DETECTION_FIELDS = (
    "entity_type",
    "start",
    "end",
    "text",
    "confidence",
    "context",
    "engine",
    "ord",
)


def explode_detections(
    df: DataFrame, key: Sequence[str] = ("doc_id",), column: str = "detections"
) -> DataFrame:
    """One row per detection: the key, then the fields of the detection."""
    return df.select(*[F.col(name(k)) for k in key], F.inline(F.col(name(column))))


def with_detections(
    df: DataFrame,
    types: Iterable[str] = REGEX_TYPES,
    text: str = "text",
    overlaps: bool = True,
    column: str = "detections",
) -> DataFrame:
    """Add the structured detections of each text as an array, in list order.

    ``overlaps=False`` keeps only the survivors, in text order.
    """
    found = regex_detections(name(text), types)
    if overlaps:
        return compute_once(df, **{column: found})
    raw = compute_once(df, _raw=found)
    return compute_once(raw, **{column: without_overlaps("_raw")}).drop("_raw")


def detect(
    df: DataFrame,
    types: Iterable[str] = REGEX_TYPES,
    key: Sequence[str] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Every match of the given types, one row each; overlaps are still there."""
    slim = df.select(*[name(k) for k in key], F.col(name(text)).alias("_text"))
    return slim.select(
        *[name(k) for k in key], F.inline(F.expr(regex_detections("_text", types)))
    )


def offsets(
    df: DataFrame, entity_type: str, key: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """Where the pattern of a type matches: position, start, end, matched text."""
    spans = F.expr(match_offsets(name(text), SPARK_PATTERNS[entity_type]))
    return df.select(*[name(k) for k in key], F.posexplode(spans).alias("position", "span")).select(
        *[name(k) for k in key], "position", "span.start", "span.end", "span.text"
    )


def score_cards(detections: DataFrame) -> DataFrame:
    """Card matches with the outcome of the checksum; the confidence follows from it."""
    return detections.where("entity_type = 'CREDIT_CARD'").withColumn(
        "valid", F.expr(luhn_ok("text"))
    )


def score_ibans(detections: DataFrame) -> DataFrame:
    """IBAN matches with the outcome of the length check."""
    return detections.where("entity_type = 'IBAN'").withColumn(
        "valid", F.expr(iban_length_ok("text"))
    )


def remove_overlaps(df: DataFrame, column: str = "detections") -> DataFrame:
    """Keep the best of overlapping detections in each row's array; no shuffle."""
    return compute_once(df, **{column: without_overlaps(name(column))})


def entity_counts(df: DataFrame, column: str = "detections") -> DataFrame:
    """Per text: is anything there, and how often each type occurs."""
    array = name(column)
    kinds = f"transform({array}, d -> d.entity_type)"
    counts = f"""map_from_entries(transform(array_distinct({kinds}),
        k -> struct(k, size(filter({array}, d -> d.entity_type = k)))))"""
    return df.withColumns(
        {"has_pii": F.expr(f"size({array}) > 0"), "entity_counts": F.expr(counts)}
    )


def entity_totals(detections: DataFrame, *by: str) -> DataFrame:
    """Number of detections per type (and per ``by``), most types are few: one
    small shuffle after map-side counting."""
    return detections.groupBy(*by, "entity_type").agg(F.count(F.lit(1)).alias("n"))


def ingest_ner_spans(spans: DataFrame) -> DataFrame:
    """Detections from a table of recognizer spans (label, start, end, text).

    The label map is five literal entries, so this is a projection, not a join.
    Spans with other labels are dropped.
    """
    space = rf"[{SPACE_MEMBERS}]".replace("\\", "\\\\")
    words = f"size(filter(split(text, '{space}+', -1), w -> length(w) > 0))"
    stripped = f"length(regexp_replace(text, '^{space}+|{space}+$', ''))"
    capitals = (
        r"(text rlike '\\p{IsUppercase}'"
        r" and not text rlike '[\\p{IsLowercase}\\p{Lt}]')"
    )
    confidence = f"""round(case when {stripped} <= 1 then {literal(NER_SINGLE_CHAR)}
        else {literal(NER_BASE)} + if({words} >= 2, {literal(NER_MULTI_WORD)}, 0D)
            - if(label = 'PERSON' and {capitals}, {literal(NER_CAPS_PERSON)}, 0D) end, 3)"""
    kept = ", ".join(literal(label) for label in NER_LABELS)
    fields = {
        "entity_type": f"element_at({literal(NER_LABELS)}, label)",
        "confidence": confidence,
        "context": "''",
        "engine": literal(NER_ENGINE),
        "ord": f"cast({NER_ORD} + start as int)",
    }
    others = [c for c in spans.columns if c not in (*DETECTION_FIELDS, "label")]
    return (
        spans.where(f"label in ({kept})")
        .withColumns({k: F.expr(v) for k, v in fields.items()})
        .select(*others, *DETECTION_FIELDS)
    )


def merge_detections(structured: DataFrame, recognized: DataFrame) -> DataFrame:
    """Both engines' detections in one table, structured ones first by ``ord``."""
    return structured.unionByName(recognized)


def nest_detections(
    detections: DataFrame, key: Sequence[str] = ("doc_id",), column: str = "detections"
) -> DataFrame:
    """One array per text from a detections table.

    A group is the detections of a single text, so it is no larger than a text.
    """
    fields = F.struct(*[F.col(c) for c in DETECTION_FIELDS])
    return detections.groupBy(*key).agg(
        F.collect_list(fields).cast(DETECTIONS_TYPE).alias(column)
    )


def _null_key(key: Sequence[str]) -> str:
    return "(" + " or ".join(f"{name(k)} is null" for k in key) + ")"


def _keyed(spans: DataFrame, key: Sequence[str], *others: str) -> DataFrame:
    """Spans with their key columns under names of their own, which no text table has."""
    return spans.select(*[F.col(name(k)).alias(f"_span_key_{i}") for i, k in enumerate(key)], *map(name, others))


def _same_key(key: Sequence[str], equal: str = "<=>") -> Column:
    return F.expr(" and ".join(f"{name(k)} {equal} _span_key_{i}" for i, k in enumerate(key)))


def with_spans(df: DataFrame, spans: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Add the spans of each text, found by its key, as an array.

    A null in a key equals a null.  Where both tables are bucketed by the key, the texts are
    not shuffled: keys without nulls meet by plain equality, and texts with a null key are a
    branch of their own.  A key of spans may not belong to several texts, since nobody could tell
    whose spans they are: that raises, except on a stream, where only the offsets tell.
    """
    if not df.isStreaming:
        asked = df.select(*map(name, key)).join(_keyed(spans, key).distinct(), _same_key(key), "left_semi")
        if not asked.groupBy(*map(name, key)).count().where("count > 1").isEmpty():
            raise ValueError(f"spans are given for a {', '.join(key)} that several texts have")
    nested = nest_detections(spans, key, column)
    kept = [*map(name, df.columns), column]
    whole, loose = f"not {_null_key(key)}", _null_key(key)
    of_whole = df.where(whole).join(_keyed(nested.where(whole), key, column), _same_key(key, "="), "left")
    of_null = df.where(loose).join(_keyed(nested.where(loose), key, column), _same_key(key), "left")
    return of_whole.select(*kept).unionByName(of_null.select(*kept))


def placed(spans: str, text: str) -> str:
    """SQL: the spans whose text is what stands at their offsets."""
    return f"""filter({spans}, d -> d.start >= 0 and d.end > d.start
        and substring({text}, d.start + 1, d.end - d.start) = d.text)"""


def misplaced_spans(
    df: DataFrame, spans: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """Spans that a scan leaves out: there is no such text, or another text at their offsets."""
    fields = [f"_span.{name(c)}" for c in spans.columns]
    packed = spans.withColumn("_span", F.struct(*map(name, spans.columns)))
    texts = df.select(*map(name, key), F.col(name(text)).alias("_whole"))
    found = _keyed(packed, key, "_span").join(texts, _same_key(key), "left").select(*fields, "_whole")
    there = "`start` >= 0 and `end` > `start` and substring(_whole, `start` + 1, `end` - `start`) = `text`"
    return found.where(f"not coalesce({there}, false)").drop("_whole")
