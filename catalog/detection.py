"""Detection, context scoring and rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import TEXTS_SQL, texts
from catalog.oracle_parts import context_columns, iban_ok, luhn, raw_all, raw_of, with_parts
from catalog.registry import query
from veilwork.constants import REGEX_TYPES
from veilwork.functions.detectors import python_detector
from veilwork.operators.context import context_signals, score_context
from veilwork.operators.detect import (
    detect,
    entity_counts,
    entity_totals,
    explode_detections,
    ingest_ner_spans,
    merge_detections,
    offsets,
    remove_overlaps,
    score_cards,
    score_ibans,
    with_detections,
)
from veilwork.operators.rules import (
    apply_source_rules,
    filter_by_threshold,
    filter_disabled,
    resolve_rules,
)
from veilwork.plans.scan import scan
from veilwork.policy import Policy

SPAN = 'doc_id, entity_type, start, "end", text, confidence'
SPAN_COLUMNS = ["doc_id", "entity_type", "start", "end", "text", "confidence"]


def _texts_only(body: str) -> str:
    return f"WITH texts AS MATERIALIZED ({TEXTS_SQL}) {body}"


def _register_type(kind: str) -> None:
    @query(f"detect_{kind.lower()}", _texts_only(f"SELECT {SPAN} FROM ({raw_of(kind)})"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return detect(texts(spark, sf), [kind]).select(*SPAN_COLUMNS)


for _kind in REGEX_TYPES:
    _register_type(_kind)


@query("detect_all", _texts_only(f"SELECT {SPAN}, ord, 'regex' AS engine FROM ({raw_all()})"))
def detect_all(spark: SparkSession, sf: str) -> DataFrame:
    return detect(texts(spark, sf)).select(*SPAN_COLUMNS, "ord", "engine")


_OFFSET_TYPES = ("EMAIL", "PHONE_NUMBER", "IP_ADDRESS")


@query(
    "match_offsets",
    _texts_only(
        'SELECT doc_id, entity_type, CAST(n - 1 AS INTEGER) AS position, start, "end", text'
        f" FROM ({raw_all(_OFFSET_TYPES)})"
    ),
)
def match_offsets(spark: SparkSession, sf: str) -> DataFrame:
    source = texts(spark, sf)
    parts = [
        offsets(source, kind).withColumn("entity_type", F.lit(kind)) for kind in _OFFSET_TYPES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "card_luhn_score",
    _texts_only(
        f"SELECT {SPAN}, {luhn('text')} AS valid FROM ({raw_of('CREDIT_CARD')})"
    ),
)
def card_luhn_score(spark: SparkSession, sf: str) -> DataFrame:
    return score_cards(detect(texts(spark, sf), ["CREDIT_CARD"])).select(*SPAN_COLUMNS, "valid")


@query(
    "iban_length_score",
    _texts_only(f"SELECT {SPAN}, {iban_ok('text')} AS valid FROM ({raw_of('IBAN')})"),
)
def iban_length_score(spark: SparkSession, sf: str) -> DataFrame:
    return score_ibans(detect(texts(spark, sf), ["IBAN"])).select(*SPAN_COLUMNS, "valid")


@query("remove_overlaps", with_parts(f"SELECT {SPAN} FROM first_pass"))
def overlaps_removed(spark: SparkSession, sf: str) -> DataFrame:
    raw = with_detections(texts(spark, sf))
    return explode_detections(remove_overlaps(raw)).select(*SPAN_COLUMNS)


@query(
    "entity_counts",
    with_parts(
        """SELECT t.doc_id, count(c.n) > 0 AS has_pii,
            coalesce(string_agg(c.entity_type || '=' || c.n, ',' ORDER BY c.entity_type), '')
                AS counts
        FROM texts t LEFT JOIN (SELECT doc_id, entity_type, count(*) AS n FROM first_pass
            GROUP BY ALL) c USING (doc_id) GROUP BY t.doc_id"""
    ),
)
def counts_per_text(spark: SparkSession, sf: str) -> DataFrame:
    counted = entity_counts(with_detections(texts(spark, sf), overlaps=False))
    listed = """array_join(array_sort(transform(map_entries(entity_counts),
        e -> concat(e.key, '=', e.value))), ',')"""
    return counted.select("doc_id", "has_pii", F.expr(listed).alias("counts"))


# Spans of an outside recognizer, derived from the first words of every text.
_SPANS = """SELECT doc_id, label, 0 AS start, CAST(length(span) AS INT) AS "end", span AS text
    FROM (SELECT doc_id,
            CASE doc_id % 7 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' WHEN 2 THEN 'GPE'
                WHEN 3 THEN 'LOC' WHEN 4 THEN 'FAC' WHEN 5 THEN 'DATE' ELSE 'PERSON' END AS label,
            CASE WHEN doc_id % 3 = 0 THEN split_part(text, ' ', 1)
                ELSE concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2)) END AS span
        FROM texts)
    WHERE length(span) > 0"""


def ner_spans(source: DataFrame) -> DataFrame:
    sql = _SPANS.replace('"end"', "`end`").replace("FROM texts", "FROM {texts}")
    return source.sparkSession.sql(sql, texts=source)


NER_SQL = f"""SELECT doc_id, CASE label WHEN 'PERSON' THEN 'PERSON_NAME' WHEN 'ORG' THEN 'ORGANIZATION'
        WHEN 'FAC' THEN 'ADDRESS' ELSE 'LOCATION' END AS entity_type,
        CAST(1000 + start AS INTEGER) AS ord, CAST(start AS INTEGER) AS start, "end", text,
        CAST(round(CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) <= 1 THEN 0.2
            ELSE 0.75 + CASE WHEN len(list_filter(string_split_regex(text, '\\s+'),
                    lambda w: w <> '')) >= 2 THEN 0.1 ELSE 0 END
                - CASE WHEN label = 'PERSON' AND upper(text) = text AND lower(text) <> text
                    THEN 0.15 ELSE 0 END END, 3) AS DOUBLE) AS confidence
    FROM ({_SPANS}) WHERE label <> 'DATE'"""


@query("ingest_ner_spans", _texts_only(f"SELECT {SPAN}, 'nlp' AS engine FROM ({NER_SQL})"))
def ner_ingested(spark: SparkSession, sf: str) -> DataFrame:
    return ingest_ner_spans(ner_spans(texts(spark, sf))).select(*SPAN_COLUMNS, "engine")


@query(
    "merge_engines",
    with_parts(f"SELECT {SPAN}, ord, engine FROM first_pass", ner=NER_SQL),
)
def engines_merged(spark: SparkSession, sf: str) -> DataFrame:
    source = texts(spark, sf)
    structured = explode_detections(with_detections(source, overlaps=False))
    recognized = ingest_ner_spans(ner_spans(source))
    return merge_detections(structured, recognized).select(*SPAN_COLUMNS, "ord", "engine")


# --- context -------------------------------------------------------------------


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return context_signals(with_detections(texts(spark, sf), overlaps=False))


def _context_sql(columns: str) -> str:
    return with_parts(
        f"SELECT doc_id, entity_type, start, {columns} FROM ({context_columns()})"
    )


@query("context_window", _context_sql("window_text AS context"))
def context_window(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf).select("doc_id", "entity_type", "start", "context")


@query("context_boost", _context_sql("boosted"))
def context_boost(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf).select("doc_id", "entity_type", "start", "boosted")


@query("context_reduce", _context_sql("reduced"))
def context_reduce(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf).select("doc_id", "entity_type", "start", "reduced")


@query("context_label", _context_sql("labelled"))
def context_label(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf).select("doc_id", "entity_type", "start", "labelled")


@query("context_rescore", with_parts(f"SELECT {SPAN}, context FROM scored"))
def context_rescore(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_context(with_detections(texts(spark, sf), overlaps=False))
    return explode_detections(scored).select(*SPAN_COLUMNS, "context")


# --- rules ---------------------------------------------------------------------

# A rule table: names in any case, nulls inherit (default here: hash, 0.7).
RULE_ROWS = """('email', true, 'partial', CAST(NULL AS DOUBLE)), ('SSN', true, 'hash', 0.5),
    ('phone_number', CAST(NULL AS BOOLEAN), CAST(NULL AS S), 0.9),
    ('CREDIT_CARD', false, CAST(NULL AS S), CAST(NULL AS DOUBLE)),
    ('Passport_Number', true, 'redact', 0.75), ('date_of_birth', true, CAST(NULL AS S), 0.6)"""
_RULES = (
    f"SELECT * FROM (VALUES {RULE_ROWS})"
    " AS r(entity_type, enabled, masking_strategy, confidence_threshold)"
)
_RESOLVED_SQL = f"""SELECT upper(entity_type) AS entity_type, coalesce(enabled, true) AS enabled,
        coalesce(masking_strategy, 'hash') AS masking_strategy,
        CAST(coalesce(confidence_threshold, 0.7) AS DOUBLE) AS confidence_threshold
    FROM ({_RULES.replace("AS S)", "AS VARCHAR)")})"""


def rules(spark: SparkSession) -> DataFrame:
    table = spark.sql(_RULES.replace("AS S)", "AS STRING)"))
    return resolve_rules(
        table.withColumn("confidence_threshold", F.col("confidence_threshold").cast("double")),
        default_strategy="hash",
    )


@query(
    "resolve_rules",
    with_parts(
        f"""SELECT d.doc_id, d.entity_type, d.start, r.enabled, r.masking_strategy,
            r.confidence_threshold
        FROM first_pass d LEFT JOIN ({_RESOLVED_SQL}) r USING (entity_type)"""
    ),
)
def rules_resolved(spark: SparkSession, sf: str) -> DataFrame:
    found = explode_detections(with_detections(texts(spark, sf), overlaps=False))
    return found.join(F.broadcast(rules(spark)), "entity_type", "left").select(
        "doc_id", "entity_type", "start", "enabled", "masking_strategy", "confidence_threshold"
    )


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return explode_detections(
        score_context(with_detections(texts(spark, sf), overlaps=False))
    )


@query(
    "filter_disabled_types",
    with_parts(
        f"""SELECT {SPAN} FROM scored LEFT JOIN ({_RESOLVED_SQL}) r USING (entity_type)
        WHERE coalesce(enabled, true)"""
    ),
)
def disabled_types(spark: SparkSession, sf: str) -> DataFrame:
    return filter_disabled(_scored(spark, sf), rules(spark)).select(*SPAN_COLUMNS)


@query(
    "filter_by_threshold",
    with_parts(
        f"""SELECT {SPAN} FROM scored LEFT JOIN ({_RESOLVED_SQL}) r USING (entity_type)
        WHERE confidence >= coalesce(confidence_threshold, 0.7)"""
    ),
)
def by_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return filter_by_threshold(_scored(spark, sf), rules(spark)).select(*SPAN_COLUMNS)


@query(
    "remove_overlaps_across_engines",
    with_parts(f"SELECT {SPAN}, engine FROM final_pass", ner=NER_SQL),
)
def across_engines(spark: SparkSession, sf: str) -> DataFrame:
    source = texts(spark, sf)
    found = scan(source, Policy(use_ner=True), ner=ingest_ner_spans(ner_spans(source)))
    return explode_detections(found).select(*SPAN_COLUMNS, "engine")


_SOURCES = "SELECT * FROM (VALUES ('src3', 'skip'), ('src4', 'strict'), ('src1', 'scan')) AS r(source, action)"


@query(
    "filter_skipped_sources",
    with_parts(
        """SELECT t.doc_id, t.source, t.source <> 'src3' AS scanned, count(d.doc_id) AS detections
        FROM texts t LEFT JOIN final_pass d USING (doc_id) GROUP BY ALL""",
        scanned="source <> 'src3'",
    ),
)
def skipped_sources(spark: SparkSession, sf: str) -> DataFrame:
    ruled = apply_source_rules(texts(spark, sf), spark.sql(_SOURCES))
    found = scan(ruled.where("scanned").drop("scanned"))
    passed = ruled.where("not scanned").select(
        "doc_id", "source", "scanned", F.lit(0).cast("bigint").alias("detections")
    )
    return found.select(
        "doc_id", "source", "scanned", F.size("detections").cast("bigint").alias("detections")
    ).unionByName(passed)


@query(
    "metric_entity_type_counts",
    with_parts("SELECT entity_type, count(*) AS n FROM final_pass GROUP BY entity_type"),
)
def type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return entity_totals(explode_detections(scan(texts(spark, sf)))).orderBy("entity_type")




# --- extensions ------------------------------------------------------------------


def _first_digits(text: str) -> list[tuple[str, int, int, float]]:
    found = re.search("[0-9]+", text)
    return [("DIGITS", found.start(), found.end(), 0.9)] if found else []


_DIGITS_SQL = """SELECT doc_id, 'DIGITS' AS entity_type, CAST(strpos(text, found) - 1 AS INTEGER) AS start,
        CAST(strpos(text, found) - 1 + length(found) AS INTEGER) AS "end", found AS text, CAST(0.9 AS DOUBLE) AS confidence
    FROM (SELECT doc_id, text, regexp_extract(text, '[0-9]+') AS found FROM texts) WHERE found <> ''"""


@query("custom_detector", _texts_only(_DIGITS_SQL))
def detected_in_python(spark: SparkSession, sf: str) -> DataFrame:
    """A detector written in Python, batch by batch, beside none of the built-in ones."""
    policy = Policy(use_regex=False, use_context=False, detectors=(python_detector(spark, "first_digits", _first_digits),))
    return explode_detections(scan(texts(spark, sf), policy)).select(
        "doc_id", "entity_type", "start", "end", "text", "confidence"
    )
