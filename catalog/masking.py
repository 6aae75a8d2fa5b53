"""Masking, dictionaries, tokens and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.detection import SPAN
from catalog.inputs import ORDER_BASE, TEXTS_SQL, pages, texts
from catalog.oracle_parts import (
    PARTIAL,
    REDACT,
    hashed,
    masked_texts,
    partial,
    partial_generic,
    q,
    raw_all,
    with_parts,
)
from catalog.registry import query
from veilwork.constants import PSEUDO_KEY_TYPES, REGEX_TYPES
from veilwork.functions import masks
from veilwork.functions.strategies import Strategy, hash_strategy, redact_strategy
from veilwork.operators.detect import detect, explode_detections
from veilwork.operators.dictionary import (
    mask_with_pseudonyms,
    mask_with_sha3,
    mask_with_tables,
    mask_with_tokens,
    merge_tokens,
    pseudonym_dictionary,
    restore_text,
    restore_tokens,
)
from veilwork.plans.scan import scan, scan_and_mask
from veilwork.policy import EntityRule, Policy
from veilwork.session import materialized, new_folder
from veilwork.sources.texts import write_masked
from veilwork.sources.token_table import TokenTable, read_tokens, write_tokens


@query(
    "scan_text_table",
    """SELECT 'documents' AS origin, doc_id AS id, coalesce(source, 'unknown') AS source, text
    FROM documents
    UNION ALL SELECT 'pages', page_id, 'unknown', html FROM pages""",
)
def scan_text_table(spark: SparkSession, sf: str) -> DataFrame:
    from catalog.inputs import documents

    parts = {
        "documents": documents(spark, sf).withColumnRenamed("doc_id", "id"),
        "pages": pages(spark, sf).withColumnRenamed("page_id", "id"),
    }
    first, second = (df.withColumn("origin", F.lit(k)) for k, df in parts.items())
    return first.unionByName(second)


def _masked(replacement: str, **parts: str) -> str:
    return with_parts(masked_texts(replacement), **parts)


# --- one strategy over every text ------------------------------------------------


@query("mask_redact", _masked(REDACT))
def mask_redact(spark: SparkSession, sf: str) -> DataFrame:
    return scan_and_mask(texts(spark, sf)).select("doc_id", "source", "masked_text")


@query("apply_masking", _masked("'[' || d.entity_type || ']'"))
def apply_masking(spark: SparkSession, sf: str) -> DataFrame:
    policy = Policy(strategies=(redact_strategy("[{entity_type}]"),))
    return scan_and_mask(texts(spark, sf), policy).select("doc_id", "source", "masked_text")


@query("mask_hash_sha256", _masked(hashed("d.text", "pepper")))
def mask_hash_sha256(spark: SparkSession, sf: str) -> DataFrame:
    policy = Policy(default_strategy="hash", strategies=(hash_strategy(salt="pepper"),))
    return scan_and_mask(texts(spark, sf), policy).select("doc_id", "source", "masked_text")


@query("mask_hash_md5", _masked(hashed("d.text", algorithm="md5")))
def mask_hash_md5(spark: SparkSession, sf: str) -> DataFrame:
    policy = Policy(default_strategy="hash", strategies=(hash_strategy("md5"),))
    return scan_and_mask(texts(spark, sf), policy).select("doc_id", "source", "masked_text")


@query("mask_hash_fallback", _masked(hashed("d.text", algorithm="whirl")))
def mask_hash_fallback(spark: SparkSession, sf: str) -> DataFrame:
    policy = Policy(default_strategy="hash", strategies=(hash_strategy("whirl"),))
    return scan_and_mask(texts(spark, sf), policy).select("doc_id", "source", "masked_text")


@query("mask_hash_sha3_256")
def mask_hash_sha3_256(spark: SparkSession, sf: str) -> DataFrame:
    return mask_with_sha3(scan(texts(spark, sf))).select("doc_id", "source", "masked_text")


@query(
    "mask_dry_run",
    with_parts(
        """SELECT t.doc_id, t.source, t.text AS masked_text, count(d.doc_id) AS detections
        FROM texts t LEFT JOIN final_pass d USING (doc_id) GROUP BY ALL"""
    ),
)
def mask_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    return scan_and_mask(texts(spark, sf), Policy(dry_run=True)).select(
        "doc_id", "source", "masked_text", F.size("detections").cast("bigint").alias("detections")
    )


# --- partial masks by type -------------------------------------------------------


def _partial_query(key: str, types: tuple[str, ...], form, oracle_form) -> None:
    sql = f"""WITH texts AS MATERIALIZED ({TEXTS_SQL})
        SELECT doc_id, entity_type, start, text, {oracle_form("text")} AS masked
        FROM ({raw_all(types)})"""

    @query(key, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return detect(texts(spark, sf), types).select(
            "doc_id", "entity_type", "start", "text", F.expr(form("text")).alias("masked")
        )


_partial_query(
    "mask_partial_generic",
    tuple(t for t in REGEX_TYPES if t not in PARTIAL),
    masks.partial_generic,
    partial_generic,
)
for _key, _type, _form in (
    ("mask_partial_email", "EMAIL", masks.partial_email),
    ("mask_partial_ssn", "SSN", masks.partial_ssn),
    ("mask_partial_card", "CREDIT_CARD", masks.partial_card),
    ("mask_partial_phone", "PHONE_NUMBER", masks.partial_phone),
):
    _partial_query(_key, (_type,), _form, PARTIAL[_type])

# --- rules decide ----------------------------------------------------------------

_RULES = {
    "EMAIL": EntityRule(strategy="partial"),
    "SSN": EntityRule(strategy="hash"),
    "CREDIT_CARD": EntityRule(strategy="partial", threshold=0.2),
    "DATE_OF_BIRTH": EntityRule(threshold=0.5),
    "IP_ADDRESS": EntityRule(enabled=False),
}
_KEEP = """CASE entity_type WHEN 'CREDIT_CARD' THEN confidence >= 0.2
    WHEN 'DATE_OF_BIRTH' THEN confidence >= 0.5 WHEN 'IP_ADDRESS' THEN false
    ELSE confidence >= 0.7 END"""


@query(
    "resolve_strategy",
    with_parts(
        f"""SELECT {SPAN}, CASE entity_type WHEN 'EMAIL' THEN 'partial' WHEN 'SSN' THEN 'hash'
            WHEN 'CREDIT_CARD' THEN 'partial' WHEN 'DATE_OF_BIRTH' THEN 'redact'
            ELSE 'reversible' END AS strategy FROM final_pass""",
        keep=_KEEP,
    ),
)
def resolve_strategy(spark: SparkSession, sf: str) -> DataFrame:
    policy = Policy(entity_rules=_RULES, use_reversible=True)
    found = explode_detections(scan(texts(spark, sf), policy))
    return found.select(
        "doc_id", "entity_type", "start", "end", "text", "confidence",
        F.expr(policy.strategy_name("entity_type")).alias("strategy"),
    )


_MIXED = f"""CASE d.entity_type WHEN 'EMAIL' THEN {partial("d.entity_type", "d.text")}
    WHEN 'SSN' THEN {hashed("d.text")}
    WHEN 'CREDIT_CARD' THEN {partial("d.entity_type", "d.text")} ELSE {REDACT} END"""


@query(
    "mask_mixed",
    with_parts(masked_texts(_MIXED), keep=_KEEP, scanned="source <> 'src3'"),
)
def mask_mixed(spark: SparkSession, sf: str) -> DataFrame:
    policy = Policy(entity_rules=_RULES, source_actions={"src3": "skip", "src4": "strict"})
    return scan_and_mask(texts(spark, sf), policy).select("doc_id", "source", "masked_text")


@query(
    "custom_strategy",
    with_parts(masked_texts("substr(d.text, 1, 1) || '#' || length(d.text)")),
)
def mask_initial(spark: SparkSession, sf: str) -> DataFrame:
    """A strategy of the user's own: the first letter and the length."""
    initial = Strategy("initial", lambda kind, text: f"concat(left({text}, 1), '#', length({text}))")
    policy = Policy(default_strategy="initial", strategies=(initial,))
    return scan_and_mask(texts(spark, sf), policy).select("doc_id", "source", "masked_text")


# --- pseudonyms ------------------------------------------------------------------

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_KEY_FAKE = f"""'FAKE_KEY_' || array_to_string([substr('{_ALPHABET}',
    CAST('0x' || substr(sha256('42:' || entity_type || ':' || text), i * 2 + 1, 2) AS INTEGER)
        % 62 + 1, 1) for i in range(16)], '')"""
_KEY_LIST = ", ".join(q(k) for k in PSEUDO_KEY_TYPES)
_FAKE = f"""CASE WHEN entity_type = 'EMAIL' THEN 'user_' || printf('%04d', idx) || '@anon.example'
    WHEN entity_type = 'PHONE_NUMBER' THEN '+1-555-000-' || printf('%04d', idx)
    WHEN entity_type = 'SSN' THEN '000-00-' || printf('%04d', idx)
    WHEN entity_type = 'CREDIT_CARD' THEN '4000-0000-0000-' || printf('%04d', idx)
    WHEN entity_type = 'IP_ADDRESS' THEN '10.0.0.' || (idx % 255)
    WHEN entity_type IN ({_KEY_LIST}) THEN {_KEY_FAKE}
    WHEN entity_type = 'JWT_TOKEN' THEN 'eyJmYWtl.eyJmYWtl.ZmFrZV9zaWduYXR1cmU'
    ELSE '<ANON_' || entity_type || '_' || idx || '>' END"""
DICTIONARY_SQL = f"""SELECT entity_type, text, idx, {_FAKE} AS fake, n FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY doc_id, start DESC) AS idx
    FROM (SELECT entity_type, text, doc_id, start,
            count(*) OVER (PARTITION BY entity_type, text) AS n,
            row_number() OVER (PARTITION BY entity_type, text ORDER BY doc_id, start DESC) AS seen
        FROM final_pass) WHERE seen = 1)"""


@query("pseudonym_dictionary", with_parts(DICTIONARY_SQL))
def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    found = materialized(
        explode_detections(scan(texts(spark, sf))).select("doc_id", "entity_type", "start", "text")
    )
    return pseudonym_dictionary(found)


PSEUDO_SQL = with_parts(
    masked_texts(
        "p.fake",
        joins=f"JOIN ({DICTIONARY_SQL}) p ON p.entity_type = d.entity_type AND p.text = d.text",
    )
)


@query("mask_pseudo", PSEUDO_SQL)
def mask_pseudo(spark: SparkSession, sf: str) -> DataFrame:
    policy = Policy(default_strategy="pseudo")
    return mask_with_pseudonyms(scan(texts(spark, sf), policy), policy).select(
        "doc_id", "source", "masked_text"
    )


@query(
    "mask_pseudo_api_key",
    f"""WITH texts AS MATERIALIZED ({TEXTS_SQL})
    SELECT doc_id, entity_type, start, text, {_KEY_FAKE} AS masked
    FROM ({raw_all(PSEUDO_KEY_TYPES)})""",
)
def mask_pseudo_api_key(spark: SparkSession, sf: str) -> DataFrame:
    return detect(texts(spark, sf), PSEUDO_KEY_TYPES).select(
        "doc_id", "entity_type", "start", "text",
        F.expr(masks.pseudo_key("entity_type", "text")).alias("masked"),
    )


# --- tokens ----------------------------------------------------------------------

_TOKEN = "'__SHIELD_' || d.entity_type || '_' || printf('%06d', d.number) || '__'"
_NUMBERED = "(SELECT *, row_number() OVER (ORDER BY doc_id, start DESC) AS number FROM final_pass)"


def keyring(spark: SparkSession) -> DataFrame:
    """Two test keys; in production this is a protected table."""
    return spark.createDataFrame(
        [(1, bytearray(b"0123456789abcdef0123456789abcdef")), (2, bytearray(b"fedcba9876543210" * 2))],
        "key_id int, key binary",
    )


def _tokenized(spark: SparkSession, sf: str, key_id: int = 1) -> tuple[DataFrame, DataFrame]:
    policy = Policy(use_reversible=True)
    return mask_with_tokens(
        scan(texts(spark, sf), policy), policy, keyring(spark), key_id=key_id
    )


@query("mask_reversible", with_parts(masked_texts(_TOKEN, _NUMBERED)))
def mask_reversible(spark: SparkSession, sf: str) -> DataFrame:
    return _tokenized(spark, sf)[0].select("doc_id", "source", "masked_text")


_MIXED_NUMBERED = """(SELECT *, row_number() OVER (
        PARTITION BY entity_type = 'EMAIL' ORDER BY doc_id, start DESC) AS number FROM final_pass)"""


@query(
    "mask_mixed_dictionaries",
    with_parts(
        masked_texts(
            f"CASE WHEN d.entity_type = 'EMAIL' THEN p.fake ELSE {_TOKEN} END",
            _MIXED_NUMBERED,
            joins=f"LEFT JOIN ({DICTIONARY_SQL}) p ON p.entity_type = d.entity_type AND p.text = d.text",
        )
    ),
)
def mask_mixed_dictionaries(spark: SparkSession, sf: str) -> DataFrame:
    policy = Policy(use_reversible=True, entity_rules={"EMAIL": EntityRule(strategy="pseudo")})
    masked, _ = mask_with_tables(scan(texts(spark, sf), policy), policy, keyring=keyring(spark))
    return masked.select("doc_id", "source", "masked_text")


@query(
    "restore_tokens",
    with_parts(
        f"""SELECT {_TOKEN} AS token, text AS original FROM {_NUMBERED} d
        UNION ALL SELECT {_TOKEN} || 'x', NULL FROM {_NUMBERED} d"""
    ),
)
def tokens_restored(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _tokenized(spark, sf)[1]
    known = tokens.select("token")
    asked = known.unionByName(known.select(F.concat("token", F.lit("x")).alias("token")))
    return restore_tokens(asked, tokens, keyring(spark))


@query("restore_text", f"SELECT doc_id, text AS restored_text FROM ({TEXTS_SQL})")
def text_restored(spark: SparkSession, sf: str) -> DataFrame:
    masked, tokens = _tokenized(spark, sf)
    return restore_text(
        masked.select("doc_id", "masked_text"), tokens, keyring(spark), text="masked_text"
    ).select("doc_id", "restored_text")


@query(
    "sink_token_mapping",
    with_parts(
        f"""SELECT {_TOKEN} AS token, d.entity_type,
            CASE WHEN d.doc_id < {ORDER_BASE} THEN 2 ELSE 1 END AS key_id, d.text AS original
        FROM {_NUMBERED} d"""
    ),
)
def token_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """The mapping of all texts, then a later one of the documents under a new key."""
    path = new_folder(spark, "tokens")
    write_tokens(_tokenized(spark, sf)[1], f"{path}/first")
    policy = Policy(use_reversible=True)
    later = texts(spark, sf).where(F.col("doc_id") < ORDER_BASE)
    write_tokens(
        mask_with_tokens(scan(later, policy), policy, keyring(spark), key_id=2)[1],
        f"{path}/second",
    )
    merged = merge_tokens(
        read_tokens(spark, f"{path}/first"), read_tokens(spark, f"{path}/second")
    )
    restored = restore_tokens(merged.select("token"), merged, keyring(spark))
    return merged.select("token", "entity_type", "key_id").join(restored, "token")


@query(
    "merge_token_buckets",
    with_parts(
        f"""SELECT {_TOKEN} AS token, d.entity_type,
            CASE WHEN d.doc_id < {ORDER_BASE} THEN 2 ELSE 1 END AS key_id, d.text AS original
        FROM {_NUMBERED} d"""
    ),
)
def bucketed_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """The same two mappings, merged into buckets in place."""
    tokens = TokenTable(spark, new_folder(spark, "token-buckets"))
    tokens.merge(materialized(_tokenized(spark, sf)[1]))
    policy = Policy(use_reversible=True)
    later = texts(spark, sf).where(F.col("doc_id") < ORDER_BASE)
    tokens.merge(materialized(mask_with_tokens(scan(later, policy), policy, keyring(spark), key_id=2)[1]))
    merged = tokens.read()
    restored = restore_tokens(merged.select("token"), merged, keyring(spark))
    return merged.select("token", "entity_type", "key_id").join(restored, "token")


@query(
    "sink_masked_table",
    with_parts(
        f"SELECT doc_id, source, masked_text AS text FROM ({masked_texts(REDACT)})",
        scanned="source <> 'src3'",
    ),
)
def masked_table(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "masked")
    policy = Policy(source_actions={"src3": "skip"})
    write_masked(scan_and_mask(texts(spark, sf), policy), path)
    return spark.read.schema("doc_id bigint, text string, source string").parquet(path).select(
        "doc_id", "source", "text"
    )


