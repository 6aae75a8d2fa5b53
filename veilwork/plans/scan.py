"""The whole path of a text: source rule, detection, context, rules, masking.

Everything up to the replacement is one narrow stage.  Each text is matched
against the patterns once (``compute_once``), and only pseudonyms and tokens,
which depend on other texts, need a shuffle, of the texts that hold them alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.constants import DEFAULT_SOURCE
from veilwork.functions.columns import compute_once, name
from veilwork.functions.context import with_context_scores
from veilwork.functions.masks import splice
from veilwork.functions.overlaps import without_overlaps
from veilwork.functions.spans import NO_DETECTIONS, NO_REDACTIONS, regex_detections
from veilwork.operators.detect import DETECTION_FIELDS, placed, with_spans
from veilwork.policy import Policy

CUSTOM_ORD = 1_000_000_000
CUSTOM_ENGINE = "custom"

# A stage maps (SQL of the text, SQL of the detections so far) to SQL.
Stage = Callable[[str, str], str]


def _custom_detections(sql: str, number: int) -> str:
    return f"""coalesce(transform({sql}, d -> named_struct(
        'entity_type', d.entity_type, 'start', cast(d.start as int), 'end', cast(d.end as int),
        'text', d.text, 'confidence', round(cast(d.confidence as double), 3), 'context', '',
        'engine', '{CUSTOM_ENGINE}', 'ord', {CUSTOM_ORD + number})), {NO_DETECTIONS})"""


def find(policy: Policy, text: str) -> str:
    """Structured matches of a scanned text, overlaps included."""
    if not policy.use_regex:
        return NO_DETECTIONS
    return f"if(scanned, {regex_detections(text, policy.types)}, {NO_DETECTIONS})"


def stages(policy: Policy, recognized: str | None = None) -> list[Stage]:
    """From raw matches to final detections.

    Overlaps are removed once among the structured types, before context and
    thresholds, and once more among what is left of all engines.  The order
    matters: a match below its threshold still hides what it overlapped.
    """

    def merge(text: str, found: str) -> str:
        parts = [without_overlaps(found)]
        if recognized is not None:
            in_order = f"array_sort({placed(recognized, text)}, (a, b) -> a.ord - b.ord)"
            parts.append(f"if(scanned, coalesce({in_order}, {NO_DETECTIONS}), {NO_DETECTIONS})")
        for number, detector in enumerate(policy.detectors):
            custom = _custom_detections(detector(text), number)
            parts.append(f"if(scanned, {custom}, {NO_DETECTIONS})")
        return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"

    def keep(text: str, found: str) -> str:
        return f"filter({found}, d -> {policy.keeps('d.entity_type', 'd.confidence')})"

    steps: list[Stage] = [merge]
    if policy.use_context:
        steps.append(lambda text, found: with_context_scores(text, found, policy.context_window))
    return [*steps, keep, lambda text, found: without_overlaps(found)]


def redactions_of(policy: Policy, detections: str) -> str:
    """Detections with the name of their strategy and their replacement.

    A dry run replaces nothing and so has no redactions.
    """
    if policy.dry_run:
        return NO_REDACTIONS
    fields = ", ".join(f"'{f}', d.{f}" for f in DETECTION_FIELDS)
    return f"""transform({detections}, d -> named_struct({fields},
        'strategy', {policy.strategy_name("d.entity_type")},
        'masked', {policy.replacement("d.entity_type", "d.text")}))"""


def scan(
    df: DataFrame,
    policy: Policy = Policy(),
    key: Sequence[str] = ("doc_id",),
    text: str = "text",
    source: str = "source",
    ner: DataFrame | None = None,
) -> DataFrame:
    """Add ``scanned`` and ``detections`` (final: scored, filtered, no overlaps).

    ``ner`` is a detections table from ``ingest_ner_spans`` with the same key; it
    is used when the policy switches recognizer spans on.  A span counts where its text
    stands at its offsets; ``misplaced_spans`` reports the others.  Texts of skipped
    sources and null texts are not scanned and have no detections.
    """
    t = name(text)
    out = df.withColumn(source, F.coalesce(F.col(name(source)), F.lit(DEFAULT_SOURCE)))
    out = out.withColumn("scanned", F.expr(f"{t} is not null and {policy.scans(name(source))}"))
    recognized = None
    if policy.use_ner and ner is not None:
        out = with_spans(out, ner, key, "_ner")
        recognized = "_ner"
    out = compute_once(out, detections=find(policy, t))
    for stage in stages(policy, recognized):
        out = compute_once(out, detections=stage(t, "detections"))
    kept = [c for c in df.columns if c not in ("scanned", "detections")]
    return out.select(*map(name, kept), "scanned", "detections")


def replacements(scanned: DataFrame, policy: Policy) -> DataFrame:
    """Add ``redactions``; where a table has to give a replacement it is null."""
    return compute_once(scanned, redactions=redactions_of(policy, "detections"))


def mask(scanned: DataFrame, policy: Policy = Policy(), text: str = "text") -> DataFrame:
    """Add ``redactions`` and ``masked_text`` to a scanned table.

    For strategies with an SQL form; ``operators.dictionary.mask_with_tables`` has all.
    Without a key there are no tokens: the default strategy takes their place.
    """
    policy = policy.without_tokens()
    if policy.needs_tables():
        raise ValueError("pseudonyms and SHA3 digests need scan_and_mask or mask_with_tables")
    spliced = F.expr(splice(name(text), "redactions"))
    return replacements(scanned, policy).withColumn("masked_text", spliced)


def scan_and_mask(
    df: DataFrame,
    policy: Policy = Policy(),
    key: Sequence[str] = ("doc_id",),
    text: str = "text",
    source: str = "source",
    ner: DataFrame | None = None,
) -> DataFrame:
    """``scan`` followed by the masking the policy asks for, all strategies included.

    Tokens need a key: ``scan_and_mask_reversibly`` takes one and returns their table.
    """
    return scan_and_mask_reversibly(df, policy, None, 1, key, text, source, ner)[0]


def scan_and_mask_reversibly(
    df: DataFrame,
    policy: Policy,
    keyring: DataFrame | None,
    key_id: int = 1,
    key: Sequence[str] = ("doc_id",),
    text: str = "text",
    source: str = "source",
    ner: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(masked table, token table or None)."""
    scanned = scan(df, policy, key, text, source, ner)
    if keyring is None:
        policy = policy.without_tokens()
    if not policy.needs_tables():
        return mask(scanned, policy, text), None
    from veilwork.operators.dictionary import mask_with_tables

    return mask_with_tables(scanned, policy, key, text, keyring=keyring, key_id=key_id)
