"""Match spans of the structured types, as one nested column per text.

Spark finds matches but does not say where.  So each match is put between two
marks and the text is split at the marks: gaps and matches alternate, and the
offsets are running sums of their lengths, counted in code points.  That takes
one pass of the pattern, and splitting at a single character takes none.  A text
that holds the mark itself is split by the pattern instead.
"""

from __future__ import annotations

from collections.abc import Iterable

from veilwork.constants import (
    CARD_CHECKSUM_FACTOR,
    CONFIDENCE,
    IBAN_LENGTH_FACTOR,
    REGEX_TYPES,
)
from veilwork.functions.checks import iban_length_ok, luhn_ok
from veilwork.functions.columns import let, literal, quoted
from veilwork.functions.regex import SPARK_PATTERNS

SPANS_TYPE = "array<struct<start:int,end:int,text:string>>"
FOUND_TYPE = "array<struct<ord:int,pieces:array<string>>>"
MARK = r"'\u0000'"
MARKED_MATCH = r"'\u0000$0\u0000'"
DETECTION_TYPE = (
    "struct<entity_type:string,start:int,end:int,text:string,"
    "confidence:double,context:string,engine:string,ord:int>"
)
DETECTIONS_TYPE = f"array<{DETECTION_TYPE}>"
NO_DETECTIONS = f"cast(array() as {DETECTIONS_TYPE})"
REDACTION_TYPE = DETECTION_TYPE[:-1] + ",strategy:string,masked:string>"
NO_REDACTIONS = f"cast(array() as array<{REDACTION_TYPE}>)"
REGEX_ENGINE = "regex"

# Types whose every match holds four digits in a row share one test of the text.
FOUR_DIGIT_TYPES = (
    "PHONE_NUMBER",
    "SSN",
    "CREDIT_CARD",
    "IBAN",
    "PASSPORT_NUMBER",
    "DATE_OF_BIRTH",
    "MEDICAL_ID",
    "DRIVERS_LICENSE",
)

# Cheap tests that every text with a match passes, the cheapest first; ``T`` stands for the text.
GUARDS = {
    "EMAIL": "contains(T, '@')",
    "SSN": r"contains(T, '-') and T rlike '\\p{Nd}-\\p{Nd}{2}-\\p{Nd}{4}'",
    "IBAN": r"T rlike '[A-Z]{2}\\p{Nd}{2}'",
    "IP_ADDRESS": r"contains(T, '.') and T rlike '\\p{Nd}\\.\\p{Nd}{1,3}\\.\\p{Nd}'",
    "IPV6_ADDRESS": "contains(T, ':') and (contains(T, '::') or T rlike ':[0-9a-fA-F]{1,4}:')",
    "MAC_ADDRESS": "(contains(T, ':') or contains(T, '-')) and T rlike '[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]'",
    "API_KEY_AWS": "contains(T, 'AKIA')",
    "API_KEY_OPENAI": "contains(T, 'sk-')",
    "API_KEY_STRIPE": "contains(T, 'k_live_') or contains(T, 'k_test_')",
    "API_KEY_GITHUB": "contains(T, 'gh') and T rlike 'gh[pousr]_'",
    "PASSPORT_NUMBER": r"T rlike '[A-Z]\\p{Nd}{8}'",
    "DATE_OF_BIRTH": r"(contains(T, '-') or contains(T, '/')) and T rlike '[12]\\p{Nd}{3}[-/]'",
    "MEDICAL_ID": "T rlike '[Mm][Rr][Nn]'",
    "DRIVERS_LICENSE": r"T rlike '[A-Z]\\p{Nd}{3}'",
    "URL_WITH_AUTH": "contains(T, '://')",
    "JWT_TOKEN": "contains(T, 'eyJ')",
}


def ord_of(entity_type: str) -> int:
    """Place of a structured type in the list, from 1."""
    return REGEX_TYPES.index(entity_type) + 1


def _pieces(text: str, pattern: str) -> str:
    """Gap, match, gap, ... of a text; null or a single piece without a match."""
    by_marks = let(
        f"regexp_replace({text}, {quoted(pattern)}, {MARKED_MATCH})",
        "marked",
        f"if(octet_length(marked) = octet_length({text}), null, split(marked, {MARK}, -1))",
    )
    by_pattern = f"""flatten(zip_with(split({text}, {quoted(pattern)}, -1),
        regexp_extract_all({text}, {quoted(pattern)}, 0),
        (gap, hit) -> if(hit is null, array(gap), array(gap, hit))))"""
    return f"if(contains({text}, {MARK}), {by_pattern}, {by_marks})"


def _candidates(text: str, types: Iterable[str]) -> str:
    """The types with matches in list order, each behind its tests, as ``FOUND_TYPE``."""
    wanted, entries = set(types), []
    for entity_type in (t for t in REGEX_TYPES if t in wanted):
        found = f"""named_struct('ord', {ord_of(entity_type)},
            'pieces', {_pieces(text, SPARK_PATTERNS[entity_type])})"""
        tests = [f"({GUARDS[entity_type].replace('T', text)})"] if entity_type in GUARDS else []
        if entity_type in FOUR_DIGIT_TYPES:
            tests.insert(0, "_four_digits")
        entries.append(f"if({' and '.join(tests)}, {found}, null)" if tests else found)
    if not entries:
        return f"cast(array() as {FOUND_TYPE})"
    found = f"filter(array({', '.join(entries)}), c -> size(c.pieces) > 1)"
    if wanted.isdisjoint(FOUR_DIGIT_TYPES):
        return found
    return let(rf"{text} rlike '\\p{{Nd}}{{4}}'", "_four_digits", found)


# Appending copies an array, so matches are gathered in blocks of this many.
SPANS_BLOCK = 256


def spans_of(pieces: str) -> str:
    """The matches among alternating gaps and matches, with their offsets."""
    # most texts with a match of a type have one
    single = """array(named_struct('start', length(parts[0]),
        'end', length(parts[0]) + length(parts[1]), 'text', parts[1]))"""
    return let(pieces, "parts", f"if(size(parts) = 3, {single}, {_folded_spans('parts')})")


def _folded_spans(pieces: str) -> str:
    return f"""aggregate({pieces},
        named_struct('pos', 0, 'hit', false,
            'done', cast(array() as array<{SPANS_TYPE}>), 'out', cast(array() as {SPANS_TYPE})),
        (acc, p) -> named_struct(
            'pos', acc.pos + length(p),
            'hit', not acc.hit,
            'done', if(acc.hit and size(acc.out) = {SPANS_BLOCK}, array_append(acc.done, acc.out), acc.done),
            'out', if(acc.hit, array_append(
                if(size(acc.out) = {SPANS_BLOCK}, cast(array() as {SPANS_TYPE}), acc.out),
                named_struct('start', acc.pos, 'end', acc.pos + length(p), 'text', p)), acc.out)),
        acc -> flatten(array_append(acc.done, acc.out)))"""


def match_offsets(text: str, pattern: str) -> str:
    """Start, end and text of every match of a Java pattern, as ``SPANS_TYPE``."""
    spans = f"coalesce({spans_of(_pieces(text, pattern))}, cast(array() as {SPANS_TYPE}))"
    return f"if({text} is null, null, {spans})"


def _confidence(ord_: str, hit: str) -> str:
    base = f"element_at({literal(CONFIDENCE[t] for t in REGEX_TYPES)}, {ord_})"
    card = round(CONFIDENCE["CREDIT_CARD"] * CARD_CHECKSUM_FACTOR, 3)
    iban = round(CONFIDENCE["IBAN"] * IBAN_LENGTH_FACTOR, 3)
    return f"""case
        when {ord_} = {ord_of("CREDIT_CARD")} and not {luhn_ok(hit)} then {literal(card)}
        when {ord_} = {ord_of("IBAN")} and not {iban_length_ok(hit)} then {literal(iban)}
        else {base} end"""


def regex_detections(text: str, types: Iterable[str] = REGEX_TYPES) -> str:
    """Every match of every type, in list order; overlaps are still there."""
    names = literal(REGEX_TYPES)
    of_one_type = f"""transform(
        {spans_of("cand.pieces")},
        s -> named_struct(
            'entity_type', element_at({names}, cand.ord),
            'start', s.start, 'end', s.end, 'text', s.text,
            'confidence', {_confidence("cand.ord", "s.text")},
            'context', '', 'engine', {quoted(REGEX_ENGINE)}, 'ord', cand.ord))"""
    return f"if({text} is null, null, flatten(transform({_candidates(text, types)}, cand -> {of_one_type})))"
