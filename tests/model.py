"""A plain single-text model of a scan, for brute-force comparison."""

from __future__ import annotations

import re

from veilwork.constants import (
    BOOSTERS,
    CONFIDENCE,
    IBAN_LENGTHS,
    IGNORE_CASE_TYPES,
    LABEL_PATTERN,
    PATTERNS,
    REDUCERS,
    REGEX_TYPES,
)

COMPILED = {
    t: re.compile(PATTERNS[t], re.IGNORECASE if t in IGNORE_CASE_TYPES else 0)
    for t in REGEX_TYPES
}
LABEL = re.compile(LABEL_PATTERN, re.IGNORECASE)


def luhn(text: str) -> bool:
    total = 0
    digits = [int(c) for c in text if c.isdecimal()]
    for place, digit in enumerate(reversed(digits)):
        if place % 2:
            digit = digit * 2 - (9 if digit > 4 else 0)
        total += digit
    return len(digits) > 1 and total % 10 == 0


def raw(text: str) -> list[tuple]:
    """(type, start, end, text, confidence) in list order."""
    found = []
    for kind in REGEX_TYPES:
        for m in COMPILED[kind].finditer(text):
            confidence = CONFIDENCE[kind]
            if kind == "CREDIT_CARD" and not luhn(m[0]):
                confidence = 0.27
            if kind == "IBAN":
                compact = m[0].replace(" ", "")
                if len(compact) != IBAN_LENGTHS.get(compact[:2], len(compact)):
                    confidence = 0.352
            found.append((kind, m.start(), m.end(), m[0], confidence))
    return found


def without_overlaps(found: list[tuple]) -> list[tuple]:
    kept: list[tuple] = []
    for d in sorted(found, key=lambda d: (-d[4], d[1])):
        if all(d[1] >= k[2] or d[2] <= k[1] for k in kept):
            kept.append(d)
    return sorted(kept, key=lambda d: d[1])


def scored(text: str, found: list[tuple]) -> list[tuple]:
    lowered, out = text.lower(), []
    for kind, start, end, value, confidence in found:
        around = lowered[max(0, start - 80) : min(len(text), end + 80)]
        change = 0.08 * any(w in around for w in BOOSTERS.get(kind, ()))
        change -= 0.15 * any(w in around for w in REDUCERS.get(kind, ()))
        change += 0.10 * bool(LABEL.search(around))
        out.append((kind, start, end, value, round(min(max(confidence + change, 0), 1), 3)))
    return out


def scan(text: str, threshold: float = 0.7) -> list[tuple]:
    found = scored(text, without_overlaps(raw(text)))
    return without_overlaps([d for d in found if d[4] >= threshold])


def redact(text: str) -> str:
    for kind, start, end, *_ in reversed(scan(text)):
        text = f"{text[:start]}<{kind}_REDACTED>{text[end:]}"
    return text
