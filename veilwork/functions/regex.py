"""Patterns with the Unicode meaning of ``\\b``, ``\\d`` and ``\\s`` on the JVM.

Java's shorthand classes are ASCII, and its UNICODE_CHARACTER_CLASS mode differs
from the text model used here (combining marks, connector punctuation), so the
three shorthands are spelled out.
"""

from __future__ import annotations

import re

from veilwork.constants import IGNORE_CASE_TYPES, LABEL_PATTERN, PATTERNS

WORD = r"[\p{L}\p{N}_]"
# One or two characters back: a letter outside the basic plane is two Java chars.
_AFTER_WORD = rf"(?<={WORD}{{1,2}})"
_NOT_AFTER_WORD = rf"(?<!{WORD}{{1,2}})"
_BEFORE_WORD = rf"(?={WORD})"
_NOT_BEFORE_WORD = rf"(?!{WORD})"
BOUNDARY = f"(?:{_NOT_AFTER_WORD}{_BEFORE_WORD}|{_AFTER_WORD}{_NOT_BEFORE_WORD})"
DIGIT = r"\p{Nd}"
SPACE_MEMBERS = r"\s\x1c-\x1f\x85\p{Z}"

# What a match can begin with.  Looking at it before the word boundary rejects
# most positions with one cheap test; it changes no result.
FIRST_CHARACTER = {
    "EMAIL": r"[A-Za-z0-9._%+-]",
    "PHONE_NUMBER": r"[+(\p{Nd}]",
    "SSN": DIGIT,
    "CREDIT_CARD": "[3-6]",
    "IBAN": "[A-Z]",
    "IP_ADDRESS": DIGIT,
    "IPV6_ADDRESS": "[0-9a-fA-F:]",
    "MAC_ADDRESS": "[0-9A-Fa-f]",
    "API_KEY_AWS": "AKIA",
    "API_KEY_OPENAI": "sk-",
    "API_KEY_STRIPE": "[sp]k_",
    "API_KEY_GITHUB": "gh[pousr]_",
    "PASSPORT_NUMBER": "[A-Z]",
    "DATE_OF_BIRTH": "[12]",
    "MEDICAL_ID": "m",
    "DRIVERS_LICENSE": "[A-Z]",
    "JWT_TOKEN": "eyJ",
}
# Patterns whose first or last character can be something else than a letter,
# digit or underscore need both looks at that end; the others only the outer one.
OPEN_START = ("EMAIL", "IPV6_ADDRESS")
OPEN_END = ("EMAIL", "IBAN", "IPV6_ADDRESS", "JWT_TOKEN")

_SHORTHAND = re.compile(r"\\[bds]|\\.|\[\^?|\]|.", re.DOTALL)


def to_spark_regex(pattern: str) -> str:
    """Spell ``\\b``, ``\\d`` and ``\\s`` out for Java."""
    out, in_class = [], False
    for token in _SHORTHAND.findall(pattern):
        if token in ("[", "[^"):
            in_class = True
        elif token == "]":
            in_class = False
        if token == r"\b":
            token = BOUNDARY
        elif token == r"\d":
            token = DIGIT
        elif token == r"\s":
            token = SPACE_MEMBERS if in_class else f"[{SPACE_MEMBERS}]"
        out.append(token)
    return "".join(out)


def spark_pattern(name: str) -> str:
    """The pattern of one entity type, ready for ``regexp_*``."""
    pattern = PATTERNS[name]
    start, end = "", ""
    if pattern.startswith(r"\b") and name not in OPEN_START:
        pattern, start = pattern.removeprefix(r"\b"), _NOT_AFTER_WORD
    if pattern.endswith(r"\b") and name not in OPEN_END:
        pattern, end = pattern.removesuffix(r"\b"), _NOT_BEFORE_WORD
    body = to_spark_regex(pattern)
    # a run that cannot hold the character after it never needs to give one back
    body = body.replace("-]+@", "-]++@", 1).replace(":@]+", ":@]++")
    if name == "IPV6_ADDRESS":
        body = f"(?:{body})"
    first = FIRST_CHARACTER.get(name)
    flags = "(?iu)" if name in IGNORE_CASE_TYPES else ""
    return flags + (f"(?={first})" if first else "") + start + body + end


SPARK_PATTERNS = {name: spark_pattern(name) for name in PATTERNS}
SPARK_LABEL_PATTERN = "(?iu)" + to_spark_regex(LABEL_PATTERN)
