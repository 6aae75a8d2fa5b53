"""Checks on a matched text: card checksum and IBAN length."""

from __future__ import annotations

import sys
import unicodedata

from veilwork.constants import IBAN_LENGTHS
from veilwork.functions.columns import let, literal, quoted

# Every decimal digit of Unicode beyond ASCII and its value, by the rule that
# defines it.
_DIGITS = [
    (chr(c), str(unicodedata.decimal(chr(c))))
    for c in range(0x80, sys.maxunicode + 1)
    if unicodedata.category(chr(c)) == "Nd"
]
_FROM = quoted("".join(digit for digit, _ in _DIGITS))
_TO = quoted("".join(value for _, value in _DIGITS))


def digits(text: str) -> str:
    """The decimal digits of ``text``, as ASCII, without anything between them."""
    kept = rf"regexp_replace({text}, '\\P{{Nd}}', '')"
    return rf"if({text} rlike '[^\\x00-\\x7F]', translate({kept}, {_FROM}, {_TO}), {kept})"


def luhn_ok(text: str) -> str:
    """Luhn checksum over the digits of ``text``; fewer than two digits fail."""
    doubled = "cast(d as int) * 2 % 10 + if(cast(d as int) > 4, 1, 0)"
    total = (
        f"aggregate(transform(n, (d, i) -> if(i % 2 = 0, cast(d as int), {doubled})),"
        " 0, (total, v) -> total + v)"
    )
    backwards = f"regexp_extract_all(reverse({digits(text)}), '[0-9]', 0)"
    return let(backwards, "n", f"(size(n) >= 2 and {total} % 10 = 0)")


def iban_length_ok(text: str) -> str:
    """Length by country after ASCII spaces are taken out; unknown countries pass."""
    compact = f"replace({text}, ' ', '')"
    expected = f"try_element_at({literal(IBAN_LENGTHS)}, upper(left({compact}, 2)))"
    return f"coalesce(length({compact}) = {expected}, true)"
