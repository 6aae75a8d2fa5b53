"""Masking strategies by name.

A strategy either has an SQL form over one detection, or is filled in later
from a table (pseudonyms, tokens); then its form is None.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from veilwork.constants import HASH_LENGTH, REDACT_TEMPLATE
from veilwork.functions import masks


@dataclass(frozen=True)
class Strategy:
    """``form(entity_type, text)`` gives the SQL of the replacement.

    ``sha3`` has the length and the salt of a SHA3-256 digest, which a table gives.
    """

    name: str
    form: Callable[[str, str], str] | None
    sha3: tuple[int, str] | None = None


def redact_strategy(template: str = REDACT_TEMPLATE) -> Strategy:
    return Strategy("redact", lambda kind, text: masks.redact(kind, template))


def partial_strategy(mark: str = "*", visible: int = 4) -> Strategy:
    return Strategy("partial", lambda kind, text: masks.partial(kind, text, mark, visible))


def hash_strategy(
    algorithm: str = "sha256", length: int = HASH_LENGTH, salt: str = ""
) -> Strategy:
    if algorithm == "sha3_256":
        return Strategy("hash", None, (length, salt))
    return Strategy("hash", lambda kind, text: masks.hashed(text, algorithm, length, salt))


PSEUDO = Strategy("pseudo", None)
REVERSIBLE = Strategy("reversible", None)

_DEFAULTS: dict[str, Strategy] = {
    s.name: s for s in (redact_strategy(), partial_strategy(), hash_strategy(), PSEUDO)
}


def get_strategy(name: str, registered: tuple[Strategy, ...] = ()) -> Strategy:
    """A strategy by name; names given in ``registered`` win."""
    known = _DEFAULTS | {s.name: s for s in registered}
    if name not in known:
        raise ValueError(f"Unknown masking strategy '{name}'; known are {', '.join(known)}")
    return known[name]
