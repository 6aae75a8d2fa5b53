"""Replacement texts, as SQL over an entity type and the matched text."""

from __future__ import annotations

from veilwork.constants import (
    HASH_LENGTH,
    PSEUDO_FORMATS,
    PSEUDO_JWT,
    PSEUDO_KEY_LENGTH,
    PSEUDO_KEY_PREFIX,
    PSEUDO_KEY_TYPES,
    PSEUDO_NAMES,
    PSEUDO_SEED,
    REDACT_TEMPLATE,
    TOKEN_PREFIX,
)
from veilwork.functions.columns import let, literal, quoted


def redact(entity_type: str, template: str = REDACT_TEMPLATE) -> str:
    return f"replace({quoted(template)}, '{{entity_type}}', {entity_type})"


def _stars(text: str, mark: str) -> str:
    return f"repeat({quoted(mark)}, length({text}))"


def _plain_digits(text: str) -> str:
    return rf"regexp_replace({text}, '\\P{{Nd}}', '')"


def partial_generic(text: str, mark: str = "*", visible: int = 4) -> str:
    hidden = f"repeat({quoted(mark)}, length({text}) - {visible})"
    return (
        f"if(length({text}) <= {visible}, {_stars(text, mark)},"
        f" concat({hidden}, right({text}, {visible})))"
    )


def partial_email(text: str, mark: str = "*") -> str:
    domain = f"""case when size(labels) >= 2
        then concat({_stars("labels[0]", mark)}, '.', element_at(labels, -1))
        else {_stars("parts[1]", mark)} end"""
    masked = f"""concat(left(parts[0], 1),
        repeat({quoted(mark)}, length(parts[0]) - 1), '@',
        {let(r"split(parts[1], '\\.', -1)", "labels", domain)})"""
    return let(
        f"split({text}, '@', -1)",
        "parts",
        f"if(size(parts) = 2, {masked}, {_stars(text, mark)})",
    )


def _last_four(text: str, condition: str, prefix: str, mark: str) -> str:
    return let(
        _plain_digits(text),
        "kept",
        f"if({condition}, concat({quoted(prefix)}, right(kept, 4)), {_stars(text, mark)})",
    )


def partial_ssn(text: str, mark: str = "*") -> str:
    return _last_four(text, "length(kept) = 9", "***-**-", mark)


def partial_card(text: str, mark: str = "*") -> str:
    return _last_four(text, "length(kept) >= 12", "****-****-****-", mark)


def partial_phone(text: str, mark: str = "*") -> str:
    return _last_four(text, "length(kept) >= 7", "***-***-", mark)


def partial(entity_type: str, text: str, mark: str = "*", visible: int = 4) -> str:
    return f"""case {entity_type}
        when 'EMAIL' then {partial_email(text, mark)}
        when 'SSN' then {partial_ssn(text, mark)}
        when 'CREDIT_CARD' then {partial_card(text, mark)}
        when 'PHONE_NUMBER' then {partial_phone(text, mark)}
        else {partial_generic(text, mark, visible)} end"""


def hashed(
    text: str, algorithm: str = "sha256", length: int = HASH_LENGTH, salt: str = ""
) -> str:
    """An unknown algorithm is SHA-256 under the given name."""
    data = f"concat({quoted(salt)}, {text})"
    digest = f"md5({data})" if algorithm == "md5" else f"sha2({data}, 256)"
    return f"concat({quoted(algorithm.upper() + ':')}, left({digest}, {length}))"


def pseudo_key(entity_type: str, text: str, seed: int = PSEUDO_SEED) -> str:
    """Sixteen letters and digits drawn from a digest of seed, type and text."""
    digest = f"sha2(concat({quoted(str(seed))}, ':', {entity_type}, ':', {text}), 256)"
    alphabet = quoted("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    letters = f"""transform(sequence(0, {PSEUDO_KEY_LENGTH - 1}), i -> substring({alphabet},
        cast(conv(substring(h, i * 2 + 1, 2), 16, 10) as int) % 62 + 1, 1))"""
    return (
        f"concat({quoted(PSEUDO_KEY_PREFIX)},"
        f" {let(digest, 'h', f'''array_join({letters}, '')''')})"
    )


def pseudonym(entity_type: str, text: str, index: str) -> str:
    """The fake for the ``index``-th distinct text of a type."""
    formats = "\n".join(
        f"when {quoted(kind)} then format_string({quoted(form)}, {index})"
        for kind, form in PSEUDO_FORMATS.items()
    )
    keys = "\n".join(
        f"when {quoted(kind)} then {pseudo_key(entity_type, text)}" for kind in PSEUDO_KEY_TYPES
    )
    names = literal(PSEUDO_NAMES)
    return f"""case {entity_type} {formats} {keys}
        when 'PERSON_NAME' then concat({names}[cast(({index} - 1) % {len(PSEUDO_NAMES)} as int)],
            ' Person', {index})
        when 'IP_ADDRESS' then concat('10.0.0.', {index} % 255)
        when 'JWT_TOKEN' then {quoted(PSEUDO_JWT)}
        else concat('<ANON_', {entity_type}, '_', {index}, '>') end"""


def token(entity_type: str, number: str) -> str:
    return f"concat({quoted(TOKEN_PREFIX)}, {entity_type}, format_string('_%06d__', {number}))"


def splice(text: str, replacements: str, masked: str = "masked", restoring: bool = False) -> str:
    """``text`` with every span in ``replacements`` (in text order) replaced.

    A span without a replacement never shows what was found: it becomes the redaction
    of its type.  Only ``restoring``, where spans are tokens, leaves it as it is.
    """
    before = "if(i = 0, 0, spans[i - 1].end)"
    otherwise = (
        f"substring({text}, r.start + 1, r.end - r.start)"
        if restoring
        else redact("r.entity_type", REDACT_TEMPLATE)
    )
    piece = f"""concat(substring({text}, {before} + 1, r.start - {before}),
        coalesce(r.{masked}, {otherwise}))"""
    whole = let(
        replacements,
        "spans",
        f"""concat(array_join(transform(spans, (r, i) -> {piece}), ''),
            substring({text}, element_at(spans, -1).end + 1))""",
    )
    return f"if(size({replacements}) > 0, {whole}, {text})"
