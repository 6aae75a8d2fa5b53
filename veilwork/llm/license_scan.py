"""Licence scans: Aho-Corasick for phrases and tags, shunting-yard for expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from veilwork.llm.base import LOWER_TABLE, map_rows, whole_text

# Notice phrases (words as the scan sees them) and their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
MORE_PHRASES = (
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("isc license", "isc"),
    ("boost software license", "boost"),
    ("the unlicense", "unlicense"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("all rights reserved", "all-rights-reserved"),
)
# What stands before a licence expression.
TAGS = ("spdx-license-identifier:", "license-expression:")
# First parts of licence identifiers, and which grant use without copyleft.
FAMILIES = {
    "gpl": "gpl",
    "lgpl": "lgpl",
    "agpl": "agpl",
    "apache": "apache",
    "mit": "mit",
    "mpl": "mpl",
    "epl": "epl",
    "bsd": "bsd",
    "0bsd": "bsd",
    "isc": "isc",
    "bsl": "boost",
    "unlicense": "unlicense",
    "cc": "cc-by",
    "cc0": "cc0",
}
PERMISSIVE = {"apache", "mit", "bsd", "isc", "boost", "unlicense", "cc0", "cc-by"}

_SEPARATORS = {c: " " for c in (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))} | LOWER_TABLE
# white space that split() knows and the definition of a word does not
_WIDE_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_OPERATORS = {"or": 1, "and": 2, "with": 3}


def words_of(text: str) -> list[str]:
    """Words of letters, digits and all that is not ASCII, A-Z lower-cased."""
    spaced = text.translate(_SEPARATORS)
    if _WIDE_SPACE.search(spaced):
        return [w for w in spaced.split(" ") if w]
    return spaced.split()


def parse_expression(text: str) -> tuple[list[str], list[str]] | None:
    """(postfix form, identifiers) of a licence expression, or None if it is none.

    Shunting-yard: ``with`` binds tighter than ``and``, that tighter than ``or``.
    The expression ends where no further token fits.
    """
    output: list[str] = []
    stack: list[str] = []
    names: list[str] = []
    operand_next, at = True, 0
    text = text.strip(" \t*/#;-")
    while match := _TOKEN.match(text, at):
        token, word = match.group(), match.group().lower()
        if operand_next:
            if token == "(":
                stack.append(token)
            elif token != ")" and word not in _OPERATORS:
                output.append(word)
                if not (stack and stack[-1] == "with"):
                    names.append(word)
                operand_next = False
            else:
                return None
        elif token == ")":
            while stack and stack[-1] != "(":
                output.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif word in _OPERATORS:
            while stack and stack[-1] != "(" and _OPERATORS[stack[-1]] >= _OPERATORS[word]:
                output.append(stack.pop())
            stack.append(word)
            operand_next = True
        else:
            break
        at = match.end()
        while at < len(text) and text[at] in " \t":
            at += 1
    if operand_next or "(" in stack:
        return None
    return output + stack[::-1], names


def family(identifier: str) -> str:
    return FAMILIES.get(identifier.split("-")[0].rstrip("+"), identifier)


def permits(postfix: Sequence[str]) -> bool:
    """Whether some choice the expression leaves needs permissive licences only."""
    values: list[bool] = []
    for token in postfix:
        if token in _OPERATORS:
            right, left = values.pop(), values.pop()
            # an exception widens its licence, it never makes it narrower
            values.append(left if token == "with" else (left or right) if token == "or" else (left and right))
        else:
            values.append(family(token) in PERMISSIVE)
    return values[0]


@lru_cache(maxsize=4)
def _automaton(phrases: tuple, tag_strings: tuple) -> tuple:
    notices, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label, base in phrases:
        notices.add_word(f" {phrase} ", (len(phrase) + 2, label, base))
    for tag in tag_strings:
        tags.add_word(tag, len(tag))
    notices.make_automaton()
    tags.make_automaton()
    return notices, tags


def scan_text(text: str, notices, tags) -> tuple:
    words = words_of(text)
    joined = f" {' '.join(words)} "
    base, labels, hits = [], set(), 0
    base_labels = set()
    seen_to, seen_words = 0, 0
    for end, (size, label, is_base) in notices.iter(joined):
        start = end - size + 1
        # phrases end in order but may start before the last one did
        if start >= seen_to:
            seen_words += joined.count(" ", seen_to, start)
            word = seen_words
            seen_to = start
        else:
            word = seen_words - joined.count(" ", start, seen_to)
        labels.add(label)
        hits += 1
        if is_base:
            base.append(word)
            base_labels.add(label)
    permissive, expressions = None, []
    if ":" in text:
        lowered = text.translate(LOWER_TABLE)
        for end, _ in tags.iter(lowered):
            line_end = text.find("\n", end + 1)
            parsed = parse_expression(text[end + 1 : line_end if line_end >= 0 else len(text)])
            if parsed:
                postfix, names = parsed
                expressions.append(" ".join(postfix))
                labels.update(map(family, names))
                permissive = permits(postfix) and permissive is not False
    weight = hits + 2 * len(expressions)
    return (
        len(words),
        len(base),
        min(base, default=None),
        max(base, default=None),
        ",".join(sorted(base_labels)),
        ",".join(sorted(labels)),
        1.0 - 0.5 ** min(weight, 60),
        expressions,
        permissive,
    )


_COLUMNS = {
    "n_words": pa.int64(),
    "n_base": pa.int64(),
    "first_word": pa.int64(),
    "last_word": pa.int64(),
    "base_labels": pa.string(),
    "labels": pa.string(),
    "score": pa.float64(),
    "expressions": pa.list_(pa.string()),
    "permissive": pa.bool_(),
}


def scan_licenses(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    base_phrases: Sequence[tuple[str, str]] = BASE_PHRASES,
    more_phrases: Sequence[tuple[str, str]] = MORE_PHRASES,
    tags: Sequence[str] = TAGS,
) -> DataFrame:
    """Licence notices and expressions of each text.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` speak of the base
    phrases alone; ``labels`` has those, the further phrases and the families of the
    identifiers after tags.  ``expressions`` are in postfix form, ``permissive`` is
    whether all of them can be met by permissive licences (null without any), and ``score``
    is 1 - 2^-(phrases + 2 * expressions).  A null text counts as empty, an expression that
    does not parse as none; rows that repeat are scanned each, null ids stay null.
    One narrow stage: nothing is shuffled.
    """
    phrases = tuple((p, label, True) for p, label in base_phrases) + tuple(
        (p, label, False) for p, label in more_phrases
    )
    tag_strings = tuple(tags)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        notices, tag_automaton = _automaton(phrases, tag_strings)
        rows = [scan_text(t, notices, tag_automaton) for t in batch.column(1).to_pylist()]
        columns = list(zip(*rows)) or [[]] * len(_COLUMNS)
        return pa.RecordBatch.from_arrays(
            [batch.column(0)] + [pa.array(list(c), t) for c, t in zip(columns, _COLUMNS.values())],
            names=["_id", *_COLUMNS],
        )

    schema = "_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, " \
        "base_labels string, labels string, score double, expressions array<string>, permissive boolean"
    rows = docs.select(docs[id_column].cast("bigint").alias("_id"), whole_text(text_column))
    return map_rows(rows, scan, schema).withColumnRenamed("_id", id_column)
