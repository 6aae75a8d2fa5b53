"""Confidence from the words around a detection."""

from __future__ import annotations

from veilwork.constants import (
    BOOSTERS,
    CONTEXT_BOOST,
    CONTEXT_LABEL,
    CONTEXT_REDUCTION,
    CONTEXT_WINDOW,
    REDUCERS,
)
from veilwork.functions.columns import let, literal, quoted
from veilwork.functions.regex import SPARK_LABEL_PATTERN


def window_of(text: str, start: str, end: str, window: int = CONTEXT_WINDOW) -> str:
    """The match with up to ``window`` characters on each side (0 means the default)."""
    width = window or CONTEXT_WINDOW
    return (
        f"substring({text}, greatest({start} - {width}, 0) + 1,"
        f" {end} + {width} - greatest({start} - {width}, 0))"
    )


def lowered(text: str) -> str:
    """The text in which words are looked for, at the offsets of the original.

    Lower-casing can lengthen a text; a window then moves against its match, and
    what lies beyond the length of the original is never looked at.
    """
    return f"left(lower({text}), length({text}))"


def _has_word(words_by_type: dict[str, list[str]], entity_type: str, context: str) -> str:
    words = f"try_element_at({literal(words_by_type)}, {entity_type})"
    return f"coalesce(exists({words}, w -> contains({context}, w)), false)"


def boost_hit(entity_type: str, lowered_context: str) -> str:
    return _has_word(BOOSTERS, entity_type, lowered_context)


def reduce_hit(entity_type: str, lowered_context: str) -> str:
    return _has_word(REDUCERS, entity_type, lowered_context)


def label_hit(lowered_context: str) -> str:
    """Is there a label with a colon or an equals sign?  Most windows have neither."""
    return (
        f"((contains({lowered_context}, ':') or contains({lowered_context}, '='))"
        f" and {lowered_context} rlike {quoted(SPARK_LABEL_PATTERN)})"
    )


def rescored(confidence: str, boost: str, reduce: str, label: str) -> str:
    changed = (
        f"{confidence} + if({boost}, {literal(CONTEXT_BOOST)}, 0D)"
        f" - if({reduce}, {literal(CONTEXT_REDUCTION)}, 0D)"
        f" + if({label}, {literal(CONTEXT_LABEL)}, 0D)"
    )
    return f"round(least(greatest({changed}, 0D), 1D), 3)"


def with_context_scores(text: str, detections: str, window: int = CONTEXT_WINDOW) -> str:
    """Detections with their context and the confidence it gives, order kept.

    """
    score = rescored(
        "d.confidence",
        boost_hit("d.entity_type", "around"),
        reduce_hit("d.entity_type", "around"),
        label_hit("around"),
    )
    scored = let(
        window_of("lowered", "d.start", "d.end", window),
        "around",
        f"""named_struct('entity_type', d.entity_type, 'start', d.start, 'end', d.end,
            'text', d.text, 'confidence', {score},
            'context', {window_of(text, "d.start", "d.end", window)},
            'engine', d.engine, 'ord', d.ord)""",
    )
    every = let(lowered(text), "lowered", f"transform({detections}, d -> {scored})")
    return f"if(size({detections}) > 0, {every}, {detections})"
