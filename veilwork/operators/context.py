"""Context scoring over a detections array or a detections table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.constants import CONTEXT_WINDOW
from veilwork.functions.columns import compute_once, name
from veilwork.functions.context import (
    boost_hit,
    label_hit,
    lowered,
    reduce_hit,
    rescored,
    window_of,
    with_context_scores,
)


def score_context(
    df: DataFrame,
    text: str = "text",
    column: str = "detections",
    window: int = CONTEXT_WINDOW,
) -> DataFrame:
    """Rescore each row's detections; their order stays."""
    return compute_once(df, **{column: with_context_scores(name(text), name(column), window)})


def context_signals(
    df: DataFrame,
    text: str = "text",
    column: str = "detections",
    window: int = CONTEXT_WINDOW,
) -> DataFrame:
    """One row per detection with its context and what was found in it.

    Adds ``context``, ``boosted``, ``reduced``, ``labelled`` and ``rescored``.
    """
    kept = [name(c) for c in df.columns if c not in (text, column)]
    around = compute_once(df, _lowered=lowered(name(text)))
    flat = around.select(
        *kept,
        F.expr(
            f"""inline(transform({name(column)}, d -> named_struct(
                'entity_type', d.entity_type, 'start', d.start, 'end', d.end,
                'text', d.text, 'confidence', d.confidence,
                'context', {window_of(name(text), "d.start", "d.end", window)},
                'lowered', {window_of("_lowered", "d.start", "d.end", window)})))"""
        ),
    )
    signals = {
        "boosted": boost_hit("entity_type", "lowered"),
        "reduced": reduce_hit("entity_type", "lowered"),
        "labelled": label_hit("lowered"),
    }
    return (
        flat.withColumns({k: F.expr(v) for k, v in signals.items()})
        .withColumn("rescored", F.expr(rescored("confidence", "boosted", "reduced", "labelled")))
        .drop("lowered")
    )
