"""Greedy removal of overlapping detections, inside one row.

Detections are taken by confidence (high first), then start, then list order,
and kept when they overlap nothing kept before.  Only detections connected by
overlaps can influence each other, so a text is first cut into such islands and
the quadratic rule runs within an island, not over the whole text.  Islands are cut out
by their boundaries and put together once, so the rest grows with the number of detections.
"""

from __future__ import annotations

from veilwork.functions.columns import let
from veilwork.functions.spans import DETECTIONS_TYPE

_BY_POSITION = "if(a.start <> b.start, a.start - b.start, a.ord - b.ord)"
_BY_PRIORITY = f"""case when a.confidence > b.confidence then -1
    when a.confidence < b.confidence then 1 else {_BY_POSITION} end"""


def _survivors(island: str, nothing: str) -> str:
    kept = f"""aggregate(
        array_sort({island}, (a, b) -> {_BY_PRIORITY}), {nothing},
        (kept, d) -> if(exists(kept, k -> d.start < k.end and d.end > k.start),
                        kept, array_append(kept, d)))"""
    return f"if(size({island}) <= 1, {island}, array_sort({kept}, (a, b) -> {_BY_POSITION}))"


# Detections whose running maximum is one fold: a fold copies what it has with each step.
_PIECE = 256


def _running_max(values: str, first: str) -> str:
    """The largest of ``first`` and all earlier values, for each value."""
    return f"""aggregate({values}, named_struct('before', cast(array() as array<int>), 'most', cast({first} as int)),
        (acc, v) -> named_struct('before', array_append(acc.before, acc.most), 'most', greatest(acc.most, v)),
        acc -> acc.before)"""


def without_overlaps(detections: str, array_type: str = DETECTIONS_TYPE) -> str:
    """The surviving detections in text order.

    Each detection needs ``start``, ``end``, ``confidence`` and ``ord`` (its
    place in the list); ``array_type`` is the type of the array.
    """
    nothing = f"cast(array() as {array_type})"
    # the furthest end before each detection: over pieces first, then within each piece
    reaches = let(
        let(
            "transform(ordered, d -> d.end)",
            "ends",
            f"""transform(sequence(0, (size(ends) - 1) div {_PIECE}),
                k -> slice(ends, k * {_PIECE} + 1, {_PIECE}))""",
        ),
        "pieces",
        f"""flatten(zip_with(pieces,
            {_running_max("transform(pieces, p -> array_max(p))", "0")},
            (piece, before) -> {_running_max("piece", "before")}))""",
    )
    starts = let(reaches, "reach", "filter(transform(ordered, (d, i) -> if(d.start >= reach[i], i, null)), i -> i is not null)")
    island = "slice(ordered, i + 1, coalesce(get(starts, j + 1), size(ordered)) - i)"
    islands = let(
        starts, "starts", f"flatten(transform(starts, (i, j) -> {let(island, 'island', _survivors('island', nothing))}))"
    )
    touching = """exists(
        zip_with(slice(ordered, 1, size(ordered) - 1), slice(ordered, 2, size(ordered) - 1),
                 (a, b) -> a.end > b.start),
        overlap -> overlap)"""
    cleaned = let(
        f"array_sort({detections}, (a, b) -> {_BY_POSITION})",
        "ordered",
        f"if({touching}, {islands}, ordered)",
    )
    return f"if(size({detections}) > 1, {cleaned}, {detections})"
