"""Detectors written in Python, run on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from veilwork.functions.columns import name

# What a detector yields for a text: entity type, start, end (code points, half open), confidence.
Found = Iterable[tuple[str, int, int, float]]

_FIELDS = [("entity_type", StringType()), ("start", IntegerType()), ("end", IntegerType()), ("text", StringType()), ("confidence", DoubleType())]
_TYPE = ArrayType(StructType([StructField(n, t) for n, t in _FIELDS]))
_ARROW = pa.list_(
    pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("confidence", pa.float64())])
)


def checked(text: str, found: Found) -> list[dict]:
    """Detections with their text; offsets outside the text, and empty spans, raise."""
    out = []
    for kind, start, end, confidence in found:
        if not 0 <= start < end <= len(text):
            raise ValueError(f"a detector gave {kind} at {start} to {end} of a text of {len(text)}")
        out.append({"entity_type": kind, "start": start, "end": end, "text": text[start:end], "confidence": confidence})
    return out


def python_detector(spark: SparkSession, function_name: str, find: Callable[[str], Found]) -> Callable[[str], str]:
    """A detector for ``Policy.detectors`` from a Python function over one text.

    The function is registered under a name with the session, and its tasks get texts in
    Arrow batches; ``spark.sql.execution.arrow.maxRecordsPerBatch`` and, where the texts are long,
    ``maxBytesPerBatch`` bound them.  Null texts are not shown to it.
    It works for texts, not for blocks inside messages: explode those first.
    """

    @F.arrow_udf(_TYPE)
    def detect(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else checked(t, find(t)) for t in texts.to_pylist()], _ARROW)

    spark.udf.register(function_name, detect)
    return lambda text: f"{name(function_name)}({text})"
