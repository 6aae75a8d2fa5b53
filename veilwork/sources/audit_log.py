"""The audit log: JSON lines of two kinds of events."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.operators.audit import AUDIT_SCHEMA


_CORRUPT = "_corrupt_record"
_READ_SCHEMA = f"{AUDIT_SCHEMA}, {_CORRUPT} string"


def write_audit(events: DataFrame, path: str) -> None:
    """Append events; fields without a value are left out of a line."""
    events.write.mode("append").json(path)


def parse_audit(lines: DataFrame, line: str = "value") -> DataFrame:
    """Events from lines.  Blank lines and lines that are not JSON objects are
    dropped; ``from_json`` alone would turn them into rows of nulls."""
    trimmed = F.regexp_replace(line, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("_line")
    return (
        lines.select(trimmed)
        .where(F.col("_line").startswith("{"))
        .select(F.from_json("_line", _READ_SCHEMA, {"columnNameOfCorruptRecord": _CORRUPT}).alias("_event"))
        .where(F.col("_event").isNotNull() & F.col(f"_event.{_CORRUPT}").isNull())
        .select("_event.*")
        .drop(_CORRUPT)
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """All events of a log; a missing log is empty."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], AUDIT_SCHEMA)
    return parse_audit(lines)
