"""Newline-delimited messages, from files or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _as_lines(raw: DataFrame) -> DataFrame:
    # only \n ends a line; bytes that are not UTF-8 are replaced; empty lines go
    return raw.select(F.make_valid_utf8("value").alias("line")).where(F.length("line") > 0)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return _as_lines(spark.read.option("lineSep", "\n").text(path))


def stream_messages(spark: SparkSession, path: str) -> DataFrame:
    return _as_lines(spark.readStream.option("lineSep", "\n").text(path))
