"""Tables of texts: reading them, and writing them back masked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.constants import DEFAULT_SOURCE
from veilwork.functions.columns import name


# A source with a third of all rows still fills several tasks.
FILES_PER_VALUE = 32


def as_texts(
    df: DataFrame,
    key: Sequence[str] = ("doc_id",),
    text: str = "text",
    source: str | None = "source",
) -> DataFrame:
    """Key, ``source`` (``unknown`` when missing) and ``text`` of a table or stream."""
    origin = F.lit(DEFAULT_SOURCE)
    if source is not None:
        origin = F.coalesce(F.col(name(source)).cast("string"), origin)
    return df.select(
        *map(name, key), origin.alias("source"), F.col(name(text)).alias("text")
    )


def read_texts(
    spark: SparkSession,
    path: str,
    key: Sequence[str] = ("doc_id",),
    text: str = "text",
    source: str | None = "source",
    format: str = "parquet",
    schema: str | None = None,
) -> DataFrame:
    """Texts from files; only the columns named here are read."""
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    return as_texts(reader.load(path), key, text, source)


def write_masked(
    masked: DataFrame,
    path: str,
    key: Sequence[str] = ("doc_id",),
    format: str = "parquet",
    mode: str = "append",
    partition_by: str | None = "source",
) -> None:
    """Write the masked text in place of the original.

    Detections are not written: they hold the original values.  With ``partition_by`` the
    rows of a value come to ``FILES_PER_VALUE`` tasks at most, so that there is no file for
    each task and value; the text is shuffled once for that, and ``None`` avoids it.
    """
    rows = masked.select(*map(name, key), "source", F.col("masked_text").alias("text"))
    if partition_by:
        spread = F.pmod(F.xxhash64(*map(name, key)), F.lit(FILES_PER_VALUE))
        rows = rows.repartition(F.col(name(partition_by)), spread)
    writer = rows.write.format(format).mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: Sequence[str] = ("doc_id",)) -> None:
    """Store texts, or spans of texts, dealt out by their key once and for all.

    Tables with the same number of buckets join on the key without a shuffle.
    """
    writer = df.write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, *key).sortBy(*key).saveAsTable(table)
