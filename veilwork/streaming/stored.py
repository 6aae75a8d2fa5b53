"""Tables that a stream keeps from batch to batch: a dictionary of fakes, and tokens.

What a batch adds lies in folders that carry its number and are overwritten when it runs
again.  A batch reads only what it needs of the batches before it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilwork.operators.dictionary import pseudonym_dictionary
from veilwork.session import materialized

# Rows of a bucket, about, before the dictionary is dealt out to twice as many.
BUCKET_ROWS = 100_000
FEWEST_BUCKETS = 16
# Buckets that are named one by one when they are read.
NAMED_BUCKETS = 2000

_ENTRY = "entity_type string, text string, idx bigint, fake string, n bigint"
DICTIONARY_SCHEMA = f"{_ENTRY}, batch_id bigint"
_NUMBERS = "entity_type string, largest bigint, buckets int"


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none where there is no folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []


def _latest(spark: SparkSession, path: str, before: int | None) -> str | None:
    """The folder of the last batch, or of the last one before a number."""
    names = (re.fullmatch(r"batch_id=(\d+)", x) for x in _names(spark, path))
    ids = [int(m[1]) for m in names if m and (before is None or int(m[1]) < before)]
    return batch_folder(path, max(ids)) if ids else None


def latest_table(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """What the last batch (before one) stored; an empty table where there was none."""
    folder = _latest(spark, path, before)
    return spark.createDataFrame([], schema) if folder is None else spark.read.schema(schema).parquet(folder)


def read_latency_window(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest latencies of a stream, as its last batch left them."""
    return latest_table(spark, path, StructType.fromDDL(schema))


@dataclass(frozen=True)
class StoredDictionary:
    """A dictionary of fakes in buckets by a digest of (entity_type, text).

    ``buckets=<b>/bucket=<k>/batch_id=<i>`` holds what batch i added to a bucket, and
    ``numbers/batch_id=<i>`` the largest number of each type after it, which also says how many buckets
    there are.  A batch opens the latest numbers and the buckets its own values fall into.  As
    the dictionary grows it is dealt out to twice as many buckets, so that a bucket has about
    ``bucket_rows`` rows at most and what a batch reads follows its own size, not the number of batches;
    all the dealing out together writes each entry about twice.
    """

    spark: SparkSession
    path: str
    bucket_rows: int = BUCKET_ROWS

    def _entries(self, buckets: int) -> str:
        return f"{self.path.rstrip('/')}/buckets={buckets}"

    @property
    def _numbers(self) -> str:
        return f"{self.path.rstrip('/')}/numbers"

    def numbers(self, before: int | None = None) -> tuple[dict[str, int], int]:
        """(largest number of each type, buckets) after the batches before one; a row per type."""
        folder = _latest(self.spark, self._numbers, before)
        if folder is None:
            return {}, FEWEST_BUCKETS
        rows = self.spark.read.schema(_NUMBERS).parquet(folder).collect()
        return {r.entity_type: r.largest for r in rows if r.entity_type is not None}, max(r.buckets for r in rows)

    def read(self, before: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """All entries, or those of the batches before one, or of some buckets."""
        largest, buckets = self.numbers(before)
        if not largest:
            return self.spark.createDataFrame([], DICTIONARY_SCHEMA)
        return self._read(buckets, before, only)

    def _read(self, buckets: int, before: int | None, only: Sequence[int] | None) -> DataFrame:
        base = self._entries(buckets)
        names = set(_names(self.spark, base))
        paths = [f"{base}/{x}" for x in (f"bucket={k}" for k in only)] if only is not None else [base]
        paths = [p for p in paths if only is None or p.rpartition("/")[2] in names]
        if not paths:
            return self.spark.createDataFrame([], DICTIONARY_SCHEMA)
        schema = f"{_ENTRY}, bucket int, batch_id bigint"
        stored = self.spark.read.schema(schema).option("basePath", base).parquet(*paths).drop("bucket")
        return stored if before is None else stored.where(F.col("batch_id") < before)

    def _write(self, entries: DataFrame, buckets: int) -> None:
        """Add entries with a ``batch_id``; those of the same bucket and batch are replaced."""
        placed = entries.withColumn("bucket", _bucket(buckets))
        (
            placed.repartition("bucket")
            .sortWithinPartitions("bucket", "batch_id")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "batch_id")
            .parquet(self._entries(buckets))
        )

    def extended(self, values: DataFrame, batch_id: int, key: Sequence[str]) -> DataFrame:
        """The entries of these values, once the new ones among them are numbered and stored."""
        largest, buckets = self.numbers(batch_id)
        wanted = buckets
        while sum(largest.values()) > wanted * self.bucket_rows:
            wanted *= 2
        if wanted > buckets:
            # the new layout is this batch's own work, and made anew when it runs again
            self._write(self._read(buckets, batch_id, None), wanted)
        asked = materialized(values.select("entity_type", "text").distinct().withColumn("bucket", _bucket(wanted)))
        touched = [r.bucket for r in asked.select("bucket").distinct().limit(NAMED_BUCKETS + 1).collect()]
        only = sorted(touched) if len(touched) <= NAMED_BUCKETS else None
        earlier = self._read(wanted, batch_id, only) if largest else self.spark.createDataFrame([], DICTIONARY_SCHEMA)
        known = materialized(earlier.drop("batch_id").join(asked.drop("bucket"), ["entity_type", "text"], "left_semi"))
        before = self.spark.createDataFrame(list(largest.items()), "entity_type string, largest bigint")
        new = materialized(pseudonym_dictionary(values, key, known, before))
        self._write(new.withColumn("batch_id", F.lit(batch_id).cast("bigint")), wanted)
        after = {r.entity_type: r.idx for r in new.groupBy("entity_type").agg(F.max("idx").alias("idx")).collect()}
        rows = [(k, n, wanted) for k, n in (largest | after).items()] or [(None, 0, wanted)]
        self.spark.createDataFrame(rows, _NUMBERS).coalesce(1).write.mode("overwrite").parquet(
            batch_folder(self._numbers, batch_id)
        )
        return known.unionByName(new)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("entity_type", "text"), F.lit(buckets)).cast("int")


def read_dictionary(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The stored pseudonyms, or those of the batches before one."""
    return StoredDictionary(spark, path).read(before)


# --- tokens -------------------------------------------------------------------------------------


def last_token(spark: SparkSession, path: str, before: int) -> int:
    """The last token number that a batch before this one was given; 0 where there is none."""
    folder = _latest(spark, f"{path.rstrip('/')}/numbers", before)
    return 0 if folder is None else spark.read.schema("last bigint").parquet(folder).first()[0]


def write_batch_tokens(tokens: DataFrame, path: str, batch_id: int) -> None:
    """Store a batch's tokens, and then the end of its range of numbers."""
    spark, root = tokens.sparkSession, path.rstrip("/")
    folder = batch_folder(f"{root}/tokens", batch_id)
    tokens.write.mode("overwrite").parquet(folder)
    count = spark.read.schema(tokens.schema).parquet(folder).count()
    last = last_token(spark, path, batch_id) + count
    spark.createDataFrame([(last,)], "last bigint").coalesce(1).write.mode("overwrite").parquet(
        batch_folder(f"{root}/numbers", batch_id)
    )


def read_stream_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The tokens of all batches, as a token table."""
    schema = "token string, entity_type string, key_id int, ciphertext binary, batch_id bigint"
    if not _names(spark, f"{path.rstrip('/')}/tokens"):
        return spark.createDataFrame([], schema).drop("batch_id")
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/tokens").drop("batch_id")
