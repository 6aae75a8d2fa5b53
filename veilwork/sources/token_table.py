"""The token table on storage: as a plain folder, or in buckets that merges replace one by one."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.operators.dictionary import merge_tokens

TOKEN_SCHEMA = "token string, entity_type string, key_id int, ciphertext binary"


def write_tokens(tokens: DataFrame, path: str, mode: str = "errorifexists") -> None:
    tokens.write.mode(mode).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass(frozen=True)
class TokenTable:
    """Tokens in buckets by a digest of the token; a merge rewrites the buckets of its tokens alone.

    ``version=<v>/bucket=<b>`` holds the buckets that merge v wrote, and ``manifest/version=<v>`` says
    which version of each bucket holds after it.  The manifest is written last, and it counts once its
    ``_SUCCESS`` file is there, which Spark's committer creates as its last step: a merge that fails,
    or is still under way, leaves the table as it was, and a reader sees one version throughout.
    One merge at a time.  Old versions stay until they are deleted by hand.
    """

    spark: SparkSession
    path: str
    buckets: int = 64

    def _folder(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def _names(self, path: str) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []

    def version(self) -> int:
        """The last complete version, 0 before the first merge."""
        found = (re.fullmatch(r"version=([0-9]+)", x) for x in self._names(self._folder("manifest")))
        for v in sorted((int(m[1]) for m in found if m), reverse=True):
            if "_SUCCESS" in self._names(self._folder(f"manifest/version={v}")):
                return v
        return 0

    def _manifest(self, version: int) -> dict[int, int]:
        """The version of each bucket that has rows: ``buckets`` rows at most."""
        if not version:
            return {}
        rows = self.spark.read.schema("bucket int, held int").parquet(self._folder(f"manifest/version={version}"))
        return {r.bucket: r.held for r in rows.collect()}

    def _rows(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], TOKEN_SCHEMA)
        paths = [self._folder(f"version={v}/bucket={b}") for b, v in sorted(held.items())]
        return self.spark.read.schema(TOKEN_SCHEMA).parquet(*paths)

    def read(self) -> DataFrame:
        """All tokens, as of the last complete merge."""
        return self._rows(self._manifest(self.version()))

    def merge(self, new: DataFrame) -> list[int]:
        """Add tokens; where the table knows one, the new row holds.  The buckets that were rewritten."""
        bucket = F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")
        rows = new.select("token", "entity_type", F.col("key_id").cast("int").alias("key_id"), "ciphertext")
        touched = sorted(r.bucket for r in rows.select(bucket.alias("bucket")).distinct().collect())
        if not touched:
            return []
        last = self.version()
        held = self._manifest(last)
        merged = merge_tokens(self._rows({b: v for b, v in held.items() if b in set(touched)}), rows)
        placed = merged.withColumn("bucket", bucket)
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._folder(f"version={last + 1}"))
        after = held | dict.fromkeys(touched, last + 1)
        manifest = self.spark.createDataFrame(sorted(after.items()), "bucket int, held int")
        manifest.coalesce(1).write.mode("overwrite").parquet(self._folder(f"manifest/version={last + 1}"))
        return touched
