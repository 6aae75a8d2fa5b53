"""Exact deduplication by Grace hashing.

Records are dealt out by the digest of their content.  Within a task they go into
an open-addressing table that compares complete contents; when the table outgrows
its memory, what it holds and all that follows is split by further bits of the digest
into spill files, and each file is treated the same way one level deeper.
"""

from __future__ import annotations

import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.base import join_balanced, whole_text
from veilwork.session import materialized

MEMORY_BYTES = 96 << 20
FANOUT_BITS = 4

_SCHEMA = "digest binary, content string, unsure boolean, first bigint, stamp bigint, n bigint"
_ARROW = pa.schema(
    [
        ("digest", pa.binary()),
        ("content", pa.string()),
        ("unsure", pa.bool_()),
        ("first", pa.int64()),
        ("stamp", pa.int64()),
        ("n", pa.int64()),
    ]
)


class ContentTable:
    """Distinct contents with the best (unsure, first, stamp) and a count of each.

    Linear probing over a table of slots; a slot is taken by the same record only
    if digest and complete content are equal.
    """

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.records: list[list] = []
        self.bytes = 0

    def _place(self, digest: bytes) -> int:
        return int.from_bytes(digest[-8:], "little") & (len(self.slots) - 1)

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for number, record in enumerate(self.records):
            at = self._place(record[0])
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = number

    def add(self, record: list) -> None:
        digest, content, mask = record[0], record[1], len(self.slots) - 1
        at = self._place(digest)
        while (number := self.slots[at]) >= 0:
            known = self.records[number]
            if known[0] == digest and known[1] == content:
                if record[2:5] < known[2:5]:
                    known[2:5] = record[2:5]
                known[5] += record[5]
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.records)
        self.records.append(record)
        self.bytes += len(content) + 400
        if 3 * len(self.records) > 2 * len(self.slots):
            self._grow()


def grace(
    records: Iterator[list], memory_bytes: int, level: int = 0, folder: str | None = None
) -> Iterator[list]:
    """One record for each distinct content, using at most about ``memory_bytes``.

    Spill files live in a folder of this task and go when it ends; nobody else reads
    them, so a task that is run again on another executor starts afresh.
    """
    table, files, made = ContentTable(), None, None
    shift = 256 - FANOUT_BITS * (level + 1)

    def spill(record: list) -> None:
        bucket = (int.from_bytes(record[0], "big") >> shift) & ((1 << FANOUT_BITS) - 1)
        pickle.dump(record, files[bucket], pickle.HIGHEST_PROTOCOL)

    try:
        for record in records:
            if files is None:
                table.add(record)
                if table.bytes > memory_bytes and len(table.records) > 1 and shift > 0:
                    if folder is None:
                        folder = made = tempfile.mkdtemp(prefix="grace-")
                    at = tempfile.mkdtemp(dir=folder)
                    files = [open(os.path.join(at, str(k)), "w+b") for k in range(1 << FANOUT_BITS)]
                    for held in table.records:
                        spill(held)
                    table = ContentTable()
            else:
                spill(record)
        if files is None:
            yield from table.records
            return
        for file in files:
            file.seek(0)
            yield from grace(_read(file), memory_bytes, level + 1, folder)
            file.close()
    finally:
        for file in files or ():
            file.close()
        if made:
            shutil.rmtree(made, ignore_errors=True)


def _read(file) -> Iterator[list]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _grace_batches(memory_bytes: int, with_content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[list]:
            for batch in batches:
                yield from map(list, zip(*(c.to_pylist() for c in batch.columns)))

        held, size = [], 0
        for record in grace(records(), memory_bytes):
            if not with_content:
                record[1] = None
            held.append(record)
            size += len(record[1] or "") + 100
            if size > 8 << 20:
                yield _batch(held)
                held, size = [], 0
        yield _batch(held)

    return run


def _batch(records: list[list]) -> pa.RecordBatch:
    columns = list(zip(*records)) or [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
    )


def exact_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    memory_bytes: int = MEMORY_BYTES,
) -> DataFrame:
    """Each row with the row that stays for its text.

    Texts are equal when identical after every run of white space (space and
    U+0009 to U+000D) became one space; a null text counts as empty.  The row with
    the smallest id stays, a null id counting as the largest; of rows that repeat that
    id as well, exactly one is ``kept``.  An empty table gives an empty one; other columns
    are ignored.  Returns id, keep_id, group_size, kept, text_sha256.

    Each task first removes the copies among its own rows, so that a text which fills
    a third of the table is sent to its bucket once per task.  A row is sent its
    bucket's verdict by a join in which such texts are broadcast.
    """
    text = F.regexp_replace(whole_text(text_column), r"(?: [ \t-\r]|[\t-\r])[ \t-\r]*", " ")
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("first"),
        F.monotonically_increasing_id().alias("stamp"),
        text.alias("content"),
    ).withColumn("digest", F.unhex(F.sha2("content", 256)))
    slim = materialized(rows.select("first", "stamp", "digest"))
    full = rows.select(
        "digest",
        "content",
        F.col("first").isNull().alias("unsure"),
        F.coalesce("first", F.lit(0)).alias("first"),
        "stamp",
        F.lit(1).cast("bigint").alias("n"),
    )
    local = full.mapInArrow(_grace_batches(memory_bytes, True), _SCHEMA)
    groups = materialized(
        local.repartition("digest")
        .mapInArrow(_grace_batches(memory_bytes, False), _SCHEMA)
        .select(
            "digest",
            F.when(~F.col("unsure"), F.col("first")).alias("keep_id"),
            F.col("stamp").alias("keep_stamp"),
            F.col("n").alias("group_size"),
        )
    )
    joined = join_balanced(slim, groups, ["digest"], "group_size", slim.count())
    return joined.select(
        F.col("first").alias(id_column),
        "keep_id",
        "group_size",
        (F.col("stamp") == F.col("keep_stamp")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
