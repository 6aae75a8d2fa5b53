"""Packing of tokenised documents into sequences by bulk-synchronous best fit.

Documents are sorted by length over all tasks, and so are the gaps of open sequences.
Both sorted lists consist of runs of equal numbers, so a sweep goes from run to run: the
documents of a length look for the smallest gap that holds them, by rank one document to
one gap, the gaps that took one come back with the new size, and the sweep repeats until
all are placed.  A run stands for any number of documents; there are at most as many
lengths as a sequence has tokens, so what a sweep handles does not grow with the corpus.
Encoding, sorting, ranking and placing are done by all tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.base import map_rows, whole_text
from veilwork.llm.bpe import ENCODERS, byte_pairs
from veilwork.operators.lookup import with_positions
from veilwork.session import materialized

CAPACITY = 4096
END_ID = 1


class Gaps:
    """Open sequences by the room they have left, in runs of neighbours."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, size: int, first: int, count: int) -> None:
        if size:
            if size not in self.runs:
                insort(self.sizes, size)
                self.runs[size] = []
            self.runs[size].append((first, count))

    def take(self, least: int, most: int) -> tuple[int, int, int] | None:
        """(size, first, count): up to ``most`` sequences of the smallest size that fits."""
        at = bisect_left(self.sizes, least)
        if at == len(self.sizes):
            return None
        size = self.sizes[at]
        runs = self.runs[size]
        first, count = runs.pop()
        if count > most:
            runs.append((first + most, count - most))
            count = most
        if not runs:
            del self.runs[size], self.sizes[at]
        return size, first, count


def sweep(lengths: list[int], counts: list[int], capacity: int) -> np.ndarray:
    """Rows (first rank, first sequence, offset) for documents ranked by falling length.

    From each row on, ranks and sequences rise by one together until the next row.
    """
    gaps, placed, rank, opened = Gaps(), [], 0, 0
    for length, count in zip(lengths, counts):
        while count:
            found = gaps.take(length, count)
            if found is None:
                # nothing holds them: open what they need among themselves
                new = -(-count // (capacity // length))
                gaps.put(capacity, opened, new)
                opened += new
                continue
            size, first, taken = found
            placed.append((rank, first, capacity - size))
            gaps.put(size - length, first, taken)
            rank += taken
            count -= taken
    return np.array(placed, np.int64).reshape(-1, 3)


def pieces(
    docs: DataFrame, path: str, id_column: str, text_column: str, capacity: int, end_id: int
) -> DataFrame:
    """Each document's token ids and an end id, cut only where longer than a sequence."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, end = byte_pairs(path, by_library=True), end_id.to_bytes(4, "little")
        out: list[tuple] = []
        # one text at a time: a batch's texts are not held twice
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            coded = encoder.encode(text.as_py()) + end
            for k in range(0, len(coded), 4 * capacity):
                part = coded[k : k + 4 * capacity]
                out.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
        columns = list(zip(*out)) or [()] * 5
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ["_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = docs.select(docs[id_column].cast("bigint").alias("_id"), whole_text(text_column))
    return map_rows(rows, run, "_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", [ENCODERS])


def pack(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is the end id alone; so is an empty one.  Rows that repeat or have a null
    id are packed each.  Pieces of a sequence stand one after another from offset 0, and
    no sequence holds more than ``capacity`` tokens.  An empty table gives an empty one.
    """
    cut = materialized(pieces(docs, path, id_column, text_column, capacity, end_id))
    ranked = with_positions(cut, [F.desc("length"), "_id", "start", "ids_crc32"], "rank")
    # at most ``capacity`` rows
    lengths = cut.groupBy("length").count().orderBy(F.desc("length")).collect()
    plan = cut.sparkSession.sparkContext.broadcast(
        sweep([r["length"] for r in lengths], [r["count"] for r in lengths], capacity)
    )

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = plan.value
        rank = batch.column(5).to_numpy()
        at = np.searchsorted(rows[:, 0], rank, side="right") - 1
        sequence, offset = rows[at, 1] + rank - rows[at, 0], rows[at, 2]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
            names=["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )

    schema = "_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, " \
        "sequence_id bigint, offset bigint"
    return map_rows(ranked, place, schema).withColumnRenamed("_id", id_column)
