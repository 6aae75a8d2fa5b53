"""Removal of passages that an earlier document has, found with suffix automata.

The corpus is its own reference, so its automata cannot be sent whole to every task.
What may repeat is found first: each window of words has one word n-gram that is the
least of the window (its anchor), equal windows have equal anchors, and only anchors that two
documents share matter.  Pieces of text around such anchors are dealt into shards by anchor.
In a shard the documents come in order of their ids: each piece is streamed through the
suffix automaton of the pieces of smaller documents for its matching statistics, and
places with a long enough match are to be removed; then it joins the automaton itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from veilwork.llm.base import filter_bits, in_filter, map_batches, map_rows, rows_with, whole_text
from veilwork.llm.words import sequence_hashes, single_spaced, text_bytes, words_of
from veilwork.session import materialized

WINDOW = 13
ANCHOR = 4
# The filter for shared anchors has a fixed size: when it fills up, more pieces are looked at
# than need be; the result stays the same.
# An anchor in more than this share of the documents is cut into single windows.
HOT_SHARE = 1 / 500
HOT_LEAST = 64
HOT_WINDOWS = 100_000
_LAST_ID = (1 << 63) - 1


def anchors(words: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window, by the hashes of its words, its anchor's hash and place."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = sequence_hashes(words, size)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - size + 1)
    at = views.argmin(axis=1) + np.arange(len(views))
    return grams[at].view(np.int64), at


class SuffixAutomaton:
    """Suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        following, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            known = following[last].get(word)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is not None:
                last = self._copy(last, word, known)
                continue
            new = len(following)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and word not in following[at]:
                following[at][word] = new
                at = link[at]
            if at >= 0:
                target = following[at][word]
                link[new] = target if length[target] == length[at] + 1 else self._copy(at, word, target)
            last = new

    def _copy(self, at: int, word, target: int) -> int:
        following, link, length = self.next, self.link, self.length
        copy = len(following)
        following.append(dict(following[target]))
        length.append(length[at] + 1)
        link.append(link[target])
        link[target] = copy
        while at >= 0 and following[at].get(word) == target:
            following[at][word] = copy
            at = link[at]
        return copy

    def matches(self, words: list) -> Iterator[int]:
        """At each word the length of the longest match that ends there."""
        following, link, length = self.next, self.link, self.length
        state, size = 0, 0
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                size = length[state]
            if word in following[state]:
                state = following[state][word]
                size += 1
            yield size


def covered(sizes: Iterator[int], least: int) -> list[tuple[int, int]]:
    """Maximal spans that matches of at least ``least`` words cover."""
    spans: list[list[int]] = []
    for end, size in enumerate(sizes, 1):
        if size >= least:
            if spans and spans[-1][1] >= end - size:
                spans[-1][0] = min(spans[-1][0], end - size)
                spans[-1][1] = end
            else:
                spans.append([end - size, end])
    return [tuple(s) for s in spans]


class Shard:
    """The pieces of one anchor, in order of their documents."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.known: set[bytes] = set()
        self.waiting: list[bytes] = []
        self.automaton: SuffixAutomaton | None = None
        self.new: list[bytes] = []
        self.document = None

    def spans(self, document: int, piece: bytes) -> list[tuple[int, int]]:
        if document != self.document:
            self.document = document
            for text in self.new:
                if text not in self.known:
                    self.known.add(text)
                    self.waiting.append(text)
            self.new = []
        if piece in self.known:
            return [(0, piece.count(b" ") + 1)]
        self.new.append(piece)
        if not self.known:
            return []
        if self.automaton is None:
            self.automaton = SuffixAutomaton()
        for text in self.waiting:
            self.automaton.add(text.split(b" "))
        self.waiting = []
        return covered(self.automaton.matches(piece.split(b" ")), self.least)


def _documents_columns(id_column: str, text_column: str) -> dict[str, Column]:
    """key tells apart texts under one id; a null id comes after all others."""
    text = whole_text(text_column)
    return {
        "id": F.coalesce(F.col(id_column).cast("bigint"), F.lit(_LAST_ID)),
        "key": F.xxhash64(F.col(id_column).cast("bigint"), text),
        "text": text,
    }


def _documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(*(c.alias(k) for k, c in _documents_columns(id_column, text_column).items()))


def _shared_anchors(rows: DataFrame, window: int, size: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = [], []
        for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            hashes = np.unique(anchors(words_of(text).hashes, window, size)[0])
            found.append(hashes)
            ids.append(np.full(len(hashes), doc, np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (found, ids)], names=["anchor", "id"]
        )

    return (
        map_rows(rows.select("id", "text"), run, "anchor bigint, id bigint")
        .groupBy("anchor")
        .agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("docs"))
        .where("least < most")
        .select("anchor", "docs")
    )


def _pieces(rows: DataFrame, shared: DataFrame, total: int, window: int, size: int) -> DataFrame:
    """Pieces around shared anchors, by shard; spans where the verdict is known already.

    Pieces around an anchor in very many documents would make one shard too large.
    They are cut into single windows with a shard each, and of these the windows
    that very many documents share are decided where they stand, by a table of the
    smallest document of each.
    """
    spark = rows.sparkSession
    hot_least = max(HOT_LEAST, total * HOT_SHARE)
    hot = np.array(sorted(r["anchor"] for r in shared.where(F.col("docs") > hot_least).collect()), np.int64)
    shared_bits = spark.sparkContext.broadcast(filter_bits(shared, "anchor"))

    def often(hashes: np.ndarray) -> np.ndarray:
        if not len(hot):
            return np.zeros(len(hashes), bool)
        return hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        least: dict[bytes, list] = {}
        for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            words = words_of(text)
            for k in np.flatnonzero(often(anchors(words.hashes, window, size)[0])):
                piece = single_spaced(text[words.start[k] : words.end[k + window - 1]])
                seen = least.setdefault(piece, [doc, doc, 0])
                if seen[1] != doc or not seen[2]:
                    seen[2] += 1
                seen[0], seen[1] = min(seen[0], doc), doc
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(least), pa.binary()),
                pa.array([v[0] for v in least.values()], pa.int64()),
                pa.array([v[2] for v in least.values()], pa.int64()),
            ],
            names=["piece", "least", "docs"],
        )

    common: dict[bytes, int] = {}
    if len(hot):
        # the table is kept small; a window it has no room for goes to its own shard
        found = (
            map_rows(rows.select("id", "text"), windows, "piece binary, least bigint, docs bigint")
            .groupBy("piece")
            .agg(F.min("least").alias("least"), F.sum("docs").alias("docs"))
            .where(F.col("docs") > hot_least)
            .orderBy(F.desc("docs"), "piece")
            .limit(HOT_WINDOWS)
        )
        common = {bytes(r["piece"]): r["least"] for r in found.collect()}
    common_windows = spark.sparkContext.broadcast(common)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits, first = shared_bits.value, common_windows.value
        out = {k: [] for k in ("shard", "id", "key", "start", "piece", "end")}

        def put(*columns) -> None:
            for column, values in zip(out.values(), columns):
                column.extend(values)

        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc, key, raw in zip(ids, keys, text_bytes(batch.column(2))):
            text = single_spaced(raw)
            words = words_of(np.frombuffer(text, np.uint8))
            hashes, at = anchors(words.hashes, window, size)
            if not len(hashes):
                continue
            # runs of windows with one anchor
            begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            end = np.r_[begin[1:], len(at)]
            maybe = in_filter(bits, hashes[begin])
            begin, end = begin[maybe], end[maybe]
            single = often(hashes[begin])
            b, e = begin[~single], end[~single] + window - 2
            many = len(b)
            pieces = [text[x:y] for x, y in zip(words.start[b].tolist(), words.end[e].tolist())]
            put(hashes[b].tolist(), [doc] * many, [key] * many, b.tolist(), pieces, [None] * many)
            for k in (k for run in zip(begin[single].tolist(), end[single].tolist()) for k in range(*run)):
                piece = text[words.start[k] : words.end[k + window - 1]]
                if piece in first:
                    if first[piece] < doc:
                        put([0], [doc], [key], [k], [None], [k + window])
                else:
                    shard = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)
                    put([shard], [doc], [key], [k], [piece], [None])
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    schema = "shard bigint, id bigint, key bigint, start int, piece binary, end int"
    return map_rows(rows.select("id", "key", "text"), cut, schema)


def repeated_spans(
    rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """id, key, start, end (in words) of all that windows of smaller documents cover."""
    shared = materialized(_shared_anchors(rows, window, anchor))
    cuts = _pieces(rows, shared, rows.count(), window, anchor)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_of, shard = None, None
        for batch in batches:
            out = {k: [] for k in ("id", "key", "start", "end")}
            for name, doc, key, start, piece, end in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is None:
                    spans, start = [(start, end)], 0
                else:
                    if name != shard_of:
                        shard_of, shard = name, Shard(window)
                    spans = shard.spans(doc, piece)
                for b, e in spans:
                    for column, value in zip(out.values(), (doc, key, start + b, start + e)):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    # decided windows need no shard: they are spread out by document
    by_shard = F.when(F.col("piece").isNull(), F.col("key")).otherwise(F.col("shard"))
    dealt = cuts.withColumn("shard", by_shard).repartition("shard").sortWithinPartitions("shard", "id", "start")
    return map_batches(dealt, stream, "id bigint, key bigint, start int, end int")


def remove_repeated(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """id, n_words, n_removed and ``kept`` (words that stay, with single spaces) of each row.

    With ``keep`` those columns of ``docs`` instead, and _n_words, _n_removed and _kept.

    A word goes if ``window`` consecutive words around it (cut at space and U+0009 to
    U+000D, compared byte by byte) also stand in a document with a smaller id.  Windows
    are judged on the input.  A null text counts as empty; a null id is larger than all
    others and does not count as smaller than another null one.  Rows with equal ids do not
    remove each other's words.  Other columns are ignored; an empty table gives an empty one.
    """
    rows = _documents(docs, id_column, text_column)
    spans = materialized(
        repeated_spans(rows, window, anchor)
        .groupBy("id", "key")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    )
    keys = materialized(spans.select("key").distinct())
    id_text = _documents_columns(id_column, text_column)
    kept = [F.col(id_column).cast("bigint").alias(id_column)] if keep is None else [F.col(f"`{c}`") for c in keep]
    full = docs.select(*kept, id_text["id"].alias("_id"), id_text["key"].alias("_key"), id_text["text"].alias("_text"))
    mark = "" if keep is None else "_"

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, removed, stay = [], [], []
        *others, texts, spans = batch.columns
        for text, found in zip(text_bytes(texts), spans.to_pylist()):
            words = text.tobytes().split()
            left, at = [], 0
            for span in found or ():
                left.extend(words[at : span["start"]])
                at = max(at, span["end"])
            left.extend(words[at:])
            counts.append(len(words))
            removed.append(len(words) - len(left))
            stay.append(b" ".join(left).decode("utf-8", "surrogatepass"))
        return pa.RecordBatch.from_arrays(
            [*others, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(stay, pa.string())],
            names=[*batch.schema.names[:-2], *(f"{mark}{c}" for c in ("n_words", "n_removed", "kept"))],
        )

    columns = [F.col(f"`{c}`") for c in full.columns if c not in ("_id", "_key")]
    schema = StructType([f for f in full.schema.fields if f.name not in ("_id", "_key", "_text")])
    for name, kind in (("n_words", LongType()), ("n_removed", LongType()), ("kept", StringType())):
        schema = schema.add(f"{mark}{name}", kind)
    # only documents that lose something meet their spans in a shuffle
    places = spans.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("spans").alias("_spans"))
    changed = rows_with(full, keys.select(F.col("key").alias("_key")), "_key").join(places, ["_id", "_key"], "left")
    none = F.lit(None).cast(places.schema["_spans"].dataType)
    same = rows_with(full, keys.select(F.col("key").alias("_key")), "_key", without=True).withColumn("_spans", none)
    parts = [
        map_rows(part.select(*columns, "_spans"), finish, schema)
        for part in (changed, same)
    ]
    return parts[0].unionByName(parts[1])
