"""Fuzzy deduplication of lines: MinHash, banding, exact Jaccard, union-find.

A line's signature comes from the hashes of its character shingles: they fall into bins,
and each bin's least hash stands for it; an empty bin borrows from the next one.  Lines
that agree in a band of bins are compared by the exact Jaccard similarity of their shingle
sets.  Links make components, and of each component the first line stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.base import join_balanced, map_rows, min_labels, rows_with, whole_text
from veilwork.llm.ngram_join import pairs_in_lists
from veilwork.llm.words import mixed
from veilwork.session import materialized

SHINGLE = 8
SIMILARITY = 0.8
BANDS, ROWS = 8, 4
# Blank lines only are left out.
EVERY_LINE = 1
# Bins of a line's distinct shingles, each with one bit: whether their number is odd.  As many shingles
# as bits differ stand in one of two lines alone, at least.
SKETCH = 2048
# Rounds in which lines of different components name only the one they differ least from.
ROUNDS = 2
_LAST_ID = (1 << 63) - 1
# Characters that are hashed at once: what is made of them stays near the processor.
_CHUNK = 1 << 16
# White space below U+0100 that is neither a space nor ends a line here.
_ODD_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def plain(line: str) -> str:
    """What of a line is compared: lower case, single spaces, none at the ends."""
    return " ".join(line.lower().split())


def plain_lines(text: str) -> list[str]:
    """``plain`` of each line; most texts have single spaces only, which one look at the whole text tells."""
    lowered = text.lower()
    try:
        lowered.encode("latin-1")
        odd = any(c in lowered for c in _ODD_SPACE)
    except UnicodeEncodeError:
        odd = True
    if odd:
        return [" ".join(line.split()) for line in lowered.split("\n")]
    lines = [line.strip(" ") for line in lowered.split("\n")]
    return [" ".join(line.split()) if "  " in line else line for line in lines] if "  " in lowered else lines


def shingle_set(line: str, size: int) -> set[str]:
    return {line[k : k + size] for k in range(max(1, len(line) - size + 1))}


_MIXED_CODES = mixed(np.arange(256, dtype=np.uint64))


def _shingle_hashes(lines: list[str], size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of lines (not empty, plain): first, end, hashes of their shingles, each one's line in the run."""
    start = 0
    while start < len(lines):
        end, chars = start, 0
        while end < len(lines) and (end == start or chars + len(lines[end]) < _CHUNK):
            chars += len(lines[end]) + size
            end += 1
        # a line of fewer characters than a shingle is filled up to one
        padded = [line.ljust(size, "\0") for line in lines[start:end]]
        joined = "".join(padded)
        try:
            codes = np.frombuffer(joined.encode("latin-1"), np.uint8)
            first = _MIXED_CODES[codes]
        except UnicodeEncodeError:
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
            first = mixed(codes.astype(np.uint64))
        text = codes.astype(np.uint64)
        lengths = np.array([len(p) for p in padded])
        h = text
        width = 1
        while width < size:
            step = min(width, size - width)
            right = first[step:] if h is text else mixed(h[step:])
            h = h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15) + right
            width += step
        # the last size - 1 places of a line begin no shingle
        inside = np.ones(len(codes), bool)
        inside[(np.cumsum(lengths)[:, None] - np.arange(1, size)).ravel()] = False
        of_line = np.repeat(np.arange(len(padded)), lengths - (size - 1))
        yield start, end, mixed(h[inside[: len(h)]]), of_line
        start = end


def least_hashes(lines: list[str], size: int, bins: int) -> np.ndarray:
    """The least shingle hash of each bin, one row per line (not empty, plain)."""
    out = np.empty((len(lines), bins), np.uint64)
    none = np.iinfo(np.uint64).max
    for start, end, h, of_line in _shingle_hashes(lines, size):
        least = np.full((end - start) * bins, none, np.uint64)
        rank = h // np.uint64(bins)
        np.minimum.at(least, of_line * bins + (h - rank * np.uint64(bins)).astype(np.int64), rank)
        least = least.reshape(-1, bins)
        empty = least == none
        # how far the next bin that is not empty stands, going round
        far = np.where(empty, np.int64(2 * bins), np.arange(bins))
        far = np.concatenate([far, far + bins], axis=1)[:, ::-1]
        row, column = np.nonzero(empty)
        next_full = np.minimum.accumulate(far, axis=1)[:, ::-1][row, column]
        least[row, column] = mixed(least[row, next_full % bins] + (next_full - column).astype(np.uint64))
        out[start:end] = least
    return out


def signatures(lines: list[str], size: int, bands: int, rows: int) -> np.ndarray:
    """Band keys, one row per line."""
    least = least_hashes(lines, size, bands * rows)
    keys = np.zeros((len(lines), bands), np.uint64)
    for r in range(rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, r::rows])
    return mixed(keys + np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    """In order; np.unique looks up each value in a table, which takes many times as long."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


def sketches(lines: list[str], size: int) -> np.ndarray:
    """How many distinct shingles a line has and which of ``SKETCH`` bins hold an odd number of them, as bytes."""
    out = np.zeros((len(lines), 1 + SKETCH // 64), "<u8")
    for start, end, h, of_line in _shingle_hashes(lines, size):
        cuts = np.searchsorted(of_line, np.arange(end - start + 1))
        for k in range(end - start):
            own = _distinct(h[cuts[k] : cuts[k + 1]])
            odd = np.bincount((own % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
            out[start + k, 0] = len(own)
            out[start + k, 1:] = np.packbits(odd.astype(np.uint8)).view("<u8")
    return out.view(np.uint8)


def _excess(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """By how much the least possible difference of sets goes beyond what the similarity allows."""
    x, y = x.view("<u8"), y.view("<u8")
    n_x, n_y = x[:, 0].astype(np.int64), y[:, 0].astype(np.int64)
    differ = np.bitwise_count(x[:, 1:] ^ y[:, 1:]).sum(axis=1, dtype=np.int64)
    differ = np.maximum(differ, abs(n_x - n_y))
    return differ - (1 - similarity) / (1 + similarity) * (n_x + n_y)


def may_reach(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """False for pairs of sketches whose sets surely stay below the similarity."""
    return _excess(x, y, similarity) <= 1e-6


def _documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = whole_text(text_column)
    return docs.select(
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(_LAST_ID)).alias("id"),
        F.xxhash64(id_column, text).alias("key"),
        text.alias("text"),
    )


def _signed_lines(rows: DataFrame, least_chars: int, size: int, bands: int, per_band: int) -> DataFrame:
    """Every line that counts: digest, id, key, line (its number); n and bands where it is the first of its equals.

    Of equal lines in a batch the first place has their number ``n`` and their bands, all others have nulls.
    A line shorter than a shingle is like no other: it has no bands, only its digest.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[str, int] = {}
        digests, of_place, least, counts = [], [], [], []
        docs, keys, numbers = [], [], []
        for doc, key, text in zip(*batch.columns):
            doc, key = doc.as_py(), key.as_py()
            for number, line in enumerate(plain_lines(text.as_py())):
                if len(line) < least_chars:
                    continue
                at = seen.setdefault(line, len(seen))
                if at == len(digests):
                    digests.append(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")))
                    least.append(len(docs))
                    counts.append(1)
                else:
                    counts[at] += 1
                    k = least[at]
                    if (doc, key, number) < (docs[k], keys[k], numbers[k]):
                        least[at] = len(docs)
                of_place.append(at)
                docs.append(doc)
                keys.append(key)
                numbers.append(number)
        lines = list(seen)
        signed = [k.tobytes() if len(x) >= size else b"" for x, k in zip(lines, signatures(lines, size, bands, per_band))]
        n, signs = [None] * len(docs), [None] * len(docs)
        for k, count, sign in zip(least, counts, signed):
            n[k], signs[k] = count, sign
        return pa.RecordBatch.from_arrays(
            [
                pa.array(digests, pa.binary()).take(pa.array(of_place, pa.int64())),
                pa.array(docs, pa.int64()),
                pa.array(keys, pa.int64()),
                pa.array(numbers, pa.int32()),
                pa.array(n, pa.int64()),
                pa.array(signs, pa.binary()),
            ],
            names=["digest", "id", "key", "line", "n", "bands"],
        )

    return map_rows(rows, run, "digest binary, id bigint, key bigint, line int, n bigint, bands binary")


def _classes(signed: DataFrame) -> DataFrame:
    """One row per different line: digest, n (places), bands, its first place and a number ``node``.

    A task has each line once already, so the rows are dealt out as they are and sorted once.
    """
    grouped = signed.where("n IS NOT NULL").repartition("digest").groupBy("digest").agg(
        F.min(F.struct("id", "key", "line")).alias("at"), F.first("bands").alias("bands"), F.sum("n").alias("n")
    )
    return grouped.select("digest", "bands", "at.*", "n").withColumn("node", F.monotonically_increasing_id())


def _index(classes: DataFrame) -> DataFrame:
    """gram (a band's key) and id (a line's node) of all bands that lines share."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column(1).to_pylist()
        grams = np.frombuffer(b"".join(keys), np.int64)
        nodes = np.repeat(batch.column(0).to_numpy(), [len(k) // 8 for k in keys])
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(grams)], names=["id", "gram"])

    exploded = map_rows(classes.select("node", "bands"), run, "id bigint, gram bigint")
    shared = exploded.withColumn("lines", F.count(F.lit(1)).over(Window.partitionBy("gram"))).where("lines > 1")
    return shared.select("gram", "id")


def _candidates(rows: DataFrame, banded: DataFrame, size: int) -> DataFrame:
    """Text and sketch of the lines that share a band with another."""
    wanted = materialized(
        banded.groupBy("id", "key").agg(F.collect_list(F.struct("line", "node")).alias("lines"))
    )
    keys = materialized(wanted.select("key").distinct())

    def texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, lines = [], []
        for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            of_text = text.split("\n")
            for place in places:
                found.append(place["node"])
                lines.append(plain(of_text[place["line"]]))
        sketch = [s.tobytes() for s in sketches(lines, size)]
        return pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int64()), pa.array(lines, pa.string()), pa.array(sketch, pa.binary())],
            names=["node", "text", "sketch"],
        )

    held = rows_with(rows, keys, "key").dropDuplicates(["id", "key"]).join(wanted, ["id", "key"])
    return materialized(map_rows(held.select("text", "lines"), texts, "node bigint, text string, sketch binary"))


def _near_neighbours(similarity: float):
    """Pairs of a band: each line with the first one and with the one before it, where the sketches leave room."""

    def pairs_of(ids, sketch):
        here = np.arange(1, len(ids))
        for other in (np.zeros_like(here), here - 1):
            ok = may_reach(sketch[here], sketch[other], similarity)
            yield here[ok], other[ok]

    return pairs_of


def _across(similarity: float, best: bool):
    """Pairs of a band's lines in different components, where the sketches leave room.

    With ``best`` each line names only the one that it differs least from, else all.
    """

    def pairs_of(ids, sketch, component):
        for k in range(1, len(ids)):
            other = np.flatnonzero(component[:k] != component[k])
            least = None
            for part in np.array_split(other, -(-len(other) // 65_536) or 1):
                over = _excess(sketch[part], sketch[k : k + 1], similarity)
                part, over = part[over <= 1e-6], over[over <= 1e-6]
                if not best:
                    yield np.full(len(part), k), part
                elif len(part) and (least is None or over.min() < least[0]):
                    least = over.min(), part[[over.argmin()]]
            if least is not None:
                yield np.array([k]), least[1]

    return pairs_of


def _with_sketches(index: DataFrame, known: DataFrame) -> DataFrame:
    return index.join(known.select(F.col("node").alias("id"), "sketch"), "id")


def _pairs(lists: DataFrame, pairs_of, *columns: str) -> DataFrame:
    ordered = lists.repartition("gram").sortWithinPartitions("gram", "id")
    return pairs_in_lists(ordered.select("gram", "id", *columns), pairs_of)


def _open_bands(named: DataFrame) -> DataFrame:
    """The bands with lines of more than one component: gram, id, component."""
    several = (
        named.groupBy("gram")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .where("least < most")
        .select("gram")
    )
    return named.join(several, "gram", "left_semi").select("gram", "id", "component")


def _merged(links: DataFrame, labels: DataFrame) -> DataFrame:
    """component and its new name ``to``, for those that the links join."""
    ends = links.join(labels.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").join(
        labels.select(F.col("id").alias("b"), F.col("component").alias("y")), "b"
    )
    edges = materialized(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("component")).distinct()
    return materialized(min_labels(nodes, edges, "component", "to"))


def _renamed(named: DataFrame, merged: DataFrame) -> DataFrame:
    found = named.join(merged, "component", "left").withColumn("component", F.coalesce("to", "component"))
    return found.select(*named.columns)


def _codes(line: str, size: int) -> np.ndarray | None:
    """The line's distinct shingles as sorted numbers, one for each; None where 64 bits don't hold them."""
    if size != 8 or len(line) < size:
        return None
    try:
        codes = np.frombuffer(line.encode("latin-1"), np.uint8).astype(np.uint64)
    except UnicodeEncodeError:
        return None
    for width in (1, 2, 4):
        codes = codes[:-width] | codes[width:] << np.uint64(8 * width)
    return _distinct(codes)


def _similar(known: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs of lines whose shingle sets really reach the similarity."""

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, held = [], {}

        def coded(line: str) -> np.ndarray | None:
            if line not in held:
                if len(held) > 1000:
                    held.clear()
                held[line] = _codes(line, size)
            return held[line]

        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = x.as_py(), y.as_py()
            a, b = coded(x), coded(y)
            if a is None or b is None:
                a, b = shingle_set(x, size), shingle_set(y, size)
                common = len(a & b)
            else:
                both = np.sort(np.concatenate([a, b]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(common >= similarity * (len(a) + len(b) - common))
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = (
        pairs.join(known.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(known.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    return map_rows(both, verify, "a bigint, b bigint")


def deduplicate_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows_per_band: int = ROWS,
    least_chars: int = EVERY_LINE,
    mark: str = "",
) -> DataFrame:
    """``docs`` with each text's lines that stay, and n_lines, n_removed (after ``mark``).

    Lines are compared in lower case with white space made single spaces.  Two are linked
    if equal or if the Jaccard similarity of their character shingles is at least
    ``similarity``; of each component of links the line first by (id, number) stays, in all
    other places it goes.  Lines of fewer than ``least_chars`` characters always stay: by default
    only blank ones do, and lines shorter than a shingle go where equal.  A
    similar pair is found if it agrees in one of ``bands`` bands: at 0.8 with probability
    0.985, at 0.9 with 0.9998.  In a crowded band each line meets the first one, then, in
    rounds, the likest one of other components, last all that are left of these; two lines are
    compared exactly unless their sketches prove that they stay below the similarity.

    A null text has no lines and stays null.  A null id comes after all others; among rows
    that repeat an id, the text's hash decides, and rows with equal id and text keep the same
    lines, so removing whole copies of a row is left to exact deduplication.  Columns other
    than the text are passed through, except ones named n_lines and n_removed, which are
    replaced.  An empty table gives an empty one.
    """
    rows = _documents(docs, id_column, text_column)
    signed = materialized(_signed_lines(rows, least_chars, shingle, bands, rows_per_band))
    lines = signed.select("digest", "id", "key", "line")
    classes = materialized(_classes(signed))
    index = materialized(_index(classes))
    nodes = materialized(index.select("id").distinct())
    # what shares no band is like its equals only, and most lines are of that kind
    of_nodes = nodes.select(F.col("id").alias("node"))
    banded = materialized(rows_with(classes.drop("bands"), of_nodes, "node"))
    known = _candidates(rows, banded, shingle)
    near = _pairs(_with_sketches(index, known), _near_neighbours(similarity), "sketch")
    links = materialized(_similar(known, materialized(near), shingle, similarity))
    labels = materialized(min_labels(nodes, links))
    open_bands = materialized(_open_bands(materialized(index.join(labels, "id"))))
    best = [True] * ROUNDS + [False]
    while best and not open_bands.isEmpty():
        pairs_of = _across(similarity, best.pop(0))
        further = _pairs(_with_sketches(open_bands, known), pairs_of, "sketch", "component")
        more = materialized(_similar(known, materialized(further), shingle, similarity))
        if more.isEmpty():  # another round of the likest ones would find nothing either
            best = best[-1:]
            continue
        merged = _merged(more, labels)
        labels = materialized(_renamed(labels, merged))
        if best:
            open_bands = materialized(_open_bands(materialized(_renamed(open_bands, merged))))
    place = F.struct("id", "key", "line")
    member = materialized(banded.join(labels.select(F.col("id").alias("node"), "component"), "node"))
    stays = member.groupBy("component").agg(F.min(place).alias("keep"), F.sum("n").alias("of"))
    linked = member.select("digest", "n", "component").join(stays.where("of > 1"), "component")
    alone = rows_with(classes.where("n > 1").drop("bands"), of_nodes, "node", without=True)
    doubtful = materialized(
        linked.select("digest", "n", "keep").unionByName(alone.select("digest", "n", place.alias("keep")))
    )
    gone = join_balanced(lines, doubtful, ["digest"], "n", lines.count()).where(place != F.col("keep"))
    removed = materialized(gone.groupBy("id", "key").agg(F.collect_set("line").alias("_gone")))
    keys = materialized(removed.select(F.col("key").alias("_key")).distinct())

    others = [c for c in docs.columns if c not in (text_column, f"{mark}n_lines", f"{mark}n_removed")]
    text = F.col(text_column)
    tagged = docs.select(
        *[F.col(f"`{c}`") for c in others],
        text,
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(_LAST_ID)).alias("_id"),
        F.xxhash64(id_column, whole_text(text_column)).alias("_key"),
    )
    changed = rows_with(tagged, keys, "_key").join(
        removed.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "_gone"), ["_id", "_key"], "left"
    )
    same = rows_with(tagged, keys, "_key", without=True).withColumn("_gone", F.lit(None).cast("array<int>"))
    parts = F.split(text, "\n", -1)
    ends = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    is_gone = F.size(F.coalesce("_gone", F.array().cast("array<int>")))
    kept = F.array_join(F.filter(parts, lambda x, k: ~F.array_contains(F.col("_gone"), k)), "\n")
    return changed.unionByName(same, allowMissingColumns=True).select(
        *[F.col(f"`{c}`") for c in others],
        F.when(F.col("_gone").isNull(), text).otherwise(kept).alias(text_column),
        F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(ends + 1).alias(f"{mark}n_lines"),
        is_gone.alias(f"{mark}n_removed"),
    )
