"""Self-join of documents by the Jaccard similarity of their word n-grams.

Each set indexes the n-grams of its prefix: two sets that reach the similarity share at
least one.  The lists of the index are ordered by set size, and a set skips, from its
position in a list, all that are too small or whose remaining elements are too few.

What two sets have to do with each other decides how much of a list is read.  Equal sets
are one class.  A set first meets the centre of its list only; one that is
highly similar to a centre takes over the centre's answers, that is, it belongs to the same
component, and of all pairs only those across components are left to compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.base import (
    filter_bits,
    in_filter,
    join_balanced,
    map_batches,
    map_rows,
    min_labels,
    rows_with,
    whole_text,
)
from veilwork.llm.words import shingles, text_bytes
from veilwork.session import materialized

WORDS = 5
PERCENT = 80
# N-grams with a hash below this, a fifth of all, are counted to learn which are shared.
POOL_END = -(1 << 63) + (1 << 64) // 5
# A set's elements are folded into so many bits, for a bound on how much two sets differ.
FOLDED_BITS = 1024


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def folded(elements: np.ndarray) -> bytes:
    """For each slot, whether an odd number of elements falls there.

    Two sets differ in at least as many elements as their folded bits differ.
    """
    counts = np.bincount(elements & (FOLDED_BITS - 1), minlength=FOLDED_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _shared(docs: DataFrame, words: int) -> np.ndarray:
    """A filter of the pool's n-grams that more than one document has."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.empty(0, np.int64)]
        for text in text_bytes(batch.column(0)):
            s = shingles(text, words)
            found.append(s[: np.searchsorted(s, POOL_END)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["gram"])

    counted = map_rows(docs.select("text"), run, "gram bigint").groupBy("gram").count()
    return filter_bits(counted.where("count > 1"), "gram")


def _sketches(docs: DataFrame, words: int, percent: int, shared: np.ndarray) -> DataFrame:
    """n, a digest of the set, its folded bits, and what of its prefix others may have.

    N-grams are in the order: of the pool and in one document alone, not of the pool, shared.
    The first kind fills most prefixes; it matches nothing, so it is only counted (``alone``).
    A filter that is too full changes the order, not what is found.
    """
    bits = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, folds, alone, prefixes = [], [], [], [], []
        for text in text_bytes(batch.column(1)):
            s = shingles(text, words)
            sizes.append(len(s))
            folds.append(folded(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            pool = int(np.searchsorted(s, POOL_END))
            often = in_filter(bits.value, s[:pool])
            first = pool - int(often.sum())
            length = prefix_length(len(s), percent)
            alone.append(min(first, length))
            rest = np.concatenate([s[pool:], s[:pool][often]])
            prefixes.append(rest[: max(length - first, 0)])
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
        values = np.concatenate([np.empty(0, np.int64), *prefixes])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int32()),
                pa.array(digests, pa.binary()),
                pa.array(folds, pa.binary()),
                pa.array(alone, pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
            ],
            names=["id", "n", "digest", "bits", "alone", "prefix"],
        )

    schema = "id bigint, n int, digest binary, bits binary, alone int, prefix array<bigint>"
    return map_rows(docs, run, schema)


def _reach(n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """The least number of common elements of sets this large."""
    return -(-percent * (n_x + n_y) // (100 + percent))


def _room(n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """The most elements that may be in one alone of sets this large."""
    return n_x + n_y - 2 * _reach(n_x, n_y, percent)


def _differ(bits_x: np.ndarray, bits_y: np.ndarray) -> np.ndarray:
    """In how many places rows of folded bits differ."""
    return np.bitwise_count(bits_x.view(np.uint64) ^ bits_y.view(np.uint64)).sum(axis=1, dtype=np.int64)


def _centre_pairs(percent: int):
    """Each set with its list's first set that is not too small, and with the one before it.

    A list is in order of set size; of each set: size, and place of the list's n-gram.
    """

    def pairs_of(ids, n, at) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # skip to the first set that is large enough, seen from each position
        first = np.searchsorted(n, -(-percent * n // 100))
        here = np.arange(len(n))
        for other in (first, here - 1):
            ok = (other < here) & (other >= first)
            x, y = here[ok], other[ok]
            near = np.minimum(n[x] - at[x], n[y] - at[y]) >= _reach(n[x], n[y], percent)
            yield x[near], y[near]

    return pairs_of


def _across_pairs(percent: int, best: bool):
    """Sets of different components that may reach the similarity.

    Of each set: size, place of the list's n-gram, component, folded bits.  The sets of a
    list's main component are only met, none of them goes through the list.  With ``best``
    each other set names the one that it differs least from, else all.
    """

    def pairs_of(ids, n, at, component, bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        names, counts = np.unique(component, return_counts=True)
        main = names[counts.argmax()]
        first = np.searchsorted(n, -(-percent * n // 100))
        end = np.searchsorted(n, 100 * n // percent, side="right")
        for k in np.flatnonzero(component != main):
            span = slice(first[k], end[k])
            theirs = component[span]
            left = np.minimum(n[k] - at[k], n[span] - at[span])
            ok = (theirs != component[k]) & (left >= _reach(n[k], n[span], percent))
            if not best:  # of two sets outside the main component the later one names the pair
                ok &= (theirs == main) | (np.arange(first[k], end[k]) < k)
            other = np.flatnonzero(ok) + first[k]
            over = _differ(bits[other], bits[k : k + 1]) - _room(n[k], n[other], percent)
            near = other[over <= 0]
            if best and len(near):
                near = other[[over.argmin()]]
            yield np.full(len(near), k), near

    return pairs_of


def _values(column: pa.Array) -> np.ndarray:
    """A column as an array; binary values of equal length as rows of bytes."""
    if not pa.types.is_binary(column.type):
        return column.to_numpy(zero_copy_only=False)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def pairs_in_lists(ordered: DataFrame, pairs_of) -> DataFrame:
    """Distinct pairs (a, b) of ids that ``pairs_of`` names within lists.

    Columns: gram (the list's key), id, and what ``pairs_of`` needs; a list's rows lie
    together.  A task holds one list and a bounded number of pairs at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        out_a, out_b, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out_a, out_b, size
            a = np.concatenate([np.empty(0, np.int64), *out_a])
            b = np.concatenate([np.empty(0, np.int64), *out_b])
            pair = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b]
            pair = np.unique(pair, axis=0)
            out_a, out_b, size = [], [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["a", "b"]
            )

        def work(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal size
            gram, ids = columns[:2]
            starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            ends = np.r_[starts[1:], len(gram)]
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                for x, y in pairs_of(*(c[s:e] for c in columns[1:])):
                    out_a.append(ids[s:e][x])
                    out_b.append(ids[s:e][y])
                    size += len(x)
                    if size > 1 << 18:
                        yield flush()

        for batch in batches:
            columns = [_values(c) for c in batch.columns]
            if not len(columns[0]):
                continue
            if kept is not None:
                columns = [np.concatenate(c) for c in zip(kept, columns)]
            # the last list may go on in the next batch
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            yield from work([c[:cut] for c in columns])
            kept = [c[cut:] for c in columns]
        if kept is not None:
            yield from work(kept)
        yield flush()

    return map_batches(ordered, run, "a bigint, b bigint").distinct()


def list_pairs(index: DataFrame, pairs_of, *columns: str) -> DataFrame:
    ordered = index.repartition("gram").sortWithinPartitions("gram", "n", "id")
    return pairs_in_lists(ordered.select("gram", "id", "n", "at", *columns), pairs_of)


def _open_lists(index: DataFrame, components: DataFrame, sets: DataFrame) -> DataFrame:
    """The lists with sets of more than one component, with these and their folded bits."""
    named = materialized(index.join(components, "id"))
    several = (
        named.groupBy("gram")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .where("least < most")
        .select("gram")
    )
    return named.join(several, "gram", "left_semi").join(sets.select("id", "set", "bits"), ["id", "set"])


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs without those whose folded bits rule the similarity out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not len(batch):
            return batch.select([0, 1])
        n_a, n_b, bits_a, bits_b = (_values(c) for c in batch.columns[2:])
        return batch.select([0, 1]).filter(pa.array(_differ(bits_a, bits_b) <= _room(n_a, n_b, percent)))

    def side(of: str) -> DataFrame:
        return sets.select(F.col("id").alias(of), F.col("n").alias(f"n_{of}"), F.col("bits").alias(f"bits_{of}"))

    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return map_rows(both, run, "a bigint, b bigint").distinct()


class Compared:
    """Compares pairs by their whole sets; a text's set is made once, when first needed."""

    def __init__(self, docs: DataFrame, words: int, percent: int) -> None:
        self.docs, self.words, self.percent = docs, words, percent
        self.sets: DataFrame | None = None
        self.pairs: DataFrame | None = None

    def fresh(self, pairs: DataFrame) -> DataFrame:
        """Pairs that were not compared yet, stored."""
        return materialized(pairs if self.pairs is None else pairs.join(self.pairs, ["a", "b"], "left_anti"))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of some stored fresh pairs whose sets really reach the similarity, stored."""
        words, percent = self.words, self.percent
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b"))).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("id").distinct(), "id", "left_anti")

        def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingles(t, words).tobytes() for t in text_bytes(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "grams"])

        def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        new = materialized(map_rows(rows_with(self.docs, materialized(wanted), "id"), sets_of, "id bigint, grams binary"))
        self.sets = new if self.sets is None else self.sets.union(new)
        self.pairs = pairs if self.pairs is None else self.pairs.union(pairs)
        known = self.sets
        both = (
            pairs.join(known.select(F.col("id").alias("b"), F.col("grams").alias("grams_b")), "b")
            .join(known.select(F.col("id").alias("a"), F.col("grams").alias("grams_a")), "a")
            .select("a", "b", "grams_a", "grams_b")
        )
        return materialized(map_rows(both, verify, "a bigint, b bigint"))


def similar_components(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links) of each row.

    A document's set: its distinct sequences of ``words`` words (A-Z lower-cased, cut at
    space and U+0009 to U+000D), the whole text as one if it has fewer words.  Two link
    when 100 * common >= ``percent`` * all of both.  A null or blank text has no set and links
    with nothing; its component is its own id.  Rows that repeat a text, with the same id or
    another, are one class and so share a component; other texts under one id are compared
    each, and that id's links count for all of them.  A row with a null id takes part in its
    class, gives no component its name and without another row has a null one.  Other columns are
    ignored, an empty table gives an empty one.

    N-grams are compared as 64-bit hashes, equal sets by 128 bits.  First every set meets the
    centres of its lists.  Then, in rounds, the sets of a list that are in different components:
    each names its nearest, until a round links nothing; last, all that are left.  Pairs that
    folded bits rule out, which no link does, never become rows.
    """
    texts = docs.select(docs[id_column].cast("bigint").alias("id"), whole_text(text_column).alias("text"))
    sketched = materialized(_sketches(texts, words, percent, _shared(texts, words)))
    classes = materialized(
        sketched.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    )
    heads = materialized(sketched.join(
        classes.where("class_id IS NOT NULL").select(F.col("class_id").alias("id"), F.col("digest").alias("of")), "id"
    ).where("digest = of").dropDuplicates(["id", "digest"]).withColumn("set", F.xxhash64("digest")))
    index = heads.select("id", "set", "n", "alone", F.posexplode("prefix").alias("at", "gram")).select(
        "id", "set", "n", (F.col("alone") + F.col("at")).alias("at"), "gram"
    )
    # lists of one set find nothing
    index = materialized(
        index.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("gram"))).where("sets > 1").drop("sets")
    )

    compared = Compared(texts, words, percent)
    ids = classes.where("class_id IS NOT NULL").select(F.col("class_id").alias("id")).distinct()
    links = compared.linked(
        compared.fresh(_plausible(materialized(list_pairs(index, _centre_pairs(percent))), heads, percent))
    )
    labels = materialized(min_labels(ids, links))
    for best in (True, False):
        while True:
            lists = _open_lists(index, labels, heads)
            pairs = compared.fresh(list_pairs(lists, _across_pairs(percent, best), "component", "bits"))
            more = compared.linked(pairs) if not pairs.isEmpty() else pairs
            if more.isEmpty():
                break
            links = links.union(more)
            labels = materialized(min_labels(ids, links))
            if not best:
                break
    named = materialized(
        classes.join(labels.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select(
            "digest", "component", "copies"
        )
    )
    rows = sketched.select("id", "n", "digest")
    with_set = join_balanced(rows.where("digest IS NOT NULL"), named, ["digest"], "copies", rows.count())
    blank = rows.where("digest IS NULL").withColumn("component", F.col("id"))
    return (
        with_set.select("id", "n", "component")
        .unionByName(blank.select("id", "n", "component"))
        .select(
            F.col("id").alias(id_column),
            F.col("n").cast("bigint").alias("n_shingles"),
            F.col("component").alias("component_id"),
        )
    )
