"""Near-duplicate documents by SimHash, with bit-sliced comparison of fingerprints.

Fingerprints within the radius agree on two of ``radius + 2`` pieces of their 64 bits, so
they meet in a bucket of one of the pairs of pieces.  A bucket's fingerprints are stored as 64
vertical bit planes: one word holds the same bit of 64 fingerprints.  A plane against itself,
moved by some places, is the difference of as many pairs; carry-save adders count the
differences of all of them at once, and words in which every pair is beyond the radius, or
already connected, are left out of what follows.

Buckets that are too large for one task are split by further pieces of the bits, on one of
which two fingerprints must agree again, and what is left after that by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.base import join_balanced, map_rows, min_labels, whole_text
from veilwork.session import materialized

WORDS = 3
RADIUS = 3
SEED = 42
# Fingerprints of a bucket that one task compares at a time.
BLOCK = 8192
# How often a larger bucket is split by further bits before it is cut into blocks.
REFINEMENTS = 3
# Planes after which lanes beyond the radius are looked for.
PLANES_A_STEP = 12

_BITS = 64
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints -------------------------------------------------------------------------------


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every sequence of ``words`` words; a shorter text is one sequence."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    size = min(words, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(found) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist())]
    return np.array(hashes, np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have set, as a signed 64-bit number."""
    set_in = np.zeros(_BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        piece = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(piece, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * set_in > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_column: str, text_column: str, words: int = WORDS) -> DataFrame:
    """id and fp of every row; a narrow pass over whole texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        found = [simhash(shingle_hashes(t, words)) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    texts = docs.select(docs[id_column].cast("bigint").alias("id"), whole_text(text_column).alias("text"))
    return map_rows(texts, run, "id bigint, fp bigint")


# --- bit-sliced comparison ----------------------------------------------------------------------


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Row b holds bit b of all fingerprints, 64 of them to a word, and a word to spare."""
    lanes = -(-len(fps) // _BITS) * _BITS + _BITS
    padded = np.zeros(lanes, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view("<u8")


def _packed(lanes: np.ndarray, words: int) -> np.ndarray:
    """Booleans as bits of ``words`` words; places beyond the end are set."""
    out = np.ones(words * _BITS, bool)
    out[: len(lanes)] = lanes
    return np.packbits(out, bitorder="little").view("<u8")


class Counter:
    """Counts of up to ``limit`` for 64 lanes a word, one bit of all counts to a plane."""

    def __init__(self, limit: int, words: int):
        self.limit = limit
        self.planes = [np.zeros(words, "<u8") for _ in range(max(1, limit.bit_length()))]
        self.over = np.zeros(words, "<u8")

    def _add(self, plane: np.ndarray, at: int) -> None:
        while at < len(self.planes):
            carry = self.planes[at] & plane
            self.planes[at] ^= plane
            plane, at = carry, at + 1
        self.over |= plane

    def add(self, planes: np.ndarray) -> None:
        """Carry-save: three planes become one of ones and one of twos."""
        full = len(planes) - len(planes) % 3
        for k in range(0, full, 3):
            a, b, c = planes[k], planes[k + 1], planes[k + 2]
            either = a ^ b
            self._add(either ^ c, 0)
            self._add((a & b) | (either & c), 1)
        for k in range(full, len(planes)):
            self._add(planes[k], 0)

    def beyond(self) -> np.ndarray:
        """Lanes that count more than the limit."""
        more, same = np.zeros_like(self.over), np.full_like(self.over, _ONES)
        for k in reversed(range(len(self.planes))):
            if self.limit >> k & 1:
                same &= self.planes[k]
            else:
                more |= same & self.planes[k]
                same &= ~self.planes[k]
        return self.over | more

    def keep(self, words: np.ndarray) -> None:
        self.planes = [p[words] for p in self.planes]
        self.over = self.over[words]


def near_lanes(planes: np.ndarray, shift: int, skipped: np.ndarray, radius: int) -> np.ndarray:
    """Lanes x for which x and x + ``shift`` differ in at most ``radius`` bits.

    ``skipped`` has a bit for each lane that need not be compared, and its length says how
    many words are.  Words are abandoned as soon as no lane of theirs is left.
    """
    live = np.flatnonzero(skipped != _ONES)
    out = skipped[live]
    far, near = divmod(shift, _BITS)
    counter = Counter(radius, len(live))
    for k in range(0, _BITS, PLANES_A_STEP):
        if not len(live):
            break
        here = planes[k : k + PLANES_A_STEP]
        there = here[:, live + far]
        if near:
            last = here.shape[1] - 1
            there = (there >> np.uint64(near)) | (
                here[:, np.minimum(live + far + 1, last)] << np.uint64(_BITS - near)
            )
        counter.add(here[:, live] ^ there)
        out = out | counter.beyond()
        alive = out != _ONES
        if not alive.all():
            live, out = live[alive], out[alive]
            counter.keep(alive)
    lanes = np.flatnonzero(np.unpackbits((~out).view(np.uint8), bitorder="little"))
    return live[lanes // _BITS] * _BITS + lanes % _BITS


def _roots(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def connect(fps: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of places that connect all fingerprints of a bucket which links connect.

    Buckets of these ``sizes`` follow one another.  The pairs are a forest: at most as many as
    there are fingerprints, however many pairs are near.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = np.cumsum(sizes) - sizes
    sizes = sizes[order]
    # larger buckets first: what a shift concerns is a prefix
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.repeat(starts[order], sizes) + within
    room = np.repeat(sizes, sizes) - 1 - within
    planes, parent = bit_planes(fps[place]), np.arange(len(place))
    links: list[np.ndarray] = []
    reach = np.cumsum(sizes)
    for shift in range(1, int(sizes[0]) if len(sizes) else 0):
        # lanes of buckets with more than ``shift`` members
        lanes = int(reach[np.searchsorted(-sizes, -shift) - 1])
        ahead = parent[np.minimum(np.arange(shift, lanes + shift), len(parent) - 1)]
        skipped = (room[:lanes] < shift) | (parent[:lanes] == ahead)
        if skipped.all():
            continue
        near = near_lanes(planes, shift, _packed(skipped, -(-lanes // _BITS)), radius)
        for x, y in zip(near.tolist(), (near + shift).tolist()):
            a, b = x, y
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((place[x], place[y]))
        if len(near):
            parent = _roots(parent)
    return np.array(links, np.int64).reshape(-1, 2)


# --- buckets ------------------------------------------------------------------------------------


def _pieces(bits: list[int], count: int) -> list[int]:
    """Masks that split these bits into ``count`` pieces of about the same length."""
    cuts = [len(bits) * k // count for k in range(count + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]


def first_masks(radius: int) -> list[int]:
    """Two fingerprints within the radius agree on all bits of at least one mask."""
    return [a | b for a, b in combinations(_pieces(list(range(_BITS)), radius + 2), 2)]


def further_masks(mask: int, radius: int) -> list[int]:
    """The same for two that agree on ``mask``; none where no bits are left to split by."""
    rest = [b for b in range(_BITS) if not mask >> b & 1]
    return [mask | p for p in _pieces(rest, radius + 1)] if len(rest) > radius else []


def _signed(mask: int) -> int:
    return mask - (1 << _BITS) if mask >> (_BITS - 1) else mask


def _keyed(rows: DataFrame, masks: Column) -> DataFrame:
    return rows.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def _cut_up(large: DataFrame, block: int) -> DataFrame:
    """Rows of (mask, key, members) that are beyond one block, once for each pair of blocks."""
    blocks = F.ceil(F.col("members") / block).cast("int") + 1
    of = large.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        of.withColumn("other", other)
        .where("other <> b")
        .select("fp", "mask", "key", (F.least("b", "other") * F.col("blocks") + F.greatest("b", "other")).alias("part"))
    )


def bucketed(fps: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """(fp, mask, key, part): any two fingerprints within the radius share a (mask, key, part).

    About ``block`` rows have the same one at most, two blocks' where a bucket is cut up.
    """
    masks = first_masks(radius)
    rows = _keyed(fps, F.array(*[F.lit(_signed(m)) for m in masks]))
    small: DataFrame | None = None
    for level in range(REFINEMENTS + 1):
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("members"))
        hot = materialized(sizes.where(F.col("members") > block))
        total = hot.agg(F.sum("members")).first()[0]
        if total is None:
            cold, large = rows, None
        else:
            # a stored table of large buckets, fewer than rows / block; Spark sends it out if it is small
            cold = rows.join(hot, ["mask", "key"], "left_anti")
            large = materialized(join_balanced(materialized(rows.join(hot, ["mask", "key"], "left_semi")), hot, ["mask", "key"], "members", total))
        cold = cold.select("fp", "mask", "key", F.lit(0).alias("part"))
        small = cold if small is None else small.unionByName(cold)
        if large is None:
            return small
        further = {m: further_masks(m, radius) for m in masks}
        if level == REFINEMENTS or not all(further.values()):
            return small.unionByName(_cut_up(large, block))
        of_mask = F.create_map(
            *[x for m, f in further.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in f]))]
        )
        rows = _keyed(large.select("fp", "mask"), of_mask[F.col("mask")]).distinct()
        masks = list(dict.fromkeys(m for f in further.values() for m in f))
    return small


def forest(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between fingerprints that connect what is connected within buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(columns: list[np.ndarray]) -> pa.RecordBatch:
            fp, *keys = columns
            new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
            starts = np.flatnonzero(new)
            sizes = np.r_[starts[1:], len(fp)] - starts
            kept = np.repeat(sizes > 1, sizes)
            held = fp[kept]
            pairs = connect(held.view(np.uint64), sizes[sizes > 1], radius)
            return pa.RecordBatch.from_arrays([pa.array(held[pairs[:, 0]]), pa.array(held[pairs[:, 1]])], names=["a", "b"])

        kept: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            if kept is not None:
                columns = [np.concatenate(c) for c in zip(kept, columns)]
            # the last bucket may go on in the next batch
            last = np.all([k == k[-1] for k in columns[1:]], axis=0)
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield links([c[:cut] for c in columns])
            kept = [c[cut:] for c in columns]
        if kept is not None:
            yield links(kept)

    ordered = rows.repartition("mask", "key", "part").sortWithinPartitions("mask", "key", "part")
    return ordered.select("fp", "mask", "key", "part").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
    block: int = BLOCK,
) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (smallest id reachable) of each row.

    A fingerprint's bit is set if more than half of the hashes of the text's word sequences
    (repeats count each time) have it set; A-Z are lower-cased, words are cut at space and
    U+0009 to U+000D, and a text of fewer words is one sequence.  A null or blank text has
    fingerprint zero and links like any other.  Two rows link when their fingerprints differ in at most
    ``radius`` bits.  Rows that repeat a text or an id are compared each.  A row with a null id
    links too and gives a component no name; one of null ids alone has a null name.
    Other columns are ignored, an empty table gives an empty one.
    """
    marked = materialized(fingerprints(docs, id_column, text_column, words))
    classes = materialized(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")))
    links = materialized(forest(bucketed(classes.select("fp"), radius, block), radius))
    labels = materialized(min_labels(classes, links, node="fp"))
    names = materialized(
        labels.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    )
    named = materialized(join_balanced(labels, names, ["component"], "members", labels.count()).select("fp", "copies", "component_id"))
    return join_balanced(marked, named, ["fp"], "copies", marked.count()).select(
        F.col("id").alias(id_column),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
