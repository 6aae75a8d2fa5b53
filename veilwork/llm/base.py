"""What the operators share: reading, Arrow batches, balanced look-ups, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilwork.session import materialized

# A key with more than this share of all rows is hot: fewer than 1/share keys are.
HOT_SHARE = 1 / 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as the empty one."""
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other letters stay."""
    return F.translate(
        text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


#: The same for Python's str.translate.
LOWER_TABLE = {c: c + 32 for c in range(65, 91)}


#: What this Python worker keeps from task to task: by name, how to let go of it.
_KEPT: dict[str, Callable[[], None]] = {}


def kept(name: str, forget: Callable[[], None]) -> None:
    """A worker has a cache now, which the tasks that do not name it let go of."""
    _KEPT[name] = forget


def let_go(*but: str) -> None:
    """Drop all caches ``but`` those, and give free memory back to the machine.

    Workers serve one operator after another; without this each would keep what all had.
    """
    for name in [n for n in _KEPT if n not in but]:
        _KEPT.pop(name)()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(
    df: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
    keeps: Sequence[str] = (),
) -> DataFrame:
    """A task's Arrow batches at once; of the worker's caches only ``keeps`` stay for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(*keeps)
        yield from function(batches)
        let_go(*keeps)

    return df.mapInArrow(run, schema)


def map_rows(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str | StructType,
    keeps: Sequence[str] = (),
) -> DataFrame:
    """Each Arrow batch on its own; of the worker's caches only ``keeps`` stay for it."""
    return map_batches(df, lambda batches: map(function, batches), schema, keeps)


def row_batch(columns: dict[str, pa.Array | list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    arrays = [
        v if isinstance(v, pa.Array) else pa.array(v, types[k]) for k, v in columns.items()
    ]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


# Rows of one bigint that may be broadcast: 16 MB of keys, whatever the input's size.
BROADCAST_KEYS = 2_000_000


def rows_with(df: DataFrame, keys: DataFrame, on: str, without: bool = False) -> DataFrame:
    """Rows whose bigint ``on`` is among ``keys`` (or is not), a stored table of distinct keys.

    Keys are sent to the rows, which then need no shuffle, as long as they are few
    enough; beyond that both sides are dealt out by key.
    """
    small = keys.count() <= BROADCAST_KEYS
    side = keys.select(on)
    return df.join(F.broadcast(side) if small else side, on, "left_anti" if without else "left_semi")


# Bits of a filter for hashes: 8 MB, whatever the size of the corpus.
FILTER_BITS = 26


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, mask = hashes.view(np.uint64), np.uint64((1 << FILTER_BITS) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def filter_bits(hashes: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of a column of hashes, put together by Spark: 64 bits to a word."""
    mask = F.lit((1 << FILTER_BITS) - 1)
    slot = F.explode(
        F.array(F.col(column).bitwiseAND(mask), F.shiftright(column, 32).bitwiseAND(mask))
    )
    words = (
        hashes.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.view(np.uint64)


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False for a hash that is surely not in the filter."""
    both = np.ones(len(hashes), bool)
    for slot in _slots(hashes):
        both &= (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
    return both


def join_balanced(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    count: str,
    total: int,
    how: str = "inner",
    share: float = HOT_SHARE,
) -> DataFrame:
    """Join with a table of one row per key, whatever share of ``left`` a key has.

    ``count`` is a column of ``right``: how many rows of ``left`` have the key,
    of ``total``.  Hot keys, fewer than ``1 / share`` of them by construction,
    are broadcast; only the rows of the others are shuffled.  Both tables are read
    twice, so they should be stored ones.
    """
    hot = right.where(F.col(count) > F.lit(max(total * share, 1.0)))
    cold = right.where(F.col(count) <= F.lit(max(total * share, 1.0)))
    keys = list(on)
    of_hot = left.join(F.broadcast(hot), keys, "inner")
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return of_hot.unionByName(rest.join(cold, keys, how))


# Rows of a round's tables that one task handles.
EDGES_PER_TASK = 200_000


def min_labels(
    nodes: DataFrame, edges: DataFrame, node: str = "id", label: str = "component"
) -> DataFrame:
    """Connected components: every node with the smallest node it is connected to.

    ``edges`` has columns ``a`` and ``b``.  A distributed union-find: each round
    every node points to the smallest label among itself and its neighbours, roots
    are hooked to smaller roots, and pointers are halved, so that the number of rounds
    grows with the logarithm of a component's width.  Each edge is replaced by the
    labels of its ends, and edges inside a component leave.  Every round is a stored
    table: lost executors recompute one round at most.  Hooking aggregates with a map-side
    combine, so a node with very many edges is no hot key.
    """
    labels = None
    open_edges = materialized(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a < b")
        .distinct()
    )
    count = open_edges.count()
    # no table of a round has more rows than the edges have ends
    tasks = -(-count // EDGES_PER_TASK)

    def stored(df: DataFrame) -> DataFrame:
        return materialized(df.coalesce(tasks))

    while count:
        # every end hooks to the smallest root it has an edge to
        hooks = open_edges.groupBy("b").agg(F.min("a").alias("to"))
        parents = stored(hooks.select(F.col("b").alias("root"), "to"))
        # follow the pointers to the end: they only go down, so this is a forest
        while True:
            up = parents.select(F.col("root").alias("to"), F.col("to").alias("next"))
            jumped = stored(
                parents.join(up, "to", "left").select(
                    "root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")
                )
            )
            parents = jumped.select("root", "to")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parents
        else:
            moved = labels.join(
                parents.select(F.col("root").alias("to"), F.col("to").alias("next")), "to", "left"
            ).select("root", F.coalesce("next", "to").alias("to"))
            labels = stored(moved.unionByName(parents))
        roots = parents.select(F.col("root"), F.col("to").alias("top"))
        at_a = open_edges.join(
            roots.select(F.col("root").alias("a"), F.col("top").alias("a_top")), "a", "left"
        )
        at_b = at_a.join(
            roots.select(F.col("root").alias("b"), F.col("top").alias("b_top")), "b", "left"
        ).select(F.coalesce("a_top", "a").alias("x"), F.coalesce("b_top", "b").alias("y"))
        open_edges = stored(
            at_b.where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        count = open_edges.count()
    if labels is None:
        return nodes.withColumn(label, F.col(node))
    return nodes.join(
        labels.select(F.col("root").alias(node), F.col("to").alias(label)), node, "left"
    ).withColumn(label, F.coalesce(label, node))
