"""Scoring texts with a class-based bigram model (Brown classes by exchange).

A word's probability after another is that of its class after the other's class, times
that of the word within its class.  Counts of words cover the whole training text.  What
is clustered is a bounded number of units: the most frequent words one by one, all others
by their last letters.  Every word belongs to a unit, every unit to a class.

Pairs of neighbours are counted once and packed.  Each sweep reads that table: tasks add up how often
each unit stands next to each class, and each unit then moves to the class whose neighbours
fit its own best, until none moves or the likelihood of the class bigrams stops rising.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.base import map_rows, whole_text
from veilwork.session import materialized

# Bounds of the model: what the driver and each task hold of it.
CLASSES = 32
UNIT_WORDS = 16_384
UNIT_ENDINGS = 4_096
# Words whose counts each task has at hand (16 MB); those of all others come by a join.
WORDS_AT_HAND = 1_000_000
ENDING = 3
TRANSITION_WEIGHT = 5.0
BASE_ADD = 0.1
_BLOCK = 64


class Words(dict):
    """Numbers for words, with the hashes of each word and of its ending."""

    LIMIT = 400_000

    def __init__(self) -> None:
        super().__init__()
        self.whole = np.empty(1024, np.int64)
        self.ending = np.empty(1024, np.int64)
        self.learned: dict = {}

    def __missing__(self, word: bytes) -> int:
        number = len(self)
        if number == len(self.whole):
            self.whole = np.resize(self.whole, 2 * number)
            self.ending = np.resize(self.ending, 2 * number)
        self.whole[number] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        if word.isascii():
            last = word.rstrip(b".,;:!?|*&%$#")[-ENDING:]
        else:
            last = word.decode("utf-8", "surrogatepass").rstrip(".,;:!?|*&%$#")[-ENDING:].encode("utf-8", "surrogatepass")
        self.ending[number] = xxhash.xxh3_64_intdigest(last) - (1 << 63)
        self[word] = number
        return number

    def full(self) -> bool:
        return len(self) > self.LIMIT

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the words' numbers in all these texts, how many words each has); numbers of earlier calls may be void."""
        if self.full():
            self.clear()
            self.learned.clear()
        found = [text.encode("utf-8", "surrogatepass").lower().split() for text in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        every = map(self.__getitem__, chain.from_iterable(found))
        return np.fromiter(every, np.int64, int(counts.sum())), counts

    def hashes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        numbers, _ = self.numbers([text])
        return self.whole[numbers], self.ending[numbers]

    def values(self, compute, numbers: np.ndarray) -> np.ndarray:
        """``compute(hashes, endings)`` for the words with these numbers, once for each word.

        What is known goes when the next function comes.
        """
        known, done = self.learned.get(compute, (None, 0))
        if done < len(self):
            new = compute(self.whole[done : len(self)], self.ending[done : len(self)])
            if known is None or len(known) < len(self):  # room for as many again, not a copy each time
                wider = np.empty((2 * len(self), *new.shape[1:]), new.dtype)
                if done:
                    wider[:done] = known[:done]
                known = wider
            known[done : len(self)] = new
            if compute not in self.learned:
                self.learned.clear()
            self.learned[compute] = known, len(self)
        elif known is None:
            return compute(self.whole[:0], self.ending[:0])
        return known[numbers]


# Texts whose words are looked up at once, and the characters that end such a group.
GROUP_TEXTS, GROUP_CHARS = 256, 1 << 20


def groups(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in their order, some at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1])
        if len(held) == GROUP_TEXTS or size > GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


_WORDS = Words()


def _place(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted hash stands in the sorted ``known``, -1 if nowhere."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


class Units:
    """Unit numbers: words, then endings, then one for the rest, then the end of a text."""

    def __init__(self, words: np.ndarray, endings: np.ndarray) -> None:
        self.words, self.endings = np.sort(words), np.sort(endings)
        self.rest = len(words) + len(endings)
        self.end = self.rest + 1
        self.count = self.rest + 2

    def of(self, whole: np.ndarray, ending: np.ndarray) -> np.ndarray:
        at = _place(self.words, whole)
        by_ending = _place(self.endings, ending)
        other = np.where(by_ending >= 0, by_ending + len(self.words), self.rest)
        return np.where(at >= 0, at, other)


def _count_words(rows: DataFrame) -> DataFrame:
    """word, ending (hashes) and n over all rows; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)

        def summed() -> pa.RecordBatch:
            seen = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(_WORDS.whole[seen]), pa.array(_WORDS.ending[seen]), pa.array(counts[seen])],
                names=["word", "ending", "n"],
            )

        for batch in batches:
            for texts in groups(batch.column(0)):
                if _WORDS.full():  # the numbers will be given anew
                    yield summed()
                    counts = np.zeros(0, np.int64)
                numbers, _ = _WORDS.numbers(texts)
                if len(counts) < len(_WORDS):
                    counts = np.concatenate([counts, np.zeros(2 * len(_WORDS) - len(counts), np.int64)])
                np.add.at(counts, numbers, 1)
        yield summed()

    return (
        rows.select("text")
        .mapInArrow(run, "word bigint, ending bigint, n bigint")
        .groupBy("word")
        .agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))
    )


def _most_frequent(counts: DataFrame, key: str, most: int) -> pa.Table:
    """key and n of the keys from a count on that at most ``most`` reach; ties stay together."""
    sizes = counts.groupBy("n").count().orderBy(F.desc("n"))
    # one row per different count: far fewer than keys, and only as many as are needed
    least, total = None, 0
    for r in sizes.toLocalIterator():
        total += r["count"]
        if total > most:
            break
        least = r["n"]
    if least is None:
        return counts.select(key, "n").limit(0).toArrow()
    return counts.where(F.col("n") >= least).select(key, "n").toArrow()


# Parts in which pairs of units are added up, by the left unit; the model bounds what one can hold.
PAIR_PARTS = 256
# Pairs that a task sorts at once.
PAIRS_AT_ONCE = 4_000_000


def summed_pairs(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs in order, and the sum of each one's numbers."""
    order = np.argsort(pair, kind="stable")
    pair, n = pair[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    return pair[first], np.add.reduceat(n, first)


_PACKED = "left binary, right binary, n binary"


def _packed_row(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Pairs as the bytes of one row: ``left``, ``right`` (32 bits) and ``n`` (64 bits)."""
    data = [[c.astype(t).tobytes()] for c, t in zip((left, right, n), ("<i4", "<i4", "<i8"))]
    return pa.RecordBatch.from_arrays([pa.array(d, pa.binary()) for d in data], names=["left", "right", "n"])


def _packed_bigrams(rows: DataFrame, units: Units) -> DataFrame:
    """All pairs of neighbours and their numbers, packed; each pair stands in one row only.

    Each task adds up its own pairs first and sends them as bytes, a row for each part of the left units:
    a task's pairs are different ones, and as single rows their way takes longer than all counting.
    """
    model = rows.sparkSession.sparkContext.broadcast(units)
    count, width = units.count, -(-units.count // PAIR_PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = model.value
        unit_of, end = units.of, np.array([units.end])

        def counted(sequence: list[np.ndarray]) -> pa.RecordBatch:
            # texts one after another, an end before, between and behind them
            joined = np.concatenate(sequence)
            pair, n = np.unique(joined[:-1] * count + joined[1:], return_counts=True)
            part = pair // (count * width)
            parts = np.unique(part)
            cuts = np.append(np.searchsorted(part, parts), len(part))
            data = [[x[i:j].astype("<i8").tobytes() for i, j in zip(cuts, cuts[1:])] for x in (pair, n)]
            return pa.RecordBatch.from_arrays(
                [pa.array(parts.astype(np.int32)), *(pa.array(d, pa.binary()) for d in data)],
                names=["part", "pair", "n"],
            )

        sequence, size = [end], 1
        for batch in batches:
            for texts in groups(batch.column(0)):
                numbers, counts = _WORDS.numbers(texts)
                # an end behind each text
                sequence.append(np.insert(_WORDS.values(unit_of, numbers), np.cumsum(counts), end[0]))
                size += len(sequence[-1])
                if size > PAIRS_AT_ONCE:
                    yield counted(sequence)
                    sequence, size = [end], 1
        if len(sequence) > 1:
            yield counted(sequence)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of whole parts, one part after another; what waits is added up whenever it has doubled."""
        part, held, size, least = None, [], 0, PAIRS_AT_ONCE

        def added() -> tuple[np.ndarray, np.ndarray]:
            return summed_pairs(*(np.concatenate([h[k] for h in held]) for k in range(2)))

        def row() -> pa.RecordBatch:
            pair, n = added()
            return _packed_row(*np.divmod(pair, count), n)

        for batch in batches:
            for number, *data in zip(*batch.columns):
                if held and number.as_py() != part:
                    yield row()
                    held, size, least = [], 0, PAIRS_AT_ONCE
                part = number.as_py()
                # a copy: the batch goes
                held.append([np.frombuffer(x.as_buffer(), "<i8").copy() for x in data])
                size += len(held[-1][0])
                if size > least:
                    held = [added()]
                    size = len(held[0][0])
                    least = max(PAIRS_AT_ONCE, 2 * size)
        if held:
            yield row()

    sent = rows.select("text").mapInArrow(run, "part int, pair binary, n binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(total, _PACKED)


def _bigrams(rows: DataFrame, units: Units) -> DataFrame:
    """left, right (unit numbers) and n of all pairs of neighbours, a row each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [b"".join(c.to_pylist()) for c in batch.columns]
        arrays = [pa.array(np.frombuffer(d, t)) for d, t in zip(data, ("<i4", "<i4", "<i8"))]
        return pa.RecordBatch.from_arrays(arrays, names=["left", "right", "n"])

    return map_rows(_packed_bigrams(rows, units), run, "left int, right int, n bigint")


# Pairs of units in a row that is packed of single ones.
PACKED_PAIRS = 65_536


def _packed(bigrams: DataFrame) -> DataFrame:
    """Rows of single pairs packed, many to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def row() -> pa.RecordBatch:
            return _packed_row(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3)))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PACKED_PAIRS:
                yield row()
                held, size = [], 0
        if size:
            yield row()

    return bigrams.mapInArrow(run, _PACKED)


def _neighbours(packed: DataFrame, units: Units, class_of: np.ndarray, classes: int) -> np.ndarray:
    """How often each unit follows (first half) and precedes (second half) each class."""
    spark = packed.sparkSession
    model = spark.sparkContext.broadcast((units.count, class_of))
    width = 2 * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, class_of = model.value
        table = np.zeros(count * width, np.int64)
        used = False
        for row in chain.from_iterable(zip(*batch.columns) for batch in batches):
            left, right, n = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, ("<i4", "<i4", "<i8")))
            left, right = left.astype(np.int64), right.astype(np.int64)
            used = True
            np.add.at(table, right * width + class_of[left], n)
            np.add.at(table, left * width + classes + class_of[right], n)
        if used:
            parts = np.resize(table, -(-count // _BLOCK) * _BLOCK * width)
            parts[len(table) :] = 0
            parts = parts.reshape(-1, _BLOCK * width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(parts))), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["block", "table"],
            )

    def total(key, batches):
        whole = sum(np.frombuffer(t.as_py(), np.int64) for t in batches.column("table"))
        return pa.table({"block": [key[0].as_py()], "table": pa.array([whole.tobytes()], pa.binary())})

    found = (
        packed.mapInArrow(run, "block bigint, table binary")
        .groupBy("block")
        .applyInArrow(total, "block bigint, table binary")
        .collect()
    )
    table = np.zeros((-(-units.count // _BLOCK), _BLOCK * width), np.int64)
    for r in found:
        table[r["block"]] = np.frombuffer(r["table"], np.int64)
    return table.reshape(-1, width)[: units.count]


def steps(table: np.ndarray, class_of: np.ndarray, classes: int) -> np.ndarray:
    """How often each class (row) stands before each class (column)."""
    counts = np.zeros((classes, classes), np.int64)
    np.add.at(counts, class_of, table[:, :classes])
    return counts.T


def likelihood(counts: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, up to what no assignment changes."""

    def sums(n: np.ndarray) -> float:
        n = n[n > 0].astype(float)
        return float((n * np.log(n)).sum())

    return sums(counts) - sums(counts.sum(0)) - sums(counts.sum(1))


def exchange(table: np.ndarray, class_of: np.ndarray, classes: int, end: int) -> np.ndarray:
    """Each unit's best class, given what stands around it and around the classes."""
    follows, precedes = table[:, :classes], table[:, classes:]
    before = np.zeros((classes, classes))
    after = np.zeros((classes, classes))
    np.add.at(before, class_of, follows)
    np.add.at(after, class_of, precedes)
    size = before.sum(1)
    with np.errstate(divide="ignore"):
        fit_before = np.log(before + 0.1) - np.log(size + 0.1 * classes)[:, None]
        fit_after = np.log(after + 0.1) - np.log(after.sum(1) + 0.1 * classes)[:, None]
    gain = follows @ fit_before.T + precedes @ fit_after.T
    gain[:, class_of[end]] = -np.inf
    best = gain.argmax(1)
    seen = follows.sum(1) > 0
    moved = np.where(seen, best, class_of)
    moved[end] = class_of[end]
    return moved


def converged(neighbours, class_of: np.ndarray, classes: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(classes of units, their table) when no unit moves or a sweep stops raising the likelihood.

    ``neighbours`` gives the table for an assignment.  Each rise is a new assignment, so
    the sweeps come to an end; the last one, which gained nothing, is not kept.
    """
    table = neighbours(class_of)
    value = likelihood(steps(table, class_of, classes))
    while True:
        moved = exchange(table, class_of, classes, end)
        if (moved == class_of).all():
            return class_of, table
        moved_table = neighbours(moved)
        moved_value = likelihood(steps(moved_table, moved, classes))
        if moved_value <= value:
            return class_of, table
        class_of, table, value = moved, moved_table, moved_value


class Model:
    """Everything of the model but the words' own counts."""

    def __init__(self, units, class_of, transitions, singles, total, distinct, ends) -> None:
        self.units, self.class_of = units, class_of
        classes = len(transitions)
        self.total, self.distinct, self.ends = total, distinct, ends
        size = transitions.sum(0).astype(float)
        share = (size + 0.1) / (size.sum() + 0.1 * classes)
        rows = transitions.sum(1, keepdims=True)
        self.step = np.log10((transitions + TRANSITION_WEIGHT * share) / (rows + TRANSITION_WEIGHT))
        new = (singles + 0.5) / (size + 1.0)
        new[class_of[units.end]] = 0.0
        with np.errstate(divide="ignore"):
            self.unknown = np.log10(new)  # in place of a word that was never seen
            self.known = np.log10(1.0 - new) - np.log10(np.maximum(size, 1.0))  # added to log10 c
        self.base_unit = np.log10(total + BASE_ADD * (distinct + 1))


def train(rows: DataFrame, classes: int = CLASSES) -> tuple[Model, DataFrame, np.ndarray, np.ndarray]:
    """(model, stored counts of all words, hashes and counts of the most frequent ones)."""
    counts = materialized(_count_words(rows))
    texts = rows.count()
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = (totals["n"] or 0) + texts, totals["v"] + (texts > 0)
    at_hand = _most_frequent(counts, "word", WORDS_AT_HAND)
    word, n = (at_hand.column(c).to_numpy() for c in ("word", "n"))
    top = np.lexsort((word, -n))[:UNIT_WORDS]
    endings = counts.groupBy("ending").agg(F.sum("n").alias("n"))
    units = Units(word[top], _most_frequent(endings, "ending", UNIT_ENDINGS).column("ending").to_numpy())

    # the most frequent words begin as a class each, all other units share one
    end_class = classes - 1
    class_of = np.zeros(units.count, np.int64)
    class_of[_place(units.words, word[top[: classes - 2]])] = np.arange(1, min(classes - 2, len(top)) + 1)
    class_of[units.end] = end_class
    bigrams = materialized(_packed_bigrams(rows, units))
    class_of, table = converged(
        lambda assigned: _neighbours(bigrams, units, assigned, classes), class_of, classes, units.end
    )
    transitions = steps(table, class_of, classes)

    model_units = rows.sparkSession.sparkContext.broadcast((units, class_of))

    def classed(batch: pa.RecordBatch) -> pa.RecordBatch:
        units, class_of = model_units.value
        found = class_of[units.of(batch.column(0).to_numpy(), batch.column(1).to_numpy())]
        return pa.RecordBatch.from_arrays([pa.array(found)], names=["class"])

    singles = np.zeros(classes)
    once = map_rows(counts.where("n = 1").select("word", "ending"), classed, "class bigint")
    for r in once.groupBy("class").count().collect():
        singles[r["class"]] = r["count"]
    order = np.argsort(word)
    return Model(units, class_of, transitions, singles, total, distinct, texts), counts, word[order], n[order]


def score_texts(
    docs: DataFrame,
    training: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    classes: int = CLASSES,
) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score, perplexity of each text.

    Words are cut at space and U+0009 to U+000D, A-Z in lower case; each text ends with
    one more token, the end.  ``base_score`` adds log10((c + 0.1) / (N + 0.1 (V + 1))) over
    tokens; ``score`` is the class model's log10 probability, and ``perplexity`` is
    10^(-score / n_tokens).  Transitions are smoothed by the classes' own shares; a word never
    seen in training gets the share of its class that words seen once have.  A null text
    counts as empty; rows that repeat are scored (and trained on) each.  When nothing could
    be learned, ``score`` equals ``base_score``.  An empty table gives an empty one.

    Words are told apart by 64-bit hashes.  A text never leaves its task: what it needs of
    words that are not at hand comes as a sum per text.
    """
    rows = docs.select(
        docs[id_column].cast("bigint").alias("_id"), whole_text(text_column).alias("text"), training.alias("train")
    )
    model, counts, word, n = train(rows.where("train").select("text"), classes)
    shared = rows.sparkSession.sparkContext.broadcast((model, word, n))

    held: dict = {}

    def of_words(model, word, n):
        # the same function for all batches of a task, so that words are looked up once
        def looked_up(whole, ending):
            """Class, whether at hand, and what each place of the word adds to base and score."""
            unit_class = model.class_of[model.units.of(whole, ending)]
            at = _place(word, whole)
            here = at >= 0
            out = np.zeros((len(whole), 4))
            out[:, 0], out[:, 1] = unit_class, here
            c = n[at[here]].astype(float)
            out[here, 2] = np.log10(c + BASE_ADD)
            out[here, 3] = np.log10(c) + model.known[unit_class[here]]
            return out

        return held.setdefault("words", looked_up)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, word, n = shared.value
        looked_up = of_words(model, word, n)
        end_class, ends = model.class_of[model.units.end], model.ends
        out = {k: [np.empty(0)] for k in ("tokens", "known", "base", "score")}
        rare_counts, rare_words, rare_classes = [np.zeros(1, np.int64)], [], []
        for texts in groups(batch.column(1)):
            numbers, counts = _WORDS.numbers(texts)
            found = _WORDS.values(looked_up, numbers)
            unit_class = found[:, 0].astype(np.int64)
            # each text's words and behind them its end
            behind = np.cumsum(counts)
            first = np.r_[0, behind[:-1]] + np.arange(len(counts))
            path = np.insert(unit_class, behind, end_class)
            steps = model.step[np.r_[end_class, path[:-1]], path]
            here, base, logs = (np.add.reduceat(np.insert(found[:, k], behind, 0.0), first) for k in (1, 2, 3))
            out["tokens"].append(counts + 1)
            out["known"].append(here + (ends > 0))
            out["base"].append(base + np.log10(ends + BASE_ADD) - (counts + 1) * model.base_unit)
            out["score"].append(np.add.reduceat(steps, first) + logs)
            rare = found[:, 1] == 0
            rare_counts.append(counts - here.astype(np.int64))
            rare_words.append(_WORDS.whole[numbers[rare]])
            rare_classes.append(unit_class[rare])
        out = {k: np.concatenate(x) for k, x in out.items()}
        rare_offsets = np.cumsum(np.concatenate(rare_counts))
        offsets = pa.array(rare_offsets.astype(np.int32))
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(t)))
            for x, t in ((rare_words, np.int64), (rare_classes, np.int32))
        ]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(out["tokens"].astype(np.int64)),
                pa.array(out["known"].astype(np.int64)),
                pa.array(out["base"]),
                pa.array(out["score"]),
                *lists,
            ],
            names=["_id", "n_tokens", "n_known", "base", "score", "rare", "rare_class"],
        )

    schema = "_id bigint, n_tokens bigint, n_known bigint, base double, score double, " \
        "rare array<bigint>, rare_class array<int>"
    scored = materialized(
        map_rows(rows.select("_id", "text"), run, schema).withColumn("stamp", F.monotonically_increasing_id())
    )
    # (text, word) of all that was not at hand, with its number of places
    rare = (
        scored.where(F.size("rare") > 0)
        .select("stamp", F.explode(F.arrays_zip("rare", "rare_class")).alias("w"))
        .groupBy("stamp", F.col("w.rare").alias("word"), F.col("w.rare_class").alias("class"))
        .agg(F.count(F.lit(1)).alias("times"))
    )
    per_class = F.array(*[F.lit(float(x)) for x in model.known]), F.array(*[F.lit(float(x)) for x in model.unknown])
    known, unknown = (F.element_at(a, F.col("class") + 1) for a in per_class)
    c = F.coalesce("n", F.lit(0))
    word_log = F.when(c > 0, known + F.log10(F.greatest(c, F.lit(1)))).otherwise(unknown)
    late = (
        rare.join(counts.select("word", "n"), "word", "left")
        .groupBy("stamp")
        .agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("late_known"),
            F.sum(F.col("times") * F.log10(c + BASE_ADD)).alias("late_base"),
            F.sum(F.col("times") * word_log).alias("late_score"),
        )
    )
    none = F.lit(0)
    full = scored.drop("rare", "rare_class").join(late, "stamp", "left")
    base = F.col("base") + F.coalesce("late_base", none)
    score = F.col("score") + F.coalesce("late_score", none) if model.total else base
    return full.select(
        F.col("_id").alias(id_column),
        "n_tokens",
        (F.col("n_known") + F.coalesce("late_known", none)).alias("n_known"),
        F.lit(int(model.total)).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
