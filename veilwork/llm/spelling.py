"""Groups of spelling variants: rare words and the frequent words one edit away from them.

Two words at one edit agree on the first or on the second half of either.  The vocabulary is dealt
out by the first and by the last letters, which are part of these halves, and each task
searches the words it has in a bidirectional FM-index of them: one half exactly, then across
the other with one error.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.base import join_balanced, whole_text
from veilwork.llm.fm_index import WordIndex
from veilwork.session import materialized

LEAST_CHARS = 7
LEAST_COUNT = 2
TIMES = 10
# One run in so many, by a digest of row and run, loses a letter; 0: none does.
SLIP_EVERY = 31
# Words of one index.
BLOCK = 16_384
# Words, and bytes of words, that a task counts before it hands them on.
HELD_WORDS, HELD_BYTES = 200_000, 32 << 20
# Letters of asked words that are searched at the same time.
SEARCHED = 1 << 16

LETTERS = "A-Za-zÀ-ÿ"


def runs_of(doc: int | None, text: str, pattern: re.Pattern, slip_every: int) -> Iterator[tuple[bytes, int]]:
    """Runs of letters of a text, A-Z in lower case, and how often each occurs."""
    counts: Counter = Counter()
    for run, n in Counter(pattern.findall(text)).items():
        counts[run.encode("utf-8", "surrogatepass").lower()] += n
    start = zlib.crc32(b"%s:" % ("" if doc is None else str(doc)).encode())
    for run, n in counts.items():
        h = zlib.crc32(run, start)
        if slip_every and h % slip_every == 0:
            letters = run.decode("utf-8", "surrogatepass")
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode("utf-8", "surrogatepass")
        yield run, n


def vocabulary(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT,
    slip_every: int = SLIP_EVERY,
) -> DataFrame:
    """word and n: words of at least these code points and occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a shorter run gives no word, whether or not it loses a letter
        pattern = re.compile(f"[{LETTERS}]{{{least_chars},}}")
        counts: Counter = Counter()
        held = 0

        def counted() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in runs_of(doc, text.as_py(), pattern, slip_every):
                    if word not in counts:
                        held += len(word)
                    counts[word] += n
                if len(counts) > HELD_WORDS or held > HELD_BYTES:
                    yield counted()
                    counts, held = Counter(), 0
        yield counted()

    texts = docs.select(docs[id_column].cast("bigint").alias("id"), whole_text(text_column).alias("text"))
    return (
        texts.mapInArrow(run, "word string, n bigint")
        .where(F.length("word") >= least_chars)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least_count)
    )


def _dealt_out(words: DataFrame, key_chars: int, block: int) -> DataFrame:
    """Words by their first and by their last letters, about ``block`` of them to a group.

    In a group, words that are ``asked`` meet those that are ``indexed``.  Keys of few words
    share groups.  A key of more words is cut into blocks by a digest of the word, and each block of
    asked words meets each block of indexed ones in a group of its own.
    """
    keyed = words.select(
        "word", "n", F.explode(F.array(
            F.struct(F.lit(True).alias("first_half"), F.left("word", F.lit(key_chars)).alias("key")),
            F.struct(F.lit(False).alias("first_half"), F.right("word", F.lit(key_chars)).alias("key")),
        )).alias("k"),
    ).select("word", "n", "k.*")
    keys = ["first_half", "key"]
    hot = materialized(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > block))
    groups = max(1, -(-2 * words.count() // block))
    cold = keyed if hot.isEmpty() else keyed.join(hot, keys, "left_anti")
    together = cold.select(
        "first_half", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("part"),
        F.lit(-1).alias("x"), F.lit(-1).alias("y"), "word", "n",
        F.lit(True).alias("asked"), F.lit(True).alias("indexed"),
    )
    total = hot.agg(F.sum("members")).first()[0]
    if total is None:
        return together
    blocks = F.ceil(F.col("members") / block).cast("int")
    cut = join_balanced(materialized(keyed.join(hot, keys, "left_semi")), hot, keys, "members", total)
    cut = cut.withColumn("b", F.pmod(F.xxhash64("word"), blocks).cast("int"))
    every = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    both = cut.select("*", every)
    part = F.xxhash64("key").alias("part")
    as_asked = both.select(
        "first_half", part, F.col("b").alias("x"), F.col("other").alias("y"), "word", "n",
        F.lit(True).alias("asked"), F.lit(False).alias("indexed"),
    )
    as_indexed = both.select(
        "first_half", part, F.col("other").alias("x"), F.col("b").alias("y"), "word", "n",
        F.lit(False).alias("asked"), F.lit(True).alias("indexed"),
    )
    return together.unionByName(as_asked).unionByName(as_indexed)


def search(words: list[str], asked: list[str], first_half: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in ``asked``, place in ``words``) at one edit whose named half is unchanged.

    With the second half: only those whose first half is not unchanged as well.
    """
    index = WordIndex(words)
    order = np.argsort(np.fromiter(map(len, asked), np.int64, len(asked)), kind="stable")
    at = 0
    while at < len(order):
        # words of about the same length together
        size = max(1, SEARCHED // (len(asked[order[at]]) + 1))
        chosen = order[at : at + size]
        while len(chosen) > 1 and len(asked[chosen[-1]]) > 2 * len(asked[chosen[0]]):
            chosen = chosen[: -(-len(chosen) // 2)]
        at += len(chosen)
        which, number = index.near([asked[k] for k in chosen], first_half)
        which = chosen[which]
        if not first_half and len(which):
            new = [
                not words[v].startswith(asked[w][: len(asked[w]) // 2])
                for w, v in zip(which.tolist(), number.tolist())
            ]
            which, number = which[new], number[new]
        yield which, number


def near_words(words: DataFrame, least_chars: int = LEAST_CHARS, block: int = BLOCK) -> DataFrame:
    """(word, other, other_n): every pair of words at one edit, from both sides."""
    schema = "word string, other string, other_n bigint"

    def run(group: pa.Table) -> pa.Table:
        first_half = group.column("first_half")[0].as_py()
        indexed, asked = group.filter(group.column("indexed")), group.filter(group.column("asked"))
        names, own = indexed.column("word").combine_chunks(), asked.column("word").combine_chunks()
        n = indexed.column("n").combine_chunks()
        found = list(search(names.to_pylist(), own.to_pylist(), first_half)) if len(names) and len(own) else []
        which, number = (pa.array(np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)])) for k in (0, 1))
        return pa.table([own.take(which), names.take(number), n.take(number)], names=["word", "other", "other_n"])

    dealt = _dealt_out(words, least_chars // 2, block)
    return dealt.groupBy("first_half", "part", "x", "y").applyInArrow(run, schema)


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of every word with a form; pointers are followed two at a time."""
    roots = materialized(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialized(
            roots.join(ahead, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            )
        )
        roots = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return roots


def spelling_variants(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT,
    times: int = TIMES,
    slip_every: int = SLIP_EVERY,
    block: int = BLOCK,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts.

    Words are the longest runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, of at least ``least_chars``
    code points and ``least_count`` occurrences in all texts.  Where a digest of id and run is a multiple of
    ``slip_every``, the run loses a letter before it is counted.  Two words are near at exactly one
    inserted, deleted or replaced code point; ``n_near`` counts them.  A word's form is its most
    frequent near word (of equally frequent ones the smallest in code-point order) if that is at least
    ``times`` as frequent, else null; its root is what its forms lead to, the word itself without one.
    ``times`` must be above 1, so that no chain comes back.

    A null text has no words; a null id is an empty one in the digest.  Rows that repeat a text or an id
    count each.  Words of any length are searched.  Other columns are ignored, an empty table, or one
    without words, gives an empty one.
    """
    if times <= 1 or least_chars < 1:
        raise ValueError("times must be above 1 and least_chars at least 1")
    words = materialized(vocabulary(docs, id_column, text_column, least_chars, least_count, slip_every))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other")))
    near = near_words(words, least_chars, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    best_n = -F.col("best.less")
    enough = best_n >= F.col("n") * times
    forms = materialized(
        words.join(near, "word", "left").select(
            "word", F.when(enough, F.col("best.other")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, best_n).alias("form_n"),
        )
    )
    return forms.join(_roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
