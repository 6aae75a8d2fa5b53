"""Document fingerprints from spot signatures.

A spot is a common word (an anchor) with the content words that come after it: the chain
of the next ``CHAIN`` words that are no anchors.  The set of a text's spots is its
fingerprint.  Only SQL functions are used, one pass of a regular expression per text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.base import whole_text
from veilwork.operators.lookup import with_positions
from veilwork.session import materialized

# Words that stand everywhere in English, German, French and Spanish prose.
ANCHORS = (
    "the", "of", "and", "a", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "at", "be",
    "this", "from", "by", "der", "die", "das", "und", "ist", "zu", "den", "von", "mit", "ein", "eine", "nicht", "im",
    "dem", "le", "la", "les", "et", "un", "une", "des", "est", "que", "dans", "el", "los", "las", "en", "y", "por",
    "con", "del", "para", "de",
)
CHAIN = 2
# Ratio of the bounds of neighbouring length partitions.
LENGTH_STEP = 1.25


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spots(text: Column, anchors: Sequence[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct 32-bit hashes of a text's spots (array of int).

    Words are runs of letters and digits in lower case.  A spot starts at an anchor that
    a content word follows at once; anchors within the chain are passed over.  A text without
    any spot has its distinct words instead, one without words the empty array.
    """
    common = "(?:" + "|".join(anchors) + ")"
    content = f"(?!{common} )[^ ]+"
    skip = f"(?:{common} )*+"
    words_alone = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    # the match is the anchor alone, so that chains may overlap
    pattern = f"(?<= )(?=({common} {content}{(' ' + skip + content) * (chain - 1)}) ){common}"
    between = f" {common}(?= )"

    def chain_hash(s: Column) -> Column:
        first = F.substring_index(s, " ", 1)
        return F.hash(F.concat(first, F.regexp_replace(F.substr(s, F.length(first) + 1), between, "")))

    def of_plain(plain: Column) -> Column:
        words = F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.hash(w))
        raw = F.regexp_extract_all(plain, F.lit(pattern), F.lit(1))
        return _once(raw, lambda raw: F.when(F.size(raw) > 0, F.transform(raw, chain_hash)).otherwise(words))

    return F.array_sort(F.array_distinct(_once(words_alone, of_plain)))


def fingerprint(found: Column) -> Column:
    """The set as text: eight hexadecimal digits for each spot."""
    return F.array_join(F.transform(found, lambda h: F.lpad(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def length_partition(found: Column) -> Column:
    """Sets of equal length are in one partition, and so are those little longer."""
    return F.floor(F.log(F.greatest(F.size(found), F.lit(1)).cast("double")) / F.log(F.lit(LENGTH_STEP)))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; two empty ones are alike.

    Two sets whose lengths alone keep them below ``least`` are not intersected and get 0:
    neither those of length partitions too far apart, nor others too different in length.
    """
    apart = F.abs(length_partition(a) - length_partition(b))
    small = F.least(F.size(a), F.size(b)).cast("double")
    large = F.greatest(F.size(a), F.size(b)).cast("double")
    common = F.size(F.array_intersect(a, b)).cast("double")
    pruned = (F.pow(F.lit(LENGTH_STEP), F.lit(1.0) - apart) < least) | (small < large * least) | (small == 0)
    return (
        F.when(large == 0, F.lit(1.0)).when(pruned, F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))
    )


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited form, and how alike they are.

    The edited text: the last floor(n / 4) code points replaced by as many from the start
    of the next document's text (or all of it), in order of ids, the first one after the last.
    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, length_partition.

    A null text counts as empty, a null id comes last, rows that repeat an id are in order
    of their texts' hashes and each counts.  A single row is its own next.  An empty table
    gives an empty one.

    Ids and lengths are sorted; texts are not: they are dealt out by row once, with their
    spots, and of each only the start its predecessor needs goes on to it.
    """
    text = whole_text(text_column)
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), text.alias("text")).select(
        F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"),
        # its lowest bit: is the id null?
        F.expr("(xxhash64(text) & -2L) | cast(id is null as bigint)").alias("key"),
        "text",
    )
    unnamed = (F.col("key").bitwiseAND(F.lit(1)) == 1).alias("unnamed")
    slim = rows.select("id", unnamed, "key", F.length("text").alias("n"))
    placed = with_positions(slim, ["unnamed", "id", "key"], "position")
    total = F.lit(max(placed.count(), 1))
    following = placed.select(
        ((F.col("position") + total - 1) % total).alias("position"),
        F.col("id").alias("next_id"),
        F.col("key").alias("next_key"),
    )
    order = materialized(placed.join(following, "position"))

    # equal rows are one here; both uses need the same columns, so that they read the same
    # shuffled texts, whose spots are found before
    spotted = rows.withColumn("spots", spots(F.col("text")))
    known = spotted.groupBy("id", "key").agg(F.first("text").alias("text"), F.first("spots").alias("spots"))
    heads = (
        order.select(
            F.col("id").alias("of_id"), F.col("key").alias("of_key"), "position", F.floor(F.col("n") / 4).cast("int").alias("need"),
            F.col("next_id").alias("id"), F.col("next_key").alias("key"),
        )
        .join(known, ["id", "key"])
        .select("of_id", "of_key", "position", "need", F.expr("substring(text, 1, need)").alias("head"), "spots")
        .groupBy(F.col("of_id").alias("id"), F.col("of_key").alias("key"))
        .agg(F.collect_list(F.struct("position", "need", "head", "spots")).alias("next"))
    )
    met = known.join(heads, ["id", "key"]).select(
        "id", unnamed, "text", "spots", F.explode("next").alias("next")
    )
    edited = F.concat(F.expr("substring(text, 1, length(text) - next.need)"), F.col("next.head"))
    full = met.select(
        "id", "unnamed", F.length("text").cast("bigint").alias("n_chars"), "spots", edited.alias("edited"), F.col("next.spots").alias("next_spots")
    ).withColumn("edited_spots", spots(F.col("edited")))
    return full.select(
        F.when(~F.col("unnamed"), F.col("id")).alias(id_column),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
        length_partition(F.col("spots")).alias("length_partition"),
    )
