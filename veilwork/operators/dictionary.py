"""Replacements that depend on other texts: pseudonyms, digests by value, tokens.

All three number or digest distinct values on the side and join them back.  Every
text is scanned once and stored; only texts that need such a replacement take part in a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilwork.constants import HASH_LENGTH, TOKEN_PATTERN, TOKEN_PREFIX
from veilwork.functions.columns import compute_once, name, quoted
from veilwork.functions.masks import pseudonym, splice, token
from veilwork.functions.spans import match_offsets
from veilwork.functions.strategies import hash_strategy
from veilwork.operators.detect import DETECTION_FIELDS
from veilwork.operators.lookup import lookup, with_positions
from veilwork.plans.scan import mask, replacements
from veilwork.policy import Policy
from veilwork.session import materialized


def _first_place(values: DataFrame, key: Sequence[str]) -> Column:
    """Where a value appears first: smallest key, then rightmost in the text.

    For a single integer key both numbers fit into one decimal.  That keeps the
    aggregation a hash aggregation, which counts map-side without sorting; a
    struct would turn it into a sort of all occurrences.
    """
    integral = ("tinyint", "smallint", "int", "bigint")
    if len(key) == 1 and dict(values.dtypes)[key[0]] in integral:
        packed = f"cast({name(key[0])} as decimal(20,0)) * cast(4294967296 as decimal(10,0))"
        return F.min(F.expr(f"{packed} - start"))
    return F.min(F.struct(*[F.col(name(k)) for k in key], (-F.col("start")).alias("_right")))


def pseudonym_dictionary(
    values: DataFrame,
    key: Sequence[str] = ("doc_id",),
    known: DataFrame | None = None,
    largest: DataFrame | None = None,
) -> DataFrame:
    """One fake per distinct (entity_type, text), numbered per type from 1.

    Numbers follow the first appearance: by key, and right to left in a text.
    ``values`` has the key, ``entity_type``, ``start`` and ``text``.  With
    ``known``, an earlier dictionary, values it holds keep their number and new
    ones continue after the largest of their type; only new ones are returned.
    ``largest`` (entity_type, largest) says so where ``known`` is only a part of the dictionary.
    Column ``n`` says how many rows hold the value.
    """
    distinct = values.groupBy("entity_type", "text").agg(
        _first_place(values, key).alias("_first"), F.count(F.lit(1)).alias("n")
    )
    if known is not None:
        distinct = distinct.join(
            known.select("entity_type", "text"), ["entity_type", "text"], "left_anti"
        )
    placed = with_positions(distinct, ["entity_type", "_first", "text"])
    # one row per type from here on
    bases = placed.groupBy("entity_type").agg(F.min("position").alias("_base"))
    if known is not None and largest is None:
        largest = known.groupBy("entity_type").agg(F.max("idx").alias("largest"))
    if largest is not None:
        bases = bases.join(largest, "entity_type", "left").select(
            "entity_type",
            (F.col("_base") - F.coalesce("largest", F.lit(0))).alias("_base"),
        )
    return (
        placed.join(F.broadcast(bases), "entity_type")
        .withColumn("idx", F.col("position") - F.col("_base") + 1)
        .withColumn("fake", F.expr(pseudonym("entity_type", "text", "idx")))
        .select("entity_type", "text", "idx", "fake", "n")
    )


def _open_values(hits: DataFrame, key: Sequence[str], strategy: str) -> DataFrame:
    """The redactions of one strategy that still lack their replacement.

    ``_row`` tells the texts apart, whatever their keys; keys only give the order.
    """
    return hits.select(
        "_row", *[name(k) for k in key if k != "_row"], F.posexplode("redactions").alias("_i", "r")
    ).where(f"r.masked is null and r.strategy = {quoted(strategy)}").select(
        "_row",
        *[name(k) for k in key if k != "_row"],
        "_i",
        "r.entity_type",
        "r.start",
        "r.text",
    )


def _finish(waiting: DataFrame, rest: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """Put looked-up replacements (_row, _i, masked) back and splice all texts.

    A group here is the redactions of one text.
    """
    by_text = found.groupBy("_row").agg(
        F.map_from_entries(F.collect_list(F.struct("_i", "masked"))).alias("_filled")
    )
    fields = ", ".join(f"'{f}', r.{f}" for f in (*DETECTION_FIELDS, "strategy"))
    redactions = f"""transform(redactions, (r, i) -> named_struct({fields},
        'masked', coalesce(r.masked, try_element_at(_filled, i))))"""
    filled = compute_once(waiting.join(by_text, "_row", "left"), redactions=redactions)
    columns = list(map(name, rest.columns))
    both = filled.select(*columns).unionByName(rest.select(*columns))
    return both.withColumn("masked_text", F.expr(splice(name(text), "redactions")))


def _split_open(scanned: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """(texts that wait for a lookup, with a row number; the others), from shared storage.

    All texts are stored once they are scanned: scanning them a second time for those that wait
    for nothing takes many times what writing and reading them takes.
    """
    ready = replacements(scanned, policy).withColumn("_open", F.expr("exists(redactions, r -> r.masked is null)"))
    numbered = "_row" in ready.columns
    if not numbered:
        ready = ready.withColumn("_row", F.monotonically_increasing_id())
    columns = [name(c) for c in ready.columns if c != "_open"]
    found = scanned.schema["detections"].dataType.elementType.names
    if set(found) == set(DETECTION_FIELDS):
        # they stand in the redactions as well, which are one for one
        fields = ", ".join(f"'{f}', r.{f}" for f in found)
        kept = materialized(ready.drop("detections")).withColumn(
            "detections", F.expr(f"transform(redactions, r -> named_struct({fields}))")
        )
    else:
        kept = materialized(ready)
    waiting, rest = kept.where("_open").select(*columns), kept.where("not coalesce(_open, false)").select(*columns)
    return waiting, rest if numbered else rest.drop("_row")


def mask_with_tables(
    scanned: DataFrame,
    policy: Policy,
    key: Sequence[str] = ("doc_id",),
    text: str = "text",
    dictionary: Callable[[DataFrame], DataFrame] | None = None,
    keyring: DataFrame | None = None,
    key_id: int = 1,
    first: int = 1,
) -> tuple[DataFrame, DataFrame | None]:
    """Mask with every strategy of the policy, alone or mixed: (masked table, token table).

    Consistent fakes for ``pseudo``, digests for SHA3, and tokens that can be undone where
    the policy is reversible and there is a keyring; without one the default strategy is used
    and there is no token table.  ``dictionary`` maps the values at hand to a dictionary
    table that covers them; when it is missing a new dictionary is made.
    """
    if keyring is None:
        policy = policy.without_tokens()
    if not policy.needs_tables():
        return mask(scanned, policy, text), None
    waiting, rest = _split_open(scanned, policy)
    on, parts, tokens = ["entity_type", "text"], [], None
    answer = ["_row", "_i", "masked"]
    if policy.uses("pseudo"):
        values = materialized(_open_values(waiting, key, "pseudo"))
        if dictionary is None:
            fakes = materialized(pseudonym_dictionary(values, key))
            found = lookup(values, fakes.select(*on, F.col("fake").alias("masked"), "n"), on, "n")
        else:
            fakes = dictionary(values).select(*on, F.col("fake").alias("masked"))
            found = lookup(values, fakes, on)
        parts.append(found.select(*answer))
    for strategy in {s.name: s for s in policy.strategies_in_use() if s.sha3}.values():
        values = materialized(_open_values(waiting, key, strategy.name))
        digests = materialized(sha3_dictionary(values, *strategy.sha3))
        found = lookup(values, digests.withColumnRenamed("fake", "masked"), on, "n")
        parts.append(found.select(*answer))
    if policy.uses("reversible"):
        # sorting reads its rows twice, to find the ranges and to deal them out
        values = materialized(_open_values(waiting, key, "reversible"))
        numbered = number_tokens(values, [*key, "_row"], first)
        parts.append(numbered.select("_row", "_i", F.col("token").alias("masked")))
        tokens = encrypt_tokens(numbered, keyring, key_id)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return _finish(waiting, rest, found, text), tokens


def mask_with_pseudonyms(
    scanned: DataFrame,
    policy: Policy,
    key: Sequence[str] = ("doc_id",),
    text: str = "text",
    dictionary: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Mask, with consistent fakes for the types whose strategy is ``pseudo``."""
    return mask_with_tables(scanned, policy, key, text, dictionary)[0]


@F.pandas_udf(StringType())
def _sha3(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in values:
        yield batch.map(lambda v: hashlib.sha3_256(v.encode("utf-8")).hexdigest())


def sha3_dictionary(values: DataFrame, length: int = HASH_LENGTH, salt: str = "") -> DataFrame:
    """SHA3-256 replacement per distinct value: the one digest Spark SQL lacks."""
    distinct = values.groupBy("entity_type", "text").agg(F.count(F.lit(1)).alias("n"))
    return distinct.withColumn(
        "fake",
        F.concat(F.lit("SHA3_256:"), F.left(_sha3(F.concat(F.lit(salt), "text")), F.lit(length))),
    )


def mask_with_sha3(
    scanned: DataFrame,
    key: Sequence[str] = ("doc_id",),
    text: str = "text",
    length: int = HASH_LENGTH,
    salt: str = "",
) -> DataFrame:
    """Mask every detection with its SHA3-256 digest."""
    policy = Policy(
        default_strategy="hash", strategies=(hash_strategy("sha3_256", length, salt),)
    )
    return mask_with_tables(scanned, policy, key, text)[0]


def number_tokens(values: DataFrame, key: Sequence[str], first: int = 1) -> DataFrame:
    """A token per occurrence, numbered by key and right to left within a text."""
    order = [*[F.col(k) for k in key], F.col("start").desc()]
    return (
        with_positions(values, order, "_position")
        .withColumn("number", F.col("_position") + first)
        .withColumn("token", F.expr(token("entity_type", "number")))
        .drop("_position")
    )


# Keys that may be sent to all tasks.
MOST_KEYS = 100_000


def _one_key_each(keyring: DataFrame) -> DataFrame:
    """A keyring small enough to be sent out; two keys under one id would be a matter of chance."""
    counts = keyring.groupBy("key_id").count().agg(F.max("count").alias("most"), F.count(F.lit(1)).alias("n")).first()
    if (counts.most or 0) > 1:
        raise ValueError("a key_id has several keys")
    if counts.n > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys")
    return keyring.select("key_id", "key")


def encrypt_tokens(numbered: DataFrame, keyring: DataFrame, key_id: int) -> DataFrame:
    """The token table: token, entity_type, key_id and AES-GCM ciphertext.

    The key comes from a keyring table (key_id, key), so it is not part of any
    plan.  The nonce is a digest of key, token and text: recomputing a lost
    partition gives the same bytes, and no two different texts share a nonce.
    """
    ring = F.broadcast(_one_key_each(keyring.where(F.col("key_id") == key_id)))
    nonce = "unhex(left(sha2(concat(key, encode(concat(token, text), 'UTF-8')), 256), 24))"
    cipher = f"aes_encrypt(encode(text, 'UTF-8'), key, 'GCM', 'DEFAULT', {nonce})"
    return (
        numbered.withColumn("key_id", F.lit(key_id))
        .join(ring, "key_id")
        .select("token", "entity_type", "key_id", F.expr(cipher).alias("ciphertext"))
    )


def mask_with_tokens(
    scanned: DataFrame,
    policy: Policy,
    keyring: DataFrame | None = None,
    key_id: int = 1,
    key: Sequence[str] = ("doc_id",),
    text: str = "text",
    first: int = 1,
) -> tuple[DataFrame, DataFrame | None]:
    """Mask with tokens that can be undone: (masked table, token table).

    Types with a rule keep their own strategy.  Without a keyring the default
    strategy is used and there is no token table.
    """
    return mask_with_tables(
        scanned,
        replace(policy, use_reversible=True),
        key,
        text,
        keyring=keyring,
        key_id=key_id,
        first=first,
    )


def restore_tokens(
    requested: DataFrame, tokens: DataFrame, keyring: DataFrame
) -> DataFrame:
    """Add ``original`` to a table with a ``token`` column.

    Unknown tokens, missing keys and wrong keys give null.
    """
    ring = F.broadcast(_one_key_each(keyring))
    return (
        lookup(requested, tokens.select("token", "key_id", "ciphertext"), ["token"])
        .join(ring, "key_id", "left")
        .withColumn(
            "original",
            F.expr("cast(try_aes_decrypt(ciphertext, key, 'GCM', 'DEFAULT') as string)"),
        )
        .select(*map(name, requested.columns), "original")
    )


def restore_text(
    df: DataFrame,
    tokens: DataFrame,
    keyring: DataFrame,
    text: str = "text",
    restored: str = "restored_text",
) -> DataFrame:
    """Replace every token that can be resolved; everything else stays."""
    t = name(text)
    spans = match_offsets(t, TOKEN_PATTERN)
    guarded = f"if(contains({t}, {quoted(TOKEN_PREFIX)}), {spans}, null)"
    marked = compute_once(df, _spans=guarded)
    waiting = materialized(
        marked.where("size(_spans) > 0").withColumn("_row", F.monotonically_increasing_id())
    )
    rest = marked.where("not coalesce(size(_spans) > 0, false)")
    asked = waiting.select("_row", F.posexplode("_spans").alias("_i", "s")).select(
        "_row", "_i", F.col("s.text").alias("token")
    )
    answers = (
        restore_tokens(asked, tokens, keyring)
        .where("length(original) > 0")
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("_i", "original"))).alias("_originals"))
    )
    filled = waiting.join(answers, "_row", "left").withColumn(
        "_spans",
        F.expr(
            """transform(_spans, (s, i) -> named_struct('start', s.start, 'end', s.end,
                'masked', try_element_at(_originals, i)))"""
        ),
    )
    done = filled.withColumn(restored, F.expr(splice(t, "_spans", restoring=True)))
    return done.select(*map(name, df.columns), restored).unionByName(
        rest.withColumn(restored, F.col(t)).select(*map(name, df.columns), restored)
    )


def merge_tokens(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two token tables as one; where both know a token, the new row holds."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    fields = [c for c in old.columns if c != "token"]
    return (
        both.groupBy("token")
        .agg(F.max_by(F.struct(*fields), "_age").alias("_row"))
        .select("token", *[F.col(f"_row.{c}").alias(c) for c in fields])
    )
