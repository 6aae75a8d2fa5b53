"""JSON messages with text inside, one message per line.

A message is a candidate when it is an object whose ``result.content`` is a
list and whose source is scanned.  Everything else passes through untouched.
Masking and rebuilding happen inside the row, without a shuffle.

Lines up to a length are read as variants, in SQL alone.  A longer one could exceed what a
variant may hold, so its texts are found in the bytes by a Python helper and the masked ones put back
there; detection and masking between are the same.  The long lines are a branch of their own:
the others never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from veilwork.constants import DEFAULT_SOURCE
from veilwork.functions.columns import compute_once, name
from veilwork.functions.json_splice import find_blocks, with_texts
from veilwork.functions.masks import splice
from veilwork.operators.dictionary import mask_with_tables
from veilwork.plans.scan import find, redactions_of, scan, stages
from veilwork.policy import Policy
from veilwork.session import materialized

# Bytes of a line that is surely a variant of less than 16 MB: a value of two bytes of JSON, with
# its comma, takes six in one.
LONGEST_LINE = 4_000_000
# In an object with repeated keys the last one counts.
REPEATED_KEYS_SETTING = "spark.sql.variant.allowDuplicateKeys"

_PLACES = {"text": "$.text", "resource": "$.resource.text"}


def _parse_if_named(raw: str, key: str) -> str:
    """Parse only lines that can hold the key, plain or written with escapes."""
    possible = rf"contains({raw}, '{key}') or contains({raw}, '\\u')"
    return f"if({possible}, try_parse_json({raw}), null)"


def _parsed(df: DataFrame, line: str) -> DataFrame:
    """Add ``_message`` (null unless the line can hold a result) and ``_content``."""
    df.sparkSession.conf.set(REPEATED_KEYS_SETTING, "true")
    parsed = compute_once(df, _message=_parse_if_named(name(line), "result"))
    content = "try_variant_get(_message, '$.result.content', 'array<variant>')"
    return compute_once(parsed, _content=content)


def _tool_name() -> str:
    return (
        f"coalesce(try_variant_get(_message, '$.result._meta.tool_name', 'string'),"
        f" '{DEFAULT_SOURCE}')"
    )


def _block_text(block: str) -> str:
    """The text of a block, null when there is none to scan."""
    cases = " ".join(
        f"""when '{kind}' then if(
            schema_of_variant(try_variant_get({block}, '{path}', 'variant')) = 'STRING',
            nullif(try_variant_get({block}, '{path}', 'string'), ''), null)"""
        for kind, path in _PLACES.items()
    )
    return f"case try_variant_get({block}, '$.type', 'string') {cases} else null end"


_LOCATED = StructType([
    StructField("tool", StringType()),
    StructField("kinds", ArrayType(StringType())),
    StructField("texts", ArrayType(StringType())),
    StructField("starts", ArrayType(LongType())),
    StructField("ends", ArrayType(LongType())),
    StructField("dead", ArrayType(StructType([StructField("s", LongType()), StructField("e", LongType())]))),
])


@F.arrow_udf(_LOCATED)
def _locate(lines: pa.Array) -> pa.Array:
    found = (find_blocks(line.as_buffer().to_pybytes()) for line in lines.cast(pa.binary()))
    blocks = [
        None if b is None else vars(b) | {"texts": [t and _utf8(t) for t in b.texts], "dead": [{"s": s, "e": e} for s, e in b.dead]}
        for b in found
    ]
    places, words = pa.list_(pa.int64()), pa.list_(pa.string())
    dead = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    return pa.array(
        blocks,
        pa.struct([("tool", pa.string()), ("kinds", words), ("texts", words), ("starts", places), ("ends", places), ("dead", dead)]),
    )


def _utf8(text: str) -> str:
    """Halves of surrogate pairs, which JSON can write and a string cannot hold, as question marks."""
    return text.encode("utf-8", "replace").decode()


@F.arrow_udf(StringType())
def _respliced(lines: pa.Array, located: pa.Array, masked: pa.Array) -> pa.Array:
    out = []
    for line, at, texts in zip(lines.cast(pa.binary()), located, masked):
        at, texts = at.as_py(), texts.as_py()
        if at is None or texts is None:
            out.append(None)
            continue
        dead = [(d["s"], d["e"]) for d in at["dead"]]
        out.append(with_texts(line.as_buffer().to_pybytes(), at["starts"], at["ends"], texts, dead).decode())
    return pa.array(out, pa.string())


def _branches(df: DataFrame, line: str, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lines that are read as variants, longer ones); null lines are among the first."""
    long = f"coalesce(octet_length({name(line)}) > {int(longest)}, false)"
    return df.where(f"not {long}"), df.where(long)


def _located(df: DataFrame, line: str) -> DataFrame:
    """Add ``_located``: null where a long line has no list of content."""
    return compute_once(df, _located=_locate(F.col(name(line))))


_LONG_TOOL = f"coalesce(_located.tool, '{DEFAULT_SOURCE}')"


def classify_messages(
    df: DataFrame, policy: Policy = Policy(), line: str = "line", longest: int = LONGEST_LINE
) -> DataFrame:
    """Add ``message_class`` (candidate or passthrough) and ``tool_name``.

    ``tool_name`` is null where a line has no list of content.  Lines of more than
    ``longest`` bytes are read by the token.
    """
    short, long = _branches(df, line, longest)
    parts = []
    for part, content, tool in (
        (_parsed(short, line), "_content", _tool_name()),
        (_located(long, line), "_located", _LONG_TOOL),
    ):
        named = part.withColumn("tool_name", F.expr(f"if({content} is null, null, {tool})"))
        is_candidate = f"if({content} is not null and {policy.scans('tool_name')}, 'candidate', 'passthrough')"
        parts.append(
            named.withColumn("message_class", F.expr(is_candidate)).select(
                *map(name, [c for c in df.columns if c not in ("tool_name", "message_class")]), "tool_name", "message_class"
            )
        )
    return parts[0].unionByName(parts[1])


def explode_blocks(
    df: DataFrame, key: Sequence[str] = ("msg_id",), line: str = "line", longest: int = LONGEST_LINE
) -> DataFrame:
    """One row per content block with text: position, type, source and text."""
    short, long = _branches(df, line, longest)
    of_short = (
        _parsed(short, line)
        .where("_content is not null")
        .select(*map(name, key), F.expr(_tool_name()).alias("source"), F.posexplode("_content").alias("block", "_b"))
        .select(
            *map(name, key),
            "block",
            "source",
            F.expr("try_variant_get(_b, '$.type', 'string')").alias("block_type"),
            F.expr(_block_text("_b")).alias("text"),
        )
    )
    of_long = (
        _located(long, line)
        .where("_located is not null")
        .select(
            *map(name, key),
            F.expr(_LONG_TOOL).alias("source"),
            F.posexplode(F.arrays_zip("_located.kinds", "_located.texts")).alias("block", "_b"),
        )
        .select(*map(name, key), "block", "source", F.col("_b.kinds").alias("block_type"), F.col("_b.texts").alias("text"))
    )
    return of_short.unionByName(of_long).where("text is not null")


def _with_detections(out: DataFrame, policy: Policy) -> DataFrame:
    """Add ``block_detections`` to rows with ``block_texts``, both by position in the content."""
    found = find(policy, "block_text")
    out = compute_once(out, block_detections=f"transform(block_texts, block_text -> {found})")
    for stage in stages(policy):
        each = stage("block_text", "block_found")
        out = compute_once(
            out,
            block_detections=f"""zip_with(block_texts, block_detections,
                (block_text, block_found) -> {each})""",
        )
    return out


def _with_sources(df: DataFrame, policy: Policy, line: str, long: bool) -> DataFrame:
    """Add ``source`` and ``scanned``, and what rebuilding a line of this branch needs."""
    out, content, tool = (
        (_located(df, line), "_located", _LONG_TOOL) if long else (_parsed(df, line), "_content", _tool_name())
    )
    return out.withColumn("source", F.expr(tool)).withColumn(
        "scanned", F.expr(f"{content} is not null and {policy.scans('source')}")
    )


def _with_texts(out: DataFrame, long: bool) -> DataFrame:
    """Add ``block_texts``, null where there is nothing to scan."""
    texts = "_located.texts" if long else f"transform(_content, b -> {_block_text('b')})"
    return compute_once(out, block_texts=f"if(scanned, {texts}, null)")


def scan_messages(
    df: DataFrame, policy: Policy = Policy(), line: str = "line", longest: int = LONGEST_LINE
) -> DataFrame:
    """Add the source, the block texts and the final detections of each block.

    Columns: ``source``, ``scanned``, ``block_texts`` (null where there is nothing
    to scan) and ``block_detections``, both by position in the content.
    """
    added = ("source", "scanned", "block_texts", "block_detections")
    kept = [c for c in df.columns if c not in added]
    short, long = (
        _with_detections(_with_texts(_with_sources(part, policy, line, is_long), is_long), policy).select(*map(name, kept), *added)
        for is_long, part in enumerate(_branches(df, line, longest))
    )
    return short.unionByName(long)


def _rebuilt(masked: str) -> str:
    """The message with the masked texts in place, as JSON text.

    ``masked`` is an array of texts by position, null where a block stays.
    """
    new = f"element_at({masked}, i + 1)"
    fields = "cast(b as map<string, variant>)"
    inner = "cast(v as map<string, variant>)"
    resource = f"""to_variant_object(transform_values({inner},
        (k2, v2) -> if(k2 = 'text', cast({new} as variant), v2)))"""
    kind = "try_variant_get(b, '$.type', 'string')"
    block = f"""if({new} is null, b, to_variant_object(transform_values({fields}, (k, v) -> case
        when k = 'text' and {kind} = 'text' then cast({new} as variant)
        when k = 'resource' and {kind} = 'resource' then {resource}
        else v end)))"""
    content = f"to_variant_object(transform(_content, (b, i) -> {block}))"
    result = f"""to_variant_object(transform_values({inner},
        (k1, v1) -> if(k1 = 'content', {content}, v1)))"""
    return f"""to_json(to_variant_object(transform_values(
        cast(_message as map<string, variant>), (k, v) -> if(k = 'result', {result}, v))))"""


_HAS_HITS = "exists(block_detections, d -> size(d) > 0)"


def mask_messages(
    df: DataFrame,
    policy: Policy = Policy(),
    key: Sequence[str] = ("msg_id",),
    line: str = "line",
    longest: int = LONGEST_LINE,
) -> DataFrame:
    """Add ``masked_line``, ``source``, ``scanned``, ``modified``, ``blocks_with_pii``
    and ``block_masked`` (replaced texts by position).

    A line in which nothing is found stays as it is, byte for byte; a changed one
    is equal as JSON in everything but the masked texts.  A changed line of more than ``longest``
    bytes keeps all other bytes; of repeated keys only the last value counts, the others become null.
    """
    return mask_messages_reversibly(df, policy, None, 1, key, line, longest=longest)[0]


def mask_messages_reversibly(
    df: DataFrame,
    policy: Policy,
    keyring: DataFrame | None,
    key_id: int = 1,
    key: Sequence[str] = ("msg_id",),
    line: str = "line",
    dictionary: Callable[[DataFrame], DataFrame] | None = None,
    first: int = 1,
    longest: int = LONGEST_LINE,
) -> tuple[DataFrame, DataFrame | None]:
    """``mask_messages`` with all strategies: (masked messages, token table or None)."""
    if keyring is None:
        policy = policy.without_tokens()
    if policy.needs_tables():
        return _mask_with_tables(df, policy, key, line, keyring, key_id, dictionary, first, longest)
    masked = splice("block_text", redactions_of(policy, "block_found"))
    replaced = f"""zip_with(block_texts, block_detections,
        (block_text, block_found) -> if(size(block_found) > 0, {masked}, null))"""
    short, long = (
        _put_back(
            compute_once(
                _with_detections(_with_texts(_with_sources(part, policy, line, is_long), is_long), policy),
                block_masked=replaced,
            ),
            df, line, is_long,
        )
        for is_long, part in enumerate(_branches(df, line, longest))
    )
    return short.unionByName(long), None


def _put_back(out: DataFrame, df: DataFrame, line: str, long: bool) -> DataFrame:
    hits = "coalesce(exists(block_masked, m -> m is not null), false)"
    if long:
        out = out.withColumn(
            "_new_line", _respliced(F.expr(f"if({hits}, {name(line)}, null)"), F.expr(f"if({hits}, _located, null)"), F.col("block_masked"))
        )
    new = "_new_line" if long else _rebuilt("block_masked")
    return out.select(
        *map(name, df.columns),
        "source",
        "scanned",
        F.expr(hits).alias("modified"),
        F.expr("coalesce(size(filter(block_masked, m -> m is not null)), 0)").alias(
            "blocks_with_pii"
        ),
        "block_masked",
        # a changed message that cannot be written is held back, never passed on as it is
        F.expr(f"if({hits}, {new}, {name(line)})").alias("masked_line"),
    )


def _mask_with_tables(
    df: DataFrame,
    policy: Policy,
    key: Sequence[str],
    line: str,
    keyring: DataFrame | None,
    key_id: int,
    dictionary: Callable[[DataFrame], DataFrame] | None,
    first: int,
    longest: int,
) -> tuple[DataFrame, DataFrame | None]:
    """Block texts go through the dictionaries as a table of their own.

    Messages are stored with a row number, so that null and repeated keys do no harm; keys
    only give the order.  Only messages with detections meet again; a group is one message.
    """
    numbered = materialized(df.withColumn("_message_row", F.monotonically_increasing_id()))
    block_key = [*key, "_message_row", "block"]
    blocks = explode_blocks(numbered, block_key[:-1], line, longest)
    masked, tokens = mask_with_tables(
        scan(blocks, policy, block_key), policy, block_key, "text", dictionary, keyring, key_id, first
    )
    by_message = materialized(
        masked.where("size(detections) > 0")
        .groupBy("_message_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("block", "masked_text"))).alias("_new"))
    )
    parts = []
    for is_long, part in enumerate(_branches(numbered, line, longest)):
        out = _with_sources(part, policy, line, is_long).join(by_message, "_message_row", "left")
        content = "_located.texts" if is_long else "_content"
        replaced = f"if(_new is null, null, transform({content}, (b, i) -> try_element_at(_new, i)))"
        parts.append(_put_back(compute_once(out, block_masked=replaced), df, line, is_long))
    return parts[0].unionByName(parts[1]), tokens


def message_stats(masked: DataFrame) -> DataFrame:
    """Totals over masked messages: one row."""
    return masked.agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.coalesce(F.sum("blocks_with_pii"), F.lit(0)).alias("scanned"),
        F.count_if(~F.col("modified")).alias("passthrough"),
        F.lit(0).cast("bigint").alias("errors"),
    )


def request_methods(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``method``: the method of a request line, null where there is none."""
    df.sparkSession.conf.set(REPEATED_KEYS_SETTING, "true")
    parsed = _parse_if_named(name(line), "method")
    return df.withColumn("method", F.expr(f"try_variant_get({parsed}, '$.method', 'string')"))
