"""Input tables of the registered queries, for Spark and for the checking SQL.

The given tables hold few of the types, so texts for all of them are derived
from every row of ``orders`` (one text each) and every turn of ``conversations``
(one message line each).  A recipe is plain SQL that both engines read alike; ``S``
stands for the name of the string type and ``J(x)`` for a JSON string.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.session import spread
from veilwork.sources.texts import as_texts, read_texts

ORDER_BASE = 1_000_000_000

_K = "CAST(o_orderkey AS S)"
_MD5 = f"md5({_K})"


def _num(modulus: int, width: int, offset: int = 0, key: str = "o_orderkey") -> str:
    return f"lpad(CAST({key} % {modulus} + {offset} AS S), {width}, '0')"


def _cat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


_PHONE = _cat("'555-'", _num(900, 3, 100), "'-'", _num(10000, 4))
_EMAIL = _cat("'user'", _K, "'@corp'", "CAST(o_orderkey % 25 AS S)", "'.example.com'")
_SSN = _cat(
    f"CASE WHEN o_orderkey % 17 = 0 THEN '000' ELSE {_num(500, 3, 100)} END",
    "'-'", _num(89, 2, 10), "'-'", _num(8999, 4, 1000),
)
_CARD = (
    "CASE o_orderkey % 4 WHEN 0 THEN '4111-1111-1111-1111' WHEN 1 THEN '5500 0000 0000 0004'"
    " WHEN 2 THEN '4111-1111-1111-1112' ELSE '6011000990139424' END"
)
_DIGITS20 = _cat(_num(100000, 10), _num(99991, 10))
_IP = _cat(
    "CAST(o_orderkey % 256 AS S)", "'.'", "CAST(o_orderkey % 200 AS S)", "'.0.'",
    "CAST(o_orderkey % 100 AS S)",
)
_IPV6 = _cat(*[x for i in range(8) for x in (f"substr({_MD5}, {4 * i + 1}, 4)", "':'")][:-1])
_MAC = _cat(*[x for i in range(6) for x in (f"substr({_MD5}, {2 * i + 1}, 2)", "':'")][:-1])
_DAY = _cat("'-'", _num(12, 2, 1), "'-'", _num(28, 2, 1))

# One text per order, by o_orderkey % 26.
RECIPES = [
    _cat("'Email: '", _EMAIL, "' thanks'"),
    _cat("'reach '", _EMAIL, "', or call '", _PHONE),
    _cat("'SSN: '", _SSN),
    _cat("'Card: '", _CARD),
    _cat("'iban DE'", _DIGITS20),
    _cat("'transfer to DE'", f"substr({_DIGITS20}, 1, 18)", "' today'"),
    _cat("'from '", _IP, "' on the server'"),
    _cat("'via '", _IPV6, "' now'"),
    _cat("'link fe80::'", _K, "' up'"),
    _cat("'adapter '", _MAC),
    _cat("'aws AKIA'", f"upper(substr({_MD5}, 1, 16))"),
    _cat("'export KEY=sk-'", _MD5),
    _cat("'use sk_live_'", f"substr({_MD5}, 1, 24)", "' for payment'"),
    _cat("'github: ghp_'", _MD5, f"substr({_MD5}, 1, 4)"),
    _cat("'passport A'", _num(100000000, 8), "' issued'"),
    _cat("'Born: 19'", _num(100, 2), _DAY),
    _cat("'created 20'", _num(30, 2), _DAY, "' by the system'"),
    _cat("'file mrn: '", _num(100000, 6), "' closed'"),
    _cat("'license D'", _num(1000, 3), "'-'", _num(10000, 4), "'-'", _num(9999, 4)),
    _cat("'see https://u'", _K, "':p'", _K, "'@h'", "CAST(o_orderkey % 9 AS S)", "'.example/x'"),
    _cat(
        "'bearer eyJ'", f"substr({_MD5}, 1, 20)", "'.'", _MD5, "'.'", f"substr({_MD5}, 9, 16)"
    ),
    _cat("'fax '", "repeat('.', CAST(60 + o_orderkey % 40 AS INT))", "' '", _PHONE),
    _cat(
        "'To '", _EMAIL, "' from '", _EMAIL, "': card '", _CARD, "', ssn '", _SSN, "', ip='",
        _IP, "', tel '", _PHONE, "' and '", _PHONE,
    ),
    _cat("'Version '", _PHONE, "' released'"),
    _cat("'4111 1111 1111 1112 and 555'", _num(9999999, 7), "' or '", _CARD),
    _cat("'order '", _K, "' for customer '", "CAST(o_custkey AS S)", "' was shipped'"),
]

_ORDER_TEXT = (
    "CASE o_orderkey % "
    + str(len(RECIPES))
    + " "
    + " ".join(f"WHEN {i} THEN {r}" for i, r in enumerate(RECIPES))
    + " END"
)
_ORDER_SOURCE = "concat('src', CAST(o_orderkey % 5 AS S))"

# One line per turn, by (conv_id + turn) % 10; five in ten carry content.
_MSG_ID = "conv_id * 1000 + turn"
_C = "CAST(conv_id * 1000 + turn AS S)"
BLOCK_TEXT = _cat("text", "' mail user'", _C, "'@corp.example.com, tel 555-123-'",
                  _num(10000, 4, key="conv_id"))
RESOURCE_TEXT = (
    "CASE WHEN turn % 2 = 0 THEN 'nothing to hide' ELSE "
    + _cat("'SSN: 123-45-'", _num(9000, 4, 1000, key="conv_id"))
    + " END"
)
_FULL = _cat(
    "'{\"jsonrpc\": \"2.0\", \"id\": '", _C, "', \"result\": {\"content\": [{\"type\": \"text\", \"text\": '",
    f"J({BLOCK_TEXT})", "'}, {\"type\": \"resource\", \"resource\": {\"uri\": \"f\", \"text\": '",
    f"J({RESOURCE_TEXT})",
    "'}}, \"plain\", {\"type\": \"image\", \"data\": \"a@b.example.com\"}],"
    " \"_meta\": {\"tool_name\": '", "J(role)", "'}}}'",
)
_LINE_CASES = {
    5: _cat("'not json result '", _C),
    6: _cat("'{\"id\": '", _C, "', \"method\": \"tools/call\"}'"),
    7: _cat("'{\"id\": '", _C, "', \"result\": null}'"),
    8: _cat("'{\"id\": '", _C, "', \"result\": {\"content\": \"mail a@b.example.com\"}}'"),
    9: "'[\"result\", \"a@b.example.com\"]'",
}
_LINE = (
    "CASE (conv_id + turn) % 10 "
    + " ".join(f"WHEN {i} THEN {r}" for i, r in _LINE_CASES.items())
    + f" ELSE {_FULL} END"
)


def _for_spark(recipe: str) -> str:
    recipe = _json_calls(recipe, "to_json(cast({} as variant))")
    return re.sub(r"AS S\)", "AS STRING)", recipe)


def _for_duckdb(recipe: str) -> str:
    recipe = _json_calls(recipe, "CAST(to_json({}) AS VARCHAR)")
    return re.sub(r"AS S\)", "AS VARCHAR)", recipe)


def _json_calls(recipe: str, form: str) -> str:
    for inner in (BLOCK_TEXT, RESOURCE_TEXT, "role"):
        recipe = recipe.replace(f"J({inner})", form.format(inner))
    return recipe


# --- Spark ---------------------------------------------------------------------


def table(spark: SparkSession, sf: str, table_name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table_name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_texts(spark, f"{sf}/documents.parquet")


def order_texts(orders: DataFrame) -> DataFrame:
    return orders.select(
        (F.col("o_orderkey") + ORDER_BASE).alias("doc_id"),
        F.expr(_for_spark(_ORDER_SOURCE)).alias("source"),
        F.expr(_for_spark(_ORDER_TEXT)).alias("text"),
    )


def spread_orders(orders: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """What texts are derived from.  A shuffle of keys, not of the texts they become."""
    keys = ("o_orderkey", "o_custkey")
    return spread(orders.select(*keys), "o_orderkey", like=None if like is None else like.select(*keys))


def text_parts(spark: SparkSession, sf: str) -> list[DataFrame]:
    """All documents, and one derived text per order."""
    return [spread(documents(spark, sf), "doc_id"), order_texts(spread_orders(table(spark, sf, "orders")))]


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents and one derived text per order."""
    given, derived = text_parts(spark, sf)
    return given.unionByName(derived)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """One message line per conversation turn."""
    turns = spread(table(spark, sf, "conversations"), "conv_id", "turn")
    return turns.select(
        F.expr(_MSG_ID).alias("msg_id"), F.expr(_for_spark(_LINE)).alias("line")
    )


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return as_texts(table(spark, sf, "pages"), ("page_id",), "html", None)


# --- SQL -----------------------------------------------------------------------

TEXTS_SQL = f"""SELECT doc_id, coalesce(source, 'unknown') AS source, text FROM documents
    UNION ALL
    SELECT o_orderkey + {ORDER_BASE}, {_for_duckdb(_ORDER_SOURCE)}, {_for_duckdb(_ORDER_TEXT)}
    FROM orders"""

MESSAGES_SQL = f"""SELECT {_MSG_ID} AS msg_id, conv_id, turn, role,
    (conv_id + turn) % 10 AS kind, {_for_duckdb(_LINE)} AS line FROM conversations"""

# The texts inside the messages, straight from the recipe: key = msg_id * 10 + position.
BLOCKS_SQL = f"""SELECT ({_MSG_ID}) * 10 AS doc_id, role AS source,
        {_for_duckdb(BLOCK_TEXT)} AS text
    FROM conversations WHERE (conv_id + turn) % 10 < 5
    UNION ALL
    SELECT ({_MSG_ID}) * 10 + 1, role, {_for_duckdb(RESOURCE_TEXT)}
    FROM conversations WHERE (conv_id + turn) % 10 < 5"""
