"""Streams of texts and messages, over the same plans as in batch.

Masking without a dictionary is stateless.  Where a sink or a dictionary needs
more, ``foreachBatch`` writes each micro-batch into a folder named after its
number and overwrites it, so a replayed batch leaves no duplicates.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilwork.constants import LATENCY_WINDOW
from veilwork.functions.columns import name
from veilwork.operators.audit import audit_events
from veilwork.operators.detect import explode_detections
from veilwork.operators.dictionary import mask_with_tables
from veilwork.operators.metrics import latency_sketches, latest
from veilwork.operators.messages import mask_messages, mask_messages_reversibly
from veilwork.operators.reports import report_part
from veilwork.plans.scan import mask, scan, scan_and_mask
from veilwork.policy import Policy
from veilwork.streaming.stored import (
    StoredDictionary,
    batch_folder,
    last_token,
    latest_table,
    write_batch_tokens,
)

# Take what there is and end.  ``{"processingTime": "10 seconds"}`` runs on.
ONCE: Mapping[str, object] = {"availableNow": True}


def _start(writer, checkpoint: str, trigger: Mapping[str, object]) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _stateless(policy: Policy) -> None:
    if policy.without_tokens().needs_tables():
        raise ValueError("this policy needs a dictionary: use stream_masked_with_tables or stream_messages_with_tables")


def stream_mask_text(
    texts: DataFrame,
    path: str,
    checkpoint: str,
    policy: Policy = Policy(),
    key: Sequence[str] = ("doc_id",),
    trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    """Mask a stream of texts into a Parquet folder."""
    _stateless(policy)
    masked = mask(scan(texts, policy, key), policy)
    out = masked.select(*key, "source", F.col("masked_text").alias("text"))
    return _start(out.writeStream.format("parquet").option("path", path), checkpoint, trigger)


def stream_mask_messages(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    policy: Policy = Policy(),
    trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    """Mask a stream of message lines into a folder of lines."""
    _stateless(policy)
    out = mask_messages(lines, policy).select(F.col("masked_line").alias("value"))
    return _start(out.writeStream.format("text").option("path", path), checkpoint, trigger)


def stream_pseudonyms(
    texts: DataFrame,
    path: str,
    dictionary: str,
    checkpoint: str,
    policy: Policy = Policy(default_strategy="pseudo"),
    key: Sequence[str] = ("doc_id",),
    trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    """Mask with fakes that stay the same over all micro-batches.

    New values of a batch are numbered after the largest stored number of their
    type.  A replayed batch sees the same earlier batches, so it writes the same.
    """
    return stream_masked_with_tables(texts, path, checkpoint, policy, dictionary=dictionary, key=key, trigger=trigger)


def stream_masked_with_tables(
    texts: DataFrame,
    path: str,
    checkpoint: str,
    policy: Policy,
    dictionary: str | None = None,
    tokens: str | None = None,
    keyring: DataFrame | None = None,
    key_id: int = 1,
    key: Sequence[str] = ("doc_id",),
    trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    """Mask a stream with every strategy: fakes from a stored dictionary, tokens into a stored table.

    A batch takes its token numbers from a range that starts where the batch before ended, and its
    tokens are stored before its texts: no masked text is without its tokens, a number is given
    once, and a replayed batch gives its numbers again.  ``read_stream_tokens`` reads them all.
    """
    _check_tables(policy, dictionary, tokens, keyring)

    def each(batch: DataFrame, batch_id: int) -> None:
        scanned = scan(batch, policy, key)
        masked, table = mask_with_tables(
            scanned, policy, key, "text", _extending(batch, dictionary, batch_id, key),
            keyring, key_id, _first_token(batch, tokens, batch_id),
        )
        _store_tokens(table, tokens, batch_id)
        masked.select(*key, "source", F.col("masked_text").alias("text")).write.mode(
            "overwrite"
        ).parquet(batch_folder(path, batch_id))

    return _start(texts.writeStream.foreachBatch(each), checkpoint, trigger)


def stream_messages_with_tables(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    policy: Policy,
    dictionary: str | None = None,
    tokens: str | None = None,
    keyring: DataFrame | None = None,
    key_id: int = 1,
    key: Sequence[str] = ("msg_id",),
    trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    """``stream_masked_with_tables`` for message lines: key columns and ``line``."""
    _check_tables(policy, dictionary, tokens, keyring)

    def each(batch: DataFrame, batch_id: int) -> None:
        block_key = [*key, "_message_row", "block"]
        masked, table = mask_messages_reversibly(
            batch, policy, keyring, key_id, key, dictionary=_extending(batch, dictionary, batch_id, block_key),
            first=_first_token(batch, tokens, batch_id),
        )
        _store_tokens(table, tokens, batch_id)
        masked.select(*key, F.col("masked_line").alias("line")).write.mode("overwrite").parquet(
            batch_folder(path, batch_id)
        )

    return _start(lines.writeStream.foreachBatch(each), checkpoint, trigger)


def stream_message_pseudonyms(
    lines: DataFrame,
    path: str,
    dictionary: str,
    checkpoint: str,
    policy: Policy = Policy(default_strategy="pseudo"),
    key: Sequence[str] = ("msg_id",),
    trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    """``stream_pseudonyms`` for message lines: key columns and ``line``."""
    return stream_messages_with_tables(lines, path, checkpoint, policy, dictionary=dictionary, key=key, trigger=trigger)


def _check_tables(policy: Policy, dictionary: str | None, tokens: str | None, keyring: DataFrame | None) -> None:
    if (tokens is None) != (keyring is None):
        raise ValueError("tokens need both a folder and a keyring")
    if policy.uses("pseudo") and dictionary is None:
        raise ValueError("pseudonyms need a folder for their dictionary")


def _extending(
    batch: DataFrame, dictionary: str | None, batch_id: int, key: Sequence[str]
) -> Callable[[DataFrame], DataFrame] | None:
    """The stored entries of a batch's values, once those it is the first to have are added."""
    if dictionary is None:
        return None
    return lambda values: StoredDictionary(batch.sparkSession, dictionary).extended(values, batch_id, key)


def _first_token(batch: DataFrame, tokens: str | None, batch_id: int) -> int:
    return 1 if tokens is None else last_token(batch.sparkSession, tokens, batch_id) + 1


def _store_tokens(table: DataFrame | None, tokens: str | None, batch_id: int) -> None:
    if table is not None:
        write_batch_tokens(table, tokens, batch_id)


def stream_audit(
    texts: DataFrame,
    path: str,
    checkpoint: str,
    timestamp: Column | str,
    policy: Policy = Policy(),
    key: Sequence[str] = ("doc_id",),
    trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    """Append the audit events of a stream as JSON lines, a folder per batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        masked = scan_and_mask(batch, policy, key)
        audit_events(masked, timestamp, dry_run=policy.dry_run).write.mode("overwrite").json(
            batch_folder(path, batch_id)
        )

    return _start(texts.writeStream.foreachBatch(each), checkpoint, trigger)


def stream_entity_counts(
    texts: DataFrame,
    path: str,
    checkpoint: str,
    policy: Policy = Policy(),
    key: Sequence[str] = ("doc_id",),
    trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    """Running number of detections per type; the folder holds the latest counts.

    The state is a row per type.
    """
    counts = (
        explode_detections(scan(texts, policy, key), key)
        .groupBy("entity_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return _start(counts.writeStream.outputMode("complete").foreachBatch(each), checkpoint, trigger)


def stream_latency_window(
    latencies: DataFrame,
    path: str,
    checkpoint: str,
    value: str,
    order: Sequence[str],
    n: int = LATENCY_WINDOW,
    trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    """Keep the ``n`` newest latencies of a stream, by the columns of ``order``.

    The state is at most ``n`` rows.  A batch merges its own newest rows with the state of the
    batch before it and stores the outcome under its number, so rows that arrive late take the place that
    their time gives them, and any split into batches leaves the same rows.
    ``read_latency_window`` reads them.
    """
    newest = [F.col(name(c)).desc_nulls_last() for c in order]

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(F.col(name(value)).isNotNull()).select(*map(name, dict.fromkeys([value, *order])))
        held = latest_table(batch.sparkSession, path, rows.schema, batch_id)
        latest(rows.unionByName(held), newest, n).coalesce(1).write.mode("overwrite").parquet(
            batch_folder(path, batch_id)
        )

    return _start(latencies.writeStream.foreachBatch(each), checkpoint, trigger)


def stream_latency_sketches(
    latencies: DataFrame,
    path: str,
    checkpoint: str,
    value: str,
    by: Sequence[str] = (),
    trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    """A quantile sketch per batch (and group): ``sketch_percentiles`` merges them when asked."""

    def each(batch: DataFrame, batch_id: int) -> None:
        latency_sketches(batch, value, *by).write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return _start(latencies.writeStream.foreachBatch(each), checkpoint, trigger)


def stream_report_parts(
    audit: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] = ONCE
) -> StreamingQuery:
    """What a compliance report needs of each batch of audit events; each event is read once.

    ``report_of_parts`` of what lies below ``path`` is the report of the whole log.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        report_part(batch).write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return _start(audit.writeStream.foreachBatch(each), checkpoint, trigger)
