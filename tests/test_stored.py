"""Partial results and tables that grow by merging: the same as from everything at once."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veilwork.functions.overlaps import without_overlaps
from veilwork.operators.dictionary import merge_tokens
from veilwork.operators.metrics import RANK_ERROR, latency_sketches, latest, sketch_percentiles, window_percentiles
from veilwork.operators.reports import compliance_report, report_of_parts
from veilwork.sources.token_table import TOKEN_SCHEMA, TokenTable
from veilwork.streaming.stored import batch_folder, read_latency_window
from veilwork.streaming.streams import stream_latency_sketches, stream_latency_window, stream_report_parts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def streamed(spark, tmp_path, parts, start):
    """Each part is a batch; then the last one runs again."""
    source = str(tmp_path / "in")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        start(spark.readStream.schema(part.schema).parquet(source)).awaitTermination()
    commits = tmp_path / "c" / "commits"
    last = max((int(p.name) for p in commits.glob("[0-9]*")))
    (commits / str(last)).unlink()
    for crc in commits.glob(f".{last}.crc"):
        crc.unlink()
    start(spark.readStream.schema(parts[0].schema).parquet(source)).awaitTermination()
    return spark.read.schema(parts[0].schema).parquet(source)


def test_the_latency_window_of_a_stream(spark, tmp_path):
    r = random.Random(1)
    stamps = r.sample(range(1000), 90)
    data = [(t, k, None if k % 11 == 0 else r.random() * 100) for k, t in enumerate(stamps)]
    parts = [spark.createDataFrame(data[k::3], "ts bigint, event_id bigint, value double") for k in range(3)]
    out = str(tmp_path / "out")
    whole = streamed(spark, tmp_path, parts, lambda s: stream_latency_window(s, out, str(tmp_path / "c"), "value", ["ts", "event_id"], n=25))
    held = read_latency_window(spark, out, "value double, ts bigint, event_id bigint")
    newest = latest(whole.where("value is not null"), [F.desc("ts"), F.desc("event_id")], 25)
    assert rows(held) == rows(newest.select("value", "ts", "event_id"))
    assert window_percentiles(held, "value").first() == window_percentiles(newest, "value").first()
    assert [spark.read.parquet(batch_folder(out, k)).count() for k in range(3)] == [25, 25, 25]


def test_sketches_of_batches_stay_within_their_error(spark, tmp_path):
    values = spark.range(60_000).select(F.pow(F.rand(5), 3).alias("value"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    values.write.parquet(str(tmp_path / "values"))
    values = spark.read.parquet(str(tmp_path / "values"))
    parts = [values.where(F.pmod(F.xxhash64("value"), F.lit(4)) == k) for k in range(4)]
    out = str(tmp_path / "out")
    streamed(spark, tmp_path, parts, lambda s: stream_latency_sketches(s, out, str(tmp_path / "c"), "value", ["source"]))
    stored = spark.read.parquet(out)
    assert stored.count() == 12

    def check(found, ordered):
        assert found.n == len(ordered)
        for p in (50, 95, 99):
            rank = sum(v <= found[f"p{p}"] + 0.0005 for v in ordered) / len(ordered)
            below = sum(v < found[f"p{p}"] - 0.0005 for v in ordered) / len(ordered)
            assert below - RANK_ERROR <= p / 100 <= rank + RANK_ERROR

    check(sketch_percentiles(stored).first(), sorted(r.value for r in values.collect()))
    for r in sketch_percentiles(stored, "source").collect():
        check(r, sorted(v.value for v in values.where(F.col("source") == r.source).collect()))
    assert tuple(sketch_percentiles(latency_sketches(values.limit(0), "value")).first()) == (0, 0.0, 0.0, 0.0)


AUDIT = "event_type string, tool_name string, entity_type string, masking_strategy string, confidence double, dry_run boolean, timestamp string"


def test_a_report_from_parts(spark, tmp_path):
    r = random.Random(2)
    data = []
    for k in range(80):
        stamp = r.choice([None, "", f"2024-01-{r.randint(1, 28):02d}"])
        if k % 4 == 0:
            data.append(("scan_summary", r.choice(["a", None]), None, None, None, False, stamp))
        else:
            data.append((None, r.choice(["a", "b", None]), r.choice(["EMAIL", "SSN", None]), r.choice(["redact", "hash", None]), r.choice([0.5, 0.95, None]), k % 9 == 0, stamp))
    parts = [spark.createDataFrame(data[k::3], AUDIT) for k in range(3)]
    out = str(tmp_path / "out")
    whole = streamed(spark, tmp_path, parts, lambda s: stream_report_parts(s, out, str(tmp_path / "c")))
    assert report_of_parts(spark.read.parquet(out), "now").first() == compliance_report(whole, "now").first()
    nothing = spark.createDataFrame([], AUDIT)
    assert "NO_DATA" in compliance_report(nothing).first().report


def tokens_of(spark, numbers, cipher):
    return spark.createDataFrame([(f"t{k}", "EMAIL", 1, bytearray(f"{cipher}{k}".encode())) for k in numbers], TOKEN_SCHEMA)


def test_merging_tokens_into_buckets(spark, tmp_path):
    table = TokenTable(spark, str(tmp_path / "t"), buckets=8)
    assert table.read().count() == 0 and table.merge(tokens_of(spark, [], "a")) == []
    first, second = tokens_of(spark, range(40), "a"), tokens_of(spark, [3, 100], "b")
    assert len(table.merge(first)) == 8
    touched = table.merge(second)
    assert 1 <= len(touched) <= 2
    assert rows(table.read()) == rows(merge_tokens(first, second).select("token", "entity_type", "key_id", "ciphertext"))
    written = {p.name for p in (tmp_path / "t" / "version=2").glob("bucket=*")}
    assert written == {f"bucket={b}" for b in touched}


def test_a_failed_merge_leaves_the_table_readable(spark, tmp_path):
    table = TokenTable(spark, str(tmp_path / "t"), buckets=4)
    table.merge(tokens_of(spark, range(10), "a"))
    before = rows(table.read())
    broken = tokens_of(spark, range(5), "b").withColumn("ciphertext", F.expr("if(token = 't3', raise_error('lost'), ciphertext)"))
    with pytest.raises(Exception, match="lost"):
        table.merge(broken)
    # and one that ended before its manifest was complete
    (tmp_path / "t" / "manifest" / "version=2").mkdir()
    assert rows(table.read()) == before and table.version() == 1
    table.merge(tokens_of(spark, range(5), "c"))
    assert table.read().where("startswith(cast(ciphertext as string), 'c')").count() == 5 and table.read().count() == 10


FIELDS = "entity_type string, start int, end int, text string, confidence double, context string, engine string, ord int"
DETECTIONS = "array<struct<" + ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in FIELDS.split(", ")) + ">>"


def greedy(found):
    kept = []
    for d in sorted(found, key=lambda d: (-d[4], d[1], d[7])):
        if not any(d[1] < k[2] and d[2] > k[1] for k in kept):
            kept.append(d)
    return sorted(kept, key=lambda d: (d[1], d[7]))


def test_islands_against_the_greedy_rule(spark):
    r = random.Random(4)
    texts = []
    for size in [0, 1, 2, 5, 40, 255, 256, 257, 700] * 2:
        starts = [r.randrange(max(1, size * r.choice([2, 6]))) for _ in range(size)]
        texts.append([("T", s, s + r.choice([1, 2, 3, 9]), "x", r.choice([0.5, 0.7, 0.9]), "", "e", k) for k, s in enumerate(starts)])
    texts.append([("T", 0, 5000, "x", 0.1, "", "e", 0)] + [("T", 3 * k, 3 * k + 2, "x", 0.9, "", "e", k + 1) for k in range(600)])
    df = spark.createDataFrame(list(enumerate(texts)), f"id int, d {DETECTIONS}")
    for r in df.selectExpr("id", f"{without_overlaps('d')} as kept").collect():
        assert [tuple(x) for x in r.kept] == greedy(texts[r.id])


def test_time_grows_with_the_number_of_islands(spark):
    def seconds(n):
        one = f"""transform(sequence(0, {n - 1}), k -> named_struct('entity_type', 'T', 'start', k * 3, 'end', k * 3 + if(k % 2 = 0, 4, 2),
            'text', 'x', 'confidence', 0.9D, 'context', '', 'engine', 'e', 'ord', k))"""
        df = spark.range(1).selectExpr(f"cast({one} as {DETECTIONS}) as d")
        begin = time.perf_counter()
        assert df.selectExpr(f"size({without_overlaps('d')}) as n").first().n == n // 2
        return time.perf_counter() - begin

    seconds(1_000)
    small, large = seconds(10_000), seconds(100_000)
    assert large < 30 * max(small, 0.3)
