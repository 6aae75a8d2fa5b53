import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from veilwork.llm.packing import pack, sweep
from veilwork.llm.queries import QUERIES

PATH = path("word_bpe_49k.json")


def best_fit(lengths, capacity):
    """Sequences that one-by-one best fit by falling length needs."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= length]
        if fit:
            g = min(fit)
            gaps.remove(g)
        else:
            g = capacity
        gaps.append(g - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(25))
def test_sweep_is_as_good_as_one_by_one(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 7, 50, 300])
    kinds = [r.randint(1, capacity) for _ in range(r.randint(1, 12))]
    lengths = sorted((r.choice(kinds) for _ in range(r.randint(0, 300))), reverse=True)
    classes = sorted(set(lengths), reverse=True)
    runs = sweep(classes, [lengths.count(c) for c in classes], capacity)
    used = {}
    for rank, length in enumerate(lengths):
        row = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1]
        used.setdefault(int(row[1] + rank - row[0]), []).append((int(row[2]), length))
    check_sequences(used, capacity)
    assert len(used) <= best_fit(lengths, capacity)


def check_sequences(used, capacity):
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def check_pack(rows, texts, capacity):
    library = Tokenizer.from_file(PATH)
    by_doc, used = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    check_sequences(used, capacity)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        expected = [
            (k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(np.array(ids[k : k + capacity], "<u4").tobytes()))
            for k in range(0, len(ids), capacity)
        ]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in parts) == expected
    return len(used)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_best_fit_packing"](spark, sf).collect()
    count = check_pack(rows, texts, 4096)
    assert count <= best_fit([r.length for r in rows], 4096)


def test_small_capacity_and_edge_rows(spark):
    texts = {1: None, 2: "", 3: "a " * 9, 4: "b " * 10, 5: "c " * 35, None: "d"}
    df = spark.createDataFrame([(k, t, 7) for k, t in texts.items()], "doc_id bigint, text string, length int")
    check_pack(pack(df, PATH, capacity=10).collect(), texts, 10)
    assert pack(df.limit(0), PATH).count() == 0
    twice = pack(df.where("doc_id = 3").union(df.where("doc_id = 3")), PATH, capacity=10).collect()
    assert sorted((r.length, r.offset) for r in twice) == [(10, 0), (10, 0)]
