import random

import numpy as np
import pytest
import xxhash

from veilwork.llm import simhash
from veilwork.llm.queries import QUERIES
from veilwork.llm.simhash import Counter, bit_planes, connect, first_masks, near_duplicates, near_lanes


def plain_fingerprint(text, words=3):
    found = (text or "").encode().lower().split()
    grams = [b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows, words=3, radius=3):
    """[(id, fingerprint, component)] by all pairs."""
    marked = [(doc, plain_fingerprint(text, words)) for doc, text in rows]
    fps = np.array(sorted({f for _, f in marked}), np.uint64)
    parent = {int(f): int(f) for f in fps}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for f in fps:
        for other in fps[np.bitwise_count(fps ^ f) <= radius]:
            a, b = root(int(f)), root(int(other))
            parent[max(a, b)] = min(a, b)
    least = {}
    for doc, f in marked:
        if doc is not None:
            r = root(f)
            least[r] = min(least.get(r, doc), doc)
    return sorted(((doc, f"{f:016x}", least.get(root(f))) for doc, f in marked), key=str)


def got(df, **how):
    return sorted(map(tuple, near_duplicates(df, **how).collect()), key=str)


def near_numbers(seed, groups=30, size=20, flips=4):
    r, out = random.Random(seed), []
    for _ in range(groups):
        base = r.getrandbits(64)
        for _ in range(r.randint(1, size)):
            x = base
            for _ in range(r.randint(0, flips)):
                x ^= 1 << r.randrange(64)
            out.append(x)
    return np.array(out, np.uint64)


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 5, 7])
def test_counters_against_counting(limit):
    r = np.random.default_rng(limit)
    planes = (r.random((64, 128)) < 0.08).astype(np.uint8)
    counter = Counter(limit, 2)
    counter.add(np.packbits(planes, axis=1, bitorder="little").view("<u8"))
    beyond = np.unpackbits(counter.beyond().view(np.uint8), bitorder="little")
    assert (beyond == (planes.sum(0) > limit)).all()


@pytest.mark.parametrize("shift", [1, 2, 63, 64, 65, 130])
def test_lanes_against_distances(shift):
    fps = near_numbers(shift)
    fps = np.sort(fps)
    lanes = len(fps) - shift
    skipped = np.zeros(-(-lanes // 64) * 64, bool)
    skipped[lanes:] = True
    found = near_lanes(bit_planes(fps), shift, np.packbits(skipped, bitorder="little").view("<u8"), 3)
    assert found.tolist() == np.flatnonzero(np.bitwise_count(fps[:lanes] ^ fps[shift:]) <= 3).tolist()


def test_a_bucket_gives_a_forest():
    fps = near_numbers(5, groups=3, size=150)
    sizes = np.array([2, len(fps) - 5, 3])
    pairs = connect(fps, sizes, 3)
    assert len(pairs) < len(fps)
    bucket = np.repeat(np.arange(3), sizes)
    assert (bucket[pairs[:, 0]] == bucket[pairs[:, 1]]).all()
    assert (np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= 3).all()

    def labels(edges):
        out = np.arange(len(fps))
        while True:
            new = out.copy()
            for a, b in edges:
                new[a] = new[b] = min(new[a], new[b])
            if (new == out).all():
                return out.tolist()
            out = new

    every = [(a, b) for a in range(len(fps)) for b in range(a) if bucket[a] == bucket[b] and np.bitwise_count(fps[a] ^ fps[b]) <= 3]
    assert labels(pairs) == labels(every)


def test_masks_catch_every_pair_within_the_radius():
    r = random.Random(1)
    for radius in (1, 2, 3, 4):
        masks = first_masks(radius)
        further = {m: simhash.further_masks(m, radius) for m in masks}
        for _ in range(500):
            changed = sum(1 << b for b in r.sample(range(64), radius))
            shared = [m for m in masks if not changed & m]
            assert shared and all(any(not changed & f for f in further[m]) for m in shared)


def texts(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(150)]
    rows = []
    for _ in range(15):
        base = [r.choice(words) for _ in range(r.randint(1, 120))]
        for _ in range(r.randint(1, 20)):
            text = list(base)
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    return rows


# blocks of 2 and 5 send every bucket through the further masks and the pairs of blocks
@pytest.mark.parametrize("seed, radius, block", [(1, 3, 8192), (2, 3, 2), (3, 6, 5), (4, 0, 8192)])
def test_against_all_pairs(spark, seed, radius, block):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert got(df, radius=radius, block=block) == plain(rows, radius=radius)


def test_edge_rows(spark):
    rows = [
        (4, "a b c d"), (4, "a b c d"), (3, "A\tB\x0bC  D"), (9, None), (8, ""), (7, " \n"), (None, "a b c d"),
        (None, "only here and there"), (2, "É b"), (1, "é b"), (6, "x " * 20000), (5, "X " * 30000), (0, "a b"),
    ]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id bigint, text string, fp int, id int, component int")
    assert got(df) == plain(rows)
    assert near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op12_simhash_near_dedup"](spark, f"/root/testdata/sf{sf}")
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)
