import random

from veilwork.llm import line_dedup
from veilwork.llm.line_dedup import EVERY_LINE, deduplicate_lines, plain, shingle_set, signatures
from veilwork.llm.queries import QUERIES


def brute(rows, similarity=0.8, size=8, least=1):
    """{row position: kept text} by all pairs."""
    order = sorted(range(len(rows)), key=lambda k: (float("inf") if rows[k][0] is None else rows[k][0], k))
    places = {}
    for k in order:
        for n, line in enumerate((rows[k][1] or "").split("\n")):
            if len(plain(line)) >= least:
                places.setdefault(plain(line), []).append((order.index(k), n))
    lines = list(places)
    sets = [shingle_set(x, size) for x in lines]
    parent = list(range(len(lines)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    best = {}
    for i, line in enumerate(lines):
        best[root(i)] = min(best.get(root(i), (1 << 60, 0)), min(places[line]))
    stays = set(best.values())
    out = {}
    for k in order:
        text = rows[k][1]
        if text is None:
            out[k] = None
            continue
        out[k] = "\n".join(
            line
            for n, line in enumerate(text.split("\n"))
            if len(plain(line)) < least or (order.index(k), n) in stays
        )
    return out


def near_lines(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(25)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            line = r.choice(base)
            if r.random() < 0.5:
                at = r.randrange(len(line) + 1)
                line = line[:at] + r.choice(["x", "yz", ""]) + line[at:]
            lines.append(r.choice([line, line.upper(), "  " + line]))
        rows.append((k, "\n".join(lines)))
    return rows


def test_against_all_pairs(spark):
    for seed in (1, 2):
        rows = near_lines(seed)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        got = {r.doc_id: r.text for r in deduplicate_lines(df, bands=24, rows_per_band=2).collect()}
        assert got == brute(rows)


def test_signatures_find_similar_lines():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    found = total = 0
    for _ in range(400):
        line = " ".join(r.choice(words) for _ in range(30))
        at = r.randrange(len(line))
        other = line[:at] + "x" + line[at + 1 :]
        a, b = shingle_set(line, 8), shingle_set(other, 8)
        assert len(a & b) / len(a | b) > 0.8
        keys = signatures([line, other], 8, 8, 4)
        total += 1
        found += bool((keys[0] == keys[1]).any())
    assert found / total > 0.99
    one = signatures(["short", "a" * 5000, "x" * 9], 8, 8, 4)
    assert one.shape == (3, 8)
    assert (signatures(["a" * 5000], 8, 8, 4) == one[1:2]).all()


def test_edge_rows(spark):
    line = "a line that is long enough"
    rows = [
        (5, f"{line}\nshort\n\nshort", "x", 1),
        (3, f"{line.upper()}\n{line}!", "y", 2),
        (None, line, None, 3),
        (9, None, "n", 4),
        (8, "", "e", 5),
        (7, "short", "s", 6),
        (3, f"{line.upper()}\n{line}!", "y", 2),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_lines int")
    got = deduplicate_lines(df, least_chars=16)
    assert got.columns == ["doc_id", "source", "text", "n_lines", "n_removed"]
    found = sorted((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in got.collect() if r.doc_id != 3)
    assert found == [
        ("5", "short\n\nshort", 4, 1), ("7", "short", 1, 0), ("8", "", 0, 0), ("9", None, 0, 0), ("None", "", 1, 1),
    ]
    assert [(r.text, r.n_removed) for r in got.collect() if r.doc_id == 3] == [(line.upper(), 1)] * 2
    assert deduplicate_lines(df.limit(0)).count() == 0


def test_query_keeps_every_document(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op2_line_dedup"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows)
    # equal lines: at least these go
    seen, least = set(), {}
    for doc, text in sorted(rows):
        for line in map(plain, text.split("\n")):
            if len(line) >= 16:
                least[doc] = least.get(doc, 0) + (line in seen)
                seen.add(line)
    assert all(r.n_removed >= least.get(r.doc_id, 0) for r in got)
    assert sum(r.n_removed for r in got) > sum(least.values())


def test_query_takes_short_lines_too(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r.n_removed for r in QUERIES["op2_line_dedup"](spark, sf).collect()}
    seen, least = set(), {}
    for doc, text in sorted(rows):
        for line in filter(None, map(plain, text.split("\n"))):
            least[doc] = least.get(doc, 0) + (line in seen)
            seen.add(line)
    assert all(got[doc] >= n for doc, n in least.items())


def test_every_line_against_all_pairs(spark):
    rows = near_lines(3) + [(100 + k, t) for k, t in enumerate(["ab\n\nAB \nabc", "ab", "x\nabcdefghi\nabcdefgh", "abcdefgh", "x"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = deduplicate_lines(df, bands=24, rows_per_band=2, least_chars=EVERY_LINE)
    assert {r.doc_id: r.text for r in found.collect()} == {rows[k][0]: t for k, t in brute(rows, least=1).items()}


def test_sketches_rule_out_no_similar_pair():
    r = random.Random(7)
    met = lost = 0
    for distinct in (10, 20, 40, 110, 300):
        for _ in range(300):
            # a long line that repeats itself, and one that does so with a few letters changed
            unit = "".join(r.choice("abcdefghijklmnop") for _ in range(distinct))
            at = sorted(r.sample(range(distinct), 1 + distinct // 90))
            other = "".join("#" if k in at else c for k, c in enumerate(unit))
            both = [(unit * 300)[: 2 * distinct + 100], (unit + other * 300)[: 2 * distinct + 100]]
            a, b = (shingle_set(x, 8) for x in both)
            counts = line_dedup.sketches(both, 8)
            near = line_dedup.may_reach(counts[:1], counts[1:], len(a & b) / len(a | b))
            met += len(a & b) > 0
            lost += not near[0]
    assert met > 1000 and not lost
    far = line_dedup.sketches(["".join(r.choice("abcdefghij") for _ in range(120)) for _ in range(200)], 8)
    assert not line_dedup.may_reach(far[::2], far[1::2], 0.8).any()
    assert line_dedup.may_reach(*line_dedup.sketches(["ab" * 50, "ba" * 60], 8)[:, None], 0.8).all()


def test_recall_at_production_bands_with_sketches(spark):
    # 30 distinct shingles in lines of 180 characters and more
    r = random.Random(9)
    lines = []
    for _ in range(400):
        unit = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30))
        lines += [unit * 6, unit * 6 + "xyz"]
    a, b = shingle_set(lines[0], 8), shingle_set(lines[1], 8)
    assert 0.8 < len(a & b) / len(a | b) < 0.95
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = deduplicate_lines(df).agg({"n_removed": "sum"}).first()[0]
    keys = signatures(lines, 8, 8, 4)
    assert got == (keys[::2] == keys[1::2]).any(axis=1).sum()


def test_a_crowded_band_makes_no_pairs_that_the_sketches_rule_out(spark, monkeypatch):
    # long lines that share most shingles: no two are similar, and many agree in a band
    r = random.Random(11)
    same = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1000))
    lines = [same + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(210)) for _ in range(60)]
    a, b = shingle_set(lines[0], 8), shingle_set(lines[1], 8)
    assert 0.65 < len(a & b) / len(a | b) < 0.75
    compared = []
    similar = line_dedup._similar

    def counted(known, pairs, *args):
        compared.append(pairs.count())
        return similar(known, pairs, *args)

    monkeypatch.setattr(line_dedup, "_similar", counted)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    assert deduplicate_lines(df, bands=24, rows_per_band=1).agg({"n_removed": "sum"}).first()[0] == 0
    assert sum(compared) < 60


def test_lines_beyond_latin_letters_are_compared_exactly_too(spark):
    r = random.Random(12)
    rows = []
    for k, letters in enumerate(("abcdefghijklmnop", "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d\u4e03\u516b", "abcd\xe9\xff\u0100\U0001f600")):
        line = "".join(r.choice(letters) for _ in range(120))
        rows += [(10 * k, line), (10 * k + 1, line + "x"), (10 * k + 2, line[:60] + "".join(r.choice(letters) for _ in range(60)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = deduplicate_lines(df, bands=24, rows_per_band=2)
    assert {x.doc_id: x.text for x in got.collect()} == {rows[k][0]: t for k, t in brute(rows).items()}


def test_plain_lines_of_a_text_are_those_of_its_lines():
    texts = [
        "", "\n", " A  b \n\tC", "x Y\nz", "ΣΣ\nΣ İ", "a\r\nb\x0bc\x1cd\x85", "A b\n c d \n", " eß",
    ]
    for text in texts:
        assert line_dedup.plain_lines(text) == [plain(line) for line in text.split("\n")]


def test_each_line_is_sorted_once(spark):
    docs = spark.createDataFrame([(k, "one and the same line\nline number %d" % k) for k in range(50)], "doc_id long, text string")
    rows = line_dedup._documents(docs, "doc_id", "text")
    signed = line_dedup._signed_lines(rows, 1, 8, 8, 4)
    assert signed.where("n IS NOT NULL").count() < signed.count() == 100
    plan = line_dedup._classes(signed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
    found = line_dedup._classes(signed).select("id", "line", "n").orderBy("id").collect()
    assert sorted(map(tuple, found)) == sorted([(0, 0, 50), *((k, 1, 1) for k in range(50))])
