import os

import corpus_pipeline as cp
from brute import components, without_repeated
from pyspark.sql import functions as F
from test_line_dedup import brute as lines_left
from test_line_dedup import plain
from test_packing import best_fit, check_pack

SF = "/root/testdata/sf0.001"


def staged(spark, tmp_path, docs):
    """The input and each stage's output, stored."""
    out = [docs]
    for name, stage in cp.STAGES:
        path = os.path.join(tmp_path, name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def some(text):
    return any(len(plain(line)) >= 1 for line in text.split("\n"))


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r[0]))


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw, spoken, lines, single, clean, packed = staged(spark, tmp_path, docs)
    assert all(df.columns == docs.columns and df.dtypes == docs.dtypes for df in (spoken, lines, single, clean))
    with_letters = [r for r in pairs(raw) if any(map(str.isalpha, r[1] or ""))]
    assert pairs(spoken) == with_letters

    rows = pairs(spoken)
    left = lines_left(rows)
    expected = [(d, left[k]) for k, (d, t) in enumerate(rows) if left[k] == t or some(left[k])]
    assert pairs(lines) == expected

    rows = pairs(lines)
    stays = {doc for doc, _, component in components(rows, 5, 80) if doc == component}
    assert pairs(single) == [r for r in rows if r[0] in stays]

    rows = pairs(single)
    texts = dict(rows)
    expected = [(d, texts[d] if not gone else kept) for d, n, gone, kept in without_repeated(rows) if not gone or gone < n]
    assert pairs(clean) == expected
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    rows = packed.collect()
    assert check_pack(rows, dict(pairs(clean)), 4096) <= best_fit([r.length for r in rows], 4096)
    again = cp.run(spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_edge_rows(spark, tmp_path):
    prose = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").first().text
    rows = [
        (1, prose, "en", "s", 5), (2, prose, "en", "s", 5), (2, prose, "en", None, 5), (None, prose, None, "s", 5),
        (None, None, None, None, None), (4, "", "en", "s", 0), (5, "12 !?", "en", "s", 5),
        (6, "the one and only text of its kind", None, "s", 1), (7, "of the cat " * 9000, "en", "s", 1),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema).select("*", F.lit(1).alias("n_removed"), F.lit("x").alias("score"))
    *stages, packed = staged(spark, tmp_path, docs)
    assert all(df.columns == docs.columns for df in stages)
    assert sorted(r.doc_id for r in stages[-1].collect()) == [1, 6, 7]
    assert {r.n_removed for r in stages[-1].collect()} == {1}
    assert {r.doc_id for r in packed.collect()} == {1, 6, 7}
    *_, none = staged(spark, tmp_path / "empty", docs.limit(0))
    assert none.count() == 0


def test_columns_of_any_name(spark, tmp_path):
    """Names that the stages use inside come back with what they held."""
    names = ["_score", "_lang_pred", "_text", "_id", "_key", "_gone", "_kept", "_n_words", "_spans", "_row", "_n_removed", "n_removed", "row", "a.b", "further_0_of_the_input"]
    prose = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").first().text
    rows = [(k, f"{prose}\n{k} is its own line here" if k else prose, "en") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").select(
        "*", *[(F.col("doc_id") * 1000 + k).alias(n) for k, n in enumerate(names)]
    )
    *stages, packed = staged(spark, tmp_path, docs)
    for df in stages:
        assert df.columns == docs.columns and df.count()
        assert all(r[3 + k] == r[0] * 1000 + k for r in df.collect() for k in range(len(names)))
    assert packed.count() >= 1


def test_short_lines_of_its_own_keep_a_document(spark):
    head = "a heading that two documents share"
    rows = [(1, f"{head}\nroses"), (2, f"{head}\nviolets\n\nso blue"), (3, f"{head}\n \nroses"), (4, None), (5, "so blue\nmine")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in cp.line_dedup(spark, docs, SF).collect()}
    assert got == {1: rows[0][1], 2: "violets\n\nso blue", 4: None, 5: "mine"}
