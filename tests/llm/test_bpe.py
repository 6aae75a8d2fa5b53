import hashlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from veilwork.llm import bpe
from veilwork.llm.queries import QUERIES

PATH = path("word_bpe_49k.json")
AWKWARD = [
    "",
    "   \n\t ",
    "The the THE'S don't we'll 123 4.5%%% &&&",
    "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|> <|endoftext",
    "ΑΣ ΟΔΟΣ ΣΊΣΥΦΟΣ İstanbul ǅ ﬁ é ẛ̣",
    "a\x1cb\x1d c\x85d\xa0e　f g​h",
    "😀😀 日本語テキスト 한국어 नमस्ते ١٢٣ ½ Ⅷ",
    "a" * 5000 + "b" * 999,
    "éè" * 700,
    "ÀÉÎÕÜ ÿ ß µ ª º ½²³ × ÷ ¿qué? «a» ´¨ AÉ\u0301",
    "\x00\x01\x7f ﻿x",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, text):
    ids = np.frombuffer(bpe.byte_pairs(PATH).encode(text), "<u4").tolist()
    assert ids == np.frombuffer(bpe.byte_pairs(PATH, True).encode(text), "<u4").tolist()
    expected = library.encode(text, add_special_tokens=False).ids
    assert ids == expected
    assert bpe.byte_pairs(PATH).decode(ids) == library.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("text", AWKWARD)
def test_awkward_texts_as_the_library(library, text):
    same(library, text)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=60) | st.text("abcdefgh'st ré1 .é\x1f", max_size=80) | st.text(st.characters(max_codepoint=255), max_size=60))
def test_any_text_as_the_library(library, text):
    same(library, text)


def test_with_the_library_a_word_is_held_once_whatever_stands_around_it(library):
    coder = bpe.BytePairs(PATH, True)
    text = "Zqxé zqxé, (ZQXÉ) zqxé. 'zqxé' zqxé\n"
    ids = np.frombuffer(coder.encode(text * 50), "<u4").tolist()
    assert ids == library.encode(text * 50, add_special_tokens=False).ids
    held = [*coder.chunks, *coder.words, *coder.plain_words]
    assert [w for w in held if "zq" in w.lower()] == ["zqxé"]


def test_cuts_are_places_no_token_covers():
    coder = bpe.byte_pairs(PATH)
    word = "qzxjkvqwxzj"
    assert "".join(coder.cut(word)) == word
    assert len(coder.cut(word)) > 1
    few, many = coder._merge_few, coder._merge_many
    parts = [coder.ids[c] for c in "theinternationalization" * 3]
    assert few(list(parts)) == many(list(parts))


def test_null_rows_extra_columns_and_round_trip(spark):
    rows = [(1, "A b", "x"), (1, "A b", "x"), (None, None, None), (3, "", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, ""), (1, "a</w> b</w>"), (1, "a</w> b</w>"), (3, "")]
    assert bpe.digests(bpe.encode(df.limit(0), PATH), PATH).count() == 0


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = set()
    for r in texts:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.add(
            (
                r.doc_id,
                len(ids),
                hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(text.encode()).hexdigest(),
            )
        )
    assert {tuple(r) for r in QUERIES["op1_bpe_round_trip"](spark, sf).collect()} == expected
