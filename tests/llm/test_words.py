import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import veilwork.llm.words as w


def as_bytes(text):
    return np.frombuffer(text.encode(), np.uint8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abAB é\t\n\x0b\x0c\r\x1c  ", max_size=30) | st.none(), max_size=5))
def test_words_stand_where_bytes_split(texts):
    column = pa.array(["first", *texts], pa.string()).slice(1)
    for text, data in zip(texts, w.text_bytes(column)):
        expected = (text or "").encode().split()
        found = w.words_of(data)
        assert [data[s:e].tobytes() for s, e in zip(found.start, found.end)] == expected
        assert w.single_spaced(data) == b" ".join(expected)


def test_equal_words_have_equal_hashes_wherever_they_stand(monkeypatch):
    words = [f"w{k % 700}" * (1 + k % 3) for k in range(5000)] + ["x" * 90, "x" * 91]
    plain = w.words_of(as_bytes(" ".join(words))).hashes
    by_word = dict(zip(words, plain.tolist()))
    assert [by_word[x] for x in words] == plain.tolist()
    assert len(set(by_word.values())) == len(by_word)
    # in small pieces, and with words longer than a piece
    monkeypatch.setattr(w, "CHUNK", 64)
    pieces = w.words_of(as_bytes("\n\n" + "  ".join(words)))
    assert [by_word[x] for x in words[:-2]] == pieces.hashes[:-2].tolist()
    assert len(set(pieces.hashes.tolist())) == len(by_word)


def test_letters_are_lowered_if_wanted():
    data = as_bytes("Ab aB É é")
    lowered, kept = w.words_of(data, lower=True).hashes, w.words_of(data).hashes
    assert lowered[0] == lowered[1] and lowered[2] != lowered[3]
    assert len(set(kept.tolist())) == 4


def test_short_and_empty_texts():
    assert len(w.shingles(as_bytes(""), 4)) == 0
    assert len(w.shingles(as_bytes(" \n"), 4)) == 0
    assert len(w.shingles(as_bytes("a b"), 4)) == 1
    assert len(w.shingles(as_bytes("a b a b a b a b"), 4)) == 2
    assert list(w.text_bytes(pa.array([], pa.string()))) == []
