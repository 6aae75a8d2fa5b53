"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that stand next to each other in no token of the vocabulary
can never be joined by a merge.  Each such place is a certain cut: the fragments
between cuts are encoded on their own and their ids put one after another.  Fragments
are short and come back often, so each task keeps those it has encoded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veilwork.llm.base import kept, map_rows, whole_text

# Texts in memory of a task: entries and the longest text that is kept.
MEMO_ENTRIES = 300_000
MEMO_LONGEST = 64
# Entries where the library merges words, which makes what is not remembered cheap.
LIBRARY_ENTRIES = 200_000

_NEVER = 1 << 60
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
# str.split() also cuts at these, the tokenizer does not
_NOT_SPACE = re.compile("[\x1c-\x1f]")
# Where every letter is below U+0100 and none of these stands, a text's words are found at once
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\xad\u0100-\U0010ffff]")
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_WORDS = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+").findall
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class Memo(dict):
    """A dictionary that computes what it lacks.

    When it is full it becomes the old generation, from which entries still in use
    come back; what was not asked for since goes with the generation after.
    """

    def __init__(self, compute, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= MEMO_LONGEST:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class BytePairs:
    """Encoder and decoder for a ``tokenizers`` file: BPE with word ends, no decoder."""

    def __init__(self, path: str, by_library: bool = False) -> None:
        """``by_library``: the library merges whole words, which gives the same sooner."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        # taken from the library: how text is normalised and cut into words
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.merge_word = library.model.tokenize if by_library else None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in (self.ids | added).items()}
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.special_ids = added
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {self.ids[a] << 32 | self.ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.results = [self.ids[a + b] for a, b in pairs]
        inside = (t[: len(t) - len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t for t in self.ids)
        self.joined = {pair for t in inside for pair in zip(t, t[1:])}
        # byte-level form of every byte, as the library writes it
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.byte_form = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.simple_words = regex.compile(split["pattern"]["Regex"]).findall
        # words of plain texts at once, only as that pattern means them
        self.at_once = by_library and split["pattern"]["Regex"] == _SPLIT
        self.inner = {t: i for t, i in self.ids.items() if len(t) == 1}
        self.final = {t[0]: i for t, i in self.ids.items() if len(t) == 1 + len(self.suffix) and t.endswith(self.suffix)}
        self.fragments = Memo(self._encode_fragment, MEMO_ENTRIES // 10)
        self.words = Memo(self._encode_word, LIBRARY_ENTRIES if by_library else MEMO_ENTRIES)
        self.chunks = Memo(self._encode_chunk, LIBRARY_ENTRIES if by_library else MEMO_ENTRIES)
        self.plain_words = Memo(self._encode_plain, LIBRARY_ENTRIES)

    # -- one fragment ---------------------------------------------------------

    def _encode_fragment(self, fragment: str) -> bytes:
        """Ids of a fragment that does not end its word."""
        return self._merged([self.inner[s] for s in fragment if s in self.inner])

    def _encode_last(self, fragment: str) -> bytes:
        """Ids of a fragment that ends its word."""
        inner, final = self.inner, self.final
        parts = [inner[s] for s in fragment[:-1] if s in inner]
        if fragment[-1] in final:
            parts.append(final[fragment[-1]])
        return self._merged(parts)

    def _merged(self, parts: list[int]) -> bytes:
        merged = self._merge_few(parts) if len(parts) <= 24 else self._merge_many(parts)
        return array("I", merged).tobytes() if _LITTLE else np.array(merged, "<u4").tobytes()

    def _merge_few(self, parts: list[int]) -> list[int]:
        rank_of, result = self.ranks.get, self.results
        ranks = [rank_of(a << 32 | b, _NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            rank = min(ranks)
            if rank == _NEVER:
                break
            at = ranks.index(rank)
            parts[at : at + 2] = [result[rank]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << 32 | parts[at], _NEVER)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] << 32 | parts[at + 1], _NEVER)
        return parts

    def _merge_many(self, parts: list[int]) -> list[int]:
        """The same in n log n: a heap of possible merges over a linked list."""
        ranks, results, count = self.ranks, self.results, len(parts)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < count:
                rank = ranks.get(parts[k] << 32 | parts[after[k]])
                if rank is not None:
                    heapq.heappush(heap, (rank, k, parts[k], parts[after[k]], results[rank]))

        for k in range(count - 1):
            offer(k)
        while heap:
            _, k, left, right, new = heapq.heappop(heap)
            n = after[k] if parts[k] == left else count
            if n >= count or parts[n] != right:
                continue
            parts[k], parts[n] = new, -1
            after[k] = after[n]
            if after[k] < count:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [p for p in parts if p >= 0]

    # -- one word, one stretch without white space, one text -----------------------

    def cut(self, word: str) -> list[str]:
        """The word's fragments between certain cuts."""
        joined, start, out = self.joined, 0, []
        if joined.issuperset(zip(word, word[1:])):
            return [word]
        for k, pair in enumerate(zip(word, word[1:]), 1):
            if pair not in joined:
                out.append(word[start:k])
                start = k
        out.append(word[start:])
        return out

    def _encode_word(self, word: str) -> bytes:
        *first, last = self.cut(word)
        if not first:
            if self.merge_word:
                return array("I", [t.id for t in self.merge_word(last)]).tobytes()
            return self._encode_last(last)
        return b"".join([*map(self.fragments.__getitem__, first), self._encode_last(last)])

    def _encode_plain(self, word: str) -> bytes:
        """Ids of a word in lower case, of letters below U+0100."""
        form = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_form)
        if len(form) > MEMO_LONGEST:
            return self._encode_word(form)
        return array("I", [t.id for t in self.merge_word(form)]).tobytes()

    def _encode_chunk(self, chunk: str) -> bytes:
        out, words = [], self.words
        # no white space here, and most chunks hold no special token
        pieces = self.special.split(chunk) if self.special and self.special.search(chunk) else [chunk]
        for piece in pieces:
            if piece in self.special_ids:
                out.append(np.array([self.special_ids[piece]], "<u4").tobytes())
            elif piece:
                out.extend(map(words.__getitem__, self._words(piece)))
        return out[0] if len(out) == 1 else b"".join(out)

    def _words(self, piece: str) -> Iterable[str]:
        """Words in byte-level form; below U+0100 nothing composes and letters are plain."""
        if piece.isprintable():
            if piece.isascii():
                return self.simple_words(piece.lower())
            if max(piece) < "\u0100":
                form = self.byte_form
                return [
                    w.encode().decode("latin-1").translate(form) for w in self.simple_words(piece.lower())
                ]
        normal = self.normalizer.normalize_str(piece)
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.at_once and not _ODD.search(text) and not (self.special and self.special.search(text)):
            return b"".join(map(self.plain_words.__getitem__, _LATIN_WORDS(text.lower())))
        chunks = _SPACE.split(text) if _NOT_SPACE.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _read(path: str, by_library: bool) -> BytePairs:
    return BytePairs(path, by_library)


#: The name of the encoders among what a worker keeps.
ENCODERS = "encoders"


def byte_pairs(path: str, by_library: bool = False) -> BytePairs:
    """Read once per Python worker; the path must be valid on every executor."""
    kept(ENCODERS, _read.cache_clear)
    return _read(path, by_library and _LITTLE)


def encode(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Id and token ids of each text: columns id, ``ids`` (array of int).

    The ids are those of the tokenizers library without special tokens added, special
    tokens in the text included.  A null or blank text has no ids; every row is kept,
    also one that repeats another or has a null id.  One narrow stage.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = byte_pairs(path)
        coded = [encoder.encode(t) for t in batch.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
        values = np.frombuffer(b"".join(coded), "<i4")
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
            names=["_id", "ids"],
        )

    rows = docs.select(docs[id_column].cast("bigint").alias("_id"), whole_text(text_column))
    return map_rows(rows, run, "_id bigint, ids array<int>", [ENCODERS]).withColumnRenamed("_id", id_column)


def decode(
    encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids"
) -> DataFrame:
    """Id and decoded text (``text``): token strings with spaces between.

    Null ids count as none and give an empty text; an id outside the vocabulary fails.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        decoder = byte_pairs(path)
        texts = [decoder.decode(ids or ()) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    rows = encoded.select(encoded[id_column].cast("bigint").alias("_id"), ids_column)
    return map_rows(rows, run, "_id bigint, text string", [ENCODERS]).withColumnRenamed("_id", id_column)


def digests(
    encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids"
) -> DataFrame:
    """Digests of the ids and of the text they decode to, which stays in its task."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        decoder, counts, of_ids, of_texts = byte_pairs(path), [], [], []
        column = batch.column(1)
        for k in range(len(column)):
            scalar = column[k].values
            ids = scalar.to_numpy(zero_copy_only=False) if scalar is not None else np.empty(0, np.int32)
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            of_texts.append(hashlib.sha256(decoder.decode(ids.tolist()).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(of_ids, pa.string()),
                pa.array(of_texts, pa.string()),
            ],
            names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    rows = encoded.select(encoded[id_column].cast("bigint").alias("_id"), ids_column)
    return map_rows(rows, run, schema, [ENCODERS]).withColumnRenamed("_id", id_column)
