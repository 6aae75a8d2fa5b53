"""A bidirectional FM-index over a delimited word list, searched for whole batches at a time.

The words stand in one text, a delimiter before and after each.  An index of the text extends
a match to the left, one of the reversed text to the right; a match is an interval of
suffix ranks in both, and an extension in one says where the interval lies in the other.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_STEP = 32  # places between two stored ranks
_DELIMITER = 0


def sorted_rotations(codes: np.ndarray) -> np.ndarray:
    """Where the rotations of a text start, in their order; all rotations must differ.

    Ranks by ever longer beginnings, first by as many characters as fit 62 bits.
    """
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length())
    length = max(1, min(62 // bits, n))
    rank = np.zeros(n, np.int64)
    for k in range(length):
        rank = (rank << bits) | np.roll(codes, -k).astype(np.int64)
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        if dense[order[-1]] == n - 1:
            return order
        rank = dense * n + np.roll(dense, -length)
        length *= 2


class Ranks:
    """Occurrences of a character, and of smaller ones, before any place of a transformed text."""

    def __init__(self, codes: np.ndarray, order: np.ndarray, alphabet: int):
        n = len(codes)
        blocks = n // _STEP + 1
        last = np.full(blocks * _STEP, 255, np.uint8)
        last[:n] = codes[order - 1]
        self.last = last
        self.order = order
        self.rows = last.reshape(blocks, _STEP)
        inside = np.bincount(
            (np.arange(n) // _STEP) * alphabet + last[:n], minlength=blocks * alphabet
        ).reshape(blocks, alphabet)
        self.equal = np.cumsum(np.vstack([np.zeros(alphabet, np.int64), inside[:-1]]), axis=0).astype(np.int32)
        self.less = (np.cumsum(self.equal, axis=1) - self.equal).astype(np.int32)
        total = np.bincount(codes, minlength=alphabet)
        self.first = np.cumsum(total) - total
        self._place = np.arange(_STEP)

    def before(self, places: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = places // _STEP
        row = self.rows[block]
        there = self._place < (places % _STEP)[:, None]
        c = chars[:, None]
        equal = self.equal[block, chars] + np.count_nonzero((row == c) & there, axis=1)
        less = self.less[block, chars] + np.count_nonzero((row < c) & there, axis=1)
        return equal, less


class WordIndex:
    """Distinct words, found with one error in the half that is not searched exactly."""

    def __init__(self, words: Sequence[str]):
        text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
        self.letters = np.unique(text)
        if len(self.letters) > 250:
            raise ValueError("more than 249 different letters in one index")
        codes = np.searchsorted(self.letters, text).astype(np.uint8)
        # one code more, for letters that no word has
        self.alphabet = len(self.letters) + 1
        self.count = len(words)
        self.size = len(codes)
        self.forward = Ranks(codes, sorted_rotations(codes), self.alphabet)
        back = codes[::-1].copy()
        self.backward = Ranks(back, sorted_rotations(back), self.alphabet)
        self.number = np.cumsum(codes == _DELIMITER) - 1
        self.number_back = np.cumsum(back == _DELIMITER) - 1

    def encode(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words, one row each, and their lengths; the rows end in delimiters."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.minimum(np.searchsorted(self.letters, flat), len(self.letters) - 1)
        codes = np.where(self.letters[at] == flat, at, self.alphabet - 1).astype(np.uint8)
        rows = np.full((len(words), int(lengths.max(initial=0)) + 1), _DELIMITER, np.uint8)
        rows[np.arange(rows.shape[1]) < lengths[:, None]] = codes
        return rows, lengths

    def near(self, words: Sequence[str], first_half: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, number of an indexed word) at exactly one edit from each other.

        With ``first_half`` the first half of the searched word must stand unchanged and the
        edit lies beyond it; else the second half and before it.  Each pair comes once.
        """
        if first_half:
            rows, lengths = self.encode(words)
            asked, rank = self._search(self.forward, self.backward, rows, lengths, lengths // 2)
            number = self.number[self.forward.order[rank]]
        else:
            # the same from right to left: the reversed words in the reversed text
            rows, lengths = self.encode([w[::-1] for w in words])
            asked, rank = self._search(self.backward, self.forward, rows, lengths, lengths - lengths // 2)
            number = self.count - 1 - self.number_back[self.backward.order[rank]]
        # nothing stands between the last delimiter and the first
        real = (number >= 0) & (number < self.count)
        return asked[real], number[real]

    def _search(
        self, near: Ranks, far: Ranks, rows: np.ndarray, lengths: np.ndarray, heads: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Asked words and the place in ``near`` of what was found, read away from their heads."""
        asked = np.arange(len(rows))
        state = (asked, np.zeros_like(asked), np.zeros_like(asked), np.full_like(asked, self.size))
        # the head from its end to its beginning, then the delimiter before it
        whole = []
        for t in range(int(heads.max(initial=0)) + 1):
            ended = heads[state[0]] < t
            whole.append(_chosen(state, ended))
            state = _chosen(state, ~ended)
            at = heads[state[0]] - 1 - t
            state = _grown(near, state, np.where(at < 0, _DELIMITER, rows[state[0], at]))
        # from here on to the other side
        clean = _turned(_joined([*whole, state]))
        wrong = _chosen(clean, np.zeros(len(clean[0]), bool))
        found = [wrong]
        t = 0
        while len(clean[0]) or len(wrong[0]):
            at = heads[clean[0]] + t
            here, over = rows[clean[0], at], at == lengths[clean[0]]
            which, char, longer = self._every_extension(far, clean)
            same = char == here[which]
            other = ~same & (char != _DELIMITER)
            # one letter more, before this place: of equal letters it is the last
            wrong = _joined([wrong, _chosen(longer, other)])
            at = heads[wrong[0]] + t
            last = at == lengths[wrong[0]]
            chars = rows[wrong[0], at]
            found.append(_grown(far, _chosen(wrong, last), chars[last]))
            wrong = _joined([
                _grown(far, _chosen(wrong, ~last), chars[~last]),
                # another letter in this place
                _chosen(longer, other & ~over[which]),
                # no letter in this place: of equal letters the first is missing
                _chosen(clean, ~over & ((t == 0) | (here != rows[clean[0], heads[clean[0]] + t - 1]))),
            ])
            clean = _chosen(longer, same & ~over[which])
            t += 1
        done = _joined(found)
        return done[0], done[2]

    def _every_extension(self, ranks: Ranks, state) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Matches one character longer, by any: which match it was, the character, the new match."""
        _, low, _, size = state
        many = size > self.alphabet
        # few suffixes: the characters that stand there; many: every character
        few = np.flatnonzero(~many)
        count = size[few]
        which = np.repeat(few, count)
        place = np.repeat(low[few] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        pairs = np.concatenate([
            np.unique(which * 256 + ranks.last[place]),
            (np.flatnonzero(many)[:, None] * 256 + np.arange(self.alphabet)).ravel(),
        ])
        which, char = pairs >> 8, (pairs & 255).astype(np.uint8)
        longer, some = _extended(ranks, _chosen(state, which), char)
        return which[some], char[some], _chosen(longer, some)


def _chosen(state, rows: np.ndarray):
    return tuple(x[rows] for x in state)


def _joined(states):
    return tuple(np.concatenate(x) for x in zip(*states))


def _turned(state):
    """The same matches, to be extended on the other side."""
    return (state[0], state[2], state[1], state[3])


def _extended(ranks: Ranks, state, chars: np.ndarray):
    """Matches longer by a character each: (asked, interval here, interval in the other, size)."""
    asked, low, other, size = state
    start, start_less = ranks.before(low, chars)
    end, end_less = ranks.before(low + size, chars)
    longer = (asked, ranks.first[chars] + start, other + end_less - start_less, (end - start).astype(np.int64))
    return longer, end > start


def _grown(ranks: Ranks, state, chars: np.ndarray):
    """The same, without those that nothing matches."""
    longer, some = _extended(ranks, state, chars)
    return _chosen(longer, some)
