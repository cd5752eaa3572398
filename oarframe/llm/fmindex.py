"""A bidirectional FM-index over a delimited vocabulary, searched for many words at once.

The text is every word between delimiters.  One index is kept for the text and one for its reverse;
an interval of suffix ranks is held in both, so that a match can grow to the left and to the right.
"""

from __future__ import annotations

import numpy as np

_END, _DELIMITER, _LETTER = 0, 1, 2  # symbols: end of text, delimiter, first letter
_STEP = 32  # ranks between two rows of counts
CHUNK = 1 << 16  # states that are extended together


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the suffixes of text in order; its last symbol is 0 and occurs nowhere else."""
    n, width, key = len(text), 1, text.astype(np.int64)

    def ahead(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x[width:], np.zeros(min(width, n), np.int64)])

    while symbols ** (2 * width) < 1 << 62:  # the first symbols in one number
        key, width = key * symbols**width + ahead(key), width * 2
    while True:
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if rank[order[-1]] == n - 1:
            return order
        key, width = rank * (n + 1) + ahead(rank + 1), width * 2


class _Direction:
    """The FM-index of one reading direction."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, np.int32(_END))
        self.suffixes = suffix_array(text, symbols)
        before = text[self.suffixes - 1]
        self.rows = np.concatenate([before, np.full(_STEP - len(before) % _STEP, symbols, before.dtype)])
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        blocks = self.rows.reshape(-1, _STEP)
        counts = np.zeros((len(blocks) + 1, symbols + 1), np.int32)
        np.add.at(counts, (np.repeat(np.arange(len(blocks)), _STEP) + 1, np.minimum(self.rows, symbols)), 1)
        counts = counts.cumsum(axis=0, dtype=np.int32)
        #: For the first rows of each block, how many symbols are less than c.
        self.less = np.concatenate([np.zeros((len(counts), 1), np.int32), counts.cumsum(axis=1, dtype=np.int32)[:, :symbols]], axis=1)

    def ranks(self, symbol: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Among the first rows: how many are the symbol, and how many are less."""
        block, rest = row // _STEP, row % _STEP
        here = self.rows[(block * _STEP)[:, None] + np.arange(_STEP)]
        counted = np.arange(_STEP) < rest[:, None]
        less = self.less[block, symbol].astype(np.int64)
        equal = self.less[block, symbol + 1] - less
        return equal + ((here == symbol[:, None]) & counted).sum(axis=1), less + ((here < symbol[:, None]) & counted).sum(axis=1)


class BidirectionalIndex:
    """Distinct words, given in code-point order."""

    def __init__(self, words: list[str]):
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) for w in words], np.int64)
        self.alphabet = np.unique(letters)
        self.symbols = len(self.alphabet) + _LETTER
        text = np.full(len(letters) + len(words) + 1, _DELIMITER, np.int32)
        #: Where the delimiter before each word stands.
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        place = np.arange(len(letters)) + np.repeat(np.arange(len(words)), lengths) + 1
        text[place] = np.searchsorted(self.alphabet, letters) + _LETTER
        self.size = len(text) + 1
        self.sides = (_Direction(text, self.symbols), _Direction(text[::-1], self.symbols))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Delimited symbols of each word, a row each, and the rows' lengths; letters that no indexed word has get a symbol of their own."""
        lengths = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        rows = np.full((len(words), int(lengths.max()) + 2), _DELIMITER, np.int32)
        inside = np.arange(rows.shape[1] - 2) < lengths[:, None]
        rows[:, 1:-1][inside] = np.where(self.alphabet[at] == letters, at + _LETTER, self.symbols)
        return rows, lengths + 2

    def extend(self, side: int, symbol: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals (lo for both directions, size) after one more symbol, to the left for side 0, to the right for side 1."""
        out_lo, out_size = np.zeros_like(lo), np.zeros_like(size)
        known = np.flatnonzero(symbol < self.symbols)
        for at in range(0, len(known), CHUNK):
            k = known[at : at + CHUNK]
            c, a = symbol[k], lo[side, k]
            equal, less = self.sides[side].ranks(c, a)
            equal_end, less_end = self.sides[side].ranks(c, a + size[k])
            out_lo[side, k] = self.sides[side].below[c] + equal
            out_lo[1 - side, k] = lo[1 - side, k] + less_end - less
            out_size[k] = equal_end - equal
        return out_lo, out_size

    def _branches(self, side: int, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, letter) of all letters that may come next: read from short intervals, all letters for long ones."""
        n_letters = self.symbols - _LETTER
        short = size <= n_letters
        state = np.repeat(np.flatnonzero(short), size[short])
        step = np.arange(len(state)) - np.repeat(np.cumsum(size[short]) - size[short], size[short])
        letter = self.sides[side].rows[lo[side, state] + step]
        pair = np.unique(state * self.symbols + letter)
        pair = pair[pair % self.symbols >= _LETTER]
        long = np.flatnonzero(~short)
        return (
            np.concatenate([pair // self.symbols, np.repeat(long, n_letters)]),
            np.concatenate([pair % self.symbols, np.tile(np.arange(_LETTER, self.symbols), len(long))]).astype(np.int32),
        )

    def one_error(self, words: list[str], exact: np.ndarray, mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of the indexed words that are one edit from a query and share its exact part.

        The exact part is a query's first letters, or its last ones if mirrored.  It is matched from
        the middle outwards, delimiter included; then the match grows across the other part, where
        one letter is replaced, left out or put in.  An edit with several equal places is made at the
        last of them, so every word is found once.
        """
        pattern, length = self.encode([w[::-1] for w in words] if mirrored else words)
        outward, across = (1, 0) if mirrored else (0, 1)
        n = len(words)
        lo, size, exact = np.zeros((2, n), np.int64), np.full(n, self.size, np.int64), np.asarray(exact) + 1
        query = np.arange(n)
        for step in range(int(exact.max())):  # the exact part
            growing = np.flatnonzero((exact > step) & (size > 0))
            lo[:, growing], size[growing] = self.extend(outward, pattern[growing, exact[growing] - 1 - step], lo[:, growing], size[growing])
        alive = size > 0
        query, lo, size, at, edited = query[alive], lo[:, alive], size[alive], exact[alive], np.zeros(int(alive.sum()), bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            wanted = pattern[query, at]
            following = pattern[query, np.minimum(at + 1, length[query] - 1)]
            parts = []
            # the wanted symbol
            next_lo, next_size = self.extend(across, wanted, lo, size)
            parts.append((query, next_lo, next_size, at + 1, edited))
            clean = np.flatnonzero(~edited)
            # the wanted letter is left out
            left = clean[(wanted[clean] != _DELIMITER) & (wanted[clean] != following[clean])]
            parts.append((query[left], lo[:, left], size[left], at[left] + 1, np.ones(len(left), bool)))
            # another letter replaces it, or comes before it
            state, letter = self._branches(across, lo[:, clean], size[clean])
            state = clean[state]
            other = letter != wanted[state]
            state, letter = state[other], letter[other]
            next_lo, next_size = self.extend(across, letter, lo[:, state], size[state])
            true = np.ones(len(state), bool)
            parts.append((query[state], next_lo, next_size, at[state], true))
            swap = wanted[state] != _DELIMITER
            parts.append((query[state][swap], next_lo[:, swap], next_size[swap], at[state][swap] + 1, true[swap]))
            query, size, at, edited = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4))
            lo = np.concatenate([p[1] for p in parts], axis=1)
            whole = (size > 0) & (at == length[query])
            hit = whole & edited
            position = self.sides[0].suffixes[lo[0, hit]]
            found.append((query[hit], np.searchsorted(self.starts, position)))
            on = (size > 0) & ~whole
            query, lo, size, at, edited = query[on], lo[:, on], size[on], at[on], edited[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))
