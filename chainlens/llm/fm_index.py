"""FM-index over word symbols (numpy): suffix array, wavelet matrix, backward search, locate.

The text is a sequence of runs; every run is followed by the separator 0, words are 1..sigma.
Separators sort by position, below all words, so the suffix order is total and no search or
locate step crosses a run.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in ascending order (prefix doubling)."""
    n = len(text)
    sep = text == 0
    n_sep = int(sep.sum())
    rank = text.astype(np.int64) + n_sep
    rank[sep] = np.arange(n_sep)
    order = np.argsort(rank, kind="stable")
    k = 1
    while True:
        sorted_rank = rank[order]
        fresh = np.empty(n, dtype=np.int64)
        steps = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])])
        fresh[order] = steps
        if n == 0 or steps[-1] == n - 1:
            return order
        after = np.zeros(n, dtype=np.int64)
        after[:n - k] = fresh[k:] + 1
        rank = fresh * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        k *= 2


class WaveletMatrix:
    """Rank queries over a symbol sequence: one bit vector with running counts per bit of the alphabet."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma).bit_length())
        self.ones, self.zeros = [], []
        cur = seq
        for level in range(self.bits - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(np.int32)
            self.ones.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(cur) - int(self.ones[-1][-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``c`` before position ``i`` (element by element)."""
        first = np.zeros_like(i)
        i = i.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            one_i, one_f = ones[i], ones[first]
            i = np.where(up, zeros + one_i, i - one_i)
            first = np.where(up, zeros + one_f, first - one_f)
        return i - first


class FmIndex:
    def __init__(self, text: np.ndarray, sigma: int):
        self.n = len(text)
        sa = suffix_array(text)
        self.bwt = text[sa - 1] if self.n else text
        counts = np.bincount(text, minlength=sigma + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.wavelet = WaveletMatrix(self.bwt, sigma)
        run_start = np.zeros(self.n, dtype=bool)
        run_start[1:] = text[:-1] == 0
        run_start[:1] = True
        self.sampled = (run_start | (np.arange(self.n) % SAMPLE == 0))[sa]
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def _step(self, c, rows):
        return self.before[c] + self.wavelet.rank(c, rows)

    def search(self, phrases: np.ndarray, lengths: np.ndarray):
        """Suffix range ``[lo, hi)`` of every phrase (rows of ``phrases``, right-padded)."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((back < lengths) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, lengths[live] - 1 - back]
            lo[live], hi[live] = self._step(c, lo[live]), self._step(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: walk back until a sampled one."""
        rows = rows.copy()
        walked = np.zeros(len(rows), dtype=np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            rows[open_] = self._step(self.bwt[rows[open_]], rows[open_])
            walked[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return self.samples[self.sample_at[rows]] + walked
