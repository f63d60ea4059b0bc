"""Periodic runs of words: stretches that repeat a short piece at least four times.

Whether and how far a text repeats itself at a distance q is a longest common
extension (LCE) of two of its positions. LCE answers come from a difference
cover: only suffixes that start at a residue of COVER modulo MODULUS are
sorted. For any two positions some shift below MODULUS brings both to such a
suffix; the words up to there are compared, the rest is a range minimum over
the common prefixes of neighbouring sorted suffixes (a sparse table).

Runs are found on a harmonic grid: for every period q the positions 0, q, 2q, ...
of a text are probed, n/1 + n/2 + n/3 + ... in all. A run of four periods holds
three of them, so none is missed.

Work is one pass over the texts without a shuffle. Texts of a batch are laid
end to end with a border between them that equals nothing, in pieces of
PIECE_BYTES, and a longer text is a piece of its own.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlynx.llm.tokens import slices

#: Residues of which every difference modulo MODULUS is one of two of them (a perfect
#: difference set, fixed values).
COVER, MODULUS = (0, 1, 3, 8, 12, 18), 31
PIECE_BYTES = 1_500_000
#: A run has at least this many words, and at least this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

RUN = "struct<start:bigint,length:bigint,period:bigint>"
RESULT = f"n_words bigint, runs array<{RUN}>, collapsed string"

_SAMPLED = np.isin(np.arange(MODULUS), COVER)
# least shift that brings residues a and b both into the cover
_SHIFT = np.array([[next(d for d in range(MODULUS) if _SAMPLED[(a + d) % MODULUS] and _SAMPLED[(b + d) % MODULUS])
                    for b in range(MODULUS)] for a in range(MODULUS)])


def _refined(rank: np.ndarray, open_: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order samples of equal rank by ``key``, in place; returns those that still share
    their rank. A rank is the number of samples that are less."""
    order = np.lexsort((key, rank[open_]))
    own, key = rank[open_][order], key[order]
    new_rank = np.concatenate([[True], own[1:] != own[:-1]])
    new_pair = new_rank | np.concatenate([[True], key[1:] != key[:-1]])
    place = np.arange(len(own))
    ahead = place[new_pair][np.cumsum(new_pair) - 1] - place[new_rank][np.cumsum(new_rank) - 1]
    size = np.diff(np.append(place[new_pair], len(own)))[np.cumsum(new_pair) - 1]
    rank[open_[order]] = own + ahead
    return open_[order[size > 1]]


class Extensions:
    """How many words two positions of ``ids`` have in common from there on.

    ``ids`` ends with a number that occurs nowhere else, so extensions end inside.
    """

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.position = np.flatnonzero(_SAMPLED[np.arange(len(ids)) % MODULUS])
        self.number = np.full(len(ids) + MODULUS, -1)
        self.number[self.position] = np.arange(len(self.position))
        levels = self._sort()
        self._measure(levels)

    def _sort(self) -> list[np.ndarray]:
        """Ranks of the sampled suffixes. Level k of the result tells suffixes apart by
        their first MODULUS * 2**k words."""
        at, ids = self.position, np.append(self.ids, np.full(MODULUS, -1))
        rank = np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        for k in range(MODULUS):  # by single words as long as suffixes are alike
            if not len(open_):
                break
            open_ = _refined(rank, open_, ids[at[open_] + k])
        levels, step = [rank.copy()], MODULUS
        while len(open_):  # by the ranks of the samples behind what is compared
            behind = at[open_] + step
            there = self.number[np.minimum(behind, len(self.ids))]
            open_ = _refined(rank, open_, np.where(there < 0, -1, levels[-1][there]))
            levels.append(rank.copy())
            step *= 2
        self.rank = rank
        return levels

    def _measure(self, levels: list[np.ndarray]) -> None:
        """Common prefixes of neighbours in the order of the samples, and their minima over
        1, 2, 4, ... neighbours."""
        order = np.empty_like(self.rank)
        order[self.rank] = np.arange(len(self.rank))
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = np.flatnonzero(levels[k][a] == levels[k][b])
            common[same] += MODULUS << k
            a[same], b[same] = (self.number[self.position[x[same]] + (MODULUS << k)] for x in (a, b))
        common += self._compared(self.position[a], self.position[b], np.full(len(a), MODULUS))
        self.minima = [common]
        while 2 << (len(self.minima) - 1) <= len(common):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, at most ``most``, word by word."""
        out = np.zeros(len(i), np.int64)
        live, k = np.flatnonzero(most > 0), 0
        while len(live):
            live = live[self.ids[i[live] + k] == self.ids[j[live] + k]]
            k += 1
            out[live] = k
            live = live[most[live] > k]
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Extension of each pair of different positions."""
        shift = _SHIFT[i % MODULUS, j % MODULUS]
        out = self._compared(i, j, shift)
        far = np.flatnonzero(out == shift)
        if len(far):
            a, b = (self.rank[self.number[x[far] + shift[far]]] for x in (i, j))
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            for k in np.unique(level):
                own = level == k
                table = self.minima[k]
                out[far[own]] += np.minimum(table[low[own]], table[high[own] - (1 << k)])
        return out


def _least_shared(period):
    """Words that a run has in common with itself one period on."""
    return np.maximum(LEAST_WORDS - period, (LEAST_PERIODS - 1) * period)


def find_runs(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period.

    Text t is ``ids[first[t]:first[t + 1] - 1]``, followed by a border number of
    its own; texts stand from the longest to the shortest, so those that are long
    enough for a period come first.
    """
    sizes = np.diff(first) - 1
    most = int(sizes[0]) // LEAST_PERIODS if len(sizes) else 0
    if sizes.size == 0 or sizes[0] < LEAST_WORDS:
        return np.zeros((0, 3), np.int64)
    extend = Extensions(ids)
    # period and end of a run that holds a position
    known_period, known_end = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    found = [np.zeros((0, 3), np.int64)]
    low = 1
    while low <= most:  # no period of such a range is a multiple of another one
        high = min(2 * low - 1, most)
        ends = first[np.searchsorted(-sizes, -LEAST_PERIODS * np.arange(low, high + 1), "right")]
        hits = []
        for q, end in zip(range(low, high + 1), ends):
            grid = ids[:end:q]
            hits.append(np.flatnonzero(grid[1:] == grid[:-1]) * q)
        period = np.repeat(np.arange(low, high + 1), [len(h) for h in hits])
        at = np.concatenate(hits)
        # inside a run of period p its multiples give the same stretch again
        p = known_period[at]
        new = (p == 0) | (period % np.maximum(p, 1) != 0) | (at + period >= known_end[at])
        at, period = at[new], period[new]
        shared = extend.forward(at, at + period)
        # a long enough stretch reaches that far from its first position on the grid
        keep = shared > _least_shared(period) - period
        at, period, end = at[keep], period[keep], (at + shared)[keep]
        order = np.lexsort((at, end, period))
        at, period, end = at[order], period[order], end[order]
        once = np.concatenate([[True], (period[1:] != period[:-1]) | (end[1:] != end[:-1])])[:len(at)]
        at, period, end = at[once], period[once], end[once]
        # the stretch begins after the grid position before: bisect for the farthest start
        # from which everything up to ``at`` is shared
        start, upper = np.maximum(at - period + 1, 0), at.copy()
        while (todo := np.flatnonzero(start < upper)).size:
            middle = (start[todo] + upper[todo]) // 2
            reaches = extend.forward(middle, middle + period[todo]) >= at[todo] - middle
            upper[todo] = np.where(reaches, middle, upper[todo])
            start[todo] = np.where(reaches, start[todo], middle + 1)
        long = end - start >= _least_shared(period)
        runs = np.stack([start, end - start + period, period], axis=1)[long]
        for s, n, q in runs.tolist():
            known_period[s:s + n], known_end[s:s + n] = q, s + n
        found.append(runs)
        low = high + 1
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # equal stretches: the smallest period counts
    least = np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])[:len(runs)]
    runs = runs[least]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text, given as its words."""
    sizes = np.array([len(w) for w in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = list(itertools.chain.from_iterable(texts[t] for t in order))
    codes, known = pd.factorize(flat)
    first = np.concatenate([[0], np.cumsum(sizes[order] + 1)])
    ids = np.empty(first[-1], np.int64)
    border = np.zeros(len(ids), bool)
    border[first[1:] - 1] = True
    ids[~border] = codes
    ids[border] = len(known) + np.arange(len(texts))
    runs = find_runs(ids, first)
    owner = np.searchsorted(first, runs[:, 0], "right") - 1
    runs[:, 0] -= first[owner]
    out: list[np.ndarray] = [runs[:0]] * len(texts)
    for t in np.unique(owner).tolist():
        out[order[t]] = runs[owner == t]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without what a run repeats after its first period."""
    if len(runs):
        keep = np.ones(len(words), bool)
        for start, length, period in runs.tolist():
            keep[start + period:start + length] = False
        words = list(itertools.compress(words, keep))
    return b" ".join(words)


def with_runs(rows: DataFrame, text: Column, out: str = "periodic") -> DataFrame:
    """``rows`` and a struct ``out``: ``n_words``, all ``runs`` of the text (word number of
    the start, length and smallest period in words, by start, then period) and ``collapsed``, its
    words joined by single spaces without those that a run repeats after its first period.

    Words stand between white space (``[^\\x20\\x09-\\x0D]+``) and differ by case. A
    run is as long as its period holds, has LEAST_PERIODS periods and LEAST_WORDS words
    or more; runs may overlap. A null, empty or blank text has no word, no run and an
    empty ``collapsed``. An input column named like ``out`` is replaced.
    """

    @F.pandas_udf(RESULT)
    def find(texts: pd.Series) -> pd.DataFrame:
        all_texts = texts.tolist()
        n, found, short = [], [], []
        for a, b in slices(all_texts, PIECE_BYTES):
            # bytes.split() parts at exactly the white space above
            words = [(t or "").encode().split() for t in all_texts[a:b]]
            for w, runs in zip(words, runs_of_texts(words)):
                n.append(len(w))
                found.append([{"start": s, "length": k, "period": q} for s, k, q in runs.tolist()])
                short.append(collapsed(w, runs).decode())
        return pd.DataFrame({"n_words": n, "runs": found, "collapsed": short})

    return rows.withColumn(out, find(text))


def strongest(runs: Column) -> Column:
    """The run with the greatest length per period, compared as fractions; of equal ones the
    first by start, then period. Null where there is none."""
    def better(best: Column, r: Column) -> Column:
        more = r["length"] * best["period"] > best["length"] * r["period"]
        return F.when(best.isNull() | more, r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)
