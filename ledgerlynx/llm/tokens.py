"""Words and shingles of many texts at once, as 64-bit numbers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# white space of a word border; A-Z folded to lower case
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))


def _powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(out)
    return have[:n]


@dataclass
class Words:
    """Words of a batch of texts. ``hash`` of word i; the words of text t are
    ``first[t]:first[t + 1]``; ``start``/``end`` are byte positions in ``data``."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def words(texts: list[str | None]) -> Words:
    """Words between white space, A-Z as a-z; a null text has none.

    The hash of a word is a polynomial of its bytes; equal words have equal
    hashes, different ones differ but for a chance of about 2**-64.
    """
    parts = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends_of_text = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    data = _FOLD[data]
    inside = np.concatenate([[False], ~_BLANK[data]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = change[0::2], change[1::2]
    # sum of value(byte) * STEP**position; a difference of sums, moved back by its start
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers(_STEP, len(data)), out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * _powers(_BACK, len(data))[start])
    first = np.concatenate([[0], np.searchsorted(start, ends_of_text)])
    return Words(hashes, first, start, end, data)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and the borders between texts.

    A text of fewer words has its whole as the only shingle; one without words has none.
    """
    n = np.diff(w.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(w.first[:-1] - first[:-1], count) + np.arange(first[-1])
    size = np.repeat(np.minimum(n, k), count)
    out = size.astype(np.uint64)
    for j in range(k):
        own = size > j
        out[own] = mixed(out[own] * np.uint64(_STEP) + w.hash[at[own] + j])
    return out, first


def slices(texts: list, most_bytes: int):
    """Positions ``a, b`` that cut a batch into pieces of about ``most_bytes`` characters."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most_bytes:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
