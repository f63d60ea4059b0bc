"""Quality by compression: how far a whole text and each of its chunks shrink.

Text that repeats itself shrinks far more than prose of its length, random
characters shrink hardly at all. The ratio also grows with the length of what is
compressed, so every length has its own limits (BANDS). A text is judged as a whole,
then chunk by chunk, so a long text cannot hide a bad part behind good ones:
it is rejected when more than CHUNK_SHARE of its chunks leave their band.

One pass over the texts without a shuffle; beside it come word and line counts
that a plain rule needs (``counts``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlynx.llm.tokens import slices

#: Compression level, and bytes of a chunk; a rest of less than half a chunk joins the one before.
LEVEL, CHUNK_BYTES = 3, 4096
#: (bytes up to which a band holds, least ratio, greatest ratio) of size to compressed size.
#: A frame of a few bytes holds little but its header, so the lower limits of short texts are low.
#: Prose of many languages lies near 1.0 at 100 bytes, 1.9 at 1,000 and 2.2 at 4,000.
BANDS = (
    (64, 0.0, 1.15), (128, 0.8, 1.5), (256, 0.9, 2.1), (512, 1.05, 2.4), (1024, 1.15, 2.6), (2048, 1.2, 2.8),
    (4096, 1.25, 3.0), (16384, 1.3, 3.4), (65536, 1.3, 4.0), (None, 1.3, 5.0),
)
#: Share of the chunks of a text that may lie outside their band.
CHUNK_SHARE = 0.2
PIECE_BYTES = 4_000_000
WINDOW = 5

VERDICT = ("ratio double, band int, n_chunks bigint, n_repetitive_chunks bigint, n_incompressible_chunks bigint, "
           "verdict string")
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def chunks(data: bytes, size: int = CHUNK_BYTES) -> list[bytes]:
    """``data`` in pieces of ``size`` bytes; the last one has between half and one and a half."""
    n = max(1, (len(data) + size // 2) // size)
    return [data[i * size:(i + 1) * size if i < n - 1 else len(data)] for i in range(n)]


class Judge:
    """Ratios against the limits of their length."""

    def __init__(self, bands: Sequence[tuple] = BANDS, level: int = LEVEL, chunk_bytes: int = CHUNK_BYTES,
                 chunk_share: float = CHUNK_SHARE):
        self.ends = np.array([b[0] or np.iinfo(np.int64).max for b in bands])
        self.limits = [(b[1], b[2]) for b in bands]
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=False).compress
        self.chunk_bytes, self.chunk_share = chunk_bytes, chunk_share

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.ends, size))

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.compress(data))

    def side(self, data: bytes, ratio: float) -> int:
        """1 above the band of its length, -1 below, 0 inside."""
        low, high = self.limits[self.band(len(data))]
        return (ratio > high) - (ratio < low)

    def __call__(self, text: str | None) -> tuple:
        data = (text or "").encode()
        if not data:
            return None, 0, 0, 0, 0, "empty"
        ratio = self.ratio(data)
        whole = self.side(data, ratio)
        parts = chunks(data, self.chunk_bytes)
        sides = [whole] if len(parts) == 1 else [self.side(p, self.ratio(p)) for p in parts]
        high, low = sides.count(1), sides.count(-1)
        allowed = self.chunk_share * len(parts)
        verdict = "repetitive" if whole > 0 else "incompressible" if whole < 0 \
            else "repetitive chunks" if high > allowed else "incompressible chunks" if low > allowed else "keep"
        return ratio, self.band(len(data)), len(parts), high, low, verdict


def with_bands(rows: DataFrame, text: Column, out: str = "bands", bands: Sequence[tuple] = BANDS,
               chunk_bytes: int = CHUNK_BYTES, chunk_share: float = CHUNK_SHARE) -> DataFrame:
    """``rows`` and a struct ``out``: the compression ``ratio`` of the whole text (UTF-8), the number of
    its ``band``, its ``n_chunks``, how many lie above and below their band, and the ``verdict``:
    ``keep``, ``repetitive`` or ``incompressible`` as a whole, or by more than ``chunk_share`` of its chunks.

    A null or empty text has no ratio and the verdict ``empty``. An input column
    named like ``out`` is replaced.
    """

    @F.pandas_udf(VERDICT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        fields = [f.split()[0] for f in VERDICT.split(", ")]
        return pd.DataFrame(list(map(Judge(bands, LEVEL, chunk_bytes, chunk_share), texts)), columns=fields)

    return rows.withColumn(out, judge(text))


def _repeated_words(texts: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Per text the words that lie in a run of ``window`` words found twice or more in it."""
    sizes = np.array([len(w) for w in texts], np.int64)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for words in texts for w in words]
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = len(flat) - window + 1
    covered = np.zeros(len(flat) + 1, np.int64)
    if n > 0:
        word = pd.factorize(flat)[0].astype(np.int64)
        # numbers of ever longer runs, equal only for equal words; runs of a text alone count
        run = word[:n]
        for k in range(1, window):
            run = pd.factorize(run * (word.max() + 1) + word[k:n + k])[0].astype(np.int64)
        inside = np.flatnonzero(owner[:n] == owner[window - 1:])
        code, _ = pd.factorize(run[inside] * len(texts) + owner[inside])
        again = inside[np.bincount(code)[code] > 1] if len(inside) else inside
        np.add.at(covered, again, 1)
        np.add.at(covered, again + window, -1)
    return np.bincount(owner[np.cumsum(covered)[:-1] > 0], minlength=len(texts))


def counts_of(texts: list[str | None]) -> pd.DataFrame:
    """The columns of COUNTS for some texts."""
    data = [(t or "").encode() for t in texts]
    words = [d.split() for d in data]  # parts at exactly the white space of a word border
    out = {"n_words": [len(w) for w in words], "word_chars": [], "n_symbols": [], "n_dup_lines": [],
           "n_repeat_words": _repeated_words(words)}
    for d in data:
        byte = np.frombuffer(d, np.uint8)
        begins = (byte & 0xC0) != 0x80  # bytes that begin a code point
        out["word_chars"].append(int(np.count_nonzero(begins & ~_BLANK[byte])))
        out["n_symbols"].append(int(np.count_nonzero(_SYMBOL[byte])))
        lines = [line for line in d.split(b"\n") if line.strip()] if b"\n" in d else []
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    return pd.DataFrame(out)


def with_counts(rows: DataFrame, text: Column, out: str = "counts") -> DataFrame:
    """``rows`` and a struct ``out`` with the columns of COUNTS.

    Words stand between white space (``[^\\x20\\x09-\\x0D]+``). ``word_chars``: code points in words.
    ``n_symbols``: characters of ``#*$%&|<>``. ``n_dup_lines``: lines with a word that equal an
    earlier line. ``n_repeat_words``: words in runs of five that the text holds twice or more, the first
    one included. A null or empty text has zeros. An input column named like ``out`` is replaced.
    """

    @F.pandas_udf(COUNTS)
    def count(texts: pd.Series) -> pd.DataFrame:
        every = texts.tolist()
        parts = [counts_of(every[a:b]) for a, b in slices(every, PIECE_BYTES)]
        return pd.concat(parts, ignore_index=True) if parts else counts_of([])

    return rows.withColumn(out, count(text))
