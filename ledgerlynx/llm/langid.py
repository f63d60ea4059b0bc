"""Language of texts by error-correcting output codes."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlynx.llm.common import give_back_memory
from ledgerlynx.llm.tokens import slices

#: n-gram lengths in bytes, slots of the hashed n-grams, and bits of a random code.
GRAMS, SLOTS, RANDOM_BITS = (1, 2, 3, 4), 1 << 16, 48
#: Characters that are scored together in a task.
SLICE = 1 << 20
#: A text is ambiguous if the best codeword's share is below this.
CERTAIN = 0.5

# letters and bytes of letters beyond ASCII stay, in lower case; all else is a border
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_LETTER = re.compile(r"[^\W\d_]")


def codewords(n: int, random_bits: int = RANDOM_BITS) -> np.ndarray:
    """A row of +1 / -1 bits for each of ``n`` languages.

    Up to 7 languages: every way to part them in two (an exhaustive code).
    Beyond: the best of seeded random codes by the least distance of two rows.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([(1,) + c for c in itertools.product((1, -1), repeat=n - 1) if -1 in c], float).T
    rng = np.random.default_rng(0)
    best, far = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, random_bits))
        near = ((code[:, None, :] != code[None, :, :]).sum(2) + random_bits * np.eye(n)).min() \
            if n <= 400 else 0
        if near > far and (abs(code.sum(0)) < n).all():
            best, far = code, near
    return best


def gram_slots(data: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Slot of the n-gram that ends at each byte of ``data``; slot 0 holds those that
    are blank or run over a border of words by more than their last blank."""
    size = len(data)
    out = np.zeros(size, np.int64)
    if size < n:
        return out
    value = np.zeros(size - n + 1, np.uint32)
    for j in range(n):
        value = value * np.uint32(257) + data[j:size - n + 1 + j]
    letter = data != 32
    real = letter[:size - n + 1] | letter[n - 1:]
    for j in range(1, n - 1):
        real &= letter[j:size - n + 1 + j]
    spread = (value * np.uint32(2654435761) + np.uint32(n * 97)) >> np.uint32(8)
    out[n - 1:] = np.where(real, 1 + spread % np.uint32(slots - 1), 0)
    return out


def _prepared(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts in one array, and where each text ends."""
    parts = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    ends = np.cumsum([len(p) + 4 for p in parts])
    return _LETTERS[np.frombuffer(b"\n\n\n\n".join(parts) + b"\n\n\n\n", np.uint8)], ends


def _counter(langs_at: dict[str, int], slots: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(langs_at), slots), np.int64)
        for batch in batches:
            for lang, texts in batch.groupby("lang", sort=False)["text"]:
                texts = list(texts)
                for a, b in slices(texts, SLICE):
                    data, _ = _prepared(texts[a:b])
                    for n in GRAMS:
                        total[langs_at[lang]] += np.bincount(gram_slots(data, n, slots), minlength=slots)
        total[:, 0] = 0
        lang, slot = np.nonzero(total)
        for a in range(0, len(lang), 1 << 16):
            x, y = lang[a:a + (1 << 16)], slot[a:a + (1 << 16)]
            yield pd.DataFrame({"lang": x, "slot": y, "n": total[x, y]})
        give_back_memory()
    return count


@dataclass
class LanguageModel:
    """``weight[slot, bit]``: log odds of each bit given an n-gram; ``accuracy`` weighs the bits."""

    langs: list[str]
    code: np.ndarray
    weight: np.ndarray
    accuracy: np.ndarray
    scale: float

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Mean log odds of each bit over the n-grams of each text."""
        data, ends = _prepared(texts)
        starts = np.concatenate([[0], ends[:-1]])
        total, n_grams = np.zeros((len(texts), self.weight.shape[1])), np.zeros(len(texts))
        for n in GRAMS:
            slot = gram_slots(data, n, len(self.weight))
            n_grams += np.add.reduceat(slot != 0, starts, dtype=np.int64)
            for bit in range(self.weight.shape[1]):
                total[:, bit] += np.add.reduceat(self.weight[:, bit][slot], starts, dtype=np.float64)
        return total / np.maximum(n_grams, 1)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Logistic loss of each codeword, bits weighed by their accuracy in training."""
        signed = margins[:, None, :] * self.code[None, :, :] * self.scale
        return (np.logaddexp(0, -signed) * self.accuracy).sum(2) / self.accuracy.sum()

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Nearest codeword and its share (softmax over losses) for each text."""
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, scores
        for a, b in slices(texts, SLICE):
            loss = self.losses(self.margins(texts[a:b]))
            share = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
            share /= share.sum(1, keepdims=True)
            for i, best in enumerate(loss.argmin(1)):
                text = texts[a + i]
                if text and _LETTER.search(text):
                    langs[a + i], scores[a + i] = self.langs[best], share[i, best]
        return langs, scores


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
          slots: int = SLOTS) -> LanguageModel:
    """Classifiers of the codeword bits from all ``labelled`` rows with a language.

    Each task counts hashed n-grams per language, Spark adds the counts up; the
    sums (languages times slots, whatever the size of the table) make the
    weights. A bit's classifier gives an n-gram the smoothed log odds of the
    languages whose codeword has the bit, each language counting the same.
    """
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")) \
        .where("text IS NOT NULL AND lang IS NOT NULL")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not langs:
        return LanguageModel([], np.ones((0, 1)), np.zeros((slots, 1), np.float32), np.ones(1), 1.0)
    counts = rows.mapInPandas(_counter({x: i for i, x in enumerate(langs)}, slots),
                              "lang int, slot int, n long")
    table = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((len(langs), slots))
    seen[table["lang"], table["slot"]] = table["n"]
    share = (seen + 0.5) / (seen.sum(1, keepdims=True) + 0.5 * slots)
    code = codewords(len(langs))
    weight, accuracy = np.zeros((slots, code.shape[1]), np.float32), np.ones(code.shape[1])
    for bit in range(code.shape[1]):
        one, zero = share[code[:, bit] > 0], share[code[:, bit] < 0]
        if len(one) and len(zero):
            weight[:, bit] = np.log(one.mean(0) / zero.mean(0))
            # expected accuracy per n-gram: how far apart the two sides are
            accuracy[bit] = 0.5 + 0.25 * abs(one.mean(0) - zero.mean(0)).sum()
    weight[0] = 0
    # the typical size of a mean log odds, so that losses are on one scale
    typical = np.abs((share[:, :, None] * weight[None, :, :]).sum(1)).mean() or 1.0
    return LanguageModel(langs, code, weight, accuracy, float(2.0 / typical))


def with_language(rows: DataFrame, text: Column, model: LanguageModel) -> DataFrame:
    """``rows`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. Whole texts are read; ties go to the first language by name.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            langs, scores = shared.value.predict(list(part))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
        give_back_memory()

    out = rows.withColumn("__found", predict(text))
    return out.select(*[f"`{c}`" for c in rows.columns], "__found.lang_pred", "__found.score",
                      ((F.col("__found.score") < CERTAIN) & (F.col("__found.lang_pred") != "und"))
                      .alias("ambiguous"))
