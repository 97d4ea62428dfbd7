"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams (1 to 3 letters of lower-cased words, with word edges),
in order. A document's own most frequent n-grams are compared to each profile by the out-of-place distance: the
sum of the differences of rank, or the profile's length where a language lacks the n-gram. Profiles are counted
over every training document; only the top n-grams of each language come to the driver.

A null text or one without letters is ``und`` with score 0. Ties between languages go to the name that sorts
first; ties between n-grams go by their letters. Repeated rows get equal results; without training rows every
prediction is ``und``; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewright.llm.common import arrow, crc_mod, table, unused

#: N-grams in a profile.
TOP = 400
UNDETERMINED = "und"
#: A filter also rejects texts farther from every language than this share of the greatest possible distance.
FARTHEST = 0.97
_LETTERS = regex.compile(r"\p{L}+")


@functools.cache
def letter_table() -> np.ndarray:
    """For every code point itself if it is a letter, or a space."""
    points = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    out = np.full(sys.maxunicode + 1, 32, np.int32)
    for m in _LETTERS.finditer(points):
        for c in m[0]:
            out[ord(c)] = ord(c)
    return out


def codes(text: str | None) -> np.ndarray:
    """The n-grams of all words as 64-bit numbers: three code points of 21 bits, the first letter highest; an edge is a space."""
    if not text:
        return np.empty(0, np.int64)
    c = letter_table()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)].astype(np.int64)
    letter = c != 32
    middle = np.flatnonzero(letter[1:-1]) + 1
    first = c[middle] << 42
    pairs = np.flatnonzero(letter[:-1] | letter[1:])
    return np.concatenate([first, c[pairs] << 42 | c[pairs + 1] << 21, c[middle - 1] << 42 | first >> 21 | c[middle + 1]])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)


def profiles(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> dict[str, list[int]]:
    """The ``top`` most frequent n-grams of each language, in order."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, waiting = defaultdict(list), defaultdict(list)
        size: dict[str, int] = defaultdict(int)

        def settle(lang: str) -> None:
            parts[lang].append(np.unique(np.concatenate(waiting.pop(lang)), return_counts=True))
            size[lang] = 0

        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = codes(text)
            waiting[lang].append(found)
            size[lang] += len(found)
            if size[lang] > 1_000_000:
                settle(lang)
        for lang in list(waiting):
            settle(lang)
        rows = [(lang, *_summed(p)) for lang, p in parts.items()]
        names = pa.array([lang for lang, k, _ in rows for _ in range(len(k))], pa.string())
        return pa.RecordBatch.from_arrays([names, *(pa.array(np.concatenate([r[i] for r in rows]), pa.int64()) for i in (1, 2))], ["lang", "code", "n"])

    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), text_col)
    counts = arrow(rows, run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    out: dict[str, list[int]] = defaultdict(list)
    for r in sorted(best.collect(), key=lambda r: (r.lang, r.place)):
        out[r.lang].append(r.code)
    return dict(out)


class Ranker:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, known: dict[str, list[int]], top: int = TOP):
        self.langs, self.top = sorted(known), top
        self.codes = np.unique(np.array([c for p in known.values() for c in p], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, known[lang])] = np.arange(len(known[lang]))

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (a half to 1: how much nearer it is than the runner-up) and distance (0 to 1) of a text."""
        found = codes(text)
        if not found.size or not self.langs:
            return UNDETERMINED, 0.0, 1.0
        keys, n = np.unique(found, return_counts=True)
        if len(n) > self.top:
            often = n >= np.partition(n, len(n) - self.top)[len(n) - self.top]
            keys, n = keys[often], n[often]
        keys = keys[np.argsort(-n, kind="stable")[: self.top]]
        at = np.searchsorted(self.codes, keys)
        at[at == len(self.codes)] = 0
        ranks = self.ranks[:, np.where(self.codes[at] == keys, at, len(self.codes))]
        far = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(keys)))).sum(axis=1) / (self.top * len(keys))
        best = int(far.argmin())
        second = float(np.delete(far, best).min()) if len(far) > 1 else 1.0
        score = 1.0 - 0.5 * float(far[best]) / second if second else 0.5
        return self.langs[best], score, float(far[best])


def predict(docs: DataFrame, known: dict[str, list[int]], *, text_col: str = "text", top: int = TOP) -> DataFrame:
    """``docs`` without the text, with lang_pred, score and distance. Only the text is an input of the prediction."""
    rest = [c for c in docs.columns if c != text_col]
    ranker = Ranker(known, top)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, distance = zip(*map(ranker.judge, batch.column(batch.num_columns - 1).to_pylist()), strict=True)
        new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(distance, pa.float64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*rest, "lang_pred", "score", "distance"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return arrow(docs.select(*(f"`{c}`" for c in rest), text_col), run, f"{kinds}, lang_pred string, score double, distance double")


def keep(docs: DataFrame, train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", farthest: float = FARTHEST) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in one of the languages learned from ``train``."""
    known, name = profiles(train, text_col=text_col, lang_col=lang_col), unused(docs, "input")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias(name))
    judged = predict(row, known, text_col=name)
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("distance") <= farthest)).select("row.*")


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(crc_mod(id_col, 4) != 2)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    known = profiles(training_rows(docs))
    rows = docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return predict(rows, known).select("doc_id", "held_out", "lang_pred", "score")
