"""Quality rules whose cutoffs are certified on labelled documents.

Each rule rejects a document whose share of something (symbols, capitals, repeated lines, repeated words) is
large. One half of the labelled documents proposes, for every rule and stratum, the cutoff that tells low
quality from good best; the other half is held out to certify all rules of a stratum together: their cutoffs go down
step by step at once, from the largest share to what was proposed, and a step holds while the exact binomial bound on
the false rejections by any rule stays within the allowed risk. The error allowance is divided by the number of
strata (the order of steps is fixed by the proposing half, so each sequence counts once). A stratum with too few
labels (217 good ones held out, if none is rejected) certifies nothing and keeps its documents. Strata are classes of
length, so their number is fixed.

Nulls count as empty texts, which have no words and fail the base rules. Labels that are null or belong to no
document are ignored; repeated rows are judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.llm.common import arrow, stored, table, unused

#: Allowed false rejections among good documents of a stratum, and the probability with which that may fail.
MAX_FALSE_REJECTION, ERROR = 0.02, 0.05
#: Shares are compared on this many steps, evenly spaced in the square root of the share.
STEPS = 64
#: On the proposing half, a falsely rejected share counts as much as so many rightly rejected ones.
WEIGHT = 10.0
RULES = ("symbol_share", "upper_share", "dup_line_share", "repeat_share")
#: Upper ends of the strata, in words.
STRATA = (100, 400, 1600)
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_MEASURES = "n_words long, word_chars long, n_symbols long, n_upper long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text has twice or more."""
    n = len(words)
    m = n - width + 1
    if m < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, count()), np.int64, n)
    bits = max(1, (n - 1).bit_length())
    code, used = ids[:m], bits
    for j in range(1, width):
        if used + bits > 63:
            code, used = np.unique(code, return_inverse=True)[1].astype(np.int64), bits
        code, used = (code << bits) | ids[j : j + m], used + bits
    ordered = np.sort(code)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return 0
    at = np.flatnonzero(np.isin(code, twice))
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    edge[at + width] -= 1
    return int(np.count_nonzero(np.cumsum(edge)))


class Measures(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_upper: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int


def measure(data: bytes | None) -> Measures:
    """The measures of one text (UTF-8)."""
    if not data:
        return Measures(0, 0, 0, 0, 0, 0, 0)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    solid = b"".join(words)
    return Measures(len(words), len(solid.decode()), len(data.translate(None, _NOT_SYMBOL)), len(data.translate(None, _NOT_UPPER)), len(lines), len(lines) - len(set(lines)), repeat_words(words))


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col and the measures) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*map(measure, batch.column(1).to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], [id_col, *Measures._fields])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow(docs.select(id_col, F.col(text_col).cast("binary")), run, f"`{id_col}` {kind}, {_MEASURES}")


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def stratum():
    out = F.lit(len(STRATA))
    for i, top in reversed(list(enumerate(STRATA))):
        out = F.when(F.col("n_words") < top, i).otherwise(out)
    return out


def levels() -> dict:
    """The step of each rule's share: 0 to STEPS."""
    parts = {"symbol_share": ("n_symbols", "word_chars"), "upper_share": ("n_upper", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words")}
    return {rule: F.floor(STEPS * F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1))))).cast("int") for rule, (a, b) in parts.items()}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials with probability p, exactly; it is at most delta when the upper bound is at most p."""
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in log))


def propose(counts: dict[tuple, int]) -> dict[tuple[int, str], int]:
    """The wanted cutoff step of each (stratum, rule) that tells low quality from good.

    ``counts`` has the labelled documents of the proposing half by (stratum, quality, rule, step).
    """
    out = {}
    for s in range(len(STRATA) + 1):
        for rule in RULES:
            bad, good = (np.cumsum([counts.get((s, q, rule, i), 0) for i in range(STEPS + 1)][::-1])[::-1] for q in (0, 1))
            if not bad[0] or not good[0]:
                continue
            gain = bad / bad[0] - WEIGHT * good / good[0]
            wanted = int(np.flatnonzero(gain == gain.max())[-1])
            if gain[wanted] > 0 and wanted > 0:
                out[s, rule] = wanted
    return out


def certify(proposed: dict[tuple[int, str], int], held: dict[tuple[int, int | None], int], *, risk: float, error: float) -> dict[tuple[int, str], int]:
    """The certified cutoff step of each proposed (stratum, rule): a document goes when its step is at least that.

    ``held`` has the good documents held out by (stratum, steps below the largest at which some rule rejects them, or None).
    """
    out, strata = {}, range(len(STRATA) + 1)
    for s in strata:
        n, false, certified = sum(k for (at, _), k in held.items() if at == s), 0, None
        for below in range(STEPS + 1 if n else 0):
            false += held.get((s, below), 0)
            if binomial_tail(false, n, risk) > error / len(strata):
                break
            certified = below
        if certified is not None:
            out |= {(at, rule): max(step, STEPS - certified) for (at, rule), step in proposed.items() if at == s}
    return out


def fit(measured: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", risk: float = MAX_FALSE_REJECTION, error: float = ERROR) -> dict[tuple[int, str], int]:
    """Certified cutoffs from all labelled documents that pass the base rules.

    Only counts by stratum, quality, rule and step come to the driver, a fixed number.
    """
    known = labels.where("quality in (0, 1)").select(id_col, "quality")
    held = (F.xxhash64(F.col(id_col)) % 2 == 0).cast("int")
    rows = stored(measured.where(~base_failed()).join(known, id_col).select(stratum().alias("s"), held.alias("held"), "quality", *(x.alias(r) for r, x in levels().items())), "labelled")
    steps = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES))).alias("x")
    found = rows.where("held = 0").select("s", "quality", steps).groupBy("s", "quality", "x.rule", "x.step").count().collect()
    proposed = propose({(r.s, r.quality, r.rule, r.step): r["count"] for r in found})
    if not proposed:
        return {}
    below = F.array_min(F.array(*(F.when((F.col("s") == s) & (F.col(rule) >= step), STEPS - F.col(rule)) for (s, rule), step in proposed.items())))
    found = rows.where("held = 1 and quality = 1").groupBy("s", below.alias("below")).count().collect()
    return certify(proposed, {(r.s, r.below): r["count"] for r in found}, risk=risk, error=error)


def verdict(cutoffs: dict[tuple[int, str], int]):
    """The column ``kept`` over measures."""
    steps, rejected = levels(), F.lit(False)
    for (s, rule), step in sorted(cutoffs.items()):
        rejected = rejected | ((stratum() == s) & (steps[rule] >= step))
    return ~base_failed() & ~rejected


def judged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every row; the texts are read once."""
    measured = stored(measures(docs, id_col=id_col, text_col=text_col), "quality")
    return measured.withColumns({"base_failed": base_failed(), "kept": verdict(fit(measured, labels, id_col=id_col))})


def keep(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep. No text is shuffled: each is measured again."""
    cutoffs = fit(measures(docs, id_col=id_col, text_col=text_col), labels, id_col=id_col)
    schema, name = docs.schema, unused(docs, "measures")
    packed = docs.select("*", F.col(text_col).cast("binary").alias(name))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*map(measure, batch.column(batch.num_columns - 1).to_pylist()), strict=True))
        found = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(Measures._fields))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], name])

    fields = ", ".join(f"{x.split()[0]}: bigint" for x in _MEASURES.split(", "))
    out = arrow(packed, run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, `{name}` struct<{fields}>")
    flat = {f: F.col(f"`{name}`.{f}") for f in Measures._fields}
    # the rules read the measures by name; a struct keeps them apart from the documents' own columns
    kept = out.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(v.alias(k) for k, v in flat.items())).where(verdict(cutoffs))
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(docs, table(spark, sf_dir, "labels")).select(*columns)
