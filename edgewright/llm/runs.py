"""Periodic runs of words by a suffix tree: branching tandem repeats from smaller halves, rotated and merged into runs.

A run of ``SHORTEST`` words or more, and of two periods, repeats each of its windows of ``WINDOW`` words within its
document, so it lies in one stretch of words that such windows cover. Every stretch gets its suffix tree: the nested
intervals of a suffix array and its common prefixes, which is that tree with its leaves in order. Leaves below an inner
node of depth d, except those of a child with over half of them, are tested for a tandem repeat of period d that starts
d words before them or with them (each leaf has at most log n such nodes); a repeat branches where the word after it
breaks its period. Each is rotated to the left for as long as the period holds, and becomes the run that ends there;
runs of the same words merge into the one with the smallest period.

The tables of ranks of substrings of 1, 2, 4 ... words, from which the suffix array comes, also answer how far two
places agree, so all steps are array operations on a batch of documents. Memory is linear in a batch's stretches times
the logarithm of the longest of them; batches hold about 4 MB of text, or one longer text. Nothing is shuffled, so a
lost executor costs its own tasks.

Null, empty and blank texts have no words and no runs. Repeated rows get equal results, runs that start at one word
are listed by period, extra columns are ignored, and an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.llm.common import arrow, table

#: The least words of a run, and of a window that repeats inside each one: SHORTEST less its longest period below that.
SHORTEST, WINDOW = 12, 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def stretches(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that repeated windows of a document cover; ``ends`` are the documents' ends.

    Windows are compared by a hash, so a stretch may be too long or too many, but no repeated window is missed.
    """
    n, m = len(ids), len(ids) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if m < 2:
        return none, none
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    with np.errstate(over="ignore"):
        word = ids.astype(np.uint64) + np.uint64(1)
        code = np.zeros(m, np.uint64)
        for j in range(WINDOW):
            code = (code ^ (code >> np.uint64(29))) * _MIX + word[j : j + m]
        code = (code ^ (code >> np.uint64(31))) * _MIX + doc[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
    at = at[np.argsort(code[at])]
    code = code[at]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = code[1:] == code[:-1]
    at = at[same[1:] | same[:-1]]
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    covered = np.cumsum(edge)[:n] > 0
    starts = covered & np.r_[True, ~covered[:-1] | (doc[1:] != doc[:-1])]
    last = covered & np.r_[~covered[1:] | (doc[1:] != doc[:-1]), True]
    begin, end = np.flatnonzero(starts), np.flatnonzero(last) + 1
    long = end - begin >= SHORTEST
    return begin[long], end[long]


def ranked(word: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of ``word``, whose stretches end in numbers that occur once, and its tables of ranks: entry k has
    for every place the rank of the 2**k words there, the same for the same words. Places that differ keep their rank,
    so only those that still tie are sorted again."""
    n = len(word)
    order = np.argsort(word, kind="stable")
    key = word[order]
    head = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tables, step = [rank], 1
    while True:
        tied = ~(head & np.r_[head[1:], True])
        place = np.flatnonzero(tied)
        if not place.size:
            return order, tables
        some = order[place]
        # a tie can't reach beyond the end of its stretch, whose last number occurs once
        pair = rank[some] * (n + 1) + rank[some + step]
        by = np.argsort(pair, kind="stable")
        some, pair = some[by], pair[by]
        order[place] = some
        head = head.copy()
        head[place] = np.r_[True, pair[1:] != pair[:-1]]
        rank = rank.copy()
        rank[some] = np.maximum.accumulate(np.where(head[place], place, 0))
        tables.append(rank)
        step *= 2


def agreeing(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words agree from the places ``a`` and ``b`` on (a != b), from the longest table to the shortest."""
    n, far = len(tables[0]), np.zeros(len(a), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        x, y = a + far, b + far
        inside = np.maximum(x, y) < n
        far += np.where(inside & (tables[k][np.minimum(x, n - 1)] == tables[k][np.minimum(y, n - 1)]), 1 << k, 0)
    return far


def agreeing_before(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words agree before the places ``a`` < ``b``."""
    far = np.zeros(len(a), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        x = a - far - (1 << k)
        far += np.where((x >= 0) & (tables[k][np.maximum(x, 0)] == tables[k][np.maximum(b - far - (1 << k), 0)]), 1 << k, 0)
    return far


def nearest_smaller(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry the nearest places with a smaller one to its left and right; the ends must be the smallest. Places
    jump over what their target has jumped over, all at once, so there are few rounds."""
    n = len(value)
    out = []
    for to in (np.arange(n) - 1, np.arange(n) + 1):
        to[0], to[-1] = 0, n - 1
        todo = np.arange(1, n - 1)
        while True:
            todo = todo[value[to[todo]] >= value[todo]]
            if not todo.size:
                break
            to[todo] = to[to[todo]]
        out.append(to)
    return out[0], out[1]


def branching_repeats(order: np.ndarray, tables: list[np.ndarray], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every tandem repeat whose next word breaks its period."""
    n = len(order)
    place = tables[-1]
    common = agreeing(tables, order[:-1], order[1:])
    # entry i is the depth at which leaves i-1 and i part; entries at both ends close the root
    depth = np.r_[-1, common, -1]
    left, right = nearest_smaller(depth)
    # an inner node is an interval of leaves [left, right) with a depth; equal intervals are one node
    inner = np.arange(1, n)
    code, node_of = np.unique(left[inner] * (n + 1) + right[inner], return_inverse=True)
    lo, hi = code // (n + 1), code % (n + 1)
    deep = np.empty(len(code), np.int64)
    deep[node_of] = depth[inner]
    node_at = np.r_[-1, node_of, -1]
    above = np.where(depth[lo] >= depth[hi], node_at[lo], node_at[hi])  # -1 for the root
    size = hi - lo
    # heavy nodes, with over half of what is below the node above them, hand over to the end of their chain
    top = np.arange(len(code))
    heavy = (above >= 0) & (2 * size > size[np.maximum(above, 0)])
    top[heavy] = above[heavy]
    while not np.array_equal(further := top[top], top):
        top = further
    # leaves begin below the deeper of their two neighbours' nodes; of two leaves none is over half
    at = np.where(depth[:-1] >= depth[1:], node_at[:-1], node_at[1:])
    leaf = np.arange(n)
    starts, periods = [], []
    while leaf.size:
        keep = at >= 0
        leaf, at = leaf[keep], at[keep]
        d = deep[at]
        some = d > 0
        i, v, d = order[leaf[some]], at[some], d[some]
        for first in (i, i - d):
            second = first + d
            ok = (first >= 0) & (second + d < n)
            f, s, node, dd = first[ok], second[ok], v[ok], d[ok]
            other = place[np.where(f == i[ok], s, f)]
            ok = (other >= lo[node]) & (other < hi[node])
            f, s, dd = f[ok], s[ok], dd[ok]
            ok = word[s] != word[s + dd]
            starts.append(f[ok])
            periods.append(dd[ok])
        at = above[top[at]]
    return np.concatenate(starts), np.concatenate(periods)


def runs(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(start, length, period) rows of the maximal runs of documents laid end to end, by start and period."""
    begin, end = stretches(ids, ends)
    none = np.zeros((0, 3), np.int64)
    if not begin.size:
        return none
    # stretches, each followed by a number of its own
    size = end - begin + 1
    offset = np.r_[0, np.cumsum(size)]
    home = np.repeat(np.arange(len(begin)), size)
    source = np.minimum(np.arange(offset[-1]) - offset[home] + begin[home], len(ids) - 1)
    word = ids[source].astype(np.int64)
    word[offset[1:] - 1] = int(ids.max()) + 1 + np.arange(len(begin))
    order, tables = ranked(word)
    start, period = branching_repeats(order, tables, word)
    if not start.size:
        return none
    start, period = np.divmod(np.unique(start * len(word) + period), len(word))
    finish = start + 2 * period
    start = start - agreeing_before(tables, start, start + period)
    length = finish - start
    keep = length >= np.maximum(SHORTEST, 2 * period)
    found = np.stack([start, length, period], 1)[keep]
    # of the same words the smallest period counts
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)] if len(found) else np.zeros(0, bool)
    found = found[first]
    found[:, 0] = source[found[:, 0]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def looped(n: int, a: int, p: int) -> np.ndarray:
    """Places of words when those from ``a`` on repeat the first ``p`` of them."""
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def altered(doc_id: int | None, n: int) -> np.ndarray | None:
    """The places of words of a document that the query's contract alters, None for others."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % n
    return looped(n, a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


_NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words", "n_dropped", "runs", "collapsed")


def _found(batch: pa.RecordBatch, alter: bool, whole: bool) -> pa.RecordBatch:
    words, ends, places, total = [], [], [], 0
    seen: dict[bytes, int] = {}
    fresh = count()
    parts = []
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        own = text.split() if text else []
        ids = np.fromiter(map(seen.setdefault, own, fresh), np.int64, len(own))
        place = altered(doc_id, len(own)) if alter else None
        if place is not None:
            ids = ids[place]
        total += len(own)
        words.append(own)
        ends.append(total)
        places.append(place)
        parts.append(ids)
    found = runs(np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(ends, np.int64))
    bounds = np.searchsorted(found[:, 0], np.r_[0, ends]) if ends else []
    columns: list[list] = [[] for _ in range(len(_NAMES) - 1)]
    for i, (own, place) in enumerate(zip(words, places, strict=True)):
        begin, n = ends[i] - len(own), len(own)
        here = found[bounds[i] : bounds[i + 1]] - np.array([begin, 0, 0])
        dropped = np.zeros(n, bool)
        if len(here):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, here[:, 0] + here[:, 2], 1)
            np.add.at(edge, here[:, 0] + here[:, 1], -1)
            dropped = np.cumsum(edge)[:n] > 0
            longest = here[np.lexsort((here[:, 2], here[:, 0], -here[:, 1]))[0]].tolist()
        left = own
        if place is not None or len(here):
            left = [own[j] for j in (np.arange(n) if place is None else place)[~dropped].tolist()]
        text = b" ".join(left)
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in here.tolist())
        row = (
            len(here), *(longest if len(here) else (None,) * 3), 1000 * longest[1] // longest[2] if len(here) else None, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(text).hexdigest(), n, int(dropped.sum()), here.tolist() if whole else None, text.decode() if whole else None,
        )
        for column, x in zip(columns, row, strict=True):
            column.append(x)
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()]
    arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, names=list(_NAMES))


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    return _found(batch, True, False)


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    return _found(batch, False, True)


_SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long, runs array<array<bigint>>, collapsed string"


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_runs, runs, n_dropped, collapsed): each text's maximal runs as [start, length, period] in
    words, and the text without the words that a run repeats after its first period."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = arrow(rows, _whole, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}", rows=4096)
    return found.select(F.col("doc_id").alias(id_col), "n_words", "n_runs", "runs", "n_dropped", "collapsed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document; those whose contract says so are altered first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return arrow(docs, _digest, f"doc_id long, {_SCHEMA}", rows=4096).select(*_NAMES[:10])
