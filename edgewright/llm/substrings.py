"""Repeated passages across documents by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash among its runs of ``SEED`` words.
Consecutive windows with the same minimiser travel as one packed string (their words joined by spaces) to the
minimiser's bucket, so a passage costs little more than its own text instead of one copy per window. Of equal strings
of one batch only the smallest document's travels, as the others repeat it for certain; the strings of a batch for
one bucket travel as one compressed block, and the number of buckets follows the size of the corpus. A bucket's strings
that have their minimiser alone repeat nothing and stay packed, unless the bucket is larger than a worker may hold.
Spark sorts the others by minimiser and by doc_id (spilling as it needs), so the first string that holds a window
belongs to the smallest document that has it: a window that comes again from another document is a repeat, exactly,
by its words. Only places come back to the documents, which drop the covered words.

A minimiser that very many strings share would be one task's work. So minimisers are counted first, over all texts,
and the windows of such a one are parted by the hash of all their words instead of it.

Null and empty texts have no words and remove nothing. Texts shorter than a window are kept whole. Repeats inside
one document stay, and so do rows that repeat a doc_id. An empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.llm.common import arrow, begun, lean, most_frequent, parts, released, split_words, stored, table, unused

WINDOW, SEED = 13, 3
#: Bytes of text whose strings share a bucket, on average.
BUCKET_BYTES = 6_000_000
#: Strings of one minimiser beyond which its windows part by all their words; at most so many minimisers do.
HEAVY, MOST_HEAVY = 20_000, 100_000
#: Runs of a batch that a minimiser needs there to be counted.
OFTEN = 8
#: Compressed bytes of a bucket that a worker holds to leave out the runs that have their minimiser alone; none of a larger one are.
HELD_BYTES = 24_000_000
#: Level of the blocks' compression.
ZSTD = 3
#: What travels of a run, beside the bucket's number and 32 bits of the minimiser (more that share them only sort
#: together). Strings have the places of one document. Blocks without keys have places that are repeats for certain:
#: documents, first words, words after the last.
_SENT = pa.schema([("packed", pa.binary()), ("doc", pa.int64()), ("starts", pa.list_(pa.int32()))])
_NAMES = ["minimiser", *_SENT.names]
#: A string in Arrow's layout of views.
_VIEW = np.dtype([("length", np.int32), ("prefix", np.uint8, 4), ("buffer", np.int32), ("offset", np.int32)])
_SPREAD = np.random.default_rng(20_240_603).integers(1, 2**63, WINDOW, np.uint64) | np.uint64(1)


def _runs(hashed: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words."""
    m = len(hashed) - width + 1
    total = np.zeros(m, np.uint64)
    for j in range(width):
        total += hashed[j : j + m] * _SPREAD[j]
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def minimisers(hashed: np.ndarray, heavy: np.ndarray | None = None) -> np.ndarray:
    """The minimiser of each window of words with these hashes; the window's own hash where the minimiser is a ``heavy`` one."""
    low, span = _runs(hashed, SEED), 1  # least of ``span`` seeds in a row
    width = WINDOW - SEED + 1
    while 2 * span <= width:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    if heavy is not None and heavy.size:
        shared = heavy[np.minimum(np.searchsorted(heavy, low), heavy.size - 1)] == low
        if shared.any():
            low = np.where(shared, _runs(hashed, WINDOW), low)
    return low


class Runs(NamedTuple):
    """The runs of windows with one minimiser of a batch's texts, in order."""

    keys: np.ndarray  # minimisers
    docs: np.ndarray
    starts: np.ndarray  # first words in their texts
    words: np.ndarray  # how many
    begins: np.ndarray  # first bytes in ``joined``
    ends: np.ndarray
    joined: pa.Buffer  # the words of all texts, a space after each

    def packed(self, rows: np.ndarray) -> pa.Array:
        """The words of these runs joined by spaces."""
        views = np.zeros(len(rows), _VIEW)  # a string of 12 bytes or less would lie in its view; 13 words are longer
        views["length"] = self.ends[rows] - self.begins[rows]
        views["offset"] = self.begins[rows]
        data = np.frombuffer(self.joined, np.uint8)
        for i in range(4):
            views["prefix"][:, i] = data[self.begins[rows] + i]
        return pa.Array.from_buffers(pa.binary_view(), len(rows), [None, pa.py_buffer(views), self.joined]).cast(pa.binary())


def runs(batch: pa.RecordBatch, heavy: np.ndarray | None = None) -> Runs | None:
    """The runs of a batch (doc, text as binary); none, where no text has a window."""
    batch = batch.filter(batch.column(0).is_valid())
    distinct, codes, n = split_words(batch.column(1))
    if len(codes) < WINDOW:
        return None
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, distinct.to_numpy(zero_copy_only=False)), np.uint64, len(distinct))[codes]
    text = np.repeat(np.arange(len(n)), n)
    inside = np.flatnonzero(text[: 1 - WINDOW] == text[WINDOW - 1 :])  # the windows within one text
    if not inside.size:
        return None
    least, own = minimisers(hashed, heavy)[inside], text[inside]
    cuts = np.flatnonzero((least[1:] != least[:-1]) | (own[1:] != own[:-1])) + 1
    head = np.concatenate([[0], cuts])
    first, last = inside[head], inside[np.append(cuts, len(inside)) - 1] + WINDOW
    at = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(pc.binary_length(distinct).to_numpy()[codes] + 1, out=at[1:])
    spaced = pc.binary_join_element_wise(distinct, pa.scalar(b"", pa.binary()), pa.scalar(b" ", pa.binary())).take(pa.array(codes))
    docs = batch.column(0).to_numpy()[own[head]]
    return Runs(least[head], docs, first - (np.cumsum(n) - n)[own[head]], last - first, at[first], at[last] - 1, spaced.buffers()[2])


def heavy_minimisers(rows: DataFrame) -> np.ndarray:
    """The minimisers of more than ``HEAVY`` strings, at most ``MOST_HEAVY``: how the work is dealt, not its result.

    A batch tells of those that it has ``OFTEN`` or more times, so little is shuffled.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = runs(batch)
        keys, n = np.unique(found.keys if found else np.empty(0, np.uint64), return_counts=True)
        often = n >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(n[often])], ["minimiser", "n"])

    counted = arrow(rows, run, "minimiser long, n long", rows=1024).groupBy("minimiser").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY)
    return np.sort(np.array([r.minimiser for r in most_frequent(stored(counted, "heavy"), "n", MOST_HEAVY).collect()], np.int64).view(np.uint64))


def runs_of(batch: pa.RecordBatch, heavy: np.ndarray | None = None, buckets: int = 1) -> tuple[np.ndarray, pa.RecordBatch, np.ndarray]:
    """The minimiser of each distinct run of windows of a batch, by bucket, the run with its smallest document's places,
    and the places of the others: rows of docs, first words, words after the last."""
    found = runs(batch, heavy)
    if found is None:
        return np.empty(0, np.uint64), pa.RecordBatch.from_pylist([], _SENT), np.empty((3, 0), np.int64)
    _, kind, n = np.unique(found.keys, return_inverse=True, return_counts=True)
    group = np.arange(len(found.keys))  # of equal runs: one of their rows
    again = np.flatnonzero(n[kind] > 1)
    code = found.packed(again).dictionary_encode().indices.to_numpy()
    group[again] = again[np.unique(code, return_index=True)[1]][code]
    order = np.lexsort((found.starts, found.docs, group, found.keys % np.uint64(buckets)))
    head = np.flatnonzero(np.diff(group[order], prepend=-1))
    doc, start, n = found.docs[order], found.starts[order], np.diff(head, append=len(order))
    least = doc == np.repeat(doc[head], n)
    known = np.array([doc[~least], start[~least], (start + found.words[order])[~least]], np.int64)
    rows = order[head]
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(least, head, dtype=np.int32))]).astype(np.int32)
    starts = pa.ListArray.from_arrays(pa.array(ends), pa.array(start[least].astype(np.int32)))
    return found.keys[rows], pa.RecordBatch.from_arrays([found.packed(rows), pa.array(doc[head]), starts], schema=_SENT), known


def super_kmers(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The runs of all texts (minimiser, packed, doc, starts) but those that were seen to share no minimiser, each bucket's
    together in one partition, sorted, and rows without minimiser, packed with the places that repeat another document of
    their batch."""
    lean(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, total // bucket_bytes)
    heavy = heavy_minimisers(rows)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(__name__)
        codec = pa.Codec("zstd", compression_level=ZSTD)
        for batch in (part for whole in batches for part in parts(whole, 1024, 2_500_000)):
            keys, found, known = runs_of(batch, heavy, buckets)
            numbers, starts = np.unique(keys % np.uint64(buckets), return_index=True)
            above = (keys // np.uint64(buckets)).astype(np.uint32)
            cuts = list(itertools.pairwise([*starts.tolist(), len(keys)]))
            raw = (found.slice(a, b - a).serialize() for a, b in cuts)
            blocks = [len(block).to_bytes(8, "little") + codec.compress(block, asbytes=True) for block in raw]
            kinds = [above[a:b].tobytes() for a, b in cuts]
            numbers = numbers.astype(np.int64)
            if known.size:
                numbers = np.append(numbers, known[0, 0] % buckets)
                blocks.append(known.tobytes())
                kinds.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(kinds, pa.binary()), pa.array(blocks, pa.binary())], ["bucket", "keys", "block"])
            del found, blocks, kinds, known
            pa.default_memory_pool().release_unused()
        released()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(__name__)
        held, size, now, whole = [], 0, None, True
        for batch in batches:
            for bucket, keys, block in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if not keys.is_valid:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([block.as_py()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32()))], _NAMES)
                    continue
                if bucket != now or size > HELD_BYTES:
                    whole &= bucket != now
                    yield from shared(held, now, buckets, whole)
                    held, size, whole, now = [], 0, bucket != now, bucket
                held.append((np.frombuffer(keys.as_buffer(), np.uint32), block.as_buffer()))
                size += len(held[-1][1])
        yield from shared(held, now, buckets, whole)
        del held
        released()

    blocks = rows.mapInArrow(sent, "bucket long, keys binary, block binary").repartition("bucket").sortWithinPartitions("bucket")
    found = blocks.select("bucket", "keys", "block").mapInArrow(opened, "minimiser long, packed binary, doc long, starts array<int>")
    return found.sortWithinPartitions("minimiser", "doc")


def shared(held: list[tuple[np.ndarray, pa.Buffer]], bucket: int | None, buckets: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """The runs of these blocks of a bucket; if they are the ``whole`` bucket, without those whose minimiser no other run has."""
    if not held:
        return
    keys = np.concatenate([k for k, _ in held])
    stay = np.ones(len(keys), bool)
    if whole:
        _, kind, n = np.unique(keys, return_inverse=True, return_counts=True)
        stay = n[kind] > 1
    ready, size, at, codec = [], 0, 0, pa.Codec("zstd")
    for own, block in held:
        mask, at = stay[at : at + len(own)], at + len(own)
        if mask.any():
            minimiser = pa.array(own[mask].astype(np.int64) * buckets + bucket)
            raw = codec.decompress(block[8:], int.from_bytes(block[:8].to_pybytes(), "little"))
            columns = pa.ipc.read_record_batch(raw, _SENT).filter(pa.array(mask)).columns
            ready.append(pa.RecordBatch.from_arrays([minimiser, *columns], _NAMES))
            size += ready[-1].nbytes
        if size > 2_000_000:
            yield pa.concat_batches(ready)
            ready, size = [], 0
    if ready:
        yield pa.concat_batches(ready)


class Bucket:
    """The windows of one minimiser, seen in order of their strings' documents."""

    def __init__(self):
        self.owner: dict[bytes, int] = {}

    def repeats(self, packed: bytes, doc: int, starts: list[int]) -> Iterator[tuple[int, int, int]]:
        """(doc, first word, word after the last) of what these places repeat of smaller documents."""
        get = self.owner.setdefault
        at = [-1]
        while (i := packed.find(b" ", at[-1] + 1)) >= 0:
            at.append(i)
        at.append(len(packed))
        first = None
        for i in range(len(at) - WINDOW + 1):
            if i < len(at) - WINDOW and get(packed[at[i] + 1 : at[i + WINDOW]], doc) < doc:
                first = i if first is None else first
            elif first is not None:
                yield from ((doc, start + first, start + i + WINDOW - 1) for start in starts)
                first = None


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b): words a to b (exclusive) of the document are in windows that a smaller document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(__name__)
        bucket, key = Bucket(), None
        held: tuple | None = None  # the first row of a minimiser waits until a second one comes
        names = ["doc_id", "a", "b"]
        for batch in batches:
            strings = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            if not strings.all():
                for places in batch.column(1).filter(pa.array(~strings)):
                    doc, a, b = np.frombuffer(places.as_buffer(), np.int64).reshape(3, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names)
                batch = batch.filter(pa.array(strings))
            out: list[tuple[int, int, int]] = []
            keys = batch.column(0).to_numpy()
            fresh = np.ones(len(keys), bool)
            fresh[1:] = keys[1:] != keys[:-1]
            alone = fresh & np.append(fresh[1:], False)
            if len(keys) and keys[0] == key:
                alone[0] = False
            some = batch.filter(pa.array(~alone))
            for least, *row in zip(*(column.to_pylist() for column in some.columns), strict=True):
                if least != key:
                    bucket, key, held = Bucket(), least, row
                    continue
                if held is not None:
                    out += bucket.repeats(*held)
                    held = None
                out += bucket.repeats(*row)
            if out:
                doc, a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names)
        del bucket, held
        released()

    return super_kmers(docs, id_col=id_col, text_col=text_col).mapInArrow(run, "doc_id long, a int, b int")


def spans_by_document(docs: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, spans array<struct<a, b>>) of the documents that repeat anything; spans of one document may overlap."""
    found = repeated_spans(docs, **columns)
    return stored(found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans")), "spans")


def kept_words(data: bytes | None, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """The words of a text outside the spans, and how many were inside."""
    words = data.split() if data else []
    if not spans:
        return words, 0
    edge = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        edge[s["a"]] += 1
        edge[s["b"]] -= 1
    stay = np.cumsum(edge[:-1]) == 0
    kept = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
    return kept, len(words) - len(kept)


def _stripped(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """(row: a struct of the other columns, clean, n_words, n_removed); ``whole`` keeps texts that repeat nothing as they are."""
    spans = spans_by_document(docs, id_col=id_col, text_col=text_col)
    rest, mark = [c for c in docs.columns if c != text_col], unused(docs, "mark")
    # a struct keeps the documents' own columns apart from those added here
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(1).alias(mark)).alias("row"), F.col(f"`{text_col}`").cast("binary").alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    packed = rows.join(spans, "doc_id", "left").select("row", "text", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        found = [kept_words(t, s) for t, s in zip(texts, batch.column(2).to_pylist(), strict=True)]
        clean = [t if whole and not r else b" ".join(k) for t, (k, r) in zip(texts, found, strict=True)]
        numbers = (pa.array([len(k) + r for k, r in found], pa.int64()), pa.array([r for _, r in found], pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.binary()).cast(pa.string()), *numbers], ["row", "clean", "n_words", "n_removed"])

    kind = packed.schema["row"].dataType.simpleString()
    return arrow(packed, run, f"row {kind}, clean string, n_words long, n_removed long")


def cleaned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, clean_text, n_words, n_removed): the kept words joined by spaces, the words and those removed."""
    found = _stripped(docs.select(id_col, text_col), id_col, text_col, whole=False)
    return found.select(F.col(f"row.`{id_col}`").alias(id_col), F.col("clean").alias("clean_text"), "n_words", "n_removed")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages gone from the text; texts that repeat nothing stay as they are."""
    found = _stripped(docs, id_col, text_col, whole=True)
    return found.select(*(F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and a digest of the kept words of every document."""
    found = cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("clean_text", 256).alias("kept_sha256"))


#: Every window with the smallest document it starts in; words covered by a window of a smaller one go.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM k),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
d AS (SELECT g.doc_id, list(g.i) AS pos FROM g JOIN f ON f.g = g.g AND f.first < g.doc_id GROUP BY g.doc_id),
c AS (SELECT w.doc_id, ws, coalesce(pos, []) AS pos FROM w LEFT JOIN d ON d.doc_id = w.doc_id),
x AS (SELECT doc_id, list_distinct(flatten(list_transform(pos, lambda i: range(i, i + 13)))) AS gone FROM c),
r AS (SELECT c.doc_id, c.ws, list_filter(c.ws, lambda s, j: NOT list_contains(x.gone, j)) AS kept FROM c JOIN x ON x.doc_id = c.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM r
"""
