"""Byte-pair encoding and decoding with a lexicon compiled into a minimal acyclic transducer.

Spark counts the space-delimited pieces of the whole corpus; the most frequent ones (a fixed number) are
encoded once and compiled into an automaton that shares prefixes and suffixes, whose arcs carry numbers that
add up to a piece's place in a table of id sequences. Spark hands the file to every executor, which maps it
into memory. A piece that the automaton lacks is merged pair by pair, exactly. Pieces are cut before single
spaces, at line ends and before marks behind a letter or digit, where no token of the byte-level pattern can cross;
a run of white space is one token but for its last character, which leads the next word if it is a space.

Nulls count as empty texts: no ids, an empty decoded text. Any length of text works; equal rows give equal
results; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.llm.common import Memo, arrow, begun, gathered, lean, loaded_once, most_frequent, released, stored, table

#: How many of the most frequent pieces the automaton holds.
LEXICON = 32_768
#: About so many bytes of text are counted at once in a task.
COUNTED_BYTES = 32_000_000
SPECIAL = b"<|endoftext|>"
#: White space beyond ASCII starts with one of these in UTF-8; runs of white space, ASCII and any.
WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
RUN = re.compile(rb"[\t-\r ]{2,}")
WIDE_RUN = re.compile(rb"(?:[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80){2,}")
#: Marks behind a letter or digit are a token of their own.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SOLID = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_BYTES = [bytes([b]) for b in range(256)]
#: Latin letters with ASCII punctuation behind: two pre-tokens at most, which need no general pattern.
PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Merger:
    """Exact merging by rank, as the vocabulary file lists its merges. A pair of ids is one number: left << 32 | right."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank = {ids[x] << 32 | ids[y]: i for i, (x, y) in enumerate(pairs)}
        self.merged = [ids[x + y] for x, y in pairs]
        alphabet = byte_alphabet()
        self.first = [ids[c] for c in alphabet]
        self.to_byte = {c: b for b, c in enumerate(alphabet)}
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = len(ids)
        self.bytes_of = [b""] * (self.special + 1)
        for token, i in ids.items():
            self.bytes_of[i] = bytes(map(self.to_byte.__getitem__, token))
        self.bytes_of[self.special] = SPECIAL

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token: its pair of least rank is merged, leftmost first, until none is left."""
        parts = list(map(self.first.__getitem__, data))
        if len(parts) > 40:
            return self.merge_long(parts)
        rank, merged, never = self.rank.get, self.merged, len(self.rank)
        ranks = [rank(x << 32 | y, never) for x, y in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            parts[i] = new = merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << 32 | parts[i + 1], never)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | new, never)
        return parts

    def merge_long(self, parts: list) -> list[int]:
        """The same over a heap of pairs and a linked list, which stays near linear."""
        n, rank = len(parts), self.rank.get
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] is None or parts[j] != right or rank(parts[i] << 32 | right) != r:
                continue
            parts[i], parts[j] = self.merged[r], None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (s := rank(parts[i] << 32 | parts[k])) is not None:
                    heapq.heappush(heap, (s, i, parts[k]))
            if (h := before[i]) >= 0 and (s := rank(parts[h] << 32 | parts[i])) is not None:
                heapq.heappush(heap, (s, h, parts[i]))
        return [p for p in parts if p is not None]

    def encode(self, text: str) -> list[int]:
        """The ids of a text without special tokens, merged pre-token by pre-token."""
        return [i for symbols, _ in self.cut(text) for i in self.merge(bytes(map(self.to_byte.__getitem__, symbols)))]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The same for a piece without white space but for a space at its start."""
        if not (plain := PLAIN.fullmatch(piece.decode())):
            return self.encode(piece.decode())
        letters = plain[1].encode()
        return self.merge(letters) + (self.merge(piece[len(letters) :]) if plain[2] else [])


@loaded_once(2)
def merger(path: str) -> Merger:
    return Merger(path)


def compile_lexicon(entries: dict[bytes, list[int]], path: str) -> None:
    """Write the minimal acyclic transducer of ``entries`` (piece to ids) to ``path``.

    Words come in byte order; each state left behind is replaced by an equal one that is already registered, so
    suffixes are shared. Counting the words below each state afterwards puts on each arc how many words sort
    before it, whose sum along a word's path is its place.
    """
    words = sorted(entries)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}

    def replace(path_: list[tuple[int, int, int]], keep: int) -> None:
        while len(path_) > keep:
            parent, label, state = path_.pop()
            same = register.setdefault((final[state], *arcs[state].items()), state)
            arcs[parent][label] = same

    trail: list[tuple[int, int, int]] = []
    last = b""
    for word in words:
        common = len(os.path.commonprefix([word, last]))
        replace(trail, common)
        state = trail[-1][2] if trail else 0
        for label in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[state][label] = len(arcs) - 1
            trail.append((state, label, len(arcs) - 1))
            state = len(arcs) - 1
        final[state] = True
        last = word
    replace(trail, 0)

    below: dict[int, int] = {}
    order: list[int] = []
    todo = [(0, False)]
    while todo:
        state, done = todo.pop()
        if done:
            below[state] = final[state] + sum(below[t] for t in arcs[state].values())
            order.append(state)
        elif state not in below:
            below[state] = 0
            todo.append((state, True))
            todo += [(t, False) for t in arcs[state].values() if t not in below]
    order.reverse()
    place = {state: i for i, state in enumerate(order)}
    starts, targets, adds, labels, ends = array("I", [0]), array("I"), array("I"), bytearray(), bytearray()
    for state in order:
        seen = int(final[state])
        for label, target in sorted(arcs[state].items()):
            labels.append(label)
            targets.append(place[target])
            adds.append(seen)
            seen += below[target]
        starts.append(len(labels))
        ends.append(final[state])
    offsets, ids = array("I", [0]), array("I")
    for word in words:
        ids.extend(entries[word])
        offsets.append(len(ids))
    with open(path, "wb") as f:
        f.write(struct.pack("<4I", len(order), len(labels), len(words), len(ids)))
        for part in (starts, targets, adds, offsets, ids):
            f.write(part.tobytes())
        f.write(bytes(labels) + bytes(ends))


class Lexicon:
    """The automaton of a file, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.states, n_arcs, self.words, n_ids = struct.unpack_from("<4I", self.map)
        at, view = 16, memoryview(self.map)
        parts = []
        for n in (self.states + 1, n_arcs, n_arcs, self.words + 1, n_ids):
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.starts, self.targets, self.adds, self.offsets, self.ids = parts
        self.labels, self.ends = at, at + n_arcs

    def get(self, word: bytes) -> bytes | None:
        """The ids of a word as 32-bit numbers, or None if the automaton lacks it."""
        state = total = 0
        find, labels, starts, targets, adds = self.map.find, self.labels, self.starts, self.targets, self.adds
        for label in map(_BYTES.__getitem__, word):
            arc = find(label, labels + starts[state], labels + starts[state + 1]) - labels
            if arc < 0:
                return None
            total += adds[arc]
            state = targets[arc]
        if not self.map[self.ends + state]:
            return None
        return bytes(self.ids[self.offsets[total] : self.offsets[total + 1]])


class Encoder:
    """Whole texts to ids: pieces by the lexicon, the rest by exact merging; results of pieces are kept for a while."""

    def __init__(self, vocabulary: str, lexicon: str):
        self.merger, self.lexicon = merger(vocabulary), Lexicon(lexicon)
        self.spaced = Memo(lambda piece: self.piece(b" ", piece), 600_000, __name__)  # pieces behind a space
        self.bare = Memo(lambda piece: self.piece(b"", piece), 50_000, __name__)
        self.apart = Memo(self.exact, 20_000, __name__)  # tokens of their own: marks and white space
        self.line, self.end = self.exact(b"\n"), struct.pack("<I", self.merger.special)

    def exact(self, token: bytes) -> bytes:
        return array("I", self.merger.merge(token)).tobytes()

    def piece(self, space: bytes, piece: bytes) -> bytes:
        if b"\n" in piece:  # a line end alone: a token, and what follows has no space before
            first, *lines = piece.split(b"\n")
            head = (self.spaced if space else self.bare)[first] if space + first else b""
            return head + b"".join(self.line + (self.bare[x] if x else b"") for x in lines)
        core = piece.rstrip(MARKS)
        if core and len(core) < len(piece) and core[-1] in _SOLID:
            return (self.spaced if space else self.bare)[core] + self.apart[piece[len(core) :]]
        found = self.lexicon.get(space + piece)
        return found if found is not None else array("I", self.merger.encode_piece(space + piece)).tobytes()

    def words(self, data: bytes, spaced: bool = False) -> bytes:
        """The ids of a text without runs of white space; ``spaced``: with a space before it."""
        first, *others = data.split(b" ")
        head = self.spaced[first] if spaced else self.bare[first] if first else b""
        return head + b"".join(map(self.spaced.__getitem__, others))

    def segment(self, data: bytes) -> bytes:
        """The ids of a text without special tokens as 32-bit numbers."""
        run = WIDE_RUN if any(w in data for w in WIDE) else RUN
        out, at, spaced = [], 0, False
        for found in run.finditer(data):
            blank, begin = found[0], found.start()
            if begin > at:
                out.append(self.words(data[at:begin], spaced))
            at = found.end()
            if at == len(data):
                out.append(self.apart[blank])
                return b"".join(out)
            last = blank.decode()[-1].encode()
            out.append(self.apart[blank[: -len(last)]])
            spaced = last == b" "
            if not spaced:
                out.append(self.apart[last])
        if at < len(data):
            out.append(self.words(data[at:], spaced))
        return b"".join(out)

    def encode(self, data: bytes) -> bytes:
        return self.segment(data) if SPECIAL not in data else self.end.join(map(self.segment, data.split(SPECIAL)))

    def trim(self) -> None:
        for memo in (self.spaced, self.bare, self.apart):
            memo.trim()


@loaded_once(4)
def encoder(vocabulary: str, lexicon: str) -> Encoder:
    return Encoder(vocabulary, SparkFiles.get(lexicon))


def frequent_pieces(docs: DataFrame, text_col: str, size: int) -> list[bytes]:
    """The most frequent space-delimited pieces of all texts without the marks behind them, each with the space before
    it; at most ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(__name__)
        for texts in gathered(batches, COUNTED_BYTES):
            pieces = pc.split_pattern(texts.drop_null().view(pa.string()), " ").flatten()
            counts = pc.ascii_rtrim(pieces, MARKS.decode()).value_counts()
            yield from pa.table({"piece": counts.field(0), "n": counts.field(1)}).to_batches(max_chunksize=50_000)
        released()

    lean(docs.sparkSession)
    counts = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "piece string, n long").where(F.col("piece") != "")
    top = most_frequent(stored(counts.groupBy("piece").agg(F.sum("n").alias("n")), "pieces"), "n", size)
    return [b" " + r.piece.encode() for r in top.collect()]


def build_lexicon(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", vocabulary: str | None = None, size: int = LEXICON) -> str:
    """Compile the corpus's frequent pieces and hand the file to the executors; returns the name for ``SparkFiles``.

    What comes to the driver is bounded by ``size``, whatever the corpus.
    """
    m = merger(vocabulary or vocabulary_path())
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lexicon-")), name)
    compile_lexicon({p: m.encode_piece(p) for p in frequent_pieces(docs, text_col, size)}, path)
    spark.sparkContext.addFile(path)
    return name


def _encoded(batch: pa.RecordBatch, vocabulary: str, lexicon: str) -> pa.ListArray:
    coder = encoder(vocabulary, lexicon)
    parts = [coder.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
    coder.trim()
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _decoded(ids: pa.ListArray, vocabulary: str) -> pa.Array:
    token = merger(vocabulary).bytes_of.__getitem__
    first, *_ = at = ids.offsets.to_numpy()
    values = ids.values.slice(first, at[-1] - first).to_numpy().tolist()
    return pa.array([b"".join(map(token, values[a:b])).decode("utf-8", "replace") for a, b in zip(at[:-1] - first, at[1:] - first, strict=True)], pa.string())


def encode(docs: DataFrame, lexicon: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, ids array<int>) of every row."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), _encoded(batch, vocabulary, lexicon)], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow(docs.select(id_col, F.col(text_col).cast("binary")), run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, *, id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(id_col, ids, decoded string) of every row: the bytes of the ids' tokens, special ones included, as UTF-8."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(1)
        return pa.RecordBatch.from_arrays([batch.column(0), ids, _decoded(ids, vocabulary)], [id_col, "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return arrow(encoded.select(id_col, F.coalesce("ids", F.array().cast("array<int>")).alias("ids")), run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, lexicon: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``decode(encode(docs))`` in one pass: (id_col, ids, decoded)."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = _encoded(batch, vocabulary, lexicon)
        return pa.RecordBatch.from_arrays([batch.column(0), ids, _decoded(ids, vocabulary)], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow(docs.select(id_col, F.col(text_col).cast("binary")), run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = round_trip(docs, build_lexicon(spark, docs))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
