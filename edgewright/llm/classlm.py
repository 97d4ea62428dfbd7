"""A class-based bigram language model: words belong to classes found by exchange.

Spark counts every word of every training text. The most frequent words (a fixed number) are types of their own;
any other word begins with the type of its last letters, or with the one type that is left. Exchange clustering moves
types between classes while the likelihood of the corpus's class bigrams grows; the bigrams of types are counted
over all training texts, and their number is bounded by the number of types. Then every other word that training
counted is exchanged on its own: Spark adds up which classes stand before and after it in all training texts, and the
word moves to the class where the same likelihood is greatest, against the classes so far. Only words that training
never saw keep the class of their ending. Class bigrams are then counted anew, with the class that each word got.
A token's probability is its class's after the class before it (interpolated with the class alone) times the word's
share of its class, with one place kept in each class for words that training never saw.

Word counts and words' classes grow with the corpus and never come to the driver or to all executors: words are
exchanged in buckets of their hash, documents form blocks, each block asks for the counts and classes of its own words
by a join, and texts meet the answers in their block. A word asked for by every block is one row for each block, not
for each use.

Null texts count as empty: one end token. Repeated rows count and score each; without training rows every word is
unknown; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.llm.common import arrow, begun, crc_mod, gathered, lean, most_frequent, released, split_words, stored, table

#: Types: frequent words, endings of the other words; classes; rounds of exchange.
WORD_TYPES, ENDING_TYPES, CLASSES, ROUNDS = 700, 300, 48, 6
#: Weight of the class bigram against the class alone, and what is added to each count.
BIGRAM, ADDED = 0.9, 0.5
#: About so many bytes of text form a block.
BLOCK_BYTES = 16_000_000
#: About so many bytes of text are counted at once in a task; about so many words are exchanged in one group.
COUNTED_BYTES, BUCKET_WORDS = 32_000_000, 40_000
END = b"\n"  # no word has it


def ending(word: bytes) -> bytes:
    """The name of a rare word's type: its last three characters, letters as they are and any other as a dot."""
    return "".join(c if c.isalpha() else "." for c in word.decode()[-3:]).encode()


@dataclass(frozen=True)
class Types:
    """The type of each word: frequent words first, then endings, then the rest."""

    words: dict[bytes, int]
    endings: dict[bytes, int]

    @property
    def count(self) -> int:
        return len(self.words) + len(self.endings) + 1

    def of(self, word: bytes) -> int:
        found = self.words.get(word)
        return self.endings.get(ending(word), self.count - 1) if found is None else found

    def all(self, words: pa.Array) -> np.ndarray:
        return np.fromiter(map(self.of, words.to_pylist()), np.int64, len(words))


@dataclass(frozen=True)
class Stream:
    """Texts as one sequence: each one's words with ASCII capitals lowered, then the end."""

    words: pa.Array  # distinct words, then the end
    ids: np.ndarray  # of each token among these
    lengths: np.ndarray  # tokens of each text

    @classmethod
    def of(cls, texts: pa.Array) -> Stream:
        found, codes, n = split_words(texts, lower=True)
        words, lengths = pa.concat_arrays([found, pa.array([END], pa.binary())]), n + 1
        ids = np.full(int(lengths.sum()), len(words) - 1, np.int32)
        inside = np.ones(len(ids), bool)
        inside[np.cumsum(lengths) - 1] = False
        ids[inside] = codes
        return cls(words, ids, lengths)

    def before(self, values: np.ndarray) -> np.ndarray:
        """``values`` of the tokens before each one; before a text stands the end, as behind the text before."""
        return np.concatenate([values[-1:], values[:-1]])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over each text."""
        return np.add.reduceat(values, np.cumsum(self.lengths) - self.lengths) if len(self.lengths) else np.zeros(0, values.dtype)


def each_stream(train: DataFrame, fn, schema: str, text_col: str) -> DataFrame:
    """The batches that ``fn`` makes of the texts of ``train``, taken as streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(__name__)
        for texts in gathered(batches, COUNTED_BYTES):
            yield from fn(Stream.of(texts))
        released()

    lean(train.sparkSession)
    return train.select(F.col(text_col).cast("binary")).mapInArrow(run, schema)


def word_counts(train: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(word, n) of all training texts, the end included."""

    def run(stream: Stream) -> Iterator[pa.RecordBatch]:
        n = np.bincount(stream.ids, minlength=len(stream.words))
        yield from pa.table({"word": stream.words, "n": n}).to_batches(max_chunksize=50_000)

    return each_stream(train, run, "word binary, n long", text_col).groupBy("word").agg(F.sum("n").alias("n"))


def choose_types(counts: DataFrame, *, words: int = WORD_TYPES, endings: int = ENDING_TYPES) -> Types:
    """The types of a corpus: only as many words and endings as there may be come to the driver."""
    top = [bytes(r.word) for r in sorted(most_frequent(counts, "n", words).collect(), key=lambda r: (-r.n, r.word))]
    known = set(top)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if word not in known:
                seen[ending(word)] += n
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rare = stored(arrow(counts, run, "word binary, n long", rows=10_000).groupBy("word").agg(F.sum("n").alias("n")), "endings")
    ends = [bytes(r.word) for r in sorted(most_frequent(rare, "n", endings).collect(), key=lambda r: (-r.n, r.word))]
    return Types({w: i for i, w in enumerate(top)}, {e: len(top) + i for i, e in enumerate(ends)})


def type_bigrams(train: DataFrame, types: Types, *, text_col: str = "text") -> np.ndarray:
    """How often each type follows each, over all training texts; the end also stands before the first word."""
    size = types.count

    def run(stream: Stream) -> Iterator[pa.RecordBatch]:
        kinds = types.all(stream.words)[stream.ids]
        total = np.bincount(stream.before(kinds) * size + kinds, minlength=size * size)
        at = np.flatnonzero(total)
        yield from pa.table({"pair": at, "n": total[at]}).to_batches(max_chunksize=100_000)

    cells = each_stream(train, run, "pair long, n long", text_col).groupBy("pair").agg(F.sum("n").alias("n"))
    found, out = cells.toArrow(), np.zeros(size * size)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def _h(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0)), 0.0)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each type: every type in turn moves to where the class bigrams' likelihood is greatest."""
    size = len(bigrams)
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1)), kind="stable")
    own = np.empty(size, np.int64)
    own[order] = np.arange(size) % classes
    for _ in range(rounds):
        moved = 0
        hot = np.zeros((size, classes))
        hot[np.arange(size), own] = 1
        to, fro = bigrams @ hot, bigrams.T @ hot  # of each type to classes, and from them
        pairs = hot.T @ to
        for t in order:
            out, into, self_ = to[t].copy(), fro[t].copy(), bigrams[t, t]
            a = own[t]
            out[a] -= self_
            into[a] -= self_
            base = pairs.copy()
            base[a] -= out
            base[:, a] -= into
            base[a, a] -= self_
            # likelihood of each place for t: only the row, the column and the margins of that class change;
            # the margins of all classes hold what they send to t, and get from it, wherever it is
            row, column = base.sum(1) + into, base.sum(0) + out
            gain = (_h(base + out) - _h(base)).sum(1) + (_h(base + into[:, None]) - _h(base)).sum(0)
            corner = np.diag(base)
            gain += _h(corner + out + into + self_) + _h(corner) - _h(corner + out) - _h(corner + into)
            gain -= _h(row + out.sum() + self_) - _h(row) + _h(column + into.sum() + self_) - _h(column)
            b = int(gain.argmax())
            pairs = base
            pairs[b] += out
            pairs[:, b] += into
            pairs[b, b] += self_
            if b != a:
                own[t] = b
                moved += 1
                change = bigrams[:, t]
                to[:, a] -= change
                to[:, b] += change
                change = bigrams[t]
                fro[:, a] -= change
                fro[:, b] += change
        if not moved:
            break
    return own


def neighbours(train: DataFrame, types: Types, classes: np.ndarray, size: int, *, text_col: str = "text") -> DataFrame:
    """(word, codes, ns): how often each class stands before (codes from 0) and after a word (from ``size``), and the
    word itself before it (2 * ``size``), as parts of sums over all training texts."""
    wide = 2 * size + 1

    def run(stream: Stream) -> Iterator[pa.RecordBatch]:
        ids = stream.ids.astype(np.int64)
        own = classes[types.all(stream.words)][ids]
        same = ids == stream.before(ids)
        into = ids * wide + np.where(same, 2 * size, stream.before(own))
        out = stream.before(ids * wide + size) + own  # of the token before, by the class of this one
        cells, n = np.unique(np.concatenate([into, out[~same]]), return_counts=True)
        starts = np.searchsorted(cells, np.arange(len(stream.words) + 1) * wide).astype(np.int32)
        codes = (cells % wide).astype(np.uint8)
        for a in range(0, len(stream.words), 20_000):
            b = min(a + 20_000, len(stream.words))
            at, x, y = starts[a : b + 1] - starts[a], starts[a], starts[b]
            told = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(at), pa.py_buffer(codes[x:y])])
            ns = pa.ListArray.from_arrays(pa.array(at), pa.array(n[x:y].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([stream.words.slice(a, b - a), told, ns], ["word", "codes", "ns"])

    return each_stream(train, run, "word binary, codes binary, ns array<int>", text_col)


def _more(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(x + n) log (x + n) - x log x, for n > 0."""
    return n * np.log(x + n) + x * np.log1p(n / np.where(x > 0, x, 1.0))


def gains(pairs: np.ndarray, own: np.ndarray, into: np.ndarray, out: np.ndarray, self_: np.ndarray) -> np.ndarray:
    """What each word (row) adds to the likelihood in each class, taken out of its own one and all others left as
    they are: ``exchange``'s measure, for words whose neighbours' classes are mostly few. ``into`` and ``out`` hold
    how often each class stands before and after the word, ``self_`` how often the word does."""
    rows = np.arange(len(own))
    gain = np.zeros(into.shape)
    for side, other, table_ in ((out, into, pairs.T), (into, out, pairs)):
        word, c = np.nonzero(side)
        if not len(word):
            continue
        n, a = side[word, c], own[word]
        base = table_[c]  # of all classes with class c
        base[np.arange(len(word)), a] -= n
        inner = np.flatnonzero(c == a)
        base[inner] -= other[word[inner]]
        base[inner, a[inner]] -= self_[word[inner]]
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        gain[word[starts]] += np.add.reduceat(_more(base, n[:, None]), starts, axis=0)
    corner = np.tile(np.diag(pairs), (len(own), 1))
    corner[rows, own] -= out[rows, own] + into[rows, own] + self_
    at = np.nonzero(((out > 0) & (into > 0)) | (self_ > 0)[:, None])
    k, o, i, s = corner[at], out[at], into[at], self_[at[0]]
    gain[at] += _h(k + o + i + s) + _h(k) - _h(k + o) - _h(k + i)
    for margin, side in ((pairs.sum(1), out), (pairs.sum(0), into)):
        n = side.sum(1) + self_
        left = np.tile(margin, (len(own), 1))
        left[rows, own] -= n
        gain -= np.where(n[:, None] > 0, _more(left, np.maximum(n, 1)[:, None]), 0)
    return gain


def exchanged(cells: DataFrame, pairs: np.ndarray, types: Types, classes: np.ndarray, words: int) -> DataFrame:
    """(word, n, class) of all training words: types of their own have their class, any other word moves to the class
    where the likelihood is greatest (the least of equal ones)."""
    size = len(pairs)
    wide = 2 * size + 1
    number = max(1, math.ceil(words / BUCKET_WORDS))

    def run(bucket: pa.Table) -> pa.Table:
        coded = bucket.column("word").combine_chunks().dictionary_encode()
        codes, ns = bucket.column("codes").combine_chunks(), bucket.column("ns").combine_chunks()
        row = np.repeat(coded.indices.to_numpy().astype(np.int64), pc.list_value_length(ns).to_numpy())
        code = np.frombuffer(b"".join(codes.to_pylist()), np.uint8)
        names = coded.dictionary
        total = np.bincount(row * wide + code, ns.flatten().to_numpy(), len(names) * wide).reshape(-1, wide)
        kind = types.all(names)
        own = classes[kind]
        found = own.copy()
        for a in range(0, len(names), 2000):
            some = slice(a, a + 2000)
            into, out, self_ = total[some, :size], total[some, size : 2 * size], total[some, -1]
            best = gains(pairs, own[some], into, out, self_).argmax(axis=1)
            found[some] = np.where(kind[some] < len(types.words), own[some], best)
        n = (total[:, :size].sum(1) + total[:, -1]).astype(np.int64)
        return pa.table({"word": names, "n": n, "class": found.astype(np.int32)})

    dealt = cells.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(number)).cast("int"))
    return dealt.groupBy("bucket").applyInArrow(run, "word binary, n long, class int")


@dataclass(frozen=True)
class Model:
    """What scoring needs. All but ``words``, a table of (word, n, class), has a fixed size."""

    types: Types
    classes: np.ndarray  # of each type
    transition: np.ndarray  # log10 P(class | class before)
    emitted: np.ndarray  # log10 of each class's tokens with what is added
    tokens: int
    vocabulary: int
    words: DataFrame

    def class_of(self, word: bytes) -> int:
        kind = self.types.of(word)
        found = self.words.where(F.col("word") == F.lit(bytearray(word))).first() if kind >= len(self.types.words) else None
        return int(found["class"]) if found else int(self.classes[kind])


@dataclass(frozen=True)
class Words:
    """The words of a corpus with their classes, before class bigrams are counted."""

    types: Types
    classes: np.ndarray
    size: int
    table: DataFrame  # word, n, class
    n: np.ndarray  # tokens of each class
    words: np.ndarray


def word_classes(train: DataFrame, counts: DataFrame, *, text_col: str = "text", classes: int = CLASSES) -> Words:
    types = choose_types(counts)
    bigrams = type_bigrams(train, types, text_col=text_col)
    own = exchange(bigrams, classes)
    hot = np.zeros((len(own), classes))
    hot[np.arange(len(own)), own] = 1
    cells = neighbours(train, types, own, classes, text_col=text_col)
    found = stored(exchanged(cells, hot.T @ bigrams @ hot, types, own, counts.count()), "classes")
    n, words = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for r in found.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        n[r["class"]], words[r["class"]] = r.n, r.words
    return Words(types, own, classes, found, n, words)


def class_bigrams(train: DataFrame, size: int) -> np.ndarray:
    """How often each class follows each, from the ``classed`` training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
            total += np.bincount(np.concatenate([own[-1:], own[:-1]]) * size + own, minlength=size * size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total)], ["pair", "n"])

    out = np.zeros(size * size)
    for r in train.select("classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(size, size)


def fitted(words: Words, pairs: np.ndarray) -> Model:
    alone = (words.n + ADDED) / (words.n + ADDED).sum()
    after = pairs.sum(axis=1, keepdims=True)
    follow = np.where(after > 0, BIGRAM * pairs / np.maximum(after, 1) + (1 - BIGRAM) * alone, alone)
    emitted = np.log10(words.n + ADDED * (words.words + 1))
    return Model(words.types, words.classes, np.log10(follow), emitted, int(words.n.sum()), int(words.words.sum()), words.table)


def train_model(train: DataFrame, counts: DataFrame, *, text_col: str = "text", classes: int = CLASSES) -> Model:
    words = word_classes(train, counts, text_col=text_col, classes=classes)
    rows = train.select(F.monotonically_increasing_id().alias("row"), text_col)
    return fitted(words, class_bigrams(classed(rows, words, id_col="row", text_col=text_col), classes))


def blocks(docs: DataFrame, *, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, data, block): as many blocks as the corpus's bytes ask for, dealt by the hash of the id and the text."""
    data = docs.select(id_col, F.col(text_col).cast("binary").alias("data"))
    total = data.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    number = max(1, math.ceil(total / block_bytes))
    return data.withColumn("block", F.pmod(F.xxhash64(id_col, "data"), F.lit(number)).cast("int"))


def distinct_words(placed: DataFrame) -> DataFrame:
    """(block, word): what each block asks for. The texts' exchange is the one that scoring uses again."""

    def run(block: pa.Table) -> pa.Table:
        own = Stream.of(pa.concat_arrays(block.column("data").chunks)).words
        number = block.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(len(own), number, np.int32)), "word": own})

    return placed.groupBy("block").applyInArrow(run, "block int, word binary")


def classed(docs: DataFrame, words: Words | Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, own, classes): the class of each token, one byte each, the end's last,
    and the sum of log10 of what tokens count in their class; stored, as all class bigrams come before any score."""
    placed = blocks(docs, id_col=id_col, text_col=text_col)
    counted = words.table if isinstance(words, Words) else words.words
    answers = distinct_words(placed).join(counted, "word").select("block", "word", "n", "class")
    kind = docs.schema[id_col].dataType.simpleString()
    types, classes = words.types, words.classes
    n, v = (int(words.n.sum()), int(words.words.sum())) if isinstance(words, Words) else (words.tokens, words.vocabulary)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("data")
        stream = Stream.of(pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.binary()))
        at = pc.index_in(stream.words, right.column("word").combine_chunks()).fill_null(-1).to_numpy()
        count = np.append(right.column("n").to_numpy(), 0)[at].astype(float)  # -1: never seen
        group = np.append(right.column("class").to_numpy(), 0)[at].astype(np.uint8)
        strange = np.flatnonzero(at < 0)
        group[strange] = classes[types.all(stream.words.take(pa.array(strange)))]
        ids = stream.ids
        own = group[ids]
        offsets = np.concatenate([[0], np.cumsum(stream.lengths)]).astype(np.int32)
        columns = [
            left.column(id_col), pa.array(stream.lengths, pa.int64()), pa.array(stream.sums((count > 0)[ids].astype(np.int64))), pa.array(stream.sums(np.log10((count + 1) / (n + v + 1))[ids])),
            pa.array(stream.sums(np.log10(count + ADDED)[ids])), pa.Array.from_buffers(pa.binary(), len(stream.lengths), [None, pa.py_buffer(offsets), pa.py_buffer(own)]),
        ]
        return pa.Table.from_arrays(columns, [id_col, "n_tokens", "n_known", "base_score", "own", "classes"])

    found = placed.groupBy("block").cogroup(answers.groupBy("block"))
    return stored(found.applyInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, own double, classes binary"), "classed")


def scored(found: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score) of ``classed`` texts."""
    transition, emitted = model.transition, model.emitted
    step = transition - emitted  # a token gives what its class gets after the one before, less the class's total

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8)
        values = step[np.concatenate([own[-1:], own[:-1]]), own]
        lengths = batch.column(1).to_numpy()
        score = np.add.reduceat(values, np.cumsum(lengths) - lengths) + batch.column(4).to_numpy()
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(score)], [id_col, "n_tokens", "n_known", "base_score", "score"])

    kind = found.schema[id_col].dataType.simpleString()
    return arrow(found.select(id_col, "n_tokens", "n_known", "base_score", "own", "classes"), run, f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, counts: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score): log10 probabilities of whole texts with their ends."""
    return scored(classed(docs, model, id_col=id_col, text_col=text_col), model, id_col)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(crc_mod(id_col, 7) != 2)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = training_rows(docs)
    counts = stored(word_counts(train), "words")
    words = word_classes(train, counts)
    texts = classed(docs, words)
    model = fitted(words, class_bigrams(training_rows(texts), words.size))
    found = scored(texts, model)
    held = crc_mod("doc_id", 7) == 2
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
