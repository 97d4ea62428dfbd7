"""Best-fit packing of token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so all that planning needs is how many pieces have each length: at
most ``CAPACITY`` rows, whatever the corpus. On these the driver plans: large lengths fall into groups of equal
cardinality and are rounded up to their group's largest; configurations of these few sizes are optimised by column
generation (a linear program whose new columns are knapsacks); actual lengths replace the rounded ones; the small
ones then go, largest first, to the fullest sequence that still has room. The plan is a list of patterns, each with
how often it is used. Spark then numbers the pieces of each length and looks every number up in the plan, so no
piece passes through the driver. Numbering deals each length out over many keys, so one common length is no
hot spot.

A null text counts as empty: its document is the single end token. Repeated rows are packed each; an empty table
gives an empty table. Only documents longer than a sequence are cut.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewright.llm.common import Memo, arrow, loaded_once, split_words, stored, table

CAPACITY = 4096
END = 1
#: Lengths above this share of a sequence are large; they form so many groups.
LARGE, GROUPS = 1 / 3, 40
#: Keys over which the pieces of each length are dealt for numbering.
DEALT = 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII marks that are pre-tokens of their own behind letters (no apostrophe).
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Latin letters that lower one by one, with ASCII marks behind: two pre-tokens at most.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")


class Coder:
    """Token ids of whole texts, word by word: no token of this vocabulary crosses white space.

    Results are kept for a while. New words made of letters are lowered, freed of marks behind them and tokenized
    many at a time in one text, which their word ends part again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words = Memo(self.whole, 400_000, __name__)
        self.letters = Memo(self.whole, 300_000, __name__)
        self.marks = Memo(self.whole, 10_000, __name__)

    def whole(self, data: bytes) -> bytes:
        return array("I", self.tokenizer.encode(data.decode(), add_special_tokens=False).ids).tobytes()

    def learn(self, words: list[bytes]) -> None:
        plain = []
        for word in words:
            core = word.rstrip(MARKS)
            if core.isalpha():
                plain.append((word, core.lower(), word[len(core) :]))
            elif not word.isascii() and (found := PLAIN.fullmatch(word.decode())):
                plain.append((word, found[1].lower().encode(), found[2].encode()))
            else:
                self.words[word] = self.whole(word)
        known, last = self.letters, self.letters.last
        new = []
        for letters in {letters for _, letters, _ in plain}:
            if letters not in known:
                if letters in last:
                    known[letters] = last[letters]
                else:
                    new.append(letters)
        for i in range(0, len(new), 1000):
            some = new[i : i + 1000]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, np.uint32)
            data, at = ids.tobytes(), 0
            for letters, end in zip(some, (4 * np.flatnonzero(self.last[ids]) + 4).tolist(), strict=True):
                known[letters], at = data[at:end], end
        for word, letters, marks in plain:
            self.words[word] = known[letters] + self.marks[marks] if marks else known[letters]

    def ids(self, texts: list[bytes | None] | pa.Array) -> list[bytes]:
        """The ids of each text as 32-bit numbers."""
        for kept in (self.words, self.letters, self.marks):
            kept.trim()
        found, codes, lengths = split_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
        words = found.to_pylist()
        known, last = self.words, self.words.last
        new = []
        for word in words:
            if word not in known:
                if word in last:
                    known[word] = last[word]
                else:
                    new.append(word)
        self.learn(new)
        parts = [known[word] for word in words]
        n = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        every, first = np.frombuffer(b"".join(parts), np.uint32), np.cumsum(n) - n
        # each word's ids in the order of the texts
        many = n[codes]
        behind = np.concatenate([[0], np.cumsum(many)])
        data = every[np.repeat(first[codes] - behind[:-1], many) + np.arange(behind[-1])].tobytes()
        ends = (4 * behind[np.concatenate([[0], np.cumsum(lengths)])]).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]


@loaded_once(2)
def coder(path: str) -> Coder:
    return Coder(path)


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]) of every document, its ids followed by the end id."""
    vocabulary = vocabulary or vocabulary_path()
    end = array("I", [END]).tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = coder(vocabulary)
        rows: list[tuple] = []
        for at, data in enumerate(code.ids(batch.column(1))):
            data += end
            for piece, i in enumerate(range(0, len(data), 4 * capacity)):
                part = data[i : i + 4 * capacity]
                rows.append((at, piece, i // 4, len(part) // 4, zlib.crc32(part), part))
        at, piece, start, length, crc, parts = zip(*rows, strict=True) if rows else ((),) * 6
        columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = [id_col, "piece", "start", "length", "ids_crc32"]
        if with_ids:
            offsets = np.cumsum([0, *length]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow(docs.select(id_col, F.col(text_col).cast("binary")), run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity, and its counts."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        best[c], pick[c] = best[c - 1], -1
        fits = sizes <= c
        gain = np.where(fits, best[c - np.where(fits, sizes, 0)] + values, -1.0)
        i = int(gain.argmax())
        if gain[i] > best[c] + 1e-12:
            best[c], pick[c] = gain[i], i
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c >= sizes.min():
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations (counts of each size) and whole uses of each that together cover no more than the demand.

    Column generation: the basis prices each size, a knapsack finds the configuration that prices best, and it
    enters the basis, until none is worth more than a sequence. Uses are rounded down.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        use = inverse @ demand
        price = np.ones(k) @ inverse
        value, counts = knapsack(sizes, price, capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ counts
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = counts
    uses = np.floor(np.maximum(np.linalg.solve(basis, demand), 0) + 1e-9).astype(np.int64)
    return [(basis[:, j].round().astype(np.int64), int(uses[j])) for j in range(k) if uses[j]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, *, large: float = LARGE, groups: int = GROUPS) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a sequence) and how often each is used, for so many pieces of each length."""
    left = {n: c for n, c in sorted(histogram.items(), reverse=True) if c}
    done: list[tuple[list[int], int]] = []
    if capacity in left:
        done.append(([capacity], left.pop(capacity)))
    big = [(n, c) for n, c in left.items() if n > large * capacity]
    small = [(n, c) for n, c in left.items() if n <= large * capacity]

    # linear grouping: lists of actual lengths, longest first, cut into groups of equal cardinality
    total = sum(c for _, c in big)
    grouped: list[list[list[int]]] = []
    share, room = -(-total // groups) if total else 0, 0
    for n, c in big:
        while c:
            if not room:
                grouped.append([])
                room = share
            take = min(c, room)
            grouped[-1].append([n, take])
            c, room = c - take, room - take

    open_: list[tuple[list[int], int]] = []  # patterns with room, and uses
    if grouped:
        rounded = np.array([g[0][0] for g in grouped])
        sizes = np.unique(rounded)
        stock = {int(s): [x for g, r in zip(grouped, rounded, strict=True) if r == s for x in g] for s in sizes}
        demand = np.array([sum(c for _, c in stock[int(s)]) for s in sizes], float)
        for counts, uses in configurations(sizes, demand, capacity):
            slots = [int(s) for s, q in zip(sizes, counts, strict=True) for _ in range(int(q))]
            # each slot takes its uses from its size's list; where an actual length ends, the pattern splits
            runs = []
            for s in slots:
                need, run = uses, []
                while need and stock[s]:
                    take = min(need, stock[s][0][1])
                    run.append((stock[s][0][0], take))
                    stock[s][0][1] -= take
                    need -= take
                    if not stock[s][0][1]:
                        stock[s].pop(0)
                runs.append(run)
            edges = sorted({0, *(int(e) for run in runs for e in np.cumsum([t for _, t in run]))})
            for a, b in zip(edges, edges[1:], strict=False):
                pattern = []
                for run in runs:
                    at = 0
                    for n, t in run:
                        if at <= a < at + t:
                            pattern.append(n)
                        at += t
                open_.append((pattern, b - a))
        # what rounding the uses down has left is placed like small pieces, longest first
        rest: dict[int, int] = {}
        for lot in stock.values():
            for n, c in lot:
                rest[n] = rest.get(n, 0) + c
        small = sorted(((n, c) for n, c in rest.items() if c), reverse=True) + small

    # best fit: patterns by free room; the fullest that has room takes the piece
    free: list[list[tuple[list[int], int]]] = [[] for _ in range(capacity + 1)]
    for pattern, uses in open_:
        free[capacity - sum(pattern)].append((pattern, uses))
    for n, c in small:
        room = n
        while c:
            while room <= capacity and not free[room]:
                room += 1
            if room > capacity:
                # new sequences, each filled with as many of these as it holds
                per = capacity // n
                full, odd = divmod(c, per)
                if full:
                    free[capacity - per * n].append(([n] * per, full))
                if odd:
                    free[capacity - odd * n].append(([n] * odd, 1))
                c = 0
                break
            pattern, uses = free[room].pop()
            fit = room // n
            full, odd = divmod(c, fit)
            take = min(uses, full)
            if take:
                free[room - fit * n].append((pattern + [n] * fit, take))
                c, uses = c - take * fit, uses - take
            if uses and c and c < fit:
                free[room - c * n].append((pattern + [n] * c, 1))
                c, uses = 0, uses - 1
            if uses:
                free[room].append((pattern, uses))
    return done + [x for lot in free for x in lot]


class Places:
    """The plan as arrays: for a length and a number among its pieces, the sequence and the offset."""

    def __init__(self, patterns: list[tuple[list[int], int]]):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for pattern, uses in patterns:
            offset = 0
            for n in pattern:
                rows.append((n, used.get(n, 0), sequence, offset))
                used[n] = used.get(n, 0) + uses
                offset += n
            sequence += uses
        self.sequences = sequence
        table_ = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.keys = (table_[:, 0] << 48) | table_[:, 1]
        self.first, self.sequence, self.offset = table_[:, 1], table_[:, 2], table_[:, 3]

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << 48) | number, side="right") - 1
        return self.sequence[at] + number - self.first[at], self.offset[at]


def numbered(cut: DataFrame, keys: list[str]) -> DataFrame:
    """``cut`` with ``number``: 0, 1, ... within each length."""
    dealt = cut.withColumn("_dealt", F.pmod(F.xxhash64(*keys), F.lit(DEALT)))
    counts = dealt.groupBy("length", "_dealt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_dealt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_dealt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_dealt").orderBy(*keys))
    return dealt.withColumn("_own", own).join(starts, ["length", "_dealt"]).withColumn("number", F.col("_before") + F.col("_own") - 1).drop("_dealt", "_own", "_before")


def pack(cut: DataFrame, *, keys: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a table of pieces with ``length``) with sequence_id and offset."""
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(plan(histogram, capacity))
    rows = numbered(cut, list(keys))
    names = [c for c in rows.columns if c != "number"]
    rows = rows.select(*names, "number")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch.column(names.index("length")).to_numpy()
        sequence, offset = places.find(length, batch.column(len(names)).to_numpy())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return arrow(rows, run, f"{kinds}, sequence_id long, offset long", rows=10_000)


def packed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with their places; tokens are counted once, kept as lengths and checksums."""
    cut = stored(pieces(docs, id_col=id_col, text_col=text_col, with_ids=False), "pieces")
    return pack(cut, keys=(id_col, "piece")).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence and offset of every piece of every document."""
    return packed_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
