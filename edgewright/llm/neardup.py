"""Near-duplicate groups by one-permutation MinHash with optimal densification.

A document's set is its distinct shingles of five words (ASCII capitals lowered). Equal sets fall into one class
first, so exact copies cost one row each. A class's sketch hashes every shingle once and keeps the least hash of
each bin; an empty bin takes the value of the first filled bin in a random order of its own, the same for all
documents. Bands of the sketch are buckets, and each bucket is searched as a star: its members are compared with
one centre, the member that shares most buckets, on their full sets. Links become components.

Members of one star that ended in different components may still be links of each other: they then share shingles
that their centre lacks. So of what each member adds to its centre, the least in some random orders are the buckets of
the next round, of which only those stay whose members are in different components. Stars again, with centres of their own,
until no such bucket is left; each round's buckets ask for one more such shingle, so what only shares a passage soon
falls apart. The candidates of a round are as many as the rows of its buckets, never their pairs; no pair is compared
twice with the same centre. Members of one star that are alike without sharing anything beside
their centre meet in the buckets of other bands, whose stars have other members.

Null texts and texts without words have an empty set: linked with nothing, kept. Texts of fewer than five words
have one shingle, the whole sequence. Repeated rows of one doc_id stay together if their texts have one set; if
they differ, each row has the component of its own text (where one doc_id is the smallest of several sets, these
are one vertex, compared by the set of least fingerprint). A null doc_id has the component of its set, null if no
other row has that set. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.llm.common import Memo, arrow, dropped, stored, table
from edgewright.llm.components import components

WORDS, SIMILARITY = 5, 85
#: 32 bands of 6 bins find a pair of similarity 0.85 but for 3 in ten million.
BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
#: Random orders of what a member adds to its centre.
DIFFERENCES = 16
#: So many members of a star, about, meet one copy of their centre's set.
SMALL = 64
_random = np.random.default_rng(20_240_601)
_ORDER = np.array([_random.permutation(BINS) for _ in range(BINS)])
_ODD = _random.integers(1, 2**63, (3, max(WORDS + 1, ROWS)), np.uint64) | np.uint64(1)
_BAND = _random.integers(1, 2**63, BANDS, np.uint64)
_APART = _random.integers(1, 2**63, DIFFERENCES, np.uint64) | np.uint64(1)
_HASH = Memo(xxhash.xxh64_intdigest, 50_000, __name__, brief=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = data.lower().split() if data else []
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    _HASH.trim()
    n = min(WORDS, len(words))
    m = len(words) - n + 1
    total = np.full(m, n, np.uint64) * _ODD[0, WORDS]
    for j in range(n):
        total += hashed[j : j + m] * _ODD[0, j]
    return np.unique(_mix(total))


def sketch(found: np.ndarray) -> np.ndarray:
    """The band hashes of a set that isn't empty."""
    bins = (((found >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    values, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]], filled[bins[first]] = found[first], True
    empty = np.flatnonzero(~filled)
    if empty.size:
        order = _ORDER[empty]
        values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return _mix((values.reshape(BANDS, ROWS) * _ODD[1, :ROWS]).sum(axis=1, dtype=np.uint64) + _BAND)


def prints(found: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set."""
    return int(found.sum(dtype=np.uint64)), int(_mix(found ^ _ODD[2, 0]).sum(dtype=np.uint64))


def _longs(values: list) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)))


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, f1 and f2: a 128-bit fingerprint of the set, bands array<long>) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        f1, f2 = zip(*map(prints, sets), strict=True) if sets else ((), ())
        bands = [sketch(s) if s.size else s for s in sets]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.size for s in sets], pa.int64()), _longs(f1), _longs(f2), _lists(bands)], ["doc_id", "n_shingles", "f1", "f2", "bands"])

    found = arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")), run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")
    # empty sets join nothing: their own ids spread them
    return found.withColumn("f1", F.when(F.col("n_shingles") > 0, F.col("f1")).otherwise(F.col("doc_id")))


def shingle_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f1, f2, shingles array<long>) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        f1, f2 = zip(*map(prints, sets), strict=True) if sets else ((), ())
        return pa.RecordBatch.from_arrays([batch.column(0), _longs(f1), _longs(f2), _lists(sets)], ["doc_id", "f1", "f2", "shingles"])

    return arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")), run, "doc_id long, f1 long, f2 long, shingles array<long>")


def compared(pairs: DataFrame, sets: DataFrame, rows: int = 1) -> DataFrame:
    """The pairs (u: a centre, v) with their sizes nu and nv, how many shingles they share, k, and of those that
    v has alone the least in each of some random orders, ``rows`` in a row as one, each once, ``apart``. A centre of many members comes in copies, each for some of them."""
    copies = pairs.groupBy("u").agg(F.ceil(F.count("*") / SMALL).cast("int").alias("copies"))
    part = F.pmod(F.xxhash64("v"), F.col("copies")).cast("int").alias("part")
    members = pairs.join(copies, "u").select("u", "v", part).join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv")), "v")
    centres = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su")).join(copies, "u").select("u", "su", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = []
        for column in (batch.column(2), batch.column(3)):
            at = column.offsets.to_numpy()
            values = column.values.to_numpy().view(np.uint64)
            sides.append([values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        size, shared, apart = ([], []), [], []
        for a, b in zip(*sides, strict=True):
            differ = np.setdiff1d(b, a, assume_unique=True)
            size[0].append(len(a))
            size[1].append(len(b))
            shared.append(len(b) - len(differ))
            least = np.array([differ[_mix(differ ^ x).argmin()] for x in _APART], np.uint64) if differ.size else differ
            apart.append(np.unique(_mix(sum(np.roll(least, -i) * _APART[i] for i in range(rows)))))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (*size, shared)), _lists(apart)], ["u", "v", "nu", "nv", "k", "apart"])

    return arrow(members.join(centres, ["u", "part"]).select("u", "v", "su", "sv"), run, "u long, v long, nu long, nv long, k long, apart array<long>", rows=256)


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; ``similarity`` in hundredths."""
    sketched = stored(sketches(docs, id_col=id_col, text_col=text_col), "sketches")
    filled = sketched.where("n_shingles > 0")
    classes = stored(filled.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    # one vertex for each class: its smallest document; where that has several sets, the set of least fingerprint
    nodes = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.min(F.struct("f1", "f2")).alias("f")).select("doc_id", "f.f1", "f.f2")
    reps = filled.join(nodes, ["doc_id", "f1", "f2"]).dropDuplicates(["doc_id", "f1", "f2"])
    exploded = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(exploded.join(shared, "bucket"), "members")
    scores = stored(members.groupBy("doc_id").agg(F.sum("size").alias("score")), "scores")

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = nodes.join(scores, "doc_id", "left_semi")
    sets = stored(shingle_sets(texts.join(scores, "doc_id", "left_semi")).join(own, ["doc_id", "f1", "f2"]).dropDuplicates(["doc_id", "f1", "f2"]).select("doc_id", "shingles"), "sets")

    labels: DataFrame | None = None
    seen: DataFrame | None = None  # pairs of a centre and a member that were compared

    def labelled(rows: DataFrame, key: str, name: str) -> DataFrame:
        found = rows.join(labels.select(F.col("id").alias(key), F.col("label").alias(name)), key, "left")
        return found.withColumn(name, F.coalesce(name, key))

    rounds = 0
    while not members.isEmpty():
        rounds += 1
        scored = members.select("bucket", "doc_id").join(scores, "doc_id")
        centre = F.max(F.struct("score", (-F.col("doc_id")).alias("minus"))).alias("c")
        centres = scored.groupBy("bucket").agg(centre).select("bucket", (-F.col("c.minus")).alias("u"))
        pairs = members.select("bucket", F.col("doc_id").alias("v")).join(centres, "bucket").where("u != v").select("u", "v").distinct()
        if labels is not None:  # what is linked with its centre already isn't compared with it again
            pairs = labelled(labelled(pairs, "u", "lu"), "v", "lv").where("lu != lv").select("u", "v")
        pairs = stored(pairs if seen is None else pairs.join(seen, ["u", "v"], "left_anti"), "pairs")
        stars = stored(compared(pairs, sets, min(rounds, DIFFERENCES)), "stars")
        seen = pairs if seen is None else seen.union(pairs)

        links = stars.where(100 * F.col("k") >= similarity * (F.col("nu") + F.col("nv") - F.col("k"))).select("u", "v")
        if labels is None:
            labels = stored(components(links), "labels")
        else:  # only the components that new links join
            ends = stored(labelled(labelled(links, "u", "lu"), "v", "lv").where("lu != lv").select(F.col("lu").alias("u"), F.col("lv").alias("v")).distinct(), "ends")
            if not ends.isEmpty():
                joined = stored(components(ends), "joined")
                renamed = labels.join(joined.select(F.col("id").alias("label"), F.col("label").alias("new")), "label", "left")
                last, labels = labels, stored(renamed.select("id", F.coalesce("new", "label").alias("label")).union(joined).distinct(), "labels")
                dropped(last, joined)
            dropped(ends)

        # members of a star in different components meet again where they add the same to its centre
        marked = labelled(stars.select("u", "v", "apart"), "v", "label")
        open_ = marked.groupBy("u").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("u")
        apart = marked.join(open_, "u", "left_semi").select("v", "label", F.explode("apart").alias("hash"), "u")
        apart = stored(apart.select(F.xxhash64("u", "hash").alias("bucket"), F.col("v").alias("doc_id"), "label"), "apart")
        mixed = apart.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
        last, members = members, stored(apart.select("bucket", "doc_id").join(mixed, "bucket", "left_semi"), "members")
        dropped(last, stars, apart)

    dropped(sets)
    named = classes.withColumnRenamed("rep", "doc_id")
    named = labelled(named, "doc_id", "label") if labels is not None else named.withColumn("label", F.col("doc_id"))
    return sketched.join(named.select("f1", "f2", "label"), ["f1", "f2"], "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def keep(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, of the document with the smallest id in each group."""
    gone = stored(groups(docs, id_col=id_col, text_col=text_col, similarity=similarity).where("doc_id != component_id").select(F.col("doc_id").alias(id_col)), "gone")
    return docs.join(gone, id_col, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    found = groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


#: Sets of shingles, all pairs that share one, and their components, as SQL.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT u, v FROM p JOIN c cu ON cu.doc_id = u JOIN c cv ON cv.doc_id = v WHERE 100 * k >= 85 * (cu.n + cv.n - k)),
l AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.id WHERE r.root < l.v),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w LEFT JOIN c ON c.doc_id = w.doc_id JOIN m ON m.id = w.doc_id
"""
