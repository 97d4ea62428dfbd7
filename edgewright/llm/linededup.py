"""Line dedup with levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case; keys count from ``LEAST``
code points on, and are compared by 128 bits of their SHA-256. Documents come in batches, the largest ids first. A
batch's keys are counted by document, then anti-joined with the runs: keys that the runs say are settled (in ``COPIES``
documents or more, at one of which the line stays) need no further entry. The others become the batch's own run. Runs
are tables in buckets of the key, sorted within, so that the anti-join merges them with the batch and doesn't shuffle
them; ``FANOUT`` runs of a level are compacted into one of the next, which adds their counts up. As ids descend from
batch to batch, a key's largest document is in its oldest entry.

In the end all runs make one table of repeated keys and the largest document of each. Lines, as (key, document, place),
meet it by a join that Spark splits where a key is in very many lines. What comes back to a document are the places that
it loses; the text itself moves once, to meet them.

Null and empty texts are one empty line. Rows with one doc_id are one document, whose lines all stay where that is the
key's largest; each row keeps its own text. A null doc_id counts as one document that is smaller than all others. Extra
columns are ignored, and an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.llm.common import WHITE, passing, removed, shared_dir, stored, table

#: Code points from which on a key counts, documents that make it a repeat, batches, and runs of a level.
LEAST, COPIES, BATCHES, FANOUT = 20, 3, 8, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_text(line: Column) -> Column:
    """The line without white space at its ends and A-Z in lower case. ``lower`` changes other letters too, so it serves
    where a line is ASCII, or as a quick test of whether there is anything to change."""
    bare = F.trim(line, F.lit(WHITE))
    small = F.lower(bare)
    return F.when((small == bare) | (F.octet_length(bare) == F.length(bare)), small).otherwise(F.translate(bare, _UPPER, _LOWER))


def key_hash(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def lines(docs: DataFrame) -> DataFrame:
    """(key, doc_id, body, place) of every line with a key; ``body`` tells rows of one doc_id apart."""
    # the text must not go with each of its lines, so what is known of it is known before they part
    whole = docs.select("doc_id", F.xxhash64("text").alias("body"), F.split("text", "\n").alias("lines"))
    split = whole.select("doc_id", "body", F.posexplode("lines").alias("place", "line"))
    keyed = split.where(F.length("line") >= LEAST).withColumn("line", key_text(F.col("line"))).where(F.length("line") >= LEAST)
    return keyed.select(key_hash(F.col("line")).alias("key"), "doc_id", "body", "place")


@dataclass
class Runs:
    """Sorted runs of (key, docs, last) by level, the newest of a level last; bucketed tables in the shared folder."""

    spark: SparkSession
    buckets: int
    levels: list[list[str]] = field(default_factory=list)

    def _path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/edgewright/{name}"

    def _written(self, entries: DataFrame) -> str:
        name = f"edgewright_run_{uuid.uuid4().hex}"
        entries.write.bucketBy(self.buckets, "key").sortBy("key").option("path", self._path(name)).saveAsTable(name)
        passing(self.spark, self._path(name))
        return name

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def counted(self, names: list[str]) -> DataFrame:
        """The entries of runs, one for each key. Runs are read as plain files here: a union of bucketed tables passes for
        dealt by key, and was not (Spark 4.1)."""
        entries = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*map(self._path, names))
        return entries.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def add(self, batch: DataFrame) -> None:
        """A batch of lines (key, doc_id) whose documents are in no other batch: its keys that no run has settled become
        a run; levels that are full are compacted. Counting deals the keys into as many tasks as there are buckets."""
        pairs = batch.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
        new = pairs.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
        for name in self.names():
            new = new.hint("merge").join(self.spark.table(name).where(F.col("docs") >= COPIES).select("key"), "key", "left_anti")
        self._put(0, self._written(new))

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(full := self.levels[level]) == FANOUT:
            merged = self._written(self.counted(full))
            self.levels[level] = []
            for n in full:
                self._drop(n)
            self._put(level + 1, merged)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        removed(self.spark, self._path(name))

    def repeated(self) -> DataFrame:
        """(key, last) of the keys in at least ``COPIES`` documents, stored; the runs go."""
        found = stored(self.counted(self.names()).where(F.col("docs") >= COPIES).select("key", "last"), "repeated")
        for name in self.names():
            self._drop(name)
        self.levels = []
        return found


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Ids that part the documents into about equal batches, ascending."""
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] if shares else None
    return sorted({*(cuts or [])})


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(id_col, n_lines, n_dropped, kept): the texts without the lines that a document with a larger id has too, if
    ``COPIES`` documents have them."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = F.array(*map(F.lit, batch_bounds(docs, batches))).cast("array<bigint>")
    batch = F.coalesce(F.size(F.filter(cuts, lambda c: c <= F.col("doc_id"))), F.lit(0))
    found = stored(lines(docs).withColumn("batch", batch), "lines", by="batch")
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for i in reversed(range(batches)):
        runs.add(found.where(F.col("batch") == i).select("key", "doc_id"))
    repeated = runs.repeated()
    other = ~F.col("doc_id").eqNullSafe(F.col("last"))
    lost = found.select("key", "doc_id", "body", "place").join(repeated, "key").where(other)
    lost = lost.groupBy("doc_id", "body").agg(F.collect_list("place").alias("lost")).withColumnRenamed("doc_id", "lost_id").withColumnRenamed("body", "lost_body")
    own = docs.withColumn("body", F.xxhash64("text"))
    joined = own.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("body") == F.col("lost_body")), "left")
    parts = F.split("text", "\n")
    n = F.size(parts)
    # the places that stay, by a set difference, linear in the lines; the struct keeps the lines from being split for each
    both = F.struct(parts.alias("lines"), F.array_except(F.sequence(F.lit(0), n - 1), F.col("lost")).alias("stay"))
    rest = F.transform(F.array(both), lambda x: F.array_join(F.transform(x["stay"], lambda i: F.get(x["lines"], i)), "\n"))[0]
    loses = F.col("lost").isNotNull()
    return joined.select(
        F.col("doc_id").alias(id_col), n.cast("bigint").alias("n_lines"), F.when(loses, F.size(F.array_distinct("lost"))).otherwise(0).cast("bigint").alias("n_dropped"),
        F.when(loses, rest).otherwise(F.col("text")).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without repeated lines, as digests."""
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= {COPIES}),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.last AS lost FROM k LEFT JOIN r USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY row
"""
