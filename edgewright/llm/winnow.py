"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are runs of up to ``PIECE`` characters that aren't white space. Each run of ``GRAM`` tokens is hashed from
its tokens' hashes; of every ``SPAN`` such hashes in a row the least is chosen, the rightmost of equal ones, and
kept with its position. Two texts that share ``GRAM + SPAN - 1`` tokens in a row therefore share a chosen hash.
A text of fewer than ``GRAM`` tokens has one hash of all its tokens; one of fewer than ``SPAN`` hashes keeps its
least. The likeness of two fingerprints is twice the shared hashes over the hashes of both (1 for two equal empty
texts, 0 if one is empty).

Nulls count as empty texts with an empty fingerprint. Documents are put side by side with the next by doc_id in
ranges of ids; the first document of each range is also told to the range before it. Rows that repeat a doc_id are
ordered by their text. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewright.llm.common import stored, table

GRAM, SPAN, PIECE = 3, 4, 24
#: A range of ids has about so many documents.
RANGE = 2048
#: The low bits of a packed choice count positions down, so that the least of equal hashes is the rightmost.
_BITS = 30
_MASK = (1 << _BITS) - 1


def tokens(text: Column) -> Column:
    """Runs of characters that aren't ASCII white space, long ones in pieces."""
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]{1,%d})" % PIECE), F.lit(1))


def _pairs(values: Column, step: int) -> Column:
    """The lesser of each value and the one ``step`` after it."""
    return F.transform(F.sequence(F.lit(0), F.size(values) - step - 1), lambda i: F.least(F.get(values, i), F.get(values, i + step)))


def chosen(text: Column) -> dict[str, Column]:
    """Columns to add in order; the last, ``picks``, has the packed choices: 34 bits of hash, then the position counted down."""
    return {
        "tokens": F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.xxhash64(t)),
        "grams": F.when(F.size("tokens") == 0, F.array().cast("array<bigint>"))
        .when(F.size("tokens") < GRAM, F.array(F.xxhash64("tokens")))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size("tokens") - GRAM), lambda i: F.xxhash64(*(F.get("tokens", i + j) for j in range(GRAM))))),
        "ranked": F.transform("grams", lambda h, i: F.shiftleft(F.shiftrightunsigned(h, _BITS), _BITS).bitwiseOR(F.lit(_MASK) - i)),
        "twos": F.when(F.size("ranked") >= SPAN, _pairs(F.col("ranked"), 1)),
        "picks": F.when(F.size("ranked") == 0, F.col("ranked")).when(F.size("ranked") < SPAN, F.array(F.array_min("ranked"))).otherwise(F.array_distinct(_pairs(F.col("twos"), 2))),
    }


def winnowed(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``: the chosen hashes with their positions, packed, in order of position."""
    rest = df.columns
    for name, value in chosen(F.col(text_col)).items():
        df = df.withColumn(name, value)
    return df.select(*rest, F.col("picks").alias(out))


def unpacked(picks: str) -> Column:
    """The choices as array<struct<hash, position>>; positions count tokens from 0."""
    return F.transform(picks, lambda p: F.struct(F.shiftrightunsigned(p, _BITS).alias("hash"), (F.lit(_MASK) - p.bitwiseAND(F.lit(_MASK))).cast("int").alias("position")))


def written(picks: str) -> Column:
    """A fingerprint as text: hash@position, the hash in base 16, joined by spaces."""
    return F.array_join(F.transform(picks, lambda p: F.concat(F.lower(F.hex(F.shiftrightunsigned(p, _BITS))), F.lit("@"), (F.lit(_MASK) - p.bitwiseAND(F.lit(_MASK))).cast("string"))), " ")


def hashes(picks: str) -> Column:
    return F.array_distinct(F.transform(picks, lambda p: F.shiftrightunsigned(p, _BITS)))


def likeness(a: str, b: str) -> Column:
    """Of two arrays of distinct hashes."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / F.greatest(total, F.lit(1)))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (id, text and others) with ``next``: the struct of text and ``columns`` of the next row by id; after the last, the first.

    Ranges of ids are as many as the number of documents asks for; a window looks ahead inside each. What goes to
    the driver is the count and the ends of the ids; the first id of each range is a small table.
    """
    low, high, n = docs.agg(F.min(id_col), F.max(id_col), F.count("*")).first()
    if low is None:
        low = high = 0
    width = max(1, math.ceil((high - low + 1) / max(1, math.ceil(n / RANGE))))
    ranged = docs.withColumn("_range", F.floor((F.coalesce(id_col, F.lit(low)) - F.lit(low)) / F.lit(width)).cast("long"))
    firsts = ranged.groupBy("_range").agg(F.min(id_col).alias("_first"))
    around = Window.orderBy("_range")
    # of ranges, not documents: one row for thousands of them
    told = stored(firsts.select("_first", F.coalesce(F.lag("_range").over(around), F.last("_range").over(around.rowsBetween(Window.currentRow, Window.unboundedFollowing))).alias("_to")), "firsts")
    one = F.row_number().over(Window.partitionBy("_to").orderBy(id_col, text_col))
    guests = ranged.join(told, ranged[id_col] == told["_first"]).withColumn("_row", one).where("_row = 1").select(*docs.columns, F.col("_to").alias("_range"), F.lit(1).alias("_guest"), F.col("_first").alias("_own"))
    rows = ranged.withColumns({"_guest": F.lit(0), "_own": F.col(id_col)}).unionByName(guests)
    ahead = F.lead(F.struct(text_col, *columns)).over(Window.partitionBy("_range").orderBy("_guest", id_col, text_col))
    return rows.withColumn("next", ahead).where("_guest = 0").drop("_range", "_guest", "_own")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited, picks, edited_picks, near_edited, near_next) of every row."""
    texts = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text"))
    own = with_next(texts, id_col=id_col)
    n = F.col("n_chars")
    half = F.floor(n / 2).cast("int")
    edited = own.withColumn("n_chars", F.length("text").cast("long")).select(id_col, "n_chars", "text", F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next.text", F.lit(1), half)).alias("edited"), F.col("next.text").alias("following"))
    found = winnowed(winnowed(winnowed(edited, "text", "own"), "edited", "edited_own"), "following", "next_own")
    for name in ("own", "edited_own", "next_own"):
        found = found.withColumn(f"{name}_set", hashes(name))
    return found.select(id_col, "n_chars", "edited", F.col("own").alias("picks"), F.col("edited_own").alias("edited_picks"), likeness("own_set", "edited_own_set").alias("near_edited"), likeness("own_set", "next_own_set").alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    found = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written("picks").alias("fingerprint"), written("edited_picks").alias("edited_fingerprint"), "near_edited", "near_next")
