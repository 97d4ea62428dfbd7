"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.llm.common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in ``edges`` (u, v): label is the smallest id that it reaches.

    Each round lets every id hand its larger neighbours, then its smaller ones, over to its least neighbour, until
    nothing changes: few rounds, as paths shrink by halves. Edges stay in tables; the driver sees two sums a round.
    """
    links = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = links.union(links.select("v", "u")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u")
        last, links = links, stored(smaller.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct(), "links")
        dropped(last)
        after = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == after:
            break
        before = after
    roots = links.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return links.select(F.col("u").alias("id"), F.col("v").alias("label")).union(roots)
