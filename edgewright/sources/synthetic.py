"""Generated data for trials and tests: the same rows for a seed on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewright.functions import rng


def normal(*key) -> Column:
    """A standard normal number for a key."""
    u, v = rng.uniform(*key, "u"), rng.uniform(*key, "v")
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def random_walk(spark: SparkSession, bars: int = 1500, symbols: int = 1, *, drift: float = 0.0003, vol: float = 0.01, seed: int = 7, regime: int | None = None) -> DataFrame:
    """Bars of a drifted walk for each symbol; with ``regime`` the drift turns every so many bars."""
    grid = spark.range(symbols * bars).select(F.concat(F.lit("S"), (F.col("id") / bars).cast("int")).alias("symbol"), (F.col("id") % bars).alias("bar_seq"))
    turn = F.when(F.floor(F.col("bar_seq") / regime) % 2 == 0, 1.0).otherwise(-1.0) if regime else F.lit(1.0)
    z = lambda tag: normal(seed, tag, F.col("symbol"), F.col("bar_seq"))
    w = Window.partitionBy("symbol").orderBy("bar_seq")
    steps = grid.withColumn("x", drift * turn + vol * z("c")).withColumn("close", 100 * F.exp(F.sum("x").over(w)))
    steps = steps.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)) * F.exp(0.2 * vol * z("o")))
    wide = lambda tag: F.exp(0.5 * vol * F.abs(z(tag)))
    return steps.select("symbol", "bar_seq", F.timestamp_seconds(946_684_800 + 86_400 * F.col("bar_seq")).alias("ts"), "open", (F.greatest("open", "close") * wide("h")).alias("high"), (F.least("open", "close") / wide("l")).alias("low"), "close")


def factor_panel(spark: SparkSession, dates: int = 250, blocs: int = 3, each: int = 4, *, share: float = 0.7, seed: int = 7) -> DataFrame:
    """Returns of assets in blocs that share a factor: (ts, asset, ret)."""
    grid = spark.range(dates * blocs * each).select((F.col("id") % dates).alias("ts"), (F.col("id") / dates).cast("int").alias("a"))
    common = normal(seed, "f", F.col("ts"), F.floor(F.col("a") / each))
    own = normal(seed, "e", F.col("ts"), F.col("a"))
    return grid.select("ts", F.concat(F.lit("A"), "a").alias("asset"), (0.01 * (math.sqrt(share) * common + math.sqrt(1 - share) * own)).alias("ret"))


def r_book(spark: SparkSession, n: int = 400, *, edge: float = 1.0, seed: int = 7) -> DataFrame:
    """A trade log whose mean is scaled by ``edge``, four trades a week."""
    r = F.when(rng.uniform(seed, "w", F.col("id")) < 0.45, 1.6 + 0.4 * normal(seed, "g", F.col("id"))).otherwise(-1.0 + 0.1 * normal(seed, "l", F.col("id")))
    at = F.timestamp_seconds(946_684_800 + 151_200 * F.col("id"))
    return spark.range(n).select(F.col("id").alias("trade_seq"), (r + 0.12 * (edge - 1)).alias("r"), at.alias("entry_date"), (at + F.make_dt_interval(F.lit(2))).alias("exit_date"))


def scored_book(spark: SparkSession, n: int = 2000, *, skill: float = 0.5, seed: int = 7) -> DataFrame:
    """Predictions whose score tells outcomes as well as ``skill`` says: (row_seq, score, label)."""
    s = normal(seed, "s", F.col("id"))
    return spark.range(n).select(F.col("id").alias("row_seq"), s.alias("score"), F.when(skill * s + normal(seed, "n", F.col("id")) > 0, 1.0).otherwise(-1.0).alias("label"))


def thin(trades: DataFrame, keep: float, *, seed: int = 7) -> DataFrame:
    """About the share ``keep`` of the trades."""
    return trades.where(rng.uniform(seed, "t", F.col("trade_seq")) < keep)
