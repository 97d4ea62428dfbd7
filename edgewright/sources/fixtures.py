"""Adapters from the TPC-H-like tables to trade logs, price frames, predictions and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewright.schema import trade_log


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade for each order: R from its price, excursions, bars and odds from its keys, dates from its date."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    # floors, unlike rounding, are the same in every engine
    r = F.floor((F.col("o_totalprice") - 140000) / 12.0 + 0.5) / 10000.0
    held = (1 + k % 19).cast("int")
    found = read(spark, sf_dir, "orders").select(
        k.alias("trade_seq"),
        r.alias("r"),
        F.round(F.greatest(r, F.lit(0.0)) + (c % 7) / 10.0, 6).alias("mfe"),
        (-F.round(F.greatest(-r, F.lit(0.0)) + (c % 5) / 10.0, 6)).alias("mae"),
        held.alias("bars_held"),
        F.round(0.45 + (k % 50) / 100.0, 2).alias("prob"),
        F.col("o_orderdate").alias("entry_date"),
        (F.col("o_orderdate") + F.make_dt_interval(held)).alias("exit_date"),
        F.when(k % 4 == 0, "timeout").when(r > 0, "TP").otherwise("SL").alias("exit_reason"),
        F.col("o_orderpriority").alias("segment"),
        (0.01 * (k % 3)).alias("cost_r"),
    )
    return trade_log(found)


TRADES = """
SELECT o_orderkey AS trade_seq, r, round(greatest(r, 0.0) + (o_custkey % 7) / 10.0, 6) AS mfe, -round(greatest(-r, 0.0) + (o_custkey % 5) / 10.0, 6) AS mae,
  (1 + o_orderkey % 19)::INT AS bars_held, round(0.45 + (o_orderkey % 50) / 100.0, 2) AS prob, o_orderdate AS entry_date,
  o_orderdate + to_days((1 + o_orderkey % 19)::INT) AS exit_date, CASE WHEN o_orderkey % 4 = 0 THEN 'timeout' WHEN r > 0 THEN 'TP' ELSE 'SL' END AS exit_reason,
  o_orderpriority AS segment, 0.01 * (o_orderkey % 3) AS cost_r
FROM (SELECT *, floor((o_totalprice - 140000) / 12.0 + 0.5) / 10000.0::DOUBLE AS r FROM orders)
"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars for each priority and week of orders: first, highest, lowest and last price by order key."""
    o = read(spark, sf_dir, "orders").withColumn("week", F.date_trunc("week", "o_orderdate"))
    p = F.col("o_totalprice") / 1000
    bars = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("week").alias("ts")).agg(
        F.min_by(p, "o_orderkey").alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, "o_orderkey").alias("close")
    )
    return bars.withColumn("bar_seq", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")).cast("bigint") - 1)


PRICES = """
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_seq FROM (
  SELECT o_orderpriority AS symbol, date_trunc('week', o_orderdate)::TIMESTAMP AS ts, arg_min(o_totalprice, o_orderkey) / 1000 AS open, max(o_totalprice) / 1000 AS high,
    min(o_totalprice) / 1000 AS low, arg_max(o_totalprice, o_orderkey) / 1000 AS close
  FROM orders GROUP BY ALL)
"""


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean R of each week's entries, in order: a short series for resampling."""
    found = trades(spark, sf_dir).groupBy(F.date_trunc("week", "entry_date").alias("week")).agg(F.round(F.avg("r"), 6).alias("r"))
    return found.withColumn("trade_seq", (F.row_number().over(Window.orderBy("week")) - 1).cast("bigint")).select("trade_seq", "r", "week")


WEEKLY = f"""
SELECT row_number() OVER (ORDER BY week) - 1 AS trade_seq, r, week FROM (SELECT date_trunc('week', entry_date) AS week, round(avg(r), 6) AS r FROM ({TRADES}) GROUP BY 1)
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and a label for each order: its price with noise from its key, and whether the trade won."""
    t = read(spark, sf_dir, "orders")
    return t.select(F.col("o_orderkey").alias("row_seq"), F.round(F.floor("o_totalprice") / 1000.0 + (F.col("o_orderkey") * 37 % 400), 3).alias("score"), F.when(F.col("o_totalprice") > 140000, 1.0).otherwise(-1.0).alias("label"))


PREDICTIONS = """
SELECT o_orderkey AS row_seq, round(floor(o_totalprice) / 1000.0::DOUBLE + (o_orderkey * 37 % 400), 3) AS score, CASE WHEN o_totalprice > 140000 THEN 1.0 ELSE -1.0 END::DOUBLE AS label FROM orders
"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly returns of every symbol: (ts, asset, ret)."""
    p = prices(spark, sf_dir)
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("bar_seq"))
    return p.select("ts", F.col("symbol").alias("asset"), (F.try_divide(F.col("close"), before) - 1).alias("ret")).where("ret is not null")


PANEL = f"""
SELECT ts, symbol AS asset, ret FROM (SELECT ts, symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_seq) - 1 AS ret FROM ({PRICES})) WHERE ret IS NOT NULL
"""
