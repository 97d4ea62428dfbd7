"""Temporal splits, segment and window grids, calendar series and point-in-time slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.operators import metrics
from edgewright.operators.resample import reality_check
from edgewright.schema import clean


def side(split: str, embargo_weeks: int = 8) -> Column:
    """train: entered and left before the split; test: entered after the embargo; else NULL."""
    at = F.lit(split).cast("timestamp")
    start = at + F.make_dt_interval(F.lit(7 * embargo_weeks))
    return F.when((F.col("entry_date") < at) & (F.col("exit_date") < at), "train").when(F.col("entry_date") >= start, "test")


def split_train_test(trades: DataFrame, split: str, embargo_weeks: int = 8) -> DataFrame:
    """``trades`` with ``side``, without those that neither side may see."""
    if missing := [c for c in ("entry_date", "exit_date") if c not in trades.columns]:
        raise ValueError(f"a split by time needs {missing}")
    return trades.withColumn("side", side(split, embargo_weeks)).where("side is not null")


def holdout(trades: DataFrame, split: str, *, embargo_weeks: int = 8, **options) -> DataFrame:
    """The verdict of each side; the test side's is the one that counts."""
    return reality_check(split_train_test(trades, split, embargo_weeks), by=["side"], **options)


def full_sample(trades: DataFrame, **options) -> DataFrame:
    """The verdict on everything, named for what it is."""
    return reality_check(trades, **options).withColumn("side", F.lit("in-sample"))


def segmented_holdout(trades: DataFrame, by: str, split: str, *, embargo_weeks: int = 8, min_n: int = 0, **options) -> DataFrame:
    """Both sides' verdicts overall and for each segment, all with the same split and draws; segments whose test side has
    fewer than ``min_n`` trades are flagged as thin, on both sides."""
    cut = split_train_test(trades, split, embargo_weeks)
    parts = cut.where(F.col(by).isNotNull()).withColumn("segment_", F.col(by).cast("string")).unionByName(cut.withColumn("segment_", F.lit("OVERALL")))
    found = reality_check(parts, by=["segment_", "side"], **options)
    sized = parts.groupBy("segment_").agg(F.count(F.when(F.col("side") == "test", clean("r"))).alias("_test"))
    return found.join(sized, "segment_").withColumn("thin", F.col("_test") < min_n).drop("_test").withColumnRenamed("segment_", "segment")


def windowed_segments(trades: DataFrame, by: str, *, window_years: int = 4, metric: str = "expectancy", min_n: int = 8, start: int | None = None, end: int | None = None) -> DataFrame:
    """(segment, win_ord, y0, y1, n, value, ok): a metric for every segment and window of years, empty cells too.

    One scan with grouping sets gives the segments and OVERALL; years are aligned to the first year, half open.
    """
    ends = trades.agg(F.min(F.year("entry_date")).alias("a"), F.max(F.year("entry_date")).alias("b")).first()
    y0, y1 = start if start is not None else ends.a, end if end is not None else ends.b
    spark = trades.sparkSession
    if y0 is None or y1 is None:
        return spark.createDataFrame([], "segment string, win_ord long, y0 int, y1 int, n long, value double, ok boolean")
    count = -(-(y1 - y0 + 1) // window_years)
    seg, win = F.col(by).cast("string").alias("seg"), F.floor((F.year("entry_date") - y0) / window_years).alias("win_ord")
    rows = trades.select("*", seg, win).where((F.col("win_ord") >= 0) & (F.col("win_ord") < count))
    cells = rows.groupingSets([["seg", "win_ord"], ["win_ord"]], "seg", "win_ord").agg(*metrics.moments(), F.grouping("seg").alias("all_"))
    cells = cells.where("all_ = 1 or seg is not null").select(F.when(F.col("all_") == 1, "OVERALL").otherwise(F.col("seg")).alias("segment"), "win_ord", "n", metrics.SCORES[metric]().alias("value"))
    names = trades.where(F.col(by).isNotNull()).select(seg.alias("segment")).distinct().union(spark.createDataFrame([("OVERALL",)], "segment string")).distinct()
    # the grid has a row for each segment and window; windows are a handful
    grid = names.select("segment", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))).alias("win_ord"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(cells, ["segment", "win_ord"], "left").select(
        "segment", "win_ord", (y0 + window_years * F.col("win_ord")).cast("int").alias("y0"), (y0 + window_years * (F.col("win_ord") + 1)).cast("int").alias("y1"), n.alias("n"), F.when(n > 0, F.col("value")).otherwise(metrics.NAN).alias("value"), (n >= min_n).alias("ok")
    )


def period_r(trades: DataFrame, period: str = "month") -> DataFrame:
    """(period, r): the sum of R of each calendar period by exit (else entry) date, without gaps, by the period's last day."""
    date = next((c for c in ("exit_date", "entry_date") if c in trades.columns), None)
    if date is None:
        return trades.sparkSession.createDataFrame([], "period date, r double")
    rows = trades.where(F.col(date).isNotNull()).groupBy(F.trunc(date, period).alias("period")).agg(F.coalesce(F.sum(clean("r")), F.lit(0.0)).alias("r"))
    step = {"month": "INTERVAL 1 MONTH", "week": "INTERVAL 7 DAYS", "year": "INTERVAL 1 YEAR", "quarter": "INTERVAL 3 MONTHS"}[period]
    every = rows.agg(F.min("period").alias("a"), F.max("period").alias("b")).where("a is not null").select(F.explode(F.expr(f"sequence(a, b, {step})")).alias("period"))
    # a period is named by its last day
    return every.join(rows, "period", "left").select(F.expr(f"CAST(period + {step} - INTERVAL 1 DAY AS DATE)").alias("period"), F.coalesce("r", F.lit(0.0)).alias("r"))


def asof_window(rows: DataFrame, cutoffs: DataFrame, *, lookback: int = 5, key: str = "symbol", time: str = "ts", inclusive: bool = True) -> DataFrame:
    """For each cutoff (key, cutoff) the last ``lookback`` rows of its key at or before it, newest first as ``back`` 1, 2, ...

    Not a range join: rows and cutoffs are one ordered stream for each key, and a cutoff reads how many rows came
    before it; its rows are then those with the next lower numbers, by an equality join.
    """
    tie = F.lit(0 if inclusive else 1)
    marks = cutoffs.select(key, F.col("cutoff").alias("t"), (1 - tie).alias("late"), F.lit(1).alias("mark"))
    stream = rows.select(key, F.col(time).alias("t"), tie.alias("late"), F.lit(0).alias("mark")).unionByName(marks)
    seen = F.sum((F.col("mark") == 0).cast("int")).over(Window.partitionBy(key).orderBy("t", "late", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wanted = stream.withColumn("seen", seen).where("mark = 1").select(key, F.col("t").alias("cutoff"), F.explode(F.expr(f"sequence(1, {lookback})")).alias("back"), "seen").distinct()
    numbered = rows.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(time)))
    return wanted.withColumn("number", F.col("seen") - F.col("back") + 1).where("number > 0").join(numbered, [key, "number"]).drop("number", "seen")


def window_before(rows: DataFrame, cutoffs: DataFrame, **options) -> DataFrame:
    """The same strictly before the cutoff."""
    return asof_window(rows, cutoffs, inclusive=False, **options)


def entered(trades: DataFrame, low: str, high: str) -> DataFrame:
    """Trades entered in [low, high)."""
    return trades.where((F.col("entry_date") >= F.lit(low).cast("timestamp")) & (F.col("entry_date") < F.lit(high).cast("timestamp")))
