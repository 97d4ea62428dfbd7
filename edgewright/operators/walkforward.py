"""Walk-forward: simulate every setting once, choose in sample, stitch what the choices did out of sample."""

from __future__ import annotations

import datetime as dt
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewright.operators import metrics
from edgewright.operators.barriers import TIMEOUT, chained, paths
from edgewright.operators.ordered import running

FOLDS = "fold_id int, is_start timestamp, is_end timestamp, oos_start timestamp, oos_from timestamp, oos_end timestamp"


def param_grid(grid: dict[str, list]) -> list[dict]:
    """Every combination, in the order of the keys; an empty grid has one empty combination."""
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def simulate(bars: DataFrame, grid: dict[str, list], strategy, simulator) -> DataFrame:
    """The trades of all combinations of the whole series, by ``combo_id``: each is simulated once, then only sliced."""
    out = None
    for i, params in enumerate(param_grid(grid)):
        one = simulator(strategy(bars, **params)).withColumn("combo_id", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def crossing_signals(bars: DataFrame, settings: DataFrame, *, price: str = "close") -> DataFrame:
    """(combo_id, symbol, bar_seq) of every bar where a setting's fast mean rises above its slow one; ``settings`` is a table
    (combo_id, fast, slow). A mean of any span is a difference of two running sums, so all spans come from one column, and
    the plan is the same for any number of settings."""
    sums = running(bars.select("symbol", "bar_seq", F.col(price).alias("_v")), ["symbol"], ["bar_seq"], {"p": F.col("_v")}).select("symbol", "bar_seq", "p")
    spans = settings.select(F.explode(F.array("fast", "slow")).alias("span")).distinct().agg(F.sort_array(F.collect_list("span")).alias("spans"))
    # each bar gives every span what is subtracted where its mean ends, and the means of two bars beside each other cross
    ended = sums.crossJoin(F.broadcast(spans)).select("symbol", F.col("bar_seq").alias("at"), "p", F.explode("spans").alias("span"))
    before = ended.select("symbol", (F.col("at") + F.col("span")).alias("at"), "span", F.col("p").alias("less"))
    means = ended.join(before, ["symbol", "at", "span"], "left").select("symbol", "at", "span", F.when(F.col("at") >= F.col("span") - 1, (F.col("p") - F.coalesce("less", F.lit(0.0))) / F.col("span")).alias("mean")).where("mean is not null")
    by_bar = means.groupBy("symbol", "at").agg(F.map_from_entries(F.collect_list(F.struct("span", "mean"))).alias("now"))
    last = by_bar.select("symbol", (F.col("at") + 1).alias("at"), F.col("now").alias("was"))
    both = by_bar.join(last, ["symbol", "at"]).crossJoin(F.broadcast(settings.select("combo_id", "fast", "slow")))
    value = lambda when, which: F.try_element_at(when, F.col(which))
    return both.where((value("was", "fast") <= value("was", "slow")) & (value("now", "fast") > value("now", "slow"))).select("combo_id", "symbol", F.col("at").alias("bar_seq"))


def simulate_crossings(bars: DataFrame, settings: DataFrame, side: str = "long", *, price: str = "close", **options) -> DataFrame:
    """The trades of every setting of a crossing of means, by ``combo_id``. What each bar's entry leads to does not depend on
    the setting, so paths are resolved once; settings only choose among them."""
    found = paths(bars, side, **options)
    hits = crossing_signals(bars, settings, price=price).join(found, ["symbol", "bar_seq"])
    return chained(hits, ["combo_id", "symbol"], options.get("timeout", TIMEOUT) + 1)


def folds_of(trades: DataFrame, **days) -> DataFrame:
    """``folds`` from a log's first entry to its last."""
    ends = trades.agg(F.min("entry_date").alias("a"), F.max("entry_date").alias("b")).first()
    if ends.a is None:
        return trades.sparkSession.createDataFrame([], FOLDS)
    return folds(trades.sparkSession, ends.a, ends.b, **days)


def folds(spark: SparkSession, first: dt.datetime, last: dt.datetime, *, is_days: int, oos_days: int, purge_days: int = 0, embargo_days: int = 0, anchored: bool = False) -> DataFrame:
    """The windows of each fold. They depend on two dates only, so the driver makes them."""
    day, rows, start = dt.timedelta(days=1), [], first + dt.timedelta(days=is_days)
    while start < last:
        end = min(start + oos_days * day, last)
        is_end = start - purge_days * day
        rows.append((len(rows), first if anchored else max(first, start - is_days * day), is_end, start, start + embargo_days * day, end))
        start = end
    return spark.createDataFrame(rows, FOLDS)


def choices(trades: DataFrame, windows: DataFrame, *, score: str = "sqn", min_trades: int = 10) -> DataFrame:
    """(fold, combo_id, is_score, is_n, is_sum): of each fold the combination that did best in sample, the first on a tie."""
    inside = (F.col("entry_date") >= F.col("is_start")) & (F.col("entry_date") < F.col("is_end")) & (F.col("exit_date") < F.col("is_end"))
    seen = trades.join(F.broadcast(windows), inside).groupBy("fold_id", "combo_id").agg(*metrics.moments())
    scored = seen.where(F.col("n") >= min_trades).select("fold_id", "combo_id", metrics.SCORES[score]().alias("is_score"), F.col("n").alias("is_n"), F.col("s").alias("is_sum"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("fold_id").orderBy(F.desc("is_score"), "combo_id"))).where("place = 1").drop("place")


def stitched(trades: DataFrame, windows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen combinations' trades entered out of sample, by fold; exits may come later."""
    joined = trades.join(F.broadcast(chosen.join(windows, "fold_id").select("fold_id", "combo_id", "oos_from", "oos_end")), "combo_id")
    return joined.where((F.col("entry_date") >= F.col("oos_from")) & (F.col("entry_date") < F.col("oos_end"))).drop("oos_from", "oos_end")


def years(start: str, end: str) -> Column:
    return F.greatest(F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86400) / 365.25, F.lit(1e-9))


def fold_table(trades: DataFrame, windows: DataFrame, *, score: str = "sqn", min_trades: int = 10) -> DataFrame:
    """Each fold with its choice, both sides' scores, the SQN out of sample and the efficiency: yearly R out of sample over
    that in sample."""
    chosen = choices(trades, windows, score=score, min_trades=min_trades)
    out = stitched(trades, windows, chosen).groupBy("fold_id").agg(*metrics.moments())
    scores = out.select("fold_id", F.col("n").alias("oos_n"), F.col("s").alias("oos_sum"), metrics.SCORES[score]().alias("oos_score"), metrics.sqn().alias("oos_sqn"))
    rows = windows.join(chosen, "fold_id").join(scores, "fold_id", "left")
    inside, outside = F.col("is_sum") / years("is_start", "is_end"), F.coalesce("oos_sum", F.lit(0.0)) / years("oos_from", "oos_end")
    wfe = F.when((inside <= 0) | F.coalesce(F.col("oos_n") == 0, F.lit(True)), 0.0).otherwise(F.try_divide(outside, inside))
    return rows.select("fold_id", "combo_id", "is_n", "is_score", F.coalesce("oos_n", F.lit(0)).alias("oos_n"), F.coalesce("oos_score", F.lit(0.0)).alias("oos_score"), F.coalesce("oos_sqn", F.lit(0.0)).alias("oos_sqn"), wfe.alias("wfe"))


def mean_wfe(table: DataFrame) -> DataFrame:
    return table.agg(F.coalesce(F.avg("wfe"), F.lit(metrics.NAN)).alias("mean_wfe"))


def fold_dispersion(table: DataFrame, value: str | None = None, *, min_share: float = 0.5, max_cv: float = 2.0) -> DataFrame:
    """(n, share_positive, cv, passed): are the folds alike in SQN (or the score, in a table without it)? Missing ones are left
    out; without any nothing is known."""
    value = value or ("oos_sqn" if "oos_sqn" in table.columns else "oos_score")
    x = F.when(~F.isnan(value), F.col(value))
    found = table.agg(F.count(x).alias("n"), F.avg((x > 0).cast("double")).alias("share_positive"), F.avg(x).alias("m"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"))
    cv = F.when(F.col("n") == 0, F.lit(None)).when(F.abs("m") < 1e-12, metrics.INF).otherwise(F.abs(F.try_divide("sd", "m")))
    return found.select("n", "share_positive", cv.alias("cv")).withColumn("passed", (F.col("share_positive") >= min_share) & (F.col("cv") <= max_cv))


def efficiency(table: DataFrame, *, low: float = 0.30, high: float = 1.00, target: float = 0.50, target_high: float = 0.80) -> DataFrame:
    """(n, mean_wfe, passed, on_target): both ends of the band reject, as too good is suspect; the target is soft."""
    found = table.agg(F.count("wfe").alias("n"), F.avg("wfe").alias("mean_wfe"))
    m = F.col("mean_wfe")
    return found.withColumns({"passed": F.coalesce((m >= low) & (m <= high), F.lit(False)), "on_target": F.coalesce((m >= target) & (m <= target_high), F.lit(False))})
