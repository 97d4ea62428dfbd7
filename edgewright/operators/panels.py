"""The data of report panels: each is a small table reduced from a trade log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.operators import metrics, resample
from edgewright.operators.ordered import running
from edgewright.schema import clean

#: Codes of exits that simulators write, and their labels; other codes stand for themselves.
REASONS = {
    "tp": "take-profit", "stop": "stop-out", "hard": "hard stop", "timeout": "timeout", "neutral": "ride to neutral", "maxhold": "max hold", "reject": "rejection exit", "eod": "end of data",
}


def order_date(trades: DataFrame) -> list[str]:
    """Trades are drawn by exit, else entry, else position."""
    return [next((c for c in ("exit_date", "entry_date") if c in trades.columns), "trade_seq"), "trade_seq"]


def cumulative_r(trades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``trades`` with ``cum_r``."""
    return running(trades, by or [], order_date(trades), {"cum_r": clean("r")})


def drawdown(trades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``trades`` with ``cum_r`` and ``drawdown``: how far it is below its highest value so far."""
    ran = running(trades, by or [], order_date(trades), {"cum_r": clean("r")}, high={"_high": "cum_r"})
    return ran.withColumn("drawdown", F.col("cum_r") - F.col("_high")).drop("_high")


def curve(rows: DataFrame, place: str, values: list[str], pixels: int = 720) -> DataFrame:
    """(pixel, n, and of each value its first, last, least and greatest, as ``name_first`` ..., missing ones left out) of
    ``rows`` whose places go from 1 up: a book of any size draws its true extremes in as many rows as there are pixels."""
    total = rows.agg(F.max(place).alias("_all"))
    at = F.floor((F.col(place) - 1) * pixels / F.greatest(F.col("_all"), F.lit(pixels))).cast("int")
    parts = []
    for v in values:
        there = F.when(F.col(v).isNotNull(), F.col(place))
        parts += [F.min_by(v, there).alias(f"{v}_first"), F.max_by(v, there).alias(f"{v}_last"), F.min(v).alias(f"{v}_low"), F.max(v).alias(f"{v}_high")]
    return rows.join(F.broadcast(total)).groupBy(at.alias("pixel")).agg(F.count("*").alias("n"), *parts)


def r_curve(trades: DataFrame, pixels: int = 720) -> DataFrame:
    """``curve`` of the cumulative R (``cum_r``) and how far it is below its highest value so far (``drawdown``)."""
    ran = running(trades, [], order_date(trades), {"cum_r": clean("r"), "_at": F.lit(1)}, high={"_high": "cum_r"})
    return curve(ran.select("_at", "cum_r", (F.col("cum_r") - F.col("_high")).alias("drawdown")), "_at", ["cum_r", "drawdown"], pixels)


def excursion_bins(trades: DataFrame, bins: int = 40) -> DataFrame:
    """(mae_bin, mfe_bin, won, n, over) of trades by both excursions: bins of equal width up to the 99th percentile of each
    side's size (at least 1), the last one with all that lies beyond, which ``over`` counts."""
    up, down, r = clean("mfe"), -clean("mae"), clean("r")
    rows = trades.select(up.alias("up"), down.alias("down"), r.alias("r")).where("up is not null and down is not null and r is not null")
    ends = rows.agg(*(F.greatest(F.percentile(c, F.lit(0.99)), F.lit(1.0)).alias(f"{c}_end") for c in ("up", "down")))
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(c) / F.col(f"{c}_end") * bins))).cast("int")
    over = ((F.col("up") > F.col("up_end")) | (F.col("down") > F.col("down_end"))).cast("int")
    return rows.join(F.broadcast(ends)).groupBy(at("down").alias("mae_bin"), at("up").alias("mfe_bin"), (F.col("r") > 0).alias("won")).agg(F.count("*").alias("n"), F.sum(over).alias("over"))


def bootstrap_bins(trades: DataFrame, *, bins: int = 40, n_boot: int = 5000, seed: int = 42) -> DataFrame:
    """(bin, lo, hi, n) of the draws' expectancy, between their least and greatest."""
    means = resample.drawn(trades, n_boot, seed, ("expectancy",)).select(F.col("expectancy").alias("x"))
    ends = means.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    width = F.greatest(F.col("b") - F.col("a"), F.lit(1e-12)) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("a")) / F.col("w"))).cast("int")
    rows = means.join(F.broadcast(ends.withColumn("w", width))).select(at.alias("bin"), "a", "w")
    return rows.groupBy("bin").agg((F.first("a") + F.col("bin") * F.first("w")).alias("lo"), (F.first("a") + (F.col("bin") + 1) * F.first("w")).alias("hi"), F.count("*").alias("n"))


def block_panel(periods: DataFrame, *, block: int = 6, stationary: bool = False, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 42, order: str = "period") -> DataFrame:
    """(series, block, point, ci_low, ci_high, p_value, verdict): the mean of a series of periods with the interval of single
    periods and that of blocks, which is wider where periods follow one another. Nothing below two periods."""
    out = None
    for label, size, kind in (("single", 1, False), ("blocks", block, stationary)):
        found = resample.block_bootstrap(periods, block=size, n_boot=n_boot, alpha=alpha, seed=seed, stationary=kind, order=order).where("n >= 2")
        verdict = F.when(F.col("ci_low") > 0, "holds").when(F.col("observed") > 0, "straddles zero").otherwise("fails")
        one = found.select(F.lit(label).alias("series"), F.lit(size).cast("bigint").alias("block"), F.col("observed").alias("point"), "ci_low", "ci_high", "p_value", verdict.alias("verdict"))
        out = one if out is None else out.union(one)
    return out


def exit_reasons(trades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(reason, label, n, sum_r, avg_r, win_rate), the worst sum first."""
    label = F.coalesce(*(F.when(F.col("exit_reason") == k, v) for k, v in REASONS.items()), F.col("exit_reason"))
    found = trades.groupBy(*(by or []), F.col("exit_reason").alias("reason"), label.alias("label")).agg(F.count("*").alias("n"), F.sum(clean("r")).alias("sum_r"), F.avg(clean("r")).alias("avg_r"), F.avg((clean("r") > 0).cast("double")).alias("win_rate"))
    return found.orderBy(*(by or []), "sum_r", "reason")


def holding_medians(trades: DataFrame) -> DataFrame:
    """(won, n, median_bars)."""
    return trades.where(clean("r").isNotNull()).groupBy((F.col("r") > 0).alias("won")).agg(F.count("*").alias("n"), F.median("bars_held").alias("median_bars"))


def efficiency_bins(trades: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, n) of realised over available excursion, clipped to -1 and 1, where there was any."""
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("r"), F.col("mfe"))))
    return trades.where(F.col("mfe") > 1e-9).select(F.least(F.lit(bins - 1), F.floor((x + 1) / 2 * bins)).cast("int").alias("bin"), x.alias("x")).groupBy("bin").agg(F.count("*").alias("n"))


def efficiency_median(trades: DataFrame) -> DataFrame:
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("r"), F.col("mfe"))))
    return trades.where(F.col("mfe") > 1e-9).agg(F.median(x).alias("median"))


def r_histogram(trades: DataFrame, bins: int = 40) -> DataFrame:
    """(bin, lo, hi, n, overflow) of R, clipped to max(99th percentile, 5) and min(least, -3)."""
    r = clean("r")
    ends = trades.agg(F.greatest(F.percentile(r, F.lit(0.99)), F.lit(5.0)).alias("b"), F.least(F.min(r), F.lit(-3.0)).alias("a"))
    rows = trades.select(r.alias("r")).where("r is not null").join(F.broadcast(ends))
    width = (F.col("b") - F.col("a")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.least("r", "b") - F.col("a")) / width)).cast("int")
    return rows.select(at.alias("bin"), (F.col("r") > F.col("b")).cast("int").alias("over"), "a", width.alias("w")).groupBy("bin").agg(F.round(F.first("a") + F.col("bin") * F.first("w"), 9).alias("lo"), F.round(F.first("a") + (F.col("bin") + 1) * F.first("w"), 9).alias("hi"), F.count("*").alias("n"), F.sum("over").alias("overflow"))


def gross_net(trades: DataFrame, cost: str | float | None = None) -> DataFrame:
    """``trades`` with running net and gross R; empty where there are no costs."""
    name = cost if isinstance(cost, str) else next((c for c in ("cost", "cost_r") if c in trades.columns), None)
    paid: Column = F.lit(float(cost)) if isinstance(cost, (int, float)) else F.coalesce(F.col(name), F.lit(0.0)) if name else F.lit(0.0)
    rows = trades.withColumn("_c", paid)
    total = rows.agg(F.sum("_c").alias("total_cost"))
    r = F.coalesce(clean("r"), F.lit(0.0))
    ran = running(rows, [], order_date(trades), {"net": r, "gross": r + F.col("_c")})
    return ran.join(F.broadcast(total)).where("total_cost != 0").drop("_c", "total_cost")


def concurrency(trades: DataFrame) -> DataFrame:
    """(t, open): how many trades are open after each moment; at equal times entries count first."""
    events = trades.where("entry_date is not null and exit_date is not null").select(F.explode(F.array(F.struct(F.col("entry_date").alias("t"), F.lit(1).alias("step")), F.struct(F.col("exit_date").alias("t"), F.lit(-1).alias("step")))).alias("e")).select("e.*")
    moments = events.groupBy("t").agg(F.sum(F.when(F.col("step") > 0, 1).otherwise(0)).alias("entries"), F.sum("step").alias("net"))
    after = F.col("after")
    return running(moments, [], ["t"], {"after": F.col("net")}).select("t", after.cast("bigint").alias("open"), (after - F.col("net") + F.col("entries")).cast("bigint").alias("peak"))


def edge_ratio_curve(excursions: DataFrame) -> DataFrame:
    """(k, ratio, n) from excursions by horizon."""
    ratio = F.when(F.col("mean_mae") == 0, metrics.INF).otherwise(F.try_divide("mean_mfe", F.abs("mean_mae")))
    return excursions.select("k", ratio.alias("ratio"), "n")


def segment_forest(trades: DataFrame, by: list[str], *, n_boot: int = 2000, alpha: float = 0.10, seed: int = 42) -> DataFrame:
    """(dimension, segment, n, point, ci_low, ci_high, verdict) for every value of every column in ``by``."""
    out = None
    for name in by:
        rows = trades.where(F.col(name).isNotNull()).withColumn("segment_", F.col(name).cast("string"))
        one = resample.reality_check(rows, n_boot=n_boot, alpha=alpha, seed=seed, by=["segment_"]).select(F.lit(name).alias("dimension"), F.col("segment_").alias("segment"), "n", "point", "ci_low", "ci_high", "verdict")
        out = one if out is None else out.union(one)
    return out


def whiskers(trades: DataFrame, checks: DataFrame, *, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(metric, point, ci_low, ci_high, floor): intervals beside the floors of the checks that judge them."""
    found = resample.bootstrap_metric_cis(trades, ("expectancy", "profit_factor", "sqn"), n_boot=n_boot, alpha=alpha, seed=seed)
    floors = checks.select(F.regexp_replace("name", "_low$", "").alias("metric"), F.col("threshold").alias("floor"))
    return found.join(floors, "metric", "left")


def bullets(checks: DataFrame) -> DataFrame:
    """(gate, name, value, threshold, passed, higher_is_better): each gate's first hard check with numbers."""
    first = F.row_number().over(Window.partitionBy("gate_ord").orderBy("check_ord"))
    rows = checks.where("hard and value is not null and threshold is not null").withColumn("_p", first).where("_p = 1")
    return rows.select("gate_ord", "gate", "name", "value", "threshold", "passed", ((F.col("value") >= F.col("threshold")) == F.col("passed")).alias("higher_is_better"))


def verdict_state(checks: DataFrame) -> DataFrame:
    """(state): pass, scope if only GENERAL fails, else fail."""
    from edgewright.operators.gates import gate_verdicts

    g = gate_verdicts(checks).agg(F.bool_and("passed").alias("all"), F.bool_and(F.col("passed") | (F.col("gate") == "GENERAL")).alias("most"))
    return g.select(F.when(F.col("all"), "pass").when(F.col("most"), "scope").otherwise("fail").alias("state"))


def score_quantiles(preds: DataFrame, *, score: str = "score", label: str = "label", q: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(won, n, q05 ...) of scores by outcome."""
    rows = preds.where(clean(score).isNotNull() & clean(label).isNotNull())
    return rows.groupBy((F.col(label) > 0).alias("won")).agg(F.count("*").alias("n"), *(F.percentile(score, F.lit(p)).alias(f"q{round(100 * p):02d}") for p in q))
