"""Estimates of what a selection owes to luck: PBO by symmetric cross-validation, deflated Sharpe and expectancy."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.functions.scalars import expected_max_sharpe, probabilistic_sharpe
from edgewright.operators import metrics
from edgewright.operators.ordered import placed
from edgewright.operators.search import variant_count
from edgewright.schema import clean, finite


def check_matrix(matrix: DataFrame, splits: int) -> tuple[int, int]:
    """Rows and configurations of (period_seq, config, ret), which must be dense and finite."""
    found = matrix.agg(F.countDistinct("period_seq").alias("t"), F.countDistinct("config").alias("n"), F.count("*").alias("cells"), F.count(finite("ret")).alias("good")).first()
    if found.good != found.cells or found.cells != found.t * found.n:
        raise ValueError("the performance matrix must be dense and finite: every configuration needs a value for every period")
    if splits % 2 or not 2 <= splits <= found.t:
        raise ValueError(f"splits must be even, at least 2 and at most the {found.t} periods; got {splits}")
    if found.n < 2:
        raise ValueError("at least 2 configurations are needed")
    return found.t, found.n


def _sharpe(n: str, s: str, ss: str):
    """Mean over deviation from sums; 0 without deviation or under two rows."""
    mean = F.try_divide(s, n)
    var = F.try_divide(F.col(ss) - F.col(s) * F.col(s) / F.col(n), F.col(n) - 1)
    return F.when((F.col(n) < 2) | (var <= 1e-18) | var.isNull(), 0.0).otherwise(mean / F.sqrt(F.greatest(var, F.lit(1e-300))))


#: What a block of rows adds up to; deviation and size of a metric's accumulator follow from it.
_ADDED = ("n", "n_win", "n_loss", "s", "s_win", "s_loss", "ss", "abs")


def _added() -> list[Column]:
    r = F.col("ret")
    parts = {"n": F.lit(1.0), "n_win": (r > 0).cast("double"), "n_loss": (r < 0).cast("double"), "s": r, "s_win": F.greatest(r, F.lit(0.0)), "s_loss": F.least(r, F.lit(0.0)), "ss": r * r, "abs": F.abs(r)}
    return [F.sum(c).alias(name) for name, c in parts.items()] + [F.sum(F.coalesce(f(r).cast("double"), F.lit(0.0))).alias(name) for name, f in metrics.SUMS.items()]


def _scores(halves: DataFrame, by: list[str], metric: str) -> DataFrame:
    """(by, score) from added up blocks."""
    if metric == "sharpe":
        return halves.select(*by, _sharpe("n", "s", "ss").alias("score"))
    n = F.col("n")
    spread = F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1))
    whole = halves.withColumns({"sd": F.when(n > 1, F.sqrt(spread)), "size": F.coalesce(F.try_divide("abs", "n"), F.lit(0.0))})
    return whole.select(*by, metrics.SCORES[metric]().alias("score"))


def cscv(matrix: DataFrame, splits: int = 16, *, metric: str = "sharpe") -> DataFrame:
    """(split_id, config, is_score, oos_score, omega, logit) of every split: the best in sample and its rank out of sample.

    ``metric`` is the Sharpe ratio or any named or registered one. Blocks keep sums for each configuration, so a split adds
    up blocks instead of reading rows: each block's sums, one row for each configuration and block, meet the few splits.
    The leading rows that do not fill a block are left out.
    """
    t, n = check_matrix(matrix, splits)
    size = t // splits
    skip = t - size * splits
    periods = placed(matrix.select("period_seq").distinct(), [], ["period_seq"], "o").where(F.col("o") >= skip).select("period_seq", F.floor((F.col("o") - skip) / size).cast("int").alias("block"))
    sums = matrix.join(periods, "period_seq").groupBy("config", "block").agg(*_added())
    # a split is a number whose bits are the blocks, the first block highest: downwards they come in order of their blocks
    masks = F.filter(F.sequence(F.lit(2**splits - 1), F.lit(0), F.lit(-1)), lambda k: F.bit_count(k) == splits // 2)
    each = sums.select("*", F.posexplode(masks).alias("split_id", "mask")).withColumn("inside", F.expr(f"(mask >> ({splits - 1} - block)) & 1 = 1"))
    names = [*_ADDED, *metrics.SUMS]
    by = ["split_id", "config", "inside"]
    scored = _scores(each.groupBy(*by).agg(*(F.sum(c).alias(c) for c in names)), by, metric)
    scored = scored.groupBy("split_id", "config").agg(F.max(F.when(F.col("inside"), F.col("score"))).alias("is_score"), F.max(F.when(~F.col("inside"), F.col("score"))).alias("oos_score"))
    w = Window.partitionBy("split_id")
    ranked = scored.withColumns({"place": F.row_number().over(w.orderBy(F.desc("is_score"), "config")), "rank": F.count("*").over(w.orderBy("oos_score").rangeBetween(Window.unboundedPreceding, Window.currentRow))})
    best = ranked.where("place = 1").withColumn("omega", F.col("rank") / (n + 1))
    return best.select("split_id", "config", "is_score", "oos_score", "omega", F.log(F.col("omega") / (1 - F.col("omega"))).alias("logit"))


def ols(x: str, y: str) -> tuple:
    """Slope and R squared of y on x as aggregates; a constant x has slope 0 and no fit, a constant y no fit."""
    vx, vy, cov = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    slope = F.coalesce(F.try_divide(cov, vx), F.lit(0.0))
    fit = F.when((vx > 0) & (vy > 0), F.try_divide(cov * cov, vx * vy))
    return slope, fit


def pbo(matrix: DataFrame, splits: int = 16, *, metric: str = "sharpe") -> DataFrame:
    """(pbo, prob_oos_loss, slope, r2, n_splits, label)."""
    slope, fit = ols("is_score", "oos_score")
    found = cscv(matrix, splits, metric=metric).agg(F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.avg((F.col("oos_score") < 0).cast("double")).alias("prob_oos_loss"), slope.alias("slope"), fit.alias("r2"), F.count("*").alias("n_splits"))
    return found.withColumn("label", F.when(F.col("pbo") <= 0.10, "ROBUST").when(F.col("pbo") <= 0.35, "GUARDED").otherwise("OVERFIT"))


def trial_sharpes(trials: DataFrame) -> DataFrame:
    """(trial, sharpe) of (trial, r): trials with two values; 0 without deviation."""
    r = clean("r")
    found = trials.groupBy("trial").agg(F.count(r).alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd")).where("n >= 2")
    return found.select("trial", F.when(F.col("sd") > 0, F.col("m") / F.col("sd")).otherwise(0.0).alias("sharpe"))


@dataclass(frozen=True)
class DeflatedSharpe:
    sharpe: float
    benchmark: float
    psr: float
    n_trials: int

    @property
    def label(self) -> str:
        return "SIGNIFICANT" if self.psr >= 0.95 else "MARGINAL" if self.psr >= 0.90 else "NOT SIGNIFICANT"


def _trials(n_trials, scored: int) -> int:
    n = scored if n_trials is None else variant_count(n_trials)
    if n < scored:
        raise ValueError(f"n_trials is {n}, but {scored} trials were scored")
    return n


def deflated_sharpe(sharpes: DataFrame, returns: DataFrame, *, n_trials=None) -> DeflatedSharpe:
    """The winner's Sharpe ratio against the best that so many trials give by luck; moments are Spark's, the rest scalars."""
    s = sharpes.agg(F.count(finite("sharpe")).alias("n"), F.stddev_samp(finite("sharpe")).alias("sd")).first()
    r = finite("r")
    m = returns.agg(F.count(r).alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurt")).first()
    if s.n < 2 or m.n < 2:
        raise ValueError("at least 2 trial Sharpe ratios and 2 returns are needed")
    n = _trials(n_trials, s.n)
    sharpe = m.m / m.sd if m.sd else 0.0
    benchmark = expected_max_sharpe(s.sd, n)
    return DeflatedSharpe(sharpe, benchmark, probabilistic_sharpe(sharpe, benchmark, m.n, m.skew or 0.0, (m.kurt if m.kurt is not None else 0.0) + 3), n)


@dataclass(frozen=True)
class DeflatedExpectancy:
    expectancy: float
    sigma: float
    haircut: float
    deflated: float
    n_trials: int


def deflated_expectancy(returns: DataFrame, trials: DataFrame, *, n_trials=None) -> DeflatedExpectancy:
    """The winner's mean less what luck gives the best of so many trials; it may be negative."""
    s = trial_sharpes(trials).agg(F.count("*").alias("n"), F.stddev_samp("sharpe").alias("sd")).first()
    m = returns.agg(F.count(clean("r")).alias("n"), F.avg(clean("r")).alias("m"), F.stddev_samp(clean("r")).alias("sd")).first()
    if s.n < 2 or m.n < 2:
        raise ValueError("at least 2 scoreable trials and 2 returns are needed")
    if not m.sd or not s.sd or not math.isfinite(s.sd):
        raise ValueError("returns or trials without dispersion cannot be deflated")
    n = _trials(n_trials, s.n)
    haircut = m.sd * expected_max_sharpe(s.sd, n)
    return DeflatedExpectancy(m.m, m.sd, haircut, m.m - haircut, n)
