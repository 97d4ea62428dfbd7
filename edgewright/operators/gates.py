"""Gates: checks as rows, verdicts as boolean aggregates over hard checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.operators import metrics, resample, search, walkforward
from edgewright.operators.nulls import random_entry_null, simulated_means, timing_null
from edgewright.schema import clean

CHECKS = "gate_ord int, gate string, check_ord int, name string, passed boolean, value double, threshold double, hard boolean, detail string"


@dataclass(frozen=True)
class Thresholds:
    """Every bar and resampling budget of the gates."""

    alpha: float = 0.05
    null_percentile: float = 0.95
    min_expectancy_low: float = 0.0
    min_profit_factor_low: float = 1.25
    min_sqn_low: float = 1.6
    min_excursion: float = 1.2
    min_time_asymmetry: float = 2.0
    min_exit_efficiency: float = 0.5
    wfe_low: float = 0.30
    wfe_high: float = 1.00
    wfe_target: float = 0.50
    wfe_target_high: float = 0.80
    sqn_ratio_low: float = 0.5
    sqn_ratio_high: float = 2.0
    min_fold_share: float = 0.5
    max_fold_cv: float = 2.0
    max_pbo: float = 0.35
    min_deflated_sharpe: float = 0.95
    cusum_shift: float = 0.0
    cusum_years: float = 25.0
    cusum_trades: float = 7500.0
    rolling_window: int = 30
    rolling_slip: float = 0.5
    rate_slip: float = 0.6
    n_boot: int = 10_000
    n_perm: int = 5000
    n_sims: int = 1000
    seed: int = 42


def checks(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CHECKS)


def gate_verdicts(table: DataFrame) -> DataFrame:
    """(gate_ord, gate, passed): a gate passes with at least one hard check, and all of them; soft ones never count."""
    hard = F.when(F.col("hard"), F.col("passed"))
    return table.groupBy("gate_ord", "gate").agg(F.coalesce(F.bool_and(hard), F.lit(False)).alias("passed"))


def gauntlet_verdict(table: DataFrame) -> DataFrame:
    """(passed, failed_gates): every gate passes, and there is one."""
    g = gate_verdicts(table)
    return g.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.struct("gate_ord", "gate")))), lambda x: x["gate"]), ",").alias("failed_gates"))


def failed_checks(table: DataFrame) -> DataFrame:
    return table.where("hard and not passed")


def audit_text(table: DataFrame) -> str:
    """All checks as text: PASS, FAIL or (soft) WARN, value and threshold, gate by gate."""
    verdict = {r.gate_ord: r.passed for r in gate_verdicts(table).collect()}
    lines, last = [], None
    for r in table.orderBy("gate_ord", "check_ord").collect():
        if r.gate_ord != last:
            lines.append(f"{r.gate}: {'PASS' if verdict[r.gate_ord] else 'FAIL'}")
            last = r.gate_ord
        tag = "PASS" if r.passed else "FAIL" if r.hard else "WARN"
        value, bar = ("-" if x is None else f"{x:.4g}" for x in (r.value, r.threshold))
        lines.append(f"  [{tag}] {r.name}: {value} against {bar}" + (f" ({r.detail})" if r.detail else ""))
    whole = bool(verdict) and all(verdict.values())
    return "\n".join([*lines, f"verdict: {'PASS' if whole else 'FAIL'}"])


def mean_hold(trades: DataFrame, default: int = 20) -> int:
    """The mean holding time of a log in bars, at least 1; ``default`` if it has none."""
    if "bars_held" not in trades.columns:
        return default
    mean = trades.agg(F.avg(clean("bars_held"))).first()[0]
    return default if mean is None else max(1, round(mean))


def null_means(trades: DataFrame, bars: DataFrame, null: str, *, side: str, hold: int | None, null_scale: str | None, t: Thresholds, **simulation) -> tuple[DataFrame, str]:
    """(x) of every simulation that made trades, and what they are. Random entries are as many in each symbol as the log's
    own; a log without symbols shares its number among all."""
    if null == "random_entry":
        own = trades.count()
        if "symbol" in trades.columns:
            entries = trades.groupBy("symbol").agg(F.count("*").alias("n_entries"))
        else:
            entries = -(-own // max(1, bars.select("symbol").distinct().count()))
        simulation.setdefault("timeout", hold if hold is not None else mean_hold(trades))
        sims = simulated_means(random_entry_null(bars, side, n_entries=entries, n_sims=t.n_sims, seed=t.seed, **simulation))
        return sims.select(F.col("mean").alias("x")).where("abs(x) < double('inf')"), "random entries on the same prices"
    if null != "detrended":
        raise ValueError(f"null must be 'random_entry' or 'detrended', not {null!r}")
    held = clean("bars_held") if "bars_held" in trades.columns else F.lit(float(hold if hold is not None else mean_hold(trades)))
    log = trades.withColumn("hold", held)
    if "direction" not in log.columns:
        log = log.withColumn("direction", F.lit(1.0 if side == "long" else -1.0))
    log = log.withColumn("scale", F.col(null_scale)) if null_scale else log.drop("scale")
    sims = timing_null(bars, log, n_samples=t.n_sims, seed=t.seed).select(F.col("mean").alias("x")).where("abs(x) < double('inf')")
    return sims, f"random times of detrended prices, same holds and directions, in {'R' if null_scale else 'return'} units"


def gate_real(trades: DataFrame, *, variants: DataFrame | None = None, n_variants=1, bars: DataFrame | None = None, null: str = "random_entry", side: str = "long", hold: int | None = None, null_scale: str | None = None, t: Thresholds = Thresholds(), **simulation) -> DataFrame:
    """Is it luck? A permutation p (White's if variants are given, Šidák's otherwise), and the timing null if prices are.

    ``hold`` is how long random entries are held: the log's own mean if it is not given. ``null_scale`` names a column that
    brings a detrended null to the unit of r (entry over risk, for a log in R). Without prices, or if no simulation makes
    a trade, the check of timing is soft and not passed: it was skipped.
    """
    rows: list[tuple] = []
    if variants is not None:
        p = search.whites_reality_check(variants, n_perm=t.n_perm, seed=t.seed).first().p_value
        rows.append((0, "REAL", 0, "whites_reality_check", p < t.alpha, p, t.alpha, True, "best of all variants"))
    else:
        p = search.sign_permutation(trades, n_perm=t.n_perm, seed=t.seed).first().p_value
        n = search.variant_count(n_variants)
        p = search.sidak(p, n) if n > 1 else p
        rows.append((0, "REAL", 0, "permutation", p < t.alpha, p, t.alpha, True, f"{n} variants"))
    skipped = lambda why: (0, "REAL", 1, "random_timing", False, None, None, False, f"skipped: {why}")
    if bars is None or trades.isEmpty():
        rows.append(skipped("no prices"))
    else:
        sims, what = null_means(trades, bars, null, side=side, hold=hold, null_scale=null_scale, t=t, **simulation)
        point = trades.agg(F.avg(clean("r"))).first()[0] or 0.0
        found = sims.agg(F.percentile("x", F.lit(t.null_percentile)).alias("bar"), F.avg((F.col("x") < point).cast("double")).alias("beaten")).first()
        rows.append(skipped("the null made no trades") if found.bar is None else (0, "REAL", 1, "random_timing", point > found.bar, point, found.bar, True, f"beats {found.beaten:.0%} of {what}"))
    return checks(trades.sparkSession, rows)


def gate_strong(trades: DataFrame, *, t: Thresholds = Thresholds()) -> DataFrame:
    """Is it large? Lower bounds of expectancy and profit factor are hard; the rest is soft."""
    low = {r.metric: r.ci_low for r in resample.bootstrap_metric_cis(trades, ("expectancy", "profit_factor", "sqn"), n_boot=t.n_boot, alpha=t.alpha, seed=t.seed).collect()}
    report = metrics.edge_report(trades).first().asDict()
    rows = [
        (1, "STRONG", i, f"{m}_low", low.get(m) is not None and low[m] > bar, low.get(m), bar, hard, "")
        for i, (m, bar, hard) in enumerate((("expectancy", t.min_expectancy_low, True), ("profit_factor", t.min_profit_factor_low, True), ("sqn", t.min_sqn_low, False)))
    ]
    for i, (m, bar) in enumerate((("excursion_ratio", t.min_excursion), ("time_asymmetry", t.min_time_asymmetry), ("exit_efficiency", t.min_exit_efficiency)), 3):
        if (x := report.get(m)) is not None and x == x:
            rows.append((1, "STRONG", i, m, x >= bar, x, bar, False, ""))
    return checks(trades.sparkSession, rows)


def gate_durable(folds: DataFrame, *, wfe: str = "return", t: Thresholds = Thresholds()) -> DataFrame:
    """Does it last? The efficiency's band (both ends), or the ratio's low end, and the folds' likeness are hard."""
    rows = []
    if wfe == "return":
        e = walkforward.efficiency(folds, low=t.wfe_low, high=t.wfe_high, target=t.wfe_target, target_high=t.wfe_target_high).first()
        rows += [(2, "DURABLE", 0, "wfe", e.passed, e.mean_wfe, t.wfe_low, True, f"at most {t.wfe_high}"), (2, "DURABLE", 1, "wfe_target", e.on_target, e.mean_wfe, t.wfe_target, False, "")]
    elif wfe == "sqn":
        m = folds.where("is_score != 0").agg(F.avg(F.try_divide("oos_score", "is_score"))).first()[0]
        rows += [(2, "DURABLE", 0, "sqn_ratio", m is not None and m > t.sqn_ratio_low, m, t.sqn_ratio_low, True, ""), (2, "DURABLE", 1, "sqn_ratio_high", m is not None and m <= t.sqn_ratio_high, m, t.sqn_ratio_high, False, "")]
    else:
        raise ValueError(f"wfe must be 'return' or 'sqn', not {wfe!r}")
    d = walkforward.fold_dispersion(folds, min_share=t.min_fold_share, max_cv=t.max_fold_cv).first()
    rows.append((2, "DURABLE", 2, "fold_dispersion", bool(d.passed), d.cv, t.max_fold_cv, True, f"{d.n} folds"))
    return checks(folds.sparkSession, rows)


def gate_general(markets: DataFrame, *, t: Thresholds = Thresholds()) -> DataFrame:
    """Does it travel? The best market against luck over all of them; ``markets`` is (variant, variant_ord, obs_seq, r)."""
    p = search.whites_reality_check(markets, n_perm=t.n_perm, seed=t.seed).first().p_value
    return checks(markets.sparkSession, [(3, "GENERAL", 0, "markets", p < t.alpha, p, t.alpha, True, "")])


def run_gauntlet(trades: DataFrame, *, folds: DataFrame | None = None, markets: DataFrame | None = None, wfe: str = "return", t: Thresholds = Thresholds(), **real) -> DataFrame:
    """All check rows: REAL and STRONG always, DURABLE and GENERAL if they can be judged."""
    out = gate_real(trades, t=t, **real).union(gate_strong(trades, t=t))
    if folds is not None:
        out = out.union(gate_durable(folds, wfe=wfe, t=t))
    return out if markets is None else out.union(gate_general(markets, t=t))


def gates_json(table: DataFrame) -> DataFrame:
    """(gate, passed, record): each gate with its checks as JSON."""
    nested = table.groupBy("gate_ord", "gate").agg(F.sort_array(F.collect_list(F.struct("check_ord", "name", "passed", "value", "threshold", "hard", "detail"))).alias("checks"))
    joined = nested.join(gate_verdicts(table), ["gate_ord", "gate"])
    return joined.select("gate_ord", "gate", "passed", F.to_json(F.struct("gate", "passed", "checks")).alias("record"))
