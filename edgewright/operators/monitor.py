"""After promotion: is a live book still the one that was promoted? CUSUM, rolling mean and trade rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.functions import rng
from edgewright.functions.scalars import Baseline, CusumDesign, cusum_design
from edgewright.operators.ordered import joined, placed, running
from edgewright.schema import SEQ, clean
from edgewright.tables import written

ROLLING, SLIP, SLOW = 30, 0.5, 0.6


def _date(trades: DataFrame) -> str | None:
    return next((c for c in ("entry_date", "exit_date") if c in trades.columns), None)


def trades_per_year(trades: DataFrame, window_years: float | None = None) -> float | None:
    """Trades a year by their dates, over the trailing window if it has two; None without a span."""
    if window_years is not None and window_years <= 0:
        raise ValueError(f"the window must be positive, not {window_years}")
    date = _date(trades)
    if date is None:
        return None

    def rate(rows: DataFrame) -> float | None:
        found = rows.agg(F.count(date).alias("n"), ((F.unix_micros(F.max(date)) - F.unix_micros(F.min(date))) / 86_400_000_000).alias("days")).first()
        return found.n * 365.25 / found.days if found.n >= 2 and found.days else None

    if window_years is not None:
        last = trades.agg(F.max(date)).first()[0]
        if last is not None and (found := rate(trades.where(F.unix_micros(date) >= F.unix_micros(F.lit(last)) - F.lit(round(window_years * 365.25 * 86_400_000_000))))) is not None:
            return found
    return rate(trades)


def baseline(trades: DataFrame, *, deflated=None, rate: float | None = None, rate_window_years: float | None = None, n_variants: int | None = None) -> Baseline:
    """The frozen baseline of a promoted book; a missing r makes it invalid rather than being left out."""
    found = trades.agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.count("*").alias("n")).first()
    value = getattr(deflated, "deflated", deflated)
    years = None if rate is not None else rate_window_years
    return Baseline(found.m if found.m is not None else float("nan"), found.sd or 0.0, found.n, rate if rate is not None else trades_per_year(trades, years), n_variants, value, years)


def cusum_path(trades: DataFrame, k: float, sigma: float, *, by: list[str] | None = None, order: str = SEQ) -> DataFrame:
    """``trades`` with ``cusum``: max(0, what it was + (k - r) / sigma); a missing r leaves it as it was.

    The reflected sum is the running sum less its lowest value so far (or 0), so nothing has to loop over rows, and both
    run in ranges of the order, so a long book is many tasks' work.
    """
    ran = running(trades, by or [], [order], {"_c": (F.lit(k) - F.col("r")) / sigma}, low={"_low": "_c"})
    return ran.withColumn("cusum", F.col("_c") - F.least(F.lit(0.0), F.col("_low"))).drop("_c", "_low")


def rolling_expectancy(trades: DataFrame, window: int = ROLLING, *, by: list[str] | None = None, order: str = SEQ) -> DataFrame:
    """``trades`` with ``rolling``: the mean of the last ``window`` trades, missing until there are so many."""
    if window < 2:
        raise ValueError(f"the window must be at least 2, not {window}")
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(-(window - 1), 0)
    return trades.withColumn("rolling", F.when(F.count(F.lit(1)).over(w) == window, F.avg("r").over(w)))


def edge_monitor(trades: DataFrame, base: Baseline, *, design: CusumDesign | None = None, window: int = ROLLING, slip: float = SLIP, slow: float = SLOW, by: list[str] | None = None, order: str = SEQ) -> DataFrame:
    """One verdict for each book. Only the CUSUM says DEGRADED; a low rolling mean or rate says SLIPPING; else HOLDING."""
    design, by = design or cusum_design(base), by or []
    ran = running(trades, by, [order], {"_c": (F.lit(design.k) - F.col("r")) / design.sigma, "_i": F.lit(1)}, low={"_low": "_c"})
    ran = ran.withColumn("cusum", F.col("_c") - F.least(F.lit(0.0), F.col("_low")))
    date = _date(trades)
    days = (F.unix_micros(F.max(date)) - F.unix_micros(F.min(date))) / 86_400_000_000 if date else F.lit(None).cast("double")
    found = ran.groupBy(*by).agg(
        F.count("*").alias("n"), F.max_by("cusum", "_i").alias("cusum"), F.max("cusum").alias("peak"), F.min(F.when(F.col("cusum") > design.h, F.col("_i"))).alias("alarm_at"),
        (F.count(date) if date else F.lit(0)).alias("dated"), days.alias("days"),
    )
    latest = joined(ran.select(*by, "_i", "r"), found.select(*by, F.col("n").alias("_n")), by).where(F.col("_i") > F.col("_n") - window)
    latest = latest.groupBy(*by).agg(F.when(F.count("*") == window, F.avg("r")).alias("rolling"))
    found = joined(found, latest, by, "left")
    rate = F.when((F.col("dated") >= 2) & (F.col("days") > 0), F.col("dated") * 365.25 / F.col("days"))
    found = found.withColumn("rolling_ratio", F.col("rolling") / base.reference).withColumn("rate_ratio", rate / base.trades_per_year if base.trades_per_year else F.lit(None).cast("double"))
    alarm, low, thin = F.col("alarm_at").isNotNull(), F.coalesce(F.col("rolling_ratio") < slip, F.lit(False)), F.coalesce(F.col("rate_ratio") < slow, F.lit(False))
    reasons = F.array_compact(F.array(F.when(alarm, "cusum"), F.when(low, "rolling"), F.when(thin, "rate")))
    label = F.when(alarm, "DEGRADED").when(low | thin, "SLIPPING").otherwise("HOLDING")
    return found.select(*by, "n", "cusum", "peak", F.col("alarm_at").cast("bigint").alias("alarm_at"), "rolling_ratio", "rate_ratio", (F.coalesce("cusum", F.lit(0.0)) / design.h).alias("share_of_threshold"), label.alias("label"), F.array_join(reasons, ",").alias("reasons"))


#: Steps of a simulated run that are taken before it is seen which runs go on.
ROUND = 4096


def empirical_arl(trades: DataFrame, design: CusumDesign, *, shift: float = 0.0, n_sims: int = 1000, max_run: int | None = None, seed: int = 42) -> DataFrame:
    """(mean, median, inflation, censored): steps to alarm on resampled trades recentred to the shifted mean.

    Every step of every run is a row that looks its trade up by position, so a book of any size serves; runs go on by
    rounds of ``ROUND`` steps, and only those without an alarm do. Within a round a run is a running sum less its lowest
    value. Steps are numbered by (seed, run, step), so the result depends on nothing else.
    """
    rows = placed(trades.select(SEQ, clean("r").alias("r")).where("r is not null"), [], [SEQ], "i")
    n, mean = rows.agg(F.count("*"), F.avg("r")).first()
    if n < 2:
        raise ValueError(f"the book must have 2 trades, not {n}")
    book = written(rows.select("i", ((design.k - (F.col("r") - mean + shift * mean)) / design.sigma).alias("step")), "book")
    nominal = design.arl1 if shift < 1 else design.arl0
    cap = max_run or int(min(10 * nominal, 200_000))
    going, ended, begin = trades.sparkSession.range(n_sims).select(F.col("id").alias("sim"), F.lit(0.0).alias("level")), None, 0
    while begin < cap:
        last = min(begin + ROUND, cap)
        slots = going.select("sim", "level", F.explode(F.sequence(F.lit(begin + 1).cast("bigint"), F.lit(last).cast("bigint"))).alias("t"))
        steps = slots.withColumn("i", rng.index(F.lit(n), seed, "arl", F.col("sim"), F.col("t"))).join(book, "i")
        run = Window.partitionBy("sim").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = steps.select("sim", "t", (F.col("level") + F.sum("step").over(run)).alias("c"))
        levels = summed.select("sim", "t", (F.col("c") - F.least(F.lit(0.0), F.min("c").over(run))).alias("level"))
        met = written(levels.groupBy("sim").agg(F.min(F.when(F.col("level") > design.h, F.col("t"))).alias("length"), F.max_by("level", "t").alias("level")), "runs")
        over = met.where("length is not null").select("length", F.lit(False).alias("censored"))
        ended = over if ended is None else ended.union(over)
        going, begin = met.where("length is null").select("sim", "level"), last
        if going.isEmpty():
            break
    runs = ended.union(going.select(F.lit(cap).cast("bigint"), F.lit(True)))
    return runs.agg(F.avg("length").alias("mean"), F.median("length").alias("median"), (F.avg("length") / nominal).alias("inflation"), F.sum(F.col("censored").cast("int")).alias("censored"))


def monitor_curve(trades: DataFrame, base: Baseline, *, design: CusumDesign | None = None, window: int = ROLLING, pixels: int = 720, order: str = SEQ) -> DataFrame:
    """(pixel, n, the extremes of ``cusum`` and ``rolling``, alarm_at): both channels of one book as a page draws them, and the
    number of the first trade beyond the threshold where it is drawn. The rolling mean is a difference of two running sums,
    looked up by position."""
    from edgewright.operators.panels import curve

    design = design or cusum_design(base)
    ran = running(trades.select(order, "r"), [], [order], {"_c": (F.lit(design.k) - F.col("r")) / design.sigma, "_s": F.col("r"), "_at": F.lit(1)}, low={"_low": "_c"})
    ran = ran.select(F.col("_at").cast("bigint").alias("_at"), "_s", (F.col("_c") - F.least(F.lit(0.0), F.col("_low"))).alias("cusum"))
    before = ran.select((F.col("_at") + window).alias("_at"), F.col("_s").alias("_less"))
    mean = F.when(F.col("_at") >= window, (F.col("_s") - F.coalesce("_less", F.lit(0.0))) / window)
    both = ran.join(before, "_at", "left").select("_at", "cusum", mean.alias("rolling"), F.when(F.col("cusum") > design.h, F.col("_at")).alias("alarm"))
    drawn = curve(both, "_at", ["cusum", "rolling", "alarm"], pixels)
    return drawn.select("pixel", "n", *(f"{v}_{k}" for v in ("cusum", "rolling") for k in ("first", "last", "low", "high")), F.when(F.col("alarm_low") == F.min("alarm_low").over(Window.partitionBy(F.lit(0))), F.col("alarm_low")).alias("alarm_at"))
