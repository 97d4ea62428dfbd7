"""Edge metrics as one aggregation over any grouping.

All of them come from a few sums, which Spark adds up in partial aggregates; segments, windows, folds and draws
use the same accumulator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.schema import clean

INF, NAN = float("inf"), float("nan")
SQN_CAP = 100
#: Left-closed calibration bins.
BINS = ((0.0, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 1.0001))


def moments(r: Column | str = "r") -> list[Column]:
    """The accumulator: rows, wins, losses, sums of r, of gains, of losses, of squares and of sizes; NaN and NULL are left out."""
    r = clean(r)
    up, down = F.when(r > 0, r), F.when(r < 0, r)
    zero = F.lit(0.0)
    return [
        F.count(r).alias("n"),
        F.count(up).alias("n_win"),
        F.count(down).alias("n_loss"),
        F.coalesce(F.sum(r), zero).alias("s"),
        F.coalesce(F.sum(up), zero).alias("s_win"),
        F.coalesce(F.sum(down), zero).alias("s_loss"),
        F.stddev_samp(r).alias("sd"),
        F.coalesce(F.avg(F.abs(r)), zero).alias("size"),
        *(F.coalesce(F.sum(f(r).cast("double")), zero).alias(name) for name, f in SUMS.items()),
    ]


def win_rate() -> Column:
    return F.coalesce(F.try_divide("n_win", "n"), F.lit(0.0))


def expectancy() -> Column:
    """Mean R: the win rate times the mean win less the loss rate times the mean loss."""
    return F.coalesce(F.try_divide("s", "n"), F.lit(0.0))


def profit_factor(gain: str = "s_win", loss: str = "s_loss") -> Column:
    g, d = F.col(gain), F.abs(F.col(loss))
    return F.when(d > 0, F.try_divide(g, d)).when(g > 0, INF).otherwise(0.0)


def payoff_ratio() -> Column:
    win, loss = F.try_divide("s_win", "n_win"), F.abs(F.try_divide("s_loss", "n_loss"))
    return F.when(F.col("n_win") == 0, 0.0).when(F.col("n_loss") == 0, INF).otherwise(F.try_divide(win, loss))


def sqn(cap: int = SQN_CAP) -> Column:
    """Mean over deviation times the root of the (capped) count; 0 below two trades or without deviation."""
    flat = F.col("sd").isNull() | (F.col("sd") <= 1e-12 * (F.col("size") + 1e-12))
    return F.when((F.col("n") < 2) | flat, 0.0).otherwise(F.try_divide(F.try_divide("s", "n"), F.col("sd")) * F.sqrt(F.least("n", F.lit(cap)).cast("double")))


SCORES: dict[str, Callable[[], Column]] = {"win_rate": win_rate, "expectancy": expectancy, "profit_factor": profit_factor, "payoff_ratio": payoff_ratio, "sqn": sqn}
#: Sums of registered metrics, beside those of ``moments``: what each trade adds, as a function of its r.
SUMS: dict[str, Callable[[Column], Column]] = {}
_OWN = ("n", "n_win", "n_loss", "s", "s_win", "s_loss", "sd", "size")


def register(name: str, finish: Callable[[], Column], sums: dict[str, Callable[[Column], Column]] | None = None) -> None:
    """Make a metric of one's own known by name to every report, resample, fold and split: ``finish`` is a column over the
    accumulator (``moments``), ``sums`` add to it what each trade adds. Columns only, so it runs where the others do; as
    sums of parts add up to the sum of all, it also serves blocks, ranges and draws."""
    for part, f in (sums or {}).items():
        if part in _OWN or (part in SUMS and SUMS[part] is not f):
            raise ValueError(f"there is a sum {part!r} already")
    if name in SCORES:
        raise ValueError(f"there is a metric {name!r} already")
    SUMS.update(sums or {})
    SCORES[name] = finish


def unregister(name: str, sums: tuple[str, ...] = ()) -> None:
    """Forget a registered metric and those of its sums that no other one needs."""
    SCORES.pop(name)
    for part in sums:
        SUMS.pop(part)


def scored(summed: DataFrame, by: list[str], names: tuple[str, ...] = tuple(SCORES)) -> DataFrame:
    """Metrics from a table of ``moments``."""
    return summed.select(*by, "n", *(SCORES[m]().alias(m) for m in names))


def _ratio(up: Column, down: Column) -> Column:
    return F.when(up.isNull() | down.isNull(), NAN).when(down == 0, INF).otherwise(F.try_divide(up, F.abs(down)))


def excursion_ratio(mfe: str = "mfe", mae: str = "mae") -> Column:
    """Mean favourable over mean adverse excursion; each side leaves out its own missing values. Also the e-ratio at a horizon."""
    return _ratio(F.avg(clean(mfe)), F.avg(clean(mae)))


def time_asymmetry() -> Column:
    """Mean bars held of winners over that of losers."""
    return _ratio(F.avg(F.when(clean("r") > 0, F.col("bars_held"))), F.avg(F.when(clean("r") < 0, F.col("bars_held"))))


def exit_efficiency() -> Column:
    """Of winners, mean R over mean favourable excursion."""
    won = clean("r") > 0
    got, could = F.avg(F.when(won, F.col("r"))), F.avg(F.when(won, F.col("mfe")))
    return F.when(could > 0, F.try_divide(got, could)).otherwise(NAN)


def edge_report(trades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every metric that the columns allow, for each group, in one pass."""
    by = by or []
    has = set(trades.columns).issuperset
    more = {}
    if has({"mfe", "mae"}):
        more["excursion_ratio"] = excursion_ratio()
    if has({"bars_held"}):
        more["time_asymmetry"] = time_asymmetry()
    if has({"mfe"}):
        more["exit_efficiency"] = exit_efficiency()
    summed = trades.groupBy(*by).agg(*moments(), *(c.alias(n) for n, c in more.items()))
    return summed.select(*by, "n", *(SCORES[m]().alias(m) for m in SCORES), *more)


def calibration(trades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Trades and win rate by bin of the predicted probability; empty bins are left out."""
    p, r, which = clean("prob"), clean("r"), F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(BINS))):
        which = F.when((p >= a) & (p < b), i).otherwise(which)
    rows = trades.where(p.isNotNull() & r.isNotNull()).withColumn("bin", which).where("bin is not null")
    return rows.groupBy(*(by or []), "bin").agg(F.count("*").alias("trades"), F.avg((r > 0).cast("double")).alias("win_rate"))


def flags(report: DataFrame) -> DataFrame:
    """The report with a PASS, WARN or FAIL for each metric that has a bar."""
    def flag(name: str, bar: float, soft: bool) -> Column:
        return F.when(clean(name).isNull(), F.lit(None)).when(F.col(name) > bar, "PASS").otherwise("WARN" if soft else "FAIL").alias(f"{name}_flag")

    bars = {"expectancy": (0.0, False), "profit_factor": (1.25, True), "excursion_ratio": (1.0, False), "time_asymmetry": (1.0, True)}
    return report.select("*", *(flag(n, *b) for n, b in bars.items() if n in report.columns))


def report_text(row) -> str:
    """One report row as lines of text, with its flags if it has them."""
    values = row.asDict()
    lines = [f"trades            {values['n']}"]
    for name in (*SCORES, "excursion_ratio", "time_asymmetry", "exit_efficiency"):
        if (x := values.get(name)) is not None and x == x:
            lines.append(f"{name:<17} {x:+.4f}  {values.get(f'{name}_flag') or ''}".rstrip())
    return "\n".join(lines)
