"""What chance alone would have made of the entries: random entries, and random timing of the same holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.functions import rng
from edgewright.operators.barriers import TIMEOUT, chained, paths
from edgewright.operators.ordered import joined, running
from edgewright.operators.signals import by_bar, random_picks
from edgewright.tables import written


def random_entry_null(bars: DataFrame, side: str = "long", *, n_entries: int | DataFrame, n_sims: int = 1000, seed: int = 42, **options) -> DataFrame:
    """(sim, symbol, expectancy, n): mean R of barrier trades at random bars. Paths are resolved once for all bars.

    Each simulation draws its bars without the others, each bar a row that looks its path up, so a simulation costs as
    much as its entries. Overlaps drop out as in real trading, so that n may fall short of ``n_entries``: a number for
    every symbol, or a table (symbol, n_entries) of each one's own.
    """
    found = paths(bars, side, **options).select("symbol", "bar_seq", "exit_seq", "r")
    lasts = bars.groupBy("symbol").agg(F.max("bar_seq").cast("bigint").alias("last"))
    own = n_entries if isinstance(n_entries, DataFrame) else lasts.select("symbol", F.lit(n_entries).alias("n_entries"))
    lasts = lasts.join(own.select("symbol", F.col("n_entries").cast("bigint").alias("n_entries")), "symbol")
    each = lasts.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_sims - 1).cast("bigint"))).alias("sim"))
    picked = random_picks(each, F.col("n_entries"), seed, "sim", "symbol").select("sim", "symbol", "bar_seq")
    taken = chained(picked.join(found, ["symbol", "bar_seq"]), ["sim", "symbol"], options.get("timeout", TIMEOUT) + 1)
    made = taken.groupBy("sim", "symbol").agg(F.avg("r").alias("expectancy"), F.count("*").alias("n"))
    return each.select("sim", "symbol").join(made, ["sim", "symbol"], "left").select("sim", "symbol", "expectancy", F.coalesce("n", F.lit(0)).alias("n"))


def simulated_means(null: DataFrame) -> DataFrame:
    """(sim, mean, n) of a random-entry null: the mean R of each simulation over all its symbols, NULL without trades."""
    return null.groupBy("sim").agg(F.try_divide(F.sum(F.col("expectancy") * F.col("n")), F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def timing_null(bars: DataFrame, trades: DataFrame, *, n_samples: int = 2000, detrend: bool = True, seed: int = 42, price: str = "close") -> DataFrame:
    """(draw, mean): each trade's hold, direction and scale at a random start of the (detrended) series.

    A window's compound return is a difference of running sums of logarithms, which a trade looks up by the places where
    its window begins and ends: no series is one row, or sent whole to a task beyond what Spark broadcasts. Trades need ``hold`` and may have
    ``direction`` and ``scale``; a missing or short hold counts as 1, the others as 1.
    """
    before = F.lag(price).over(by_bar())
    returns = bars.select("symbol", "bar_seq", (F.try_divide(F.col(price), before) - 1).alias("x")).where("abs(x) < double('inf')")
    sizes = returns.groupBy("symbol").agg(F.avg("x").alias("mean"), F.count("*").alias("m")).where("m >= 3")
    # 1 + return may be zero or negative once detrended: its size, sign and zeros add up side by side
    steps = joined(returns, sizes, ["symbol"]).withColumn("f", 1 + F.col("x") - (F.col("mean") if detrend else F.lit(0.0)))
    summed = {"p": F.when(F.col("f") == 0, 0.0).otherwise(F.log(F.abs("f"))), "g": (F.col("f") < 0).cast("int"), "z": (F.col("f") == 0).cast("int"), "i": F.lit(1)}
    sums = running(steps.select("symbol", "bar_seq", "f"), ["symbol"], ["bar_seq"], summed).select("symbol", F.col("i").cast("bigint").alias("i"), F.struct("p", "g", "z").alias("s"))
    sums = written(sums, "sums")  # looked up twice, and from now on Spark knows its size
    lengths = sums.groupBy("symbol").agg(F.max("i").alias("m"))
    one = F.lit(1.0)
    has = set(trades.columns)
    held = F.greatest(F.lit(1), F.coalesce(F.floor("hold"), F.lit(1))).cast("int")
    log = trades.select("symbol", "trade_seq", held.alias("hold"), (F.coalesce("direction", one) if "direction" in has else one).alias("direction"), (F.coalesce("scale", one) if "scale" in has else one).alias("scale"))
    draws = F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("draw")
    starts = log.join(lengths, "symbol").withColumn("hold", F.least("hold", "m")).select("*", draws)
    at = rng.index(F.col("m") - F.col("hold") + 1, seed, F.col("draw"), F.col("symbol"), F.col("trade_seq")).cast("bigint")
    starts = starts.select("symbol", "draw", (F.col("direction") * F.col("scale")).alias("w"), at.alias("at"), (at + F.col("hold")).alias("to"))
    # Sums are looked up by place; none is at place 0. Spark takes the unfolded draws for no larger than the log, but a left
    # join never broadcasts its left side; every end has its sum, so nothing is null for it
    ends = starts.join(sums.select("symbol", F.col("i").alias("to"), F.col("s").alias("b")), ["symbol", "to"], "left")
    ends = ends.join(sums.select("symbol", F.col("i").alias("at"), F.col("s").alias("a")), ["symbol", "at"], "left")
    inside = lambda name: F.col("b")[name] - F.coalesce(F.col("a")[name], F.lit(0.0))
    grown = F.when(inside("z") > 0, 0.0).otherwise(F.exp(inside("p")) * F.when(inside("g") % 2 == 0, 1.0).otherwise(-1.0))
    return ends.select("draw", ((grown - 1) * F.col("w")).alias("v")).groupBy("draw").agg(F.avg("v").alias("mean"))
