"""Resampling inference on one book of trades, or on one book for each group.

A draw is one row: its metric is folded over the book's array inside the JVM. The arrays of all books together are
bounded (``LARGEST_BOOK``, checked) and sent to every task. Beyond it nothing is sent whole. Draws with replacement then
follow their law instead of the numbers of single slots: how often a draw takes from each range of a book is split by
binomials, range by range, and each range's task adds up what all draws take from it. Blocks are differences of two
running sums that are looked up by position, and signs belong to rows, so these are the same draws at any size. The
counter generator makes every result independent of partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.functions import rng
from edgewright.operators import metrics
from edgewright.operators.ordered import joined, placed, running
from edgewright.schema import SEQ, clean
from edgewright.tables import written

#: Rows of all books together that may be sent to every task.
LARGEST_BOOK = 1_000_000
#: Rows of a range of a large book, draws that its task holds at once, and slots of a draw that one row unfolds.
RANGE_ROWS, AT_ONCE, SLOTS = 20_000, 64, 100_000
N_BOOT, ALPHA, SEED = 10_000, 0.05, 42


def book(trades: DataFrame, by: list[str] | None = None, value: str = "r", order: str = SEQ) -> DataFrame:
    """One row for each group: its values in order as ``rs`` and their number ``n``; missing values are left out."""
    by = by or []
    rows = trades.select(*by, F.struct(F.col(order).alias("o"), clean(value).alias("r")).alias("x")).where("x.r is not null")
    packed = rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["r"]).alias("rs"))
    return packed.withColumn("n", F.size("rs").cast("bigint"))


def _fold(values: Column) -> Column:
    """The accumulator of an array, by the names of ``metrics.moments``."""
    def total(f) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))

    s, ss = total(lambda x: x), total(lambda x: x * x)
    n = F.size(values)
    return F.struct(
        n.cast("bigint").alias("n"),
        F.size(F.filter(values, lambda x: x > 0)).cast("bigint").alias("n_win"),
        F.size(F.filter(values, lambda x: x < 0)).cast("bigint").alias("n_loss"),
        s.alias("s"),
        total(lambda x: F.greatest(x, F.lit(0.0))).alias("s_win"),
        total(lambda x: F.least(x, F.lit(0.0))).alias("s_loss"),
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (ss - s * s / n) / (n - 1)))).alias("sd"),
        F.when(n > 0, total(F.abs) / n).otherwise(0.0).alias("size"),
        *(total(lambda x, f=f: F.coalesce(f(x).cast("double"), F.lit(0.0))).alias(name) for name, f in metrics.SUMS.items()),
    )


def draws(books: DataFrame, n_boot: int, seed: int, names: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """(group, draw, metrics): every metric of every draw of size n with replacement. All groups see the same stream."""
    by = by or []
    each = books.sparkSession.range(n_boot).withColumnRenamed("id", "draw").join(F.broadcast(books.where("n > 0")))
    picked = F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), lambda i: F.get("rs", rng.index(F.col("n"), seed, F.col("draw"), i).cast("int")))
    drawn = each.select(*by, "draw", picked.alias("rs")).select(*by, "draw", _fold(F.col("rs")).alias("m")).select(*by, "draw", "m.*")
    return drawn.select(*by, "draw", *(metrics.SCORES[m]().alias(m) for m in names))


def _taken(n: int, at: int, width: int, batch: int, draws_: int, seed: int) -> np.ndarray:
    """How many of a draw's n slots fall into the range ``at`` of ranges of ``width`` rows, for a batch of draws: halves of the
    ranges share what their parent has by binomials, so every range finds its own number without the others."""
    low, high = 0, -(-n // width)
    rows = lambda a, b: min(b * width, n) - a * width
    slots = np.full(draws_, n, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left = np.random.default_rng([seed, batch, low, high]).binomial(slots, rows(low, mid) / rows(low, high))
        slots, low, high = (left, low, mid) if at < mid else (slots - left, mid, high)
    return slots


def multinomial_draws(trades: DataFrame, n_boot: int, seed: int, names: tuple[str, ...], value: str = "r", by: list[str] | None = None) -> DataFrame:
    """(group, draw, metrics) of draws of size n with replacement, for books of any size: what is shuffled are sums for each
    range and draw, not slots. The law is that of ``draws``, the numbers are others. Trades without a group have no draws.
    """
    by, width = by or [], RANGE_ROWS
    rows = trades.select(*by, SEQ, clean(value).alias("r")).where("r is not null")
    if by:
        rows = rows.dropna(subset=by)
    own = tuple(metrics.SUMS)
    rows = placed(rows, by, [SEQ], "i").select("*", *(F.coalesce(f(F.col("r")).cast("double"), F.lit(0.0)).alias(name) for name, f in metrics.SUMS.items()))
    books = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("r").alias("mean"))
    ranged = joined(rows.select(*by, "i", "r", *own), books, by).withColumn("_range", F.floor(F.col("i") / width))
    sums = ("n", "n_win", "n_loss", "s", "s_win", "s_loss", "d", "dd", "abs", *own)

    def add_up(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        x, at, n = rows["r"].to_numpy(), rows["_range"][0].as_py(), rows["n"][0].as_py()
        d = x - rows["mean"][0].as_py()
        features = np.stack([np.ones(len(x)), x > 0, x < 0, x, np.maximum(x, 0), np.minimum(x, 0), d, d * d, np.abs(x), *(rows[c].to_numpy() for c in own)], 1)
        out = []
        for batch in range(0, n_boot, AT_ONCE):
            taken = _taken(n, at, width, batch, min(AT_ONCE, n_boot - batch), seed)
            pick = np.random.default_rng([seed, batch, at])
            counts = np.stack([np.bincount(pick.integers(0, len(x), k), minlength=len(x)) for k in taken.tolist()])
            out.append(counts @ features)
        total = np.concatenate(out)
        keys = {c: pa.chunked_array([pa.array([rows[c][0].as_py()] * n_boot, rows.schema.field(c).type)]) for c in by}
        return pa.table(keys | {"draw": np.arange(n_boot)} | {name: total[:, k] for k, name in enumerate(sums)})

    kinds = ", ".join([*(f"`{c}` {trades.schema[c].dataType.simpleString()}" for c in by), "draw long", *(f"{c} double" for c in sums)])
    found = ranged.groupBy(*by, "_range").applyInArrow(add_up, kinds).groupBy(*by, "draw").agg(*(F.sum(c).alias(c) for c in sums))
    spread = F.greatest(F.lit(0.0), (F.col("dd") - F.col("d") * F.col("d") / F.col("n")) / (F.col("n") - 1))
    found = found.withColumns({"sd": F.when(F.col("n") > 1, F.sqrt(spread)), "size": F.col("abs") / F.col("n")} | {c: F.round(c).cast("bigint") for c in ("n", "n_win", "n_loss")})
    return metrics.scored(found, [*by, "draw"], names).drop("n")


def drawn(trades: DataFrame, n_boot: int, seed: int, names: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """(group, draw, metrics) by the way that the books' size allows."""
    if trades.count() <= LARGEST_BOOK:
        return draws(book(trades, by), n_boot, seed, names, by)
    return multinomial_draws(trades, n_boot, seed, names, by=by)


def interval(values: Column, alpha: float = ALPHA) -> list[Column]:
    """Percentile bounds over all draws; infinite ones count, and only infinite ones give infinite bounds."""
    return [F.percentile(values, F.lit(alpha / 2)).alias("ci_low"), F.percentile(values, F.lit(1 - alpha / 2)).alias("ci_high")]


def finite_interval(metric: str, alpha: float = ALPHA) -> list[Column]:
    """Percentile bounds over the finite draws."""
    x = F.when(F.abs(metric) < float("inf"), F.col(metric))
    return interval(x, alpha)


def bootstrap_ci(trades: DataFrame, metric: str = "expectancy", *, n_boot: int = N_BOOT, alpha: float = ALPHA, seed: int = SEED, by: list[str] | None = None) -> DataFrame:
    """Point and percentile interval of a metric for each group."""
    by = by or []
    point = trades.groupBy(*by).agg(*metrics.moments()).select(*by, "n", metrics.SCORES[metric]().alias("point"))
    bounds = drawn(trades, n_boot, seed, (metric,), by).groupBy(*by).agg(*finite_interval(metric, alpha))
    return point.join(bounds, by, "left") if by else point.join(F.broadcast(bounds))


def bootstrap_metric_cis(trades: DataFrame, names: tuple[str, ...] = ("expectancy", "profit_factor", "sqn", "win_rate"), *, n_boot: int = N_BOOT, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(metric, point, ci_low, ci_high) from one stream of draws."""
    point = trades.groupBy().agg(*metrics.moments()).select(*(metrics.SCORES[m]().alias(m) for m in names)).unpivot([], list(names), "metric", "point")
    values = drawn(trades, n_boot, seed, names).unpivot(["draw"], list(names), "metric", "value")
    return point.join(values.groupBy("metric").agg(*interval(F.col("value"), alpha)), "metric")


def reality_check(trades: DataFrame, *, n_boot: int = N_BOOT, alpha: float = ALPHA, seed: int = SEED, by: list[str] | None = None) -> DataFrame:
    """HELD, FRAGILE or FAIL for each group, with interval and p, from one pass of draws."""
    by = by or []
    point = trades.groupBy(*by).agg(*metrics.moments()).select(*by, "n", metrics.expectancy().alias("point"))
    bounds = drawn(trades, n_boot, seed, ("expectancy",), by).groupBy(*by).agg(*finite_interval("expectancy", alpha), F.avg((F.col("expectancy") > 0).cast("double")).alias("p_positive"))
    both = point.join(bounds, by, "left") if by else point.join(F.broadcast(bounds))
    verdict = F.when((F.col("point") > 0) & (F.col("ci_low") > 0), "HELD").when(F.col("point") > 0, "FRAGILE").otherwise("FAIL")
    return both.withColumn("p_positive", F.coalesce("p_positive", F.lit(0.0))).withColumns({"p_value": 1 - F.col("p_positive"), "verdict": verdict})


def block_means(books: DataFrame, block: int, n_boot: int, seed: int) -> DataFrame:
    """(draw, mean) of circular blocks, each a slice of the series put twice in a row; the last one is cut to its length."""
    size = F.least(F.lit(block), F.col("n"))
    twice = books.where("n > 0").select("n", F.concat("rs", "rs").alias("twice"), F.ceil(F.col("n") / size).cast("int").alias("k"), size.alias("block"))
    each = books.sparkSession.range(n_boot).withColumnRenamed("id", "draw").join(F.broadcast(twice))

    def one(i: Column) -> Column:
        start = rng.index(F.col("n"), seed, F.col("draw"), i)
        long = F.least(F.col("block"), F.col("n") - F.col("block") * i)
        return F.aggregate(F.slice("twice", (start + 1).cast("int"), long.cast("int")), F.lit(0.0), lambda a, x: a + x)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("k") - 1), one), F.lit(0.0), lambda a, x: a + x)
    return each.select("draw", (total / F.col("n")).alias("mean"))


def stationary_means(books: DataFrame, block: int, n_boot: int, seed: int) -> DataFrame:
    """(draw, mean) of blocks that end with probability 1/block at every slot."""
    each = books.sparkSession.range(n_boot).withColumnRenamed("id", "draw").join(F.broadcast(books.where("n > 0")))
    start = F.struct(rng.index(F.col("n"), seed, "j", F.col("draw"), 0).alias("at"), F.lit(0.0).alias("sum"))

    def step(a: Column, t: Column) -> Column:
        anew = rng.u52(seed, "b", F.col("draw"), t) % block == 0
        at = F.when(t == 0, a["at"]).when(anew, rng.index(F.col("n"), seed, "j", F.col("draw"), t)).otherwise((a["at"] + 1) % F.col("n"))
        return F.struct(at.alias("at"), (a["sum"] + F.get("rs", at.cast("int"))).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), start, step)["sum"]
    return each.select("draw", (total / F.col("n")).alias("mean"))


def _parts(spark, n: int, n_boot: int) -> DataFrame:
    """(draw, t) for t from 0 to n - 1, dealt out before they unfold."""
    lots = spark.range(n_boot).withColumnRenamed("id", "draw").select("draw", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // SLOTS))).alias("lot")).repartition("draw", "lot")
    first = F.col("lot").cast("bigint") * SLOTS
    return lots.select("draw", F.explode(F.sequence(first, F.least(first + SLOTS, F.lit(n).cast("bigint")) - 1)).alias("t"))


def _segment_means(segments: DataFrame, sums: DataFrame, n: int) -> DataFrame:
    """(draw, mean) of (draw, at, long): stretches of a series put in a circle, each the difference of two running sums,
    three if it passes the end."""
    end = F.col("at") + F.col("long")
    term = lambda place, sign: F.struct(place.cast("bigint").alias("i"), F.lit(sign).alias("sign"))
    terms = F.array(term(F.least(end, F.lit(n)), 1.0), term(F.col("at"), -1.0), term(F.greatest(end - n, F.lit(0)), 1.0))
    looked = segments.select("draw", F.explode(F.filter(terms, lambda x: x["i"] > 0)).alias("x")).select("draw", "x.i", "x.sign").join(sums, "i")
    return looked.groupBy("draw").agg((F.sum(F.col("sign") * F.col("p")) / n).alias("mean"))


def large_block_means(rows: DataFrame, n: int, block: int, n_boot: int, seed: int) -> DataFrame:
    """The draws of ``block_means`` for a series of any length, as ``_series`` gives it."""
    size = min(block, n)
    slots = _parts(rows.sparkSession, -(-n // size), n_boot)
    at = rng.index(F.lit(n), seed, F.col("draw"), F.col("t"))
    return _segment_means(slots.select("draw", at.alias("at"), F.least(F.lit(size), F.lit(n) - F.col("t") * size).alias("long")), rows, n)


def large_stationary_means(rows: DataFrame, n: int, block: int, n_boot: int, seed: int) -> DataFrame:
    """The draws of ``stationary_means`` for a series of any length: slots where a block begins, each as long as up to the
    next one of its draw."""
    slots = _parts(rows.sparkSession, n, n_boot)
    begins = slots.where((F.col("t") == 0) | (rng.u52(seed, "b", F.col("draw"), F.col("t")) % block == 0))
    nexts = F.coalesce(F.lead("t").over(Window.partitionBy("draw").orderBy("t")), F.lit(n))
    return _segment_means(begins.select("draw", rng.index(F.lit(n), seed, "j", F.col("draw"), F.col("t")).alias("at"), (nexts - F.col("t")).alias("long")), rows, n)


def _series(trades: DataFrame, value: str, order: str) -> DataFrame:
    """(i, p): the sum of the first i values in order, for i from 1."""
    rows = trades.select(F.col(order).alias("o"), clean(value).alias("r")).where("r is not null")
    ran = running(rows, [], ["o"], {"p": F.col("r"), "i": F.lit(1)})
    return written(ran.select(F.col("i").cast("bigint").alias("i"), "p"), "series")


def block_bootstrap(trades: DataFrame, *, block: int = 6, n_boot: int = N_BOOT, alpha: float = ALPHA, seed: int = SEED, stationary: bool = False, value: str = "r", order: str = SEQ) -> DataFrame:
    """(n, observed, p_value of a mean of zero, ci_low, ci_high); under two values p is 1 and the interval missing."""
    if trades.count() <= LARGEST_BOOK:
        books = book(trades, value=value, order=order)
        means = (stationary_means if stationary else block_means)(books, block, n_boot, seed)
        observed = books.select("n", F.when(F.col("n") > 0, F.aggregate("rs", F.lit(0.0), lambda a, x: a + x) / F.col("n")).alias("observed"))
    else:
        series = _series(trades, value, order)
        n = series.count()
        means = (large_stationary_means if stationary else large_block_means)(series, n, block, n_boot, seed)
        observed = series.where(F.col("i") == n).select(F.lit(n).cast("bigint").alias("n"), (F.col("p") / n).alias("observed"))
    # the mean of a centred draw is the draw's mean less the observed one
    rows = means.join(F.broadcast(observed.where("n > 1")))
    tested = rows.agg(F.sum((F.col("mean") - F.col("observed") >= F.col("observed")).cast("int")).alias("hits"), *interval(F.col("mean"), alpha))
    return observed.join(F.broadcast(tested)).select("n", "observed", F.coalesce((F.col("hits") + 1) / F.lit(n_boot + 1), F.lit(1.0)).alias("p_value"), "ci_low", "ci_high")
