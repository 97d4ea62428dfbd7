"""Entry signals and indicators as window expressions over (symbol, bar_seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.functions import rng
from edgewright.schema import clean
from edgewright.tables import written


def by_bar():
    """Each symbol's bars in order."""
    return Window.partitionBy("symbol").orderBy("bar_seq")


def crossover(fast: Column, slow: Column) -> Column:
    """True where fast rises above slow; a missing operand is False."""
    return F.coalesce((F.lag(fast).over(by_bar()) <= F.lag(slow).over(by_bar())) & (fast > slow), F.lit(False))


def sma(price: str, span: int) -> Column:
    """The mean of a full window, missing before."""
    frame = by_bar().rowsBetween(-(span - 1), 0)
    return F.when(F.count(price).over(frame) == span, F.avg(price).over(frame))


class _Mean:
    """How one exponential mean composes, as SQL of the steps of ``aggregate``. A summary of consecutive bars is its first
    observed one (``p``, ``v``), the affine map y -> a*y + b of all after that, and the ``last`` observed one; missing bars
    only widen the gap before the next."""

    def __init__(self, column: str, span: float):
        alpha = 2 / (span + 1)
        self.q, self.alpha = f"{1 - alpha!r}d", f"{alpha!r}d"
        self.v = f"CASE WHEN NOT isnan(x.`{column}`) THEN CAST(x.`{column}` AS DOUBLE) END"

    def _keep(self, gap: str) -> str:
        return f"CASE WHEN {gap} = 1 THEN {self.q} ELSE pow({self.q}, {gap}) / (pow({self.q}, {gap}) + {self.alpha}) END"

    def _add(self, gap: str) -> str:
        return f"CASE WHEN {gap} = 1 THEN {self.alpha} ELSE {self.alpha} / (pow({self.q}, {gap}) + {self.alpha}) END"

    def summary(self) -> Column:
        """Of a chunk's bars ``_xs``."""
        keep, add, v = self._keep("(x.bar_seq - s.last)"), self._add("(x.bar_seq - s.last)"), self.v
        first = f"named_struct('p', x.bar_seq, 'v', {v}, 'a', 1d, 'b', 0d, 'last', x.bar_seq)"
        later = f"named_struct('p', s.p, 'v', s.v, 'a', s.a * {keep}, 'b', s.b * {keep} + {v} * {add}, 'last', x.bar_seq)"
        return F.expr(f"aggregate(_xs, {_NOTHING}, (s, x) -> CASE WHEN {v} IS NULL THEN s WHEN s.p IS NULL THEN {first} ELSE {later} END)")

    def composed(self, name: str) -> Column:
        """Of a range's summaries, the fields ``name`` of ``items``."""
        keep, add = self._keep("(t.p - s.last)"), self._add("(t.p - s.last)")
        both = f"named_struct('p', s.p, 'v', s.v, 'a', s.a * {keep} * t.a, 'b', t.a * ({keep} * s.b + {add} * t.v) + t.b, 'last', t.last)"
        return F.expr(f"aggregate(items.{name}, {_NOTHING}, (s, t) -> CASE WHEN s.p IS NULL THEN t WHEN t.p IS NULL THEN s ELSE {both} END)")

    def states(self, name: str, start: str) -> Column:
        """The states before each of a range's summaries, from ``start`` on."""
        keep, add = self._keep("(t.p - s.seen)"), self._add("(t.p - s.seen)")
        first = f"CASE WHEN s.seen IS NULL THEN t.v ELSE {keep} * s.y + {add} * t.v END"
        step = f"CASE WHEN t.p IS NULL THEN s ELSE named_struct('y', t.a * ({first}) + t.b, 'seen', t.last) END".replace("s.", "element_at(out, -1).").replace("THEN s ", "THEN element_at(out, -1) ")
        return F.expr(f"slice(aggregate(items.{name}, array({start}), (out, t) -> concat(out, array({step}))), 1, size(items))")

    def means(self, start: str) -> Column:
        """The states after each of a chunk's bars."""
        keep, add, v = self._keep("(x.bar_seq - s.seen)"), self._add("(x.bar_seq - s.seen)"), self.v
        step = f"CASE WHEN {v} IS NULL THEN s WHEN s.seen IS NULL THEN named_struct('y', {v}, 'seen', x.bar_seq) ELSE named_struct('y', {keep} * s.y + {add} * {v}, 'seen', x.bar_seq) END".replace("s.", "element_at(out, -1).").replace("THEN s ", "THEN element_at(out, -1) ")
        return F.expr(f"slice(aggregate(_xs, array({start}), (out, x) -> concat(out, array({step}))), 2, size(_xs))")


_NOTHING = "named_struct('p', cast(null as bigint), 'v', cast(null as double), 'a', 1d, 'b', 0d, 'last', cast(null as bigint))"
_BEFORE = "named_struct('y', cast(null as double), 'seen', cast(null as bigint))"
#: Bars of a chunk and chunks of a range: what one row of arrays holds.
CHUNK, RANGE = 64, 1024


def with_ewm(df: DataFrame, columns: dict[str, tuple[str, float]], chunk: int = CHUNK, range_: int = RANGE) -> DataFrame:
    """``df`` with exponential means: name to (column, span), y = (1 - alpha) * y + alpha * x from the first observed x.

    A mean is a chain of affine maps, and maps compose: chunks of bars become one map each, ranges of chunks too, and a
    symbol's few ranges are walked in order. Then each chunk is walked from the value that reaches it. So a long symbol
    is many tasks' work, in JVM functions alone; what one row holds is bounded by ``chunk`` and ``range_``.
    """
    others = [c for c in df.columns if c not in ("symbol", "bar_seq", *columns)]
    means = {n: _Mean(c, span) for n, (c, span) in columns.items()}
    at = F.floor(F.col("bar_seq") / chunk)
    rows = df.select("symbol", at.alias("_chunk"), F.floor(at / range_).alias("_range"), F.struct(F.col("bar_seq").cast("bigint").alias("bar_seq"), *others).alias("_x"))
    parts = rows.groupBy("symbol", "_range", "_chunk").agg(F.sort_array(F.collect_list("_x")).alias("_xs"))

    def collected(df: DataFrame, by: list[str], key: str) -> DataFrame:
        return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(key, *columns))).alias("items"))

    def handed_down(df: DataFrame, by: list[str], key: str, start: dict[str, str]) -> DataFrame:
        """(by, key, and each mean's state before it)."""
        zipped = df.select(*by, F.explode(F.arrays_zip(F.col(f"items.{key}").alias("k"), *(mean.states(n, start[n]).alias(n) for n, mean in means.items()))).alias("z"))
        return zipped.select(*by, F.col("z.k").alias(key), *(F.col(f"z.{n}").alias(f"{n}_in") for n in columns))

    inner = {n: f"{n}_in" for n in columns}
    ranges = written(collected(parts.select("symbol", "_range", "_chunk", *(mean.summary().alias(n) for n, mean in means.items())), ["symbol", "_range"], "_chunk"), "ranges")  # needed twice, and small
    summed = ranges.select("symbol", "_range", *(mean.composed(n).alias(n) for n, mean in means.items()))
    into_range = handed_down(collected(summed, ["symbol"], "_range"), ["symbol"], "_range", dict.fromkeys(columns, _BEFORE))
    into_chunk = handed_down(ranges.join(into_range, ["symbol", "_range"]), ["symbol", "_range"], "_chunk", inner)
    walked = parts.join(into_chunk, ["symbol", "_range", "_chunk"])
    states = [mean.means(inner[n]).alias(n) for n, mean in means.items()]
    out = walked.select("symbol", F.explode(F.arrays_zip(F.col("_xs").alias("x"), *states)).alias("z"))
    return out.select("symbol", F.col("z.x.bar_seq").cast(df.schema["bar_seq"].dataType).alias("bar_seq"), *(F.col(f"z.x.{c}").alias(c) for c in others), *(F.col(f"z.{n}.y").alias(n) for n in columns)).select(*[c for c in df.columns if c not in columns], *columns)


def ma_cross(df: DataFrame, fast: int = 20, slow: int = 50, price: str = "close", kind: str = "sma") -> DataFrame:
    """``df`` with ``signal``."""
    if kind == "sma":
        df = df.withColumns({"_fast": sma(price, fast), "_slow": sma(price, slow)})
    elif kind == "ema":
        df = with_ewm(df, {"_fast": (price, fast), "_slow": (price, slow)})
    else:
        raise ValueError(f"kind must be 'sma' or 'ema', not {kind!r}")
    return df.withColumn("signal", crossover(F.col("_fast"), F.col("_slow"))).drop("_fast", "_slow")


def macd_cross(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "close") -> DataFrame:
    two = with_ewm(df, {"_f": (price, fast), "_s": (price, slow)}).withColumn("_macd", F.col("_f") - F.col("_s"))
    return with_ewm(two, {"_line": ("_macd", signal)}).withColumn("signal", crossover(F.col("_macd"), F.col("_line"))).drop("_f", "_s", "_line").withColumnRenamed("_macd", "macd")


def with_atr(df: DataFrame, span: int = 14) -> DataFrame:
    """``df`` with ``atr``: the exponential mean of the true range; the first bar has no close before it."""
    before = F.lag("close").over(by_bar())
    ranged = df.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return with_ewm(ranged, {"atr": ("_tr", span)}).drop("_tr")


def donchian(df: DataFrame, lookback: int = 20) -> DataFrame:
    """``signal``: close above the highest high of the full ``lookback`` bars before."""
    frame = by_bar().rowsBetween(-lookback, -1)
    return df.withColumn("signal", F.coalesce((F.count("high").over(frame) == lookback) & (F.col("close") > F.max("high").over(frame)), F.lit(False)))


def random_picks(groups: DataFrame, n: Column, seed: int, *key: str) -> DataFrame:
    """``groups`` (with ``last``, their last bar) with ``bar_seq``: min(n, last) distinct bars of each, never the last one.
    Each pick is a row of its own, so none of them costs more for there being many bars."""
    slots = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(n, F.col("last")) - 1)).alias("_slot")
    rows = groups.where((F.col("last") > 0) & (n > 0)).select("*", slots)
    return rows.withColumn("bar_seq", rng.permuted(F.col("_slot"), F.col("last"), seed, *map(F.col, key))).drop("_slot")


def random_entries(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``signal`` on min(n, bars - 1) distinct bars of each symbol, never the last."""
    lasts = df.groupBy("symbol").agg(F.max("bar_seq").cast("bigint").alias("last"))
    picks = random_picks(lasts, F.lit(n).cast("bigint"), seed, "symbol").select("symbol", "bar_seq", F.lit(True).alias("_hit"))
    return df.join(picks, ["symbol", "bar_seq"], "left").withColumn("signal", F.coalesce("_hit", F.lit(False))).drop("_hit")
