"""Triple-barrier trades: every candidate's path in parallel, then the non-overlapping chain of each symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewright.operators.signals import by_bar, with_atr
from edgewright.tables import written

TIMEOUT = 20
TRADE_COLUMNS = ("symbol", "trade_seq", "r", "mfe", "mae", "bars_held", "entry_date", "exit_date", "exit_reason")


def paths(bars: DataFrame, side: str = "long", *, tp: float = 2.0, sl: float = 1.0, timeout: int = TIMEOUT, risk_unit: str = "atr", entry: str = "next_open", keep: list[str] | None = None) -> DataFrame:
    """What each bar's entry would lead to: (symbol, bar_seq, exit_seq, r, mfe, mae, bars_held, dates, exit_reason).

    A bar's exit depends on that bar alone, so all are resolved at once. Entry bars meet the bars of their horizon
    by an equality join on blocks of ``timeout`` bars: a bar belongs to its own block, an entry to its own and the
    next, so no pair of bars outside the horizon's two blocks is ever built.
    """
    if entry not in ("next_open", "close"):
        raise ValueError(f"entry must be 'next_open' or 'close', not {entry!r}")
    plain = bars
    if risk_unit == "atr" and "atr" not in bars.columns:
        bars = with_atr(bars)
    s = 1.0 if side == "long" else -1.0
    unit = F.col("atr") if risk_unit == "atr" else F.lit(1.0)
    last = F.max("bar_seq").over(Window.partitionBy("symbol"))
    shift = 1 if entry == "next_open" else 0
    price = F.lead("open").over(by_bar()) if shift else F.col("close")
    date = F.lead("ts").over(by_bar()) if shift else F.col("ts")
    block = timeout + 1
    candidates = bars.select("symbol", *(keep or []), F.col("bar_seq").alias("i"), (F.col("bar_seq") + shift).alias("ei"), price.alias("ep"), date.alias("entry_date"), unit.alias("unit"), last.alias("last"))
    candidates = candidates.where((F.col("i") < F.col("last")) & (F.col("ep") > 0) & (F.col("unit") > 0) & ~F.isnan("unit"))
    candidates = candidates.withColumn("risk", sl * F.col("unit"))
    candidates = candidates.withColumns({"stop": F.col("ep") - s * F.col("risk"), "goal": F.col("ep") + s * tp * F.col("unit")})
    spread = candidates.withColumn("block", F.explode(F.array(F.floor(F.col("ei") / block), F.floor(F.col("ei") / block) + 1)))
    ahead = plain.select(F.col("symbol").alias("sym"), F.floor(F.col("bar_seq") / block).alias("blk"), F.col("bar_seq").alias("j"), F.col("ts").alias("t"), "high", "low", "close")
    steps = spread.join(ahead, (F.col("symbol") == F.col("sym")) & (F.col("block") == F.col("blk")) & (F.col("j") >= F.col("ei")) & (F.col("j") <= F.col("ei") + timeout))
    best, worst = (F.col("high"), F.col("low")) if s > 0 else (F.col("low"), F.col("high"))
    stopped = F.col("low") <= F.col("stop") if s > 0 else F.col("high") >= F.col("stop")
    hit = F.col("high") >= F.col("goal") if s > 0 else F.col("low") <= F.col("goal")
    reason = F.when(stopped, "SL").when(hit, "TP").when(F.col("j") - F.col("ei") >= timeout, "timeout").when(F.col("j") == F.col("last"), "eod")
    level = F.when(stopped, F.col("stop")).when(hit, F.col("goal")).otherwise(F.col("close"))
    steps = steps.select("symbol", *(keep or []), "i", "ei", "ep", "risk", "entry_date", "j", "t", reason.alias("reason"), level.alias("xp"), (s * (best - F.col("ep")) / F.col("risk")).alias("up"), (s * (worst - F.col("ep")) / F.col("risk")).alias("down"))
    ordered = F.sort_array(F.collect_list(F.struct("j", "t", "reason", "xp", "up", "down")))
    walked = steps.groupBy("symbol", *(keep or []), "i", "ei", "ep", "risk", "entry_date").agg(ordered.alias("path"))
    end = F.array_min(F.transform(F.filter("path", lambda p: p["reason"].isNotNull()), lambda p: p["j"]))
    walked = walked.withColumn("exit_seq", end).where("exit_seq is not null").withColumn("taken", F.filter("path", lambda p: p["j"] <= F.col("exit_seq")))
    at = F.element_at("taken", -1)
    return walked.select(
        "symbol", *(keep or []), F.col("i").alias("bar_seq"), "exit_seq",
        (s * (at["xp"] - F.col("ep")) / F.col("risk")).alias("r"),
        F.greatest(F.lit(0.0), F.array_max(F.transform("taken", lambda p: p["up"]))).alias("mfe"),
        F.least(F.lit(0.0), F.array_min(F.transform("taken", lambda p: p["down"]))).alias("mae"),
        (F.col("exit_seq") - F.col("ei")).cast("int").alias("bars_held"), "entry_date", at["t"].alias("exit_date"), at["reason"].alias("exit_reason"),
    )


#: Bars of a block of the chain.
BLOCK = 4096


def chained(found: DataFrame, by: list[str], longest: int, block: int = BLOCK) -> DataFrame:
    """Of each group's candidates in order of their bars, those that start after the exit of the one taken before.

    All that a block of bars needs to know of the bars before it is where the last trade exits, at most ``longest`` bars
    after it began. So each block says apart where its own last trade exits for each of these few cases; a group's blocks
    are walked by these tables alone, and then each block picks its trades from the case that came true.
    """
    block = max(block, 4 * longest)
    others = [c for c in found.columns if c not in by]
    rows = found.select(*by, F.floor(F.col("bar_seq") / block).alias("_block"), F.struct("bar_seq", "exit_seq", *(c for c in others if c not in ("bar_seq", "exit_seq"))).alias("_x"))
    blocks = written(rows.groupBy(*by, "_block").agg(F.sort_array(F.collect_list("_x")).alias("_xs")), "blocks")
    first = F.col("_block") * block - 1  # a trade that exits here or before leaves the whole block free
    spans = F.transform("_xs", lambda x: F.struct(x["bar_seq"].cast("bigint").alias("i"), x["exit_seq"].cast("bigint").alias("j")))
    leaves = lambda free: F.aggregate("spans", free, lambda at, x: F.when(x["i"] > at, x["j"]).otherwise(at))
    cases = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(longest).cast("bigint")), lambda k: leaves(first + k))
    tables = blocks.select(*by, "_block", spans.alias("spans")).select(*by, "_block", cases.alias("cases"))
    walked = tables.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_block", "cases"))).alias("tables"))
    begin = F.array(F.struct(F.lit(-1).cast("bigint").alias("free"), F.lit(-1).cast("bigint").alias("after")))

    def step(out, t):
        free = F.greatest(F.element_at(out, -1)["after"], t["_block"] * block - 1)
        return F.concat(out, F.array(F.struct(free.alias("free"), F.get(t["cases"], (free - t["_block"] * block + 1).cast("int")).alias("after"))))

    free = F.slice(F.aggregate("tables", begin, step), F.lit(2), F.size("tables"))
    entries = walked.select(*by, F.explode(F.arrays_zip(F.transform("tables", lambda t: t["_block"]).alias("b"), F.transform(free, lambda x: x["free"]).alias("f"))).alias("z"))
    entries = entries.select(*by, F.col("z.b").alias("_block"), F.col("z.f").alias("_free"))
    state = F.struct(F.col("_free").alias("free"), F.slice("_xs", 1, 0).alias("kept"))
    take = lambda s, x: F.when(x["bar_seq"] > s["free"], F.struct(x["exit_seq"].cast("bigint").alias("free"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)
    kept = blocks.join(entries, [*by, "_block"]).select(*by, F.explode(F.aggregate("_xs", state, take)["kept"]).alias("_x"))
    return kept.select(*by, *(F.col(f"_x.{c}").alias(c) for c in others))


def barrier_trades(bars: DataFrame, signal: str = "signal", side: str = "long", **options) -> DataFrame:
    """The trade log of the bars where ``signal`` is true; without any, an empty one with the same columns."""
    found = paths(bars, side, keep=[signal], **options).where(F.coalesce(F.col(signal), F.lit(False)))
    taken = chained(found, ["symbol"], options.get("timeout", TIMEOUT) + 1)
    return taken.withColumn("trade_seq", F.col("bar_seq")).select(*TRADE_COLUMNS)


def excursions(bars: DataFrame, side: str = "long", *, horizons: int = 20, signal: str = "signal") -> DataFrame:
    """(k, mean_mfe, mean_mae, n): excursions in units of ATR within k bars of each signal's entry."""
    s = 1.0 if side == "long" else -1.0
    if "atr" not in bars.columns:
        bars = with_atr(bars)
    entry = F.lead("open").over(by_bar())
    out = []
    for k in range(1, horizons + 1):
        frame = by_bar().rowsBetween(1, k)
        full = F.count("high").over(frame) == k
        up, down = (F.max("high").over(frame), F.min("low").over(frame)) if s > 0 else (F.min("low").over(frame), F.max("high").over(frame))
        out.append(F.when(full, F.struct(F.lit(k).alias("k"), (F.greatest(F.lit(0.0), s * (up - entry) / F.col("atr"))).alias("mfe"), (F.least(F.lit(0.0), s * (down - entry) / F.col("atr"))).alias("mae"))))
    rows = bars.withColumn("_x", F.array(*out)).where(F.coalesce(F.col(signal), F.lit(False))).select(F.explode("_x").alias("x")).where("x is not null")
    return rows.groupBy("x.k").agg(F.avg("x.mfe").alias("mean_mfe"), F.avg("x.mae").alias("mean_mae"), F.count("*").alias("n"))
