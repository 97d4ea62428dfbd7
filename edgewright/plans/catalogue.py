"""Registered queries of the library's own operators and their SQL twins.

Every query runs over its whole tables. Doubles are rounded, as sums come in any order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewright.functions.scalars import EULER, NORMAL, Baseline, cusum_design
from edgewright.operators import barriers, gates, metrics, monitor, nulls, overfit, panels, resample, scores, search, signals, splits, walkforward
from edgewright.sources import fixtures as fx
from edgewright.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Draws of the registered resampling queries, which SQL repeats slot by slot; the operators' own defaults are larger.
BOOT, DRAWS = 20, 200
SPLIT = "1997-01-01"
BASE = Baseline(0.08, 0.9, 1000, 400.0)
DESIGN = cusum_design(BASE)


def rounded(df: DataFrame) -> DataFrame:
    kinds = {"double": lambda c: F.round(c, 6) + 0.0, "float": lambda c: F.round(c.cast("double"), 6) + 0.0, "int": lambda c: c.cast("bigint")}
    return df.select(*(kinds.get(t, lambda c: c)(F.col(f"`{c}`")).alias(c) for c, t in df.dtypes))


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _u52(*parts) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 13))::BIGINT"


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


_PF = "CASE WHEN {d} <> 0 THEN {g} / abs({d}) WHEN {g} > 0 THEN 'inf'::DOUBLE ELSE 0.0 END"
_SQN = "CASE WHEN count({r}) < 2 OR stddev_samp({r}) IS NULL OR stddev_samp({r}) <= 1e-12 * (avg(abs({r})) + 1e-12) THEN 0.0 ELSE avg({r}) / stddev_samp({r}) * sqrt(least(count({r}), 100)) END"
_UP, _DOWN = "coalesce(sum({r}) FILTER ({r} > 0), 0)", "coalesce(sum({r}) FILTER ({r} < 0), 0)"
_SCORES = {
    "win_rate": "avg(({r} > 0)::INT)",
    "expectancy": "avg({r})",
    "profit_factor": _PF.format(g=_UP, d=_DOWN),
    "payoff_ratio": "CASE WHEN count(*) FILTER ({r} > 0) = 0 THEN 0.0 WHEN count(*) FILTER ({r} < 0) = 0 THEN 'inf'::DOUBLE ELSE avg({r}) FILTER ({r} > 0) / abs(avg({r}) FILTER ({r} < 0)) END",
    "sqn": _SQN,
}


def _score(name: str, r: str = "r") -> str:
    return _SCORES[name].replace("{r}", r)


_REPORT = f"""count(r) AS n, {", ".join(f"{_r(_score(m))} AS {m}" for m in _SCORES)},
  {_r("avg(mfe) / abs(avg(mae))")} AS excursion_ratio, {_r("avg(bars_held) FILTER (r > 0) / avg(bars_held) FILTER (r < 0)")} AS time_asymmetry,
  {_r("avg(r) FILTER (r > 0) / avg(mfe) FILTER (r > 0)")} AS exit_efficiency"""


@query(f"SELECT segment, {_REPORT} FROM ({fx.TRADES}) GROUP BY segment")
def edge_report_by_segment(spark, sf_dir):
    return metrics.edge_report(fx.trades(spark, sf_dir), ["segment"])


@query(f"""SELECT segment, bin::BIGINT AS bin, count(*) AS trades, {_r("avg((r > 0)::INT)")} AS win_rate FROM (
  SELECT *, CASE WHEN prob < 0.5 THEN 0 WHEN prob < 0.6 THEN 1 WHEN prob < 0.7 THEN 2 WHEN prob < 0.8 THEN 3 ELSE 4 END AS bin FROM ({fx.TRADES})) GROUP BY ALL""")
def calibration_bins(spark, sf_dir):
    return metrics.calibration(fx.trades(spark, sf_dir), ["segment"])


def _draws(book: str, n_boot: int, by: str = "") -> str:
    """(group, draw, r) of every slot of every draw of a book; slots come first, as a join order of its own may pair whole books."""
    own, part, same = (f"{by}, ", f"PARTITION BY {by}", f" AND x.{by} = s.{by}") if by else ("", "", "")
    return f"""(WITH b AS MATERIALIZED (SELECT {own}r, row_number() OVER ({part} ORDER BY trade_seq) - 1 AS i, count(*) OVER ({part}) AS n FROM ({book})),
      s AS MATERIALIZED (SELECT {own}d.draw, {_u52(42, "d.draw", "i")} % n AS j FROM b CROSS JOIN range({n_boot}) d(draw))
      SELECT {f"s.{by}, " if by else ""}s.draw, x.r FROM s JOIN b x ON x.i = s.j{same})"""


def _verdict(book: str, n_boot: int, by: str = "", alpha: float = 0.05) -> str:
    own, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    group = f"GROUP BY {by}" if by else ""
    return f"""
WITH m AS (SELECT {own}draw, avg(r) AS e FROM {_draws(book, n_boot, by)} GROUP BY ALL),
c AS (SELECT {own}quantile_cont(e, {alpha / 2}) AS ci_low, quantile_cont(e, {1 - alpha / 2}) AS ci_high, avg((e > 0)::INT) AS p_positive FROM m {group}),
p AS (SELECT {own}count(r) AS n, avg(r) AS point FROM ({book}) {group})
SELECT {own}n, {_r("point")} AS point, {_r("ci_low")} AS ci_low, {_r("ci_high")} AS ci_high, {_r("p_positive")} AS p_positive, {_r("1 - p_positive")} AS p_value,
  CASE WHEN point > 0 AND ci_low > 0 THEN 'HELD' WHEN point > 0 THEN 'FRAGILE' ELSE 'FAIL' END AS verdict FROM p JOIN c {on}"""


@query(_verdict(fx.WEEKLY, DRAWS))
def bootstrap_verdict(spark, sf_dir):
    return resample.reality_check(fx.weekly(spark, sf_dir), n_boot=DRAWS)


@query(f"""
WITH m AS (SELECT draw, {", ".join(f"{_score(m)} AS {m}" for m in ("expectancy", "profit_factor", "sqn", "win_rate"))} FROM {_draws(fx.WEEKLY, DRAWS)} GROUP BY draw),
u AS (UNPIVOT m ON expectancy, profit_factor, sqn, win_rate INTO NAME metric VALUE v),
q AS (SELECT {", ".join(f"{_score(m)} AS {m}" for m in ("expectancy", "profit_factor", "sqn", "win_rate"))} FROM ({fx.WEEKLY})),
p AS (UNPIVOT q ON expectancy, profit_factor, sqn, win_rate INTO NAME metric VALUE point)
SELECT metric, {_r("point")} AS point, {_r("quantile_cont(v, 0.025)")} AS ci_low, {_r("quantile_cont(v, 0.975)")} AS ci_high FROM u JOIN p USING (metric) GROUP BY metric, point""")
def bootstrap_metric_cis(spark, sf_dir):
    return resample.bootstrap_metric_cis(fx.weekly(spark, sf_dir), n_boot=DRAWS)


_BLOCK_END = f"""
o AS (SELECT count(*) AS n, avg(r) AS observed FROM ({fx.WEEKLY}))
SELECT n, {_r("observed")} AS observed, {_r(f"((SELECT count(*) FROM m, o WHERE mean - observed >= observed) + 1) / {DRAWS + 1}.0")} AS p_value,
  {_r("(SELECT quantile_cont(mean, 0.025) FROM m)")} AS ci_low, {_r("(SELECT quantile_cont(mean, 0.975) FROM m)")} AS ci_high FROM o"""


@query(f"""
WITH b AS (SELECT r, row_number() OVER (ORDER BY trade_seq) - 1 AS i, count(*) OVER () AS n FROM ({fx.WEEKLY})),
s AS (SELECT d.draw, b.n, ({_u52(42, "d.draw", "b.i // 6")} % b.n + b.i % 6) % b.n AS j FROM b CROSS JOIN range({DRAWS}) d(draw)),
m AS (SELECT draw, avg(r) AS mean FROM s JOIN b ON b.i = s.j GROUP BY draw), {_BLOCK_END}""")
def block_bootstrap_circular(spark, sf_dir):
    return resample.block_bootstrap(fx.weekly(spark, sf_dir), n_boot=DRAWS)


@query(f"""
WITH b AS (SELECT r, row_number() OVER (ORDER BY trade_seq) - 1 AS i, count(*) OVER () AS n FROM ({fx.WEEKLY})),
t AS (SELECT d.draw, b.i, b.n, CASE WHEN b.i = 0 THEN {_u52(42, "'j'", "d.draw", 0)} % b.n WHEN {_u52(42, "'b'", "d.draw", "b.i")} % 6 = 0 THEN {_u52(42, "'j'", "d.draw", "b.i")} % b.n END AS jump FROM b CROSS JOIN range({DRAWS}) d(draw)),
f AS (SELECT *, last_value(jump IGNORE NULLS) OVER w AS base, last_value(CASE WHEN jump IS NOT NULL THEN i END IGNORE NULLS) OVER w AS at FROM t WINDOW w AS (PARTITION BY draw ORDER BY i)),
m AS (SELECT draw, avg(r) AS mean FROM f JOIN b ON b.i = (f.base + f.i - f.at) % f.n GROUP BY draw), {_BLOCK_END}""")
def block_bootstrap_stationary(spark, sf_dir):
    return resample.block_bootstrap(fx.weekly(spark, sf_dir), n_boot=DRAWS, stationary=True)


@query(f"""
WITH b AS (SELECT r, row_number() OVER (ORDER BY trade_seq) - 1 AS i, count(*) OVER () AS n FROM ({fx.WEEKLY})),
m AS (SELECT d.draw, avg(abs(r) * CASE WHEN {_u52(42, "d.draw", "b.i")} % 2 = 0 THEN 1 ELSE -1 END) AS mean FROM b CROSS JOIN range({DRAWS}) d(draw) GROUP BY d.draw),
o AS (SELECT count(*) AS n, avg(r) AS observed FROM b)
SELECT n, {_r("observed")} AS observed, {_r(f"((SELECT count(*) FROM m, o WHERE mean >= observed - 1e-12) + 1) / {DRAWS + 1}.0")} AS p_value FROM o""")
def sign_permutation(spark, sf_dir):
    return search.sign_permutation(fx.weekly(spark, sf_dir), n_perm=DRAWS)


_MONTHLY = f"""SELECT segment AS variant, dense_rank() OVER (ORDER BY segment) - 1 AS variant_ord, obs_seq, r FROM (
  SELECT segment, (year(entry_date) * 12 + month(entry_date)) AS obs_seq, round(avg(r), 6) AS r FROM ({fx.TRADES}) GROUP BY ALL)"""


def variants(spark, sf_dir):
    """Monthly mean R of each segment, as variants in order of their names."""
    rows = fx.trades(spark, sf_dir).groupBy("segment", (F.year("entry_date") * 12 + F.month("entry_date")).alias("obs_seq")).agg(F.round(F.avg("r"), 6).alias("r"))
    return rows.select(F.col("segment").alias("variant"), (F.dense_rank().over(Window.orderBy("segment")) - 1).alias("variant_ord"), "obs_seq", "r")


@query(f"""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY obs_seq) - 1 AS i FROM ({_MONTHLY})),
s AS (SELECT variant, variant_ord, avg(r) AS mean FROM v GROUP BY ALL), b AS (SELECT * FROM s ORDER BY mean DESC, variant_ord LIMIT 1),
m AS (SELECT draw, max(mean) AS best FROM (SELECT d.draw, variant, avg(abs(r) * CASE WHEN {_u52(42, "d.draw", "variant_ord", "i")} % 2 = 0 THEN 1 ELSE -1 END) AS mean FROM v CROSS JOIN range({DRAWS}) d(draw) GROUP BY ALL) GROUP BY draw)
SELECT variant AS best_variant, {_r("mean")} AS best_mean, {_r(f"((SELECT count(*) FROM m, b WHERE best >= mean - 1e-12) + 1) / {DRAWS + 1}.0")} AS p_value, (SELECT count(*) FROM s) AS n_variants FROM b""")
def whites_reality_check(spark, sf_dir):
    return search.whites_reality_check(variants(spark, sf_dir), n_perm=DRAWS)


@query(f"""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY obs_seq) - 1 AS i FROM ({_MONTHLY})),
s AS (SELECT variant, variant_ord, count(*) AS n, avg(r) AS mean, stddev_samp(r) / sqrt(count(*)) AS se FROM v GROUP BY ALL HAVING count(*) >= 2 AND stddev_samp(r) > 0),
k AS (SELECT *, mean / se AS t FROM s WHERE mean / se >= -sqrt(2 * ln(ln(greatest(n, 3))))), b AS (SELECT * FROM k ORDER BY t DESC, variant_ord LIMIT 1),
m AS (SELECT draw, max(x) AS best FROM (SELECT d.draw, v.variant, avg(abs(r) * CASE WHEN {_u52(42, "d.draw", "v.variant_ord", "i")} % 2 = 0 THEN 1 ELSE -1 END) / any_value(se) AS x FROM v JOIN k USING (variant) CROSS JOIN range({DRAWS}) d(draw) GROUP BY ALL) GROUP BY draw)
SELECT variant AS best_variant, {_r("t")} AS best_t, {_r(f"((SELECT count(*) FROM m, b WHERE best >= t - 1e-12) + 1) / {DRAWS + 1}.0")} AS p_value, (SELECT count(*) FROM s) AS n_variants, (SELECT count(*) FROM k) AS n_kept FROM b""")
def spa_test(spark, sf_dir):
    return search.spa_test(variants(spark, sf_dir), n_perm=DRAWS)


_CUT = f"""SELECT *, CASE WHEN entry_date < TIMESTAMP '{SPLIT}' AND exit_date < TIMESTAMP '{SPLIT}' THEN 'train' WHEN entry_date >= TIMESTAMP '{SPLIT}' + INTERVAL 56 DAY THEN 'test' END AS side
  FROM ({fx.TRADES})"""
_SIDES = f"SELECT * FROM ({_CUT}) WHERE side IS NOT NULL"


@query(_verdict(_SIDES, BOOT, "side"))
def holdout(spark, sf_dir):
    return splits.holdout(fx.trades(spark, sf_dir), SPLIT, n_boot=BOOT)


@query(f"""SELECT split_part(ss, '|', 1) AS segment, split_part(ss, '|', 2) AS side, * EXCLUDE (ss), max(n) FILTER (split_part(ss, '|', 2) = 'test') OVER (PARTITION BY split_part(ss, '|', 1)) < 2700 AS thin FROM ({_verdict(f"SELECT *, segment || '|' || side AS ss FROM ({_SIDES}) UNION ALL SELECT *, 'OVERALL|' || side AS ss FROM ({_SIDES})", BOOT, "ss")})""")
def segmented_holdout(spark, sf_dir):
    return splits.segmented_holdout(fx.trades(spark, sf_dir), "segment", SPLIT, n_boot=BOOT, min_n=2700)


@query(f"""
WITH t AS (SELECT *, year(entry_date) AS y FROM ({fx.TRADES})), e AS (SELECT min(y) AS y0, max(y) AS y1 FROM t),
w AS (SELECT CASE WHEN grouping(segment) = 1 THEN 'OVERALL' ELSE segment END AS segment, (y - y0) // 2 AS win_ord, count(r) AS n, avg(r) AS value FROM t, e GROUP BY GROUPING SETS ((segment, (y - y0) // 2), ((y - y0) // 2))),
g AS (SELECT s.segment, k.k AS win_ord, y0 + 2 * k.k AS a, y0 + 2 * k.k + 2 AS b FROM (SELECT DISTINCT segment FROM t UNION SELECT 'OVERALL') s, e, LATERAL (SELECT unnest(range(0, (y1 - y0) // 2 + 1)) AS k) k)
SELECT segment, win_ord::BIGINT AS win_ord, a::BIGINT AS y0, b::BIGINT AS y1, coalesce(n, 0)::BIGINT AS n, coalesce({_r("value")}, 'nan'::DOUBLE) AS value, coalesce(n, 0) >= 8 AS ok FROM g LEFT JOIN w USING (segment, win_ord)""")
def windowed_segments(spark, sf_dir):
    return splits.windowed_segments(fx.trades(spark, sf_dir), "segment", window_years=2)


@query(f"""
WITH m AS (SELECT date_trunc('month', exit_date)::DATE AS period, sum(r) AS r FROM ({fx.TRADES}) GROUP BY 1)
SELECT last_day(c.period) AS period, {_r("coalesce(r, 0)")} AS r FROM (SELECT unnest(generate_series((SELECT min(period) FROM m), (SELECT max(period) FROM m), INTERVAL 1 MONTH))::DATE AS period) c LEFT JOIN m USING (period)""")
def monthly_r(spark, sf_dir):
    return splits.period_r(fx.trades(spark, sf_dir))


def _asof(op: str) -> str:
    return f"""
WITH p AS ({fx.PRICES}), c AS (SELECT DISTINCT symbol, date_trunc('month', ts)::TIMESTAMP AS cutoff FROM p)
SELECT * FROM (SELECT c.symbol, c.cutoff, row_number() OVER (PARTITION BY c.symbol, c.cutoff ORDER BY p.ts DESC) AS back, p.ts, {_r("p.close")} AS close FROM c JOIN p ON p.symbol = c.symbol AND p.ts {op} c.cutoff) WHERE back <= 5"""


def _cutoffs(spark, sf_dir):
    p = fx.prices(spark, sf_dir)
    return p, p.select("symbol", F.date_trunc("month", "ts").alias("cutoff")).distinct()


@query(_asof("<="))
def asof_window(spark, sf_dir):
    return splits.asof_window(*_cutoffs(spark, sf_dir)).select("symbol", "cutoff", "back", "ts", "close")


@query(_asof("<"))
def window_before(spark, sf_dir):
    return splits.window_before(*_cutoffs(spark, sf_dir)).select("symbol", "cutoff", "back", "ts", "close")


_W = "PARTITION BY symbol ORDER BY bar_seq"


@query(f"""
WITH m AS (SELECT symbol, bar_seq, CASE WHEN count(*) OVER f = 5 THEN avg(close) OVER f END AS a, CASE WHEN count(*) OVER s = 20 THEN avg(close) OVER s END AS b FROM ({fx.PRICES})
  WINDOW f AS ({_W} ROWS 4 PRECEDING), s AS ({_W} ROWS 19 PRECEDING))
SELECT symbol, bar_seq, coalesce(lag(a) OVER w <= lag(b) OVER w AND a > b, false) AS signal FROM m WINDOW w AS ({_W})""")
def ma_cross(spark, sf_dir):
    return signals.ma_cross(fx.prices(spark, sf_dir), 5, 20).select("symbol", "bar_seq", "signal")


def _ewm(source: str, columns: dict[str, tuple[str, float]]) -> str:
    """A recursive query of exponential means of columns of ``source`` (a CTE name)."""
    first = ", ".join(f"{c} AS {n}" for n, (c, _) in columns.items())
    step = ", ".join(f"{1 - 2 / (s + 1)!r} * e.{n} + {2 / (s + 1)!r} * p.{c}" for n, (c, s) in columns.items())
    return f"SELECT symbol, bar_seq, {first} FROM {source} WHERE bar_seq = 0 UNION ALL SELECT p.symbol, p.bar_seq, {step} FROM e JOIN {source} p ON p.symbol = e.symbol AND p.bar_seq = e.bar_seq + 1"


@query(f"""
WITH RECURSIVE p AS MATERIALIZED ({fx.PRICES}), e AS ({_ewm("p", {"f": ("close", 12), "s": ("close", 26)})}),
q AS MATERIALIZED (SELECT symbol, bar_seq, f - s AS macd FROM e),
l AS (SELECT symbol, bar_seq, macd AS line FROM q WHERE bar_seq = 0 UNION ALL SELECT q.symbol, q.bar_seq, 0.8 * l.line + 0.2 * q.macd FROM l JOIN q ON q.symbol = l.symbol AND q.bar_seq = l.bar_seq + 1)
SELECT symbol, bar_seq, {_r("macd")} AS macd, coalesce(lag(macd) OVER w <= lag(line) OVER w AND macd > line, false) AS signal FROM q JOIN l USING (symbol, bar_seq) WINDOW w AS ({_W})""")
def macd_cross(spark, sf_dir):
    return signals.macd_cross(fx.prices(spark, sf_dir)).select("symbol", "bar_seq", "macd", "signal")


_TR = f"SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM ({fx.PRICES}) WINDOW w AS ({_W})"


@query(f"WITH RECURSIVE p AS MATERIALIZED ({_TR}), e AS ({_ewm('p', {'atr': ('tr', 14)})}) SELECT symbol, bar_seq, {_r('atr')} AS atr FROM e")
def atr(spark, sf_dir):
    return signals.with_atr(fx.prices(spark, sf_dir)).select("symbol", "bar_seq", "atr")


@query(f"SELECT symbol, bar_seq, coalesce(count(*) OVER f = 10 AND close > max(high) OVER f, false) AS signal FROM ({fx.PRICES}) WINDOW f AS ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def donchian(spark, sf_dir):
    return signals.donchian(fx.prices(spark, sf_dir), 10).select("symbol", "bar_seq", "signal")


def _permuted(slot: str, m: str, *key) -> str:
    """The SQL of ``rng.permuted``."""
    a = f"ceil(sqrt({m}))::BIGINT"
    b = f"ceil({m} / {a})::BIGINT"
    once = lambda x, s, j: f"list_reduce(list_concat([{x}], range(1, 5)), lambda {s}, {j}: CASE WHEN {j} % 2 = 1 THEN ({s} // {b} + {_u52(*key, j, f'{s} % {b}')}) % {a} * {b} + {s} % {b} ELSE {s} // {b} * {b} + ({s} % {b} + {_u52(*key, j, f'{s} // {b}')}) % {b} END)"
    return f"list_reduce(list_concat([{once(slot, 's', 'j')}], range(15)), lambda y, i: CASE WHEN y >= {m} THEN {once('y', 's', 'j')} ELSE y END)"


@query(f"""
WITH p AS (SELECT *, max(bar_seq) OVER (PARTITION BY symbol) AS last FROM ({fx.PRICES})),
k AS (SELECT symbol, {_permuted("slot", "last", 7, "symbol")} AS bar_seq FROM (SELECT symbol, last, unnest(range(0, least(30, last))) AS slot FROM (SELECT DISTINCT symbol, last FROM p)))
SELECT p.symbol, p.bar_seq, k.bar_seq IS NOT NULL AS signal FROM p LEFT JOIN k ON k.symbol = p.symbol AND k.bar_seq = p.bar_seq""")
def random_entries(spark, sf_dir):
    return signals.random_entries(fx.prices(spark, sf_dir), 30, 7).select("symbol", "bar_seq", "signal")


def _paths(side: str, entry: str = "next_open", unit: str = "atr", timeout: int = 8) -> str:
    """CTEs up to ``x``: what every bar's entry leads to."""
    s, shift = (1 if side == "long" else -1), (1 if entry == "next_open" else 0)
    best, worst = ("high", "low") if s > 0 else ("low", "high")
    stopped, hit = ("low <= stop", "high >= goal") if s > 0 else ("high >= stop", "low <= goal")
    price = "lead(open) OVER w" if shift else "close"
    return f"""p AS MATERIALIZED ({_TR}), e AS ({_ewm("p", {"atr": ("tr", 14)})}),
c AS (SELECT symbol, bar_seq, bar_seq + {shift} AS ei, {price} AS ep, {"atr" if unit == "atr" else "1.0"} AS unit, max(bar_seq) OVER (PARTITION BY symbol) AS last FROM p JOIN e USING (symbol, bar_seq) WINDOW w AS ({_W})),
d AS (SELECT *, ep - {s} * unit AS stop, ep + {s} * 2 * unit AS goal FROM c WHERE bar_seq < last AND ep > 0 AND unit > 0),
j AS (SELECT d.*, p.bar_seq AS b, {s} * ({best} - ep) / unit AS up, {s} * ({worst} - ep) / unit AS down, CASE WHEN {stopped} THEN 'SL' WHEN {hit} THEN 'TP' WHEN p.bar_seq - ei >= {timeout} THEN 'timeout' WHEN p.bar_seq = last THEN 'eod' END AS reason,
  CASE WHEN {stopped} THEN stop WHEN {hit} THEN goal ELSE close END AS xp FROM d JOIN p ON p.symbol = d.symbol AND p.bar_seq BETWEEN ei AND ei + {timeout}),
x AS MATERIALIZED (SELECT j.symbol, j.bar_seq, exit_seq, {s} * (max(xp) FILTER (b = exit_seq) - any_value(ep)) / any_value(unit) AS r, greatest(0, max(up) FILTER (b <= exit_seq)) AS mfe, least(0, min(down) FILTER (b <= exit_seq)) AS mae,
  exit_seq - any_value(ei) AS bars_held, max(reason) FILTER (b = exit_seq) AS exit_reason FROM j JOIN (SELECT symbol, bar_seq, min(b) AS exit_seq FROM j WHERE reason IS NOT NULL GROUP BY ALL) k USING (symbol, bar_seq) GROUP BY j.symbol, j.bar_seq, exit_seq)"""


def _chain(candidates: str) -> str:
    """A recursive CTE ``t`` over ``candidates`` (symbol, bar_seq, exit_seq): the next one after each exit."""
    return f"""t AS (SELECT symbol, bar_seq, exit_seq FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_seq) AS k FROM {candidates}) WHERE k = 1
  UNION ALL SELECT symbol, bar_seq, exit_seq FROM (SELECT n.*, row_number() OVER (PARTITION BY n.symbol ORDER BY n.bar_seq) AS k FROM t JOIN {candidates} n ON n.symbol = t.symbol AND n.bar_seq > t.exit_seq) WHERE k = 1)"""


def _barrier_sql(side: str, **options) -> str:
    return f"""
WITH RECURSIVE {_paths(side, **options)},
g AS MATERIALIZED (SELECT x.* FROM x JOIN (SELECT symbol, bar_seq, coalesce(count(*) OVER f = 10 AND close > max(high) OVER f, false) AS signal FROM p WINDOW f AS ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) s USING (symbol, bar_seq) WHERE signal),
{_chain("g")}
SELECT g.symbol, g.bar_seq AS trade_seq, {_r("r")} AS r, {_r("mfe")} AS mfe, {_r("mae")} AS mae, bars_held::BIGINT AS bars_held, exit_reason FROM g JOIN t USING (symbol, bar_seq)"""


def _barrier(spark, sf_dir, side, **options):
    bars = signals.donchian(fx.prices(spark, sf_dir), 10)
    return barriers.barrier_trades(bars, side=side, timeout=8, **options).select("symbol", "trade_seq", "r", "mfe", "mae", "bars_held", "exit_reason")


@query(_barrier_sql("long"))
def barrier_trades_long(spark, sf_dir):
    return _barrier(spark, sf_dir, "long")


@query(_barrier_sql("short"))
def barrier_trades_short(spark, sf_dir):
    return _barrier(spark, sf_dir, "short")


@query(_barrier_sql("long", entry="close"))
def barrier_trades_close(spark, sf_dir):
    return _barrier(spark, sf_dir, "long", entry="close")


@query(_barrier_sql("long", unit="price"))
def barrier_trades_price(spark, sf_dir):
    return _barrier(spark, sf_dir, "long", risk_unit="price")


def _simulated(entries: str, timeout: int) -> str:
    """CTEs up to ``z`` (sim, symbol, r): trades at random bars; ``entries`` is a table of symbols and numbers."""
    return f"""{_paths("long", timeout=timeout)}, b AS (SELECT symbol, max(bar_seq) AS last, any_value(n_entries) AS n_entries FROM p JOIN ({entries}) USING (symbol) GROUP BY 1),
k AS (SELECT sim, symbol || '|' || sim AS symbol, {_permuted("slot", "last", 42, "sim", "symbol")} AS bar_seq, symbol AS sym FROM (SELECT s.sim, b.symbol, b.last, unnest(range(0, least(b.n_entries, b.last))) AS slot FROM b CROSS JOIN range({BOOT}) s(sim))),
g AS MATERIALIZED (SELECT k.sim, k.sym, k.symbol, k.bar_seq, x.exit_seq, x.r FROM k JOIN x ON x.symbol = k.sym AND x.bar_seq = k.bar_seq),
{_chain("g")},
z AS (SELECT g.sim, g.sym AS symbol, g.r FROM g JOIN t USING (symbol, bar_seq))"""


@query(f"""
WITH RECURSIVE {_simulated(f"SELECT DISTINCT symbol, 25 AS n_entries FROM ({fx.PRICES})", 8)}
SELECT sim, symbol, {_r("avg(r)")} AS expectancy, count(*) AS n FROM z GROUP BY ALL""")
def random_entry_null(spark, sf_dir):
    return nulls.random_entry_null(fx.prices(spark, sf_dir), n_entries=25, n_sims=BOOT, timeout=8)


_TIMED = f"SELECT segment AS symbol, trade_seq, bars_held AS hold, CASE WHEN trade_seq % 2 = 0 THEN 1.0 ELSE -1.0 END AS direction FROM ({fx.TRADES})"


_TIMING = f"""
WITH q AS (SELECT symbol, bar_seq, close / lag(close) OVER ({_W}) - 1 AS x FROM ({fx.PRICES})),
y AS (SELECT symbol, bar_seq, ln(abs(1 + x - m)) AS y, (1 + x - m < 0)::INT AS neg FROM (SELECT *, avg(x) OVER (PARTITION BY symbol) AS m FROM q WHERE x IS NOT NULL)),
z AS (SELECT symbol, row_number() OVER ({_W}) AS i, count(*) OVER (PARTITION BY symbol) AS m, sum(y) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS p, sum(neg) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS g FROM y),
p AS (SELECT * FROM z UNION ALL SELECT DISTINCT symbol, 0, m, 0.0, 0 FROM z),
s AS (SELECT d.draw, t.symbol, t.direction, least(t.hold, n.m) AS hold, {_u52(42, "d.draw", "t.symbol", "t.trade_seq")} % (n.m - least(t.hold, n.m) + 1) AS at FROM ({_TIMED}) t JOIN (SELECT DISTINCT symbol, m FROM z) n USING (symbol) CROSS JOIN range({BOOT}) d(draw)),
v AS (SELECT draw, avg((exp(b.p - a.p) * CASE WHEN (b.g - a.g) % 2 = 0 THEN 1 ELSE -1 END - 1) * direction) AS mean FROM s JOIN p a ON a.symbol = s.symbol AND a.i = s.at JOIN p b ON b.symbol = s.symbol AND b.i = s.at + s.hold GROUP BY draw)"""


@query(f"{_TIMING} SELECT draw, {_r('mean')} AS mean FROM v")
def timing_null(spark, sf_dir):
    t = fx.trades(spark, sf_dir).select(F.col("segment").alias("symbol"), "trade_seq", F.col("bars_held").alias("hold"), F.when(F.col("trade_seq") % 2 == 0, 1.0).otherwise(-1.0).alias("direction"))
    return nulls.timing_null(fx.prices(spark, sf_dir), t, n_samples=BOOT)


#: Fixed folds over the orders' years; each segment is a setting to choose.
FOLDS = {"is_days": 730, "oos_days": 182, "purge_days": 7, "embargo_days": 14}


def _fold_rows(spark, sf_dir):
    t = fx.trades(spark, sf_dir)
    combos = t.join(F.broadcast(t.select("segment").distinct().withColumn("combo_id", F.row_number().over(Window.orderBy("segment")) - 1)), "segment")
    return combos, walkforward.folds_of(t, **FOLDS)


#: From settings' trades ``t`` up to the choices' folds ``k``.
_WALK = f"""
e AS (SELECT min(entry_date)::TIMESTAMP AS a, max(entry_date)::TIMESTAMP AS b FROM t),
w AS (SELECT 0 AS fold_id, a + INTERVAL 730 DAY AS s FROM e WHERE a + INTERVAL 730 DAY < b UNION ALL SELECT fold_id + 1, s + INTERVAL 182 DAY FROM w, e WHERE s + INTERVAL 182 DAY < b),
f AS (SELECT fold_id, greatest(a, s - INTERVAL 730 DAY) AS is_start, s - INTERVAL 7 DAY AS is_end, s + INTERVAL 14 DAY AS oos_from, least(s + INTERVAL 182 DAY, b) AS oos_end FROM w, e),
i AS (SELECT fold_id, combo_id, count(*) AS is_n, sum(r) AS is_sum, {_score("sqn")} AS is_score FROM t JOIN f ON entry_date >= is_start AND entry_date < is_end AND exit_date < is_end GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY fold_id ORDER BY is_score DESC, combo_id) = 1),
o AS (SELECT fold_id, count(*) AS oos_n, sum(r) AS oos_sum, {_score("sqn")} AS oos_score FROM t JOIN c USING (combo_id) JOIN f USING (fold_id) WHERE entry_date >= oos_from AND entry_date < oos_end GROUP BY ALL),
k AS (SELECT fold_id, combo_id, is_n, is_score, coalesce(oos_n, 0) AS oos_n, coalesce(oos_score, 0.0) AS oos_score, CASE WHEN is_sum <= 0 OR oos_n IS NULL THEN 0.0 ELSE
  (oos_sum / greatest(date_diff('day', oos_from, oos_end) / 365.25, 1e-9)) / (is_sum / greatest(date_diff('day', is_start, is_end) / 365.25, 1e-9)) END AS wfe FROM c JOIN f USING (fold_id) LEFT JOIN o USING (fold_id))"""
_FOLDS = f"""
WITH RECURSIVE t AS (SELECT *, dense_rank() OVER (ORDER BY segment) - 1 AS combo_id FROM ({fx.TRADES})), {_WALK}"""


@query(f"{_FOLDS} SELECT fold_id::BIGINT AS fold_id, combo_id, is_n, {_r('is_score')} AS is_score, oos_n, {_r('oos_score')} AS oos_score, {_r('wfe')} AS wfe FROM k")
def walk_forward_folds(spark, sf_dir):
    return walkforward.fold_table(*_fold_rows(spark, sf_dir)).drop("oos_sqn")


@query(f"{_FOLDS} SELECT fold_id::BIGINT AS fold_id, combo_id, trade_seq, {_r('r')} AS r FROM t JOIN (SELECT fold_id, combo_id FROM c) USING (combo_id) JOIN f USING (fold_id) WHERE entry_date >= oos_from AND entry_date < oos_end")
def walk_forward_stitched(spark, sf_dir):
    t, w = _fold_rows(spark, sf_dir)
    return walkforward.stitched(t, w, walkforward.choices(t, w)).select("fold_id", "combo_id", "trade_seq", "r")


#: Spans of the crossing means that the grid tries.
GRID = {"fast": [2, 3, 5, 8], "slow": [10, 13, 21, 34, 55]}


def _grid_rows(spark, sf_dir):
    bars = fx.prices(spark, sf_dir)
    grid = [(i, p["fast"], p["slow"]) for i, p in enumerate(walkforward.param_grid(GRID))]
    t = walkforward.simulate_crossings(bars, spark.createDataFrame(grid, "combo_id int, fast int, slow int"), timeout=8)
    t = written(t.withColumn("r", F.round("r", 6)), "grid")
    return t, walkforward.folds_of(t, **FOLDS)


_GRID = f"""
WITH RECURSIVE {_paths("long")},
q AS MATERIALIZED (SELECT symbol, bar_seq, sum(close) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS s FROM p),
h AS (SELECT (row_number() OVER ()) - 1 AS combo_id, fast, slow FROM (SELECT unnest({GRID["fast"]}) AS fast), (SELECT unnest({GRID["slow"]}) AS slow) ORDER BY fast, slow),
v AS MATERIALIZED (SELECT q.symbol, q.bar_seq, x.span, CASE WHEN q.bar_seq >= x.span - 1 THEN (q.s - coalesce(b.s, 0)) / x.span END AS mean FROM q CROSS JOIN (SELECT unnest({sorted({*GRID["fast"], *GRID["slow"]})}) AS span) x LEFT JOIN q b ON b.symbol = q.symbol AND b.bar_seq = q.bar_seq - x.span),
g AS MATERIALIZED (SELECT h.combo_id, x.symbol AS sym, x.symbol || '|' || h.combo_id AS symbol, x.bar_seq, x.exit_seq, round(x.r, 6) AS r FROM h JOIN v a ON a.span = h.fast JOIN v b ON b.span = h.slow AND b.symbol = a.symbol AND b.bar_seq = a.bar_seq
  JOIN v c ON c.span = h.fast AND c.symbol = a.symbol AND c.bar_seq = a.bar_seq - 1 JOIN v d ON d.span = h.slow AND d.symbol = a.symbol AND d.bar_seq = a.bar_seq - 1 JOIN x ON x.symbol = a.symbol AND x.bar_seq = a.bar_seq WHERE c.mean <= d.mean AND a.mean > b.mean),
{_chain("g")}
SELECT g.combo_id, g.sym AS symbol, g.bar_seq, g.r, n.ts AS entry_date, m.ts AS exit_date FROM g JOIN t USING (symbol, bar_seq) JOIN p n ON n.symbol = g.sym AND n.bar_seq = g.bar_seq + 1 JOIN p m ON m.symbol = g.sym AND m.bar_seq = g.exit_seq"""


@query(f"WITH RECURSIVE t AS MATERIALIZED (SELECT * FROM ({_GRID})), {_WALK} SELECT fold_id::BIGINT AS fold_id, combo_id, is_n, {_r('is_score')} AS is_score, oos_n, {_r('oos_score')} AS oos_score, {_r('wfe')} AS wfe FROM k")
def walk_forward_grid(spark, sf_dir):
    """Twenty settings of crossing means simulated on the whole series, chosen in sample and judged out of it."""
    return walkforward.fold_table(*_grid_rows(spark, sf_dir)).drop("oos_sqn")


@query(f"""{_FOLDS}, d AS (SELECT count(*) AS n, avg((oos_score > 0)::INT) AS share, avg(oos_score) AS m, coalesce(stddev_samp(oos_score), 0) AS sd, avg(wfe) AS e FROM k)
SELECT n, {_r("share")} AS share_positive, {_r("abs(sd / m)")} AS cv, share >= 0.5 AND abs(sd / m) <= 2 AS passed, {_r("e")} AS mean_wfe, e >= 0.3 AND e <= 1.0 AS wfe_passed, e >= 0.5 AND e <= 0.8 AS on_target FROM d""")
def fold_diagnostics(spark, sf_dir):
    table = walkforward.fold_table(*_fold_rows(spark, sf_dir))
    e = walkforward.efficiency(table).select("mean_wfe", F.col("passed").alias("wfe_passed"), "on_target")
    return walkforward.fold_dispersion(table).join(F.broadcast(e))


_PBO = f"""
WITH h AS MATERIALIZED ({_MONTHLY}), m AS (SELECT dense_rank() OVER (ORDER BY obs_seq) - 1 AS o, variant AS config, coalesce(r, 0.0) AS r FROM (SELECT DISTINCT obs_seq FROM h) CROSS JOIN (SELECT DISTINCT variant FROM h) LEFT JOIN h USING (obs_seq, variant)), n AS (SELECT max(o) + 1 AS t, count(DISTINCT config) AS n FROM m),
b AS (SELECT (o - t % 8) // (t // 8) AS block, config, r FROM m, n WHERE o >= t % 8),
s AS (SELECT row_number() OVER (ORDER BY list_transform(range(8), lambda i: CASE WHEN (k >> i) & 1 = 1 THEN 0 ELSE 1 END)) - 1 AS split_id, k FROM range(256) x(k) WHERE bit_count(k::INT) = 4),
v AS (SELECT split_id, config, (k >> block) & 1 = 1 AS inside, CASE WHEN count(*) < 2 OR stddev_samp(r) <= 1e-9 THEN 0.0 ELSE avg(r) / stddev_samp(r) END AS score FROM b CROSS JOIN s GROUP BY ALL),
w AS (SELECT split_id, config, max(score) FILTER (inside) AS is_score, max(score) FILTER (NOT inside) AS oos_score FROM v GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY split_id ORDER BY is_score DESC, config) AS place, count(*) OVER (PARTITION BY split_id ORDER BY oos_score RANGE UNBOUNDED PRECEDING) AS rank FROM w),
z AS (SELECT split_id, config, is_score, oos_score, rank / (n + 1.0) AS omega FROM q, n WHERE place = 1)"""


def _matrix(spark, sf_dir):
    """Mean R of every month and segment; a month without trades of a segment made nothing there."""
    v = variants(spark, sf_dir)
    grid = v.select("obs_seq").distinct().join(F.broadcast(v.select("variant").distinct()))
    return grid.join(v, ["obs_seq", "variant"], "left").select(F.col("obs_seq").alias("period_seq"), F.col("variant").alias("config"), F.coalesce("r", F.lit(0.0)).alias("ret"))


@query(f"{_PBO} SELECT split_id, config, {_r('is_score')} AS is_score, {_r('oos_score')} AS oos_score, {_r('omega')} AS omega, {_r('ln(omega / (1 - omega))')} AS logit FROM z")
def pbo_splits(spark, sf_dir):
    return overfit.cscv(_matrix(spark, sf_dir), 8)


@query(f"""{_PBO} SELECT {_r("avg((ln(omega / (1 - omega)) < 0)::INT)")} AS pbo, {_r("avg((oos_score < 0)::INT)")} AS prob_oos_loss, {_r("regr_slope(oos_score, is_score)")} AS slope, {_r("regr_r2(oos_score, is_score)")} AS r2, count(*) AS n_splits,
  CASE WHEN avg((ln(omega / (1 - omega)) < 0)::INT) <= 0.1 THEN 'ROBUST' WHEN avg((ln(omega / (1 - omega)) < 0)::INT) <= 0.35 THEN 'GUARDED' ELSE 'OVERFIT' END AS label FROM z""")
def pbo(spark, sf_dir):
    return overfit.pbo(_matrix(spark, sf_dir), 8)


@query(f"SELECT segment AS trial, {_r('CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) ELSE 0.0 END')} AS sharpe FROM ({fx.TRADES}) GROUP BY 1 HAVING count(r) >= 2")
def trial_sharpes(spark, sf_dir):
    return overfit.trial_sharpes(fx.trades(spark, sf_dir).withColumnRenamed("segment", "trial"))


#: What the best of k skill-less trials is worth in their deviations; SQL has no normal quantiles, so they are literals.
_LUCK = "CASE k " + " ".join(f"WHEN {k} THEN {1 - EULER!r} * {NORMAL.inv_cdf(1 - 1 / k)!r} + {EULER!r} * {NORMAL.inv_cdf(1 - 1 / (k * math.e))!r}" for k in range(2, 8)) + " END"


@query(f"""
WITH s AS (SELECT count(*) AS k, stddev_samp(sharpe) AS spread FROM (SELECT segment, CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) ELSE 0.0 END AS sharpe FROM ({fx.TRADES}) GROUP BY 1 HAVING count(r) >= 2)),
c AS (SELECT r, r - avg(r) OVER () AS d FROM ({fx.TRADES})),
m AS (SELECT count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd, avg(d * d * d) / power(avg(d * d), 1.5) AS skew, avg(d * d * d * d) / power(avg(d * d), 2) AS kurt FROM c),
e AS (SELECT *, mean / sd AS sharpe, spread * ({_LUCK}) AS luck FROM s, m),
z AS (SELECT *, greatest(-9, least(9, (sharpe - luck) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe))) AS z FROM e),
p AS (SELECT 0.5 + sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z * i / 2000, 2) / 2)) * any_value(z) / 6000 / sqrt(2 * pi()) AS psr FROM z, range(2001) x(i))
SELECT {_r("sharpe")} AS sharpe, {_r("luck")} AS benchmark, {_r("psr")} AS psr, CASE WHEN psr >= 0.95 THEN 'SIGNIFICANT' WHEN psr >= 0.90 THEN 'MARGINAL' ELSE 'NOT SIGNIFICANT' END AS label,
  {_r("mean")} AS expectancy, {_r("sd * luck")} AS haircut, {_r("mean - sd * luck")} AS deflated, k AS n_trials FROM z, p""")
def deflated(spark, sf_dir):
    """Deflated Sharpe ratio and expectancy of the whole book, its segments the trials; SQL integrates the normal density."""
    t = fx.trades(spark, sf_dir)
    trials = t.withColumnRenamed("segment", "trial")
    s, e = overfit.deflated_sharpe(overfit.trial_sharpes(trials), t), overfit.deflated_expectancy(t, trials)
    return spark.createDataFrame([(s.sharpe, s.benchmark, s.psr, s.label, e.expectancy, e.haircut, e.deflated, e.n_trials)], "sharpe double, benchmark double, psr double, label string, expectancy double, haircut double, deflated double, n_trials long")


def _gates(*rows: str) -> str:
    """Check rows of gates, each a SELECT of (gate_ord, gate, check_ord, name, passed, value, threshold, hard)."""
    first = "SELECT NULL::BIGINT AS gate_ord, NULL AS gate, NULL::BIGINT AS check_ord, NULL AS name, NULL::BOOLEAN AS passed, NULL::DOUBLE AS value, NULL::DOUBLE AS threshold, NULL::BOOLEAN AS hard WHERE false"
    return " UNION ALL ".join([first, *rows])


_DISPERSED = f"SELECT 2, 'DURABLE', 2, 'fold_dispersion', passed, cv, 2.0, true FROM ({SQL['fold_diagnostics']})"
_GAUNTLET = _gates(
    f"SELECT 0, 'REAL', 0, 'permutation', p < 0.05, {_r('p')}, 0.05, true FROM (SELECT 1 - power(1 - round(p_value * {DRAWS + 1}) / {DRAWS + 1}, 5) AS p FROM ({SQL['sign_permutation']}))",
    "SELECT 0, 'REAL', 1, 'random_timing', false, NULL, NULL, false",
    f"SELECT 1, 'STRONG', o, metric || '_low', ci_low > bar, ci_low, bar, hard FROM ({SQL['bootstrap_metric_cis']}) JOIN (VALUES ('expectancy', 0, 0.0, true), ('profit_factor', 1, 1.25, true), ('sqn', 2, 1.6, false)) x(metric, o, bar, hard) USING (metric)",
    f"SELECT 2, 'DURABLE', 0, 'wfe', wfe_passed, mean_wfe, 0.3, true FROM ({SQL['fold_diagnostics']})",
    f"SELECT 2, 'DURABLE', 1, 'wfe_target', on_target, mean_wfe, 0.5, false FROM ({SQL['fold_diagnostics']})",
    _DISPERSED,
    f"SELECT 3, 'GENERAL', 0, 'markets', p_value < 0.05, p_value, 0.05, true FROM ({SQL['whites_reality_check']})",
)
_CHECK = ["gate_ord", "gate", "check_ord", "name", "passed", "value", "threshold", "hard"]


def _gauntlet(spark, sf_dir):
    t = gates.Thresholds(n_boot=DRAWS, n_perm=DRAWS)
    return gates.run_gauntlet(fx.weekly(spark, sf_dir), folds=walkforward.fold_table(*_fold_rows(spark, sf_dir)), markets=variants(spark, sf_dir), n_variants=5, t=t)


@query(_GAUNTLET)
def gauntlet_checks(spark, sf_dir):
    """All gates on the weekly series, one of five variants, with segments as markets."""
    return _gauntlet(spark, sf_dir).select(*_CHECK)


@query(f"""
WITH g AS (SELECT gate_ord, gate, coalesce(bool_and(passed) FILTER (hard), false) AS passed FROM ({_GAUNTLET}) GROUP BY ALL)
SELECT bool_and(passed) AS passed, coalesce(string_agg(gate, ',' ORDER BY gate_ord) FILTER (NOT passed), '') AS failed_gates FROM g""")
def gauntlet_verdict(spark, sf_dir):
    return gates.gauntlet_verdict(_gauntlet(spark, sf_dir))


@query(_gates(
    f"SELECT 0, 'REAL', 0, 'permutation', p_value < 0.05, p_value, 0.05, true FROM ({SQL['sign_permutation'].replace(fx.WEEKLY, fx.TRADES)})",
    f"SELECT 0, 'REAL', 1, 'random_timing', point > bar, {_r('point')}, {_r('bar')}, true FROM (SELECT avg(r) AS point FROM ({fx.TRADES})), ({_TIMING} SELECT quantile_cont(mean, 0.95) AS bar FROM v)",
))
def gate_real_detrended(spark, sf_dir):
    """The trades against random signs, and against the same holdings at random times of detrended prices."""
    t = fx.trades(spark, sf_dir).withColumns({"symbol": F.col("segment"), "direction": F.when(F.col("trade_seq") % 2 == 0, 1.0).otherwise(-1.0)})
    return gates.gate_real(t, bars=fx.prices(spark, sf_dir), null="detrended", t=gates.Thresholds(n_perm=DRAWS, n_sims=BOOT)).select(*_CHECK)


def _chart(spark, sf_dir):
    """The trades of breakouts on the weekly prices, numbered over all symbols."""
    t = _barrier(spark, sf_dir, "long")
    return t.withColumns({"r": F.round("r", 6), "trade_seq": F.col("trade_seq") * 10 + F.substring("symbol", 1, 1).cast("bigint")})


_CHART = f"SELECT symbol, r, trade_seq * 10 + left(symbol, 1)::BIGINT AS trade_seq FROM ({_barrier_sql('long')})"


def _luck(entries: str, timeout: int, wins: str) -> str:
    """The check of timing against random entries, all symbols of a simulation together."""
    return f"""SELECT 0, 'REAL', 1, 'random_timing', point > bar, {_r('point')}, {_r('bar')}, true FROM (SELECT avg(r) AS point FROM ({wins})),
    (SELECT quantile_cont(m, 0.95) AS bar FROM (WITH RECURSIVE {_simulated(entries, timeout)} SELECT sim, avg(r) AS m FROM z GROUP BY sim))"""


@query(_gates(
    f"SELECT 0, 'REAL', 0, 'permutation', p_value < 0.05, p_value, 0.05, true FROM ({SQL['sign_permutation'].replace(fx.WEEKLY, _CHART)})",
    _luck(f"SELECT symbol, count(*) AS n_entries FROM ({_CHART}) GROUP BY 1", 8, _CHART),
))
def gate_real_random_entry(spark, sf_dir):
    """Breakout trades against random signs, and against as many random entries in each symbol, held as long."""
    return gates.gate_real(_chart(spark, sf_dir), bars=fx.prices(spark, sf_dir), hold=8, t=gates.Thresholds(n_perm=DRAWS, n_sims=BOOT)).select(*_CHECK)


_RATIO = f"({_FOLDS} SELECT avg(oos_score / is_score) FILTER (is_score <> 0) AS m FROM k)"


@query(_gates(
    f"SELECT 2, 'DURABLE', 0, 'sqn_ratio', coalesce(m > 0.5, false), {_r('m')}, 0.5, true FROM {_RATIO}",
    f"SELECT 2, 'DURABLE', 1, 'sqn_ratio_high', coalesce(m <= 2, false), {_r('m')}, 2.0, false FROM {_RATIO}",
    _DISPERSED,
))
def gate_durable_sqn(spark, sf_dir):
    return gates.gate_durable(walkforward.fold_table(*_fold_rows(spark, sf_dir)), wfe="sqn").select(*_CHECK)


_EVENTS = f"""
WITH g AS (SELECT segment || '/' || exit_reason AS params, avg(r) AS score, min(entry_date) AS ts, exit_reason, count(*) AS k FROM ({fx.TRADES}) GROUP BY ALL),
e AS (SELECT 'entry' AS event, params, score, ts, 1 AS n FROM g UNION ALL SELECT 'entry', params, score - 0.01, ts, 2 FROM g WHERE k % 2 = 0 UNION ALL SELECT 'select', params, score, ts, 3 FROM g WHERE exit_reason = 'TP'),
c AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY params ORDER BY n DESC) <= (SELECT count(*) FROM e s WHERE s.event = 'select' AND s.params = e.params) THEN 'selected' ELSE 'tried' END AS status FROM e WHERE event = 'entry')"""


def _events(spark, sf_dir):
    """A search's ledger: each segment and exit reason was tried, every other one twice, and winners were selected."""
    g = fx.trades(spark, sf_dir).groupBy(F.concat_ws("/", "segment", "exit_reason").alias("params"), "exit_reason").agg(F.avg("r").alias("score"), F.min("entry_date").alias("ts"), F.count("*").alias("k"))
    event = lambda kind, score, n: (F.lit(kind).alias("event"), "params", score.alias("score"), "ts", F.lit(n).alias("n"), F.lit("tried").alias("status"))
    s = F.col("score")
    return g.select(*event("entry", s, 1)).union(g.where("k % 2 = 0").select(*event("entry", s - 0.01, 2))).union(g.where("exit_reason = 'TP'").select(*event("select", s, 3)))


@query(f"{_EVENTS} SELECT params, n::BIGINT AS n, {_r('score')} AS score, status FROM c")
def ledger_entries(spark, sf_dir):
    return search.current_entries(_events(spark, sf_dir)).select("params", "n", "score", "status")


@query(f"{_EVENTS} SELECT params, n::BIGINT AS n, {_r('score')} AS score, status FROM c ORDER BY c.score DESC, ts, c.n LIMIT 1")
def ledger_best(spark, sf_dir):
    return search.best_entry(search.current_entries(_events(spark, sf_dir))).select("params", "n", "score", "status")


@query(f"""
WITH RECURSIVE b AS (SELECT avg(r) AS m, stddev_samp(r) AS sd, count(*) AS n, count(*) * 365.25 / ((epoch_us(max(entry_date)) - epoch_us(min(entry_date))) / 86400000000.0) AS rate FROM ({fx.TRADES})),
d AS (SELECT *, m / sd AS delta, m / sd / 2 AS drift, 2 * power(m / sd / 2, 2) * rate * 25 AS c FROM b),
newton AS (SELECT 0 AS i, c, ln(1 + c) + 5 AS y FROM d UNION ALL SELECT i + 1, c, y - (exp(y) - 1 - y - c) / (exp(y) - 1) FROM newton WHERE i < 60),
h AS (SELECT d.*, y, y / (2 * drift) - 1.166 AS h FROM d, newton WHERE i = 60)
SELECT {_r("m")} AS expectancy, {_r("sd")} AS sigma, n AS n_trades, {_r("rate")} AS trades_per_year, {_r("m / 2")} AS k, {_r("drift")} AS k_std, {_r("h")} AS h, {_r("delta")} AS delta,
  {_r("rate * 25 / 1000")} AS arl0_thousands, {_r("(exp(-y) + y - 1) / (2 * drift * drift)")} AS arl1 FROM h""")
def monitor_design(spark, sf_dir):
    """The baseline that a book freezes and the detector designed for it; one false alarm in 25 years."""
    b = monitor.baseline(fx.trades(spark, sf_dir))
    d = cusum_design(b)
    return spark.createDataFrame([(b.expectancy, b.sigma, b.n_trades, b.trades_per_year, d.k, d.k_std, d.h, d.delta, d.arl0 / 1000, d.arl1)], "expectancy double, sigma double, n_trades long, trades_per_year double, k double, k_std double, h double, delta double, arl0_thousands double, arl1 double")


_CUSUM = f"""SELECT *, c - least(0, min(c) OVER (PARTITION BY segment ORDER BY trade_seq)) AS cusum FROM (
  SELECT segment, trade_seq, r, entry_date, sum(({DESIGN.k!r} - r) / {DESIGN.sigma!r}) OVER (PARTITION BY segment ORDER BY trade_seq) AS c FROM ({fx.TRADES}))"""


@query(f"SELECT segment, trade_seq, {_r('cusum')} AS cusum, {_r('CASE WHEN count(*) OVER w = 30 THEN avg(r) OVER w END')} AS rolling FROM ({_CUSUM}) WINDOW w AS (PARTITION BY segment ORDER BY trade_seq ROWS 29 PRECEDING)")
def cusum_and_rolling(spark, sf_dir):
    t = monitor.cusum_path(fx.trades(spark, sf_dir), DESIGN.k, DESIGN.sigma, by=["segment"])
    return monitor.rolling_expectancy(t, 30, by=["segment"]).select("segment", "trade_seq", "cusum", "rolling")


@query(f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY trade_seq) AS i FROM ({_CUSUM})),
g AS (SELECT segment, count(*) AS n, arg_max(cusum, i) AS cusum, max(cusum) AS peak, min(i) FILTER (cusum > {DESIGN.h!r}) AS alarm, (epoch_us(max(entry_date)) - epoch_us(min(entry_date))) / 86400000000.0 AS days FROM c GROUP BY 1),
l AS (SELECT c.segment, avg(r) / {BASE.expectancy!r} AS rolling_ratio FROM c JOIN g USING (segment) WHERE i > n - 30 GROUP BY 1 HAVING count(*) = 30),
f AS (SELECT g.*, rolling_ratio, n * 365.25 / days / {BASE.trades_per_year!r} AS rate_ratio FROM g LEFT JOIN l USING (segment))
SELECT segment, n, {_r("cusum")} AS cusum, {_r("peak")} AS peak, coalesce(alarm, 0) AS alarm_at, {_r("rolling_ratio")} AS rolling_ratio, {_r("rate_ratio")} AS rate_ratio, {_r(f"cusum / {DESIGN.h!r}")} AS share_of_threshold,
  CASE WHEN alarm IS NOT NULL THEN 'DEGRADED' WHEN rolling_ratio < 0.5 OR rate_ratio < 0.6 THEN 'SLIPPING' ELSE 'HOLDING' END AS label,
  array_to_string(list_filter([CASE WHEN alarm IS NOT NULL THEN 'cusum' END, CASE WHEN rolling_ratio < 0.5 THEN 'rolling' END, CASE WHEN rate_ratio < 0.6 THEN 'rate' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f""")
def edge_monitor(spark, sf_dir):
    return monitor.edge_monitor(fx.trades(spark, sf_dir), BASE, design=DESIGN, by=["segment"]).fillna(0, ["alarm_at"])


@query(f"""
WITH b AS (SELECT r, row_number() OVER (ORDER BY trade_seq) - 1 AS i, count(*) OVER () AS n, avg(r) OVER () AS m FROM ({fx.WEEKLY})),
s AS (SELECT sim, t, {_u52(42, "'arl'", "sim", "t")} % (SELECT count(*) FROM b) AS i FROM range(200) x(sim) CROSS JOIN range(1, 2001) y(t)),
c AS (SELECT sim, t, sum(({DESIGN.k!r} - (r - m)) / {DESIGN.sigma!r}) OVER (PARTITION BY sim ORDER BY t) AS c FROM s JOIN b USING (i)),
l AS (SELECT sim, min(t) FILTER (level > {DESIGN.h!r}) AS length FROM (SELECT sim, t, c - least(0, min(c) OVER (PARTITION BY sim ORDER BY t)) AS level FROM c) GROUP BY sim)
SELECT {_r("avg(coalesce(length, 2000))")} AS mean, {_r("median(coalesce(length, 2000))")} AS median, {_r(f"avg(coalesce(length, 2000)) / {DESIGN.arl1!r}")} AS inflation, count(*) FILTER (length IS NULL) AS censored FROM l""")
def empirical_arl(spark, sf_dir):
    """Simulated run lengths of the detector on the weekly series."""
    return monitor.empirical_arl(fx.weekly(spark, sf_dir), DESIGN, n_sims=200, max_run=2000)


_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(f"SELECT count(*) AS n, {_r('corr(a, b)')} AS ic FROM (SELECT {_RANK.format(c='score')} AS a, {_RANK.format(c='label')} AS b FROM ({fx.PREDICTIONS}))")
def information_coefficient(spark, sf_dir):
    return scores.information_coefficient(fx.predictions(spark, sf_dir))


@query(f"""SELECT greatest(1, ceil((i - 1) * 5 / (n - 1)))::BIGINT AS bucket, {_r("avg((label > 0)::INT)")} AS win_rate, {_r("avg(score)")} AS avg_score, count(*) AS n FROM (
  SELECT *, row_number() OVER (ORDER BY score, row_seq) AS i, count(*) OVER () AS n FROM ({fx.PREDICTIONS})) GROUP BY 1""")
def quantile_decay(spark, sf_dir):
    return scores.quantile_decay(fx.predictions(spark, sf_dir))


_FEATURES = "SELECT o_orderpriority AS grp, o_orderkey AS row_seq, o_totalprice::DOUBLE AS target, (o_totalprice + o_orderkey % 1000 * 100)::DOUBLE AS f1, (o_totalprice + o_orderkey % 1000 * 100 + 5)::DOUBLE AS f2, (o_custkey % 97)::DOUBLE AS f3, (o_orderkey % 2)::DOUBLE AS f4 FROM orders"
_NAMES = ["f1", "f2", "f3", "f4"]


def _features(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    return fx.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), k.alias("row_seq"), p.alias("target"), (p + k % 1000 * 100).alias("f1"), (p + k % 1000 * 100 + 5).alias("f2"), (F.col("o_custkey") % 97).cast("double").alias("f3"), (k % 2).cast("double").alias("f4"))


@query(f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY row_seq) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM ({_FEATURES})),
u AS (UNPIVOT (SELECT grp, ((i + 1) * 5 - 1) // n AS fold, target, f1, f2, f3, f4 FROM p WHERE n >= 40) ON f1, f2, f3, f4 INTO NAME feature VALUE value),
r AS (SELECT grp, fold, feature, value, rank() OVER (PARTITION BY grp, fold, feature ORDER BY value) + (count(*) OVER (PARTITION BY grp, fold, feature, value) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY grp, fold, feature ORDER BY target) + (count(*) OVER (PARTITION BY grp, fold, feature, target) - 1) / 2.0 AS b, count(*) OVER (PARTITION BY grp, fold, feature) AS k FROM u),
c AS (SELECT feature, corr(a, b) AS ic FROM r WHERE k >= 10 GROUP BY grp, fold, feature HAVING count(DISTINCT value) >= 2)
SELECT feature, {_r("avg(ic)")} AS mean_ic, {_r("abs(avg(ic))")} AS abs_ic, {_r("stddev_pop(ic)")} AS std_ic, count(*) AS n_folds, {_r("avg(ic) / stddev_pop(ic)")} AS ratio FROM c GROUP BY feature""")
def fold_ic(spark, sf_dir):
    return scores.fold_ic(_features(spark, sf_dir), _NAMES, "target", group="grp", order="row_seq")


@query(f"""
WITH RECURSIVE u AS (UNPIVOT (SELECT row_seq, f1, f2, f3 FROM ({_FEATURES})) ON f1, f2, f3 INTO NAME feature VALUE value),
k AS (SELECT row_seq, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS x FROM u),
e AS (SELECT a.feature AS a, b.feature AS b FROM k a JOIN k b ON a.row_seq = b.row_seq AND a.feature < b.feature GROUP BY ALL HAVING abs(corr(a.x, b.x)) >= 0.85),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), g AS (SELECT a AS root, a AS f FROM s UNION SELECT g.root, s.b FROM g JOIN s ON s.a = g.f),
m AS (SELECT f AS feature, min(root) AS first FROM g GROUP BY f), i AS (SELECT m.*, round(abs_ic, 4) AS abs_ic FROM m LEFT JOIN ({SQL["fold_ic"]}) USING (feature))
SELECT (dense_rank() OVER (ORDER BY first) - 1)::BIGINT AS component, feature, {_r("abs_ic")} AS abs_ic, CASE WHEN row_number() OVER (PARTITION BY first ORDER BY coalesce(abs_ic, -1) DESC, feature) = 1 THEN 'KEEP' ELSE 'DROP' END AS action FROM i""")
def redundancy_droplist(spark, sf_dir):
    return scores.droplist(_features(spark, sf_dir), _NAMES, "target", group="grp", order="row_seq")


@query(f"""
WITH c AS (SELECT segment AS a, exit_reason AS b, count(*) AS o FROM ({fx.TRADES}) GROUP BY ALL), n AS (SELECT sum(o) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM c),
e AS (SELECT a.a, b.b, a.s * b.s / n AS e FROM (SELECT a, sum(o) AS s FROM c GROUP BY 1) a CROSS JOIN (SELECT b, sum(o) AS s FROM c GROUP BY 1) b, n)
SELECT {_r("sqrt(sum(power(coalesce(o, 0) - e, 2) / e) / any_value(n) / (least(any_value(r), any_value(k)) - 1))")} AS v FROM e LEFT JOIN c USING (a, b), n""")
def cramers_v(spark, sf_dir):
    return scores.cramers_v(fx.trades(spark, sf_dir), "segment", "exit_reason")


@query(f"""
WITH p AS ({fx.PANEL}), f AS (SELECT * FROM p WHERE ts IN (SELECT ts FROM p GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT asset) FROM p))),
c AS (SELECT a.asset AS a, b.asset AS b, corr(a.ret, b.ret) AS rho FROM f a JOIN f b USING (ts) GROUP BY ALL), s AS (SELECT count(DISTINCT a) AS n, sum(rho * rho) AS s FROM c)
SELECT n AS n_assets, {_r("n * n / s")} AS n_eff, {_r("s / n")} AS redundancy FROM s""")
def effective_n(spark, sf_dir):
    return scores.effective_n(fx.panel(spark, sf_dir))


_RAN = "ORDER BY exit_date, trade_seq ROWS UNBOUNDED PRECEDING"


@query(f"""SELECT segment, trade_seq, {_r("cum_r")} AS cum_r, {_r("cum_r - max(cum_r) OVER (PARTITION BY segment " + _RAN + ")")} AS drawdown FROM (SELECT *, sum(r) OVER (PARTITION BY segment {_RAN}) AS cum_r FROM ({fx.TRADES}))""")
def drawdown(spark, sf_dir):
    return panels.drawdown(fx.trades(spark, sf_dir), ["segment"]).select("segment", "trade_seq", "cum_r", "drawdown")


def _pixels(rows: str, values: list[str], pixels: int) -> str:
    """The SQL of ``panels.curve`` over rows with their place ``spot``."""
    parts = ", ".join(f"{_r(f'arg_min({v}, spot)')} AS {v}_first, {_r(f'arg_max({v}, spot)')} AS {v}_last, {_r(f'min({v})')} AS {v}_low, {_r(f'max({v})')} AS {v}_high" for v in values)
    return f"SELECT floor((spot - 1) * {pixels} / greatest(total, {pixels}))::BIGINT AS pixel, count(*) AS n, {parts} FROM (SELECT *, max(spot) OVER () AS total FROM ({rows})) GROUP BY 1"


@query(_pixels(f"SELECT spot, cum_r, cum_r - max(cum_r) OVER (ORDER BY spot) AS drawdown FROM (SELECT row_number() OVER (ORDER BY exit_date, trade_seq) AS spot, sum(r) OVER ({_RAN}) AS cum_r FROM ({fx.TRADES}))", ["cum_r", "drawdown"], 100))
def r_curve(spark, sf_dir):
    """Cumulative R and drawdown of all trades by pixel, with their true extremes."""
    return panels.r_curve(fx.trades(spark, sf_dir), 100)


@query(f"""
WITH t AS (SELECT mfe AS up, -mae AS down, r FROM ({fx.TRADES})), e AS (SELECT greatest(quantile_cont(up, 0.99), 1.0) AS u, greatest(quantile_cont(down, 0.99), 1.0) AS d FROM t)
SELECT greatest(0, least(39, floor(down / d * 40)))::BIGINT AS mae_bin, greatest(0, least(39, floor(up / u * 40)))::BIGINT AS mfe_bin, r > 0 AS won, count(*) AS n, count(*) FILTER (up > u OR down > d) AS over FROM t, e GROUP BY ALL""")
def excursion_bins(spark, sf_dir):
    return panels.excursion_bins(fx.trades(spark, sf_dir))


@query(f"""
WITH m AS (SELECT draw, avg(r) AS x FROM {_draws(fx.WEEKLY, DRAWS)} GROUP BY draw), e AS (SELECT min(x) AS a, (max(x) - min(x)) / 20 AS w FROM m)
SELECT least(19, floor((x - a) / w))::BIGINT AS bin, {_r("any_value(a) + bin * any_value(w)")} AS lo, {_r("any_value(a) + (bin + 1) * any_value(w)")} AS hi, count(*) AS n FROM m, e GROUP BY 1""")
def bootstrap_bins(spark, sf_dir):
    return panels.bootstrap_bins(fx.weekly(spark, sf_dir), bins=20, n_boot=DRAWS)


_BLOCKS = SQL["block_bootstrap_circular"]
_JUDGED = "CASE WHEN ci_low > 0 THEN 'holds' WHEN observed > 0 THEN 'straddles zero' ELSE 'fails' END AS verdict"


@query(f"""
SELECT 'blocks' AS series, 6 AS block, observed AS point, ci_low, ci_high, p_value, {_JUDGED} FROM ({_BLOCKS})
UNION ALL SELECT 'single', 1, observed, ci_low, ci_high, p_value, {_JUDGED} FROM ({_BLOCKS.replace('b.i // 6', 'b.i // 1').replace('b.i % 6', 'b.i % 1')})""")
def block_panel(spark, sf_dir):
    return panels.block_panel(fx.weekly(spark, sf_dir), n_boot=DRAWS, order="trade_seq")


@query(f"""WITH z AS ({_pixels(f"SELECT row_number() OVER (ORDER BY trade_seq) AS spot, c - least(0, min(c) OVER (ORDER BY trade_seq)) AS cusum, CASE WHEN count(*) OVER v = 30 THEN avg(r) OVER v END AS rolling FROM (SELECT trade_seq, r, sum(({DESIGN.k!r} - r) / {DESIGN.sigma!r}) OVER (ORDER BY trade_seq) AS c FROM ({fx.TRADES})) WINDOW v AS (ORDER BY trade_seq ROWS 29 PRECEDING)", ["cusum", "rolling"], 100)})
SELECT * FROM z""")
def monitor_curve(spark, sf_dir):
    """CUSUM and rolling mean of the whole book by pixel."""
    return monitor.monitor_curve(fx.trades(spark, sf_dir), BASE, design=DESIGN, pixels=100).drop("alarm_at")


@query(f"""SELECT segment, exit_reason AS reason, exit_reason AS label, count(*) AS n, {_r("sum(r)")} AS sum_r, {_r("avg(r)")} AS avg_r, {_r("avg((r > 0)::INT)")} AS win_rate FROM ({fx.TRADES}) GROUP BY ALL""")
def exit_reasons(spark, sf_dir):
    return panels.exit_reasons(fx.trades(spark, sf_dir), ["segment"])


@query(f"SELECT r > 0 AS won, count(*) AS n, {_r('median(bars_held)')} AS median_bars FROM ({fx.TRADES}) GROUP BY 1")
def holding_medians(spark, sf_dir):
    return panels.holding_medians(fx.trades(spark, sf_dir))


@query(f"SELECT least(19, floor((greatest(-1, least(1, r / mfe)) + 1) / 2 * 20))::BIGINT AS bin, count(*) AS n FROM ({fx.TRADES}) WHERE mfe > 1e-9 GROUP BY 1")
def exit_efficiency_bins(spark, sf_dir):
    return panels.efficiency_bins(fx.trades(spark, sf_dir))


@query(f"""
WITH t AS ({fx.TRADES}), e AS (SELECT greatest(quantile_cont(r, 0.99), 5.0) AS b, least(min(r), -3.0) AS a FROM t)
SELECT least(39, floor((least(r, b) - a) / ((b - a) / 40)))::BIGINT AS bin, {_r("any_value(a) + bin * any_value((b - a) / 40)")} AS lo, {_r("any_value(a) + (bin + 1) * any_value((b - a) / 40)")} AS hi, count(*) AS n, count(*) FILTER (r > b) AS overflow FROM t, e GROUP BY 1""")
def r_histogram(spark, sf_dir):
    return panels.r_histogram(fx.trades(spark, sf_dir))


@query(f"SELECT trade_seq, {_r('sum(r) OVER w')} AS net, {_r('sum(r + cost_r) OVER w')} AS gross FROM ({fx.TRADES}) WINDOW w AS ({_RAN})")
def gross_net(spark, sf_dir):
    return panels.gross_net(fx.trades(spark, sf_dir)).select("trade_seq", "net", "gross")


@query(f"""
WITH e AS (SELECT entry_date AS t, 1 AS step FROM ({fx.TRADES}) UNION ALL SELECT exit_date, -1 FROM ({fx.TRADES})), m AS (SELECT t, sum(step) AS net, count(*) FILTER (step > 0) AS entries FROM e GROUP BY t)
SELECT t, (sum(net) OVER w)::BIGINT AS open, (sum(net) OVER w - net + entries)::BIGINT AS peak FROM m WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)""")
def concurrency(spark, sf_dir):
    return panels.concurrency(fx.trades(spark, sf_dir))


_HORIZONS = " UNION ALL ".join(
    f"SELECT {k} AS k, greatest(0, (max(high) OVER f - lead(open) OVER w) / atr) AS up, least(0, (min(low) OVER f - lead(open) OVER w) / atr) AS down, count(*) OVER f = {k} AS whole, signal FROM s WINDOW f AS ({_W} ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING), w AS ({_W})"
    for k in range(1, 11)
)


@query(f"""
WITH RECURSIVE p AS MATERIALIZED ({_TR}), e AS ({_ewm("p", {"atr": ("tr", 14)})}),
s AS MATERIALIZED (SELECT p.*, atr, coalesce(count(*) OVER f = 10 AND close > max(high) OVER f, false) AS signal FROM p JOIN e USING (symbol, bar_seq) WINDOW f AS ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT k::BIGINT AS k, {_r("CASE WHEN avg(down) = 0 THEN 'inf'::DOUBLE ELSE avg(up) / abs(avg(down)) END")} AS ratio, count(*) AS n FROM ({_HORIZONS}) WHERE whole AND signal GROUP BY k""")
def edge_ratio_curve(spark, sf_dir):
    bars = signals.donchian(fx.prices(spark, sf_dir), 10)
    return panels.edge_ratio_curve(barriers.excursions(bars, horizons=10))


@query(f"SELECT 'segment' AS dimension, segment, n, point, ci_low, ci_high, verdict FROM ({_verdict(fx.TRADES, BOOT, 'segment', 0.10)})")
def segment_forest(spark, sf_dir):
    return panels.segment_forest(fx.trades(spark, sf_dir), ["segment"], n_boot=BOOT)


@query(f"SELECT label > 0 AS won, count(*) AS n, {', '.join(f'''{_r(f'quantile_cont(score, {q})')} AS q{round(100 * q):02d}''' for q in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM ({fx.PREDICTIONS}) GROUP BY 1")
def score_quantiles(spark, sf_dir):
    return panels.score_quantiles(fx.predictions(spark, sf_dir))
