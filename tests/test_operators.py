import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from edgewright.functions import rng, scalars
from edgewright.operators import barriers, gates, metrics, monitor, overfit, panels, render, resample, scores, search, signals, splits, walkforward
from edgewright.schema import from_arrays, from_frame, trade_log
from edgewright.sources import files


def log(spark, r, **columns):
    return from_arrays(spark, r, **columns)


def one(df):
    return df.first().asDict()


def test_trade_log_names_the_missing_column(spark):
    with pytest.raises(ValueError, match="rename"):
        trade_log(spark.range(1))


def test_from_frame_keeps_r_of_the_mapping(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert one(from_frame(df, r_col="b", mapping={"a": "r"}))["r"] == 1.0
    assert one(from_frame(df, r_col="b"))["r"] == 2.0


def test_metrics_of_a_small_book(spark):
    got = one(metrics.edge_report(log(spark, [2.0, -1.0, 2.0, -1.0, float("nan")])))
    assert (got["n"], got["win_rate"], got["expectancy"], got["profit_factor"], got["payoff_ratio"]) == (4, 0.5, 0.5, 2.0, 2.0)


def test_metrics_without_losers_or_trades(spark):
    got = one(metrics.edge_report(log(spark, [1.0, 1.0])))
    assert got["profit_factor"] == math.inf and got["payoff_ratio"] == math.inf and got["sqn"] == 0
    empty = one(metrics.edge_report(log(spark, [1.0]).where("r > 5")))
    assert (empty["n"], empty["expectancy"], empty["profit_factor"]) == (0, 0, 0)


def test_excursions_and_text(spark):
    t = log(spark, [1.0, -1.0], mfe=[2.0, 0.5], mae=[-0.5, -1.0], bars_held=[4, 2])
    row = metrics.flags(metrics.edge_report(t)).first()
    assert row.excursion_ratio == pytest.approx(2.5 / 1.5) and row.time_asymmetry == 2 and row.exit_efficiency == 0.5
    assert "PASS" in metrics.report_text(row)


def test_calibration_omits_empty_bins(spark):
    got = metrics.calibration(log(spark, [1.0, -1.0, 1.0], prob=[0.5, 0.55, 0.95])).orderBy("bin").collect()
    assert [(r.bin, r.trades, r.win_rate) for r in got] == [(1, 2, 0.5), (4, 1, 1.0)]


def test_draws_do_not_depend_on_partitions(spark):
    t = log(spark, [0.5, -1.0, 2.0, 0.1, -0.3])
    a, b = (one(resample.reality_check(x, n_boot=50)) for x in (t, t.repartition(3)))
    assert a == b


def test_multinomial_draws_follow_the_law_of_folded_ones(spark, monkeypatch):
    r = [((7 * i) % 11) - 4.5 + (i % 3) / 7 for i in range(60)]
    t = log(spark, r).withColumn("market", F.when(F.col("trade_seq") < 45, "a").otherwise("b"))
    monkeypatch.setattr(resample, "RANGE_ROWS", 7)
    names = ("expectancy", "win_rate", "sqn")
    for by in ([], ["market"]):
        ask = lambda df: resample.multinomial_draws(df, 3000, 5, names, by=by)
        drawn = ask(t).toPandas()
        again = ask(t.repartition(5)).toPandas()
        keys = [*by, "draw"]
        a, b = (x.sort_values(keys)[list(names)].to_numpy() for x in (drawn, again))
        assert a == pytest.approx(b)  # partitions change no more than the order of sums
        folded = resample.draws(resample.book(t, by), 3000, 5, names, by).toPandas()
        assert len(drawn) == len(folded)
        for group in ("a", "b") if by else (None,):
            x, y = (d[d["market"] == group] if by else d for d in (drawn, folded))
            own = [v for i, v in enumerate(r) if group is None or (i < 45) == (group == "a")]
            assert x["expectancy"].mean() == pytest.approx(sum(own) / len(own), abs=0.06)
            for m in names:
                for q in (0.05, 0.25, 0.5, 0.75, 0.95):
                    assert x[m].quantile(q) == pytest.approx(y[m].quantile(q), abs=0.15 * y[m].std() + (1.01 / len(own) if m == "win_rate" else 0))


def test_ranges_share_a_draw_without_remainder():
    for n, width in ((60, 7), (7, 7), (1000, 3)):
        shares = [resample._taken(n, at, width, 64, 10, 1) for at in range(-(-n // width))]
        assert (sum(shares) == n).all() and all((x >= 0).all() for x in shares)


def test_large_books_give_the_same_blocks_and_signs(spark, monkeypatch):
    t = log(spark, [((7 * i) % 11) - 4.5 if i != 5 else float("nan") for i in range(23)])
    ask = (
        lambda: one(resample.block_bootstrap(t, n_boot=40)), lambda: one(resample.block_bootstrap(t, n_boot=40, block=50)),
        lambda: one(resample.block_bootstrap(t, n_boot=40, stationary=True)), lambda: one(search.sign_permutation(t, n_perm=40)),
    )
    folded = [f() for f in ask]
    for name, n in (("LARGEST_BOOK", 5), ("SLOTS", 3)):
        monkeypatch.setattr(resample, name, n)
    for want, got in zip(folded, [f() for f in ask], strict=True):
        assert got == pytest.approx(want)
    monkeypatch.setattr(resample, "RANGE_ROWS", 4)
    got = one(resample.bootstrap_metric_cis(t, ("expectancy",), n_boot=400))
    assert got["ci_low"] < got["point"] < got["ci_high"]
    assert one(resample.reality_check(t, n_boot=100))["n"] == 22


def test_multinomial_draws_of_no_trades(spark):
    empty = log(spark, [1.0]).where("r > 5")
    assert resample.multinomial_draws(empty, 5, 3, ("expectancy",)).count() == 0


def test_strong_and_weak_books(spark):
    strong = log(spark, [1.0, 1.2, 0.8, -0.2, 1.1] * 20)
    assert one(resample.reality_check(strong, n_boot=200))["verdict"] == "HELD"
    assert one(resample.reality_check(log(spark, [3.0, -1.0, -1.0, -0.5]), n_boot=200))["verdict"] == "FRAGILE"
    assert one(resample.reality_check(log(spark, [-1.0, -1.0]), n_boot=50))["verdict"] == "FAIL"


def test_empty_books(spark):
    empty = log(spark, [1.0]).where("r > 5")
    assert one(search.sign_permutation(empty, n_perm=10))["p_value"] == 1.0
    assert one(resample.block_bootstrap(empty, n_boot=10))["p_value"] == 1.0


def test_large_searches_give_the_same_answers(spark, monkeypatch):
    rows = [(v, o, i, ((5 * i + o) % 7) - 2.8 + 0.3 * o) for o, v in enumerate("abc") for i in range(9 + o)]
    variants = spark.createDataFrame(rows, "variant string, variant_ord int, obs_seq int, r double")
    ask = (lambda: one(search.whites_reality_check(variants, n_perm=40)), lambda: one(search.spa_test(variants, n_perm=40)))
    folded = [f() for f in ask]
    monkeypatch.setattr(resample, "LARGEST_BOOK", 5)
    assert [f() for f in ask] == folded


def test_sidak():
    assert search.sidak(0.05, 1) == pytest.approx(0.05) and search.sidak(2.0, 3) == 1
    with pytest.raises(ValueError):
        search.sidak(0.1, 0)


def test_ledger(spark, tmp_path):
    book = search.Ledger(spark, str(tmp_path / "ledger"), "a")
    for i in range(4):
        book.record({"n": i}, score=float(i % 3))
    book.mark_selected({"n": 2})
    search.Ledger(spark, book.path, "b").record({"n": 9}, score=99)
    assert book.n_variants == book.session_n_variants == 4
    assert book.best().first().params == '{"n": 2}'
    assert [r.params for r in book.entries().where("status = 'selected'").collect()] == ['{"n": 2}']
    with pytest.raises(ValueError):
        book.record({}, status="other")


def test_split_keeps_leaks_out(spark):
    d = [dt.datetime(2020, 1, 1), dt.datetime(2020, 5, 30), dt.datetime(2020, 6, 10), dt.datetime(2020, 9, 1)]
    t = log(spark, [1.0] * 4, entry_date=d, exit_date=[x + dt.timedelta(days=7) for x in d])
    got = {r.trade_seq: r.side for r in splits.split_train_test(t, "2020-06-01").collect()}
    assert got == {0: "train", 3: "test"}


def test_asof_windows(spark):
    rows = spark.createDataFrame([("x", i) for i in range(1, 8)], "symbol string, ts int")
    cut = spark.createDataFrame([("x", 4), ("x", 1)], "symbol string, cutoff int")
    at = sorted((r.cutoff, r.back, r.ts) for r in splits.asof_window(rows, cut, lookback=2).collect())
    assert at == [(1, 1, 1), (4, 1, 4), (4, 2, 3)]
    before = sorted((r.cutoff, r.back, r.ts) for r in splits.window_before(rows, cut, lookback=2).collect())
    assert before == [(4, 1, 3), (4, 2, 2)]


def bars(spark, rows):
    full = [("s", i, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "symbol string, bar_seq long, ts timestamp, open double, high double, low double, close double")


def test_a_bar_that_touches_both_is_a_stop(spark):
    b = bars(spark, [(10, 10, 10, 10), (10, 20, 5, 10), (10, 10, 10, 10)]).withColumn("signal", F.col("bar_seq") == 0)
    got = one(barriers.barrier_trades(b, risk_unit="price"))
    assert (got["exit_reason"], got["r"], got["bars_held"], got["mfe"], got["mae"]) == ("SL", -1.0, 0, 10.0, -5.0)


def test_timeout_end_and_overlap(spark):
    flat = bars(spark, [(10, 10.5, 9.5, 10)] * 8).withColumn("signal", F.lit(True))
    got = barriers.barrier_trades(flat, risk_unit="price", timeout=2).orderBy("trade_seq").collect()
    assert [(r.trade_seq, r.bars_held, r.exit_reason) for r in got] == [(0, 2, "timeout"), (4, 2, "timeout")]
    late = flat.withColumn("signal", F.col("bar_seq") == 5)
    assert one(barriers.barrier_trades(late, risk_unit="price", timeout=5))["exit_reason"] == "eod"
    none = barriers.barrier_trades(flat.withColumn("signal", F.lit(False)), risk_unit="price")
    assert none.count() == 0 and none.columns == list(barriers.TRADE_COLUMNS)


def test_ewm_recursion(spark):
    b = bars(spark, [(1, 1, 1, x) for x in (1, 2, 3)])
    got = [r.e for r in signals.with_ewm(b, {"e": ("close", 3)}).orderBy("bar_seq").collect()]
    assert got == [1.0, 1.5, 2.25]


def test_ewm_in_chunks_equals_one_recursion(spark):
    x = [None if i in (0, 1, 17) or 30 < i < 52 else math.sin(i) + i % 7 for i in range(90)]
    rows = [(s, i, v) for s, n in (("a", 90), ("b", 1), ("c", 40)) for i, v in enumerate(x[:n])]
    df = spark.createDataFrame(rows, "symbol string, bar_seq int, close double")
    want = {}
    for s, i, v in rows:
        for name, span in (("e", 5), ("f", 1), ("g", 60)):
            alpha = 2 / (span + 1)
            y, old = want.get((s, i - 1, name), (None, 1.0))
            old *= 1 - alpha
            want[s, i, name] = (y, old) if v is None else (v if y is None else (old * y + alpha * v) / (old + alpha), 1.0)
    for chunk, ranged in ((4, 3), (64, 1024)):
        got = signals.with_ewm(df, {"e": ("close", 5), "f": ("close", 1), "g": ("close", 60)}, chunk, ranged).collect()
        assert len(got) == len(rows)
        for r in got:
            for name in "efg":
                assert r[name] == (pytest.approx(want[r.symbol, r.bar_seq, name][0], rel=1e-12) if want[r.symbol, r.bar_seq, name][0] is not None else None)


def test_chains_in_blocks_equal_one_walk(spark):
    rng_ = random.Random(2)
    rows = [(g, i, i + rng_.randrange(6), f"{g}{i}") for g in "ab" for i in range(300) if rng_.random() < 0.6] + [("c", 7, 9, "c7")]
    want, free = [], {}
    for g, i, j, name in rows:
        if i > free.get(g, -1):
            free[g] = j
            want.append(name)
    df = spark.createDataFrame(rows, "g string, bar_seq long, exit_seq long, name string")
    for block in (24, 50, 4096):
        got = barriers.chained(df, ["g"], 6, block)
        assert sorted(r.name for r in got.collect()) == sorted(want)
        assert got.columns == df.columns and "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_folds_and_grid(spark):
    assert walkforward.param_grid({}) == [{}] and len(walkforward.param_grid({"a": [1, 2], "b": [3, 4]})) == 4
    f = walkforward.folds(spark, dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1), is_days=100, oos_days=100, purge_days=5, embargo_days=2).collect()
    assert len(f) == 3 and f[0].is_end == f[0].oos_start - dt.timedelta(days=5) and f[-1].oos_end == dt.datetime(2021, 1, 1)


def test_a_grid_as_data_trades_as_each_setting_alone(spark):
    rng_ = random.Random(5)
    level, rows = 50.0, []
    for _ in range(160):
        step = rng_.gauss(0, 1)
        rows.append((level, max(level, level + step) + 0.5, min(level, level + step) - 0.5, level + step))
        level += step
    b = bars(spark, rows)
    grid = [(i, p["fast"], p["slow"]) for i, p in enumerate(walkforward.param_grid({"fast": [2, 3], "slow": [5, 9]}))]
    got = walkforward.simulate_crossings(b, spark.createDataFrame(grid, "combo_id int, fast int, slow int"), timeout=6).collect()
    want = walkforward.simulate(b, {"fast": [2, 3], "slow": [5, 9]}, signals.ma_cross, lambda x: barriers.barrier_trades(x, timeout=6)).collect()
    assert len(want) > 10
    assert sorted((r.combo_id, r.bar_seq, r.exit_reason, round(r.r, 9)) for r in got) == sorted((r.combo_id, r.trade_seq, r.exit_reason, round(r.r, 9)) for r in want)
    many = spark.createDataFrame([(i, 2 + i % 20, 30 + i // 20) for i in range(200)], "combo_id int, fast int, slow int")
    lines = walkforward.crossing_signals(b, many)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert lines == walkforward.crossing_signals(b, spark.createDataFrame(grid, "combo_id int, fast int, slow int"))._jdf.queryExecution().optimizedPlan().toString().count("\n")


def test_pbo_rejects_bad_matrices(spark):
    m = spark.createDataFrame([(i, c, float(i)) for i in range(4) for c in "ab"], "period_seq int, config string, ret double")
    with pytest.raises(ValueError, match="even"):
        overfit.pbo(m, 3)
    with pytest.raises(ValueError, match="dense"):
        overfit.pbo(m.where("not (period_seq = 1 and config = 'a')"), 2)


def test_a_metric_of_ones_own_goes_everywhere(spark, monkeypatch):
    tail = lambda r: F.when(r < -1, r).otherwise(0.0)
    metrics.register("gain_over_tail", lambda: F.try_divide("s", F.abs("tail")), {"tail": tail})
    try:
        r = [((7 * i) % 11) / 2 - 2.4 for i in range(40)]
        t = log(spark, r)
        own = sum(r) / abs(sum(x for x in r if x < -1))
        found = one(resample.bootstrap_ci(t, "gain_over_tail", n_boot=300))
        assert found["point"] == pytest.approx(own) and found["ci_low"] < own < found["ci_high"]
        monkeypatch.setattr(resample, "LARGEST_BOOK", 5)
        monkeypatch.setattr(resample, "RANGE_ROWS", 9)
        large = one(resample.bootstrap_ci(t, "gain_over_tail", n_boot=300))
        assert large["point"] == pytest.approx(own) and large["ci_low"] == pytest.approx(found["ci_low"], abs=0.2)
        rows = [(i, c, r[(i * k) % 40] + (0.5 if c == "a" else 0)) for i in range(40) for c, k in (("a", 1), ("b", 3), ("c", 7))]
        m = spark.createDataFrame(rows, "period_seq int, config string, ret double")
        splits_ = {x.split_id: x for x in overfit.cscv(m, 4, metric="gain_over_tail").collect()}
        inside = lambda i, blocks: i // 10 in blocks
        ratio = lambda xs: sum(xs) / abs(sum(x for x in xs if x < -1))
        for k, blocks in enumerate(((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))):
            best = max("abc", key=lambda c: ratio([x for i, d, x in rows if d == c and inside(i, blocks)]))
            assert splits_[k].config == best
            assert splits_[k].oos_score == pytest.approx(ratio([x for i, d, x in rows if d == best and not inside(i, blocks)]))
        assert one(overfit.pbo(m, 4, metric="expectancy"))["n_splits"] == 6
        with pytest.raises(ValueError, match="already"):
            metrics.register("sqn", metrics.expectancy)
    finally:
        metrics.unregister("gain_over_tail", ("tail",))


def test_a_dominant_configuration_is_robust(spark):
    rows = [(i, c, (1.0 if c == "a" else -1.0) + (0.1 if i % 2 else -0.1)) for i in range(32) for c in "abc"]
    got = one(overfit.pbo(spark.createDataFrame(rows, "period_seq int, config string, ret double"), 8))
    assert got["pbo"] == 0 and got["label"] == "ROBUST" and got["n_splits"] == 70


def test_deflated_needs_enough_trials(spark):
    t = log(spark, [1.0, -0.5, 0.8, 0.3])
    trials = t.withColumn("trial", F.col("trade_seq") % 2)
    with pytest.raises(ValueError, match="n_trials"):
        overfit.deflated_expectancy(t, trials, n_trials=1)
    assert overfit.deflated_expectancy(t, trials, n_trials=50).deflated < overfit.deflated_expectancy(t, trials, n_trials=2).deflated


def test_gate_logic(spark):
    rows = [(0, "A", 0, "x", True, 1.0, 0.5, True, ""), (0, "A", 1, "y", False, 0.0, 0.5, False, ""), (3, "GENERAL", 0, "z", False, 0.2, 0.05, True, "")]
    table = gates.checks(spark, rows)
    assert {r.gate: r.passed for r in gates.gate_verdicts(table).collect()} == {"A": True, "GENERAL": False}
    assert one(gates.gauntlet_verdict(table)) == {"passed": False, "failed_gates": "GENERAL"}
    assert one(panels.verdict_state(table))["state"] == "scope"
    assert "[WARN] y" in gates.audit_text(table)
    soft = gates.checks(spark, [(0, "A", 0, "y", True, None, None, False, "")])
    assert not one(gates.gauntlet_verdict(soft))["passed"]


def test_permutations_are_permutations(spark):
    for m in (1, 2, 3, 7, 64, 100, 257):
        got = [r.p for r in spark.range(m).select(rng.permuted(F.col("id"), F.lit(m), 3, "key").alias("p")).collect()]
        assert sorted(got) == list(range(m))
    firsts = spark.range(2000).select(rng.permuted(F.lit(0), F.lit(10), 3, F.col("id")).alias("p")).groupBy("p").count().collect()
    assert len(firsts) == 10 and all(130 < r["count"] < 270 for r in firsts)


def test_random_picks_are_distinct_and_spare_the_last_bar(spark):
    b = bars(spark, [(10, 11, 9, 10)] * 30)
    for n in (0, 5, 29, 60):
        hit = [r.bar_seq for r in signals.random_entries(b, n, 7).where("signal").collect()]
        assert len(hit) == len({*hit}) == min(n, 29) and 29 not in hit


def test_gate_real_skips_softly_and_holds_as_the_log_did(spark):
    b = bars(spark, [(10 + i % 5, 11 + i % 5, 9 + i % 5, 10 + (i + 1) % 5) for i in range(80)])
    t = log(spark, [1.0, 0.5, 0.8, -0.2], bars_held=[2, 3, 2, 3])
    small = gates.Thresholds(n_perm=50, n_sims=20)
    quiet = gates.gate_real(t, t=small).where("check_ord = 1").first()
    assert (quiet.passed, quiet.hard, quiet.value) == (False, False, None) and "[WARN] random_timing" in gates.audit_text(gates.gate_real(t, t=small))
    dead = gates.gate_real(t, bars=b.withColumns({c: F.lit(0.0) for c in ("open", "high", "low", "close")}), t=small).where("check_ord = 1").first()
    assert (dead.passed, dead.hard) == (False, False) and "no trades" in dead.detail
    assert gates.mean_hold(t) == 2 and gates.mean_hold(t.drop("bars_held")) == 20
    own = gates.gate_real(t, bars=b, t=small).where("check_ord = 1").first()
    held = gates.gate_real(t, bars=b, hold=2, t=small).where("check_ord = 1").first()
    longer = gates.gate_real(t, bars=b, hold=30, t=small).where("check_ord = 1").first()
    assert own.threshold == held.threshold != longer.threshold
    # two symbols with the same bars and half of the trades each: one number for each simulation
    two = b.union(b.withColumn("symbol", F.lit("t")))
    both = gates.gate_real(t.withColumn("symbol", F.when(F.col("trade_seq") < 2, "s").otherwise("t")), bars=two, hold=2, t=small).where("check_ord = 1").first()
    assert both.hard and both.threshold is not None
    scaled = [gates.gate_real(t.withColumns({"unit": F.lit(50.0), "symbol": F.lit("s")}), bars=b, null="detrended", null_scale=c, t=small).where("check_ord = 1").first() for c in (None, "unit")]
    assert scaled[1].threshold == pytest.approx(50 * scaled[0].threshold) and "R units" in scaled[1].detail


def test_thin_segments_are_judged_by_their_test_side(spark):
    d = [dt.datetime(2020, 1, 1) + dt.timedelta(days=30 * i) for i in range(20)]
    t = log(spark, [1.0] * 20, entry_date=d, exit_date=d).withColumn("m", F.when(F.col("trade_seq") % 5 == 0, "few").otherwise("many"))
    got = {(r.segment, r.side): r.thin for r in splits.segmented_holdout(t, "m", "2020-06-01", min_n=4, n_boot=10).collect()}
    assert got == {("OVERALL", "train"): False, ("OVERALL", "test"): False, ("few", "train"): True, ("few", "test"): True, ("many", "train"): False, ("many", "test"): False}
    assert not any(r.thin for r in splits.segmented_holdout(t, "m", "2020-06-01", n_boot=10).collect())


def test_cusum_path_equals_the_recursion(spark):
    r = [0.5, -1.0, -1.0, 2.0, -0.7, 0.1, -1.3] * 9
    t = log(spark, r)
    level, want = 0.0, []
    for x in r:
        level = max(0.0, level + (0.1 - x) / 0.9)
        want.append(level)
    assert [x.cusum for x in monitor.cusum_path(t, 0.1, 0.9).orderBy("trade_seq").collect()] == pytest.approx(want)


def test_design_of_the_documented_size():
    d = scalars.cusum_design(scalars.Baseline(0.1, 1.2, 400, 300.0))
    assert d.arl0 == pytest.approx(7500, rel=1e-3) and 0 < d.arl1 < d.arl0
    with pytest.raises(ValueError):
        scalars.Baseline(-0.1, 1.0, 10)
    with pytest.raises(ValueError):
        scalars.cusum_design(scalars.Baseline(0.1, 1.0, 10), shift=1.0)


def test_monitor_labels(spark):
    base = scalars.Baseline(0.5, 1.0, 100)
    assert one(monitor.edge_monitor(log(spark, [0.5] * 40), base))["label"] == "HOLDING"
    assert one(monitor.edge_monitor(log(spark, [-2.0] * 60), base))["label"] == "DEGRADED"
    assert one(monitor.edge_monitor(log(spark, [0.5] * 40 + [0.1] * 30), base))["label"] == "SLIPPING"


def test_ranks_decay_and_constant_scores(spark):
    p = spark.createDataFrame([(i, float(i), 1.0 if i >= 5 else -1.0) for i in range(10)], "row_seq int, score double, label double")
    assert one(scores.information_coefficient(p))["ic"] > 0.8
    assert one(scores.information_coefficient(p.withColumn("score", F.lit(1.0))))["ic"] == 0
    table = scores.quantile_decay(p, 5)
    assert [r.n for r in table.orderBy("bucket").collect()] == [3, 2, 2, 2, 1] or sum(r.n for r in table.collect()) == 10
    assert one(scores.decay_summary(table)) == {"spread": 1.0, "monotonic": True}
    with pytest.raises(ValueError):
        scores.alpha_gate(0.01, 0.02)


def test_droplist_keeps_the_best(spark):
    rows = [("g", i, float(i % 17), float(i % 17) * 2 + 1, float((i * 7) % 11)) for i in range(80)]
    p = spark.createDataFrame(rows, "grp string, row_seq int, a double, b double, target double")
    got = scores.droplist(p, ["a", "b"], "target", group="grp", order="row_seq").collect()
    assert {(r.feature, r.action) for r in got} == {("a", "KEEP"), ("b", "DROP")}


def test_breadth(spark):
    rows = [(i, a, float((i * k) % 13) - 6) for i in range(40) for a, k in (("x", 1), ("y", 1), ("z", 5))]
    p = spark.createDataFrame(rows, "ts int, asset string, ret double")
    assert 1 <= one(scores.effective_n(p))["n_eff"] <= 3
    values, _ = scores.principal_components(p)
    assert values.sum() == pytest.approx(3) and one(scores.effective_n(p))["n_eff"] == pytest.approx(9 / (values**2).sum())


def test_vendor_csv_and_pages(spark, tmp_path):
    (tmp_path / "t.csv").write_text("gain,when\n1.5%,a\n-0.75%,b\n")
    t = files.read_vendor_csv(spark, str(tmp_path / "t.csv"), return_col="gain", risk=0.75)
    assert sorted(r.r for r in t.collect()) == [-1.0, 2.0]
    text = render.tearsheet(log(spark, [1.0, -1.0, 0.5], bars_held=[1, 2, 3]), str(tmp_path / "page.html"), n_boot=20)
    assert (tmp_path / "page.html").read_text() == text and "Cumulative R" in text and "not attested" in text


def test_generator_is_a_function_of_its_key(spark):
    got = spark.range(3).select(rng.u52(1, F.col("id")).alias("u")).collect()
    assert len({r.u for r in got}) == 3 and all(0 <= r.u < 2**52 for r in got)


def test_pages_of_gates_and_monitors(spark):
    rows = [(0, "REAL", 0, "permutation", False, 0.2, 0.05, True, "1 variants"), (0, "REAL", 1, "random_timing", False, None, None, False, "skipped: no prices"), (1, "STRONG", 0, "expectancy_low", True, 0.1, 0.0, True, "")]
    text = render.banner(gates.checks(spark, rows))
    assert "<details open><summary><strong>REAL" in text and "<details><summary><strong>STRONG" in text
    assert "REAL fails on permutation" in text and "random_timing (soft)" in text and ">warn<" in text
    base = scalars.Baseline(0.5, 1.0, 100)
    r = [0.5] * 40 + [-1.5] * 60
    t = log(spark, r)
    page = render.monitor_page(t, base)
    alarm = one(monitor.edge_monitor(t, base))["alarm_at"]
    assert f"ALARM at trade {alarm}." in page and "Rolling expectancy" in page
    assert "No alarm." in render.monitor_page(log(spark, [0.5] * 40), base)


def test_curves_keep_extremes(spark):
    r = [0.1] * 5000
    r[777], r[778] = -50.0, 50.0
    rows = panels.r_curve(log(spark, r), 50).collect()
    assert len(rows) == 50 and sum(x.n for x in rows) == 5000
    assert min(x.drawdown_low for x in rows) == pytest.approx(-50.0) and {x.pixel: x.cum_r_low for x in rows}[7] == pytest.approx(77.7 - 50)
    few = panels.r_curve(log(spark, [1.0, -2.0]), 50).collect()
    assert sorted((x.pixel, x.cum_r_last) for x in few) == [(0, 1.0), (1, -1.0)]
    m = {x.pixel: x for x in monitor.monitor_curve(log(spark, r), scalars.Baseline(0.5, 1.0, 100), window=10, pixels=50).collect()}
    assert max(x.rolling_high for x in m.values()) == pytest.approx((50 + 0.9) / 10) and sum(x.alarm_at is not None for x in m.values()) == 1


def test_excursion_bins_count_what_lies_beyond(spark):
    t = log(spark, [1.0] * 99 + [9.0], mfe=[0.5] * 99 + [100.0], mae=[-0.2] * 100)
    got = panels.excursion_bins(t, 4).collect()
    assert sum(x.n for x in got) == 100 and sum(x.over for x in got) == 1


def test_simulated_runs_go_on_over_rounds(spark, monkeypatch):
    t = log(spark, [0.5, -1.0, 2.0, 0.1, -0.3, 1.1])
    d = scalars.cusum_design(scalars.Baseline(0.4, 1.0, 100), trades=300)
    whole = one(monitor.empirical_arl(t, d, n_sims=40, max_run=150))
    monkeypatch.setattr(monitor, "ROUND", 40)
    parts = one(monitor.empirical_arl(t, d, n_sims=40, max_run=150))
    assert parts == pytest.approx(whole) and 0 < whole["mean"] <= 150
    never = one(monitor.empirical_arl(t, d, shift=0.99, n_sims=10, max_run=3))
    assert (never["mean"], never["censored"]) == (3, 10)
    with pytest.raises(ValueError, match="2 trades"):
        monitor.empirical_arl(t.limit(1), d)


def test_dispersion_judges_sqn_whatever_chose_the_settings(spark):
    d = [dt.datetime(2020, 1, 1) + dt.timedelta(days=3 * i) for i in range(200)]
    r = [(0.8 if i % 3 else -1.0) + (0.3 if i > 150 else 0) for i in range(200)]
    t = log(spark, r, entry_date=d, exit_date=d).withColumn("combo_id", F.lit(0))
    w = walkforward.folds_of(t, is_days=200, oos_days=100)
    by_sqn, by_mean = (walkforward.fold_table(t, w, score=s) for s in ("sqn", "expectancy"))
    assert one(walkforward.fold_dispersion(by_sqn)) == one(walkforward.fold_dispersion(by_mean))
    assert one(walkforward.fold_dispersion(by_mean, "oos_score")) != one(walkforward.fold_dispersion(by_mean))
    assert walkforward.folds_of(t.limit(0), is_days=1, oos_days=1).count() == 0
