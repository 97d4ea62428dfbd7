from edgewright.operators import barriers, gates, nulls, resample, scores, signals, walkforward
from edgewright.sources import synthetic


def test_walk_to_verdict(spark):
    bars = synthetic.random_walk(spark, 300, 2)
    assert bars.where("low > least(open, close) or high < greatest(open, close)").count() == 0
    trades = barriers.barrier_trades(signals.donchian(bars, 10), timeout=10)
    assert trades.where("mae > 0 or mfe < 0").count() == 0 and trades.where("exit_reason = 'SL' and abs(r + 1) > 1e-9").count() == 0
    assert resample.reality_check(trades, n_boot=50).first().verdict in ("HELD", "FRAGILE", "FAIL")
    null = nulls.random_entry_null(bars, n_entries=5, n_sims=6, timeout=10)
    assert null.count() == 12 and null.where("n > 5").count() == 0


def test_grid_walk_forward_and_gauntlet(spark):
    import datetime as dt

    bars = synthetic.random_walk(spark, 400, 1, regime=120)
    trades = walkforward.simulate(bars, {"fast": [3], "slow": [8, 12]}, lambda b, fast, slow: signals.ma_cross(b, fast, slow), lambda b: barriers.barrier_trades(b, timeout=5)).cache()
    assert {r.combo_id for r in trades.select("combo_id").distinct().collect()} == {0, 1}
    windows = walkforward.folds(spark, dt.datetime(2000, 1, 1), dt.datetime(2001, 2, 1), is_days=150, oos_days=60)
    folds = walkforward.fold_table(trades, windows, min_trades=3)
    t = gates.Thresholds(n_boot=50, n_perm=50, n_sims=5)
    checks = gates.run_gauntlet(trades.where("combo_id = 0"), folds=folds, bars=bars, t=t, timeout=5)
    assert {r.gate for r in checks.collect()} == {"REAL", "STRONG", "DURABLE"}
    assert gates.gates_json(checks).count() == 3


def test_blocs_count_as_fewer_streams(spark):
    n = scores.effective_n(synthetic.factor_panel(spark)).first()
    assert n.n_assets == 12 and 3 < n.n_eff < 8


def test_scores_tell_outcomes(spark):
    good, none = (scores.information_coefficient(synthetic.scored_book(spark, 500, skill=k)).first().ic for k in (2.0, 0.0))
    assert good > 0.5 and abs(none) < 0.2
    book = synthetic.r_book(spark, 300)
    assert 50 < synthetic.thin(book, 0.3).count() < 130
