"""Two-level sums, extremes, positions and ranks against one pass over sorted rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgewright.operators import ordered, scores


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [(g, rng.randrange(12), i, None if rng.random() < 0.1 else rng.gauss(0, 1)) for i in range(400) for g in (rng.choice(("a", "a", "a", "b", None)),)]


@pytest.fixture(params=["windows", "ranges"])
def way(request, monkeypatch):
    if request.param == "ranges":
        monkeypatch.setattr(ordered, "WINDOW_ROWS", 0)
    return request.param


def test_running_sums_and_extremes(spark, rows, way):
    df = spark.createDataFrame(rows, "g string, day int, i int, x double").repartition(3)
    got = ordered.running(df, ["g"], ["day", "i"], {"c": F.col("x"), "k": F.lit(1)}, high={"top": "c"}, low={"bottom": "c"})
    assert got.columns == ["g", "day", "i", "x", "c", "k", "top", "bottom"]
    state, want = {}, {}
    for g, day, i, x in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        c, k, top, bottom = state.get(g, (0.0, 0, -9e9, 9e9))
        c += x or 0.0
        state[g] = want[i] = (c, k + 1, max(top, c), min(bottom, c))
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.c, r.k, r.top, r.bottom) == pytest.approx(want[r.i])
    everything = {r.i: r["_i"] for r in ordered.placed(df, [], ["day", "i"]).collect()}
    assert everything == {i: n for n, (_, i) in enumerate(sorted((d, i) for _, d, i, _ in rows))}


def test_ranks_of_ties_and_of_no_rows(spark, rows, way):
    df = spark.createDataFrame([(g, d) for g, d, _, _ in rows], "g string, v int")
    got = {(r.g, r.v): r["rank"] for r in ordered.value_ranks(df, ["g"], "v", "rank").collect()}
    for g in ("a", "b", None):
        own = sorted(d for h, d, _, _ in rows if h == g)
        for v in set(own):
            at = [n for n, d in enumerate(own, 1) if d == v]
            assert got[g, v] == sum(at) / len(at)
    assert ordered.value_ranks(df.limit(0), ["g"], "v", "rank").count() == 0
    assert ordered.running(df.limit(0), [], ["v"], {"c": F.col("v")}).count() == 0


def test_no_window_gathers_the_whole_table(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered, "WINDOW_ROWS", 0)
    preds = spark.createDataFrame([(i, x, float(d % 2)) for _, d, i, x in rows], "row_seq int, score double, label double")
    for df in (scores.information_coefficient(preds), scores.quantile_decay(preds, 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            assert not ("Window [row_number" in line or "Window [rank" in line) or "_part" in line


def test_queries_are_the_same_in_ranges(spark, sf_dir, monkeypatch):
    from edgewright.plans import catalogue

    names = ("drawdown", "gross_net", "concurrency", "cusum_and_rolling", "edge_monitor", "information_coefficient", "quantile_decay", "fold_ic", "timing_null")
    rows_of = lambda n: [tuple(r) for r in catalogue.QUERIES[n](spark, sf_dir).collect()]
    key = lambda r: tuple(f"{x:.3f}" if isinstance(x, float) else str(x) for x in r)
    want = {n: sorted(rows_of(n), key=key) for n in names}
    monkeypatch.setattr(ordered, "WINDOW_ROWS", 0)
    for n in names:
        got = sorted(rows_of(n), key=key)
        assert len(got) == len(want[n])
        for x, y in zip(got, want[n], strict=True):
            assert [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)], abs=2e-6)
            assert [v for v in x if not isinstance(v, float)] == [v for v in y if not isinstance(v, float)]


def test_gram_equals_numpy_with_missing_values(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    x[:, 1] = x[:, 0] * 2 + 0.1 * rng.normal(size=300)
    x[:, 4] = 3.0
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [([None if np.isnan(v) else float(v) for v in r],) for r in x]
    got = {(r.i, r.j): r for r in scores.gram(spark.createDataFrame(rows, "x array<double>").repartition(3), "x", 5).collect()}
    assert len(got) == 10
    for (i, j), r in got.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert r.n == both.sum()
        assert r.rho is None if 4 in (i, j) else r.rho == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1])


def test_redundant_features_of_both_kinds(spark, way):
    rng = random.Random(3)
    rows = [(i, v := rng.gauss(0, 1), v**3, rng.gauss(0, 1), float(i % 2), float(1 - i % 2), float(rng.random() < 0.5)) for i in range(200)]
    df = spark.createDataFrame(rows, "row int, a double, b double, c double, p double, q double, r double")
    got = {(r.a, r.b): (r.kind, round(r.strength, 6)) for r in scores.redundancy_edges(df, list("abcpqr"), order="row").collect()}
    assert got == {("a", "b"): ("rank", 1.0), ("p", "q"): ("cramer", 1.0)}
    with pytest.raises(ValueError, match="assets"):
        scores.MOST_ASSETS, keep = 1, scores.MOST_ASSETS
        try:
            scores.correlations(spark.createDataFrame([(t, n, float(t)) for t in range(40) for n in "xy"], "ts int, asset string, ret double"))
        finally:
            scores.MOST_ASSETS = keep
