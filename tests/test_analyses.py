import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions.distributions import chi2_tail, f_tail, normal_cdf
from tidelog.functions.grid import grid, period_end
from tidelog.operators.analysis import analyse
from tidelog.operators.changepoints import change_points, segment_costs, segmentation
from tidelog.operators.forecast import CRITERIA, accuracy, accuracy_table, appended, exogenous_counts, fit_and_predict, forecasts, forecasts_with_causes
from tidelog.operators.granger import granger, p_values
from tidelog.operators.points import as_series, causal_inputs, changes_beyond, differences, extremes, quantile_points
from tidelog.operators.points import places as places_of
from tidelog.operators.stationarity import adf_p_value, differenced, first_differences, kpss_p_value, orders, seasonal_period

SCHEMA = "property string, param1 string, param2 string, idx int, value double"


def frame(spark, **series):
    return spark.createDataFrame([("ep1", k, None, i, float(v)) for k, values in series.items() for i, v in enumerate(values)], SCHEMA)


def places(df):
    return sorted((r["param1"], r["idx"]) for r in df.collect())


def test_tails():
    # Fixed values from tables of the distributions.
    assert f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)


def test_points(spark):
    s = frame(spark, a=[1, 2, 3, 4, 10], b=[0, 0, 5, 5, 0])
    assert places(quantile_points(s, ">=", 0.6)) == [("a", 3), ("a", 4), ("b", 2), ("b", 3)]  # between two values the higher one counts
    assert places(quantile_points(s, "between", 0.25, 0.5).filter("param1 = 'a'")) == [("a", 1), ("a", 2)]
    assert places(changes_beyond(s, ">=", 0.5)) == [("a", 1), ("a", 2), ("a", 4), ("b", 2)]  # from 0 to 5 without bound, 0 to 0 is none
    assert places(changes_beyond(s, "<=", -1.0)) == [("b", 4)]
    assert places(extremes(s, 1, largest=True)) == [("a", 4), ("b", 2)] and places(extremes(s, 2, largest=False)) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    assert [r["value"] for r in differences(s.filter("param1 = 'a'"), 1, 2).orderBy("idx").collect()] == [0, 0, 5]
    for wrong in (lambda: quantile_points(s, "=", 0.1), lambda: quantile_points(s, "between", 0.1)):
        with pytest.raises(ValueError):
            wrong()


def best_cost(values, model, penalty, size):
    """The cost of the best segmentation, over all of them."""
    cost, n = segment_costs(values, model), len(values)
    best = {0: 0.0}
    for stop in range(1, n + 1):
        ways = [best[s] + float(cost(np.array([s]), stop)[0]) + penalty for s in best if stop - s >= size]
        if ways:
            best[stop] = min(ways)
    return best[n]


@pytest.mark.parametrize("model", ["rbf", "l1", "l2"])
def test_segmentation_is_optimal(model):
    rng = np.random.default_rng(2)
    for _ in range(10):
        values = np.concatenate([rng.normal(m, 1, rng.integers(4, 15)) for m in rng.normal(0, 5, 4)])
        cuts = [0, *segmentation(values, model), len(values)]
        cost = segment_costs(values, model)
        total = sum(float(cost(np.array([a]), b)[0]) + 1.5 for a, b in zip(cuts, cuts[1:], strict=False))
        assert total == pytest.approx(best_cost(values, model, 1.5, 3)) and min(np.diff(cuts)) >= 3


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 150])
def test_distances_from_medians(n):
    """Each segment's cost under l1 against the sum of distances from its median, with ties and far from zero."""
    rng = np.random.default_rng(n)
    for values in (rng.normal(size=n) * 100 + 1e4, rng.integers(0, 3, n).astype(float), np.ones(n)):
        cost = segment_costs(values, "l1")
        for stop in range(1, n + 1):
            want = [np.abs(values[s:stop] - np.median(values[s:stop])).sum() for s in range(stop)]
            assert cost(np.arange(stop), stop) == pytest.approx(want, abs=1e-7)


def test_long_series_under_l1():
    rng = np.random.default_rng(5)
    values = np.repeat(np.arange(30) % 2 * 20.0, 100) + rng.normal(size=3000)
    assert segmentation(values, "l1", penalty=50.0) == list(range(100, 3000, 100))


def brute_segments(values, model, penalty, size, jump):
    """The cost of the best segmentation whose segments start at multiples of jump."""
    cost, n = segment_costs(values, model), len(values)
    best = {0: 0.0}
    for stop in [*range(jump, n, jump), n]:
        ways = [best[s] + float(cost(np.array([s]), stop)[0]) + penalty for s in best if stop - s >= size]
        if ways:
            best[stop] = min(ways)
    return best[n]


@pytest.mark.parametrize("jump", [1, 2, 3, 5])
def test_segments_start_at_multiples_of_jump(jump):
    rng = np.random.default_rng(3)
    for size in (2, 3, 4):
        values = np.concatenate([rng.normal(m, 1, 11) for m in (0, 6, -4)])
        cuts = [0, *segmentation(values, "l2", size, 2.0, jump), len(values)]
        cost = segment_costs(values, "l2")
        assert all(c % jump == 0 for c in cuts[1:-1])
        assert sum(float(cost(np.array([a]), b)[0]) + 2.0 for a, b in zip(cuts, cuts[1:], strict=False)) == pytest.approx(brute_segments(values, "l2", 2.0, size, jump))
    with pytest.raises(ValueError):
        segmentation(values, jump=0)


def test_change_points_and_orders_of_fixed_series(spark):
    """Small series whose change points and differences are known."""
    s = frame(spark, step=[0.0] * 10 + [5.0] * 10, flat=[1.0, 1.1] * 10, line=[float(i) + (i * 7 % 5) / 10 for i in range(20)])
    assert places(change_points(s.filter("param1 <> 'line'"), "l2")) == [("step", 10)]
    rng = np.random.default_rng(1)
    found = {r["param1"]: r["differences"] for r in orders(frame(spark, walk=rng.normal(size=60).cumsum(), noise=rng.normal(size=60)), "YE").collect()}
    assert found == {"noise": 0, "walk": 1}


def test_points_as_series(spark):
    g = grid(date(2024, 1, 1), date(2024, 7, 31), "ME")
    points = spark.createDataFrame([("ep1", "a", None, 1), ("ep1", "a", None, 3), ("ep1", "b", "x", 0)] + [("ep1", "all", None, i) for i in range(7)], "property string, param1 string, param2 string, idx int")
    marked = as_series(points, g)
    assert {(r["param1"], r["idx"], r["value"]) for r in marked.filter("param1 = 'a'").collect()} == {("a", i, float(i in (1, 3))) for i in range(7)}
    assert {r["t"] for r in marked.collect()} == set(g.rights)
    assert sorted(map(tuple, places_of(marked).collect()), key=str) == sorted(map(tuple, points.collect()), key=str)
    assert {r["param1"] for r in causal_inputs(marked).collect()} == {"a"}


def test_right_edges_behind_the_grid(spark):
    for rate, first, last in (("D", date(2024, 1, 30), date(2024, 2, 10)), ("W", date(2024, 1, 30), date(2024, 4, 10)), ("ME", date(2023, 11, 5), date(2024, 4, 10)), ("QE", date(2023, 2, 5), date(2024, 4, 10)), ("YE", date(2018, 2, 5), date(2024, 4, 10))):
        g = grid(first, last, rate)
        days = list(g.rights)
        while len(days) < len(g.rights) + 30:
            days.append(period_end(days[-1] + timedelta(1), rate))
        got = spark.range(len(days)).select(g.right(F.col("id")).alias("d")).collect()
        assert [r["d"] for r in got] == days


def test_analyse_by_name(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=60)
    s = frame(spark, x=x, y=np.concatenate([[0], 0.9 * x[:-1]]) + rng.normal(0, 0.1, 60))
    g = grid(date(2020, 1, 1), date(2024, 12, 31), "ME")
    assert len(g.rights) == 60
    assert places(analyse(s, "Threshold Based Point Detection", g, mode="nlargest", k=1)) == places(extremes(s, 1, True))
    assert places(analyse(s, "Threshold Based Point Detection", g, mode="quantile", operator=">=", one=0.9)) == places(quantile_points(s, ">=", 0.9))
    assert places(analyse(s, "Change Point Detection", g, model="l2", penalty=50.0)) == places(change_points(s, "l2", penalty=50.0))
    causes = analyse(s, "Granger Causality", g, lags=2)
    assert {(r["caused"]["param1"], r["causing"]["param1"]) for r in causes.collect()} == {("y", "x")}
    ahead = analyse(s, "Forecasting", g, causes=causes, horizon=2)
    assert {(r["param1"], r["idx"], r["t"]) for r in ahead.collect()} == {(c, 60 + i, date(2025, 1 + i, 31 if i == 0 else 28)) for c in "xy" for i in range(2)}
    assert {(r["param1"], r["n_causes"]) for r in exogenous_counts(s, causes).collect()} == {("x", 0), ("y", 1)}
    assert appended(s, ahead).count() == 124
    short = grid(date(2024, 1, 1), date(2024, 6, 30), "ME")
    for technique, params in (("Guessing", {}), ("Threshold Based Point Detection", {"mode": "nlargest"}), ("Threshold Based Point Detection", {"mode": "quantile"}), ("Threshold Based Point Detection", {"mode": "other"})):
        with pytest.raises(ValueError):
            analyse(s, technique, g, **params)
    for technique in ("Forecasting", "Granger Causality"):
        with pytest.raises(ValueError):
            analyse(s, technique, short)


def test_orders_of_forecasts_are_bounded():
    y = np.random.default_rng(4).normal(size=80).cumsum()
    for criterion in CRITERIA:
        assert len(fit_and_predict(y, 3, 0, (2, 1, 0, 0), criterion=criterion, least=(1, 0, 0, 0))) == 3
    with pytest.raises(ValueError):
        fit_and_predict(y, 3, criterion="best")
    with pytest.raises(ValueError):
        fit_and_predict(y, 3, 0, (1, 1, 0, 0), least=(2, 0, 0, 0))


def test_accuracy_table(spark):
    errors = spark.createDataFrame([("a", "x", 1.0, 10.0), ("a", "x", 3.0, 20.0), ("a", "x", 8.0, 60.0), ("b", "x", 2.0, None)], "log string, experiment string, mase double, mape double")
    got = {r["log"]: r for r in accuracy_table(errors, "log", "experiment").collect()}
    assert (got["a"]["n_series"], got["a"]["mase_mean"], got["a"]["mase_median"], got["a"]["mape_mean"], got["a"]["mape_median"]) == (3, 4.0, 3.0, 30.0, 20.0)
    assert got["b"]["mape_mean"] is None


def test_change_points(spark):
    assert places(change_points(frame(spark, a=[1] * 8 + [9] * 8 + [1] * 8, b=[1, 2]))) == [("a", 8), ("a", 16)]


def test_stationarity(spark):
    rng = np.random.default_rng(4)
    noise, walk = rng.normal(size=200), rng.normal(size=200).cumsum()
    assert adf_p_value(noise) < 0.01 and kpss_p_value(noise) > 0.05 and first_differences(noise) == 0
    assert adf_p_value(walk) > 0.05 and first_differences(walk) in (1, 2)
    assert seasonal_period(noise, "QE") == 0  # noise has no season
    steps = np.concatenate([rng.normal(size=(1, 4)), rng.normal(size=(29, 4))]).cumsum(axis=0).ravel()  # each quarter walks on its own
    assert seasonal_period(steps, "QE") % 4 == 0 and seasonal_period(steps, "QE") > 0
    s = frame(spark, noise=noise, walk=walk)
    found = orders(s, "YE")
    by = {r["param1"]: r for r in found.collect()}
    assert by["noise"]["differences"] == 0 and by["walk"]["differences"] in (1, 2)
    sizes = {r["param1"]: r["count"] for r in differenced(s, found).groupBy("param1").count().collect()}
    assert sizes["walk"] == 200 - by["walk"]["period"] - by["walk"]["differences"]


def test_granger(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=120)
    y = np.concatenate([[0, 0], 0.8 * x[:-2]]) + rng.normal(0, 0.2, 120)
    assert max(p_values(y, x, 2)) < 1e-6 and min(p_values(x, y, 2)) > 0.001
    s = frame(spark, x=x, y=y)
    got = {(r["caused"]["param1"], r["causing"]["param1"]): r["lags"] for r in granger(s, [2, 3]).collect()}
    assert got == {("y", "x"): [2, 3]}
    cuts = spark.createDataFrame([("ep1", "x", None, 10), ("ep1", "y", None, 12), ("ep1", "y", None, 5)], "property string, param1 string, param2 string, idx int")
    assert [(r["lags"], [tuple(x) for x in r["from_points"]]) for r in granger(s, points=cuts).collect()] == [([2], [(2, 11, 13)])]
    many = frame(spark, **{f"z{i}": rng.normal(size=40) for i in range(7)}, x=x, y=y)
    whole = {(r["caused"]["param1"], r["causing"]["param1"]): r["lags"] for r in granger(many, [1, 2], 0.05).collect()}
    assert whole == {(r["caused"]["param1"], r["causing"]["param1"]): r["lags"] for r in granger(many, [1, 2], 0.05, block=2).collect()} and ("y", "x") in whole
    with pytest.raises(ValueError):
        granger(many, 1, most_pairs=10)
    assert granger(frame(spark, a=[1] * 30, b=range(30))).count() == 0


def test_causality_by_factors_equals_two_regressions():
    """Residual sums of the regressions with and without the other's lags, each solved as a whole."""
    from math import log

    from tidelog.functions.distributions import chi2_tail, f_tail

    rng = np.random.default_rng(8)
    for lag in (1, 3, 7):
        x = rng.normal(size=60).cumsum()
        y = 0.5 * np.roll(x, 1) + rng.normal(size=60)
        rows = np.arange(lag, 60)
        own = np.column_stack([y[rows - k] for k in range(1, lag + 1)] + [np.ones(len(rows))])
        both = np.column_stack([own] + [x[rows - k] for k in range(1, lag + 1)])
        small, large = (float(((y[rows] - d @ np.linalg.lstsq(d, y[rows], rcond=None)[0]) ** 2).sum()) for d in (own, both))
        free, gain = len(rows) - both.shape[1], (small - large) / large
        want = f_tail(gain / lag * free, lag, free), chi2_tail(len(rows) * gain, lag), chi2_tail(len(rows) * log(small / large), lag)
        assert p_values(y, x, lag) == pytest.approx(want, rel=1e-6, abs=1e-12)
    with pytest.raises(ValueError):
        p_values(y, 2 * y, 3)
    with pytest.raises(ValueError):
        p_values(y, np.ones(60), 2)


def test_forecasts(spark):
    assert fit_and_predict(np.arange(30.0), 3) == pytest.approx([30, 31, 32], abs=0.5)
    assert fit_and_predict(np.full(20, 7.0), 2) == pytest.approx([7, 7])
    rng = random.Random(3)
    wave = [10 + [0, 4, 9, 2][i % 4] + rng.random() * 0.1 for i in range(60)]
    s = frame(spark, wave=wave)
    periods = spark.createDataFrame([("ep1", "wave", None, 4)], "property string, param1 string, param2 string, period int")
    train = s.filter("idx < 56")
    got = [r["value"] for r in forecasts(train, periods).orderBy("idx").collect()]
    assert got == pytest.approx(wave[56:], abs=0.5)
    error = accuracy(s, forecasts(train, periods), train).first()
    assert 0 <= error["mase"] < 0.2 and 0 <= error["mape"] < 5


def test_forecasts_with_causes(spark):
    rng = np.random.default_rng(6)
    x = np.tile([1.0, 5, 2, 8], 15)
    y = np.concatenate([[3], 2 * x[1:]]) + rng.normal(0, 0.01, 60)
    s = frame(spark, x=x, y=y)
    side = "struct<property:string,param1:string,param2:string>"
    causes = spark.createDataFrame([(("ep1", "y", None), ("ep1", "x", None), [1])], f"caused {side}, causing {side}, lags array<int>")
    periods = spark.createDataFrame([("ep1", "x", None, 4), ("ep1", "y", None, 0)], "property string, param1 string, param2 string, period int")
    got = forecasts_with_causes(s, periods, causes)
    by = {(r["param1"], r["idx"]): r["value"] for r in got.collect()}
    assert [by["x", 60 + i] for i in range(4)] == pytest.approx([1, 5, 2, 8], abs=0.2)
    assert [by["y", 60 + i] for i in range(4)] == pytest.approx([2, 10, 4, 16], abs=1.0)
