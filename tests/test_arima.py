"""Likelihood of seasonal ARMA models against the multivariate normal density."""

import numpy as np
import pytest

from tidelog.operators.arima import _coefficients, coefficients, filtered, fit, likelihood, predict, search


def covariance(ar, ma, n):
    """Of n values, from the moving average of infinite order that the process is."""
    weights = np.zeros(3000)
    for i in range(len(weights)):
        weights[i] = (i == 0) + (ma[i - 1] if 0 < i <= len(ma) else 0.0) + sum(ar[j] * weights[i - 1 - j] for j in range(min(len(ar), i)))
    gamma = [float(weights[: len(weights) - k] @ weights[k:]) for k in range(n)]
    return np.array([[gamma[abs(i - j)] for j in range(n)] for i in range(n)])


@pytest.mark.parametrize("order,period", [((1, 0, 0, 0), 0), ((2, 1, 0, 0), 0), ((0, 2, 0, 0), 0), ((1, 1, 1, 1), 4), ((0, 1, 0, 1), 3), ((0, 0, 0, 0), 0)])
def test_likelihood_is_that_of_the_normal_density(order, period):
    rng = np.random.default_rng(sum(order) + period)
    ar, ma = coefficients(rng.normal(0, 0.5, sum(order)), order, period)
    n = 14
    y, x = rng.normal(size=n), np.column_stack([np.ones(n), rng.normal(size=n)])
    found, beta, scale = likelihood(y, x, ar, ma)
    whole = covariance(ar, ma, n)
    inverse = np.linalg.inv(whole)
    assert beta == pytest.approx(np.linalg.solve(x.T @ inverse @ x, x.T @ inverse @ y), abs=1e-8)
    left = y - x @ beta
    assert scale == pytest.approx(left @ inverse @ left / n, rel=1e-8)
    density = lambda s: -0.5 * (n * np.log(2 * np.pi) + np.linalg.slogdet(s * whole)[1] + left @ inverse @ left / s)
    assert found == pytest.approx(density(scale), rel=1e-9) and found >= density(scale * 1.1)
    # One step ahead is the conditional mean.
    state = filtered(left[:, None], ar, ma)[2]
    longer = covariance(ar, ma, n + 1)
    assert state[0, 0] == pytest.approx(longer[n, :n] @ np.linalg.solve(longer[:n, :n], left), abs=1e-8)


def test_partial_autocorrelations_give_stationary_models():
    rng = np.random.default_rng(1)
    for _ in range(50):
        c = _coefficients(rng.normal(0, 2, rng.integers(1, 5)))
        assert np.abs(np.roots(np.r_[1.0, -c])).max() < 1


def simulated(ar, ma, n, rng):
    e, y = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(30, len(y)):
        y[t] = e[t] + sum(a * y[t - 1 - i] for i, a in enumerate(ar)) + sum(b * e[t - 1 - i] for i, b in enumerate(ma))
    return y[200:]


def test_coefficients_of_simulated_series_are_found():
    rng = np.random.default_rng(2)
    ones = np.ones((600, 1))
    model = fit(simulated([0.6, -0.3], [], 600, rng) + 5, (2, 0, 0, 0), 0, ones)
    assert coefficients(model.free, model.order, 0)[0] == pytest.approx([0.6, -0.3], abs=0.12) and model.beta[0] == pytest.approx(5, abs=0.3)
    model = fit(simulated([], [0.7], 600, rng), (0, 1, 0, 0), 0, ones)
    assert coefficients(model.free, model.order, 0)[1] == pytest.approx([0.7], abs=0.1)
    seasonal = coefficients(np.arctanh([0.5 / 0.998, 0.6 / 0.998]), (1, 0, 1, 0), 4)[0]
    model = fit(simulated(seasonal, [], 600, rng), (1, 0, 1, 0), 4, ones)
    assert 0.998 * np.tanh(model.free) == pytest.approx([0.5, 0.6], abs=0.12)
    x = np.column_stack([np.ones(300), rng.normal(size=300)])
    model = fit(x @ [1.0, 3.0] + simulated([0.8], [], 300, rng), (1, 0, 0, 0), 0, x)
    assert model.beta[1] == pytest.approx(3, abs=0.15)


def test_search_finds_the_best_of_all_orders_nearby():
    rng = np.random.default_rng(3)
    y, one = simulated([0.7], [0.4], 250, rng), np.ones((250, 1))
    found = search(y, 0, (0, 0, 0, 0), (2, 2, 0, 0), "aicc", one)
    every = {(p, q): fit(y, (p, q, 0, 0), 0, one).criterion("aicc", 250) for p in range(3) for q in range(3)}
    assert found.criterion("aicc", 250) <= min(every.values()) + 2 and sum(found.order) >= 1
    ahead = predict(found, y, one, np.ones((50, 1)))
    assert len(ahead) == 50 and ahead[-1] == pytest.approx(found.beta[0], abs=0.2)
    short = search(np.arange(6.0) % 2, 4, (0, 0, 0, 0), (3, 2, 1, 1), "aicc", np.ones((6, 1)))
    assert np.isfinite(predict(short, np.arange(6.0) % 2, np.ones((6, 1)), np.ones((3, 1)))).all()
