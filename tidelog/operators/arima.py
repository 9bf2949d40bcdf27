"""Seasonal autoregressive moving-average models by exact maximum likelihood.

A model with regressors is a linear state space: the Kalman filter gives one-step errors and their variances, and with
them the likelihood. Scale and regression coefficients have closed forms given the others: the filter runs over the
series and over each regressor, and its errors are regressed on each other. What is left are the coefficients of the
four polynomials, as partial autocorrelations, so that every model is stationary and invertible; they are found by
BFGS. Orders are searched stepwise, from a few starting points to the best neighbour until none is better.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log, pi

import numpy as np

CRITERIA = ("aicc", "aic", "bic")
#: The largest partial autocorrelation; nearer to 1 the stationary variance can't be told apart from infinity.
_MOST = 0.998


def _coefficients(free: np.ndarray) -> np.ndarray:
    """Unbounded numbers to the coefficients of a stationary autoregression, by the Durbin-Levinson recursion over partial autocorrelations."""
    out = np.zeros(0)
    for r in _MOST * np.tanh(free):
        out = np.append(out - r * out[::-1], r)
    return out


def _polynomial(short: np.ndarray, seasonal: np.ndarray, period: int) -> np.ndarray:
    """Coefficients of the product of 1 - sum short_i B^i and 1 - sum seasonal_j B^(period j), as of one autoregression."""
    a, b = np.r_[1.0, -short], np.zeros(len(seasonal) * max(period, 1) + 1)
    b[0] = 1.0
    b[max(period, 1) :: max(period, 1)] = -seasonal
    return -np.convolve(a, b)[1:]


def coefficients(free: np.ndarray, order: tuple[int, int, int, int], period: int) -> tuple[np.ndarray, np.ndarray]:
    """(ar, ma) of the multiplied polynomials; the moving average is 1 + sum ma_i B^i."""
    p, q, sp, sq = order
    parts = [_coefficients(x) for x in np.split(free, np.cumsum([p, q, sp]))]
    return _polynomial(parts[0], parts[2], period), -_polynomial(parts[1], parts[3], period)


def filtered(columns: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(errors, variances, state, transition): the Kalman filter of an ARMA process with innovations of variance 1 over each of ``columns``; state is the mean of the next one's."""
    size = max(len(ar), len(ma) + 1, 1)
    move = np.zeros((size, size))
    move[: len(ar), 0] = ar
    move[np.arange(size - 1), np.arange(1, size)] = 1.0
    load = np.zeros(size)
    load[0], load[1 : len(ma) + 1] = 1.0, ma
    noise = np.outer(load, load)
    spread, power = noise.copy(), move.copy()
    for _ in range(60):  # the stationary variance, by doubling
        more = power @ spread @ power.T
        spread = spread + more
        power = power @ power
        if np.abs(more).max() <= 1e-14 * np.abs(spread).max():
            break
    n, k = columns.shape
    state, errors, variances = np.zeros((size, k)), np.empty((n, k)), np.empty(n)
    steady = False
    for t in range(n):
        errors[t] = columns[t] - state[0]
        if not steady:
            variances[t] = spread[0, 0]
            gain = move @ spread[:, 0] / spread[0, 0]
            after = move @ spread @ move.T + noise - np.outer(gain, gain) * spread[0, 0]
            steady = np.abs(after - spread).max() < 1e-12
            spread = after
        else:
            variances[t] = variances[t - 1]
        state = move @ state + gain[:, None] * errors[t]
    return errors, variances, state, move


@dataclass
class Fit:
    order: tuple[int, int, int, int]
    period: int
    free: np.ndarray
    beta: np.ndarray
    scale: float
    log_likelihood: float

    @property
    def size(self) -> int:
        return len(self.free) + len(self.beta) + 1

    def criterion(self, name: str, n: int) -> float:
        if name == "bic":
            return -2 * self.log_likelihood + self.size * log(n)
        more = 2 * self.size * (self.size + 1) / (n - self.size - 1) if name == "aicc" and n > self.size + 1 else float("inf") if name == "aicc" else 0.0
        return -2 * self.log_likelihood + 2 * self.size + more


def likelihood(y: np.ndarray, x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[float, np.ndarray, float]:
    """(log-likelihood, beta, scale) of y = x beta + ARMA errors, at the best beta and variance of the innovations."""
    errors, variances, _, _ = filtered(np.column_stack([y, x]), ar, ma)
    if not (np.isfinite(errors).all() and (variances > 0).all()):
        return -1e12, np.zeros(x.shape[1]), 1.0
    white = errors / np.sqrt(variances)[:, None]
    beta = np.linalg.lstsq(white[:, 1:], white[:, 0], rcond=None)[0] if x.shape[1] else np.zeros(0)
    left = white[:, 0] - white[:, 1:] @ beta
    scale = max(float(left @ left) / len(y), 1e-12)
    return -0.5 * (len(y) * (log(2 * pi * scale) + 1) + float(np.log(variances).sum())), beta, scale


def _minimum(f, start: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
    """BFGS with central differences and halved steps."""
    at, value = start, f(start)
    inverse = np.eye(len(at))

    def slope(x: np.ndarray) -> np.ndarray:
        return np.array([(f(x + h) - f(x - h)) / 2e-5 for h in np.eye(len(x)) * 1e-5])

    gradient = slope(at)
    for _ in range(steps):
        if np.abs(gradient).max(initial=0.0) < 1e-4:
            break
        way = -inverse @ gradient
        if way @ gradient >= 0:
            inverse, way = np.eye(len(at)), -gradient
        way *= min(1.0, 2.0 / np.abs(way).max())
        size = 1.0
        while size > 1e-6 and not f(at + size * way) < value + 1e-4 * size * (way @ gradient):
            size /= 2
        if size <= 1e-6:
            break
        step = size * way
        new = slope(at + step)
        turn, at = new - gradient, at + step
        gain, gradient = value, new
        value = f(at)
        if (bend := step @ turn) > 1e-12:
            one = np.eye(len(at)) - np.outer(step, turn) / bend
            inverse = one @ inverse @ one.T + np.outer(step, step) / bend
        if gain - value < 1e-7:
            break
    return at, value


def fit(y: np.ndarray, order: tuple[int, int, int, int], period: int = 0, x: np.ndarray | None = None) -> Fit:
    """The model of ``order`` (p, q, P, Q) with the largest likelihood; ``x`` are regressors, a constant among them if there is to be one."""
    x = np.empty((len(y), 0)) if x is None else x

    def lost(free: np.ndarray) -> float:
        return -likelihood(y, x, *coefficients(free, order, period))[0]

    free, _ = _minimum(lost, np.full(sum(order), 0.1)) if sum(order) else (np.zeros(0), 0.0)
    best, beta, scale = likelihood(y, x, *coefficients(free, order, period))
    return Fit(order, period, free, beta, scale, best)


def search(y: np.ndarray, period: int, least: tuple[int, ...], most: tuple[int, ...], criterion: str, x: np.ndarray) -> Fit:
    """Stepwise: the best of a few starting orders, then of its neighbours (one order up or down, or p and q, P and Q together) until none is better."""
    least, most = (tuple(z[:2]) + (tuple(z[2:]) if period else (0, 0)) for z in (least, most))
    known: dict[tuple[int, ...], Fit | None] = {}

    def score(order: tuple[int, ...]) -> float:
        order = tuple(order)
        if order not in known:
            longest = max(order[0] + period * order[2], order[1] + period * order[3])
            known[order] = fit(y, order, period, x) if longest < len(y) - 1 and sum(order) + x.shape[1] + 2 < len(y) else None
        return known[order].criterion(criterion, len(y)) if known[order] is not None else float("inf")

    inside = lambda o: all(a <= v <= b for a, v, b in zip(least, o, most, strict=True))
    starts = {tuple(min(max(v, a), b) for a, v, b in zip(least, o, most, strict=True)) for o in ((2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1))}
    now = min(sorted(starts), key=score)
    moves = [tuple(s if i in at else 0 for i in range(4)) for at in ((0,), (1,), (2,), (3,), (0, 1), (2, 3)) for s in (-1, 1)]
    while True:
        near = [o for m in moves if inside(o := tuple(a + b for a, b in zip(now, m, strict=True)))]
        best = min(near, key=score, default=now)
        if not score(best) < score(now) - 1e-9:
            break
        now = best
    return known[now] or Fit(now, period, np.zeros(0), np.zeros(x.shape[1]), 1.0, float("-inf"))


def predict(model: Fit, y: np.ndarray, x: np.ndarray, future: np.ndarray) -> np.ndarray:
    """The means of the values behind ``y``, one for each row of ``future`` regressors."""
    if model.log_likelihood == float("-inf"):
        return np.full(len(future), y.mean())
    ar, ma = coefficients(model.free, model.order, model.period)
    _, _, state, move = filtered((y - x @ model.beta)[:, None], ar, ma)
    out = []
    for row in future:
        out.append(float(state[0, 0] + row @ model.beta))
        state = move @ state
    return np.array(out)
