"""Seasonal periods and orders of differencing of series, by unit-root tests."""

from __future__ import annotations

from math import ceil, exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import normal_cdf
from .series import TSID

#: The smallest seasonal period of each sampling rate.
LEAST_PERIOD = {"D": 7, "W": 4, "ME": 3, "QE": 2, "YE": 2}
MOST_DIFFERENCES = 2


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients, sum of squared residuals, their standard errors)."""
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rest = y - x @ beta
    ssr = float(rest @ rest)
    spread = np.diag(np.linalg.pinv(x.T @ x)) * ssr / max(len(y) - x.shape[1], 1)
    return beta, ssr, np.sqrt(np.maximum(spread, 0))


def lagged(y: np.ndarray, lags: int) -> np.ndarray:
    """Columns of y 1 to ``lags`` steps back, for y[lags:]."""
    return np.column_stack([y[lags - k : len(y) - k] for k in range(1, lags + 1)]) if lags else np.empty((len(y), 0))


def adf_p_value(values: np.ndarray) -> float:
    """Of the augmented Dickey-Fuller test with a constant, the number of lags by AIC."""
    y = np.asarray(values, float)
    step, n = np.diff(y), len(y)
    most = min(ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if most < 0 or np.ptp(y) == 0:
        raise ValueError("too short or constant")

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        rows = len(step) - skip
        x = np.column_stack([y[skip : skip + rows], *[step[skip - k : skip - k + rows] for k in range(1, lags + 1)], np.ones(rows)])
        return x, step[skip:]

    def aic(lags: int) -> float:
        x, d = design(lags, most)
        ssr = least_squares(x, d)[1]
        return len(d) * log(max(ssr, 1e-300) / len(d)) + 2 * x.shape[1]

    lags = min(range(most + 1), key=aic)
    beta, _, error = least_squares(*design(lags, lags))
    tau = beta[0] / error[0] if error[0] > 0 else -np.inf
    # Response surface of the test's p-value with a constant.
    if tau > 2.74:
        return 1.0
    if tau < -18.83:
        return 0.0
    surface = (2.1659, 1.4412, 0.038269) if tau <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
    return normal_cdf(sum(c * tau**i for i, c in enumerate(surface)))


def kpss_p_value(values: np.ndarray) -> float:
    """Of the KPSS test around a constant, between 0.01 and 0.1; the number of lags follows the data."""
    y = np.asarray(values, float)
    n = len(y)
    rest = y - y.mean()
    if not rest.any():
        raise ValueError("constant")
    total, weighted = float(rest @ rest) / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        product = 2 * float(rest[i:] @ rest[:-i]) / n
        total, weighted = total + product, weighted + i * product
    ratio = weighted / total
    lags = min(int(1.1447 * (ratio * ratio) ** (1 / 3) * n ** (1 / 3)), n - 1)
    variance = float(rest @ rest) / n + sum(2 * (1 - i / (lags + 1)) * float(rest[i:] @ rest[:-i]) / n for i in range(1, lags + 1))
    statistic = float((rest.cumsum() ** 2).sum()) / n**2 / variance
    # The test's critical values.
    return float(np.interp(statistic, (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)))


def first_differences(values: np.ndarray, level: float = 0.05) -> int | None:
    """How often to difference until both tests find the series stationary (one of them suffices at last); None if never."""
    y = np.asarray(values, float)
    for order in range(MOST_DIFFERENCES + 1):
        adf = adf_p_value(y) < level
        try:
            kpss = kpss_p_value(y) > level
        except ValueError:
            kpss = True
        if (adf and kpss) or (order == MOST_DIFFERENCES and (adf or kpss)):
            return order
        y = np.diff(y)
    return None


def seasonal(values: np.ndarray, period: int, most_lags: int = 3) -> bool:
    """Whether the test of Osborn, Chui, Smith and Birchenhall asks for a seasonal difference; lags by AIC."""
    x = np.asarray(values, float)
    both = np.diff(x[period:] - x[:-period])

    def fit(lags: int) -> tuple[float, float]:
        ar = least_squares(lagged(both, lags), both[lags:])[0] if lags else np.empty(0)

        def filtered(y: np.ndarray) -> np.ndarray:
            return y[lags:] - lagged(y, lags) @ ar if lags else y

        z4, z5 = filtered(x[period:] - x[:-period]), filtered(np.diff(x))
        target, own = both[lags:], lagged(both, lags)
        # z4 one step back, z5 one period back, aligned at their ends with the target
        rows = min(len(target), len(z4) - 1, len(z5) - period)
        design = np.column_stack([own[len(target) - rows :], z4[-rows - 1 : -1], z5[len(z5) - period - rows : len(z5) - period]])
        target = target[len(target) - rows :]
        if rows <= design.shape[1]:
            raise ValueError("too short")
        beta, ssr, error = least_squares(design, target)
        return rows * log(max(ssr, 1e-300) / rows) + 2 * design.shape[1], beta[-1] / error[-1]

    fits = []
    for lags in range(most_lags + 1):
        try:
            fits.append(fit(lags))
        except (ValueError, np.linalg.LinAlgError):
            continue
    if not fits:
        raise ValueError("too short")
    # The critical value as a function of the period.
    away = log(period) - 0.7656451
    critical = -0.2937411 * exp(-0.2850853 * away - 0.05983644 * away * away) - 1.652202
    return min(fits)[1] > critical


def seasonal_period(values: np.ndarray, rate: str) -> int:
    """The longest period, up to a quarter of the series, for which the test asks for a difference; 0 for none."""
    least, most = LEAST_PERIOD[rate], len(values) // 4
    for period in range(most, least - 1, -1) if most > least else ():
        try:
            if seasonal(values, period):
                return period
        except (ValueError, np.linalg.LinAlgError, ZeroDivisionError):
            continue
    return 0


def orders(series: DataFrame, rate: str) -> DataFrame:
    """(property, param1, param2, period, differences): differences of the series after its seasonal difference, null if it can't be made stationary. Series of threshold points stay as they are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("idx")["value"].to_numpy()
        period, times = 0, 0
        if not str(pdf["property"].iloc[0]).startswith("Threshold Based Points"):
            period = seasonal_period(values, rate)
            try:
                times = first_differences(values[period:] - values[:-period] if period else values)
            except ValueError:
                times = None
        return pdf.iloc[:1][list(TSID)].assign(period=period, differences=pd.array([times], "Int32"))

    return series.select(*TSID, "idx", "value").groupBy(*TSID).applyInPandas(run, "property string, param1 string, param2 string, period int, differences int")


def differenced(series: DataFrame, found: DataFrame) -> DataFrame:
    """The series differenced as ``found`` (of ``orders``) says; series without an order are dropped."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        values, period = pdf["value"].to_numpy(), int(pdf["period"].iloc[0])
        values = np.diff(values[period:] - values[:-period] if period else values, int(pdf["differences"].iloc[0]))
        return pdf.iloc[len(pdf) - len(values) :][[*TSID, "idx"]].assign(value=values)

    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in TSID]
    joined = series.alias("s").join(found.filter("differences is not null").alias("o"), same).select("s.*", "o.period", "o.differences")
    return joined.select(*TSID, "idx", "value", "period", "differences").groupBy(*TSID).applyInPandas(run, "property string, param1 string, param2 string, idx int, value double")
