"""The analyses of series by their names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.grid import Grid
from .changepoints import change_points
from .forecast import dated, forecasts, forecasts_with_causes
from .granger import granger
from .points import changes_beyond, extremes, quantile_points
from .stationarity import differenced, orders
from .writeback import CHANGE_POINTS, FORECASTING, GRANGER, TECHNIQUES, THRESHOLD_POINTS

THRESHOLDS = {"quantile": quantile_points, "relative change": changes_beyond}


def threshold_points(series: DataFrame, mode: str, operator: str | None = None, one: float | None = None, other: float | None = None, k: int | None = None) -> DataFrame:
    """Points by quantiles or relative changes (with an operator and its thresholds), or the k largest or smallest (nlargest, nsmallest)."""
    if mode in ("nlargest", "nsmallest"):
        if not k or k < 1:
            raise ValueError(f"{mode} needs how many points")
        return extremes(series, k, mode == "nlargest")
    if mode not in THRESHOLDS:
        raise ValueError(f"mode must be one of {(*THRESHOLDS, 'nlargest', 'nsmallest')}")
    if operator is None or one is None:
        raise ValueError(f"{mode} needs an operator and a threshold")
    return THRESHOLDS[mode](series, operator, one, other)


def analyse(series: DataFrame, technique: str, g: Grid, *, causes: DataFrame | None = None, points: DataFrame | None = None, **params) -> DataFrame:
    """Results of a technique on ``series`` (those of ``analysable``); ``params`` are those of its function.

    Change points and threshold points: (property, param1, param2, idx). Granger causality makes series stationary
    first, by their seasonal and first differences; ``points`` gives the lags. Forecasts are dated; with ``causes`` (a
    result of Granger causality) causing series are exogenous.
    """
    if technique == CHANGE_POINTS:
        return change_points(series, **params)
    if technique == THRESHOLD_POINTS:
        return threshold_points(series, **params)
    if technique not in TECHNIQUES:
        raise ValueError(f"technique must be one of {TECHNIQUES}")
    g.needs_forecast_length()
    found = orders(series, g.rate)
    if technique == GRANGER:
        return granger(differenced(series, found), points=points, **params)
    assert technique == FORECASTING
    return dated(forecasts(series, found, **params) if causes is None else forecasts_with_causes(series, found, causes, **params), g)
