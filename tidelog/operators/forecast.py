"""Forecasts of series by seasonal autoregressive moving-average models, and their accuracy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid
from .arima import CRITERIA, predict, search
from .series import TSID
from .stationarity import first_differences

FORECAST = "property string, param1 string, param2 string, idx int, value double"


MOST, LEAST = (3, 2, 1, 1), (0, 0, 0, 0)


def fit_and_predict(values: np.ndarray, horizon: int, period: int = 0, most: tuple[int, int, int, int] = MOST, exogenous: np.ndarray | None = None, future: np.ndarray | None = None, least: tuple[int, int, int, int] = LEAST, criterion: str = "aicc") -> np.ndarray:
    """The next ``horizon`` values. Orders (p, q, P, Q) from ``least`` to ``most`` are searched stepwise by an information criterion; each model is fitted by exact maximum likelihood (``arima``). Exogenous columns are regressors of the differenced series, as they are, with their future values; their errors are the ARMA process."""
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}")
    if any(a > b for a, b in zip(least, most, strict=True)):
        raise ValueError("a least order lies above the most")
    y = np.asarray(values, float)
    base = y
    if period:
        y = y[period:] - y[:-period]
    try:
        d = first_differences(y) or 0
    except ValueError:
        d = 0
    history = [y]
    for _ in range(d):
        history.append(np.diff(history[-1]))
    z = history[-1]
    x = None if exogenous is None else exogenous[len(base) - len(z) :]
    n = len(z)
    if n < 6 or np.ptp(z) == 0:
        steps = np.full(horizon, z.mean() if n else 0.0)
    else:
        one = np.ones((n, 1))
        design, ahead = (one, np.ones((horizon, 1))) if x is None else (np.hstack([one, x]), np.hstack([np.ones((horizon, 1)), future]))
        center, width = z.mean(), z.std()
        model = search((z - center) / width, period, least, most, criterion, design)
        steps = center + width * predict(model, (z - center) / width, design, ahead)
    for level in reversed(history[:-1]):
        steps = level[-1] + steps.cumsum()
    if period:
        known = list(base[-period:])
        for s in steps:
            known.append(known[-period] + s)
        steps = np.array(known[period:])
    return steps


def forecasts(series: DataFrame, periods: DataFrame, horizon: int = 4, most: tuple[int, int, int, int] = MOST, least: tuple[int, int, int, int] = LEAST, criterion: str = "aicc") -> DataFrame:
    """Forecasts of each series on its own, behind its last place; ``periods`` (property, param1, param2, period) are those of ``orders``. ``dated`` gives their days, ``appended`` the longer series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        values = fit_and_predict(pdf["value"].to_numpy(), horizon, int(pdf["period"].iloc[0]), most, None, None, least, criterion)
        head = pdf.iloc[[0] * horizon][list(TSID)].reset_index(drop=True)
        return head.assign(idx=[int(pdf["idx"].iloc[-1]) + 1 + i for i in range(horizon)], value=values)

    return _with_period(series, periods).groupBy(*TSID).applyInPandas(run, FORECAST)


def _with_period(series: DataFrame, periods: DataFrame) -> DataFrame:
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in TSID]
    return series.alias("s").join(periods.alias("o"), same, "left").select(*[F.col(f"s.{c}").alias(c) for c in (*TSID, "idx", "value")], F.coalesce("o.period", F.lit(0)).alias("period"))


def dated(predicted: DataFrame, g: Grid) -> DataFrame:
    """With ``t``, the right edge of the interval of each row, behind the grid."""
    return predicted.withColumn("t", g.right(F.col("idx")))


def appended(series: DataFrame, predicted: DataFrame) -> DataFrame:
    """(property, param1, param2, idx, value) of the series with their forecasts behind them."""
    return series.select(*TSID, "idx", "value").unionByName(predicted.select(*TSID, "idx", "value"))


def forecasts_with_causes(series: DataFrame, periods: DataFrame, causes: DataFrame, horizon: int = 4, most: tuple[int, int, int, int] = MOST, least: tuple[int, int, int, int] = LEAST, criterion: str = "aicc") -> DataFrame:
    """Two passes: the univariate forecasts of the causing series are the future values of the exogenous columns of the caused ones. ``causes`` is a result of ``granger``; a series without causes keeps its univariate forecast."""
    alone = forecasts(series, periods, horizon, most, least, criterion)
    id_ = F.struct(*TSID)
    values = appended(series, alone).groupBy(id_.alias("cause_id")).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("by_place"))
    columns = causes.select("caused", "causing").join(values, F.col("causing").eqNullSafe(F.col("cause_id"))).groupBy("caused").agg(F.array_sort(F.collect_list(F.struct("causing", F.map_entries("by_place").alias("values")))).alias("columns"))
    own = _with_period(series, periods).groupBy(id_.alias("id")).agg(F.first("period").alias("period"), F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("values"))

    @F.pandas_udf("array<double>")
    def predict(values: pd.Series, period: pd.Series, columns: pd.Series) -> pd.Series:
        out = []
        for v, s, c in zip(values, period, columns, strict=True):
            at = [r["idx"] for r in v]
            maps = [{r["key"]: r["value"] for r in x["values"]} for x in c]
            ahead = range(at[-1] + 1, at[-1] + 1 + horizon)
            table = lambda places, maps=maps: np.array([[m.get(i, 0.0) for m in maps] for i in places])
            out.append(fit_and_predict(np.array([r["value"] for r in v]), horizon, int(s), most, table(at), table(ahead), least, criterion))
        return pd.Series([list(map(float, x)) for x in out])

    joined = own.join(columns, F.col("id").eqNullSafe(F.col("caused")))
    caused = joined.select("id", F.element_at("values", -1)["idx"].alias("last"), F.posexplode(predict("values", "period", "columns")).alias("i", "value"))
    caused = caused.select("id.*", (F.col("last") + 1 + F.col("i")).alias("idx"), "value")
    ids = causes.select(F.col("caused").alias("c")).distinct()
    rest = alone.join(ids, id_.eqNullSafe(F.col("c")), "left_anti")
    return rest.unionByName(caused)


def accuracy(series: DataFrame, predicted: DataFrame, train: DataFrame) -> DataFrame:
    """(property, param1, param2, mase, mape): of forecasts against the true values at their places, rounded to two places; mase is scaled by the mean step of ``train``. Series with a true value below 0.001 are left out."""
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy(*TSID).orderBy("idx")))
    scale = train.withColumn("step", step).groupBy(*TSID).agg(F.avg("step").alias("scale"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in TSID]
    both = series.alias("s").join(predicted.alias("f"), [*same("s", "f"), F.col("s.idx") == F.col("f.idx")]).select("s.*", F.col("f.value").alias("forecast"))
    error = F.abs(F.col("value") - F.col("forecast"))
    errors = both.groupBy(*TSID).agg(F.avg(error).alias("mae"), F.avg(error / F.greatest(F.abs("value"), F.lit(1e-300))).alias("mape"), F.min("value").alias("low")).filter("low >= 0.001")
    joined = errors.alias("e").join(scale.alias("t"), same("e", "t"))
    return joined.select(*[F.col(f"e.{c}").alias(c) for c in TSID], F.round(F.try_divide("mae", "scale"), 2).alias("mase"), F.round(F.col("mape") * 100, 2).alias("mape"))


def accuracy_table(errors: DataFrame, *by: str) -> DataFrame:
    """Mean and median of mase and mape of ``errors`` (by, mase, mape), such as by log and experiment."""
    stats = [f(c).alias(f"{c}_{name}") for c in ("mase", "mape") for name, f in (("mean", F.avg), ("median", F.median))]
    return errors.groupBy(*by).agg(F.count("*").alias("n_series"), *stats)


def exogenous_counts(series: DataFrame, causes: DataFrame) -> DataFrame:
    """(property, param1, param2, n_causes) of each series: how many others it takes as exogenous, 0 without a cause."""
    counts = causes.select("caused", "causing").distinct().groupBy("caused").agg(F.count("*").alias("n_causes"))
    ids = series.select(*TSID).distinct().withColumn("id", F.struct(*TSID))
    return ids.join(counts, F.col("id").eqNullSafe(F.col("caused")), "left").select(*TSID, F.coalesce("n_causes", F.lit(0)).alias("n_causes"))
