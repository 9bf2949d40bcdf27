"""Granger causality between series."""

from __future__ import annotations

from math import floor, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import chi2_tail, f_tail
from .series import TSID
from .stationarity import lagged


class Own:
    """A caused series regressed on its own lags, factored once for all series that may cause it."""

    def __init__(self, y: np.ndarray, lag: int):
        self.lag, self.n = lag, len(y) - lag
        design = np.hstack([lagged(y, lag), np.ones((self.n, 1))])
        self.q, r = np.linalg.qr(design)
        self.whole = _full_rank(r, design)
        y = y[lag:]
        self.left = y - self.q @ (self.q.T @ y)
        self.small = float(self.left @ self.left)

    def p_values(self, causing: np.ndarray) -> tuple[float, float, float]:
        """By the F test, the chi-squared test and the likelihood ratio: of the lags of ``causing`` only what the own lags don't span is added to the regression."""
        free = self.n - 2 * self.lag - 1
        other = lagged(causing, self.lag)
        rest = other - self.q @ (self.q.T @ other)
        rest -= self.q @ (self.q.T @ rest)
        if free <= 0 or not self.whole:
            raise ValueError("too few values or a constant series")
        q, r = np.linalg.qr(rest)
        if not _full_rank(r, other):
            raise ValueError("too few values or a constant series")
        left = self.left - q @ (q.T @ self.left)
        large = float(left @ left)
        if large <= 1e-12 * max(self.small, 1.0):
            raise ValueError("a perfect fit")
        gain = max(self.small - large, 0.0) / large
        return f_tail(gain / self.lag * free, self.lag, free), chi2_tail(self.n * gain, self.lag), chi2_tail(self.n * log(max(self.small / large, 1.0)), self.lag)


def _full_rank(r: np.ndarray, design: np.ndarray) -> bool:
    """Whether the columns of ``design`` are independent, given the triangle of their (or their rests') factor."""
    scale = np.sqrt((design**2).sum(axis=0)).max(initial=0.0)
    return r.shape[0] >= r.shape[1] and bool(np.abs(np.diagonal(r)).min(initial=np.inf) > max(design.shape) * np.finfo(float).eps * max(scale, 1e-300) * 10)


def p_values(caused: np.ndarray, causing: np.ndarray, lag: int) -> tuple[float, float, float]:
    """That ``causing`` doesn't help to predict ``caused`` with so many lags."""
    return Own(caused, lag).p_values(causing)


def _causal_lags(one: dict, other: dict, wanted, level: float, known: dict) -> list[int]:
    """``known`` keeps the factors of ``one`` by lag, for the places at which they were made."""
    at = sorted(one) if one.keys() == other.keys() else sorted(one.keys() & other.keys())
    limit = floor((len(at) - 1) / 3 - 1)
    if wanted is None:
        lags = range(1, limit + 1)
    elif isinstance(wanted, int):
        lags = range(1, min(wanted, limit) + 1)
    else:
        lags = [x for x in wanted if 0 < x <= limit]
    if known.get("at") != at:
        known.clear()
        known["at"] = at
    y, x = np.array([one[i] for i in at]), np.array([other[i] for i in at])
    out = []
    for lag in lags:
        try:
            if lag not in known:
                known[lag] = Own(y, lag)
            if all(p < level for p in known[lag].p_values(x)):
                out.append(int(lag))
        except (ValueError, np.linalg.LinAlgError):
            return []
    return out


def granger(series: DataFrame, lags: int | list[int] | None = None, level: float = 0.01, points: DataFrame | None = None, block: int = 64, most_pairs: int = 1_000_000) -> DataFrame:
    """(caused, causing: struct of property, param1, param2; lags; from_points): ordered pairs of series for which all tests reject at ``level``.

    ``lags``: None for all up to a third of the length, a number for all up to it, or a list. With ``points`` (change
    points: property, param1, param2, idx) the lags are the distances from a causing to a later caused point, and
    from_points has the pairs of points (lag, causing, caused), counted from 1, behind each lag.

    Every ordered pair is tested by definition, so the number of series decides; more than ``most_pairs`` pairs are
    refused. Series are dealt to blocks, and each pair of blocks is one task's work: a series is sent once for each
    block, not once for each pair.
    """
    id_ = F.struct(*TSID)
    whole = series.groupBy(id_.alias("id")).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("v"))
    whole = whole.select("id", F.col("v.idx").alias("at"), F.col("v.value").alias("values"))
    if points is not None:
        cuts = points.groupBy(id_.alias("p_id")).agg(F.sort_array(F.collect_set(F.col("idx").cast("int"))).alias("cuts"))
        whole = whole.join(cuts, F.col("id").eqNullSafe(F.col("p_id")), "left").drop("p_id").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    else:
        whole = whole.withColumn("cuts", F.array().cast("array<int>"))
    n = whole.count()
    if n * (n - 1) > most_pairs:
        raise ValueError(f"{n} series make {n * (n - 1)} pairs, more than {most_pairs}")
    blocks = max(1, -(-n // block))
    dealt = whole.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    by_points = points is not None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(dict(i), int(b), dict(zip(map(int, a), v, strict=True)), [int(c) for c in cuts]) for i, b, a, v, cuts in zip(pdf["id"], pdf["block"], pdf["at"], pdf["values"], pdf["cuts"], strict=True)]
        across, out = pdf["p"].iloc[0] != pdf["q"].iloc[0], []
        for i, (caused, one_block, y, ends) in enumerate(rows):
            known: dict = {}
            for j, (causing, two_block, x, starts) in enumerate(rows):
                if i == j or (across and one_block == two_block):
                    continue
                pairs = sorted((a - b, b + 1, a + 1) for a in ends for b in starts if a > b) if by_points else []
                found = _causal_lags(y, x, sorted({d for d, _, _ in pairs}) if by_points else lags, level, known)
                if found:
                    out.append((caused, causing, found, [{"lag": d, "causing": b, "caused": a} for d, b, a in pairs if d in found]))
        return pd.DataFrame(out, columns=["caused", "causing", "lags", "from_points"])

    side = "struct<property:string,param1:string,param2:string>"
    return dealt.groupBy("p", "q").applyInPandas(run, f"caused {side}, causing {side}, lags array<int>, from_points array<struct<lag:int,causing:int,caused:int>>")
