"""Change points of series by penalised optimal segmentation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .series import TSID

MODELS = ("rbf", "l1", "l2")


def segment_costs(values: np.ndarray, model: str):
    """A function of (starts, stop): the costs of the segments that end before ``stop``."""
    n = len(values)
    if model == "rbf":
        square = (values[:, None] - values[None, :]) ** 2
        pairs = square[np.triu_indices(n, 1)]
        middle = np.median(pairs) if len(pairs) else 0.0
        scaled = np.clip(square / middle if middle > 0 else square, 1e-2, 1e2)
        np.fill_diagonal(scaled, 0)
        sums = np.zeros((n + 1, n + 1))
        sums[1:, 1:] = np.exp(-scaled).cumsum(0).cumsum(1)

        def rbf(starts: np.ndarray, stop: int) -> np.ndarray:
            size = stop - starts
            return size - (sums[stop, stop] - sums[starts, stop] - sums[stop, starts] + sums[starts, starts]) / size

        return rbf
    if model == "l2":
        one, two = np.concatenate(([0], values.cumsum())), np.concatenate(([0], (values**2).cumsum()))
        return lambda starts, stop: two[stop] - two[starts] - (one[stop] - one[starts]) ** 2 / (stop - starts)
    if model == "l1":
        smallest = smallest_sums(values - np.median(values))
        return lambda starts, stop: -smallest(starts, stop, (stop - starts) // 2, (stop - starts + 1) // 2)
    raise ValueError(f"model must be one of {MODELS}")


def smallest_sums(values: np.ndarray):
    """A function of (starts, stop, low, high): for each segment, the sum of its ``low`` smallest values and that of its ``high`` smallest ones, less the sum of all. Minus that, with half the size rounded down and up, is the distance of all values from their median.

    A wavelet matrix over the ranks of the values: each level sorts by one bit, stably, and keeps how many zeros, of
    which sum, stand before each place. A question walks down the levels, for all starts at once.
    """
    n = len(values)
    ranks = np.empty(n, int)
    ranks[np.argsort(values, kind="stable")] = np.arange(n)
    prefix = lambda x: np.concatenate(([0], np.cumsum(x)))
    total, at, levels = prefix(values), np.arange(n), []
    for bit in range(max(n - 1, 1).bit_length() - 1, -1, -1):
        zero = (ranks[at] >> bit) & 1 == 0
        levels.append((prefix(zero), prefix(np.where(zero, values[at], 0.0))))
        at = np.concatenate((at[zero], at[~zero]))
    leaves = prefix(values[at])

    def sums(starts: np.ndarray, stop: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        left, left_over = np.concatenate((starts, starts)), np.concatenate((low, high))
        right, out = np.full(len(left), stop), np.zeros(len(left))
        for zeros, zero_sums in levels:
            a, b = zeros[left], zeros[right]
            up = left_over > b - a
            out += np.where(up, zero_sums[right] - zero_sums[left], 0.0)
            left_over = left_over - np.where(up, b - a, 0)
            left, right = np.where(up, zeros[-1] + left - a, a), np.where(up, zeros[-1] + right - b, b)
        out += leaves[left + left_over] - leaves[left]
        return out[: len(starts)] + out[len(starts) :] - (total[stop] - total[starts])

    return sums


def segmentation(values: np.ndarray, model: str = "rbf", min_size: int = 3, penalty: float = 1.5, jump: int = 1) -> list[int]:
    """The first places of all segments but the first, of the segmentation with the least cost plus ``penalty`` a segment; segments start at multiples of ``jump``, and starts that can't win any more are pruned."""
    if jump < 1 or min_size < 1:
        raise ValueError("jump and min_size are 1 at least")
    n = len(values)
    if n < 2 * min_size:
        return []
    cost = segment_costs(np.asarray(values, float), model)
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = 0.0
    starts = np.array([0])
    waiting = []  # starts that lie too close to the last stop
    for stop in [*(k for k in range(0, n, jump) if k >= min_size), n]:
        ready = [k for k in waiting if k <= stop - min_size]
        waiting = [k for k in waiting if k > stop - min_size]
        starts = np.append(starts, np.array(ready, int))
        ahead = best[starts] + cost(starts, stop)
        pick = int(np.argmin(ahead))
        best[stop], back[stop] = ahead[pick] + penalty, starts[pick]
        starts = starts[ahead <= best[stop]]
        waiting.append(stop)
    out, at = [], n
    while at > 0:
        at = int(back[at])
        if at:
            out.append(at)
    return out[::-1]


def change_points(series: DataFrame, model: str = "rbf", min_size: int = 3, penalty: float = 1.5, jump: int = 1) -> DataFrame:
    """(property, param1, param2, idx): each series on its own; a series is as long as the grid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        return pdf.iloc[segmentation(pdf["value"].to_numpy(), model, min_size, penalty, jump)][[*TSID, "idx"]]

    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    return series.select(*TSID, "idx", "value").groupBy(*TSID).applyInPandas(run, "property string, param1 string, param2 string, idx int")
