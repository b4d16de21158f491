"""Key frames of a clip: scaling and peaks of foreground shares. A clip is one task where its frames must be in order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scaled(df: DataFrame, value: str, key: str = "clip", name: str = "scaled", digits: int | None = None) -> DataFrame:
    """A value between its clip's least and greatest, from 0 to 1; 0 where they are equal. Rounded where digits are asked for."""
    w = Window.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    out = F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0)
    return df.withColumn(name, out if digits is None else F.bround(out, digits))


def peaks_of(x: np.ndarray, height: float, distance: int, prominence: float) -> np.ndarray:
    """Places of local maxima, middles of flat ones, that are high enough; of near ones the highest; then prominent ones."""
    n, at, i = len(x), [], 1
    while i < n - 1:
        if x[i] > x[i - 1]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                at.append((i + j) // 2)
            i = j
        i += 1
    peaks = np.array([p for p in at if x[p] >= height], np.int64)
    keep = np.ones(len(peaks), bool)
    for k in np.argsort(x[peaks], kind="stable")[::-1] if len(peaks) else []:
        if keep[k]:
            near = np.abs(peaks - peaks[k]) < distance
            near[k] = False
            keep[near] = False
    out = []
    for p in peaks[keep]:
        above_left = np.flatnonzero(x[:p] > x[p])
        above_right = np.flatnonzero(x[p + 1 :] > x[p])
        left = x[above_left[-1] + 1 if len(above_left) else 0 : p + 1].min()
        right = x[p : p + 1 + above_right[0] if len(above_right) else n].min()
        if x[p] - max(left, right) >= prominence:
            out.append(p)
    return np.array(out, np.int64)


def peaks(df: DataFrame, value: str, height: float = 0.3, distance: int = 20, prominence: float = 0.1) -> DataFrame:
    """clip and frame_idx of peaks of a value (clip, frame_idx, value); null values count as 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx", ignore_index=True)
        return pdf.iloc[peaks_of(pdf[value].fillna(0).to_numpy(float), height, distance, prominence)][["clip", "frame_idx"]]

    return df.select("clip", "frame_idx", value).groupBy("clip").applyInPandas(run, "clip long, frame_idx long")
