"""Samples of groups and windows, the same on every run."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_groups(df: DataFrame, keys: Sequence[str], n: int, salt: int = 0) -> DataFrame:
    """All rows of the n groups with the smallest hashes."""
    chosen = df.select(*keys).distinct().orderBy(F.xxhash64(*keys, F.lit(salt)), *keys).limit(n)
    return df.join(chosen, list(keys), "left_semi")


def hashed_share(df: DataFrame, keys: Sequence[str], tenths: int, salt: int = 0) -> DataFrame:
    """The groups whose hash falls in the first tenths."""
    return df.where(F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(10)) < tenths)


def cover(points: np.ndarray, strata: np.ndarray, n: int) -> list[int]:
    """Indices of n points: strata in turn, each giving its first; then whatever is
    farthest from what was chosen."""
    groups: dict[tuple, list[int]] = {}
    for i, s in enumerate(map(tuple, strata)):
        groups.setdefault(s, []).append(i)
    chosen: list[int] = []
    turns = [groups[k] for k in sorted(groups)]
    for turn in turns:
        if len(chosen) < n:
            chosen.append(turn[0])
    if not len(points) or len(chosen) >= min(n, len(points)):
        return sorted(chosen)
    gap = np.min([np.linalg.norm(points - points[i], axis=1) for i in chosen], axis=0)
    while len(chosen) < min(n, len(points)):
        gap[chosen] = -1
        far = int(gap.argmax())
        chosen.append(far)
        gap = np.minimum(gap, np.linalg.norm(points - points[far], axis=1))
    return sorted(chosen)


def covering_windows(windows: DataFrame, n: int, bins: int = 3) -> DataFrame:
    """n windows of each flight that cover its drift, length and time.

    ``windows`` has drift_magnitude, duration_ms and start_ms.
    """
    schema = windows.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_ms", "win_id"]).reset_index(drop=True)
        raw = pdf[["drift_magnitude", "duration_ms", "start_ms"]].to_numpy(float)
        spread = np.ptp(raw, axis=0)
        unit = (raw - raw.min(axis=0)) / np.where(spread > 0, spread, 1)
        return pdf.iloc[cover(unit, np.minimum((unit * bins).astype(int), bins - 1), n)]

    return windows.groupBy("tail_id", "flight_id").applyInPandas(run, schema)
