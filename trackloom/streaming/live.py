"""Structured Streaming forms of segmentation, sampling rates and filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import aeqd, aeqd_back
from ..schema import KEY, LAT, LON, SEQ, TIME


def session_segments(points: DataFrame, gap_seconds: int = 30, min_points: int = 20, late: str = "10 minutes") -> DataFrame:
    """Segments (traj_id, t0, t1, n) that end when no fix came for ``gap_seconds``; late fixes count up to ``late``.

    A session ends at a gap of exactly its length, a segment only beyond: the
    window is a millisecond longer.
    """
    window = F.session_window(TIME, f"{int(gap_seconds * 1000) + 1} milliseconds")
    out = points.withWatermark(TIME, late).groupBy(KEY, window.alias("w")).agg(F.min(TIME).alias("t0"), F.max(TIME).alias("t1"), F.count("*").alias("n"))
    return out.where(F.col("n") > min_points).select(KEY, "t0", "t1", "n")


def running_rate(points: DataFrame) -> DataFrame:
    """Mean seconds between fixes of each trajectory so far, updated with every batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, low, high = state.get if state.exists else (0, 2**62, -(2**62))
        for pdf in batches:
            t = pdf["t"]
            n, low, high = n + len(t), min(low, int(t.min())), max(high, int(t.max()))
        state.update((n, low, high))
        yield pd.DataFrame({KEY: [key[0]], "n": [n], "rate_s": [round((high - low) / 1e6 / (n - 1), 3) if n > 1 else -1.0]})

    kind = points.schema[KEY].dataType.simpleString()
    picked = points.select(KEY, F.unix_micros(TIME).alias("t"))
    return picked.groupBy(KEY).applyInPandasWithState(update, f"{KEY} {kind}, n long, rate_s double", "n long, low long, high long", "update", "NoTimeout")


def forward_filter(points: DataFrame, process_noise_std_m: float = 1.0, measurement_noise_std_m: float = 10.0) -> DataFrame:
    """Forward Kalman estimates of fixes as they come; fixes older than the last one of their trajectory are passed by."""
    q0 = process_noise_std_m**2
    q = np.diag([q0, max(0.01 * q0, 1e-6)] * 2)
    r = np.eye(2) * measurement_noise_std_m**2
    h = np.array([[1.0, 0, 0, 0], [0, 0, 1.0, 0]])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else None
        for pdf in batches:
            rows = []
            for t, seq, lat, lon in pdf.sort_values(["t", SEQ])[["t", SEQ, LAT, LON]].itertuples(index=False):
                if held is None:
                    held = [t, lat, lon, [0.0] * 4, (np.diag([r[0, 0], 1, r[1, 1], 1])).ravel().tolist()]
                elif t >= held[0]:
                    dt = max(1.0, (t - held[0]) / 1e6)
                    move = np.eye(4)
                    move[0, 1] = move[2, 3] = dt
                    x, p = move @ np.array(held[3]), move @ np.array(held[4]).reshape(4, 4) @ move.T + q
                    z = np.array([float(v) for v in aeqd(lat, lon, held[1], held[2])])
                    gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
                    held[0], held[3], held[4] = t, (x + gain @ (z - h @ x)).tolist(), ((np.eye(4) - gain @ h) @ p).ravel().tolist()
                else:
                    continue
                a, o = aeqd_back(held[3][0], held[3][2], held[1], held[2])
                rows.append((key[0], seq, t, float(a), float(o)))
            yield pd.DataFrame(rows, columns=[KEY, SEQ, "t", LAT, LON])
        if held:
            state.update(tuple(held))

    kind = points.schema[KEY].dataType.simpleString()
    picked = points.where(F.col(LAT).isNotNull() & F.col(LON).isNotNull()).select(KEY, F.unix_micros(TIME).alias("t"), SEQ, LAT, LON)
    out = picked.groupBy(KEY).applyInPandasWithState(update, f"{KEY} {kind}, {SEQ} long, t long, {LAT} double, {LON} double", "t long, lat0 double, lon0 double, x array<double>, p array<double>", "append", "NoTimeout")
    return out.select(KEY, SEQ, F.timestamp_micros("t").alias(TIME), LAT, LON)
