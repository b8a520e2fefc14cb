"""Spatio-temporal clustering compression and the neighbourhood join under it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geodesy import SPHERE, aeqd, earth_centred, inverse, inverse_stages, mercator, staged, with_distance_batched
from ..schema import KEY, LAT, LON, SEQ, TIME


def projected(points: DataFrame, use_aeqd: bool = True) -> DataFrame:
    """``x`` and ``y`` in metres: azimuthal equidistant about the trajectory's mean point, or Web Mercator."""
    if not use_aeqd:
        return points.withColumns({"x": F.lit(SPHERE) * F.radians(LON), "y": F.lit(SPHERE) * F.ln(F.tan(F.lit(np.pi / 4) + F.radians(LAT) / 2))})
    whole = Window.partitionBy(KEY)
    out = points.withColumns({"__lat0": F.avg(LAT).over(whole), "__lon0": F.avg(LON).over(whole)})
    out = with_distance_batched(out, "__lat0", "__lon0", LAT, LON, "__c")
    angle = F.radians(F.coalesce("__c_az", F.lit(0.0)))
    return out.withColumns({"x": F.col("__c_m") * F.sin(angle), "y": F.col("__c_m") * F.cos(angle)}).drop("__lat0", "__lon0", "__c_m", "__c_az")


def neighbour_pairs(points: DataFrame, radius: float, seconds: float | None = None, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Pairs (seq_a < seq_b) of a trajectory's points within ``radius`` of each other in ``x, y``, and ``seconds`` in time.

    Points meet in grid cells as wide as the radius: one side is put into the
    nine cells around it, so that this is an equi-join with a remainder, never a product.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("long")
    base = points.select(*by, SEQ, TIME, "x", "y").withColumns({"cx": cell("x"), "cy": cell("y")})
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = base.withColumn("o", F.explode(around)).select(*by, F.col(SEQ).alias("seq_b"), F.col(TIME).alias("tb"), F.col("x").alias("xb"), F.col("y").alias("yb"), (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    one = base.select(*by, F.col(SEQ).alias("seq_a"), F.col(TIME).alias("ta"), F.col("x").alias("xa"), F.col("y").alias("ya"), "cx", "cy")
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    near = (F.col("seq_a") < F.col("seq_b")) & (dx * dx + dy * dy <= F.lit(float(radius) ** 2))
    if seconds is not None:
        near = near & (F.abs(F.unix_micros("ta") - F.unix_micros("tb")) <= F.lit(int(round(seconds * 1e6))))
    return one.join(spread, [*by, "cx", "cy"]).where(near).select(*by, "seq_a", "seq_b")


def _near_lists(x: np.ndarray, y: np.ndarray, t: np.ndarray | None, radius: float, seconds: float | None) -> list[np.ndarray]:
    """Indices within the radius (and time) of each point, itself included, by grid cells."""
    cells: dict[tuple[int, int], list[int]] = {}
    cx, cy = np.floor(x / radius).astype(np.int64), np.floor(y / radius).astype(np.int64)
    for i, c in enumerate(zip(cx.tolist(), cy.tolist())):
        cells.setdefault(c, []).append(i)
    packed = {c: np.array(v) for c, v in cells.items()}
    out = []
    for i, (a, b) in enumerate(zip(cx.tolist(), cy.tolist())):
        found = np.concatenate([packed[c] for da in (-1, 0, 1) for db in (-1, 0, 1) if (c := (a + da, b + db)) in packed])
        ok = (x[found] - x[i]) ** 2 + (y[found] - y[i]) ** 2 <= radius * radius
        if t is not None:
            ok &= np.abs(t[found] - t[i]) <= seconds * 1e6
        out.append(np.sort(found[ok]))
    return out


def density_labels(near: list[np.ndarray], min_samples: int) -> np.ndarray:
    """Cluster label of each point (-1: noise).

    Clusters are the components of core points that are near each other, found
    in index order.  A point that is no core belongs to the first cluster that
    reaches it, but one passed over as noise before a cluster began is taken in
    only by the point that the cluster started from.
    """
    n = len(near)
    core = np.array([len(v) >= max(1, min_samples) for v in near], bool)
    label = np.full(n, -1)
    clusters = 0
    for i in range(n):
        if label[i] >= 0 or not core[i]:
            continue
        label[i] = clusters
        free = near[i][label[near[i]] < 0]
        label[free] = clusters
        todo = list(free[core[free]])
        while todo:
            j = todo.pop()
            more = near[j][(label[near[j]] < 0) & (core[near[j]] | (near[j] > i))]
            label[more] = clusters
            todo.extend(more[core[more]])
        clusters += 1
    return label


def cluster_ids(points: DataFrame, radius_m: float, seconds: float | None = None, min_samples: int = 1, drop_noise: bool = False, use_aeqd: bool = True) -> DataFrame:
    """Points with ``cluster_id``: the smallest seq rank in the cluster, so that ids follow first sight.

    The labelling follows row order and runs per trajectory; only (key, seq,
    time, lat, lon) travel to it.  Noise is a cluster each, or is dropped.
    """
    kind = points.schema[KEY].dataType

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(SEQ, kind="stable").reset_index(drop=True)
        lat, lon = pdf[LAT].to_numpy(float), pdf[LON].to_numpy(float)
        good = np.isfinite(lat) & np.isfinite(lon)
        out = np.full(len(pdf), -1)
        if good.any():
            x, y = aeqd(lat[good], lon[good], lat[good].mean(), lon[good].mean()) if use_aeqd else mercator(lat[good], lon[good])
            t = pdf.loc[good, "__t"].to_numpy(float) if seconds is not None else None
            out[good] = density_labels(_near_lists(x, y, t, radius_m, seconds), min_samples)
        keep = out >= 0 if drop_noise else np.ones(len(pdf), bool)
        first: dict[int, int] = {}
        ids = [first.setdefault(c, i) if c >= 0 else i for i, c in enumerate(out.tolist())]
        return pd.DataFrame({KEY: pdf[KEY], SEQ: pdf[SEQ], "cluster_id": np.array(ids, np.int64)})[keep]

    picked = points.select(KEY, SEQ, F.unix_micros(TIME).alias("__t"), LAT, LON)
    schema = T.StructType([T.StructField(KEY, kind), T.StructField(SEQ, T.LongType()), T.StructField("cluster_id", T.LongType())])
    return points.join(picked.groupBy(KEY).applyInPandas(label, schema), [KEY, SEQ])


def compress(points: DataFrame, radius_km: float = 0.1, time_threshold_s: float | None = None, collapse: bool = True, agg_other: str = "first", min_samples: int = 1, drop_noise: bool = False, use_aeqd: bool = True, geodetic_check: bool = False, geodetic_tol_m: float = 0.0) -> DataFrame:
    """One row per cluster of near points: their mean place and time, others by ``agg_other``.

    ``agg_other`` is first, last or mean (of numbers, else first); anything else
    counts as first.  Without ``collapse`` the first row of each cluster stays.
    ``geodetic_check`` turns members farther than radius and tolerance from their
    cluster's mean out into clusters of their own (drops them with drop_noise).
    Order is by ``seq``, the cluster's first.
    """
    radius = radius_km * 1000
    out = cluster_ids(points, radius, time_threshold_s, min_samples, drop_noise, use_aeqd)
    mine = Window.partitionBy(KEY, "cluster_id")
    if geodetic_check:
        out = out.withColumns({"__mlat": F.avg(LAT).over(mine), "__mlon": F.avg(LON).over(mine)})
        out = staged(out, inverse_stages("__mlat", "__mlon", LAT, LON, "__g"), ["__g_m"])
        far = F.coalesce(F.col("__g_m"), F.lit(0.0)) > F.lit(radius + geodetic_tol_m)
        out = out.where(~far) if drop_noise else out.withColumn("cluster_id", F.when(far, -1 - F.col(SEQ)).otherwise(F.col("cluster_id")))
        out = out.drop("__mlat", "__mlon", "__g_m")
    extra = [f for f in points.schema.fields if f.name not in (KEY, SEQ, TIME, LAT, LON)]
    if not collapse:
        rank = F.row_number().over(mine.orderBy(SEQ))
        return out.withColumn("__r", rank).where("__r = 1").drop("__r", "cluster_id")

    def other(f: T.StructField) -> Column:
        if agg_other == "mean" and isinstance(f.dataType, T.NumericType):
            return F.avg(f"`{f.name}`").alias(f.name)
        pick = F.max_by if agg_other == "last" else F.min_by
        return pick(F.col(f"`{f.name}`"), SEQ).alias(f.name)

    micros = F.timestamp_micros(F.round(F.avg(F.unix_micros(TIME))).cast("long"))
    got = out.groupBy(KEY, "cluster_id").agg(F.min(SEQ).alias(SEQ), micros.alias(TIME), F.avg(LAT).alias(LAT), F.avg(LON).alias(LON), F.count("*").alias("n_points"), *[other(f) for f in extra])
    return got.drop("cluster_id")


FAR = 100_000.0  # metres of a chord up to which
CHORD = 5e-5  # a geodesic is longer by less than this share of it


def nearest_walk(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Rank of each place on the walk from the first always on to the nearest place left, ties to the earlier one.

    Chords in space tell which places can be nearest: a geodesic is no shorter than
    its chord, and hardly longer.  Geodesics are computed only where chords leave
    several places; equal places follow each other by their order.
    """
    n = len(lat)
    order = np.zeros(n, np.int64)
    place = np.column_stack(earth_centred(lat, lon))
    place = np.where(np.isfinite(place), place, 1e9)
    left = np.arange(n)
    count, now = n, 0
    left[0], left[n - 1], count = left[n - 1], left[0], n - 1
    for k in range(1, n):
        rest = left[:count]
        gap = place[rest] - place[now]
        chord = np.einsum("ij,ij->i", gap, gap)
        low = chord.min()
        most = (np.sqrt(low) * (1 + CHORD) + 1e-7) ** 2 if 0 < low < FAR**2 else low if low == 0 else np.inf
        some = np.flatnonzero(chord <= most)
        j = int(some[0])
        if len(some) > 1:
            some = some[np.argsort(rest[some])]
            j = int(some[0])
            if low > 0:
                _, metres = inverse(lat[now], lon[now], lat[rest[some]], lon[rest[some]], 8 if low < FAR**2 else 20)
                j = int(some[int(np.nan_to_num(metres, nan=np.inf).argmin())])
        now = int(rest[j])
        order[now] = k
        count -= 1
        left[j], left[count] = left[count], left[j]
    return order


def greedy_order(points: DataFrame) -> DataFrame:
    """``nn_order``: from the first row (input, seq) always on to the nearest row left, ties to the earlier one.

    A sequential walk, per trajectory; of each row only its place goes to it.
    """
    kind = points.schema[KEY].dataType

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["input", SEQ], kind="stable").reset_index(drop=True)
        order = nearest_walk(pdf[LAT].to_numpy(float), pdf[LON].to_numpy(float))
        return pd.DataFrame({KEY: pdf[KEY], "input": pdf["input"], SEQ: pdf[SEQ], "nn_order": order})

    schema = T.StructType([T.StructField(KEY, kind), T.StructField("input", T.IntegerType()), T.StructField(SEQ, T.LongType()), T.StructField("nn_order", T.LongType())])
    return points.join(points.select(KEY, "input", SEQ, LAT, LON).groupBy(KEY).applyInPandas(walk, schema), [KEY, "input", SEQ])


def combine(inputs: list[DataFrame]) -> DataFrame:
    """Merge recordings of the same trajectories: greedy order, first of equal places, times spread by distance."""
    from ..schema import first_of_equal
    from .segments import combine_times

    union = None
    for i, df in enumerate(inputs):
        part = df.withColumn("input", F.lit(i).cast("int"))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    ordered = first_of_equal(greedy_order(union), KEY, LAT, LON, by=("nn_order",))
    return combine_times(ordered)
