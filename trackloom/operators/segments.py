"""Segmentation at time gaps, sampling rates, distances, bearings and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import with_distance, with_point
from ..schema import KEY, LAT, LON, SEQ, TIME, first_of_equal, in_order, seconds_between


def by_time(points: DataFrame, gap_seconds: float = 30, min_points: int = 20) -> DataFrame:
    """Split trajectories where fixes lie more than ``gap_seconds`` apart; ``segment_id`` counts from 0.

    Segments of ``min_points`` rows or fewer are dropped, those left are numbered
    anew.  A trajectory without any segment left, and one of at most
    ``min_points`` rows, comes back whole as segment 0.
    """
    w = in_order()
    gap = F.unix_micros(TIME) - F.lag(F.unix_micros(TIME)).over(w) > F.lit(int(round(gap_seconds * 1e6)))
    runs = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = points.withColumn("__run", F.sum(F.when(gap, 1).otherwise(0)).over(runs))
    out = out.withColumn("__n", F.count("*").over(Window.partitionBy(KEY, "__run")))
    out = out.withColumn("__keep", F.col("__n") > min_points)
    out = out.withColumn("__any", F.max("__keep").over(Window.partitionBy(KEY)))
    out = out.where("__keep or not __any")
    number = F.dense_rank().over(Window.partitionBy(KEY).orderBy("__run")) - 1
    return out.withColumn("segment_id", F.when(F.col("__any"), number).otherwise(0).cast("int")).drop("__run", "__n", "__keep", "__any")


def sampling_rate(points: DataFrame, *, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Mean seconds between fixes, to three decimals; -1 for fewer than two rows.

    The mean of the steps is the span divided by their number, so that no window is needed.
    """
    span = (F.max(F.unix_micros(TIME)) - F.min(F.unix_micros(TIME))).cast("double") / F.lit(1e6)
    n = F.count(TIME)
    return points.groupBy(*by).agg(F.when(n < 2, F.lit(-1.0)).otherwise(F.round(span / F.greatest(n - 1, F.lit(1)), 3)).alias("rate_s"))


def legs(points: DataFrame, by: tuple[str, ...] = (KEY,), order: tuple[str, ...] = (TIME, SEQ)) -> DataFrame:
    """Each row with the leg to the next one: ``leg_m``, ``leg_az`` and the next row's place and time (null at the end)."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = points.withColumns({"next_lat": F.lead(LAT).over(w), "next_lon": F.lead(LON).over(w), "next_time": F.lead(TIME).over(w)})
    return with_distance(out, LAT, LON, "next_lat", "next_lon", "leg")


def path_length(points: DataFrame, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Geodesic length of each trajectory in metres; legs with a null coordinate count as 0."""
    return legs(points, by).groupBy(*by).agg(F.coalesce(F.sum("leg_m"), F.lit(0.0)).alias("length_m"))


def length_index(matched: DataFrame, original: DataFrame) -> DataFrame:
    """Length of the matched trajectory over that of the original one; 0 where the original has none."""
    m = path_length(matched).withColumnRenamed("length_m", "matched_m")
    o = path_length(original).withColumnRenamed("length_m", "original_m")
    both = o.join(m, KEY, "left")
    return both.select(KEY, F.when(F.col("original_m") == 0, 0.0).otherwise(F.coalesce("matched_m", F.lit(0.0)) / F.col("original_m")).alias("length_index"))


def bearings(points: DataFrame) -> DataFrame:
    """``bearing`` from each row to the next in [0, 360), and ``turn``, its change from the row before folded to [0, 180].

    Both are null where a bearing is undefined: at the last row and between equal points.
    """
    out = legs(points).withColumn("bearing", F.col("leg_az") - F.floor(F.col("leg_az") / 360) * F.lit(360.0))
    turn = F.abs(F.col("bearing") - F.lag("bearing").over(in_order()))
    return out.withColumn("turn", F.least(turn, F.lit(360.0) - turn)).drop("next_lat", "next_lon", "next_time", "leg_az")


def curve_candidates(points: DataFrame, lower: float = 20, upper: float = 80) -> DataFrame:
    """Rows whose turn lies in [lower, upper]: where a path is looked for."""
    return bearings(points).where(F.col("turn").between(F.lit(float(lower)), F.lit(float(upper))))


def _placed(df: DataFrame, fraction: str) -> DataFrame:
    """Rows with the point at ``fraction`` of their leg."""
    df = df.withColumn("__along", F.col(fraction) * F.coalesce("leg_m", F.lit(0.0)))
    out = with_point(df, LAT, LON, "leg_az", "__along", "__p")
    flat = F.col("__along") == 0
    return out.withColumns({"__lat": F.when(flat, F.col(LAT)).otherwise(F.col("__p_lat")), "__lon": F.when(flat, F.col(LON)).otherwise(F.col("__p_lon"))})


def by_number_of_points(points: DataFrame, num: int) -> DataFrame:
    """``num`` points equally spaced along each trajectory; time is linear in distance.

    Each leg emits the targets that fall on it, so that no range join is needed.
    Trajectories of fewer than two rows give none; of several targets at equal
    points (no length) all lie on the last leg.
    """
    if num <= 2:
        raise ValueError("num has to be more than 2")
    w = in_order()
    out = legs(points).withColumn("__from", F.coalesce(F.sum("leg_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    whole = Window.partitionBy(KEY)
    out = out.withColumns({"__total": F.coalesce(F.sum("leg_m").over(whole), F.lit(0.0)), "__last": F.lead("next_time").over(w).isNull()}).where("next_time is not null")
    step = F.col("__total") / F.lit(float(num - 1))
    to = F.col("__from") + F.coalesce("leg_m", F.lit(0.0))
    # the first target at or after a distance; of equal targets the last leg that starts there takes it
    first = lambda d: F.when(F.col("__total") == 0, F.lit(0)).otherwise(F.ceil(d / step - F.lit(1e-9))).cast("long")
    lo = F.greatest(first(F.col("__from")), F.lit(0))
    hi = F.when(F.col("__last"), F.lit(num - 1)).otherwise(F.when(F.col("__total") == 0, F.lit(-1)).otherwise(first(to) - 1))
    out = out.withColumns({"__lo": lo, "__hi": hi}).where("__hi >= __lo")
    out = out.withColumn("k", F.explode_outer(F.sequence("__lo", F.least(F.col("__hi"), F.lit(num - 1)))))
    target = F.when(F.col("k") == num - 1, F.col("__total")).otherwise(F.col("k") * step)
    into = F.when(F.coalesce("leg_m", F.lit(0.0)) == 0, F.lit(0.0)).otherwise((target - F.col("__from")) / F.col("leg_m"))
    out = _placed(out.withColumn("__f", F.greatest(F.least(into, F.lit(1.0)), F.lit(0.0))), "__f")
    micros = F.unix_micros(TIME) + F.round((F.unix_micros("next_time") - F.unix_micros(TIME)) * F.col("__f")).cast("long")
    return out.select(KEY, F.col("k").alias(SEQ), F.timestamp_micros(micros).alias(TIME), F.col("__lat").alias(LAT), F.col("__lon").alias(LON))


def by_sampling_rate(points: DataFrame, rate_seconds: float) -> DataFrame:
    """Points every ``rate_seconds`` from each trajectory's first fix; the last fix need not be among them.

    A rate above the trajectory's own sampling rate is refused: such
    trajectories, single rows and those without duration come back unchanged, with
    ``resampled`` false.
    """
    if rate_seconds <= 0:
        raise ValueError("the rate has to be positive")
    step = int(round(rate_seconds * 1e6))
    whole = Window.partitionBy(KEY)
    t = F.unix_micros(TIME)
    out = legs(points).withColumns({"__t0": F.min(t).over(whole), "__t1": F.max(t).over(whole), "__n": F.count("*").over(whole)})
    own = F.round((F.col("__t1") - F.col("__t0")).cast("double") / F.lit(1e6) / F.greatest(F.col("__n") - 1, F.lit(1)), 3)
    out = out.withColumn("__ok", (F.col("__n") >= 2) & (F.col("__t1") > F.col("__t0")) & (own >= F.lit(float(rate_seconds))))
    same = out.where("not __ok").select(KEY, F.col(SEQ), TIME, LAT, LON, F.lit(False).alias("resampled"))
    a, b = t - F.col("__t0"), F.unix_micros("next_time") - F.col("__t0")
    out = out.where("__ok and next_time is not null and next_time > time")
    lo = F.ceil(a / F.lit(step)).cast("long")
    hi = F.when(F.unix_micros("next_time") == F.col("__t1"), F.floor(b / F.lit(step))).otherwise(F.ceil(b / F.lit(step)) - 1).cast("long")
    out = out.withColumns({"__lo": lo, "__hi": hi}).where("__hi >= __lo").withColumn("k", F.explode_outer(F.sequence("__lo", "__hi")))
    at = F.col("__t0") + F.col("k") * F.lit(step)
    out = _placed(out.withColumn("__f", (at - t) / (F.unix_micros("next_time") - t)), "__f")
    new = out.select(KEY, F.col("k").alias(SEQ), F.timestamp_micros(at).alias(TIME), F.col("__lat").alias(LAT), F.col("__lon").alias(LON), F.lit(True).alias("resampled"))
    return first_of_equal(new.unionByName(same), KEY, LAT, LON, TIME)


def combine_times(points: DataFrame, order: str = "nn_order") -> DataFrame:
    """Spread the span of a trajectory's times along its path in ``order``, by distance.

    Without any distance the rows are evenly spaced if there is a span.
    """
    w = Window.partitionBy(KEY).orderBy(order)
    whole = Window.partitionBy(KEY)
    out = legs(points, order=(order,))
    out = out.withColumns({"__d": F.coalesce(F.sum("leg_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "__all": F.coalesce(F.sum("leg_m").over(whole), F.lit(0.0)), "__t0": F.min(F.unix_micros(TIME)).over(whole), "__t1": F.max(F.unix_micros(TIME)).over(whole), "__n": F.count("*").over(whole), "__i": F.row_number().over(w)})
    share = F.when(F.col("__all") > 0, F.col("__d") / F.col("__all")).otherwise(F.when(F.col("__n") > 1, (F.col("__i") - 1) / (F.col("__n") - 1)).otherwise(0.0))
    at = F.col("__t0") + F.round((F.col("__t1") - F.col("__t0")) * share).cast("long")
    return out.withColumn(TIME, F.timestamp_micros(at)).drop("next_lat", "next_lon", "next_time", "leg_m", "leg_az", "__d", "__all", "__t0", "__t1", "__n", "__i")


def segment_summary(segments: DataFrame) -> DataFrame:
    """Rows, first and last time, mean interval and length of each segment."""
    by = (KEY, "segment_id")
    return legs(segments, by).groupBy(*by).agg(F.count("*").alias("n"), F.min(TIME).alias("t0"), F.max(TIME).alias("t1"), F.round(F.avg(seconds_between(F.col(TIME), F.col("next_time"))), 3).alias("rate_s"), F.round(F.coalesce(F.sum("leg_m"), F.lit(0.0)), 3).alias("length_m"))
