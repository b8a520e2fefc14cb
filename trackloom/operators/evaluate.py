"""How well matched trajectories agree with true ones: lengths, RMF, precision, recall, F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import with_distance, with_distance_batched
from ..schema import KEY, LAT, LON, SEQ
from .roads import nearest_by_grid
from .segments import path_length


def _aligned(matched: DataFrame, truth: DataFrame, *more: str) -> DataFrame:
    """Rows of both that agree in (key, seq), as m_ and t_ columns."""
    m = matched.select(KEY, SEQ, *[F.col(c).alias(f"m_{c}") for c in (LAT, LON, *more)])
    t = truth.select(KEY, SEQ, *[F.col(c).alias(f"t_{c}") for c in (LAT, LON, *more)])
    return m.join(t, [KEY, SEQ])


def _totals(matched: DataFrame, truth: DataFrame, common: DataFrame) -> DataFrame:
    m = path_length(matched).withColumnRenamed("length_m", "m")
    t = path_length(truth).withColumnRenamed("length_m", "true_len")
    out = t.join(m, KEY, "left").join(common, KEY, "left")
    zero = F.coalesce("m", F.lit(0.0)) == 0
    return out.select(KEY, F.when(zero, F.col("true_len")).otherwise(F.col("m")).alias("matched_len"), "true_len", F.coalesce("common_len", F.lit(0.0)).alias("common_len"))


def lengths_geometric(matched: DataFrame, truth: DataFrame, tol_m: float = 1.0) -> DataFrame:
    """Matched, true and common length of each trajectory; a leg is common if both its ends lie within ``tol_m``.

    Rows are aligned by ``seq``, which has to count both alike.  A matched
    trajectory without length counts as long as the true one.
    """
    both = with_distance_batched(_aligned(matched, truth), f"m_{LAT}", f"m_{LON}", f"t_{LAT}", f"t_{LON}", "gap")
    return _totals(matched, truth, _common(both.withColumn("near", F.col("gap_m") <= F.lit(float(tol_m))), "near"))


def _common(both: DataFrame, *flags: str) -> DataFrame:
    """Length of matched legs between consecutive aligned rows at both of which all ``flags`` hold."""
    w = Window.partitionBy(KEY).orderBy(SEQ)
    hold = F.lit(True)
    for f in flags:
        hold = hold & F.coalesce(F.col(f), F.lit(False))
    both = both.select(KEY, SEQ, f"m_{LAT}", f"m_{LON}", hold.alias("ok"))
    both = both.withColumns({"n_lat": F.lead(f"m_{LAT}").over(w), "n_lon": F.lead(f"m_{LON}").over(w), "n_ok": F.lead("ok").over(w) & (F.lead(SEQ).over(w) == F.col(SEQ) + 1)})
    legs = with_distance(both, f"m_{LAT}", f"m_{LON}", "n_lat", "n_lon", "leg")
    return legs.groupBy(KEY).agg(F.sum(F.when(F.col("ok") & F.col("n_ok"), F.col("leg_m"))).alias("common_len"))


def lengths_road(matched: DataFrame, truth: DataFrame, segments: DataFrame) -> DataFrame:
    """The same by roads: a leg is common if both its ends have the same nearest way in both trajectories.

    The nearest way is the one of the segment whose middle is nearest.
    """
    targets = segments.select(F.struct("way_id", "seg_no").alias("segment"), ((F.col("lat_a") + F.col("lat_b")) / 2).alias("tlat"), ((F.col("lon_a") + F.col("lon_b")) / 2).alias("tlon"))
    road = lambda p: nearest_by_grid(p, targets, "segment").withColumn("way", F.col("segment.way_id"))
    both = _aligned(road(matched), road(truth), "way")
    return _totals(matched, truth, _common(both.withColumn("same", F.col("m_way") == F.col("t_way")), "same"))


def rmf() -> Column:
    """Route mismatch fraction, from the columns of lengths."""
    t = F.col("true_len")
    return F.when(t == 0, 0.0).otherwise(F.abs(F.round((F.col("matched_len") + t - 2 * F.col("common_len")) / t, 10)))


def recall() -> Column:
    t = F.col("true_len")
    return F.when(t == 0, 0.0).otherwise(F.round(F.col("common_len") / t, 10))


def precision() -> Column:
    m = F.col("matched_len")
    return F.when(m == 0, 0.0).otherwise(F.round(F.col("common_len") / m, 10))


def f1() -> Column:
    """Harmonic mean of precision and recall; 0 if either is."""
    p, r = precision(), recall()
    return F.when((p == 0) | (r == 0), 0.0).otherwise(2 * p * r / (p + r))


def metrics(lengths: DataFrame) -> DataFrame:
    """All metrics from one pass over the lengths."""
    return lengths.select(KEY, "matched_len", "true_len", "common_len", rmf().alias("rmf"), precision().alias("precision"), recall().alias("recall"), f1().alias("f1"))
