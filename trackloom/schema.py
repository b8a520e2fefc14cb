"""Points of trajectories: the columns that every operator works on, and their normaliser.

``points`` has ``traj_id, seq, time, lat, lon`` and whatever else came along.
``seq`` is the row order of the recording; operators order by (time, seq), so
that ties never depend on how Spark laid out the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, SEQ, TIME, LAT, LON = "traj_id", "seq", "time", "lat", "lon"


def timestamp_of(df: DataFrame, name: str, fmt: str | None = None) -> Column:
    """``name`` as a timestamp: strings are parsed, numbers are epoch seconds, others are cast."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(F.col(name), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(name))
    if isinstance(kind, T.NumericType):
        return F.timestamp_seconds(F.col(name).cast("decimal(20,6)"))
    return F.col(name).cast("timestamp")


def normalise(df: DataFrame, key: str | None = KEY, time: str | None = TIME, lat: str = LAT, lon: str = LON, seq: str | None = None, time_format: str | None = None) -> DataFrame:
    """Points of ``df``, with canonical column names; NaN coordinates become null.

    Without ``key`` all rows are trajectory 0; without ``time`` the row order
    counts seconds from the epoch; without ``seq`` it is the order by time.
    """
    missing = [c for c in (key, time, lat, lon, seq) if c is not None and c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    if seq is None and time is None:
        raise ValueError("an order is needed: give time or seq")
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    when = timestamp_of(df, time, time_format) if time else F.timestamp_seconds(F.col(seq))
    own = {c for c in (key, time, lat, lon, seq) if c}
    extra = [F.col(f"`{c}`") for c in df.columns if c not in own and c not in (KEY, SEQ, TIME, LAT, LON)]
    out = df.select((F.col(key) if key else F.lit(0).cast("long")).alias(KEY), (F.col(seq).cast("long") if seq else F.lit(0).cast("long")).alias(SEQ), when.alias(TIME), number(lat).alias(LAT), number(lon).alias(LON), *extra)
    if seq is None:
        out = out.withColumn(SEQ, F.row_number().over(Window.partitionBy(KEY).orderBy(TIME, LAT, LON)).cast("long"))
    return out


def in_order(key: str = KEY, by: tuple[str, ...] = (TIME, SEQ)) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*by)


def seconds_between(a: Column, b: Column) -> Column:
    """Seconds from timestamp a to b, to the microsecond."""
    return (F.unix_micros(b) - F.unix_micros(a)).cast("double") / F.lit(1e6)


def first_of_equal(points: DataFrame, *columns: str, by: tuple[str, ...] = (SEQ,)) -> DataFrame:
    """Of rows that agree in ``columns`` the first in row order; not dropDuplicates, which keeps any."""
    rank = F.row_number().over(Window.partitionBy(*columns).orderBy(*by))
    return points.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
