"""The WGS84 geodesic problem: staged SQL expressions for DataFrames, and numpy for kernels.

Both solve Vincenty's equations (1975).  The staged form adds one column after
another, so that plans stay linear in the number of iterations and whole-stage
code generation covers all of it.  The same expressions are valid in any ANSI
engine, which is how tests compare them.  Where the iteration does not settle
(nearly antipodal points) the great-circle distance is used instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The WGS84 ellipsoid and the mean earth radius in metres.
MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
MINOR = MAJOR * (1 - FLATTENING)
MEAN_RADIUS = 6371008.8
SPHERE = 6378137.0  # of Web Mercator

ITERATIONS = 6


def _d(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def inverse_stages(lat1: str, lon1: str, lat2: str, lon2: str, out: str, iterations: int = ITERATIONS) -> list[list[tuple[str, str]]]:
    """Stages of (column, expression) that end in ``{out}_m`` and ``{out}_az``: metres, and degrees from north.

    Null coordinates give nulls; equal points give 0 metres and a null azimuth.
    """
    g, f = f"{out}__", _d(FLATTENING)
    one, two = _d(1.0), _d(2.0)
    turn = _d(360.0)
    stages = [
        [(f"{g}du", f"{lon2} - {lon1}")],
        [(f"{g}l", f"radians({g}du - {turn} * floor(({g}du + {_d(180.0)}) / {turn}))"), (f"{g}u1", f"atan(({one} - {f}) * tan(radians({lat1})))"), (f"{g}u2", f"atan(({one} - {f}) * tan(radians({lat2})))")],
        [(f"{g}s1", f"sin({g}u1)"), (f"{g}c1", f"cos({g}u1)"), (f"{g}s2", f"sin({g}u2)"), (f"{g}c2", f"cos({g}u2)"), (f"{g}x0", f"{g}l")],
    ]
    for k in range(iterations):
        x, p = f"{g}x{k}", f"{g}{k}"
        stages += [
            [(f"{p}sl", f"sin({x})"), (f"{p}cl", f"cos({x})")],
            [(f"{p}ss", f"sqrt(({g}c2 * {p}sl) * ({g}c2 * {p}sl) + ({g}c1 * {g}s2 - {g}s1 * {g}c2 * {p}cl) * ({g}c1 * {g}s2 - {g}s1 * {g}c2 * {p}cl))"), (f"{p}cs", f"{g}s1 * {g}s2 + {g}c1 * {g}c2 * {p}cl")],
            [(f"{p}sg", f"atan2({p}ss, {p}cs)"), (f"{p}sa", f"CASE WHEN {p}ss = 0 THEN {_d(0.0)} ELSE {g}c1 * {g}c2 * {p}sl / {p}ss END")],
            [(f"{p}ca", f"{one} - {p}sa * {p}sa")],
            [(f"{p}cm", f"CASE WHEN {p}ca < {_d(1e-15)} THEN {_d(0.0)} ELSE {p}cs - {two} * {g}s1 * {g}s2 / {p}ca END"), (f"{p}cc", f"{f} / {_d(16.0)} * {p}ca * ({_d(4.0)} + {f} * ({_d(4.0)} - {_d(3.0)} * {p}ca))")],
            [(f"{g}x{k + 1}", f"{g}l + ({one} - {p}cc) * {f} * {p}sa * ({p}sg + {p}cc * {p}ss * ({p}cm + {p}cc * {p}cs * ({two} * {p}cm * {p}cm - {one})))")],
        ]
    p, last, prior = f"{g}{iterations - 1}", f"{g}x{iterations}", f"{g}x{iterations - 1}"
    ratio = _d((MAJOR**2 - MINOR**2) / MINOR**2)
    stages += [
        [(f"{g}uu", f"{p}ca * {ratio}")],
        [(f"{g}A", f"{one} + {g}uu / {_d(16384.0)} * ({_d(4096.0)} + {g}uu * ({_d(-768.0)} + {g}uu * ({_d(320.0)} - {_d(175.0)} * {g}uu)))"), (f"{g}B", f"{g}uu / {_d(1024.0)} * ({_d(256.0)} + {g}uu * ({_d(-128.0)} + {g}uu * ({_d(74.0)} - {_d(47.0)} * {g}uu)))")],
        [(f"{g}ds", f"{g}B * {p}ss * ({p}cm + {g}B / {_d(4.0)} * ({p}cs * ({two} * {p}cm * {p}cm - {one}) - {g}B / {_d(6.0)} * {p}cm * ({_d(4.0)} * {p}ss * {p}ss - {_d(3.0)}) * ({_d(4.0)} * {p}cm * {p}cm - {_d(3.0)})))")],
        [
            (f"{out}_m", f"CASE WHEN abs({last} - {prior}) > {_d(1e-9)} THEN {_d(MEAN_RADIUS)} * {p}sg ELSE {_d(MINOR)} * {g}A * ({p}sg - {g}ds) END"),
            (f"{out}_az", f"CASE WHEN {p}ss = 0 THEN CAST(NULL AS DOUBLE) ELSE degrees(atan2({g}c2 * sin({last}), {g}c1 * {g}s2 - {g}s1 * {g}c2 * cos({last}))) END"),
        ],
    ]
    return stages


def direct_stages(lat: str, lon: str, azimuth: str, metres: str, out: str, iterations: int = ITERATIONS) -> list[list[tuple[str, str]]]:
    """Stages that end in ``{out}_lat`` and ``{out}_lon``: the point ``metres`` from a point along an azimuth in degrees."""
    g, f = f"{out}__", _d(FLATTENING)
    one, two = _d(1.0), _d(2.0)
    ratio = _d((MAJOR**2 - MINOR**2) / MINOR**2)
    stages = [
        [(f"{g}u", f"atan(({one} - {f}) * tan(radians({lat})))"), (f"{g}az", f"radians(coalesce({azimuth}, {_d(0.0)}))")],
        [(f"{g}su", f"sin({g}u)"), (f"{g}cu", f"cos({g}u)"), (f"{g}sz", f"sin({g}az)"), (f"{g}cz", f"cos({g}az)")],
        [(f"{g}s1", f"atan2({g}su, {g}cu * {g}cz)"), (f"{g}sa", f"{g}cu * {g}sz")],
        [(f"{g}ca", f"{one} - {g}sa * {g}sa")],
        [(f"{g}uu", f"{g}ca * {ratio}")],
        [(f"{g}A", f"{one} + {g}uu / {_d(16384.0)} * ({_d(4096.0)} + {g}uu * ({_d(-768.0)} + {g}uu * ({_d(320.0)} - {_d(175.0)} * {g}uu)))"), (f"{g}B", f"{g}uu / {_d(1024.0)} * ({_d(256.0)} + {g}uu * ({_d(-128.0)} + {g}uu * ({_d(74.0)} - {_d(47.0)} * {g}uu)))")],
        [(f"{g}x0", f"{metres} / ({_d(MINOR)} * {g}A)")],
    ]
    for k in range(iterations):
        p = f"{g}{k}"
        stages += [
            [(f"{p}cm", f"cos({two} * {g}s1 + {g}x{k})"), (f"{p}ss", f"sin({g}x{k})"), (f"{p}cs", f"cos({g}x{k})")],
            [(f"{g}x{k + 1}", f"{metres} / ({_d(MINOR)} * {g}A) + {g}B * {p}ss * ({p}cm + {g}B / {_d(4.0)} * ({p}cs * ({two} * {p}cm * {p}cm - {one}) - {g}B / {_d(6.0)} * {p}cm * ({_d(4.0)} * {p}ss * {p}ss - {_d(3.0)}) * ({_d(4.0)} * {p}cm * {p}cm - {_d(3.0)})))")],
        ]
    e = f"{g}x{iterations}"
    stages += [
        [(f"{g}ss", f"sin({e})"), (f"{g}cs", f"cos({e})"), (f"{g}cm", f"cos({two} * {g}s1 + {e})")],
        [(f"{g}t", f"{g}su * {g}ss - {g}cu * {g}cs * {g}cz"), (f"{g}C", f"{f} / {_d(16.0)} * {g}ca * ({_d(4.0)} + {f} * ({_d(4.0)} - {_d(3.0)} * {g}ca))"), (f"{g}lam", f"atan2({g}ss * {g}sz, {g}cu * {g}cs - {g}su * {g}ss * {g}cz)")],
        [(f"{g}lo", f"{lon} + degrees({g}lam - ({one} - {g}C) * {f} * {g}sa * ({e} + {g}C * {g}ss * ({g}cm + {g}C * {g}cs * ({two} * {g}cm * {g}cm - {one}))))")],
        [
            (f"{out}_lat", f"degrees(atan2({g}su * {g}cs + {g}cu * {g}ss * {g}cz, ({one} - {f}) * sqrt({g}sa * {g}sa + {g}t * {g}t)))"),
            (f"{out}_lon", f"{g}lo - {_d(360.0)} * floor(({g}lo + {_d(180.0)}) / {_d(360.0)})"),
        ],
    ]
    return stages


def staged(df: DataFrame, stages: list[list[tuple[str, str]]], out: list[str]) -> DataFrame:
    """``df`` with the columns ``out`` of these stages.

    A filter on a result must not be pushed down through the stages: written out
    in terms of the first it is exponentially long.  A condition that the
    optimizer may not move, and that always holds, stands in the way.
    """
    names = [f"`{c}`" for c in df.columns]
    for stage in stages:
        df = df.selectExpr("*", *[f"{e} AS `{n}`" for n, e in stage])
    return df.selectExpr(*names, *[f"CASE WHEN monotonically_increasing_id() >= 0 THEN `{c}` END AS `{c}`" for c in out])


def staged_sql(source: str, stages: list[list[tuple[str, str]]], name: str) -> str:
    """The same as chained common table expressions, the last one called ``name``."""
    parts, at = [], source
    for k, stage in enumerate(stages):
        here = name if k == len(stages) - 1 else f"{name}_{k}"
        parts.append(f"{here} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage)} FROM {at})")
        at = here
    return ",\n".join(parts)


def with_distance(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, out: str = "leg") -> DataFrame:
    """``df`` with ``{out}_m`` and ``{out}_az`` of the geodesic between two pairs of columns."""
    return staged(df, inverse_stages(lat1, lon1, lat2, lon2, out), [f"{out}_m", f"{out}_az"])


def with_distance_batched(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, out: str = "leg") -> DataFrame:
    """The same from numpy, by Arrow batches.

    For what is joined afterwards: the optimizer derives constraints of a join
    from every alias below it, which the many stages of the other form make too many.
    """

    @F.pandas_udf("m double, az double")
    def solve(a: pd.Series, b: pd.Series, c: pd.Series, e: pd.Series) -> pd.DataFrame:
        azimuth, metres = inverse(a, b, c, e)
        return pd.DataFrame({"m": metres, "az": azimuth})

    got = df.withColumn("__solved", solve(*[F.col(c).cast("double") for c in (lat1, lon1, lat2, lon2)]))
    null = F.lit(None).cast("double")
    return got.withColumns({f"{out}_m": F.nanvl("__solved.m", null), f"{out}_az": F.nanvl("__solved.az", null)}).drop("__solved")


def with_point(df: DataFrame, lat: str, lon: str, azimuth: str, metres: str, out: str = "to") -> DataFrame:
    """``df`` with ``{out}_lat`` and ``{out}_lon``, where a geodesic from a point ends."""
    return staged(df, direct_stages(lat, lon, azimuth, metres, out), [f"{out}_lat", f"{out}_lon"])


def inverse(lat1, lon1, lat2, lon2, iterations: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Azimuth in degrees (nan for equal points) and metres, of arrays that broadcast."""
    lat1, lon1, lat2, lon2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (lat1, lon1, lat2, lon2)))
    with np.errstate(invalid="ignore", divide="ignore"):
        l = np.radians((lon2 - lon1 + 180) % 360 - 180)
        u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(v))) for v in (lat1, lat2))
        s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
        lam = l
        for _ in range(iterations):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, c1 * c2 * sl / np.where(ss == 0, 1, ss))
            ca = 1 - sa * sa
            cm = np.where(ca < 1e-15, 0, cs - 2 * s1 * s2 / np.where(ca < 1e-15, 1, ca))
            cc = FLATTENING / 16 * ca * (4 + FLATTENING * (4 - 3 * ca))
            before, lam = lam, l + (1 - cc) * FLATTENING * sa * (sigma + cc * ss * (cm + cc * cs * (2 * cm * cm - 1)))
        uu = ca * (MAJOR**2 - MINOR**2) / MINOR**2
        a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
        b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
        ds = b * ss * (cm + b / 4 * (cs * (2 * cm * cm - 1) - b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        metres = np.where(np.abs(lam - before) > 1e-9, MEAN_RADIUS * sigma, MINOR * a * (sigma - ds))
        azimuth = np.where(ss == 0, np.nan, np.degrees(np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))))
    return azimuth, metres


def direct(lat, lon, azimuth, metres, iterations: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude of where geodesics end; a nan azimuth counts as north."""
    lat, lon, azimuth, metres = np.broadcast_arrays(*(np.asarray(v, float) for v in (lat, lon, azimuth, metres)))
    az = np.radians(np.nan_to_num(azimuth))
    u = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat)))
    su, cu, sz, cz = np.sin(u), np.cos(u), np.sin(az), np.cos(az)
    s1, sa = np.arctan2(su, cu * cz), cu * sz
    ca = 1 - sa * sa
    uu = ca * (MAJOR**2 - MINOR**2) / MINOR**2
    a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
    b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
    sigma = base = metres / (MINOR * a)
    for _ in range(iterations):
        cm, ss, cs = np.cos(2 * s1 + sigma), np.sin(sigma), np.cos(sigma)
        sigma = base + b * ss * (cm + b / 4 * (cs * (2 * cm * cm - 1) - b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    cm, ss, cs = np.cos(2 * s1 + sigma), np.sin(sigma), np.cos(sigma)
    t = su * ss - cu * cs * cz
    cc = FLATTENING / 16 * ca * (4 + FLATTENING * (4 - 3 * ca))
    lam = np.arctan2(ss * sz, cu * cs - su * ss * cz)
    out = lon + np.degrees(lam - (1 - cc) * FLATTENING * sa * (sigma + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))))
    return np.degrees(np.arctan2(su * cs + cu * ss * cz, (1 - FLATTENING) * np.hypot(sa, t))), (out + 180) % 360 - 180


def earth_centred(lat, lon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places on the ellipsoid in metres from the earth's centre."""
    a, o = np.radians(lat), np.radians(lon)
    square = FLATTENING * (2 - FLATTENING)
    across = MAJOR / np.sqrt(1 - square * np.sin(a) ** 2)
    return across * np.cos(a) * np.cos(o), across * np.cos(a) * np.sin(o), across * (1 - square) * np.sin(a)


def aeqd(lat, lon, lat0: float, lon0: float) -> tuple[np.ndarray, np.ndarray]:
    """Azimuthal equidistant coordinates in metres about a centre: polar coordinates of the inverse problem."""
    azimuth, metres = inverse(lat0, lon0, lat, lon)
    az = np.radians(np.nan_to_num(azimuth))
    return metres * np.sin(az), metres * np.cos(az)


def aeqd_back(x, y, lat0: float, lon0: float) -> tuple[np.ndarray, np.ndarray]:
    return direct(lat0, lon0, np.degrees(np.arctan2(x, y)), np.hypot(x, y))


def mercator(lat, lon) -> tuple[np.ndarray, np.ndarray]:
    """Web Mercator coordinates in metres."""
    return SPHERE * np.radians(np.asarray(lon, float)), SPHERE * np.log(np.tan(np.pi / 4 + np.radians(np.asarray(lat, float)) / 2))
