from __future__ import annotations

import numpy as np

from trackloom.functions.geodesy import aeqd, aeqd_back, direct, inverse, mercator, with_distance, with_distance_batched, with_point


def test_published_lengths():
    _, m = inverse(0, 0, 0, 1)
    assert abs(m - 111319.49079327358) < 1e-6
    az, m = inverse(-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777)  # Flinders Peak to Buninyong
    assert abs(m - 54972.271) < 0.001 and abs(az % 360 - 306.868158) < 1e-4


def test_round_trips():
    rng = np.random.default_rng(1)
    lat, lon = rng.uniform(-80, 80, 500), rng.uniform(-180, 180, 500)
    az, m = rng.uniform(0, 360, 500), rng.uniform(0, 200_000, 500)
    b, o = direct(lat, lon, az, m)
    _, back = inverse(lat, lon, b, o)
    assert np.abs(back - m).max() < 1e-5
    x, y = aeqd(b[:50] * 0 + 56.9, np.linspace(24, 24.5, 50), 56.95, 24.2)
    p, q = aeqd_back(x, y, 56.95, 24.2)
    assert np.abs(p - 56.9).max() < 1e-9 and np.abs(q - np.linspace(24, 24.5, 50)).max() < 1e-9


def test_edges_of_the_domain():
    az, m = inverse([10, 0, 0], [20, 179.5, 0], [10, 0, 0.1], [20, -179.5, 179.9])
    assert m[0] == 0 and np.isnan(az[0])
    assert abs(m[1] - 111319.4908) < 0.001
    assert 1.99e7 < m[2] < 2.01e7
    x, y = mercator(0, 180)
    assert abs(x - 20037508.342789244) < 1e-6 and abs(y) < 1e-6


def test_forms_agree(spark):
    rng = np.random.default_rng(2)
    lat = rng.uniform(-60, 60, 300)
    lon = rng.uniform(-170, 170, 300)
    rows = [(float(a), float(o), float(a + d), float(o + e), float(z)) for a, o, d, e, z in zip(lat, lon, rng.normal(0, 0.3, 300), rng.normal(0, 0.3, 300), rng.uniform(0, 5000, 300))] + [(1.0, 2.0, 1.0, 2.0, 3.0), (None, 1.0, 2.0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, z double")
    one = with_distance(df, "a", "b", "c", "d").collect()
    two = with_distance_batched(df, "a", "b", "c", "d").collect()
    for x, y, r in zip(one, two, rows):
        if r[0] is None:
            assert x.leg_m is None and y.leg_m is None
            continue
        az, m = inverse(*r[:4])
        assert abs(x.leg_m - m) < 1e-6 and abs(y.leg_m - m) < 1e-9
        assert (x.leg_az is None) == bool(np.isnan(az)) and (x.leg_az is None or abs((x.leg_az - az + 180) % 360 - 180) < 1e-6)
    moved = with_point(df.where("a is not null").withColumn("az", df.z / 14), "a", "b", "az", "z").collect()
    for r in moved:
        p, q = direct(r.a, r.b, r.z / 14, r.z)
        assert abs(r.to_lat - p) < 1e-9 and abs(r.to_lon - q) < 1e-9


def test_filters_on_distances_stay_above_the_stages(spark):
    df = spark.range(5).selectExpr("id * 0.1 as a", "id * 0.2 as b", "1.0 as c", "2.0 as d")
    assert with_distance(df, "a", "b", "c", "d").where("leg_m < 1e6").count() == 5
