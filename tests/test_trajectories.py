from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions.geodesy import inverse
from trackloom.operators import cluster, evaluate, kalman, segments
from trackloom.schema import KEY, first_of_equal, normalise

SCHEMA = "traj_id long, seq long, t double, lat double, lon double"


def points(spark, rows):
    rows = [(k, i, *(None if v is None else float(v) for v in rest)) for k, i, *rest in rows]
    return spark.createDataFrame(rows, SCHEMA).withColumn("time", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).drop("t")


def line(n, key=1, step=5.0, start=0.0):
    return [(key, i, start + i * step, 56.95 + i * 0.0001, 24.10 + i * 0.0001) for i in range(n)]


def test_normaliser(spark):
    raw = spark.createDataFrame([("2023-01-01 10:00:05", "56.95", float("nan"), "x"), ("2023-01-01 10:00:00", "56.94", 24.1, "y"), ("bad", None, 1.0, "z")], "when string, la string, lo double, extra string")
    out = normalise(raw, key=None, time="when", lat="la", lon="lo").orderBy("seq").collect()
    assert [r.extra for r in out] == ["z", "y", "x"] and out[2].lon is None and out[0].time is None and out[1].lat == 56.94
    with pytest.raises(ValueError):
        normalise(raw, key="nothing", time="when", lat="la", lon="lo")
    epoch = spark.createDataFrame([(1, 2.5, 1.0, 1.0)], "traj_id long, time double, lat double, lon double")
    assert normalise(epoch).select(F.unix_micros("time")).first()[0] == 2_500_000


def test_by_time_boundaries(spark):
    exact = [(1, i, t, 1.0, 1.0) for i, t in enumerate([*range(25), *range(54, 80)])]  # gap of 30 s: none
    over = [(2, i, t, 1.0, 1.0) for i, t in enumerate([*range(25), *(x + 54.000001 for x in range(25))])]
    short = [(3, i, float(i), 1.0, 1.0) for i in range(20)]
    none = [(4, i, float(100 * i), 1.0, 1.0) for i in range(30)]
    drop = [(5, i, t, 1.0, 1.0) for i, t in enumerate([*range(5), *range(100, 130), *range(500, 525)])]
    got = segments.by_time(points(spark, exact + over + short + none + drop))
    count = {(r[0], r[1]): r[2] for r in got.groupBy(KEY, "segment_id").count().collect()}
    assert count == {(1, 0): 51, (2, 0): 25, (2, 1): 25, (3, 0): 20, (4, 0): 30, (5, 0): 30, (5, 1): 25}


def test_sampling_rate(spark):
    got = {r[0]: r[1] for r in segments.sampling_rate(points(spark, [*line(100), *line(1, 2), *line(3, 3, 0.3337)])).collect()}
    assert got == {1: 5.0, 2: -1.0, 3: 0.334}


def test_lengths_and_bearings(spark):
    df = points(spark, [(1, 0, 0, 0.0, 0.0), (1, 1, 1, 0.0, 1.0), (1, 2, 2, 0.0, 1.0), (1, 3, 3, 1.0, 1.0), (2, 0, 0, None, 1.0)])
    got = {r[0]: r[1] for r in segments.path_length(df).collect()}
    assert abs(got[1] - 111319.4908 - 110574.3886) < 0.01 and got[2] == 0
    b = segments.bearings(df).where("traj_id = 1").orderBy("seq").collect()
    assert abs(b[0].bearing - 90) < 1e-9 and b[1].bearing is None and abs(b[2].bearing) < 1e-9 and b[3].bearing is None
    wrap = points(spark, [(1, 0, 0, 0.0, 0.0), (1, 1, 1, 0.984807, -0.173648), (1, 2, 2, 1.9696, 0.0)])
    turn = [r.turn for r in segments.bearings(wrap).orderBy("seq").collect()]
    assert abs(turn[1] - 20) < 0.2
    assert {r[0]: r[1] for r in segments.length_index(df, df).collect()} == {1: 1.0, 2: 0.0}


def test_resampling(spark):
    df = points(spark, [*line(60), *line(1, 2), (3, 0, 0, 1.0, 1.0), (3, 1, 5, 1.0, 1.0), (3, 2, 9, 1.0, 1.0)])
    got = segments.by_number_of_points(df, 17).orderBy("seq").collect()
    one = [r for r in got if r[KEY] == 1]
    assert len(one) == 17 and [r.seq for r in one] == list(range(17)) and sum(r[KEY] == 3 for r in got) == 17 and not any(r[KEY] == 2 for r in got)
    _, legs = inverse([r.lat for r in one][:-1], [r.lon for r in one][:-1], [r.lat for r in one][1:], [r.lon for r in one][1:])
    assert legs.std() < 1e-3 and abs(one[-1].lat - (56.95 + 59 * 0.0001)) < 1e-9
    rate = segments.by_sampling_rate(df, 2.0).where("traj_id = 1").orderBy("seq").collect()
    assert len(rate) == 148 and all(r.resampled for r in rate) and abs(rate[1].lat - (56.95 + 0.00004)) < 1e-8
    assert {r[KEY]: r.resampled for r in segments.by_sampling_rate(df, 50.0).collect()} == {1: False, 2: False, 3: False}
    for bad in (2, 0):
        with pytest.raises(ValueError):
            segments.by_number_of_points(df, bad)
    with pytest.raises(ValueError):
        segments.by_sampling_rate(df, 0)


def brute_labels(near, core):
    n, label, k = len(near), [-1] * len(near), 0
    visited = [False] * n
    for i in range(n):
        if visited[i]:
            continue
        visited[i] = True
        if not core[i]:
            continue
        label[i] = k
        todo = list(near[i])
        seeds = set(todo)
        for j in near[i]:
            if label[j] < 0:
                label[j] = k
        while todo:
            j = todo.pop()
            if visited[j]:
                continue
            visited[j] = True
            if label[j] < 0:
                label[j] = k
            if core[j]:
                for m in near[j]:
                    if m not in seeds:
                        seeds.add(m)
                        todo.append(m)
        k += 1
    return label


@pytest.mark.parametrize("least", [1, 2, 3, 4])
def test_density_labels(least):
    rng = np.random.default_rng(least)
    for _ in range(40):
        n = 25
        x, y = rng.uniform(0, 6, n), rng.uniform(0, 6, n)
        near = [np.flatnonzero((x - x[i]) ** 2 + (y - y[i]) ** 2 <= 1) for i in range(n)]
        grid = cluster._near_lists(x, y, None, 1.0, None)
        assert all((a == b).all() for a, b in zip(near, grid))
        core = [len(v) >= least for v in near]
        assert cluster.density_labels(near, least).tolist() == brute_labels(near, core)


def test_compress(spark):
    base = [(1, 0, 0, 56.95, 24.10), (1, 1, 5, 56.95001, 24.10), (1, 2, 10, 56.96, 24.10), (1, 3, 1000, 56.95, 24.10), (1, 4, 1005, None, None)]
    df = points(spark, base).withColumn("speed", F.col("seq").cast("double"))
    got = cluster.compress(df, 0.01).orderBy("seq").collect()
    assert [(r.seq, r.n_points, r.speed) for r in got] == [(0, 3, 0.0), (2, 1, 2.0), (4, 1, 4.0)]
    assert [r.n_points for r in cluster.compress(df, 0.01, time_threshold_s=60).orderBy("seq").collect()] == [2, 1, 1, 1]
    assert [r.speed for r in cluster.compress(df, 0.01, agg_other="last").orderBy("seq").collect()] == [3.0, 2.0, 4.0]
    assert [r.seq for r in cluster.compress(df, 0.01, min_samples=2, drop_noise=True).orderBy("seq").collect()] == [0]
    assert [r.seq for r in cluster.compress(df, 0.01, collapse=False).orderBy("seq").collect()] == [0, 2, 4]
    assert cluster.compress(df.limit(0), 0.01).count() == 0
    assert cluster.neighbour_pairs(cluster.projected(df.where("lat is not null")), 10.0).count() == 3


def test_combine(spark):
    a = points(spark, [(1, i, i * 10, 56.95, 24.1 + i * 0.001) for i in range(5)])
    b = points(spark, [(1, i, i * 10 + 5, 56.95, 24.1005 + i * 0.001) for i in range(5)]).withColumn("extra", F.lit("b"))
    got = cluster.combine([a, b]).orderBy("nn_order").collect()
    lon = [r.lon for r in got]
    assert lon == sorted(lon) and len(got) == 10
    t = [r.time for r in got]
    assert t == sorted(t) and t[0].second == 0


def test_kalman(spark):
    rng = np.random.default_rng(0)
    straight = line(50)
    spike = [(2, i, t, la + (0.01 if i == 25 else 0), lo) for _, i, t, la, lo in straight]
    noisy = [(3, i, t, la + rng.normal(0, 5e-5), lo + rng.normal(0, 5e-5)) for _, i, t, la, lo in line(250)]
    df = points(spark, [*straight, *spike, *noisy, (4, 0, 0, 1.0, 1.0), (5, 0, 0, None, None)])
    got = kalman.kalman_smooth(df).collect()
    one = sorted((r for r in got if r[KEY] == 1), key=lambda r: r.seq)
    assert all(r.kept for r in one) and max(abs(r.lat - (56.95 + r.seq * 0.0001)) for r in one) < 2e-5
    assert not next(r for r in got if r[KEY] == 2 and r.seq == 25).kept
    assert next(r for r in got if r[KEY] == 5).lat is None and len(got) == 352
    chunked = kalman.kalman_smooth(df, chunk_size=100, overlap=90).where("traj_id = 3").collect()
    assert len(chunked) == 250
    with pytest.raises(ValueError):
        kalman.kalman_smooth(df, chunk_size=10, overlap=10)
    states = kalman.kalman_smooth(df, em_iters=0, states=True).where("traj_id = 1").first()
    assert len(states.state) == 4 and len(states.q) == 16 and states.q[0] == 1.0 and states.r[0] == 100.0


def plain_kalman(xy, dt, q, r):
    """One pass of filter and smoother, row by row, as the recursions are stated."""
    n = len(xy)
    h = np.array([[1.0, 0, 0, 0], [0, 0, 1, 0]])
    f = [np.array([[1, d, 0, 0], [0, 1, 0, 0], [0, 0, 1, d], [0, 0, 0, 1]]) for d in dt]
    x, p = np.array([xy[0, 0], 0, xy[0, 1], 0]), np.diag([r[0, 0], 1, r[1, 1], 1])
    before, after, gaps = [], [], []
    for k in range(n):
        if k:
            x, p = f[k - 1] @ x, f[k - 1] @ p @ f[k - 1].T + q
        before.append((x, p))
        gaps.append((xy[k] - h @ x, h @ p @ h.T))
        if k:
            g = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
            x, p = x + g @ (xy[k] - h @ x), (np.eye(4) - g @ h) @ p
        after.append((x, p))
    xs, ps, lag = [after[-1][0]], [after[-1][1]], [np.zeros((4, 4))]
    for k in range(n - 2, -1, -1):
        c = after[k][1] @ f[k].T @ np.linalg.inv(before[k + 1][1])
        lag.insert(0, c @ ps[0])
        xs.insert(0, after[k][0] + c @ (xs[0] - before[k + 1][0]))
        ps.insert(0, after[k][1] + c @ (ps[0] - before[k + 1][1]) @ c.T)
    q1 = sum(ps[k + 1] + np.outer(xs[k + 1], xs[k + 1]) - f[k] @ (e := lag[k] + np.outer(xs[k], xs[k + 1])) - e.T @ f[k].T + f[k] @ (ps[k] + np.outer(xs[k], xs[k])) @ f[k].T for k in range(n - 1)) / max(1, n - 1) + np.zeros((4, 4))
    r1 = sum(np.outer(xy[k] - h @ xs[k], xy[k] - h @ xs[k]) + h @ ps[k] @ h.T for k in range(n)) / n
    return np.array(xs), (q1 + q1.T) / 2 + 1e-9 * np.eye(4), (r1 + r1.T) / 2 + 1e-9 * np.eye(2), gaps


@pytest.mark.parametrize(("em_iters", "em_tol"), [(0, 1e-3), (3, 1e-3), (6, 0.5)])
def test_chunks_side_by_side_are_the_plain_recursions(em_iters, em_tol):
    rng = np.random.default_rng(3)
    xy = [np.cumsum(rng.normal(0, 9, (n, 2)), axis=0) for n in (1, 2, 40, 7, 41, 3, 40)]
    seconds = [np.cumsum(rng.uniform(0.2, 9, len(v))) for v in xy]
    xy.append(rng.uniform(-5000, 5000, (35, 2)))
    seconds.append(np.cumsum(rng.exponential(30_000, 35)))  # gaps of hours, where the order of operations tells
    for v, t, (states, kept, q, r) in zip(xy, seconds, kalman.filter_chunks(xy, seconds, 1.0, 10.0, em_iters, em_tol, 0.01)):
        dt = np.maximum(1, np.diff(t))
        q1, r1 = np.diag([1, 0.01, 1, 0.01]), np.diag([100.0, 100.0])
        for _ in range(em_iters + 1):
            want, nq, nr, gaps = plain_kalman(v, dt, q1, r1)
            if not em_iters:
                break
            change = np.linalg.norm(nq - q1) / (np.linalg.norm(q1) + 1e-12) + np.linalg.norm(nr - r1) / (np.linalg.norm(r1) + 1e-12)
            q1, r1 = nq, nr
            if change < em_tol:
                want, _, _, gaps = plain_kalman(v, dt, q1, r1)
                break
        assert np.allclose(states, want, atol=1e-6) and np.allclose(q, q1) and np.allclose(r, r1)
        assert kept.tolist() == [k == 0 or bool(g @ np.linalg.inv(s + r1) @ g <= -2 * np.log(0.01)) for k, (g, s) in enumerate(gaps)]


def test_kalman_without_outliers_and_mean_noise(spark):
    df = points(spark, [(t, i, 5 * i, 56.95 + 0.0001 * i + (0.01 if i == 9 else 0), 24.1) for t in range(4) for i in range(30 + t)])
    got = kalman.kalman_smooth(df, chunk_size=10, overlap=0, outlier_alpha=None, states=True).collect()
    assert len(got) == 126 and all(r.kept for r in got)
    by = {}
    for r in got:
        by.setdefault(r[KEY], {})[tuple(r.q)] = r
    for rows in by.values():
        assert np.allclose(np.mean([r.q for r in rows.values()], axis=0), next(iter(rows.values())).q_mean)


def test_nearest_walk_is_brute_force():
    from trackloom.functions.geodesy import inverse

    rng = np.random.default_rng(8)
    for scale, n in ((1e-8, 40), (1e-4, 60), (0.3, 60), (40.0, 40)):
        lat, lon = 50 + rng.uniform(-scale, scale, n), rng.uniform(-scale, scale, n) * 2
        lat[5:9], lon[5:9] = lat[4], lon[4]
        lat[20:24] = lat[19] + np.array([1, -1, 2, -2]) * scale / 7
        lon[20:24] = lon[19]
        left, now, want = list(range(1, n)), 0, np.zeros(n, int)
        for k in range(1, n):
            _, m = inverse(np.full(len(left), lat[now]), np.full(len(left), lon[now]), lat[left], lon[left])
            now = left.pop(int(np.nan_to_num(m, nan=np.inf).argmin()))
            want[now] = k
        got = cluster.nearest_walk(lat, lon)
        _, a = inverse(lat[np.argsort(want)][:-1], lon[np.argsort(want)][:-1], lat[np.argsort(want)][1:], lon[np.argsort(want)][1:])
        _, b = inverse(lat[np.argsort(got)][:-1], lon[np.argsort(got)][:-1], lat[np.argsort(got)][1:], lon[np.argsort(got)][1:])
        assert (got == want).all() or np.allclose(a, b, atol=1e-7), scale


def test_metrics(spark):
    df = points(spark, line(8))
    same = evaluate.metrics(evaluate.lengths_geometric(df, df)).first()
    assert (same.rmf, same.precision, same.recall, same.f1) == (0.0, 1.0, 1.0, 1.0)
    away = df.withColumn("lat", F.col("lat") + F.when(F.col("seq") >= 4, 0.001).otherwise(0.0))
    part = evaluate.metrics(evaluate.lengths_geometric(away, df)).first()
    assert 0 < part.recall < 0.5 and part.f1 > 0
    still = df.withColumns({"lat": F.lit(1.0), "lon": F.lit(1.0)})
    none = evaluate.metrics(evaluate.lengths_geometric(still, df)).first()
    assert none.matched_len == none.true_len and none.f1 == 0


def test_first_of_equal(spark):
    df = points(spark, [(1, 0, 9, 1.0, 1.0), (1, 1, 2, 1.0, 1.0), (1, 2, 1, 2.0, 1.0)])
    assert sorted(r.seq for r in first_of_equal(df, KEY, "lat", "lon").collect()) == [0, 2]
