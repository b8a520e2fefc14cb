from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trackloom.schema import KEY
from trackloom.streaming import live

from test_trajectories import line, points


@pytest.fixture
def source(spark, tmp_path):
    rows = points(spark, [*line(30, 1), *line(30, 1, start=1000.0), *line(4, 2), (9, 0, 9000.0, 1.0, 1.0)])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def run(df, mode, name, spark, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_sessions(spark, source, tmp_path):
    got = run(live.session_segments(source), "append", "sessions", spark, tmp_path)
    assert sorted((r[KEY], r.n) for r in got) == [(1, 30), (1, 30)]


def test_running_rate(spark, source, tmp_path):
    got = run(live.running_rate(source.where(F.col(KEY) == 2)), "update", "rates", spark, tmp_path)
    assert [(r[KEY], r.n, r.rate_s) for r in got] == [(2, 4, 5.0)]


def test_forward_filter(spark, source, tmp_path):
    got = run(live.forward_filter(source.where(F.col(KEY) == 2)), "append", "filtered", spark, tmp_path)
    assert len(got) == 4 and max(abs(r.lat - (56.95 + r.seq * 0.0001)) for r in got) < 5e-4
