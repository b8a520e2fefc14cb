"""Trajectories, truth and road networks derived from the test tables, by arithmetic that any engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import KEY, LAT, LON, SEQ, TIME
from ..sources.osm import build_network

ROWS, COLS = 32, 520  # of the lattice of roads, 0.001 degrees apart


def d(x: float):
    return F.lit(x).cast("double")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of each user in order, without places yet."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias(KEY), "event_id", F.col("ts").cast("timestamp").alias(TIME))
    return rows.withColumn(SEQ, F.row_number().over(Window.partitionBy(KEY).orderBy(TIME, "event_id")).cast("long"))


def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf_dir).select(KEY, SEQ, TIME, "event_id", (d(56.90) + (e * 7919 % 1000) / d(10000.0)).alias(LAT), (d(24.0) + (e * 104729 % 2000) / d(10000.0)).alias(LON))


def walk(spark: SparkSession, sf_dir: str, jitter: bool = True) -> DataFrame:
    """Groups of four fixes a few metres wide, groups some 100 m apart; without jitter the truth of it."""
    e, g = F.col("event_id"), F.floor((F.col(SEQ) - 1) / 4).cast("double")
    lat = d(56.90) + g * d(0.001)
    lon = d(24.10) + (F.col(KEY) % 50).cast("double") * d(0.01) + g * d(0.0005)
    if jitter:
        lat, lon = lat + (e * 7919 % 11).cast("double") * d(0.000005), lon + (e * 104729 % 13).cast("double") * d(0.000005)
    return events(spark, sf_dir).select(KEY, SEQ, TIME, "event_id", lat.alias(LAT), lon.alias(LON))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk(spark, sf_dir, jitter=False)


def grid_nodes(spark: SparkSession, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    k = F.col("id")
    return spark.range(rows * cols).select(k.alias("node_id"), (d(56.90) + F.floor(k / cols).cast("double") * d(0.001)).alias(LAT), (d(24.10) + (k % cols).cast("double") * d(0.001)).alias(LON))


def grid_edges(spark: SparkSession, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """Roads of a lattice: every row a road (osmid from 1), every column another (from 1000)."""
    k = F.col("id")
    cells = spark.range(rows * cols)
    across = cells.where(k % cols < cols - 1).select(k.alias("edge_id"), k.alias("u"), (k + 1).alias("v"), (F.floor(k / cols) + 1).cast("long").alias("osmid"))
    up = cells.where(F.floor(k / cols) < rows - 1).select((k + 1_000_000).alias("edge_id"), k.alias("u"), (k + cols).alias("v"), (k % cols + 1000).cast("long").alias("osmid"))
    return across.unionByName(up)


def grid_network(spark: SparkSession, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    return build_network(grid_nodes(spark, rows, cols), grid_edges(spark, rows, cols))


HIGHWAYS = ("residential", "Primary", "footway", "track", "service", "42", "motorway_link", "proposed")
SERVICES = ("", "alley", "driveway", "", "bus")
ACCESSES = ("", "private", "yes", "", "destination", "", "no")
ONEWAYS = ("yes", "no", "", "1")


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A way of three nodes for each part, with tags that cycle through what the predicates ask about."""
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    tags = F.create_map(F.lit("highway"), pick(HIGHWAYS, 8), F.lit("service"), pick(SERVICES, 5), F.lit("access"), pick(ACCESSES, 7), F.lit("oneway"), pick(ONEWAYS, 4), F.lit("area"), F.when(k % 11 == 0, "yes").otherwise("no"), F.lit("construction"), F.when(k % 13 == 0, "yes").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("way_id"), tags.alias("tags"), F.array(k, k + 1, k + 2).alias("nds"))


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("node_id"), (d(56.90) + (k % 40).cast("double") * d(0.001)).alias(LAT), (d(24.10) + (k % 97).cast("double") * d(0.005)).alias(LON))


VIEWS_SQL = """
ev AS (SELECT user_id AS traj_id, event_id, ts AS time, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq FROM events),
scatter AS (SELECT traj_id, seq, time, event_id, CAST(56.90 AS DOUBLE) + (event_id * 7919 % 1000) / CAST(10000 AS DOUBLE) AS lat, CAST(24.0 AS DOUBLE) + (event_id * 104729 % 2000) / CAST(10000 AS DOUBLE) AS lon FROM ev),
truth AS (SELECT traj_id, seq, time, event_id, CAST(56.90 AS DOUBLE) + floor((seq - 1) / 4.0) * CAST(0.001 AS DOUBLE) AS lat, CAST(24.10 AS DOUBLE) + CAST(traj_id % 50 AS DOUBLE) * CAST(0.01 AS DOUBLE) + floor((seq - 1) / 4.0) * CAST(0.0005 AS DOUBLE) AS lon FROM ev),
walk AS (SELECT traj_id, seq, time, event_id, lat + CAST(event_id * 7919 % 11 AS DOUBLE) * CAST(0.000005 AS DOUBLE) AS lat, lon + CAST(event_id * 104729 % 13 AS DOUBLE) * CAST(0.000005 AS DOUBLE) AS lon FROM truth)
"""
