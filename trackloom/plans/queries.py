"""Queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import direct_stages, inverse_stages, staged_sql
from ..operators import cluster, evaluate, kalman, roads, segments
from ..schema import KEY, LAT, LON, SEQ, TIME, first_of_equal
from ..sources import maps, osm, valhalla
from . import views
from .views import VIEWS_SQL

Query = Callable[[SparkSession, str], DataFrame]
GAP, MIN_POINTS = 86_400, 3
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{VIEWS_SQL.strip()}" + "".join(f",\n{p}" for p in parts)


def _legs_sql(source: str, name: str, by: str = "traj_id", order: str = "time, seq") -> str:
    """Rows of ``source`` with the leg to the next row, as common table expressions."""
    nxt = f"{name}_n AS (SELECT *, lead(lat) OVER w AS next_lat, lead(lon) OVER w AS next_lon, lead(time) OVER w AS next_time FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY {order}))"
    return nxt + ",\n" + staged_sql(f"{name}_n", inverse_stages("lat", "lon", "next_lat", "next_lon", "leg"), name)


def _length_sql(source: str, name: str) -> str:
    return _legs_sql(source, f"{name}_l") + f",\n{name} AS (SELECT traj_id, coalesce(sum(leg_m), 0) AS length_m FROM {name}_l GROUP BY traj_id)"


SEGMENTS_SQL = f"""
sg0 AS (SELECT *, CASE WHEN epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY traj_id ORDER BY time, seq) > {GAP}000000 THEN 1 ELSE 0 END AS gap FROM walk),
sg1 AS (SELECT *, sum(gap) OVER (PARTITION BY traj_id ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS run FROM sg0),
sg2 AS (SELECT *, count(*) OVER (PARTITION BY traj_id, run) > {MIN_POINTS} AS keep FROM sg1),
sg3 AS (SELECT *, max(CAST(keep AS INT)) OVER (PARTITION BY traj_id) AS any_kept FROM sg2),
sg AS (SELECT traj_id, seq, time, lat, lon, CAST(CASE WHEN any_kept = 1 THEN dense_rank() OVER (PARTITION BY traj_id ORDER BY run) - 1 ELSE 0 END AS INT) AS segment_id FROM sg3 WHERE keep OR any_kept = 0)
""".strip()


@query(_with() + " SELECT traj_id, seq, event_id, lat, lon FROM walk")
def traj_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.walk(spark, sf_dir).select(KEY, SEQ, "event_id", LAT, LON)


@query(_with() + " SELECT traj_id, CASE WHEN count(*) < 2 THEN -1.0 ELSE round((max(epoch_us(time)) - min(epoch_us(time))) / CAST(1000000 AS DOUBLE) / (count(*) - 1), 3) END AS rate_s FROM ev GROUP BY traj_id")
def sampling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.sampling_rate(views.events(spark, sf_dir))


@query(_with(SEGMENTS_SQL) + " SELECT traj_id, seq, segment_id FROM sg")
def by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.by_time(views.walk(spark, sf_dir), GAP, MIN_POINTS).select(KEY, SEQ, "segment_id")


@query(
    _with(SEGMENTS_SQL, _legs_sql("sg", "l", "traj_id, segment_id"))
    + " SELECT traj_id, segment_id, CAST(count(*) AS BIGINT) AS n, epoch_us(min(time)) AS t0, epoch_us(max(time)) AS t1, round(avg((epoch_us(next_time) - epoch_us(time)) / CAST(1000000 AS DOUBLE)), 3) AS rate_s, round(coalesce(sum(leg_m), 0), 3) AS length_m FROM l GROUP BY traj_id, segment_id"
)
def by_time_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.segment_summary(segments.by_time(views.walk(spark, sf_dir), GAP, MIN_POINTS))
    return out.withColumns({"t0": F.unix_micros("t0"), "t1": F.unix_micros("t1")})


@query(_with(_length_sql("scatter", "p")) + " SELECT traj_id, round(length_m, 3) AS length_m FROM p")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.path_length(views.scatter(spark, sf_dir)).select(KEY, F.round("length_m", 3).alias("length_m"))


@query(_with(_length_sql("walk", "m"), _length_sql("truth", "o")) + " SELECT o.traj_id, round(CASE WHEN o.length_m = 0 THEN 0 ELSE m.length_m / o.length_m END, 8) AS length_index FROM o JOIN m ON m.traj_id = o.traj_id")
def length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.length_index(views.walk(spark, sf_dir), views.truth(spark, sf_dir))
    return out.select(KEY, F.round("length_index", 8).alias("length_index"))


BEARINGS_SQL = _with(
    _legs_sql("scatter", "l"),
    "b AS (SELECT traj_id, seq, time, leg_az - floor(leg_az / 360) * 360 AS bearing FROM l)",
    "c AS (SELECT *, abs(bearing - lag(bearing) OVER (PARTITION BY traj_id ORDER BY time, seq)) AS t FROM b)",
)


@query(BEARINGS_SQL + " SELECT traj_id, seq, round(bearing, 6) AS bearing, round(CASE WHEN t IS NULL THEN NULL ELSE least(t, 360 - t) END, 6) AS turn FROM c")
def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.bearings(views.scatter(spark, sf_dir))
    return out.select(KEY, SEQ, F.round("bearing", 6).alias("bearing"), F.round("turn", 6).alias("turn"))


@query(BEARINGS_SQL + " SELECT traj_id, seq, round(least(t, 360 - t), 6) AS turn FROM c WHERE t IS NOT NULL AND least(t, 360 - t) BETWEEN 20 AND 80")
def curve_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.curve_candidates(views.scatter(spark, sf_dir)).select(KEY, SEQ, F.round("turn", 6).alias("turn"))


@query(_with("r AS (SELECT *, row_number() OVER (PARTITION BY traj_id, lat, lon ORDER BY seq) AS k FROM truth)") + " SELECT traj_id, seq, event_id FROM r WHERE k = 1")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_of_equal(views.truth(spark, sf_dir), KEY, LAT, LON).select(KEY, SEQ, "event_id")


COMBINED_SQL = _with(
    "u AS (SELECT *, 2 * seq AS nn_order FROM walk UNION ALL SELECT *, 2 * seq + 1 AS nn_order FROM truth)",
    _legs_sql("u", "l", order="nn_order"),
    "s AS (SELECT *, coalesce(sum(leg_m) OVER (PARTITION BY traj_id ORDER BY nn_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d, sum(leg_m) OVER (PARTITION BY traj_id) AS total, min(epoch_us(time)) OVER (PARTITION BY traj_id) AS t0, max(epoch_us(time)) OVER (PARTITION BY traj_id) AS t1 FROM l)",
)


@query(COMBINED_SQL + " SELECT traj_id, nn_order, round((t0 + (t1 - t0) * d / total) / 1000000, 2) AS t FROM s")
def combine_union_retime(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, t = views.walk(spark, sf_dir), views.truth(spark, sf_dir)
    both = w.withColumn("nn_order", 2 * F.col(SEQ)).unionByName(t.withColumn("nn_order", 2 * F.col(SEQ) + 1))
    out = segments.combine_times(both)
    return out.select(KEY, "nn_order", F.round(F.unix_micros(TIME) / F.lit(1e6), 2).alias("t"))


RATE = 21_600
RESAMPLE_RATE_SQL = _with(
    _legs_sql("scatter", "l"),
    "z AS (SELECT *, min(epoch_us(time)) OVER p AS t0, max(epoch_us(time)) OVER p AS t1, count(*) OVER p AS n FROM l WINDOW p AS (PARTITION BY traj_id))",
    f"ok AS (SELECT * FROM z WHERE n >= 2 AND t1 > t0 AND round((t1 - t0) / CAST(1000000 AS DOUBLE) / (n - 1), 3) >= {RATE})",
    f"k AS (SELECT DISTINCT traj_id, t0, t1, unnest(range(0, CAST(floor((t1 - t0) / {RATE}000000.0) AS BIGINT) + 1)) AS k FROM ok)",
    f"h AS (SELECT k.traj_id, k.k, o.lat, o.lon, o.leg_m, o.leg_az, (k.t0 + k.k * {RATE}000000 - epoch_us(o.time)) / CAST(epoch_us(o.next_time) - epoch_us(o.time) AS DOUBLE) AS f, row_number() OVER (PARTITION BY k.traj_id, k.k ORDER BY o.time DESC) AS pick FROM k JOIN ok o ON o.traj_id = k.traj_id AND epoch_us(o.time) <= k.t0 + k.k * {RATE}000000 AND epoch_us(o.next_time) >= k.t0 + k.k * {RATE}000000)",
    "g AS (SELECT *, f * coalesce(leg_m, 0) AS along FROM h WHERE pick = 1)",
    staged_sql("g", direct_stages("lat", "lon", "leg_az", "along", "p"), "q"),
)


@query(RESAMPLE_RATE_SQL + " SELECT traj_id, k AS seq, round(p_lat, 7) AS lat, round(p_lon, 7) AS lon, true AS resampled FROM q UNION ALL SELECT traj_id, seq, round(lat, 7), round(lon, 7), false FROM scatter WHERE traj_id NOT IN (SELECT traj_id FROM ok)")
def resample_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.by_sampling_rate(views.scatter(spark, sf_dir), RATE)
    return out.select(KEY, SEQ, F.round(LAT, 7).alias(LAT), F.round(LON, 7).alias(LON), "resampled")


NUM = 50
RESAMPLE_COUNT_SQL = _with(
    _legs_sql("scatter", "l"),
    "z AS (SELECT *, coalesce(sum(leg_m) OVER (PARTITION BY traj_id ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d, sum(leg_m) OVER (PARTITION BY traj_id) AS total FROM l)",
    f"k AS (SELECT traj_id, max(total) AS total, unnest(range(0, {NUM})) AS k FROM z GROUP BY traj_id HAVING count(*) > 1)",
    f"h AS (SELECT k.traj_id, k.k, z.lat, z.lon, z.leg_az, z.leg_m, CASE WHEN k.k = {NUM - 1} THEN k.total ELSE k.k * (k.total / {NUM - 1}.0) END - z.d AS rest, row_number() OVER (PARTITION BY k.traj_id, k.k ORDER BY z.time DESC, z.seq DESC) AS pick FROM k JOIN z ON z.traj_id = k.traj_id AND z.next_time IS NOT NULL AND z.d <= k.k * (k.total / {NUM - 1}.0) + 1e-6)",
    "g AS (SELECT *, greatest(least(rest, leg_m), 0) AS along FROM h WHERE pick = 1)",
    staged_sql("g", direct_stages("lat", "lon", "leg_az", "along", "p"), "q"),
)


@query(RESAMPLE_COUNT_SQL + " SELECT traj_id, k AS seq, round(p_lat, 6) AS lat, round(p_lon, 6) AS lon FROM q")
def resample_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.by_number_of_points(views.scatter(spark, sf_dir), NUM)
    return out.select(KEY, SEQ, F.round(LAT, 6).alias(LAT), F.round(LON, 6).alias(LON))


RADIUS = 10.0
XY_SQL = "xy AS (SELECT *, CAST('6378137.0' AS DOUBLE) * radians(lon) AS x, CAST('6378137.0' AS DOUBLE) * ln(tan(pi() / 4 + radians(lat) / 2)) AS y FROM walk)"
NEAR_SQL = f"near AS (SELECT a.traj_id, a.seq AS seq_a, b.seq AS seq_b, abs(epoch_us(a.time) - epoch_us(b.time)) AS dt FROM xy a JOIN xy b ON a.traj_id = b.traj_id AND a.seq < b.seq AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {RADIUS * RADIUS})"


def _components_sql(condition: str) -> str:
    return _with(
        XY_SQL,
        NEAR_SQL,
        f"ed AS (SELECT traj_id, seq_a AS a, seq_b AS b FROM near WHERE {condition} UNION ALL SELECT traj_id, seq_b, seq_a FROM near WHERE {condition})",
        "re AS (SELECT traj_id, seq AS low, seq AS node FROM walk UNION SELECT re.traj_id, re.low, ed.b FROM re JOIN ed ON ed.traj_id = re.traj_id AND ed.a = re.node WHERE ed.b > re.low)",
        "cl AS (SELECT traj_id, node AS seq, min(low) AS c FROM re GROUP BY traj_id, node)",
        recursive=True,
    )


@query(_with(XY_SQL, NEAR_SQL) + " SELECT traj_id, seq_a, seq_b FROM near")
def eps_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.neighbour_pairs(cluster.projected(views.walk(spark, sf_dir), use_aeqd=False), RADIUS)


_CLUSTERS = " SELECT cl.traj_id, min(walk.seq) AS seq, CAST(count(*) AS BIGINT) AS n_points, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon, min_by(event_id, walk.seq) AS event_id FROM cl JOIN walk ON walk.traj_id = cl.traj_id AND walk.seq = cl.seq GROUP BY cl.traj_id, c"


def _compressed(df: DataFrame) -> DataFrame:
    return df.select(KEY, SEQ, "n_points", F.round(LAT, 9).alias(LAT), F.round(LON, 9).alias(LON), "event_id")


@query(_components_sql("true") + _CLUSTERS)
def compress_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compressed(cluster.compress(views.walk(spark, sf_dir), RADIUS / 1000, use_aeqd=False))


@query(_components_sql("dt <= 43200000000") + _CLUSTERS)
def compress_st(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compressed(cluster.compress(views.walk(spark, sf_dir), RADIUS / 1000, 43_200, use_aeqd=False))


@query(_components_sql("true") + " SELECT cl.traj_id, min(walk.seq) AS seq, round(avg(CAST(event_id AS DOUBLE)), 4) AS event_id FROM cl JOIN walk ON walk.traj_id = cl.traj_id AND walk.seq = cl.seq GROUP BY cl.traj_id, c")
def compress_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster.compress(views.walk(spark, sf_dir), RADIUS / 1000, agg_other="mean", use_aeqd=False)
    return out.select(KEY, SEQ, F.round("event_id", 4).alias("event_id"))


@query(_components_sql("true") + " SELECT cl.traj_id, min(walk.seq) AS seq, min_by(event_id, walk.seq) AS event_id FROM cl JOIN walk ON walk.traj_id = cl.traj_id AND walk.seq = cl.seq GROUP BY cl.traj_id, c")
def compress_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.compress(views.walk(spark, sf_dir), RADIUS / 1000, collapse=False, use_aeqd=False).select(KEY, SEQ, "event_id")


@query()
def compress_minsamples_dropnoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.compress(views.walk(spark, sf_dir), RADIUS / 1000, min_samples=3, drop_noise=True, geodetic_check=True)


CHUNK, OVERLAP = 30, 5


@query(
    _with(
        "o AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY time, seq) - 1 AS pos, count(*) OVER (PARTITION BY traj_id) AS n FROM walk)",
        f"k AS (SELECT *, unnest(range(0, CAST(floor((n - 1) / {CHUNK}.0) AS BIGINT) + 1)) AS chunk FROM o)",
    )
    + f" SELECT traj_id, seq, CAST(chunk AS INT) AS chunk FROM k WHERE pos >= greatest(0, chunk * {CHUNK} - {OVERLAP}) AND pos < least(n, (chunk + 1) * {CHUNK} + {OVERLAP})"
)
def kalman_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kalman.chunk_table(views.walk(spark, sf_dir), CHUNK, OVERLAP).select(KEY, SEQ, "chunk")


@query()
def kalman_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kalman.kalman_smooth(views.walk(spark, sf_dir))


@query()
def kalman_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kalman.kalman_smooth(views.scatter(spark, sf_dir), chunk_size=CHUNK, overlap=OVERLAP).where("not kept").select(KEY, SEQ, LAT, LON)


def _pick_sql(values: tuple[str, ...], n: int) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST(p_partkey % {n} + 1 AS INT))"


TAGS_SQL = f"tags AS (SELECT p_partkey AS way_id, lower({_pick_sql(views.HIGHWAYS, 8)}) AS highway, {_pick_sql(views.SERVICES, 5)} AS service, {_pick_sql(views.ACCESSES, 7)} AS access, {_pick_sql(views.ONEWAYS, 4)} AS oneway, p_partkey % 11 = 0 AS area, p_partkey % 13 = 0 AS building FROM part)"
_ALLOWED = ", ".join(f"'{v}'" for v in osm.ROADS)
_ACCESS = ", ".join(f"'{v}'" for v in osm.DENIED_ACCESS)


@query(
    f"WITH {TAGS_SQL} SELECT way_id, (highway IN ({_ALLOWED}, 'track') OR regexp_matches(highway, '^[0-9]+$')) AND NOT area AND NOT building AND access NOT IN ({_ACCESS}) AND service NOT IN ('driveway', 'parking_aisle') AS matcher,"
    f" (highway IN ({_ALLOWED}) OR regexp_matches(highway, '^[0-9]+$')) AND NOT area AND NOT building AND access NOT IN ({_ACCESS}) AND service NOT IN ('driveway', 'parking_aisle', 'alley') AS evaluation FROM tags"
)
def driveable_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.col("tags")
    return views.ways(spark, sf_dir).select("way_id", osm.driveable(tags, "matcher").alias("matcher"), osm.driveable(tags, "evaluation").alias("evaluation"))


@query(f"WITH {TAGS_SQL}, p AS (SELECT way_id, oneway, way_id + k AS u, way_id + k + 1 AS v FROM tags, (VALUES (0), (1)) t(k)) SELECT way_id, u, v FROM p UNION ALL SELECT way_id, v, u FROM p WHERE oneway NOT IN ('yes', 'true', '1')")
def way_edges_oneway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osm.directed_edges(views.ways(spark, sf_dir))


@query(f"WITH {TAGS_SQL} SELECT way_id AS osmid, way_id + k AS u, way_id + k + 1 AS v, oneway IN ('yes', 'true', '1') AS oneway FROM tags, (VALUES (0), (1)) t(k)")
def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osm.way_edges(views.ways(spark, sf_dir)).select("osmid", "u", "v", "oneway")


NODES_SQL = "nd AS (SELECT p_partkey AS node_id, CAST('56.9' AS DOUBLE) + CAST(p_partkey % 40 AS DOUBLE) * CAST('0.001' AS DOUBLE) AS lat, CAST('24.1' AS DOUBLE) + CAST(p_partkey % 97 AS DOUBLE) * CAST('0.005' AS DOUBLE) AS lon FROM part)"
WAY_SEGMENTS_SQL = f"{NODES_SQL}, ws AS (SELECT p.p_partkey AS way_id, CAST(k AS INT) AS seg_no, a.node_id AS u, b.node_id AS v, a.lat AS lat_a, a.lon AS lon_a, b.lat AS lat_b, b.lon AS lon_b FROM part p CROSS JOIN (VALUES (0), (1)) t(k) JOIN nd a ON a.node_id = p.p_partkey + k JOIN nd b ON b.node_id = p.p_partkey + k + 1)"


@query(f"WITH {WAY_SEGMENTS_SQL} SELECT * FROM ws")
def way_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osm.way_segments(views.ways(spark, sf_dir), views.way_nodes(spark, sf_dir))


@query(f"WITH {NODES_SQL} SELECT node_id, CASE WHEN node_id % 40 >= 15 THEN lat + CAST('0.00001' AS DOUBLE) ELSE lat END AS lat, lon FROM nd")
def merged_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of two tiles that overlap; the second tile has them a little farther north."""
    nodes = views.way_nodes(spark, sf_dir)
    south = nodes.where(F.col("node_id") % 40 < 25)
    north = nodes.where(F.col("node_id") % 40 >= 15).withColumn(LAT, F.col(LAT) + views.d(0.00001))
    return osm.merge_tiles([south, north], "node_id")


GRID_SQL = f"""
gn AS (SELECT k AS node_id, CAST('56.9' AS DOUBLE) + CAST(k // {views.COLS} AS DOUBLE) * CAST('0.001' AS DOUBLE) AS lat, CAST('24.1' AS DOUBLE) + CAST(k % {views.COLS} AS DOUBLE) * CAST('0.001' AS DOUBLE) AS lon FROM range({views.ROWS * views.COLS}) t(k)),
ge AS (SELECT k AS edge_id, k AS u, k + 1 AS v, k // {views.COLS} + 1 AS osmid FROM range({views.ROWS * views.COLS}) t(k) WHERE k % {views.COLS} < {views.COLS - 1} UNION ALL SELECT k + 1000000, k, k + {views.COLS}, k % {views.COLS} + 1000 FROM range({views.ROWS * views.COLS}) t(k) WHERE k // {views.COLS} < {views.ROWS - 1}),
gg AS (SELECT ge.*, a.lat AS ulat, a.lon AS ulon, b.lat AS vlat, b.lon AS vlon FROM ge JOIN gn a ON a.node_id = u JOIN gn b ON b.node_id = v)
""".strip()


@query(f"WITH {GRID_SQL}, {staged_sql('gg', inverse_stages('ulat', 'ulon', 'vlat', 'vlon', 'leg'), 'gl')} SELECT edge_id, u, v, osmid, round(leg_m, 4) AS length_m, least(ulon, vlon) AS minx, greatest(ulat, vlat) AS maxy FROM gl")
def build_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.grid_network(spark).select("edge_id", "u", "v", "osmid", F.round("length_m", 4).alias("length_m"), "minx", "maxy")


@query(
    _with(GRID_SQL, "bx AS (SELECT min(lat) - 0.002 AS s, max(lat) + 0.002 AS n, min(lon) - 0.002 AS w, max(lon) + 0.002 AS e FROM walk)")
    + " SELECT edge_id, osmid FROM gg, bx WHERE ulat BETWEEN s AND n AND vlat BETWEEN s AND n AND ulon BETWEEN w AND e AND vlon BETWEEN w AND e"
)
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osm.filter_by_bbox(views.grid_network(spark), views.walk(spark, sf_dir), 0.002).select("edge_id", "osmid")


TILES_SQL = _with(
    "bx AS (SELECT traj_id, max(lat) AS north, min(lat) AS south, max(lon) AS east, min(lon) AS west FROM scatter GROUP BY traj_id)",
    "r AS (SELECT *, unnest(range(0, CAST(greatest(1, ceil((north - south) / CAST('0.05' AS DOUBLE))) AS BIGINT))) AS tile_row FROM bx)",
    "c AS (SELECT *, unnest(range(0, CAST(greatest(1, ceil((east - west) / CAST('0.05' AS DOUBLE))) AS BIGINT))) AS tile_col FROM r)",
)


@query(TILES_SQL + " SELECT traj_id, CAST(tile_row AS INT) AS tile_row, CAST(tile_col AS INT) AS tile_col, round(least(north, south + tile_row * CAST('0.05' AS DOUBLE) + CAST('0.055' AS DOUBLE)), 9) AS tile_n, round(greatest(west, west + tile_col * CAST('0.05' AS DOUBLE) - CAST('0.005' AS DOUBLE)), 9) AS tile_w FROM c")
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = views.scatter(spark, sf_dir).groupBy(KEY).agg(F.max(LAT).alias("north"), F.min(LAT).alias("south"), F.max(LON).alias("east"), F.min(LON).alias("west"))
    return osm.tile_table(boxes, 0.05, 0.005).select(KEY, "tile_row", "tile_col", F.round("tile_n", 9).alias("tile_n"), F.round("tile_w", 9).alias("tile_w"))


METRE_SQL = "(pi() / 180 * CAST('6371008.8' AS DOUBLE))"


def _nearest_sql(points: str, name: str) -> str:
    metre = METRE_SQL
    return (
        f"{name}_d AS (SELECT p.traj_id, p.seq, p.lat, p.lon, t.way_id, t.seg_no, sqrt(power((t.tlon - p.lon) * {metre} * cos(radians(p.lat)), 2) + power((t.tlat - p.lat) * {metre}, 2)) AS d FROM {points} p, mid t),\n"
        f"{name}_r AS (SELECT *, row_number() OVER (PARTITION BY traj_id, seq ORDER BY d, way_id, seg_no) AS k FROM {name}_d),\n"
        f"{name} AS MATERIALIZED (SELECT p.traj_id, p.seq, p.time, p.lat, p.lon, r.way_id, r.seg_no, r.d FROM {points} p LEFT JOIN {name}_r r ON r.traj_id = p.traj_id AND r.seq = p.seq AND r.k = 1)"
    )


MIDDLES_SQL = f"{WAY_SEGMENTS_SQL}, mid AS (SELECT way_id, seg_no, (lat_a + lat_b) / 2 AS tlat, (lon_a + lon_b) / 2 AS tlon FROM ws QUALIFY row_number() OVER (PARTITION BY tlat, tlon ORDER BY way_id, seg_no) = 1)"


@query(_with(MIDDLES_SQL, _nearest_sql("walk", "nw")) + " SELECT traj_id, seq, way_id, round(d, 4) AS target_m FROM nw")
def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = osm.way_segments(views.ways(spark, sf_dir), views.way_nodes(spark, sf_dir))
    targets = ws.select(F.struct("way_id", "seg_no").alias("segment"), ((F.col("lat_a") + F.col("lat_b")) / 2).alias("tlat"), ((F.col("lon_a") + F.col("lon_b")) / 2).alias("tlon"))
    return roads.nearest_by_grid(views.walk(spark, sf_dir), targets, "segment").select(KEY, SEQ, F.col("segment.way_id").alias("way_id"), F.round("target_m", 4).alias("target_m"))


ROADS_SQL = _with(
    GRID_SQL,
    "em AS (SELECT edge_id, osmid, (ulat + vlat) / 2 AS tlat, (ulon + vlon) / 2 AS tlon FROM gg)",
    # of the lattice, which lies around all points, no nearest middle is 0.003 degrees away
    f"nd AS (SELECT w.traj_id, w.seq, w.time, e.osmid, row_number() OVER (PARTITION BY w.traj_id, w.seq ORDER BY sqrt(power((e.tlon - w.lon) * {METRE_SQL} * cos(radians(w.lat)), 2) + power((e.tlat - w.lat) * {METRE_SQL}, 2)), e.edge_id) AS k FROM walk w JOIN em e ON e.tlat BETWEEN w.lat - 0.003 AND w.lat + 0.003 AND e.tlon BETWEEN w.lon - 0.003 AND w.lon + 0.003)",
    "pv AS (SELECT traj_id, seq, osmid, lag(osmid) OVER (PARTITION BY traj_id ORDER BY time, seq) AS prev_osmid FROM nd WHERE k = 1)",
)


@query(ROADS_SQL + " SELECT traj_id, seq, osmid, prev_osmid FROM pv WHERE osmid <> prev_osmid")
def road_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.road_transitions(views.walk(spark, sf_dir), views.grid_network(spark)).select(KEY, SEQ, "osmid", "prev_osmid")


GEOMETRIC_SQL = _with(
    "al AS (SELECT w.traj_id, w.seq, w.lat AS m_lat, w.lon AS m_lon, t.lat AS t_lat, t.lon AS t_lon FROM walk w JOIN truth t ON t.traj_id = w.traj_id AND t.seq = w.seq)",
    staged_sql("al", inverse_stages("m_lat", "m_lon", "t_lat", "t_lon", "gap"), "gp"),
    "nr AS MATERIALIZED (SELECT traj_id, seq, m_lat, m_lon, gap_m <= 2.0 AS near FROM gp)",
    "pr AS MATERIALIZED (SELECT a.traj_id, a.seq, a.m_lat, a.m_lon, b.m_lat AS n_lat, b.m_lon AS n_lon, a.near AND b.near AS both_ FROM nr a JOIN nr b ON b.traj_id = a.traj_id AND b.seq = a.seq + 1)",
    staged_sql("pr", inverse_stages("m_lat", "m_lon", "n_lat", "n_lon", "leg"), "pl"),
    "cm AS MATERIALIZED (SELECT traj_id, sum(CASE WHEN both_ THEN leg_m END) AS common_len FROM pl GROUP BY traj_id)",
    _length_sql("walk", "m"),
    _length_sql("truth", "o"),
    "ln AS (SELECT o.traj_id, CASE WHEN m.length_m = 0 THEN o.length_m ELSE m.length_m END AS matched_len, o.length_m AS true_len, coalesce(c.common_len, 0) AS common_len FROM o JOIN m ON m.traj_id = o.traj_id LEFT JOIN cm c ON c.traj_id = o.traj_id)",
)
TOL = 2.0


@query(GEOMETRIC_SQL + " SELECT traj_id, round(matched_len, 3) AS matched_len, round(true_len, 3) AS true_len, round(common_len, 3) AS common_len FROM ln")
def lengths_geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.lengths_geometric(views.walk(spark, sf_dir), views.truth(spark, sf_dir), TOL)
    return out.select(KEY, *[F.round(c, 3).alias(c) for c in ("matched_len", "true_len", "common_len")])


ROAD_SQL = _with(
    MIDDLES_SQL,
    _nearest_sql("walk", "nw"),
    _nearest_sql("truth", "nt"),
    "al AS (SELECT w.traj_id, w.seq, w.lat AS m_lat, w.lon AS m_lon, coalesce(w.way_id = t.way_id, false) AS same FROM nw w JOIN nt t ON t.traj_id = w.traj_id AND t.seq = w.seq)",
    "pr AS MATERIALIZED (SELECT a.traj_id, a.seq, a.m_lat, a.m_lon, b.m_lat AS n_lat, b.m_lon AS n_lon, a.same AND b.same AS both_ FROM al a JOIN al b ON b.traj_id = a.traj_id AND b.seq = a.seq + 1)",
    staged_sql("pr", inverse_stages("m_lat", "m_lon", "n_lat", "n_lon", "leg"), "pl"),
    "cm AS MATERIALIZED (SELECT traj_id, sum(CASE WHEN both_ THEN leg_m END) AS common_len FROM pl GROUP BY traj_id)",
)


@query(ROAD_SQL + " SELECT traj_id, round(coalesce(common_len, 0), 3) AS common_len FROM cm")
def lengths_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = osm.way_segments(views.ways(spark, sf_dir), views.way_nodes(spark, sf_dir))
    return evaluate.lengths_road(views.walk(spark, sf_dir), views.truth(spark, sf_dir), ws).select(KEY, F.round("common_len", 3).alias("common_len"))


def _metric(column, digits: int = 6) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lengths = evaluate.lengths_geometric(views.walk(spark, sf_dir), views.truth(spark, sf_dir), TOL)
        return lengths.select(KEY, F.round(column(), digits).alias("value"))

    return run


_METRICS = {
    "rmf": (evaluate.rmf, "CASE WHEN true_len = 0 THEN 0 ELSE abs(round((matched_len + true_len - 2 * common_len) / true_len, 10)) END"),
    "recall": (evaluate.recall, "CASE WHEN true_len = 0 THEN 0 ELSE round(common_len / true_len, 10) END"),
    "precision": (evaluate.precision, "CASE WHEN matched_len = 0 THEN 0 ELSE round(common_len / matched_len, 10) END"),
    "f1": (evaluate.f1, "CASE WHEN common_len = 0 THEN 0 ELSE 2 * (common_len / matched_len) * (common_len / true_len) / (common_len / matched_len + common_len / true_len) END"),
}
for _name, (_column, _expression) in _METRICS.items():
    _queries[_name] = _metric(_column)
    _sql[_name] = GEOMETRIC_SQL + f" SELECT traj_id, round({_expression}, 6) AS value FROM ln"


@query()
def combine_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.combine([views.walk(spark, sf_dir), views.truth(spark, sf_dir)]).select(KEY, "input", SEQ, "nn_order", LAT, LON)


@query()
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = views.walk(spark, sf_dir).groupBy(KEY).agg((F.max(SEQ) / 4).cast("int").alias("g"))
    col = (F.col(KEY) % 50) * 10
    requests = ends.select(F.col(KEY).alias("request_id"), col.cast("long").alias("from_node"), (F.least(F.col("g"), F.lit(views.ROWS - 1)) * views.COLS + col + 5).cast("long").alias("to_node"))
    return roads.shortest_paths(requests, views.grid_network(spark), buffer=0.01)


@query()
def refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.refine(views.walk(spark, sf_dir), views.grid_network(spark), max_node_m=200, buffer=0.005)


@query()
def curve_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.curve_interpolation(views.walk(spark, sf_dir), views.grid_network(spark), max_node_m=200, buffer=0.005)


@query()
def match_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.match_hmm(views.walk(spark, sf_dir), views.grid_network(spark), buffer=0.003).select(KEY, SEQ, LAT, LON, "edge_id", "osmid", "dist_m", "matched")


@query()
def service_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valhalla.requests(views.walk(spark, sf_dir))


@query(_with() + " SELECT traj_id, count(*) AS n FROM walk GROUP BY traj_id")
def map_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.geojson_lines(views.walk(spark, sf_dir)).select(KEY, "n")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
