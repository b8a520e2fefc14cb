"""Road data: OSM XML and GraphML readers, the driveable predicate, tiles, and a Parquet cache."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geodesy import with_distance_batched

#: Road classes a car may use, and values of tags that keep it out.
ROADS = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "road")
MATCHER_ROADS = (*ROADS, "track")
DENIED_SERVICE = ("driveway", "parking_aisle")
DENIED_ACCESS = ("no", "private", "customers", "permit", "delivery", "destination")
ACCESS_TAGS = ("access", "vehicle", "motorcar", "motor_vehicle")
ONEWAY = ("yes", "true", "1")

WAY_SCHEMA = T.StructType([T.StructField("_id", T.LongType()), T.StructField("nd", T.ArrayType(T.StructType([T.StructField("_ref", T.LongType())]))), T.StructField("tag", T.ArrayType(T.StructType([T.StructField("_k", T.StringType()), T.StructField("_v", T.StringType())])))])
NODE_SCHEMA = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_lat", T.DoubleType()), T.StructField("_lon", T.DoubleType())])
GEOMETRY = "array<struct<lon:double,lat:double>>"


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, lat, lon) and ways (way_id, tags, nds) of an OSM XML extract; ways of one node are dropped."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema(NODE_SCHEMA).load(path).select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    ways = spark.read.format("xml").option("rowTag", "way").schema(WAY_SCHEMA).load(path)
    pairs = F.filter(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: t["_k"].isNotNull())
    ways = ways.select(F.col("_id").alias("way_id"), F.map_from_entries(F.array_distinct(pairs)).alias("tags"), F.transform("nd", lambda n: n["_ref"]).alias("nds"))
    return nodes, ways.where(F.size("nds") >= 2)


def read_osm_tiles(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and ways of extracts of overlapping tiles; of those in several extracts the last one's stay."""
    nodes, ways = zip(*(read_osm(spark, path) for path in paths))
    return merge_tiles(list(nodes), "node_id"), merge_tiles(list(ways), "way_id")


def merge_tiles(tables: list[DataFrame], key: str) -> DataFrame:
    """One row for each key of tables with equal columns, from the last table that has it; rows of null keys go.

    Rows of one key within a table are taken to be equal.
    """
    names = tables[0].columns
    every = None
    for k, table in enumerate(tables):
        part = table.select(F.col(key).alias("key"), F.struct(*names).alias("row"), F.lit(k).alias("tile"))
        every = part if every is None else every.unionByName(part)
    return every.where("key is not null").groupBy("key").agg(F.max_by("row", "tile").alias("row")).select(*[F.col("row")[n].alias(n) for n in names])


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, lon, lat) and edges (edge_id, u, v, osmid, length_m, geometry) of a GraphML cache.

    Where an edge has no geometry, it is the straight line between its ends.
    """
    data = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_VALUE", T.StringType())]))
    read = lambda tag, fields: spark.read.format("xml").option("rowTag", tag).schema(T.StructType([*fields, T.StructField("data", data)])).load(path)
    text = T.StringType()
    value = lambda k: F.element_at(F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"]))), k)
    digits = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("long")
    nodes = read("node", [T.StructField("_id", text)]).select(F.col("_id").alias("name"), value("node_id").cast("long").alias("node_id"), value("x").cast("double").alias("lon"), value("y").cast("double").alias("lat"))
    nodes = nodes.withColumn("node_id", F.coalesce("node_id", digits(F.col("name"))))
    edges = read("edge", [T.StructField("_source", text), T.StructField("_target", text)]).select("_source", "_target", digits(value("osmid")).alias("osmid"), value("length").cast("double").alias("length_m"), value("geometry_wkt").alias("wkt"))
    a = nodes.select(F.col("name").alias("_source"), F.col("node_id").alias("u"), F.struct("lon", "lat").alias("pu"))
    b = nodes.select(F.col("name").alias("_target"), F.col("node_id").alias("v"), F.struct("lon", "lat").alias("pv"))
    out = edges.join(a, "_source").join(b, "_target")
    out = out.withColumn("geometry", F.coalesce(parse_wkt(F.col("wkt")), F.array("pu", "pv")))
    out = out.withColumn("edge_id", F.xxhash64("u", "v", "osmid", "wkt")).select("edge_id", "u", "v", "osmid", "length_m", "geometry")
    return nodes.select("node_id", "lon", "lat"), out


def parse_wkt(wkt: Column) -> Column:
    """Coordinates of a WKT LINESTRING; null for null and anything else."""
    body = F.regexp_extract(wkt, r"^\s*LINESTRING\s*\((.*)\)\s*$", 1)
    point = lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("lon"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("lat"))
    return F.when(body != "", F.transform(F.split(body, ","), point))


def to_wkt(geometry: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(geometry, lambda p: F.concat_ws(" ", p["lon"], p["lat"])), ", "), F.lit(")"))


def driveable(tags: Column, profile: str = "evaluation") -> Column:
    """Whether a car may use a way: ``matcher`` also allows tracks and alleys, ``evaluation`` does not."""
    if profile not in ("matcher", "evaluation"):
        raise ValueError(f"no profile {profile!r}")
    tag = lambda k: F.lower(F.coalesce(F.element_at(tags, k), F.lit("")))
    denied = DENIED_SERVICE if profile == "matcher" else (*DENIED_SERVICE, "alley")
    open_ = tag("highway").isin(*(MATCHER_ROADS if profile == "matcher" else ROADS)) | tag("highway").rlike("^[0-9]+$")
    shut = (tag("area") == "yes") | (tag("route") == "ferry") | tag("service").isin(*denied)
    for k in ("proposed", "construction"):
        shut = shut | (tag(k) == "yes")
    for k in ACCESS_TAGS:
        shut = shut | tag(k).isin(*DENIED_ACCESS)
    return open_ & ~shut


def way_segments(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Consecutive node pairs of ways with their places (way_id, seg_no, lat_a, lon_a, lat_b, lon_b); both ends have to exist."""
    pairs = ways.select("way_id", F.posexplode(F.arrays_zip(F.slice("nds", F.lit(1), F.size("nds") - 1).alias("u"), F.slice("nds", F.lit(2), F.size("nds") - 1).alias("v"))).alias("seg_no", "p"))
    pairs = pairs.select("way_id", "seg_no", F.col("p.u").alias("u"), F.col("p.v").alias("v"))
    a = nodes.select(F.col("node_id").alias("u"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    return pairs.join(a, "u").join(b, "v").select("way_id", "seg_no", "u", "v", "lat_a", "lon_a", "lat_b", "lon_b")


def directed_edges(ways: DataFrame) -> DataFrame:
    """(way_id, u, v) for each direction in which consecutive nodes of a way may be driven."""
    one = F.lower(F.coalesce(F.element_at("tags", "oneway"), F.lit(""))).isin(*ONEWAY)
    pairs = ways.select("way_id", one.alias("oneway"), F.explode(F.arrays_zip(F.slice("nds", F.lit(1), F.size("nds") - 1).alias("u"), F.slice("nds", F.lit(2), F.size("nds") - 1).alias("v"))).alias("p"))
    pairs = pairs.select("way_id", "oneway", F.col("p.u").alias("u"), F.col("p.v").alias("v"))
    return pairs.select("way_id", "u", "v").unionByName(pairs.where("not oneway").select("way_id", F.col("v").alias("u"), F.col("u").alias("v")))


def way_edges(ways: DataFrame) -> DataFrame:
    """One edge (edge_id, u, v, osmid, oneway) for each two consecutive nodes of a way, in the way's direction."""
    one = F.lower(F.coalesce(F.element_at("tags", "oneway"), F.lit(""))).isin(*ONEWAY)
    pairs = F.arrays_zip(F.slice("nds", F.lit(1), F.size("nds") - 1).alias("u"), F.slice("nds", F.lit(2), F.size("nds") - 1).alias("v"))
    out = ways.select(F.col("way_id").alias("osmid"), one.alias("oneway"), F.posexplode(pairs).alias("seg_no", "p"))
    return out.select(F.xxhash64("osmid", "seg_no").alias("edge_id"), F.col("p.u").alias("u"), F.col("p.v").alias("v"), "osmid", "oneway")


def build_network(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends known, their geodesic end-to-end length, geometry, bounding box.

    ``edges`` has edge_id, u, v, osmid and perhaps geometry; without one it is the straight line.
    """
    a = nodes.select(F.col("node_id").alias("u"), F.col("lat").alias("ulat"), F.col("lon").alias("ulon"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("lat").alias("vlat"), F.col("lon").alias("vlon"))
    out = with_distance_batched(edges.join(a, "u").join(b, "v"), "ulat", "ulon", "vlat", "vlon", "leg").withColumnRenamed("leg_m", "length_m").drop("leg_az")
    straight = F.array(F.struct(F.col("ulon").alias("lon"), F.col("ulat").alias("lat")), F.struct(F.col("vlon").alias("lon"), F.col("vlat").alias("lat")))
    out = out.withColumn("geometry", F.coalesce("geometry", straight) if "geometry" in edges.columns else straight)
    return with_bounds(out)


def with_bounds(edges: DataFrame) -> DataFrame:
    """``minx, miny, maxx, maxy`` of each geometry, as plain columns that Parquet statistics can prune by."""
    axis = lambda k: F.transform("geometry", lambda p: p[k])
    return edges.withColumns({"minx": F.array_min(axis("lon")), "miny": F.array_min(axis("lat")), "maxx": F.array_max(axis("lon")), "maxy": F.array_max(axis("lat"))})


def filter_by_bbox(edges: DataFrame, points: DataFrame, buffer: float = 0.01) -> DataFrame:
    """Edges of the subgraph of nodes within the points' bounding box and ``buffer`` degrees; all sides inclusive."""
    box = points.agg((F.min("lat") - buffer).alias("s"), (F.max("lat") + buffer).alias("n"), (F.min("lon") - buffer).alias("w"), (F.max("lon") + buffer).alias("e"))
    inside = lambda p: F.col(f"{p}lat").between(F.col("s"), F.col("n")) & F.col(f"{p}lon").between(F.col("w"), F.col("e"))
    return edges.join(F.broadcast(box), inside("u") & inside("v")).drop("s", "n", "w", "e")


def tiles(north: float, south: float, east: float, west: float, tile_deg: float = 0.5, overlap_deg: float = 0.05) -> list[tuple[float, float, float, float]]:
    """(north, south, east, west) of tiles that cover a box, widened by an overlap within it."""
    rows, cols = max(1, math.ceil((north - south) / tile_deg)), max(1, math.ceil((east - west) / tile_deg))
    out = []
    for i in range(rows):
        for j in range(cols):
            s, w = south + i * tile_deg, west + j * tile_deg
            out.append((min(north, s + tile_deg + overlap_deg), max(south, s - overlap_deg), min(east, w + tile_deg + overlap_deg), max(west, w - overlap_deg)))
    return out


def tile_table(boxes: DataFrame, tile_deg: float = 0.5, overlap_deg: float = 0.05) -> DataFrame:
    """Tiles of each row's box (north, south, east, west): ``tile_row, tile_col`` and the tile's own sides."""
    count = lambda hi, lo: F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo)) / F.lit(tile_deg))).cast("int")
    out = boxes.withColumn("tile_row", F.explode(F.sequence(F.lit(0), count("north", "south") - 1))).withColumn("tile_col", F.explode(F.sequence(F.lit(0), count("east", "west") - 1)))
    s, w = F.col("south") + F.col("tile_row") * F.lit(tile_deg), F.col("west") + F.col("tile_col") * F.lit(tile_deg)
    return out.withColumns({"tile_n": F.least(F.col("north"), s + F.lit(tile_deg + overlap_deg)), "tile_s": F.greatest(F.col("south"), s - F.lit(overlap_deg)), "tile_e": F.least(F.col("east"), w + F.lit(tile_deg + overlap_deg)), "tile_w": F.greatest(F.col("west"), w - F.lit(overlap_deg))})


def tile_key(north: Column, south: Column, east: Column, west: Column) -> Column:
    """Key of a tile in a cache: hash of its sides to six decimals."""
    return F.sha2(F.format_string("%.6f_%.6f_%.6f_%.6f", north, south, east, west), 256)


class RoadCache:
    """Road tables kept as Parquet under one folder; deleted only when asked to be."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, name: str, table: DataFrame, by: list[str] | None = None) -> None:
        writer = table.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{name}")

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def clear(self) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
