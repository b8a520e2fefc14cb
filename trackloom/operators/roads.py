"""Operators that bring trajectories and roads together: refinement, curves, matching, nearest roads.

A trajectory meets only the edges around it: its bounding box and the edges are
put into tiles of a fixed width, joined by tile, and filtered exactly.  Then each
trajectory and its edges go to one kernel.  Nothing grows with the whole network,
so no network is ever broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.network import MatchSettings, Network, curved, matches, refined
from ..schema import KEY, LAT, LON, SEQ, TIME, first_of_equal, in_order
from ..scratch import cut

TILE = 0.25  # degrees
AROUND = "around"  # key of the trajectory that edges are around


def edges_around(points: DataFrame, edges: DataFrame, buffer: float, tile: float = TILE) -> DataFrame:
    """Edges with both ends within each trajectory's bounding box and ``buffer`` degrees, with its key; ``line`` is lon, lat, lon, lat, …; ``oneway`` is false if the edges do not have it."""
    box = boxes(points, buffer).select(F.col(KEY).alias(AROUND), "s", "n", "w", "e")
    return edges_within(box, edges, tile).select(AROUND, "edge_id", "u", "v", "osmid", "length_m", "oneway", "line")


def boxes(points: DataFrame, buffer: float) -> DataFrame:
    """Each trajectory's bounding box (s, n, w, e), wider by ``buffer`` degrees on all sides, and its number of points."""
    return points.groupBy(KEY).agg((F.min(LAT) - buffer).alias("s"), (F.max(LAT) + buffer).alias("n"), (F.min(LON) - buffer).alias("w"), (F.max(LON) + buffer).alias("e"), F.count("*").alias("points")).where("s is not null")


def edges_within(box: DataFrame, edges: DataFrame, tile: float = TILE) -> DataFrame:
    """Edges with both ends within each of the boxes (s, n, w, e, other columns), with all columns of the box."""
    oneway = F.coalesce(F.col("oneway").cast("boolean"), F.lit(False)) if "oneway" in edges.columns else F.lit(False)
    cell = lambda c: F.floor(c / F.lit(tile)).cast("int")
    near = box.withColumn("ty", F.explode(F.sequence(cell(F.col("s")), cell(F.col("n"))))).withColumn("tx", F.explode(F.sequence(cell(F.col("w")), cell(F.col("e")))))
    # an edge is filed under its first end, which has to lie in the box; each pair meets once
    filed = edges.withColumns({"ty": cell(F.col("ulat")), "tx": cell(F.col("ulon"))})
    inside = lambda p: F.col(f"{p}lat").between(F.col("s"), F.col("n")) & F.col(f"{p}lon").between(F.col("w"), F.col("e"))
    line = F.flatten(F.transform("geometry", lambda p: F.array(p["lon"], p["lat"])))
    return filed.join(near, ["ty", "tx"]).where(inside("u") & inside("v")).select(*box.columns, "edge_id", "u", "v", "osmid", "length_m", "ulat", "ulon", "vlat", "vlon", oneway.alias("oneway"), line.alias("line"))


def network_of(pdf: pd.DataFrame) -> Network:
    pdf = pdf.sort_values("edge_id", kind="stable")
    lines = [np.asarray(g, float).reshape(-1, 2) for g in pdf["line"]]
    return Network(pdf["edge_id"], pdf["u"], pdf["v"], pdf["osmid"], pdf["length_m"], lines, pdf["oneway"])


def _walk(points: DataFrame, edges: DataFrame, buffer: float, kernel) -> DataFrame:
    """Rows that ``kernel`` makes of each trajectory and its edges, first of equal places and times, in time order."""
    ready = first_of_equal(points.where(F.col(LAT).isNotNull() & F.col(LON).isNotNull()), KEY, LAT, LON, TIME)
    ready = ready.select(KEY, SEQ, F.unix_micros(TIME).alias("t"), LAT, LON)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["t", SEQ])
        rows = kernel(left[LAT].to_numpy(float), left[LON].to_numpy(float), left["t"].to_numpy(float) / 1e6, network_of(right))
        return pd.DataFrame({KEY: [left[KEY].iloc[0]] * len(rows), SEQ: np.arange(len(rows)), "t": [int(round(r[2] * 1e6)) for r in rows], LAT: [r[0] for r in rows], LON: [r[1] for r in rows], "inserted": [r[3] for r in rows]}) if len(left) else pd.DataFrame({c: [] for c in (KEY, SEQ, "t", LAT, LON, "inserted")})

    kind = points.schema[KEY].dataType
    schema = T.StructType([T.StructField(KEY, kind), T.StructField(SEQ, T.LongType()), T.StructField("t", T.LongType()), T.StructField(LAT, T.DoubleType()), T.StructField(LON, T.DoubleType()), T.StructField("inserted", T.BooleanType())])
    out = ready.groupBy(KEY).cogroup(edges_around(points, edges, buffer).groupBy(AROUND)).applyInPandas(run, schema)
    out = first_of_equal(out, KEY, LAT, LON, "t")
    out = out.withColumn(TIME, F.timestamp_micros("t")).drop("t")
    return out.withColumn(SEQ, F.row_number().over(in_order()).cast("long")).select(KEY, SEQ, TIME, LAT, LON, "inserted")


def refine(points: DataFrame, edges: DataFrame, max_node_m: float = 10, apart_m: float = 45, between_tol_m: float = 0.001, buffer: float = 0.5) -> DataFrame:
    """Trajectories with corners and routed paths put in where their road changes (``inserted``)."""
    return _walk(points, edges, buffer, lambda lat, lon, t, net: refined(lat, lon, t, net, max_node_m, apart_m, between_tol_m))


def curve_interpolation(points: DataFrame, edges: DataFrame, lower: float = 20, upper: float = 80, max_node_m: float = 10, buffer: float = 0.5) -> DataFrame:
    """Trajectories with routed paths in place of the legs that end in a turn of [lower, upper] degrees."""
    return _walk(points, edges, buffer, lambda lat, lon, t, net: curved(lat, lon, t, net, lower, upper, max_node_m))


WIDTH = 0.02  # degrees of the smallest blocks of trajectories that share their edges
SHARE = 5_000  # points of a block's part, on average


def _blocks(box: DataFrame) -> DataFrame:
    """The boxes with the block of each: the cell of its corner among cells that are wider than it, by at most twice, in parts of bounded size.

    A block's edges lie within two cells each way, so that boxes share most of
    them.  A trajectory lies in one part as a whole.
    """
    wide = F.greatest(F.col("n") - F.col("s"), F.col("e") - F.col("w"), F.lit(WIDTH))
    box = box.withColumn("level", F.ceil(F.log2(wide / F.lit(WIDTH)) - F.lit(1e-9)).cast("int"))
    size = F.lit(WIDTH) * F.pow(F.lit(2.0), F.col("level"))
    box = box.withColumns({"cy": F.floor(F.col("s") / size).cast("long"), "cx": F.floor(F.col("w") / size).cast("long")})
    parts = box.groupBy("level", "cy", "cx").agg(F.ceil(F.sum("points") / F.lit(SHARE)).cast("long").alias("parts"))
    return box.join(parts, ["level", "cy", "cx"]).withColumn("part", F.pmod(F.xxhash64(KEY), "parts")).drop("parts")


def match_hmm(points: DataFrame, edges: DataFrame, settings: MatchSettings = MatchSettings(), strict: bool = False, buffer: float = 0.01, projected: bool = False) -> DataFrame:
    """Points moved to the most likely roads, with ``edge_id, osmid, dist_m, matched``; all columns stay.

    Edges with a true ``oneway`` are driven from u to v only.  ``projected`` puts
    metres about the middle of the trajectory in place of degrees.  Points without a candidate stay where they are, unmatched; ``strict`` drops
    trajectories that have any.
    """
    block = ["level", "cy", "cx", "part"]
    box = cut(_blocks(boxes(points, buffer).where("w is not null")))
    ready = points.where(F.col(LAT).isNotNull() & F.col(LON).isNotNull()).select(KEY, SEQ, F.unix_micros(TIME).alias("t"), LAT, LON).join(box.drop("points"), KEY)
    whole = box.groupBy(*[F.col(c).alias(c) for c in block]).agg(F.min("s").alias("s"), F.max("n").alias("n"), F.min("w").alias("w"), F.max("e").alias("e"))
    around = edges_within(whole, edges)
    names = ["m_lat", "m_lon", "edge_id", "osmid", "dist_m", "matched"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([(KEY, "ascending"), ("t", "ascending"), (SEQ, "ascending")]).combine_chunks()
        net = network_of(right.to_pandas())
        order = np.argsort(right["edge_id"].to_numpy(), kind="stable")
        ulat, ulon, vlat, vlon = (right[c].to_numpy()[order] for c in ("ulat", "ulon", "vlat", "vlon"))
        lat, lon, s, n, w, e = (left[c].to_numpy() for c in (LAT, LON, "s", "n", "w", "e"))
        key = left[KEY].combine_chunks()
        starts = [0, *(np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(lat)]
        cols = []
        for a, b in zip(starts[:-1], starts[1:]):
            inside = (ulat >= s[a]) & (ulat <= n[a]) & (vlat >= s[a]) & (vlat <= n[a]) & (ulon >= w[a]) & (ulon <= e[a]) & (vlon >= w[a]) & (vlon <= e[a])
            cols.append(matches(lat[a:b], lon[a:b], net, settings, projected, inside))
        return pa.table({KEY: left[KEY], SEQ: left[SEQ], **{c: np.concatenate(v) for c, v in zip(names, zip(*cols))}})

    of = lambda name: T.StructField(name, points.schema[name].dataType)
    schema = T.StructType([of(KEY), of(SEQ), *(T.StructField(c, t()) for c, t in zip(names, (T.DoubleType, T.DoubleType, T.LongType, T.LongType, T.DoubleType, T.BooleanType)))])
    done = ready.groupBy(*block).cogroup(around.groupBy(*block)).applyInArrow(run, schema)
    out = points.join(done, [KEY, SEQ], "left").withColumns({LAT: F.coalesce("m_lat", LAT), LON: F.coalesce("m_lon", LON), "matched": F.coalesce("matched", F.lit(False)), "dist_m": F.nanvl("dist_m", F.lit(None).cast("double"))}).drop("m_lat", "m_lon")
    if strict:
        out = out.withColumn("__all", F.min("matched").over(Window.partitionBy(KEY))).where("__all").drop("__all")
    return out


PER_CELL = 32  # targets of a cell, on average
GROUP = 50_000  # points of a cell that one task takes at a time
METRE = np.pi / 180 * 6371008.8  # of a degree


def nearest_by_grid(points: DataFrame, targets: DataFrame, target_id: str) -> DataFrame:
    """For each point the target (``tlat, tlon``) with the least distance, ties to the smaller id (``target_id``, ``target_m``).

    Distances are metres on the local tangent plane of the sphere.  Cells are as
    wide as the density of targets asks for.  A point is compared with the targets
    of its cell and those around it; where the best of them is no nearer than the
    border of what was seen, the point goes on to cells three times as wide, until
    all are settled.  So the result is exact, whatever the distance, and each
    point is one row in each round.  Crowded cells are dealt to several tasks.
    Points without a place, and all if there are no targets, get nulls.
    """
    places = cut(targets.where("tlat is not null and tlon is not null").groupBy("tlat", "tlon").agg(F.min(target_id).alias("id")))
    coarse = places.agg(F.count("*").alias("n"), F.count_distinct(F.floor(F.col("tlat") * 100), F.floor(F.col("tlon") * 100)).alias("cells")).first()
    width = float(np.clip(0.01 * np.sqrt(PER_CELL * max(coarse.cells, 1) / max(coarse.n, 1)), 1e-4, 1.0))
    todo = points.where(F.col(LAT).isNotNull() & F.col(LON).isNotNull()).select(KEY, SEQ, F.col(LAT).alias("plat"), F.col(LON).alias("plon"))
    settled = None
    while coarse.n:
        got = cut(_nearest_around(todo, places, width))
        part = got.where("settled")
        settled = part if settled is None else settled.unionByName(part)
        todo = got.where("not settled").select(KEY, SEQ, "plat", "plon")
        if not todo.limit(1).count():
            break
        width *= 3
    if settled is None:
        return points.withColumns({target_id: F.lit(None).cast(targets.schema[target_id].dataType), "target_m": F.lit(None).cast("double")})
    best = settled.select(KEY, SEQ, F.col("id").alias(target_id), F.col("d").alias("target_m"))
    return points.join(best, [KEY, SEQ], "left")


def _nearest_around(points: DataFrame, places: DataFrame, width: float) -> DataFrame:
    """Nearest of the places in each point's cell and the eight around it, and whether no other place can be as near."""
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    here = points.withColumns({"cy": cell("plat"), "cx": cell("plon")})
    tasks = here.groupBy("cy", "cx").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("parts"))
    here = here.join(tasks, ["cy", "cx"]).withColumn("part", F.pmod(F.xxhash64(KEY, SEQ), F.col("parts")).cast("int")).drop("parts")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = places.withColumn("o", F.explode(around)).select("tlat", "tlon", "id", (cell("tlat") + F.col("o.i")).alias("cy"), (cell("tlon") + F.col("o.j")).alias("cx"))
    spread = spread.join(tasks, ["cy", "cx"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["id"].combine_chunks() if right.num_rows else right["id"]
        order = sorted(range(right.num_rows), key=lambda i: _sort_key(ids[i].as_py()))
        tlat, tlon = right["tlat"].to_numpy()[order], right["tlon"].to_numpy()[order]
        plat, plon = left["plat"].to_numpy(), left["plon"].to_numpy()
        shrink = np.array([math.cos(v) for v in np.radians(plat).tolist()])
        pick, best = np.full(len(plat), -1), np.full(len(plat), np.inf)
        step = max(1, 2_000_000 // max(len(order), 1))
        for at in range(0, len(plat) if order else 0, step):
            some = slice(at, at + step)
            dx, dy = (tlon - plon[some, None]) * METRE * shrink[some, None], (tlat - plat[some, None]) * METRE
            d = np.sqrt(dx * dx + dy * dy)
            pick[some] = d.argmin(axis=1)
            best[some] = d.min(axis=1)
        cy, cx = np.floor(plat / width), np.floor(plon / width)
        up = np.minimum(plat - (cy - 1) * width, (cy + 2) * width - plat) * METRE
        side = np.minimum(plon - (cx - 1) * width, (cx + 2) * width - plon) * METRE * np.maximum(shrink, 0)
        sure = (best < np.minimum(up, side) * (1 - 1e-9)) | (width >= 360)
        found = pa.array([order[k] if k >= 0 else None for k in pick.tolist()], pa.int64())
        chosen = ids.take(found) if right.num_rows else pa.nulls(len(plat), right.schema.field("id").type)
        return pa.table({KEY: left[KEY], SEQ: left[SEQ], "plat": left["plat"], "plon": left["plon"], "d": pa.array(np.where(pick >= 0, best, np.nan), mask=pick < 0), "id": chosen, "settled": pa.array(sure)})

    of = lambda df, name: T.StructField(name, df.schema[name].dataType)
    schema = T.StructType([of(points, KEY), of(points, SEQ), of(points, "plat"), of(points, "plon"), T.StructField("d", T.DoubleType()), of(places, "id"), T.StructField("settled", T.BooleanType())])
    return here.groupBy("cy", "cx", "part").cogroup(spread.groupBy("cy", "cx", "part")).applyInArrow(nearest, schema)


def _sort_key(value) -> tuple:
    return tuple(value.values()) if isinstance(value, dict) else (value,)


def road_transitions(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows whose nearest road (by its middle) differs from that of the row before: ``osmid`` and ``prev_osmid``."""
    middle = lambda k: (F.col(f"u{k}") + F.col(f"v{k}")) / 2
    targets = edges.select(F.col("edge_id"), "osmid", middle("lat").alias("tlat"), middle("lon").alias("tlon"))
    near = nearest_by_grid(points, targets.drop("osmid"), "edge_id").join(targets.select("edge_id", "osmid"), "edge_id", "left")
    return near.withColumn("prev_osmid", F.lag("osmid").over(in_order())).where("osmid <> prev_osmid")


def shortest_paths(requests: DataFrame, edges: DataFrame, buffer: float = 0.05) -> DataFrame:
    """Routes (request_id, step, node_id, cum_m) between node pairs (request_id, from_node, to_node).

    Each distinct pair is routed once, on the edges around its ends.
    """
    ends = edges.select(F.col("u").alias("node"), F.col("ulat").alias("lat"), F.col("ulon").alias("lon")).unionByName(edges.select(F.col("v").alias("node"), F.col("vlat").alias("lat"), F.col("vlon").alias("lon"))).dropDuplicates(["node"])
    pairs = requests.select("from_node", "to_node").distinct().withColumn(KEY, F.xxhash64("from_node", "to_node"))
    places = pairs.select(KEY, F.explode(F.array("from_node", "to_node")).alias("node")).join(ends, "node").select(KEY, LAT, LON)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        net = network_of(right)
        rows = []
        for a, b in zip(left["from_node"].tolist(), left["to_node"].tolist()):
            path = net.shortest_path(a, b) or []
            total = 0.0
            for k, node in enumerate(path):
                total += min(w for y, w, _ in net.near[path[k - 1]] if y == node) if k else 0.0
                rows.append((a, b, k, node, total))
        return pd.DataFrame(rows, columns=["from_node", "to_node", "step", "node_id", "cum_m"])

    found = pairs.groupBy(KEY).cogroup(edges_around(places, edges, buffer).groupBy(AROUND)).applyInPandas(run, "from_node long, to_node long, step long, node_id long, cum_m double")
    return requests.join(found, ["from_node", "to_node"]).select("request_id", "step", "node_id", "cum_m")
