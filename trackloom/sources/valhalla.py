"""Map matching by a Valhalla service: request bodies, replies, and a client with an injectable transport."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY, LAT, LON, SEQ, TIME

REPLY = "struct<tracepoints:array<struct<location:array<double>>>>"
Transport = Callable[[str, str], str]


def requests(points: DataFrame) -> DataFrame:
    """One request (traj_id, seqs, body) per trajectory: its places in order, to be snapped to the map."""
    rows = F.array_sort(F.collect_list(F.struct(TIME, SEQ, LAT, LON)))
    shape = F.transform("rows", lambda r: F.struct(r[LAT].alias("lat"), r[LON].alias("lon")))
    body = F.to_json(F.struct(shape.alias("shape"), F.lit(100).alias("search_radius"), F.lit("map_snap").alias("shape_match"), F.lit("auto").alias("costing"), F.lit("osrm").alias("format")))
    good = points.where(F.col(LAT).isNotNull() & F.col(LON).isNotNull())
    return good.groupBy(KEY).agg(rows.alias("rows")).select(KEY, F.transform("rows", lambda r: r[SEQ]).alias("seqs"), body.alias("body"))


def http_transport(url: str, body: str, timeout: float = 30) -> str:
    call = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(call, timeout=timeout) as reply:  # noqa: S310
        return reply.read().decode()


def send(bodies: DataFrame, url: str, transport: Transport = http_transport, retries: int = 3, wait_s: float = 0.5) -> DataFrame:
    """Replies (traj_id, seqs, reply, error): failures are rows with an error, after ``retries`` more tries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies, errors = [], []
            for body in pdf["body"]:
                reply = error = None
                for k in range(retries + 1):
                    try:
                        reply, error = transport(url, body), None
                        json.loads(reply)
                        break
                    except (OSError, ValueError) as why:
                        reply, error = None, str(why)
                        time.sleep(wait_s * 2**k if k < retries else 0)
                replies.append(reply)
                errors.append(error)
            yield pd.DataFrame({KEY: pdf[KEY], "seqs": pdf["seqs"], "reply": replies, "error": errors})

    key = bodies.schema[KEY].dataType.simpleString()
    return bodies.mapInPandas(run, f"{KEY} {key}, seqs array<bigint>, reply string, error string")


def matched_points(replies: DataFrame, points: DataFrame) -> DataFrame:
    """Points at their matched places, with ``original_lat, original_lon``; points that found none go."""
    parsed: Column = F.from_json("reply", REPLY)["tracepoints"]
    rows = replies.withColumn("p", parsed).select(KEY, F.posexplode(F.arrays_zip("seqs", F.col("p"))).alias("k", "z")).select(KEY, F.col("z.seqs").alias(SEQ), F.col("z.p.location").alias("at"))
    rows = rows.where(F.col("at").isNotNull()).select(KEY, SEQ, F.get("at", F.lit(1)).alias("m_lat"), F.get("at", F.lit(0)).alias("m_lon"))
    out = points.join(rows, [KEY, SEQ]).withColumns({"original_lat": F.col(LAT), "original_lon": F.col(LON)})
    return out.withColumns({LAT: F.col("m_lat"), LON: F.col("m_lon")}).drop("m_lat", "m_lon")


def match(points: DataFrame, url: str, transport: Transport = http_transport) -> DataFrame:
    return matched_points(send(requests(points), url, transport), points)
