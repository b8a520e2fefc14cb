"""Map sinks: GeoJSON lines, a self-contained HTML map, and SVG plots of trajectories.

Geometry is gathered per trajectory by Spark; only the lines to be drawn come to
the driver, which a caller limits by choosing trajectories.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY, LAT, LON, SEQ, TIME

#: The ten colours of a categorical palette.
PALETTE = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")
SINGLE = "#ffa500"


def color_of(k: int, n: int) -> str:
    return PALETTE[min(int(k / max(n, 1) * len(PALETTE)), len(PALETTE) - 1)]


def geojson_lines(points: DataFrame, digits: int = 6) -> DataFrame:
    """A GeoJSON LineString of each trajectory in order (traj_id, n, geometry); null coordinates are left out."""
    good = points.where(F.col(LAT).isNotNull() & F.col(LON).isNotNull())
    rows = F.array_sort(F.collect_list(F.struct(F.col(TIME).alias("t"), F.col(SEQ).alias("s"), F.round(LON, digits).alias("x"), F.round(LAT, digits).alias("y"))))
    line = F.transform("rows", lambda r: F.array(r["x"], r["y"]))
    return good.groupBy(KEY).agg(rows.alias("rows")).select(KEY, F.size("rows").cast("long").alias("n"), F.to_json(F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))).alias("geometry"))


def write_geojson(points: DataFrame, path: str) -> None:
    """One GeoJSON feature per line, written by the executors."""
    lines = geojson_lines(points)
    feature = F.concat(F.lit('{"type":"Feature","properties":{"traj_id":'), F.to_json(F.struct(F.col(KEY).alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(KEY).alias("k")))) - 6), F.lit('},"geometry":'), F.col("geometry"), F.lit("}"))
    lines.select(feature.alias("value")).write.mode("overwrite").text(path)


def _drawn(points: DataFrame, names: dict | None, limit: int) -> list[tuple[str, list[list[float]]]]:
    rows = geojson_lines(points).orderBy(KEY).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} trajectories; choose some or raise the limit")
    return [(str((names or {}).get(r[KEY]) or f"Trajectory {i + 1}"), json.loads(r["geometry"])["coordinates"]) for i, r in enumerate(rows)]


def html_map(points: DataFrame, names: dict | None = None, legend: bool = True, legend_name: str = "Color by Trajectory", limit: int = 200) -> str:
    """A self-contained HTML page with the trajectories as coloured lines, zoomable, with a legend that can be dragged."""
    lines = _drawn(points, names, limit)
    n = len(lines)
    colors = [SINGLE] if n == 1 else [color_of(k, n) for k in range(n)]
    entries = "".join(f'<div><span style="background:{c}"></span>{html.escape(name)}</div>' for (name, _), c in zip(lines, colors))
    box = f'<div id="legend"><b>{html.escape(legend_name)}</b>{entries}</div>' if legend else ""
    drag = "const l=document.getElementById('legend');if(l)l.onpointerdown=e=>{const x=e.clientX-l.offsetLeft,y=e.clientY-l.offsetTop;document.onpointermove=m=>{l.style.left=m.clientX-x+'px';l.style.top=m.clientY-y+'px';};document.onpointerup=()=>{document.onpointermove=null;};};"
    zoom = "const s=document.querySelector('svg');s.onwheel=e=>{e.preventDefault();const b=s.viewBox.baseVal,k=e.deltaY>0?1.2:1/1.2;b.x+=b.width*(1-k)/2;b.y+=b.height*(1-k)/2;b.width*=k;b.height*=k;};"
    style = "body{margin:0}svg{width:100vw;height:100vh}#legend{position:fixed;top:1em;left:1em;background:#fffc;padding:.5em;font:13px sans-serif;cursor:move}#legend span{display:inline-block;width:1em;height:.6em;margin-right:.5em}"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><style>{style}</style></head><body>{_svg(lines, colors)}{box}<script>{drag}{zoom}</script></body></html>'


def svg_plot(points: DataFrame, names: dict | None = None, limit: int = 200) -> str:
    """An SVG picture of the trajectories, longitude to the right and latitude up."""
    lines = _drawn(points, names, limit)
    return _svg(lines, [color_of(k, len(lines)) for k in range(len(lines))])


def _svg(lines: list[tuple[str, list[list[float]]]], colors: list[str]) -> str:
    flat = [p for _, line in lines for p in line] or [[0.0, 0.0]]
    x0, x1 = min(p[0] for p in flat), max(p[0] for p in flat)
    y0, y1 = min(p[1] for p in flat), max(p[1] for p in flat)
    wide = max(x1 - x0, y1 - y0, 1e-9)
    shapes = []
    for (name, line), color in zip(lines, colors):
        at = " ".join(f"{(x - x0) / wide * 1000:.2f},{(y1 - y) / wide * 1000:.2f}" for x, y in line)
        shapes.append(f'<polyline points="{at}" fill="none" stroke="{color}" stroke-width="2"><title>{html.escape(name)}</title></polyline>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="-20 -20 1040 1040">{"".join(shapes)}</svg>'
