"""Constant-velocity Kalman filter, Rauch-Tung-Striebel smoother and EM, by chunks of a trajectory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geodesy import aeqd, aeqd_back
from ..schema import KEY, LAT, LON, SEQ, TIME

def chunk_table(points: DataFrame, chunk_size: int | None, overlap: int = 50) -> DataFrame:
    """Points with ``pos`` (0-based order), ``n`` and one row per chunk they are in (``chunk``, first and last position).

    Chunk k has the rows from k * chunk_size - overlap to (k + 1) * chunk_size + overlap.
    """
    if chunk_size is not None and overlap >= chunk_size:
        raise ValueError("overlap has to be less than chunk_size")
    order = Window.partitionBy(KEY).orderBy(TIME, SEQ)
    out = points.withColumns({"pos": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy(KEY))})
    if chunk_size is None:
        return out.withColumns({"chunk": F.lit(0), "lo": F.lit(0), "hi": F.col("n").cast("int")})
    last = F.floor((F.col("n") - 1) / chunk_size)
    first_in = F.greatest(F.lit(0), F.floor((F.col("pos") - overlap) / chunk_size))
    last_in = F.least(last, F.floor((F.col("pos") + overlap) / chunk_size))
    out = out.withColumn("chunk", F.explode(F.sequence(first_in.cast("int"), last_in.cast("int"))))
    return out.withColumns({"lo": F.greatest(F.lit(0), F.col("chunk") * chunk_size - overlap), "hi": F.least(F.col("n"), (F.col("chunk") + 1) * chunk_size + overlap)}).where("pos >= lo and pos < hi")


BATCH = 100_000  # rows that are filtered at a time, chunks side by side


class Chunks:
    """Planar observations of many chunks, longest first, padded to one length; step k of all is one operation."""

    def __init__(self, xy: list[np.ndarray], seconds: list[np.ndarray]) -> None:
        self.size = np.array([len(v) for v in xy])
        b, n = len(xy), int(self.size.max())
        self.xy, self.dt = np.zeros((b, n, 2)), np.ones((b, max(n - 1, 0)))
        for i, (v, t) in enumerate(zip(xy, seconds)):
            self.xy[i, : len(v)] = v
            self.dt[i, : len(v) - 1] = np.maximum(1.0, np.diff(t))

    def some(self, which: np.ndarray) -> Chunks:
        out = object.__new__(Chunks)
        out.size = self.size[which]
        n = int(out.size.max())
        out.xy, out.dt = self.xy[which, :n], self.dt[which, : max(n - 1, 0)]
        return out

    def move(self, k: int, m: int) -> np.ndarray:
        """Transition from row k to row k + 1 of the first m chunks."""
        out = np.tile(np.eye(4), (m, 1, 1))
        out[:, 0, 1] = out[:, 2, 3] = self.dt[:m, k]
        return out


def _turned(x: np.ndarray) -> np.ndarray:
    return x.transpose(0, 2, 1)


def _inverse(x: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(x)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(x)


def smooth(chunks: Chunks, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One E-step: smoothed states and covariances, lag-one covariances, innovations and the predicted part of their covariances."""
    b, n = chunks.xy.shape[:2]
    xp, pp, xf, pf = np.zeros((b, n, 4)), np.zeros((b, n, 4, 4)), np.zeros((b, n, 4)), np.zeros((b, n, 4, 4))
    innovation, spread = np.zeros((b, n, 2)), np.zeros((b, n, 2, 2))
    x, p = np.zeros((b, 4)), np.tile(np.eye(4), (b, 1, 1))
    x[:, 0], x[:, 2] = chunks.xy[:, 0, 0], chunks.xy[:, 0, 1]
    p[:, 0, 0], p[:, 2, 2] = r[:, 0, 0], r[:, 1, 1]
    for k in range(n):
        m = int((chunks.size > k).sum())
        x, p = x[:m], p[:m]
        if k:
            f = chunks.move(k - 1, m)
            x, p = (f @ x[:, :, None])[:, :, 0], f @ p @ _turned(f) + q[:m]
        xp[:m, k], pp[:m, k] = x, p
        seen = p[:, :, [0, 2]]
        spread[:m, k] = seen[:, [0, 2]]
        innovation[:m, k] = chunks.xy[:m, k] - x[:, [0, 2]]
        if k:
            gain = seen @ np.linalg.inv(spread[:m, k] + r[:m])
            x = x + (gain @ innovation[:m, k, :, None])[:, :, 0]
            lost = np.zeros((m, 4, 4))
            lost[:, :, [0, 2]] = gain
            p = (np.eye(4) - lost) @ p  # in this order: after long gaps p less gain times seen would lose all digits
        xf[:m, k], pf[:m, k] = x, p
    xs, ps, lag = xf.copy(), pf.copy(), np.zeros((b, n, 4, 4))
    for k in range(n - 2, -1, -1):
        m = int((chunks.size > k + 1).sum())
        c = pf[:m, k] @ _turned(chunks.move(k, m)) @ _inverse(pp[:m, k + 1])
        xs[:m, k] = xf[:m, k] + (c @ (xs[:m, k + 1] - xp[:m, k + 1])[:, :, None])[:, :, 0]
        ps[:m, k] = pf[:m, k] + c @ (ps[:m, k + 1] - pp[:m, k + 1]) @ _turned(c)
        lag[:m, k] = c @ ps[:m, k + 1]
    return xs, ps, lag, innovation, spread


def new_noise(chunks: Chunks, xs: np.ndarray, ps: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The M-step: process and observation noise of each chunk, symmetric and a little regularised."""
    b, n = chunks.xy.shape[:2]
    q, r = np.zeros((b, 4, 4)), np.zeros((b, 2, 2))
    outer = lambda u, v: u[:, :, None] * v[:, None, :]
    for k in range(n):
        m = int((chunks.size > k).sum())
        gap = chunks.xy[:m, k] - xs[:m, k][:, [0, 2]]
        r[:m] += outer(gap, gap) + ps[:m, k][:, [0, 2]][:, :, [0, 2]]
        m = int((chunks.size > k + 1).sum())
        if m:
            f = chunks.move(k, m)
            e00 = ps[:m, k] + outer(xs[:m, k], xs[:m, k])
            e11 = ps[:m, k + 1] + outer(xs[:m, k + 1], xs[:m, k + 1])
            e01 = lag[:m, k] + outer(xs[:m, k], xs[:m, k + 1])
            q[:m] += e11 - f @ e01 - _turned(e01) @ _turned(f) + f @ e00 @ _turned(f)
    q /= np.maximum(1, chunks.size - 1)[:, None, None]
    r /= chunks.size[:, None, None]
    return (q + _turned(q)) / 2 + 1e-9 * np.eye(4), (r + _turned(r)) / 2 + 1e-9 * np.eye(2)


def filter_chunks(xy: list[np.ndarray], seconds: list[np.ndarray], process_std: float, measure_std: float, em_iters: int, em_tol: float, alpha: float | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Smoothed states, kept flags, and the noises last estimated, of each chunk of planar observations."""
    order = sorted(range(len(xy)), key=lambda i: -len(xy[i]))
    chunks = Chunks([xy[i] for i in order], [seconds[i] for i in order])
    b = len(order)
    q0 = process_std**2
    q = np.tile(np.diag([q0, max(0.01 * q0, 1e-6)] * 2), (b, 1, 1))
    r = np.tile(np.diag([measure_std**2] * 2), (b, 1, 1))
    states, innovation, spread = np.zeros((*chunks.xy.shape[:2], 4)), np.zeros(chunks.xy.shape), np.zeros((*chunks.xy.shape, 2))

    def keep(which: np.ndarray, done: tuple) -> None:
        n = done[0].shape[1]
        states[which, :n], innovation[which, :n], spread[which, :n] = done[0], done[3], done[4]

    todo = np.arange(b)
    for _ in range(em_iters + 1):
        part = chunks.some(todo)
        done = smooth(part, q[todo], r[todo])
        keep(todo, done)
        if not em_iters:
            break
        q1, r1 = new_noise(part, *done[:3])
        size = lambda x: np.sqrt((x * x).sum(axis=(1, 2)))
        change = size(q1 - q[todo]) / (size(q[todo]) + 1e-12) + size(r1 - r[todo]) / (size(r[todo]) + 1e-12)
        q[todo], r[todo] = q1, r1
        still = change < em_tol
        if still.any():
            settled = todo[still]
            keep(settled, smooth(chunks.some(settled), q[settled], r[settled]))
            todo = todo[~still]
        if not len(todo):
            break
    # the states are those of the last smoothing; outliers are judged with the noise estimated from it
    out: list = [None] * b
    for place, i in enumerate(order):
        n = len(xy[i])
        kept = np.ones(n, bool)
        if alpha is not None:
            gap = innovation[place, :n]
            distance = np.einsum("ki,kij,kj->k", gap, np.linalg.inv(spread[place, :n] + r[place]), gap)
            kept = distance <= -2 * np.log(alpha)  # the chi-squared quantile of two degrees of freedom in closed form
            kept[0] = True
        out[i] = states[place, :n], kept, q[place], r[place]
    return out


def kalman_smooth(points: DataFrame, process_noise_std_m: float = 1.0, measurement_noise_std_m: float = 10.0, em_iters: int = 3, em_tol: float = 1e-3, chunk_size: int | None = None, overlap: int = 50, outlier_alpha: float | None = 0.01, per_chunk_aeqd: bool = True, states: bool = False) -> DataFrame:
    """Smoothed places in ``lat, lon``, with ``kept`` false for outliers (they are flagged, not removed).

    Chunks of a trajectory are filtered in parallel, and ``overlap`` rows on inner
    sides are trimmed; rows filled twice get the mean, and are kept if both say
    so.  Without ``outlier_alpha`` all rows are kept.  Rows with null coordinates, and
    what no chunk fills, stay as they are.  Chunks stream through a task in order, and
    those of about ``BATCH`` rows are filtered side by side.  With ``states`` the state
    (x, vx, y, vy) about the chunk's centre and the noises (Q and R, row by row) come
    along, and the means of the noises over the trajectory's chunks.
    """
    whole = Window.partitionBy(KEY)
    good = points.where(F.col(LAT).isNotNull() & F.col(LON).isNotNull())
    good = good.select(KEY, SEQ, TIME, LAT, LON).withColumns({"lat0": F.avg(LAT).over(whole), "lon0": F.avg(LON).over(whole)})
    dealt = chunk_table(good, chunk_size, overlap).withColumn("t", F.unix_micros(TIME).cast("double") / F.lit(1e6))

    def filtered(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """The inner rows of whole chunks that begin at ``starts``."""
        lo, hi, n, pos, t, lat, lon, lat0, lon0 = (rows[c].to_numpy() for c in ("lo", "hi", "n", "pos", "t", LAT, LON, "lat0", "lon0"))
        parts = [slice(a, b) for a, b in zip(starts, np.append(starts[1:], rows.num_rows))]
        centres = [(lat[p].mean(), lon[p].mean()) if per_chunk_aeqd else (lat0[p][0], lon0[p][0]) for p in parts]
        done = filter_chunks([np.column_stack(aeqd(lat[p], lon[p], *c)) for p, c in zip(parts, centres)], [t[p] for p in parts], process_noise_std_m, measurement_noise_std_m, em_iters, em_tol, outlier_alpha)
        back = [aeqd_back(x[:, 0], x[:, 2], *c) for (x, *_), c in zip(done, centres)]
        inner = np.flatnonzero(((lo == 0) | (pos >= lo + overlap)) & ((hi >= n) | (pos < hi - overlap)))
        state = np.concatenate([x for x, *_ in done])
        chunk = np.repeat(np.arange(len(parts)), [p.stop - p.start for p in parts])[inner]
        wide = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        made = [np.concatenate([b[0] for b in back])[inner], np.concatenate([b[1] for b in back])[inner], np.concatenate([k for _, k, *_ in done])[inner]]
        noise = [wide(np.array([d[i].ravel() for d in done])[chunk]) for i in (2, 3)] if states else []
        picked = rows.take(pa.array(inner)).combine_chunks()
        column = lambda c: picked[c].chunk(0) if picked.num_rows else picked[c].combine_chunks()
        return pa.RecordBatch.from_arrays([column(KEY), column(SEQ), column("chunk"), *map(pa.array, made), *([wide(state[inner]), *noise] if states else [])], [*schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= BATCH:
                rows = pa.Table.from_batches(held)
                starts = _starts(rows)
                last = int(starts[-1])
                if last:
                    yield filtered(rows.slice(0, last), starts[:-1])
                held, size = rows.slice(last).to_batches(), rows.num_rows - last
        if size:
            rows = pa.Table.from_batches(held)
            yield filtered(rows, _starts(rows))

    row = T.ArrayType(T.DoubleType())
    extra = [T.StructField(c, row) for c in ("state", "q", "r")] if states else []
    schema = T.StructType([T.StructField(KEY, points.schema[KEY].dataType), T.StructField(SEQ, T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("s_lat", T.DoubleType()), T.StructField("s_lon", T.DoubleType()), T.StructField("kept", T.BooleanType()), *extra])
    dealt = dealt.select(KEY, F.col("chunk").cast("int").alias("chunk"), F.col(SEQ).cast("long").alias(SEQ), "pos", "lo", "hi", "n", "t", LAT, LON, "lat0", "lon0")
    done = dealt.repartition(KEY, "chunk").sortWithinPartitions(KEY, "chunk", "pos").mapInArrow(run, schema)
    dealt_noise = done.groupBy(KEY, "chunk").agg(F.first("q").alias("q"), F.first("r").alias("r")) if states else None
    more = [F.first(c).alias(c) for c in ("state", "q", "r")] if states else []
    done = done.groupBy(KEY, SEQ).agg(F.avg("s_lat").alias("s_lat"), F.avg("s_lon").alias("s_lon"), F.bool_and("kept").alias("kept"), *more)
    out = points.join(done, [KEY, SEQ], "left")
    if states:
        out = out.join(_mean_noise(dealt_noise, "q").join(_mean_noise(dealt_noise, "r"), KEY), KEY, "left")
    return out.withColumns({LAT: F.coalesce("s_lat", LAT), LON: F.coalesce("s_lon", LON), "kept": F.coalesce("kept", F.lit(True))}).drop("s_lat", "s_lon")


def _starts(rows: pa.Table) -> np.ndarray:
    """Places at which a chunk begins, in rows ordered by trajectory and chunk."""
    chunk, pos = rows["chunk"].to_numpy(), rows["pos"].to_numpy()
    # within a chunk positions follow each other; the first of the next is in another chunk or no higher
    new = (chunk[1:] != chunk[:-1]) | (pos[1:] != pos[:-1] + 1)
    return np.concatenate(([0], np.flatnonzero(new) + 1))


def _mean_noise(noise: DataFrame, name: str) -> DataFrame:
    """Mean over a trajectory's chunks of a noise matrix, row by row, as ``<name>_mean``."""
    each = noise.select(KEY, F.posexplode(name).alias("i", "v")).groupBy(KEY, "i").agg(F.avg("v").alias("v"))
    return each.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias(f"{name}_mean"))
