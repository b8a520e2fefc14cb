"""Packing by cutting-stock column generation.

Every document is cut into pieces of ``width`` tokens and a rest.  Only the
histogram of piece lengths, in classes, goes to the driver: lengths up to 64
are classes of their own, longer ones are rounded up by less than 2 %, which
keeps the program small enough to be solved to its optimum.  There a linear
program over patterns, each a multiset of lengths that fits a sequence,
is solved by column generation: the knapsack that prices a new pattern is solved
by dynamic programming over the width.  Patterns are used as often as the
rounded-down solution says; the few pieces left over are packed best-fit.
Pieces are ranked within their length, and a pattern's places are intervals of
those ranks, so that each piece finds its sequence by a look-up.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import small_batches, written
from .tokens import END, id_lists

WIDTH = 1024
PART = 4096  # pieces of one length that are ranked together, on average
ROUNDS = 1500  # patterns that column generation makes at most
GAP = 0.001  # of sequences over the bound at which column generation ends
SMOOTH = (0.9, 0.6, 0.3, 0.0)  # weights of the best dual point in a price


def length_class(n: Column, width: int = WIDTH) -> Column:
    """Length that a piece of ``n`` tokens counts as: steps of 1, then 2, 4, 8 from 64, 128, 256 on."""
    up = lambda k: F.ceil(n / k) * k
    got = F.when(n <= 64, n).when(n <= 128, up(2)).when(n <= 256, up(4)).otherwise(up(8))
    return F.least(got, F.lit(width)).cast("long")


def price(values: np.ndarray, lengths: np.ndarray, width: int) -> tuple[float, dict[int, int]]:
    """Most valuable pattern: the unbounded knapsack by dynamic programming over capacities."""
    best = np.zeros(width + 1)
    took = np.full(width + 1, -1)
    order = np.argsort(lengths)
    sizes, gains = lengths[order], values[order]
    fits = np.searchsorted(sizes, np.arange(width + 1), side="right")
    for c in range(1, width + 1):
        best[c] = best[c - 1]
        k = fits[c]
        if k:
            got = best[c - sizes[:k]] + gains[:k]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-12:
                best[c], took[c] = got[j], order[j]
    pattern: dict[int, int] = {}
    c = width
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[int(took[c])] = pattern.get(int(took[c]), 0) + 1
            c -= int(lengths[took[c]])
    return float(best[width]), pattern


def best_fit(left: dict[int, int], width: int = WIDTH) -> dict[tuple[int, ...], int]:
    """Best fit decreasing: sorted lengths of each sequence, and how many sequences have them.

    Works on counts: as many sequences with the same gap as there are pieces of
    a length take one at a time, so that its steps depend on the lengths alone.
    """
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for n in sorted((k for k, v in left.items() if v), reverse=True):
        todo = left[n]
        while todo:
            gap = next((g for g in range(n, width) if open_.get(g)), None)
            if gap is None:
                each = min(todo, width // n)
                times = todo // each
                at = open_.setdefault(width - n * each, {})
                key = (n,) * each
            else:
                old, have = next(iter(open_[gap].items()))
                each = min(gap // n, todo)
                times = min(have, todo // each)
                if times == have:
                    del open_[gap][old]
                else:
                    open_[gap][old] = have - times
                at = open_.setdefault(gap - n * each, {})
                key = old + (n,) * each
            at[key] = at.get(key, 0) + times
            todo -= times * each
    out: dict[tuple[int, ...], int] = {}
    for same in open_.values():
        for key, times in same.items():
            out[key] = out.get(key, 0) + times
    return out


def patterns(lengths: np.ndarray, counts: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS, gap: float = GAP) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often the linear program uses each, to hold all ``counts``.

    Revised simplex with an explicit basis inverse, from the basis of the
    patterns that repeat one length.  Known patterns, at first those of best
    fit, are priced by a matrix product; when none improves, the knapsack makes
    a new one.  Its prices are smoothed towards the best dual point so far, else
    they swing.  Farley's bound tells how far the optimum may still be; ``gap``
    ends the rounds.
    """
    m = len(lengths)
    if not m:
        return []
    at = {int(n): i for i, n in enumerate(lengths)}
    basis = [{i: int(width // lengths[i])} for i in range(m)]
    pool = list(basis)
    for key in best_fit(dict(zip(lengths.tolist(), counts.tolist())), width):
        pool.append({at[n]: key.count(n) for n in set(key)})
    known = np.zeros((m, len(pool) + rounds))
    for k, p in enumerate(pool):
        known[list(p), k] = list(p.values())
    inverse = np.diag([1.0 / c[i] for i, c in enumerate(basis)])
    need = counts.astype(float)
    x = inverse @ need
    centre = lengths / width
    bound = float(need @ centre)
    made = 0
    for _ in range(20 * (m + rounds)):
        duals = inverse.sum(axis=0)
        worth = duals @ known[:, : len(pool)]
        k = int(worth.argmax())
        if worth[k] <= 1 + 1e-7:
            if made == rounds or x.sum() <= bound * (1 + gap):
                break
            made += 1
            for smooth in SMOOTH:
                point = smooth * centre + (1 - smooth) * np.maximum(duals, 0)
                value, pattern = price(point, lengths, width)
                low = float(need @ point) / max(value, 1e-9)
                if low > bound:
                    bound, centre = low, point / value
                if sum(duals[i] * n for i, n in pattern.items()) > 1 + 1e-7:
                    break
            else:
                break
            k = len(pool)
            pool.append(pattern)
            known[list(pattern), k] = list(pattern.values())
        d = inverse @ known[:, k]
        able = d > 1e-9
        if not able.any():
            break
        ratio = np.full(m, np.inf)
        ratio[able] = x[able] / d[able]
        r = int(ratio.argmin())
        step = ratio[r]
        x -= step * d
        x[r] = step
        np.maximum(x, 0, out=x)
        pivot = inverse[r] / d[r]
        inverse -= np.outer(d, pivot)
        inverse[r] = pivot
        basis[r] = pool[k]
    return [(c, float(v)) for c, v in zip(basis, x)]


def plan(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> pieces) and integer uses that hold exactly the pieces of ``histogram``."""
    left = {k: v for k, v in histogram.items() if 0 < k < width and v}
    out = [({width: 1}, histogram[width])] if histogram.get(width) else []
    lengths = np.array(sorted(left), dtype=np.int64)
    found = patterns(lengths, np.array([left[k] for k in lengths.tolist()], dtype=np.int64), width)
    for pattern, uses in sorted(found, key=lambda p: -p[1]):
        named = {int(lengths[i]): k for i, k in pattern.items()}
        times = min([int(uses + 1e-6), *(left[n] // k for n, k in named.items())])
        if times > 0:
            out.append((named, times))
            for n, k in named.items():
                left[n] -= k * times
    for key, times in best_fit(left, width).items():
        out.append(({n: key.count(n) for n in set(key)}, times))
    return out


def places(planned: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, from rank, to rank, first sequence, pieces a sequence)."""
    out, used, sequence = [], {}, 0
    for pattern, times in planned:
        for n, k in pattern.items():
            start = used.get(n, 0)
            out.append((n, start, start + k * times, sequence, k))
            used[n] = start + k * times
        sequence += times
    return out


def pieces(docs: DataFrame, doc_id: str, text: str, vocabulary: str, width: int) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens): each document cut at multiples of ``width``."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), id_lists(batch.column(1), vocabulary)):
                raw = np.array([*ids, END], "<u4").tobytes()
                n = len(raw) // 4
                rows.extend((doc, s, min(width, n - s), crc32(raw[4 * s : 4 * (s + width)]), n) for s in range(0, n, width))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(cut_up, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Pack all documents into sequences of at most ``width`` tokens.

    Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset),
    a row for each piece.  Null and empty texts are the end token alone.  Rows
    that repeat an id are packed each on their own; rows without an id too.
    Very long texts are cut as they are read.  Sequence ids are unique, those of
    full pieces not gapless; which pieces of a length share a sequence follows the
    order in which the table is read.  Other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    numbered = pieces(docs, doc_id, text, vocabulary, width).withColumn("piece", F.monotonically_increasing_id())
    rows, _ = written(numbered, "pieces")
    rows = rows.withColumn("class", length_class(F.col("length"), width))
    histogram = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count("*").alias("n")).collect()}
    planned = plan({n: k for n, k in histogram.items() if n < width}, width)
    named = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    # a full piece is a sequence of its own, numbered after all others, and needs no rank
    full = rows.where(F.col("class") == width).select(*named, (F.col("piece") + sum(times for _, times in planned)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    by_length: dict[int, list] = {}
    for row in places(planned):
        by_length.setdefault(row[0], []).append(row[1:])
    table = spark.sparkContext.broadcast({n: np.array(sorted(v), np.int64) for n, v in by_length.items()})
    parts = spark.createDataFrame([(n, -(-k // PART)) for n, k in histogram.items() if n < width], "class long, parts long")
    rest = rows.join(F.broadcast(parts), "class").withColumn("part", F.pmod(F.xxhash64("piece"), F.col("parts")))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = rest.groupBy("class", "part").agg(F.count("*").alias("n")).select("class", "part", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("class", "part").orderBy("piece"))).join(bases, ["class", "part"])
    ranked = ranked.select(*named, "class", (F.col("base") + F.col("rank") - 1).alias("rank"))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(5).to_numpy()
            rank = batch.column(6).to_numpy()
            sequence = np.zeros(len(n), np.int64)
            for length in np.unique(n).tolist():
                at = np.flatnonzero(n == length)
                spans = table.value[length]
                row = spans[np.searchsorted(spans[:, 0], rank[at], side="right") - 1]
                sequence[at] = row[:, 2] + (rank[at] - row[:, 0]) // row[:, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence)], [*batch.schema.names, "sequence_id"])

    seated = ranked.mapInArrow(seat, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long, rank long, sequence_id long")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    return full.unionByName(seated.select(*named, "sequence_id", offset))
