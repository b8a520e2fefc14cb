"""Near-duplicate vectors: hierarchical navigable small-world graphs per shard.

Vectors of a label are dealt to shards of bounded size, and a graph is built of
each.  Shards of a label meet in pairs, and each queries the other.  Beams widen
where they are full of links, and for the whole shard until an audit against
brute force on a sample passes: vectors with few links and with many are audited
apart, and themselves do not count.  Where no beam passes, or there is no link to
audit, the shard is searched by brute force.  Cosines are verified in double precision, and links are
united into components.  Equal vectors are one node with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import cut, forget

THRESHOLD = 0.98
SHARD = 4096  # vectors of a shard, on average at most
DEGREE = 16  # links of a node; twice as many on the lowest layer
BUILD_BEAM = 48
BEAM = 48
AUDIT = 512  # vectors of a shard that an audit compares with brute force at a time,
LINKED = 128  # until so many of them have links
RECALL = 0.995  # of audited links that has to be found, among vectors of about as many
EXACT = 0  # width that stands for brute force
MARGIN = 1e-5  # below the threshold, for cosines in single precision


class Graph:
    """Layers of neighbour lists over unit vectors; nodes come in by batches that double."""

    def __init__(self, unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 5) -> None:
        self.unit = unit.astype(np.float32)
        n = len(unit)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(degree)).astype(int), 6)
        order = np.argsort(-level, kind="stable")
        self.layers: list[np.ndarray] = []
        self.entry = int(order[0]) if n else -1
        top = int(level[order[0]]) if n else -1
        for k in range(top + 1):
            self.layers.append(np.full((n, degree if k else 2 * degree), -1, np.int32))
        done, size = 1, 1
        while done < n:
            batch = order[done : done + size]
            self._insert(batch, level, order[:done], beam)
            done += len(batch)
            size = min(2 * size, 256)

    def _insert(self, batch: np.ndarray, level: np.ndarray, old: np.ndarray, beam: int) -> None:
        start = np.full((len(batch), 1), self.entry)
        for k in range(len(self.layers) - 1, -1, -1):
            mine = np.flatnonzero(level[batch] >= k)
            ids, sims = self.beam(self.unit[batch], k, start, beam if len(mine) else 1)
            start = ids[:, : min(4, ids.shape[1])]
            if not len(mine):
                continue
            who = batch[mine]
            near = self.unit[who] @ self.unit[who].T
            np.fill_diagonal(near, -2)
            take = min(len(who), beam)
            also = np.argsort(-near, axis=1, kind="stable")[:, :take]
            cand = np.concatenate((ids[mine], who[also]), axis=1)
            worth = np.concatenate((sims[mine], np.take_along_axis(near, also, 1)), axis=1)
            cand[worth <= -2] = -1
            links = self._diverse(who, cand, worth, self.layers[k].shape[1] // (1 if k else 2))
            self.layers[k][who, : links.shape[1]] = links
            self._link_back(k, who, links)

    def _diverse(self, who: np.ndarray, cand: np.ndarray, worth: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` candidates each, nearest first, preferring those nearer to the node than to any chosen one."""
        order = np.argsort(-np.where(cand < 0, -3, worth), axis=1, kind="stable")[:, : 4 * most]
        cand, worth = np.take_along_axis(cand, order, 1), np.take_along_axis(worth, order, 1)
        vec = self.unit[np.maximum(cand, 0)]
        between = np.einsum("bid,bjd->bij", vec, vec)
        n, m = cand.shape
        chosen = np.zeros((n, m), bool)
        for j in range(m):
            clash = (chosen & (between[:, :, j] > worth[:, j : j + 1])).any(axis=1)
            chosen[:, j] = (cand[:, j] >= 0) & ~clash & (chosen.sum(axis=1) < most)
        rank = np.argsort(np.where(chosen, 0, np.where(cand < 0, 2, 1)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(cand, rank, 1).astype(np.int32)

    def _link_back(self, k: int, who: np.ndarray, links: np.ndarray) -> None:
        table = self.layers[k]
        width = table.shape[1]
        a, b = np.repeat(who, links.shape[1]), links.ravel()
        a, b = a[b >= 0], b[b >= 0]
        sims = np.einsum("id,id->i", self.unit[a], self.unit[b])
        order = np.lexsort((-sims, b))
        a, b = a[order], b[order]
        nodes, first, count = np.unique(b, return_index=True, return_counts=True)
        place = np.arange(len(b)) - np.repeat(first, count)
        keep = place < width
        extra = np.full((len(nodes), width), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), count)[keep], place[keep]] = a[keep]
        cand = np.concatenate((table[nodes], extra), axis=1)
        same = (extra[:, :, None] == table[nodes][:, None, :]).any(axis=2) & (extra >= 0)
        cand[:, width:][same] = -1
        full = (cand >= 0).sum(axis=1) > width
        packed = np.take_along_axis(cand, np.argsort(cand < 0, axis=1, kind="stable"), 1)[:, :width]
        table[nodes[~full]] = packed[~full]
        if full.any():
            some, c = nodes[full], cand[full]
            worth = np.einsum("bid,bd->bi", self.unit[np.maximum(c, 0)], self.unit[some])
            table[some] = self._diverse(some, c, worth, width)

    def beam(self, queries: np.ndarray, layer: int, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes that a beam of that width finds from ``start``; -1 and -2 where fewer."""
        n, q = len(self.unit), len(queries)
        queries = queries.astype(np.float32)
        seen = np.zeros((q, n + 1), bool)
        row = np.arange(q)[:, None]
        ids = np.where(start < 0, n, start)
        seen[row, ids] = True
        sims = np.where(ids < n, np.einsum("bid,bd->bi", self.unit[np.minimum(ids, n - 1)], queries), -2)
        for j in range(1, ids.shape[1]):
            sims[:, j][(ids[:, :j] == ids[:, j : j + 1]).any(axis=1)] = -2
        open_ = sims > -2
        step = 4 if width >= 16 else 1
        while True:
            score = np.where(open_, sims, -3)
            pick = np.argsort(-score, axis=1, kind="stable")[:, :step] if score.shape[1] > step else np.broadcast_to(np.arange(score.shape[1]), (q, score.shape[1]))
            live = np.take_along_axis(score, pick, 1) > -3
            if not live.any():
                break
            node = np.where(live, np.take_along_axis(ids, pick, 1), n)
            np.put_along_axis(open_, pick, False, 1)
            table = self.layers[layer]
            near = np.where(node[:, :, None] < n, table[np.minimum(node, n - 1)], -1).reshape(q, -1)
            near = np.sort(np.where(near < 0, n, near), axis=1)
            fresh = (near < n) & ~seen[row, near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[row, near] = True
            who, col = np.nonzero(fresh)
            got = np.full(near.shape, -2, np.float32)
            got[who, col] = np.einsum("id,id->i", self.unit[near[who, col]], queries[who])
            ids = np.concatenate((ids, near), axis=1)
            sims = np.concatenate((sims, got), axis=1)
            open_ = np.concatenate((open_, fresh), axis=1)
            if ids.shape[1] > width:
                best = np.argpartition(-sims, width - 1, axis=1)[:, :width]
                ids, sims, open_ = (np.take_along_axis(x, best, 1) for x in (ids, sims, open_))
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(sims > -2, ids, -1), sims

    def near(self, queries: np.ndarray, low: float, width: int, own: np.ndarray | None = None) -> list[np.ndarray]:
        """Nodes found with cosine ``low`` or more for each query; a beam all of such widens for its query, up to brute force.

        ``own`` has the queries' own nodes, if they are in the graph, to start from as well.
        """
        if width == EXACT or width >= len(self.unit):
            return self._exact(queries, low)
        start = np.full((len(queries), 1), self.entry)
        for k in range(len(self.layers) - 1, 0, -1):
            start = self.beam(queries, k, start, 4)[0]
        if own is not None:
            start = np.concatenate((start, own[:, None]), axis=1)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        todo = np.arange(len(queries))
        while len(todo):
            if width >= len(self.unit):
                for i, ids in zip(todo.tolist(), self._exact(queries[todo], low)):
                    out[i] = ids
                break
            ids, sims = self.beam(queries[todo], 0, start[todo], width)
            hit = (sims >= low) & (ids >= 0)
            full = hit.all(axis=1) & (hit.shape[1] >= width)
            for i in np.flatnonzero(~full).tolist():
                out[todo[i]] = ids[i][hit[i]]
            todo, width = todo[full], 4 * width
        return out

    def _exact(self, queries: np.ndarray, low: float) -> list[np.ndarray]:
        """All nodes with cosine ``low`` or more for each query, by brute force."""
        queries = queries.astype(np.float32)
        return [np.flatnonzero(row >= low) for at in range(0, len(queries), 256) for row in queries[at : at + 256] @ self.unit.T]

    def audited(self, low: float = THRESHOLD, width: int = BEAM) -> int:
        """Beam width at which nodes of a sample, not starting from themselves, find RECALL of their links to others.

        This holds for nodes of 1, 2 to 3, 4 to 7, … links apart.  EXACT if there is no such width below the graph's size, or no link.
        Afterwards ``linked`` has the nodes with links in the sample, and ``recall`` the least recall among those classes at that width.
        """
        n = len(self.unit)
        self.linked, self.recall = 0, 1.0
        order = np.random.default_rng(3).permutation(n)
        at, truth = [], []
        for lo in range(0, n, AUDIT):
            some = order[lo : lo + AUDIT]
            near = self.unit[some].astype(np.float64) @ self.unit.T.astype(np.float64) >= low
            near[np.arange(len(some)), some] = False
            for i, row in zip(some.tolist(), near):
                if row.any():
                    at.append(i)
                    truth.append(np.flatnonzero(row))
            if len(at) >= LINKED:
                break
        want = np.array([len(t) for t in truth])
        self.linked = len(at)
        if not len(at):
            return EXACT
        size = np.log2(want).astype(int)
        while width < n:
            near = self.near(self.unit[at], low - MARGIN, width)
            found = np.array([len(np.intersect1d(t, ids)) for t, ids in zip(truth, near)])
            self.recall = float((np.bincount(size, found) / np.maximum(np.bincount(size, want), 1))[np.unique(size)].min())
            if self.recall >= RECALL:
                return width
            width *= 2
        self.recall = 1.0
        return EXACT


def _rows(column: pa.Array) -> np.ndarray:
    values = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    return values[ends[0] : ends[-1]].reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, by propagation with path halving."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == was).all():
            return root


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, shard: int = SHARD, audits: str | None = None) -> DataFrame:
    """Links between vectors of equal label with cosine ``threshold`` or more, and their components.

    Returns (vec_id, n_links, component_id, kept) for every row.  Vectors that
    are null, empty, zero or hold a null or non-finite component link with
    nothing, as do those of null label and those of other dimensions.  Equal
    vectors link with each other.  Rows without an id link with nothing and have
    null component and kept.  Rows that repeat an id are one vector if label and
    components are equal, else each their own with that id: links and components
    are by vector, and a component is named by its smallest id.  Very long vectors
    are held whole.  Every two shards of a label meet, so that a label costs the
    square of its shards.  With ``audits`` the audit of each shard is written
    there: vectors, beam width (0: brute force), linked vectors in the sample and
    their least recall.  Other columns are not read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    x = F.col("x")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"), F.col(label).alias("label"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    keyed = rows.where("good").select("vec_id", "x", F.xxhash64("label", F.size("x"), F.col("label").cast("string")).alias("g"))
    copies = keyed.groupBy("g", "x").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("copies"))
    # keys rise with ids, so that a component's smallest key is that of its smallest id
    copies = cut(copies.repartitionByRange("id").sortWithinPartitions("id").withColumn("key", F.monotonically_increasing_id()))
    shards = copies.groupBy("g").agg(F.ceil(F.count("*") / F.lit(shard)).alias("shards"))
    dealt = copies.join(shards, "g").withColumn("shard", F.pmod(F.xxhash64("key"), "shards"))

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("key")
        unit = _unit(_rows(group["x"].chunk(0)))
        graph = Graph(unit)
        width = graph.audited(threshold)
        links = np.concatenate([layer.ravel() for layer in graph.layers]).astype(np.int32)
        return pa.table({"g": group["g"][:1], "shard": group["shard"][:1], "ids": pa.array([group["key"].to_numpy()]), "copies": pa.array([group["copies"].to_numpy()]), "unit": pa.array([unit.tobytes()], pa.binary()), "links": pa.array([links.tobytes()], pa.binary()), "layers": pa.array([len(graph.layers)]), "entry": pa.array([graph.entry]), "width": pa.array([width]), "linked": pa.array([graph.linked]), "recall": pa.array([graph.recall])})

    graphs = cut(dealt.select("g", "shard", "key", "copies", "x").groupBy("g", "shard").applyInArrow(build, "g long, shard long, ids array<long>, copies array<long>, unit binary, links binary, layers long, entry long, width long, linked long, recall double"))
    if audits:
        graphs.select("g", "shard", F.size("ids").alias("vectors"), "width", "linked", "recall").write.mode("overwrite").parquet(audits)

    def opened(r: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
        ids, copies_ = (r[side + k].values.to_numpy() for k in ("ids", "copies"))
        unit = np.frombuffer(r[side + "unit"].as_py(), np.float64).reshape(len(ids), -1)
        graph = Graph.__new__(Graph)
        graph.unit, graph.entry = unit.astype(np.float32), r[side + "entry"].as_py()
        links = np.frombuffer(r[side + "links"].as_py(), np.int32)
        graph.layers, at = [], 0
        for k in range(r[side + "layers"].as_py()):
            wide = (DEGREE if k else 2 * DEGREE) * len(ids)
            graph.layers.append(links[at : at + wide].reshape(len(ids), -1))
            at += wide
        return ids, copies_, unit, graph

    def verified(q_ids: np.ndarray, q_unit: np.ndarray, ids: np.ndarray, unit: np.ndarray, graph: Graph, width: int, own: bool) -> np.ndarray:
        """Which nodes of the graph each query is found to link with."""
        hit = np.zeros((len(q_ids), len(ids)), bool)
        for s in range(0, len(q_ids), 256):
            part = np.arange(s, min(s + 256, len(q_ids)))
            for j, near in zip(part.tolist(), graph.near(q_unit[part], threshold - MARGIN, width, part if own else None)):
                hit[j, near[(unit[near] @ q_unit[j] >= threshold) & (ids[near] != q_ids[j])]] = True
        return hit

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {k: b.column(k)[i] for k in b.schema.names}
                same = r["a_shard"].as_py() == r["b_shard"].as_py()
                (a_ids, a_copies, a_unit, a_graph), (b_ids, b_copies, b_unit, b_graph) = opened(r, "a_"), opened(r, "b_")
                # a pair that either end finds counts for both
                hit = verified(a_ids, a_unit, b_ids, b_unit, b_graph, r["b_width"].as_py(), same)
                hit |= (hit if same else verified(b_ids, b_unit, a_ids, a_unit, a_graph, r["a_width"].as_py(), False)).T
                total = hit @ b_copies if same else np.concatenate((hit @ b_copies, a_copies @ hit))
                who = a_ids if same else np.concatenate((a_ids, b_ids))
                nodes, where = np.unique(np.concatenate((a_ids, b_ids)), return_inverse=True)
                left, right = np.nonzero(hit)
                root = _roots(len(nodes), where[left], where[len(a_ids) + right])
                tied = np.flatnonzero(root != np.arange(len(nodes)))
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((who[some], nodes[tied]))), pa.array(np.concatenate((total[some], np.zeros(len(tied), np.int64)))), pa.array(np.concatenate((who[some], nodes[root[tied]])))], ["key", "links", "other"])

    side = lambda k: graphs.select("g", *[F.col(c).alias(k + c) for c in graphs.columns if c not in ("g", "linked", "recall")])
    tasks = side("a_").join(side("b_"), "g").where("a_shard <= b_shard").repartition("g", "a_shard", "b_shard").drop("g")
    found = cut(tasks.mapInArrow(search, "key long, links long, other long"))
    forget(graphs)
    label_of = components(found, "key", "other").join(copies.select(F.col("key").alias("component"), F.col("id").alias("low")), "component")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    nodes = copies.join(links, "key", "left").join(label_of.select(F.col("node").alias("key"), "low"), "key", "left")
    nodes = nodes.select("g", "x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "id").alias("component_id"))
    linked = keyed.join(nodes, ["g", "x"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
