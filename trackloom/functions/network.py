"""Road networks in memory: nearest edges and nodes, shortest paths, and the walks along trajectories.

The kernels here see one trajectory and the edges around it; Spark brings the
two together (``operators.roads``).
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from .geodesy import aeqd, aeqd_back, inverse


@dataclass
class Path:
    lat: np.ndarray
    lon: np.ndarray


class Network:
    """Edges (edge_id, u, v, osmid, length_m, coordinates, one-way from u to v) with look-ups by place.

    Routes take every edge both ways; ``distances``, by which points are matched, goes one way where the edge does.
    """

    def __init__(self, edge_id, u, v, osmid, length, geometry: list[np.ndarray], oneway=None) -> None:
        self.edge_id, self.osmid = np.asarray(edge_id, np.int64), np.asarray(osmid, np.int64)
        self.u, self.v = np.asarray(u, np.int64), np.asarray(v, np.int64)
        self.length, self.geometry = np.asarray(length, float), geometry
        n = len(self.edge_id)
        self.oneway = np.zeros(n, bool) if oneway is None else np.asarray(oneway, bool)
        self.ahead: dict[int, list[tuple[int, float, int]]] = {}
        self.searches: dict[int, Search] = {}
        first = np.cumsum([0, *(len(g) for g in geometry)])[:-1]
        every = np.concatenate(geometry) if n else np.zeros((0, 2))
        self.box = np.concatenate((np.minimum.reduceat(every, first), np.maximum.reduceat(every, first)), axis=1) if n else np.zeros((0, 4))
        place: dict[int, tuple[float, float]] = {}
        self.near: dict[int, list[tuple[int, float, int]]] = {}
        self.roads: dict[int, set[int]] = {}
        for k in range(n):
            a, b = int(self.u[k]), int(self.v[k])
            place.setdefault(a, tuple(geometry[k][0]))
            place.setdefault(b, tuple(geometry[k][-1]))
            for x, y in ((a, b), (b, a)):
                self.near.setdefault(x, []).append((y, float(self.length[k]), k))
                self.roads.setdefault(x, set()).add(int(self.osmid[k]))
                if x == a or not self.oneway[k]:
                    self.ahead.setdefault(x, []).append((y, float(self.length[k]), k))
        self.nodes = np.array(sorted(place), np.int64)
        self.lon = np.array([place[i][0] for i in self.nodes.tolist()])
        self.lat = np.array([place[i][1] for i in self.nodes.tolist()])
        self._place = {i: k for k, i in enumerate(self.nodes.tolist())}

    def __len__(self) -> int:
        return len(self.edge_id)

    def nearest_edge(self, lat: float, lon: float) -> int:
        """Edge whose bounding box is nearest; ties by distance to the line, then by id."""
        dx = np.maximum(np.maximum(self.box[:, 0] - lon, lon - self.box[:, 2]), 0)
        dy = np.maximum(np.maximum(self.box[:, 1] - lat, lat - self.box[:, 3]), 0)
        d = np.hypot(dx, dy)
        tied = np.flatnonzero(d <= d.min() + 1e-12)
        if len(tied) > 1:
            line = np.array([line_distance(self.geometry[k], lon, lat) for k in tied.tolist()])
            tied = tied[np.lexsort((self.edge_id[tied], np.round(line, 12)))]
        return int(tied[0])

    def nearest_node(self, lat: float, lon: float, osmid: int, limit_m: float, k: int = 3) -> int | None:
        """Of the k nearest nodes within the limit the nearest that touches a road of this id."""
        rough = np.hypot(self.lat - lat, ((self.lon - lon + 180) % 360 - 180) * np.cos(np.radians(lat)))
        some = np.argsort(rough, kind="stable")[: 4 * k]
        _, metres = inverse(lat, lon, self.lat[some], self.lon[some])
        order = np.lexsort((self.nodes[some], metres))[:k]
        for i in order.tolist():
            node = int(self.nodes[some[i]])
            if metres[i] <= limit_m and osmid in self.roads[node]:
                return node
        return None

    def shortest_path(self, a: int, b: int) -> list[int] | None:
        """Nodes of the shortest path by length, both directions open; null if there is none or a = b."""
        if a == b or a not in self.near or b not in self.near:
            return None
        best, prior = {a: 0.0}, {}
        heap = [(0.0, a)]
        done: set[int] = set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            if x == b:
                path = [b]
                while path[-1] != a:
                    path.append(prior[path[-1]])
                return path[::-1]
            for y, w, _ in self.near[x]:
                if d + w < best.get(y, np.inf):
                    best[y], prior[y] = d + w, x
                    heapq.heappush(heap, (d + w, y))
        return None

    def distances(self, a: int, limit: float) -> tuple[dict[int, float], dict[int, int]]:
        """Driving distances from a node to those within the limit, and the node before each of them."""
        search = Search(self, a)
        search.grow(limit)
        return search.done, {x: prior for x, (prior, _) in search.prior.items()}

    def search(self, a: int) -> Search:
        """The search from a node that all trajectories share; all are begun anew when they hold too much."""
        if a not in self.searches:
            if sum(len(x.best) for x in self.searches.values()) > SETTLED:
                self.searches = {}
            self.searches[a] = Search(self, a)
        return self.searches[a]

    @cached_property
    def vertices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different places (lon, lat) of the lines' vertices, the place of each vertex, and where each line's vertices begin and end."""
        spots, spot = np.unique(np.concatenate(self.geometry), axis=0, return_inverse=True)
        return spots, spot.reshape(-1), np.cumsum([0, *(len(g) for g in self.geometry)])

    def route(self, lat1: float, lon1: float, lat2: float, lon2: float, limit_m: float) -> Path | None:
        """Path between the nodes of the roads nearest to two places, as node coordinates."""
        if not len(self):
            return None
        one = self.nearest_node(lat1, lon1, int(self.osmid[self.nearest_edge(lat1, lon1)]), limit_m)
        two = self.nearest_node(lat2, lon2, int(self.osmid[self.nearest_edge(lat2, lon2)]), limit_m)
        nodes = self.shortest_path(one, two) if one is not None and two is not None else None
        if not nodes or len(nodes) < 2:
            return None
        at = [self._place[i] for i in nodes]
        return Path(self.lat[at], self.lon[at])


SETTLED = 500_000  # nodes that the searches of a network hold before they begin anew


class Search:
    """Shortest ways from a node, found only as far as they are asked for; on the edges with a true ``inside`` if given."""

    def __init__(self, net: Network, a: int, inside: bytes | None = None) -> None:
        self.ahead, self.start, self.inside = net.ahead, a, inside
        self.best, self.prior, self.done = {a: 0.0}, {}, {}
        self._heap = [(0.0, a)]

    def grow(self, limit: float, to: int | None = None) -> None:
        """Settle nodes, nearest first, until ``to`` is one of them or all within the limit are."""
        best, prior, heap, done, inside = self.best, self.prior, self._heap, self.done, self.inside
        while heap and to not in done and heap[0][0] <= limit:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done[x] = d
            for y, w, k in self.ahead.get(x, ()):
                if d + w < best.get(y, np.inf) and (inside is None or inside[k]):
                    best[y], prior[y] = d + w, (x, k)
                    heapq.heappush(heap, (d + w, y))

    def reach(self, to: int, limit: float) -> float:
        """Distance to a node, infinite beyond the limit."""
        if to not in self.done:
            self.grow(limit, to)
        d = self.done.get(to, np.inf)
        return d if d <= limit else np.inf

    def way(self, to: int) -> tuple[list[int], list[int]]:
        """Nodes of the way, last one first, and its edges."""
        nodes, edges = [to], []
        while nodes[-1] != self.start:
            x, k = self.prior[nodes[-1]]
            nodes.append(x)
            edges.append(k)
        return nodes, edges


def line_distance(line: np.ndarray, x: float, y: float) -> float:
    """Planar distance from a point to a polyline."""
    a, b = line[:-1], line[1:]
    d = b - a
    size = (d * d).sum(axis=1)
    t = np.clip(np.divide(((np.array([x, y]) - a) * d).sum(axis=1), size, out=np.zeros(len(a)), where=size > 0), 0, 1)
    p = a + t[:, None] * d
    return float(np.hypot(p[:, 0] - x, p[:, 1] - y).min())


def crossing(p: np.ndarray, q: np.ndarray) -> tuple[str, tuple[float, float] | None]:
    """How two polylines meet: ("none", None), ("point", (lon, lat)) or ("more", None)."""
    found: set[tuple[float, float]] = set()
    for a, b in zip(p[:-1], p[1:]):
        for c, d in zip(q[:-1], q[1:]):
            r, s = b - a, d - c
            cross = r[0] * s[1] - r[1] * s[0]
            w = c - a
            if abs(cross) > 1e-18:
                t, u = (w[0] * s[1] - w[1] * s[0]) / cross, (w[0] * r[1] - w[1] * r[0]) / cross
                if -1e-9 <= t <= 1 + 1e-9 and -1e-9 <= u <= 1 + 1e-9:
                    found.add((round(float(a[0] + t * r[0]), 12), round(float(a[1] + t * r[1]), 12)))
            elif abs(w[0] * r[1] - w[1] * r[0]) <= 1e-15:
                rr = float(r @ r)
                if rr:
                    lo, hi = sorted((float(w @ r) / rr, float((d - a) @ r) / rr))
                    lo, hi = max(lo, 0.0), min(hi, 1.0)
                    if hi - lo > 1e-9:
                        return "more", None
                    if hi >= lo - 1e-9:
                        found.add((round(float(a[0] + lo * r[0]), 12), round(float(a[1] + lo * r[1]), 12)))
    if not found:
        return "none", None
    return ("point", next(iter(found))) if len(found) == 1 else ("more", None)


def between(lat1: float, lon1: float, lat2: float, lon2: float, lat: float, lon: float, tol_m: float = 0.001) -> bool:
    """Whether a place lies on the geodesic between two others, to ``tol_m``."""
    _, d = inverse([lat1, lat, lat1], [lon1, lon, lon1], [lat, lat2, lat2], [lon, lon2, lon2])
    return bool(abs(d[0] + d[1] - d[2]) <= tol_m)


def timed(path: Path, t1: float, t2: float) -> tuple[Path, np.ndarray] | None:
    """Times along a path in proportion to distance, its ends a second inside; rows of equal time as the one before go."""
    _, legs = inverse(path.lat[:-1], path.lon[:-1], path.lat[1:], path.lon[1:])
    total = legs.sum()
    share = np.concatenate(([0.0], np.cumsum(legs))) / total if total > 0 else np.linspace(0, 1, len(path.lat))
    t = t1 + share * (t2 - t1)
    t[0], t[-1] = t1 + 1, t2 - 1
    keep = np.concatenate(([True], t[1:] != t[:-1]))
    if keep.sum() < 2:
        return None
    return Path(path.lat[keep], path.lon[keep]), t[keep]


def refined(lat: np.ndarray, lon: np.ndarray, t: np.ndarray, net: Network, max_node_m: float = 10, apart_m: float = 45, between_tol_m: float = 0.001) -> list[tuple[float, float, float, bool]]:
    """Rows (lat, lon, t, inserted) of a trajectory with corners put in where the road changes.

    Roads that do not meet and lie ``apart_m`` or more apart are joined by the
    routed path, which takes the places of both points; roads that cross in one
    point between the two get that point.
    """
    rows = [(float(lat[0]), float(lon[0]), float(t[0]), False)] if len(lat) else []
    edge = [net.nearest_edge(a, o) for a, o in zip(lat, lon)] if len(net) else []
    seen: set[tuple] = set()
    for i in range(1, len(lat)):
        here = (float(lat[i]), float(lon[i]), float(t[i]), False)
        pair = (round(lat[i - 1], 6), round(lon[i - 1], 6), round(lat[i], 6), round(lon[i], 6))
        if not edge or net.osmid[edge[i]] == net.osmid[edge[i - 1]] or pair in seen:
            rows.append(here)
            continue
        seen.add(pair)
        one, two = net.geometry[edge[i - 1]], net.geometry[edge[i]]
        how, where = crossing(one, two)
        if how == "none":
            _, d = inverse(lat[i - 1], lon[i - 1], lat[i], lon[i])
            path = net.route(lat[i - 1], lon[i - 1], lat[i], lon[i], max_node_m) if d >= apart_m else None
            done = timed(path, t[i - 1], t[i]) if path else None
            if done:
                rows.pop()
                rows.extend((float(a), float(o), float(s), True) for a, o, s in zip(done[0].lat, done[0].lon, done[1]))
                continue
        elif how == "point" and between(lat[i - 1], lon[i - 1], lat[i], lon[i], where[1], where[0], between_tol_m):
            _, d = inverse([lat[i - 1], lat[i - 1]], [lon[i - 1], lon[i - 1]], [where[1], lat[i]], [where[0], lon[i]])
            at = t[i - 1] + (d[0] / d[1] if d[1] > 0 else 0) * (t[i] - t[i - 1])
            at = t[i - 1] + 1 if at == t[i - 1] else t[i] - 1 if at == t[i] else at
            rows.append((float(where[1]), float(where[0]), float(at), True))
        rows.append(here)
    if len(lat) and (rows[-1][0], rows[-1][1]) != (float(lat[-1]), float(lon[-1])):
        rows.append((float(lat[-1]), float(lon[-1]), float(t[-1]), False))
    return rows


def curved(lat: np.ndarray, lon: np.ndarray, t: np.ndarray, net: Network, lower: float = 20, upper: float = 80, max_node_m: float = 10) -> list[tuple[float, float, float, bool]]:
    """Rows of a trajectory with routed paths in place of the legs that end where it turns by [lower, upper] degrees."""
    azimuth, _ = inverse(lat[:-1], lon[:-1], lat[1:], lon[1:])
    bearing = np.append(azimuth % 360, np.nan)
    turn = np.abs(np.diff(bearing, prepend=np.nan))
    turn = np.minimum(turn, 360 - turn)
    rows: list[tuple[float, float, float, bool]] = []
    for i in range(len(lat)):
        if i and lower <= turn[i] <= upper:
            path = net.route(lat[i - 1], lon[i - 1], lat[i], lon[i], max_node_m)
            done = timed(path, t[i - 1], t[i]) if path else None
            if done and len(done[1]) > 2:
                rows.pop()
                rows.extend((float(a), float(o), float(s), True) for a, o, s in zip(done[0].lat, done[0].lon, done[1]))
                continue
        rows.append((float(lat[i]), float(lon[i]), float(t[i]), False))
    if len(lat) and (rows[-1][0], rows[-1][1]) != (float(lat[-1]), float(lon[-1])):
        rows.append((float(lat[-1]), float(lon[-1]), float(t[-1]), False))
    return rows


@dataclass
class MatchSettings:
    """``min_prob_norm`` is the least mean probability of a chain (0: any); the noises are standard deviations in metres."""

    max_dist_m: float = 50.0
    obs_noise: float = 10.0
    dist_noise: float = 50.0
    non_emitting_states: bool = True
    obs_noise_ne: float = 50.0
    non_emitting_length_factor: float = 0.75
    width: int = 3
    min_prob_norm: float = 0.0


def matched(lat: np.ndarray, lon: np.ndarray, net: Network, settings: MatchSettings = MatchSettings(), projected: bool = False) -> list[tuple[float, float, int, int, float, bool]]:
    """Rows (lat, lon, edge_id, osmid, distance, matched): places on the most likely roads.

    A hidden Markov model (Newson and Krumm 2009): candidates are the ``width`` nearest
    edges within ``max_dist_m``, observations are normal about them, and the way
    between two of them is as long as the points lie apart, but for exponential
    noise.  Junctions on that way are states without an observation: they are
    normal, with ``obs_noise_ne``, about the straight line between the two points,
    and the mean of their terms counts by ``non_emitting_length_factor``.  One-way
    edges are left at their end and entered at their start.  Where no candidate
    follows from any before, the chain starts anew; a state whose chain has a mean
    probability below ``min_prob_norm`` is no candidate.  ``projected`` gives
    metres (y, x) about the middle of the trajectory in place of (lat, lon).
    """
    return list(zip(*(v.tolist() for v in matches(lat, lon, net, settings, projected))))


def matches(lat: np.ndarray, lon: np.ndarray, net: Network, settings: MatchSettings = MatchSettings(), projected: bool = False, inside: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """What ``matched`` gives, as columns.  Only edges with a true ``inside`` are there for it, if that is given.

    So trajectories can share a network, each with the edges around it.  Ways are
    searched on all edges, once for all trajectories; a way that leaves a
    trajectory's edges is searched again on these alone.
    """
    n = len(lat)
    lat0, lon0 = (lat.max() + lat.min()) / 2, (lon.max() + lon.min()) / 2
    who, edge = _edges_near(lat, lon, net, settings.max_dist_m, inside)
    some = np.unique(edge)
    spots, spot, first = net.vertices if len(some) else (np.zeros((0, 2)), np.zeros(0, np.int64), np.zeros(1, np.int64))
    size = first[some + 1] - first[some]
    begin = np.concatenate(([0], np.cumsum(size)))
    corners = spot[np.repeat(first[some] - begin[:-1], size) + np.arange(begin[-1])]
    drawn, corner = np.unique(corners, return_inverse=True)
    nodes = np.array([net._place[i] for i in np.unique(np.concatenate((net.u[some], net.v[some]))).tolist()], np.int64)
    px, py = aeqd(np.concatenate((lat, spots[drawn, 1], net.lat[nodes])), np.concatenate((lon, spots[drawn, 0], net.lon[nodes])), lat0, lon0)
    x, y = px[:n], py[:n]
    k = n + len(drawn)
    steps = _candidates(x, y, who, np.searchsorted(some, edge), edge, net.edge_id[edge], np.column_stack((px[n:k], py[n:k]))[corner.reshape(-1)], begin, settings)
    at = dict(zip(net.nodes[nodes].tolist(), zip(px[k:].tolist(), py[k:].tolist())))
    xs, ys = x.tolist(), y.tolist()
    within = None if inside is None or inside.all() else inside.tobytes()
    own: dict[int, Search] = {}
    ways: dict[tuple[int, int], tuple[float, list[int]]] = {}
    edge_u, edge_v, edge_m, edge_one = (dict(zip(some.tolist(), v[some].tolist())) for v in (net.u, net.v, net.length, net.oneway))

    def reach(p: int, q: int, limit: float) -> tuple[float, list[int]]:
        """Length of the shortest way between two nodes, infinite beyond the limit, and its nodes."""
        if (p, q) not in ways:
            search = net.search(p)
            d = search.reach(q, limit)
            if within and d < np.inf and not all(within[k] for k in search.way(q)[1]):
                search = own[p] if p in own else own.setdefault(p, Search(net, p, within))
                d = search.reach(q, limit)
            if d == np.inf:
                return d, []
            ways[p, q] = d, search.way(q)[0]
        found = ways[p, q]
        return found if found[0] <= limit else (np.inf, [])

    def way(a: tuple, b: tuple, straight: float) -> tuple[float, list[int]]:
        """Length of the shortest way from one candidate to another, and the junctions on it."""
        one = edge_one[a[2]]
        if a[2] == b[2] and (not one or b[5] >= a[5] - settings.obs_noise):
            return abs(a[5] - b[5]), []
        limit = 3 * straight + 2200
        best, path = np.inf, []
        exits = [(edge_v[a[2]], max(edge_m[a[2]] - a[5], 0))] + ([] if one else [(edge_u[a[2]], a[5])])
        entries = [(edge_u[b[2]], b[5])] + ([] if edge_one[b[2]] else [(edge_v[b[2]], max(edge_m[b[2]] - b[5], 0))])
        for p, rest in exits:
            for q, more in entries:
                d, nodes = reach(p, q, limit)
                if rest + d + more < best:
                    best, path = rest + d + more, nodes
        return best, path

    def unseen(i: int, path: list[int]) -> float:
        """Log-probability of the junctions between the points i - 1 and i."""
        if not settings.non_emitting_states or not path:
            return 0.0
        if new := [node for node in path if node not in at]:
            where = [net._place[node] for node in new]
            at.update(zip(new, zip(*(v.tolist() for v in aeqd(net.lat[where], net.lon[where], lat0, lon0)))))
        ax, ay = xs[i - 1], ys[i - 1]
        dx, dy = xs[i] - ax, ys[i] - ay
        size, total = dx * dx + dy * dy, 0.0
        for jx, jy in (at[node] for node in path):
            t = min(max(((jx - ax) * dx + (jy - ay) * dy) / size, 0.0), 1.0) if size > 0 else 0.0
            total += (math.hypot(ax + t * dx - jx, ay + t * dy - jy) / settings.obs_noise_ne) ** 2
        return -0.5 * settings.non_emitting_length_factor * total / len(path)

    least = np.log(settings.min_prob_norm) if settings.min_prob_norm > 0 else -np.inf
    score: list[list[float]] = []
    back: list[list[int]] = []
    length: list[list[int]] = []
    for i, now in enumerate(steps):
        straight = math.hypot(xs[i] - xs[i - 1], ys[i] - ys[i - 1]) if i else 0.0
        kept, values, links, chains = [], [], [], []
        # nothing is added to a score on the way, so that candidates with less than the best option so far are done with
        order = sorted(range(len(steps[i - 1])), key=lambda j: -score[i - 1][j]) if i else []
        for c in now:
            e = -0.5 * (c[0] / settings.obs_noise) ** 2
            top = None
            for j in order:
                if top and score[i - 1][j] < top[0]:
                    break
                far, path = way(steps[i - 1][j], c, straight)
                if far < np.inf:
                    option = (score[i - 1][j] - abs(far - straight) / settings.dist_noise + unseen(i, path), -j)
                    top = option if top is None else max(top, option)
            value = e + (top[0] if top else min(score[i - 1]) - 1e3 if i and steps[i - 1] else 0.0)
            chain = length[i - 1][-top[1]] + 1 if top else 1
            if (value if top else e) / chain >= least:
                kept.append(c)
                values.append(value)
                links.append(-top[1] if top else -1)
                chains.append(chain)
        steps[i] = kept
        score.append(values)
        back.append(links)
        length.append(chains)
    chosen = [-1] * n
    for i in range(n - 1, -1, -1):
        if steps[i]:
            linked = back[i + 1][chosen[i + 1]] if i + 1 < n and chosen[i + 1] >= 0 else -1
            chosen[i] = linked if linked >= 0 else int(np.argmax(score[i]))
    found = np.array([c >= 0 for c in chosen], bool)
    best = [steps[i][c] for i, c in enumerate(chosen) if c >= 0]
    gap, edge_id, edge, bx, by = (np.array([c[k] for c in best], t) for k, t in enumerate((float, np.int64, np.int64, float, float)))
    out_lat, out_lon = (y.copy(), x.copy()) if projected else (np.array(lat, float), np.array(lon, float))
    out_lat[found], out_lon[found] = (by, bx) if projected else aeqd_back(bx, by, lat0, lon0)
    ids, roads, metres = np.full(n, -1), np.full(n, -1), np.full(n, np.nan)
    ids[found], roads[found], metres[found] = edge_id, net.osmid[edge], gap
    return out_lat, out_lon, ids, roads, metres, found


def _edges_near(lat: np.ndarray, lon: np.ndarray, net: Network, metres: float, inside: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (point, edge) that hold all with a distance of ``metres`` or less; most others are told apart by boxes.

    A straight line leaves the box of its ends, in degrees, by no more than its
    square over the earth's radius.  Where that does not say much, near the poles
    and on wide trajectories, boxes are made in metres.
    """
    all_of = np.arange(len(net)) if inside is None else np.flatnonzero(inside)
    if not len(all_of):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    box = net.box[all_of]
    if np.ptp(lat) > 2 or np.ptp(lon) > 2 or np.abs(lat).max() > 80 or np.abs(lon).max() > 175 or np.ptp(box[:, [1, 3]]) > 4 or np.ptp(box[:, [0, 2]]) > 4:
        lat0, lon0 = (lat.max() + lat.min()) / 2, (lon.max() + lon.min()) / 2
        lines = [net.geometry[k] for k in all_of.tolist()]
        begin = np.cumsum([0, *(len(g) for g in lines)])[:-1]
        every = np.concatenate(lines)
        every = np.column_stack(aeqd(every[:, 1], every[:, 0], lat0, lon0))
        box = np.concatenate((np.minimum.reduceat(every, begin), np.maximum.reduceat(every, begin)), axis=1)
        lon, lat = aeqd(lat, lon, lat0, lon0)
        up = side = metres + 1e-6
    else:
        across = np.hypot(box[:, 3] - box[:, 1], box[:, 2] - box[:, 0]) * 112_000
        up = (1.02 * metres + 1 + across**2 / 6_000_000) / 110_000
        side = up / math.cos(math.radians(np.abs(lat).max() + 1))
    west, south, east, north = box[:, 0] - side, box[:, 1] - up, box[:, 2] + side, box[:, 3] + up
    who, edge = [], []
    for start in range(0, len(lat), NEARBY):
        a, o = lat[start : start + NEARBY], lon[start : start + NEARBY]
        some = np.flatnonzero((south <= a.max()) & (north >= a.min()) & (west <= o.max()) & (east >= o.min()))
        i, j = np.nonzero((south[some] <= a[:, None]) & (north[some] >= a[:, None]) & (west[some] <= o[:, None]) & (east[some] >= o[:, None]))
        who.append(i + start)
        edge.append(all_of[some[j]])
    return np.concatenate(who), np.concatenate(edge)


NEARBY = 64  # points in a row that are compared with the edges around them at a time


def _candidates(x: np.ndarray, y: np.ndarray, who: np.ndarray, line: np.ndarray, edge: np.ndarray, ids: np.ndarray, place: np.ndarray, begin: np.ndarray, settings: MatchSettings) -> list[list[tuple]]:
    """For each point its nearest edges: (distance, edge_id, edge, x, y, metres along the edge), of the pairs (who, line).

    ``place`` has the vertices of the lines, one after another, ``begin`` where each begins.
    """
    steps: list[list[tuple]] = [[] for _ in range(len(x))]
    legs = begin[line + 1] - begin[line] - 1
    if not legs.sum():
        return steps
    step = np.diff(place, axis=0)
    size = (step * step).sum(axis=1)
    lengths = np.sqrt(size)
    inner = np.ones(len(size), bool)
    inner[begin[1:-1] - 1] = False
    before = np.concatenate(([0.0], np.cumsum(np.where(inner, lengths, 0.0))))
    chunk = np.cumsum(legs) // 1_000_000
    for part in np.unique(chunk).tolist():
        rows = np.flatnonzero((chunk == part) & (legs > 0))
        if not len(rows):
            continue
        first = np.concatenate(([0], np.cumsum(legs[rows])))
        pair = np.repeat(np.arange(len(rows)), legs[rows])
        leg = np.arange(first[-1]) - first[pair] + begin[line[rows]][pair]
        ox, oy = x[who[rows]][pair], y[who[rows]][pair]
        t = np.clip(np.divide((ox - place[leg, 0]) * step[leg, 0] + (oy - place[leg, 1]) * step[leg, 1], size[leg], out=np.zeros(len(leg)), where=size[leg] > 0), 0, 1)
        qx, qy = place[leg, 0] + t * step[leg, 0], place[leg, 1] + t * step[leg, 1]
        gap = np.hypot(qx - ox, qy - oy)
        best = np.lexsort((gap, pair))[first[:-1]]
        best = best[gap[best] <= settings.max_dist_m]
        pick = rows[pair[best]]
        along = before[leg[best]] - before[begin[line[pick]]] + t[best] * lengths[leg[best]]
        for i, *rest in zip(who[pick].tolist(), gap[best].tolist(), ids[pick].tolist(), edge[pick].tolist(), qx[best].tolist(), qy[best].tolist(), along.tolist()):
            steps[i].append(tuple(rest))
    return [sorted(c)[: settings.width] for c in steps]
