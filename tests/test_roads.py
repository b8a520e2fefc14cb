from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions.network import MatchSettings, Network, between, crossing, matched, matches, refined, timed, Path
from trackloom.operators import roads
from trackloom.plans.views import grid_network
from trackloom.schema import KEY
from trackloom.sources import maps, osm, valhalla

from test_trajectories import points

OSM = """<?xml version="1.0"?><osm>
<node id="1" lat="56.95" lon="24.10"/><node id="2" lat="56.951" lon="24.10"/><node id="3" lat="56.952" lon="24.101"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/></way>
<way id="11"><nd ref="3"/><nd ref="1"/><tag k="highway" v="primary"/><tag k="oneway" v="yes"/></way>
<way id="12"><nd ref="3"/><tag k="highway" v="primary"/></way>
<way id="13"><nd ref="1"/><nd ref="9"/><tag k="highway" v="footway"/></way>
</osm>"""

GRAPHML = """<?xml version="1.0"?><graphml><graph edgedefault="undirected">
<node id="n0"><data key="x">24.10</data><data key="y">56.95</data></node><node id="n1"><data key="x">24.11</data><data key="y">56.95</data></node>
<edge source="n0" target="n1"><data key="osmid">7</data><data key="length">600.5</data><data key="geometry_wkt">LINESTRING (24.1 56.95, 24.105 56.951, 24.11 56.95)</data></edge>
<edge source="n1" target="n0"><data key="osmid">8</data><data key="length">610</data></edge>
</graph></graphml>"""


def test_osm_reader(spark, tmp_path):
    (tmp_path / "a.osm").write_text(OSM)
    nodes, ways = osm.read_osm(spark, str(tmp_path / "a.osm"))
    assert nodes.count() == 3 and sorted(r.way_id for r in ways.collect()) == [10, 11, 13]
    good = ways.where(osm.driveable(F.col("tags")))
    assert sorted(r.way_id for r in good.collect()) == [10, 11]
    assert sorted((r.way_id, r.u, r.v) for r in osm.directed_edges(good).collect()) == [(10, 1, 2), (10, 2, 1), (10, 2, 3), (10, 3, 2), (11, 3, 1)]
    assert osm.way_segments(ways, nodes).count() == 3  # node 9 does not exist


def test_graphml_reader(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPHML)
    nodes, edges = osm.read_graphml(spark, str(tmp_path / "g.graphml"))
    got = {r.osmid: r for r in osm.with_bounds(edges).collect()}
    assert nodes.count() == 2 and len(got[7].geometry) == 3 and len(got[8].geometry) == 2
    assert got[7].length_m == 600.5 and got[7].maxy == 56.951 and got[8].minx == 24.10
    assert edges.select(osm.to_wkt(F.col("geometry")).alias("w")).where("w like 'LINESTRING (24.1 56.95%'").count() == 1


TAGS = [
    ({"highway": "residential"}, True, True), ({"highway": "Track"}, True, False), ({"highway": "service", "service": "alley"}, True, False), ({"highway": "42"}, True, True),
    ({"highway": "footway"}, False, False), ({"highway": "road", "area": "yes"}, False, False), ({"highway": "primary", "access": "Private"}, False, False), ({"highway": "primary", "motorcar": "no"}, False, False),
    ({"highway": "primary", "route": "ferry"}, False, False), ({"highway": "primary", "construction": "yes"}, False, False), ({"highway": "service", "service": "driveway"}, False, False), ({}, False, False),
]


def test_driveable(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TAGS)], "i int, tags map<string,string>")
    got = {r.i: (r.m, r.e) for r in df.select("i", osm.driveable(F.col("tags"), "matcher").alias("m"), osm.driveable(F.col("tags")).alias("e")).collect()}
    assert got == {i: (m, e) for i, (_, m, e) in enumerate(TAGS)}
    with pytest.raises(ValueError):
        osm.driveable(F.col("tags"), "bus")


def test_tiles(spark):
    assert osm.tiles(1.2, 0.0, 0.4, 0.0) == [(0.55, 0.0, 0.4, 0.0), (1.05, 0.45, 0.4, 0.0), (1.2, 0.95, 0.4, 0.0)]
    box = spark.createDataFrame([(1.2, 0.0, 0.4, 0.0)], "north double, south double, east double, west double")
    got = sorted((round(r.tile_n, 6), round(r.tile_s, 6), r.tile_e, r.tile_w) for r in osm.tile_table(box).collect())
    assert got == sorted(osm.tiles(1.2, 0.0, 0.4, 0.0))
    key = box.select(osm.tile_key(F.col("north"), F.col("south"), F.col("east"), F.col("west"))).first()[0]
    import hashlib

    assert key == hashlib.sha256(b"1.200000_0.000000_0.400000_0.000000").hexdigest()


def test_cache(spark, tmp_path):
    cache = osm.RoadCache(spark, str(tmp_path / "cache"))
    cache.save("nodes", spark.range(3))
    assert cache.load("nodes").count() == 3
    cache.clear()
    assert not (tmp_path / "cache").exists()


def lattice(n=4):
    rows = []
    for i in range(n):
        for j in range(n):
            k = i * n + j
            at = (24.1 + j * 0.001, 56.9 + i * 0.001)
            if j < n - 1:
                rows.append((k, k, k + 1, i + 1, 60.0, np.array([at, (at[0] + 0.001, at[1])])))
            if i < n - 1:
                rows.append((100 + k, k, k + n, 1000 + j, 111.0, np.array([at, (at[0], at[1] + 0.001)])))
    return Network(*[list(c) for c in zip(*rows)])


def test_network_kernels():
    net = lattice()
    path = net.shortest_path(0, 15)
    assert path[0] == 0 and path[-1] == 15 and len(path) == 7 and net.shortest_path(3, 3) is None and net.shortest_path(0, 99) is None
    assert net.osmid[net.nearest_edge(56.9001, 24.1)] == 1000
    assert net.nearest_node(56.9, 24.1, 1, 10) == 0 and net.nearest_node(56.9, 24.1, 77, 10) is None and net.nearest_node(56.9005, 24.1005, 1, 10) is None
    a = np.array([[0.0, 0], [1, 0]])
    assert crossing(a, np.array([[0.5, -1], [0.5, 1]]))[0] == "point" and crossing(a, a) == ("more", None) and crossing(a, a + 5) == ("none", None)
    assert crossing(a, np.array([[1.0, 0], [2, 0]])) == ("point", (1.0, 0.0))
    assert between(0, 0, 0, 2, 0, 1) and not between(0, 0, 0, 2, 0.1, 1)
    got = timed(Path(np.array([0.0, 0, 0]), np.array([0.0, 1, 2])), 0, 100)
    assert got[1].tolist()[0] == 1 and got[1].tolist()[-1] == 99 and abs(got[1][1] - 50) < 1e-6


def test_refine_inserts_corners_and_routes():
    net = lattice()
    lat, lon = np.array([56.9, 56.9, 56.9]), np.array([24.1002, 24.1008, 24.1012])
    assert len(refined(lat, lon, np.array([0.0, 10, 20]), net)) == 3
    # from one row road to another that it does not meet: the routed path takes their place
    lat, lon = np.array([56.9, 56.902]), np.array([24.1, 24.102])
    rows = refined(lat, lon, np.array([0.0, 100]), net, max_node_m=10)
    assert any(r[3] for r in rows) or len(rows) == 2


def test_walks_on_the_grid(spark):
    net = grid_network(spark, 6, 12)
    df = points(spark, [(1, 0, 0, 56.9001, 24.1), (1, 1, 60, 56.9, 24.1031), (1, 2, 120, 56.9021, 24.1031), (2, 0, 0, 10.0, 10.0), (2, 1, 9, 10.0, 10.1), (3, 0, 0, None, 1.0)])
    for op in (roads.refine, roads.curve_interpolation):
        got = op(df, net, max_node_m=100).collect()
        assert {r[KEY] for r in got} == {1, 2} and sum(r[KEY] == 2 for r in got) == 2
    near = roads.match_hmm(df, net).collect()
    assert len(near) == 6 and all(r.matched == (r[KEY] == 1) for r in near)
    assert all(r.dist_m < 20 for r in near if r.matched)
    assert {r[KEY] for r in roads.match_hmm(df, net, strict=True).collect()} == {1}
    straight = points(spark, [(1, i, 10 * i, 56.90205, 24.1003 + i * 0.0007) for i in range(10)])
    assert {r.osmid for r in roads.match_hmm(straight, net).collect()} == {3}


def test_shortest_paths(spark):
    net = grid_network(spark, 5, 5)
    got = roads.shortest_paths(spark.createDataFrame([(7, 0, 24), (8, 0, 24), (9, 3, 3)], "request_id long, from_node long, to_node long"), net).collect()
    ends = {r.request_id: max((x.step, x.node_id) for x in got if x.request_id == r.request_id) for r in got}
    assert ends == {7: (8, 24), 8: (8, 24)}
    assert all(abs(r.cum_m) < 1e-9 for r in got if r.step == 0)


def test_nearest_by_grid_is_brute_force(spark):
    rng = np.random.default_rng(0)
    df = points(spark, [(1, i, i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(56.9, 56.95, 80), rng.uniform(24.1, 24.15, 80)))])
    targets = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(56.9, 56.95, 60), rng.uniform(24.1, 24.15, 60)))], "tid long, tlat double, tlon double")
    t = targets.collect()
    for r in roads.nearest_by_grid(df, targets, "tid").collect():
        d = [np.hypot((x.tlat - r.lat), (x.tlon - r.lon) * np.cos(np.radians(r.lat))) for x in t]
        assert r.tid == int(np.argmin(d))


def test_nearest_target_may_be_far(spark):
    """Points far from all targets, dense clusters beside lone targets, ties, and points without a place."""
    rng = np.random.default_rng(4)
    t = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.normal(50, 0.002, 3000), rng.normal(10, 0.002, 3000)))]
    t += [(5000, 50.3, 10.4), (5001, -33.0, 151.0), (6000, 40.0, 9.999), (6001, 40.0, 10.001), (5999, 40.0, 10.001)]
    near = [(1, i, i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.normal(50, 0.3, 60), rng.normal(10, 0.3, 60)))]
    far = [(2, 0, 0, 40.0, 10.0), (2, 1, 1, -80.0, -170.0), (2, 2, 2, 0.0, 0.0), (2, 3, 3, 60.0, 170.0), (2, 4, 4, None, 1.0)]
    targets = spark.createDataFrame(t, "tid long, tlat double, tlon double")
    got = {(r.traj_id, r.seq): r for r in roads.nearest_by_grid(points(spark, near + far), targets, "tid").collect()}
    assert len(got) == len(near) + len(far)
    for k, i, _, a, o in near + far:
        if a is None:
            assert got[k, i].tid is None and got[k, i].target_m is None
            continue
        d = sorted((round(math.hypot((y - a) * roads.METRE, (x - o) * roads.METRE * math.cos(math.radians(a))), 6), n) for n, y, x in t)
        assert got[k, i].tid == d[0][1] and abs(got[k, i].target_m - d[0][0]) < 1e-5
    none = roads.nearest_by_grid(points(spark, near), targets.limit(0), "tid").collect()
    assert len(none) == len(near) and {r.tid for r in none} == {None}


def test_service_client(spark):
    df = points(spark, [(1, 0, 0, 56.9, 24.1), (1, 1, 5, 56.91, 24.11), (2, 0, 0, 1.0, 2.0)])
    bodies = valhalla.requests(df)
    body = json.loads(bodies.where("traj_id = 1").first().body)
    assert body["shape"] == [{"lat": 56.9, "lon": 24.1}, {"lat": 56.91, "lon": 24.11}] and body["search_radius"] == 100 and body["shape_match"] == "map_snap"

    def transport(url, sent):
        if len(json.loads(sent)["shape"]) == 1:
            raise OSError("refused")
        return json.dumps({"tracepoints": [None, {"location": [24.2, 56.8]}]})

    replies = valhalla.send(bodies, "http://x", transport, retries=1, wait_s=0)
    assert replies.where("error is not null").count() == 1
    got = valhalla.matched_points(replies, df).collect()
    assert [(r.seq, r.lat, r.lon, r.original_lat) for r in got] == [(1, 56.8, 24.2, 56.91)]


def test_map_sinks(spark, tmp_path):
    df = points(spark, [(1, 1, 5, 56.91, 24.11), (1, 0, 0, 56.9, 24.1), (1, 2, 6, None, 24.1), (2, 0, 0, 1.0, 2.0)])
    line = maps.geojson_lines(df).where("traj_id = 1").first()
    assert json.loads(line.geometry) == {"type": "LineString", "coordinates": [[24.1, 56.9], [24.11, 56.91]]} and line.n == 2
    page = maps.html_map(df, {1: "a<b"})
    assert "a&lt;b" in page and "Trajectory 2" in page and "legend" in page
    assert maps.svg_plot(df).count("<polyline") == 2 and maps.color_of(1, 2) == maps.PALETTE[5]
    maps.write_geojson(df, str(tmp_path / "out"))
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(r["properties"]["traj_id"] for r in rows) == [1, 2]
    with pytest.raises(ValueError):
        maps.svg_plot(df, limit=1)


def test_bbox_query_keeps_the_edges_around_all_trajectories(spark):
    from trackloom.plans import queries, views

    data = "/root/testdata/sf0.001"
    s, n, w, e = views.walk(spark, data).agg(F.min("lat") - 0.002, F.max("lat") + 0.002, F.min("lon") - 0.002, F.max("lon") + 0.002).first()
    inside = grid_network(spark).where(F.col("ulat").between(s, n) & F.col("vlat").between(s, n) & F.col("ulon").between(w, e) & F.col("vlon").between(w, e))
    assert {r.edge_id for r in queries.queries()["bbox_filter"](spark, data).collect()} == {r.edge_id for r in inside.collect()}


def two_roads(oneway=(False, False)):
    """Two parallel roads eastwards, 22 m apart, that a third joins at their eastern ends."""
    line = [np.array([(24.1, 56.9), (24.11, 56.9)]), np.array([(24.1, 56.9002), (24.11, 56.9002)]), np.array([(24.11, 56.9), (24.11, 56.9002)])]
    return Network([1, 2, 3], [0, 10, 1], [1, 11, 11], [1, 2, 3], [609.0, 609.0, 22.3], line, [*oneway, False])


def test_matching_keeps_to_the_way_of_one_way_roads():
    lon = np.linspace(24.109, 24.101, 9)  # westwards, a little nearer to the southern road
    lat = np.full(9, 56.90009)
    assert {r[3] for r in matched(lat, lon, two_roads())} == {1}
    assert {r[3] for r in matched(lat, lon, two_roads((True, False)))} == {2}
    assert {r[3] for r in matched(lat, lon[::-1], two_roads((True, False)))} == {1}


def test_distances_follow_the_direction():
    net = two_roads((True, False))
    assert net.distances(0, 1e4)[0] == {0: 0.0, 1: 609.0, 11: 631.3, 10: 1240.3}
    assert set(net.distances(1, 1e4)[0]) == {1, 11, 10} and net.shortest_path(1, 0) == [1, 0]


def test_matching_settings_act():
    lon, lat = np.linspace(24.101, 24.109, 9), np.full(9, 56.90007)
    assert all(r[5] for r in matched(lat, lon, two_roads()))
    assert not any(r[5] for r in matched(lat, lon, two_roads(), MatchSettings(obs_noise=1.0, min_prob_norm=0.5)))
    assert all(r[5] for r in matched(lat, lon, two_roads(), MatchSettings(obs_noise=20.0, min_prob_norm=0.5)))
    north = np.where(np.arange(9) == 4, 56.90012, 56.90007)
    assert [r[3] for r in matched(north, lon, two_roads(), MatchSettings(width=1))] == [1, 1, 1, 1, 2, 1, 1, 1, 1]
    assert {r[3] for r in matched(north, lon, two_roads())} == {1}
    far = matched(lat, lon, two_roads(), projected=True)
    assert abs(far[0][1] + far[-1][1]) < 0.01 and 240 < far[-1][1] < 250 and abs(far[0][0] + 7.8) < 0.2


def test_junctions_without_points_are_states():
    """Two ways of equal length from one road to another: the junction near the straight line wins."""
    at = {0: (0.0, 0.0), 1: (0.001, 0.0), 2: (0.002, 0.0), 3: (0.0015, 0.0012), 4: (0.0015, -0.0001), 5: (0.003, 0.0)}
    pairs = [(0, 1), (1, 3), (3, 2), (1, 4), (4, 2), (2, 5)]
    net = Network(range(6), [a for a, _ in pairs], [b for _, b in pairs], range(6), [111.0, 80, 80, 80, 80, 111], [np.array([at[a], at[b]]) for a, b in pairs])
    lon, lat = np.array([0.0005, 0.0014, 0.0025]), np.array([0.0, 0.00035, 0.0])
    wide = {"max_dist_m": 90, "obs_noise": 60, "dist_noise": 1e6, "width": 6}
    assert matched(lat, lon, net, MatchSettings(**wide, non_emitting_states=False))[1][3] in (1, 2)
    assert matched(lat, lon, net, MatchSettings(**wide, obs_noise_ne=20))[1][3] in (3, 4)
    assert matched(lat, lon, net, MatchSettings(**wide, obs_noise_ne=20, non_emitting_length_factor=1e-6))[1][3] in (1, 2)


def test_a_long_leg_after_a_short_one_finds_its_way():
    """A node's distances are searched again where a later leg goes farther than the first that used it."""
    net = lattice(60)
    lat, lon = np.array([56.9, 56.9, 56.9, 56.955]), np.array([24.1005, 24.1015, 24.1005, 24.14])
    rows = matched(lat, lon, net, MatchSettings(dist_noise=5000.0))
    assert all(r[5] for r in rows) and rows[1][3] == 1


def test_ways_are_searched_as_far_as_they_are_asked_for():
    """Trajectories on one network share what was searched, and no search goes on to its limit."""
    net = lattice(40)
    for shift in range(30):
        lat, lon = 56.91 + np.arange(12) * 0.0003, 24.1101 + np.arange(12) * 0.0007 + shift * 1e-6
        assert matched(lat, lon, net)[5][5]
    assert 0 < sum(len(search.done) for search in net.searches.values()) < 1000


def test_trajectories_that_share_a_network_keep_to_their_edges():
    """As on a network of these alone: ways around gaps, one-way roads, and ways that other edges would shorten."""
    rng = np.random.default_rng(5)
    full = lattice(9)
    oneway = rng.random(len(full)) < 0.3
    take = lambda some: Network(*[[v[k] for k in some] for v in (full.edge_id, full.u, full.v, full.osmid, full.length, full.geometry)], oneway[some])
    shared = take(np.arange(len(full)))
    for _ in range(60):
        n = int(rng.integers(1, 12))
        lat, lon = 56.9015 + np.cumsum(rng.normal(0, 0.0006, n)), 24.1035 + np.cumsum(rng.normal(0, 0.0006, n))
        inside = rng.random(len(full)) < 0.75
        settings = MatchSettings(width=int(rng.integers(1, 5)), dist_noise=float(rng.choice([20, 500])))
        got = list(zip(*(v.tolist() for v in matches(lat, lon, shared, settings, inside=inside))))
        want = matched(lat, lon, take(np.flatnonzero(inside)), settings)
        assert [r[2:4] for r in got] == [r[2:4] for r in want]
        assert np.allclose([r[:2] for r in got], [r[:2] for r in want], rtol=0, atol=1e-12)


def test_wide_trajectories_find_all_edges_around(spark):
    """Boxes of long edges, in degrees or metres, lose none that is near enough."""
    lines = [np.array([(10.0, 60.0), (11.9, 60.0)]), np.array([(10.0, 60.0), (10.0, 60.9)]), np.array([(-20.0, 85.0), (20.0, 85.0)])]
    net = Network([1, 2, 3], [0, 0, 5], [1, 2, 6], [1, 2, 3], [1e5, 1e5, 1e5], lines)
    middle = np.array([60.0, 60.00355, 60.0])
    assert [r[2] for r in matched(middle, np.array([10.0, 10.95, 11.9]), net, MatchSettings(max_dist_m=500))] == [1, 1, 1]
    assert matched(np.array([10.0, 85.0]), np.array([0.0, 20.0]), net)[1][2] == 3
    df = points(spark, [(k, i, i, 60.0 + 0.3 * i * (k == 2), 10.0 + 0.3 * i * (k == 1)) for k in (1, 2) for i in range(3)] + [(3, 0, 0, -5.0, 1.0), (3, 1, 1, None, 2.0)])
    edges = spark.createDataFrame([(k, u, v, k, 100.0, y, x, b, a, [(y, x), (b, a)]) for k, u, v, x, y, a, b in [(1, 0, 1, 10.0, 60.0, 11.0, 60.0), (2, 0, 2, 10.0, 60.0, 10.0, 61.0)]], "edge_id long, u long, v long, osmid long, length_m double, ulat double, ulon double, vlat double, vlon double, geometry array<struct<lat:double,lon:double>>")
    got = {(r[KEY], r.seq): r for r in roads.match_hmm(df, edges, MatchSettings(max_dist_m=3000), buffer=1.0).collect()}
    assert len(got) == 8 and {got[1, i].edge_id for i in (1, 2)} == {1} and {got[2, i].edge_id for i in (1, 2)} == {2}
    assert not got[3, 0].matched and got[3, 0].lat == -5 and got[3, 1].lat is None


def test_one_way_column_reaches_the_matcher(spark):
    nodes = spark.createDataFrame([(0, 56.9, 24.1), (1, 56.9, 24.11), (10, 56.9002, 24.1), (11, 56.9002, 24.11)], "node_id long, lat double, lon double")
    ways = spark.createDataFrame([(1, {"oneway": "yes"}, [0, 1]), (2, {}, [10, 11]), (3, {"oneway": "no"}, [1, 11])], "way_id long, tags map<string,string>, nds array<long>")
    net = osm.build_network(nodes, osm.way_edges(ways))
    west = points(spark, [(1, i, i, 56.90009, 24.109 - i * 0.001) for i in range(9)])
    assert {r.osmid for r in roads.match_hmm(west, net).collect()} == {2}
    assert {r.osmid for r in roads.match_hmm(west, net.drop("oneway")).collect()} == {1}
    assert all(abs(r.lon) < 300 for r in roads.match_hmm(west, net, projected=True).collect())


def test_overlapping_tiles_merge(spark, tmp_path):
    (tmp_path / "a.osm").write_text(OSM)
    (tmp_path / "b.osm").write_text(OSM.replace('lat="56.952"', 'lat="56.9525"').replace('v="residential"', 'v="service"').replace('<way id="13">', '<way id="14">'))
    nodes, ways = osm.read_osm_tiles(spark, [str(tmp_path / "a.osm"), str(tmp_path / "b.osm")])
    assert sorted((r.node_id, r.lat) for r in nodes.collect()) == [(1, 56.95), (2, 56.951), (3, 56.9525)]
    assert {r.way_id: r.tags["highway"] for r in ways.collect()} == {10: "service", 11: "primary", 13: "footway", 14: "footway"}
