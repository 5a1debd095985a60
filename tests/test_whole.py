"""Queries over whole tables, against brute force."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from viatica.functions import geo
from viatica.operators import loading, network
from viatica.plans.catalog import QUERIES
from viatica.sources.bridge import view

DATA = "/root/testdata/sf0.001"


def _nearest(points, nodes):
    return {p: min(((x - a) ** 2 + (y - b) ** 2, n) for n, a, b in nodes)[::-1] for p, x, y in points}


def test_nearest_node_of_all(spark):
    # 1: nothing around it; 2: a node two cells off is farther than one just outside the nine; 3: a tie
    points, nodes = [(1, 5000, 5000), (2, 199, 199), (3, 1050, 50)], [(10, 1, 1), (11, 301, 199), (12, 1040, 50), (13, 1060, 50)]
    got = network.nearest_node(spark.createDataFrame([*points, (4, None, 1)], "point long, x long, y long"), spark.createDataFrame(nodes, "node long, x long, y long"), 100)
    assert {r.point: (r.node, r.d2) for r in got.collect()} == {**_nearest(points, nodes), 4: (None, None)}
    assert network.nearest_node(got.select("point", F.lit(1).alias("x"), F.lit(1).alias("y")), spark.createDataFrame([], "node long, x long, y long"), 100).filter("node is null").count() == 4


def test_snap_whole(spark):
    points = [(k, k * 37 % 500, k * 91 % 500) for (k,) in spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey").collect()]
    nodes = [(k, k * 53 % 500, k * 29 % 500) for (k,) in spark.read.parquet(f"{DATA}/supplier.parquet").select("s_suppkey").collect()]
    assert {r.point: (r.node, r.d2) for r in QUERIES["snap_nearest_node"](spark, DATA).collect()} == _nearest(points, nodes)


def test_quota_spread_whole(spark, duck):
    trips = [t for (t,) in duck.sql("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey").fetchall()]
    assert {r.trip: r.u for r in QUERIES["quota_spread"](spark, DATA).collect()} == {t: int(f"{t:053b}"[::-1], 2) / 2**53 for t in trips}
    large = spark.createDataFrame([(65_536,), (5_000_001,)], "trip long").select("trip", geo.reversed_bits(F.col("trip")).alias("u"))
    assert {r.trip: r.u for r in large.collect()} == {t: int(f"{t:053b}"[::-1], 2) / 2**53 for t in (65_536, 5_000_001)}


def test_route_seconds_whole(spark):
    rows = view(spark, DATA, "v_traversals").collect()
    sums, routes = {}, {}
    for r in view(spark, DATA, "v_traversals").transform(loading.link_bins).collect():
        sums[r.link, r.bin] = r.pcu_seconds // r.pcu
    for r in rows:
        routes.setdefault(r.vehicle, []).append((r.pos, r.link, r.enter_s))
    want = {}
    for vehicle, own in routes.items():
        t = min(x[2] for x in own)
        for _, link, _ in sorted(own):
            t += sums.get((link, t // 900), 30)
        want[vehicle] = t
    assert max(len(x) for x in routes.values()) > 6
    assert {r.vehicle: r.arrive_s for r in QUERIES["route_seconds"](spark, DATA).collect()} == want


def _links(spark):
    return [(r.link, r.from_node, r.to_node, r.length_m) for r in view(spark, DATA, "v_links").collect()]


def test_route_sets_of_every_pair(spark):
    cost = {(o, d): 0 if o == d else 10**9 for o in range(25) for d in range(25)}
    for _, a, b, c in _links(spark):
        cost[a, b] = c
    for k in range(25):
        cost = {(o, d): min(c, cost[o, k] + cost[k, d]) for (o, d), c in cost.items()}
    for name in ("route_sets_penalty", "route_sets_simulation"):
        best = {(r.origin, r.destination): r.cost for r in QUERIES[name](spark, DATA).filter("route = 0").collect()}
        assert best == {k: c for k, c in cost.items() if k[0] != k[1]}


def test_fastest_routes_of_every_trip(spark):
    """Against arrivals relaxed until nothing changes, for a sample of trips; every trip has an answer."""
    seconds = {(r.link, r.bin): r.pcu_seconds // r.pcu for r in view(spark, DATA, "v_traversals").transform(loading.link_bins).collect()}
    trips, links = view(spark, DATA, "v_trip_results").collect(), _links(spark)
    got = {r.ask: r.arrive_s for r in QUERIES["fastest_routes_in_time"](spark, DATA).collect()}
    assert set(got) == {r.trip for r in trips}
    for r in trips[::29]:
        at, turn = {r.o_zone: r.departure_s}, True
        while turn:
            turn = False
            for link, a, b, metres in links:
                if a in at and (t := at[a] + seconds.get((link, at[a] // 900), metres // 10)) < at.get(b, 10**9):
                    at[b], turn = t, True
        assert got[r.trip] == at[r.d_zone]


def _costs(spark):
    cost = {(o, d): 0 if o == d else 10**9 for o in range(25) for d in range(25)}
    for _, a, b, c in _links(spark):
        cost[a, b] = c
    for k in range(25):
        cost = {(o, d): min(c, cost[o, k] + cost[k, d]) for (o, d), c in cost.items()}
    return cost


def test_costs_reach_and_components_whole(spark):
    cost = _costs(spark)
    assert {(r.origin, r.destination): r.cost for r in QUERIES["shortest_path_costs"](spark, DATA).collect()} == cost
    assert {(r.origin, r.node): r.cost for r in QUERIES["bounded_reach"](spark, DATA).collect()} == {k: c for k, c in cost.items() if c <= 2500}
    assert {(r.node, r.component) for r in QUERIES["network_components"](spark, DATA).collect()} == {(n, 0) for n in range(25)}


def test_demand_whole(spark):
    cells = {(r.o, r.d): r.n for r in QUERIES["od_integerise"](spark, DATA).collect()}
    want = [(o, d, i, 25200 + int(hashlib.md5(f"9:{o}:{d}:{i}".encode()).hexdigest()[:8], 16) % 7200) for (o, d), n in cells.items() for i in range(1, n + 1)]
    assert max(o for o, *_ in want) > 4
    assert sorted(map(tuple, QUERIES["demand_from_od"](spark, DATA).collect())) == sorted(want)


def test_raptor_whole(spark):
    calls, runs = {}, {}
    for r in view(spark, DATA, "v_calls").collect():
        calls.setdefault((r.line, r.stop), []).append((r.depart_s, r.run, r.pos))
        runs.setdefault(r.run, []).append((r.pos, r.stop, r.arrive_s))
    want = {}
    for trip, o, at_s in [(r.trip, r.o_zone, r.departure_s) for r in view(spark, DATA, "v_trip_results").collect()]:  # every trip at its own departure
        best = {o: (at_s, 0)}
        for n in (1, 2, 3):
            new = {}
            for stop, (t, rides) in best.items():
                for (_, at), own in calls.items() if rides == n - 1 else ():
                    ready = [c for c in own if at == stop and c[0] >= t + 60 * (n > 1)]
                    for pos, to, arrive in runs[min(ready)[1]] if ready else ():
                        if pos > min(ready)[2]:
                            for there, when in ((to, arrive), (to + 5, arrive + 240)):
                                if there < 25:
                                    new[there] = min(new.get(there, (10**9, n)), (when, n))
            best |= {s: min(x, best.get(s, x)) for s, x in new.items()}
        want |= {(trip, s): x for s, x in best.items()}
    assert {(r.ask, r.stop): (r.t, r.rides) for r in QUERIES["raptor_arrivals"](spark, DATA).collect()} == want


def test_gridlock_whole(spark):
    ids = [s for (s,) in spark.read.parquet("/root/testdata/sf0.1/supplier.parquet").select("s_suppkey").collect()]
    step, want = {s: (s * 7 + 3) % (max(ids) + 1) for s in ids}, {}
    for s in ids:
        ring, at = [s], step[s]
        while at in step and at != s and len(ring) <= len(ids):
            ring.append(at)
            at = step[at]
        if at == s:
            want[s] = min(ring)
    assert {r.link: r.ring for r in QUERIES["gridlock_cycles"](spark, "/root/testdata/sf0.1").collect()} == want and max(want) > 50
