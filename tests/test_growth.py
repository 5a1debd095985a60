"""Search trees, column generation and route sets by several costs, against plain loops."""

from __future__ import annotations

import heapq
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from viatica.operators import columns, trees
from viatica.plans import growth
from viatica.sources.bridge import view

SMALL = "/root/testdata/sf0.001"


def table(rows):
    """Links (link, from, to, seconds, metres) with nodes on a line of coordinates given by their number."""
    return pd.DataFrame([(k, a, b, s, m, b, -b, a, -a) for k, a, b, s, m in rows], columns=["link", "from_node", "to_node", "free_s", "length_m", "x", "y", "from_x", "from_y"])


def every_route(rows, o, d):
    """All routes that repeat no link and turn back only at dead ends."""
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    found, todo = [], [[r] for r in out.get(o, [])]
    while todo:
        route = todo.pop()
        if route[-1][2] == d:
            found.append(route)
        for r in out.get(route[-1][2], []):
            if r not in route and (r[2] != route[-1][1] or len(out[route[-1][2]]) == 1):
                todo.append([*route, r])
    return found


def order(route):
    """Cost, metres, links, then from the end back: nodes' places, lengths, ids."""
    places = [(route[-1][2], -route[-1][2]), *[(r[1], -r[1]) for r in reversed(route)]]
    return (sum(r[3] for r in route), round(sum(r[4] for r in route) * 1000), len(route), places, [round(r[4] * 1000) for r in reversed(route)], [r[0] for r in reversed(route)])


def test_tie_rule_by_all_routes():
    draw = random.Random(3)
    for _ in range(150):
        n = draw.randint(3, 6)
        rows = [(k, *draw.sample(range(n), 2), draw.randint(1, 2), draw.choice([100.0, 100.0, 100.0004, 150.5])) for k in range(draw.randint(4, 11))]
        roads = trees.Roads(table(rows))
        free = trees.Times(roads, 900)
        for o in range(n):
            if roads.node(o) < 0:
                continue
            tree = trees.Tree(roads, free, roads.node(o), 0.0, None, set(range(len(roads.nodes))) - {roads.node(o)})
            for d in range(n):
                if d == o or roads.node(d) < 0:
                    continue
                all_ = every_route(rows, o, d)
                got = tree.route(roads.node(d))
                assert (got is None) == (not all_)
                if got is not None:
                    assert [roads.ids[k] for k in got] == [r[0] for r in min(all_, key=order)], (rows, o, d)


def grid(wide, high, seed=0):
    draw = np.random.default_rng(seed)
    rows = []
    for n in range(wide * high):
        for k, s in enumerate((1, -1, wide, -wide)):
            t = n + s
            if 0 <= t < wide * high and (abs(s) == wide or n // wide == t // wide):
                rows.append((4 * n + k, n, t))
    costs = draw.integers(20, 90, len(rows))
    return [(k, a, b, float(c), 10.0 * c) for (k, a, b), c in zip(rows, costs, strict=True)]


def test_hundred_thousand_links():
    roads = trees.Roads(table(grid(160, 160)))
    assert len(roads.ids) > 100_000
    began = time.perf_counter()
    tree = trees.Tree(roads, trees.Times(roads, 900), 0, 0.0, None, set(range(1, len(roads.nodes))))
    assert time.perf_counter() - began < 60 and len(tree.best) >= 160 * 160 - 1
    near = trees.Tree(roads, trees.Times(roads, 900), 0, 0.0, None, {5})
    assert near.route(5) == tree.route(5) and len(near.best) < 1000  # it stops when it has what is wanted


def test_costs_in_time():
    """Against label correcting over states (link, clock), and a vector's extras beside the clock."""
    rows = grid(6, 6, 1)
    roads = trees.Roads(table(rows))
    draw = np.random.default_rng(2)
    known = pd.DataFrame([(r[0], b, r[3] + 3.0 * draw.integers(0, 3)) for r in rows for b in range(4)], columns=["link", "bin", "seconds"])
    times = trees.Times(roads, 400, known)
    own = {(k, b): s for k, b, s in known.itertuples(index=False)}
    seconds = lambda k, at: own.get((k, int(at // 400)), rows_by[k][3])
    rows_by = {r[0]: r for r in rows}
    extra = np.where(np.arange(len(rows)) % 5 == 0, 40.0, 0.0)
    place = {k: n for n, k in enumerate(roads.ids.tolist())}
    tree = trees.Tree(roads, times, 0, 100.0, extra, set(range(1, 36)))
    heap = [(seconds(r[0], 100.0) + extra[place[r[0]]], 100.0 + seconds(r[0], 100.0), r[0]) for r in rows if r[1] == 0]
    heapq.heapify(heap)
    done: dict = {}
    while heap:
        cost, clock, k = heapq.heappop(heap)
        if k in done:
            continue
        done[k] = cost
        for r in rows:
            if r[1] == rows_by[k][2] and r[2] != rows_by[k][1] and r[0] not in done:
                t = seconds(r[0], clock)
                heapq.heappush(heap, (cost + t + extra[place[r[0]]], clock + t, r[0]))
    for d in range(1, 36):
        links = tree.route(d)
        assert tree.cost[links[-1]] == pytest.approx(min(c for k, c in done.items() if rows_by[k][2] == d))
        clock = cost = 100.0
        for k in links:
            t = seconds(int(roads.ids[k]), clock)
            clock, cost = clock + t, cost + t + extra[k]
        assert cost - 100 == pytest.approx(tree.cost[links[-1]]) and clock == pytest.approx(tree.clock[links[-1]])


def frame(spark, rows):
    return spark.createDataFrame(table(rows)).withColumn("capacity", F.lit(100.0))


def test_asks_share_trees_and_clocks(spark):
    rows = grid(6, 6, 4)
    roads = trees.Roads(table(rows))
    known = pd.DataFrame([(r[0], b, r[3] * (1 + (r[0] + b) % 3)) for r in rows for b in (27, 28)], columns=["link", "bin", "seconds"])
    shared = spark.sparkContext.broadcast(trees.Shared(roads, trees.Times(roads, 900, known), {3: np.full(len(rows), 7.0)}))
    asks = spark.createDataFrame([(o, b, v, d) for o in (0, 7) for b in (27, 30) for v in (3, 4) for d in (35, 0, 99)] * 3 + [(None, 27, 3, 5), (98, 27, 3, 5)], "origin long, bin long, vector long, destination long").filter("origin is not null")
    got = trees.shared_trees(shared, asks).collect()
    assert len(got) == 12  # no route to itself, to or from a node that is not there
    times = trees.Times(roads, 900, known)
    for r in got:
        tree = trees.Tree(roads, times, r.origin, (r.bin + 0.5) * 900, np.full(len(rows), 7.0) if r.vector == 3 else None, {r.destination})
        assert [roads.ids[k] for k in tree.route(r.destination)] == r.links and r.cost == pytest.approx(r.seconds + (7 * len(r.links) if r.vector == 3 else 0))
    again = trees.ridden(shared, trees.shared_trees(shared, asks)).collect()
    assert all(any(a.links == r.links and a.seconds == pytest.approx(r.seconds) and a.cost == pytest.approx(r.cost) and a.bin == r.bin and a.vector == r.vector and a.entered[0] == r.bin for a in again) for r in got)


def plain_update(roads, times, sets, asks, most, slack=0.02, gain=1.0):
    """Sets {(o, d): [(route, links, people)]} after an update, over the asks [(o, d, bin)]."""
    def clocked(links, t, bin_):
        clock = (bin_ + 0.5) * t.width
        for k in links:
            clock += t.table[k, t.column(clock)]
        return clock - (bin_ + 0.5) * t.width

    free = trees.Times(roads, times.width)
    out = {}
    for (o, d), routes in sets.items():
        bins = sorted(b for x, y, b in asks if (x, y) == (o, d))
        room, new = max(1, most - len(routes)), []
        idle = [clocked(links, free, 0) for _, links, _ in routes]
        for b in bins:
            best = min(clocked(links, times, b) for _, links, _ in routes)
            if best <= min(idle) * (1 + slack):
                continue
            links = trees.Tree(roads, times, o, (b + 0.5) * times.width, None, {d}).route(d)
            cost = clocked(links, times, b)
            if cost <= best + 1e-9 and (len(routes) < most or cost < best - gain) and links not in [x for _, x, _ in routes] and links not in new and len(new) < room:
                new.append(links)
        shortest = min(range(len(routes)), key=lambda i: (idle[i], routes[i][0]))
        can_go = sorted((i for i in range(len(routes)) if i != shortest and routes[i][2] == 0), key=lambda i: (-idle[i], routes[i][0]))
        excess = max(0, len(routes) + len(new) - most)
        fits = len(new) - (excess - min(excess, len(can_go)))
        gone = can_go[: max(0, len(routes) + fits - most)]
        last = max(r for r, _, _ in routes)
        out[o, d] = sorted([(r, tuple(links)) for i, (r, links, _) in enumerate(routes) if i not in gone] + [(last + 1 + n, tuple(links)) for n, links in enumerate(new[:fits])])
    return out


@pytest.mark.parametrize("most", [2, 4])
def test_update_by_a_plain_loop(spark, most):
    rows = grid(7, 7, 5)
    roads = trees.Roads(table(rows))
    draw = np.random.default_rng(most)
    free = spark.sparkContext.broadcast(trees.Shared(roads, trees.Times(roads, 600)))
    pairs = [(o, d) for o in (0, 3, 24) for d in (48, 20, 6)]
    asks = [(o, d, b) for o, d in pairs for b in (10, 12)]
    asked = spark.createDataFrame([(o, d, 0, b) for o, d, b in asks], "origin long, destination long, vector long, bin long")
    sets = columns.first_sets(free, asked).withColumn("people", F.lit(1.0))
    for turn in range(1, 4):
        known = pd.DataFrame([(r[0], b, r[3] * (1 + draw.integers(0, 4))) for r in rows for b in range(9, 14)], columns=["link", "bin", "seconds"])
        now = trees.Times(roads, 600, known)
        held = {}
        for r in sets.collect():
            held.setdefault((r.origin, r.destination), []).append((r.route, np.searchsorted(roads.ids, r.links).tolist(), r.people))
        want = plain_update(roads, now, {k: sorted(v) for k, v in held.items()}, asks, most)
        sets = columns.update_least_cost(sets, asked, free, spark.sparkContext.broadcast(trees.Shared(roads, now)), most=most, turn=turn)
        got: dict = {}
        for r in sets.collect():
            got.setdefault((r.origin, r.destination), []).append((r.route, tuple(np.searchsorted(roads.ids, r.links).tolist())))
        assert {k: sorted(v) for k, v in got.items()} == want and max(map(len, want.values())) <= most
        sets = sets.withColumn("people", F.when(F.col("route") % 2 == 0, F.col("people")).otherwise(F.lit(0.0)))
    assert max(map(len, want.values())) == most


def test_sets_never_get_worse(spark):
    links, trips = view(spark, SMALL, "v_roads"), view(spark, SMALL, "v_journeys")
    roads = growth._roads(links).withColumn("capacity", F.lit(30.0))
    ways = trips.withColumn("vector", F.lit(0))
    one, three = columns.grow(roads, ways, turns=1), columns.grow(roads, ways, turns=3)
    early, late = one.sets.toPandas(), three.sets.toPandas()
    assert [r["turn"] for r in three.reports] == [1, 2, 3] and three.reports[0]["added"] > 0 and three.reports[-1]["routes"] == len(late)
    assert (late.groupby(["origin", "destination"]).size() <= 10).all() and set(early.turn) == {0, 1}
    kept = late.assign(k=late.links.map(tuple)).set_index(["origin", "destination", "k"]).index
    assert set(early.assign(k=early.links.map(tuple)).set_index(["origin", "destination", "k"]).index) <= set(kept)  # none is lost under the limit
    shared = spark.sparkContext.broadcast(trees.Shared(trees.roads_of(roads), trees.times_of(trees.roads_of(roads), three.times, 900)))
    at = lambda sets: trees.ridden(shared, sets.withColumns({"bin": F.lit(29).cast("long"), "vector": F.lit(0).cast("long")})).groupBy("origin", "destination").agg(F.min("cost").alias("c"))
    both = at(one.sets).join(at(three.sets).withColumnRenamed("c", "later"), ["origin", "destination"])
    assert both.filter("later > c + 1e-9").isEmpty() and not both.filter("later < c - 1").isEmpty()
    assert columns.grow(roads, ways.limit(0), turns=1).sets.count() == 0


def test_cost_vectors(spark):
    rows = [(0, 10, -1.0, -0.5, 0.0), (1, 10, -2.0, -1.0, 0.0), (2, 15, -1.0, -0.25, 0.0), (3, 4, -1.0, -0.3, 0.0), (4, 3, -1.0, 0.0, -0.1), (5, 2, 0.5, -1.0, 0.0)]
    classes = spark.createDataFrame(rows, "class long, people long, beta_time double, beta_cost double, beta_km double")
    kept, of = columns.cost_vectors(classes, ["cost", "km"])
    assert {(r.vector, r.w_cost, r.w_km) for r in kept.collect()} == {(0, 30.0, 0.0), (2, 15.0, 0.0)}
    got = {r["class"]: (r.vector, r.grouped) for r in of.collect()}
    assert got == {0: (0, False), 1: (0, False), 2: (2, False), 3: (2, True), 4: (0, True), 5: (0, True)}  # by value of time: 3.3 is nearer to 4 than to 2
    all_, own = columns.cost_vectors(classes, ["cost", "km"], most=9)
    assert all_.count() == 5 and own.filter("grouped").isEmpty()
    extras = columns.extras_of(spark.createDataFrame([(1, 10.0, 2.0, 0.5), (2, 10.0, -9.0, 0.0)], "link long, free_s double, cost double, km double"), kept, ["cost", "km"])
    assert {(r.vector, r.link, r.extra_s) for r in extras.collect()} == {(0, 1, 60.0), (2, 1, 30.0), (0, 2, -10.0), (2, 2, -10.0)}  # no link costs less than nothing


def drawn(spark, rows, draws):
    links = frame(spark, rows).withColumns({"cost": F.col("link") % 3 * 2.0, "km": F.col("length_m") / 1000})
    vectors = spark.createDataFrame([(0, 20.0, 0.0), (2, 5.0, 100.0)], "vector long, w_cost double, w_km double")
    every = columns.drawn_vectors(vectors, ["cost", "km"], draws)
    return links, every, columns.extras_of(links, every, ["cost", "km"])


def test_sampled_sets_by_a_loop(spark):
    rows = grid(6, 6, 6)
    links, every, extras = drawn(spark, rows, 3)
    weights = {r.vector: (r.w_cost, r.w_km) for r in every.collect()}
    assert len(weights) == 8 and weights[0] == (20.0, 0.0) and weights[200] == (5.0, 100.0) and len({w for w, _ in weights.values()}) == 8 and all(14 <= weights[v][0] <= 26 for v in range(4))
    roads = trees.roads_of(links)
    shared = spark.sparkContext.broadcast(trees.Shared(roads, trees.Times(roads, 900), trees.vectors_of(roads, extras)))
    pairs = [(o, d) for o in (0, 8, 35) for d in (35, 5, 0, 20) if o != d]
    got: dict = {}
    for r in columns.sampled_sets(shared, spark.createDataFrame([*pairs, (4, 4)], "origin long, destination long"), most=4, overlap=0.8).orderBy("route").collect():
        got.setdefault((r.origin, r.destination), []).append(r.links)
    assert set(got) == set(pairs) and any(len(x) == 4 for x in got.values())
    vectors = shared.value.vectors
    for o, d in pairs:
        free = trees.Times(roads, 900)
        held = [trees.Tree(roads, free, o, 450.0, None, {d}).route(d)]
        for v in sorted(vectors):
            noise = 1 + 0.5 * columns.mixed(0, o, v, roads.ids) if v % 100 else np.ones(len(rows))
            links_ = trees.Tree(roads, free, o, 450.0, vectors[v], {d}, noise).route(d)
            cost = roads.free + vectors[v]
            alike = max(cost[list(set(links_) & set(x))].sum() for x in held) / cost[links_].sum()
            if len(held) < 4 and links_ not in held and cost[links_].sum() <= 1.5 * cost[held[0]].sum() and alike <= 0.8:
                held.append(links_)
        first = roads.free + vectors[0]
        want = sorted(held, key=lambda x: (round(float(first[x].sum()), 9), x))
        assert got[o, d] == [roads.ids[x].tolist() for x in want]


def test_draws_are_even_and_keyed():
    u = columns.mixed(1, 2, np.arange(100_000))
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.02
    assert columns.mixed(1, 2, 7) == u[7] and columns.mixed(2, 1, 7) != u[7]


def test_sets_by_cost_hold_each_vectors_best(spark):
    rows = grid(6, 6, 7)
    links, _, extras = drawn(spark, rows, 0)
    roads = trees.roads_of(links)
    shared = spark.sparkContext.broadcast(trees.Shared(roads, trees.Times(roads, 900), trees.vectors_of(roads, extras)))
    pairs = [(0, 35), (8, 20), (3, 33)]
    got: dict = {}
    for r in columns.sets_by_cost(shared, spark.createDataFrame(pairs, "origin long, destination long"), columns.penalty_routes, [0, 200]).orderBy("route").collect():
        got.setdefault((r.origin, r.destination), []).append((r.cost, np.searchsorted(roads.ids, r.links).tolist()))
    for o, d in pairs:
        routes = [x for _, x in got[o, d]]
        assert [c for c, _ in got[o, d]] == sorted(c for c, _ in got[o, d]) and len({tuple(x) for x in routes}) == len(routes) <= 5
        for v in (0, 200):
            cost = roads.free + shared.value.vectors[v]
            per = columns.penalty_routes(roads, cost, o, d)
            assert per[0] in routes and all(cost[x].sum() <= 1.3 * cost[per[0]].sum() + 1e-9 for x in per)
            for i, x in enumerate(per):
                assert all(cost[list(set(x) & set(y))].sum() <= 0.75 * max(cost[x].sum(), cost[y].sum()) + 1e-9 for y in per[:i])


def test_growing_views_are_one_network(spark, duck):
    from viatica.sources.bridge import with_views

    for name in ("v_roads", "v_journeys"):
        mine = view(spark, SMALL, name).toPandas().sort_values(by=[view(spark, SMALL, name).columns[0]]).reset_index(drop=True)
        theirs = duck.sql(with_views(f"SELECT * FROM {name}")).df()[list(mine.columns)].sort_values(by=[mine.columns[0]]).reset_index(drop=True)
        assert mine.astype("int64").equals(theirs.astype("int64"))
    links = view(spark, SMALL, "v_roads")
    assert links.count() == links.select("link").distinct().count() and links.filter("length_m <= 0 or lanes < 1").isEmpty()


@pytest.mark.parametrize("name", ["shared_tree_routes", "route_update_least_cost", "route_sets_sampled", "route_sets_by_cost"])
def test_queries_cover_all_pairs(spark, name):
    from viatica.plans.registry import QUERIES

    found = QUERIES[name](spark, SMALL)
    trips = view(spark, SMALL, "v_journeys").filter("origin <> destination")
    if "trip" in found.columns:
        assert found.select("trip").distinct().count() == trips.count()
    else:
        assert found.select("origin", "destination").distinct().count() == trips.select("origin", "destination").distinct().count()
