from __future__ import annotations

import pandas as pd

from viatica.operators import network, routing


def test_route_sets_keep_their_limits(spark):
    links = network.grid(spark, 4, 100).withColumnRenamed("length_m", "c")
    links = links.selectExpr("from_node * 100 + to_node as link", "from_node", "to_node", "c + (from_node * 7 + to_node * 3) % 11 as c")
    pairs = spark.createDataFrame([(0, 15), (3, 12), (0, 0)], "origin long, destination long")
    cost = {r.link: float(r.c) for r in links.collect()}
    for method in routing.METHODS:
        rows = routing.route_sets(links, pairs, "c", method).collect()
        for o, d in ((0, 15), (3, 12)):
            own = sorted((r for r in rows if (r.origin, r.destination) == (o, d)), key=lambda r: r.route)
            assert own and len({tuple(r.links) for r in own}) == len(own)
            best = own[0].cost
            for r in own:
                assert r.links[0] // 100 == o and r.links[-1] % 100 == d and all(a % 100 == b // 100 for a, b in zip(r.links, r.links[1:], strict=False))
                assert r.cost == sum(cost[x] for x in r.links) >= best and r.cost <= 2.0 * best


def test_penalty_overlap():
    table = pd.DataFrame({"link": [0, 1, 2, 3, 4], "from_node": [0, 1, 0, 2, 1], "to_node": [1, 3, 2, 3, 2], "cost": [1.0, 1.0, 1.1, 1.1, 0.1]})
    found = routing.by_penalty(routing.Net(table), 0, 3, overlap=0.3)
    assert [r for _, r in found] == [[0, 1], [2, 3]]


def test_equilibrium_gap_falls(spark):
    routes = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "pair long, route long, link long")
    links = spark.createDataFrame([(0, 10.0, 50.0), (1, 10.0, 50.0)], "link long, free_s double, capacity double")
    people = spark.createDataFrame([(1, 100.0)], "pair long, people double")
    flows, gaps = routing.equilibrium(routes, links, people, 4, -1.0)
    assert [round(r.flow) for r in flows.orderBy("link").collect()] == [50, 50] and gaps[-1][1] < 1e-6


def test_draws_are_biased_and_limited():
    """The shortest route first; no noise where the bias is 0; no route that shares more than the overlap with one before."""
    table = pd.DataFrame({"link": [0, 1, 2, 3, 4], "from_node": [0, 1, 0, 2, 1], "to_node": [1, 3, 2, 3, 2], "cost": [1.0, 1.0, 1.1, 1.1, 0.1]})
    assert [r for _, r in routing.by_draws(routing.Net(table), 0, 3, overlap=0.4)] == [[0, 1], [2, 3]]
    assert {tuple(r) for _, r in routing.by_draws(routing.Net(table), 0, 3)} == {(0, 1), (2, 3), (0, 4, 3)}
    assert [r for _, r in routing.by_draws(routing.Net(table.assign(bias=0.0)), 0, 3)] == [[0, 1]]
    assert [r for _, r in routing.by_draws(routing.Net(table), 0, 3, detour=1.05)] == [[0, 1]]


def test_routes_by_joins_are_those_of_the_search(spark):
    links = network.grid(spark, 4, 100).selectExpr("from_node * 100 + to_node as link", "from_node", "to_node", "length_m + (from_node * 7 + to_node * 3) % 11 as c")
    pairs = spark.createDataFrame([(0, 15), (3, 12), (5, 5), (0, 99)], "origin long, destination long")
    a, b = (sorted((r.origin, r.destination, r.cost) for r in network.shortest_routes(links, pairs, "c", most).collect()) for most in (10**6, 3))
    assert a == b and len(a) == 3


def test_user_model_sees_whole_situations(spark):
    rows = spark.range(5000).selectExpr("id div 7 as situation", "id % 7 as alternative", "(id * 37) % 11 as c").repartition(3)
    sizes = []

    def model(frame):
        assert (frame.groupby("situation").size().isin([7, 2])).all() and frame["situation"].nunique() <= 50
        return frame["c"].eq(frame.groupby("situation")["c"].transform("min"))

    got = {tuple(r) for r in routing.choose_with(rows, model, most=50).collect()}
    want = {}
    for r in rows.collect():
        want.setdefault(r.situation, []).append((r.c, r.alternative))
    assert got == {(s, a) for s, own in want.items() for c, a in own if c == min(own)[0]} and not sizes
