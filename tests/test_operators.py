"""Small cases of operators that SQL does not check, or whose edges the tables do not reach."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from viatica.operators import choice, demand, loading, network, transit


def test_shortest_routes_follow_links(spark):
    links = spark.createDataFrame([(0, 1, 2, 5.0), (1, 2, 3, 5.0), (2, 1, 3, 11.0), (3, 3, 4, 1.0)], "link long, from_node long, to_node long, c double")
    pairs = spark.createDataFrame([(1, 4), (1, 3), (4, 1)], "origin long, destination long")
    got = {(r.origin, r.destination): (r.cost, list(r.links)) for r in network.shortest_routes(links, pairs, "c").collect()}
    assert got == {(1, 4): (11.0, [0, 1, 3]), (1, 3): (10.0, [0, 1])}


def test_static_assignment_keeps_flow(spark):
    """Two parallel ways of equal cost and capacity; at a node, what comes in goes out."""
    links = spark.createDataFrame([(0, 1, 2, 10.0, 100.0), (1, 2, 4, 10.0, 100.0), (2, 1, 3, 10.0, 100.0), (3, 3, 4, 10.0, 100.0)], "link long, from_node long, to_node long, free_s double, capacity double")
    wanted = spark.createDataFrame([(1, 4, 200.0)], "origin long, destination long, people double")
    flow = {r.link: r.flow for r in network.static_assignment(links, wanted, turns_=6).collect()}
    assert flow[0] == pytest.approx(flow[1]) and flow[2] == pytest.approx(flow[3])
    assert flow[0] + flow[2] == pytest.approx(200) and abs(flow[0] - 100) <= 200 / 6


def test_discharge_waits_for_the_vehicle_before(spark):
    queue = spark.createDataFrame([(1, 1, 0, 10, 1), (1, 2, 0, 10, 2), (1, 3, 0, 30, 1)], "link long, vehicle long, pos long, ready_s long, pcu long")
    got = {r.vehicle: r.exit_s for r in loading.discharge(queue, 5).collect()}
    assert got == {1: 10, 2: 15, 3: 30}


def test_bpr_of_a_closed_link_is_null(spark):
    row = spark.range(1).select(loading.bpr(F.lit(10.0), F.lit(5.0), F.lit(0.0)).alias("a"), loading.bpr(F.lit(10.0), F.lit(100.0), F.lit(100.0)).alias("b")).first()
    assert row.a is None and row.b == pytest.approx(11.5)


def test_three_routes_logit(spark):
    rows = spark.createDataFrame([(1, i, -0.2 * t) for i, t in enumerate((20, 22, 25))], "situation long, alternative long, u double")
    got = [round(r.p, 3) for r in choice.logit(rows).orderBy("alternative").collect()]
    assert got == [0.491, 0.329, 0.18]


def test_apportion_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([(1, i, 1) for i in range(3)], "situation long, alternative long, s long")
    got = [r.n for r in choice.apportion(rows, ["situation"], F.col("s"), F.lit(4), ["alternative"]).orderBy("alternative").collect()]
    assert got == [2, 1, 1]


def test_clock_text(spark):
    rows = spark.createDataFrame([("25:01:02",), ("7:00:00",), ("bad",), (None,)], "t string")
    assert [r[0] for r in rows.select(transit.seconds_of(F.col("t"))).collect()] == [90062, 25200, None, None]


def test_sample_of_empty_table(spark):
    rows = spark.createDataFrame([], "k long, s string")
    assert demand.systematic_sample(rows, ["s"], "k", 10, 1).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i, i + 1) for i in range(9)] + [(20, 30, 31)], "link long, from_node long, to_node long")
    got = {r.node: r.component for r in network.components(links).collect()}
    assert got == {**{i: 0 for i in range(10)}, 30: 30, 31: 30}


def test_self_regulated_steps_lag_by_two(spark):
    """1, 2, then a rise, then each comparison of gaps two iterations on; an equal or missing gap is a rise."""
    from viatica.operators import choice

    gaps = [0.9, 0.5, 0.5, 0.4, None, 0.3, 0.2]
    rows = spark.createDataFrame([(1, i, g) for i, g in enumerate(gaps)], "run long, iteration long, gap double")
    got = [r.eta for r in choice.self_regulated_steps(rows).orderBy("iteration").collect()]
    assert got == [1.0, 2.0, 3.5, 3.7, 5.2, 5.4, 6.9]
    assert [round(1 / x, 6) for x in got] == [r.step for r in choice.self_regulated_steps(rows).orderBy("iteration").collect()]


def test_kinds_of_route_types(spark):
    from pyspark.sql import functions as F

    from viatica.operators import transit

    want = {"tram": [0, 5, 900, 999], "metro": [1, 12, 400, 599, 699], "rail": [2, 100, 199, 300, 399], "bus": [3, 11, 200, 299, 700, 899], "ferry": [4, 1000, 1099, 1200, 1299], "other": [6, 7, 10, 13, 99, 1100, 1199, 1300, 1700]}
    rows = spark.createDataFrame([(t, k) for k, own in want.items() for t in own], "t long, kind string")
    assert rows.filter(transit.kind_of(F.col("t")) != F.col("kind")).isEmpty()


def test_models_by_name(spark):
    import pytest
    from pyspark.sql import functions as F

    from viatica.operators import registries

    rows = spark.range(3000).selectExpr("id div 3 as situation", "id % 3 as alternative", "id % 2 as nest", "cast(id % 3 as double) as u")
    counts = {}
    for model in ("logit", "nested_logit", "deterministic"):
        got = registries.choose(rows, model, 3)
        assert got.count() == 1000 and got.select("situation").distinct().count() == 1000
        counts[model] = {r.alternative: r["count"] for r in got.groupBy("alternative").count().collect()}
    assert counts["deterministic"] == {2: 1000} and counts["logit"][2] > counts["logit"][1] > counts["logit"][0]
    drawn = {r.alternative: r["count"] for r in registries.random_utility(rows, 5).groupBy("alternative").count().collect()}
    assert abs(drawn[2] - counts["logit"][2]) < 80  # both draw from one logit
    registries.register_model("first", lambda r, draw: r.groupBy("situation").agg(F.min("alternative").alias("alternative")))
    assert registries.choose(rows, "first", 0).filter("alternative <> 0").isEmpty() and "first" in registries.choice_models()
    with pytest.raises(ValueError, match="taken"):
        registries.register_model("logit", lambda r, d: r)
    with pytest.raises(ValueError, match="no choice model"):
        registries.choose(rows, "none", 0)
    assert "frank_wolfe" in registries.equilibration_strategies() and "simulation" in registries.route_methods()
    assert {r.value for r in registries.parameters(spark, {"sra.eta_fell": 0.3}).filter("name = 'eta_fell'").collect()} == {0.3}
    with pytest.raises(ValueError, match="no parameter"):
        registries.parameters(spark, {"sra.x": 1.0})
