"""Queries on route sets and equilibrium."""

from __future__ import annotations

from pyspark.sql import functions as F

from viatica.operators import loading, routing
from viatica.plans.registry import query


def _pairs(zones):
    """Every zone to every other."""
    d = zones.select(F.col("zone").alias("destination"))
    return zones.select(F.col("zone").alias("origin")).join(d, F.col("destination") != F.col("origin"))


@query(None, "v_zones", "v_links")
def route_sets_penalty(zones, links):
    return routing.route_sets(links, _pairs(zones), "length_m")


@query(None, "v_zones", "v_links", "v_traversals")
def route_sets_simulation(zones, links, traversals):
    """Drawn where the traffic of the traversals is heavy."""
    return routing.route_sets(links, _pairs(zones), "length_m", "simulation", loading.propensity(traversals, 900))


@query(None, "v_traversals", "v_links", "v_trip_results")
def fastest_routes_in_time(traversals, links, trips):
    """Every trip from its origin to its destination at its departure."""
    asks = trips.select(F.col("trip").alias("ask"), F.col("o_zone").alias("origin"), F.col("d_zone").alias("destination"), F.col("departure_s").alias("depart_s"))
    times = loading.link_bins(traversals).select("link", "bin", F.expr("pcu_seconds div pcu").cast("double").alias("seconds"))
    return routing.fastest_at(links.withColumn("free_s", F.expr("length_m div 10")), times, asks, 900).select("ask", "arrive_s")


@query("SELECT situation, arg_min(alternative, cost_eur * 1e9 + alternative) AS alternative FROM v_alternatives GROUP BY 1", "v_alternatives")
def user_choice_model(alternatives):
    """A model in pandas: the cheapest, the first of a tie."""
    def cheapest(rows):
        best = rows["cost_eur"].eq(rows.groupby("situation")["cost_eur"].transform("min"))
        return best & ~rows[best][["situation"]].duplicated().reindex(rows.index, fill_value=True)

    return routing.choose_with(alternatives.select("situation", "alternative", "cost_eur"), cheapest)


TURN = """c{n} AS (SELECT pair, route, round(sum(seconds), 6) AS cost FROM rl JOIN {before} USING (link) GROUP BY 1, 2), m{n} AS (SELECT *, min(cost) OVER (PARTITION BY pair) AS least FROM c{n}), e{n} AS (SELECT *, exp(CAST(-0.02 AS DOUBLE) * (cost - least)) AS e FROM m{n}),
f{n} AS (SELECT pair, route, cost, least, round(e / sum(e) OVER (PARTITION BY pair) * (10 + pair % 7), 6) AS f FROM e{n}), w{n} AS (SELECT link, sum(f) AS w FROM rl JOIN f{n} USING (pair, route) GROUP BY 1),
g{n} AS (SELECT s.link, free, cap, round(s.flow + (coalesce(w, 0) - s.flow) / {k}, 6) AS flow FROM {before} s LEFT JOIN w{n} USING (link)), s{n} AS (SELECT link, free, cap, flow, round(free * (1 + CAST(0.15 AS DOUBLE) * pow(flow / cap, 4)), 6) AS seconds FROM g{n})"""


@query(
    f"""WITH rl AS (SELECT DISTINCT pair, route, link FROM v_routes), s0 AS (SELECT link, CAST(length_m AS DOUBLE) / 10 AS free, CAST(lanes AS DOUBLE) * 9000 AS cap, CAST(0 AS DOUBLE) AS flow, CAST(length_m AS DOUBLE) / 10 AS seconds FROM v_links),
{TURN.format(n=1, before="s0", k=1)}, {TURN.format(n=2, before="s1", k=2)}, {TURN.format(n=3, before="s2", k=3)} SELECT link, round(flow, 3) AS flow, round(seconds, 3) AS seconds FROM s3""",
    "v_routes",
    "v_links",
)
def msa_equilibrium(routes, links):
    net = links.select("link", (F.col("length_m") / 10).alias("free_s"), (F.col("lanes") * 9000.0).alias("capacity"))
    people = routes.select("pair").distinct().withColumn("people", 10 + F.col("pair") % 7)
    flows, _ = routing.equilibrium(routes, net, people, 3, -0.02)
    return flows.select("link", F.round("flow", 3).alias("flow"), F.round("seconds", 3).alias("seconds"))
