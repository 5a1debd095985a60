"""Queries on searches with turns, static equilibrium by strategy, and loading by events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from viatica.operators import loading, search, simulation, statics
from viatica.plans.registry import query


def _zones(zones):
    """Every zone to every other, and where the zones are, on a grid of 1,000 metres."""
    d = zones.select(F.col("zone").alias("destination"))
    pairs = zones.select(F.col("zone").alias("origin")).join(d, F.col("destination") != F.col("origin"))
    return pairs, zones.select(F.col("zone").alias("node"), (F.col("zone") % 5 * 1000).alias("x"), (F.expr("zone div 5") * 1000).alias("y"))


@query(
    """WITH RECURSIVE r AS (SELECT from_node AS o, link, from_node AS f, to_node AS t, length_m AS cost FROM v_links UNION SELECT r.o, l.link, l.from_node, l.to_node, cost + length_m FROM r JOIN v_links l ON l.from_node = r.t AND l.to_node <> r.f WHERE cost + length_m <= 5500)
SELECT o AS origin, t AS destination, CAST(min(cost) AS DOUBLE) AS cost FROM r WHERE o <> t GROUP BY 1, 2""",
    "v_zones",
    "v_links",
)
def turn_route_costs(zones, links):
    """Over links and turns, every pair."""
    pairs, nodes = _zones(zones)
    return search.one_to_many(links, pairs, "length_m", nodes).select("origin", "destination", "cost")


@query(None, "v_zones", "v_links")
def turn_route_twins(zones, links):
    pairs, nodes = _zones(zones)
    return search.with_twins(links, pairs, "length_m", 100.0, 2, nodes)


def _asks(trips):
    """Every trip at its own departure."""
    return trips.select(F.col("trip").alias("ask"), F.col("o_zone").alias("origin"), F.col("departure_s").alias("depart_s"), F.array("d_zone").alias("destinations"))


def _times(traversals):
    return loading.link_bins(traversals).select("link", "bin", F.expr("pcu_seconds div pcu").cast("double").alias("seconds"))


@query(None, "v_traversals", "v_links", "v_trip_results", "v_zones")
def earliest_arrivals_in_time(traversals, links, trips, zones):
    """Every trip at its own departure."""
    return search.in_time(links.withColumn("free_s", F.expr("length_m div 10")), _times(traversals), _asks(trips), "free_s", 900, nodes=_zones(zones)[1]).select("ask", "destination", "arrive_s")


@query(None, "v_traversals", "v_links", "v_trip_results", "v_zones")
def least_generalised_costs(traversals, links, trips, zones):
    """Seconds and 20 more for each class of link below the first."""
    rows = links.withColumns({"free_s": F.expr("length_m div 10"), "extra_s": F.col("link") % 4 * 20})
    return search.in_time(rows, _times(traversals), _asks(trips), "free_s", 900, "extra_s", _zones(zones)[1]).select("ask", "destination", "cost", "arrive_s")


@query(None, "v_traversals", "v_links", "v_trip_results", "v_zones")
def routes_after_link(traversals, links, trips, zones):
    """For every trip, the way on after the first link out of its origin."""
    first = links.groupBy(F.col("from_node").alias("o_zone")).agg(F.min(F.struct("link", "to_node")).alias("x"))
    asks = trips.join(F.broadcast(first), "o_zone").select(F.col("trip").alias("ask"), F.col("x.to_node").alias("origin"), "departure_s", F.array("d_zone").alias("destinations"), F.col("x.link").alias("after")).withColumnRenamed("departure_s", "depart_s")
    return search.in_time(links.withColumn("free_s", F.expr("length_m div 10")), _times(traversals), asks, "free_s", 900, nodes=_zones(zones)[1]).select("ask", "arrive_s")


def _static(links, od, strategy):
    net = links.select("link", "from_node", "to_node", "length_m", (F.col("length_m") / 10).alias("free_s"), (F.col("lanes") * 9000.0).alias("capacity"))
    demand = od.select(F.col("o").alias("origin"), F.col("d").alias("destination"), (F.col("sevenths") / 7).alias("people"))
    return statics.solve(net, demand, strategy, turns=4)


@query(None, "v_links", "v_od")
def static_frank_wolfe(links, od):
    return _static(links, od, "frank_wolfe").links


@query(None, "v_links", "v_od")
def static_self_regulated(links, od):
    return _static(links, od, "sra").links


@query(None, "v_links", "v_od")
def static_free_flow(links, od):
    """In five increments, no turn more."""
    return _static(links, od, "free_flow").links


@query(None, "v_links", "v_od")
def static_route_shares(links, od):
    return statics.route_shares(_static(links, od, "msa").routes)


def _simulated(traversals, links, level):
    road = links.select("link", (F.col("length_m") / 10).alias("free_s"), (2.0 / F.col("lanes")).alias("headway_s"), F.floor(F.col("length_m") * F.col("lanes") / 7).alias("storage_pcu"), (F.col("length_m") / 5).alias("lag_s"))
    first = F.min("enter_s").over(Window.partitionBy("vehicle"))
    routes = traversals.withColumn("depart_s", first).select((F.col("vehicle") % 16).alias("scenario"), "vehicle", "pos", "link", "depart_s", "pcu")
    return simulation.simulate(road, routes, level, 40_000.0)


@query(None, "v_traversals", "v_links")
def loading_point_queues(traversals, links):
    """Level 2, over all vehicles in 16 scenarios."""
    return _simulated(traversals, links, 2)


@query(None, "v_traversals", "v_links")
def loading_spillback(traversals, links):
    """Level 4."""
    return _simulated(traversals, links, 4)
