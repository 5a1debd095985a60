"""Skims: travel seconds from every origin to every destination by mode, null where there is no way within the limit; and chains of rides executed on the times that came about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viatica.operators import search, transit


def _matrix(pairs: DataFrame, found: DataFrame, mode: str, most_s: float) -> DataFrame:
    seconds = F.when(F.col("origin") == F.col("destination"), 0.0).when(F.col("seconds") <= most_s, F.col("seconds"))
    rows = pairs.join(found.select("origin", "destination", F.col("seconds").cast("double").alias("seconds")), ["origin", "destination"], "left")
    return rows.select("origin", "destination", F.lit(mode).alias("mode"), F.round(seconds, 6).alias("seconds"))


def layer_skim(links: DataFrame, pairs: DataFrame, seconds: str, mode: str, most_s: float) -> DataFrame:
    """By bike or on foot, at fixed seconds a link."""
    found = search.one_to_many(links, pairs, seconds, bound=most_s)
    return _matrix(pairs, found, mode, most_s)


def car_skim(links: DataFrame, times: DataFrame, pairs: DataFrame, free: str, depart_s: float, width: int, most_s: float) -> DataFrame:
    """By car for one departure, at the link times met on the way."""
    asks = pairs.groupBy("origin").agg(F.sort_array(F.collect_set("destination")).alias("destinations")).select(F.col("origin").alias("ask"), "origin", F.lit(depart_s).alias("depart_s"), "destinations")
    found = search.in_time(links, times, asks, free, width).select(F.col("ask").alias("origin"), "destination", (F.col("arrive_s") - depart_s).alias("seconds"))
    return _matrix(pairs, found, "car", most_s)


def transit_skim(pairs: DataFrame, access: DataFrame, egress: DataFrame, calls: DataFrame, walks: DataFrame, depart_s: int, rides: int, slack_s: int, most_s: float) -> DataFrame:
    """By transit for one departure: access (origin, stop, walk_s), the earliest arrivals at all stops, egress (destination, stop, walk_s). One search an origin."""
    starts = access.select(F.col("origin").alias("ask"), "stop", (F.lit(depart_s) + F.col("walk_s")).alias("at_s"))
    reached = transit.arrivals(starts, calls, walks, rides, slack_s).filter("rides > 0")
    there = reached.join(egress, "stop").groupBy(F.col("ask").alias("origin"), "destination").agg((F.min(F.col("t") + F.col("walk_s")) - depart_s).alias("seconds"))
    return _matrix(pairs, there, "transit", most_s)


def execute(chains: DataFrame, rides: DataFrame, calls: DataFrame, slack_s: int, most_rides: int) -> DataFrame:
    """(trip, rides_made, arrive_s, missed) of chains (trip, start_s, access_s, egress_s) with rides (trip, n from 0, line, board, alight) on calls as they came about.

    Ride by ride: the first run of the line that can be caught, the next one from where and when it is left. A chain that finds no run is missed, at the ride where that was.
    """
    state = chains.select("trip", (F.col("start_s") + F.col("access_s")).alias("t"), F.lit(0).cast("long").alias("made"), F.lit(False).alias("missed"))
    for n in range(most_rides):
        asks = state.filter("not missed").join(rides.filter(F.col("n") == n), "trip").select(F.col("trip").alias("ask"), "line", "board", "alight", F.col("t").alias("at_s"))
        took = transit.ride_line(asks, calls, slack_s).select(F.col("ask").alias("trip"), "arrive_s")
        wants = rides.filter(F.col("n") == n).select("trip", F.lit(True).alias("wants"))
        rows = state.join(wants, "trip", "left").join(took, "trip", "left")
        rode = F.col("arrive_s").isNotNull()
        state = rows.select("trip", F.coalesce("arrive_s", "t").alias("t"), (F.col("made") + rode.cast("long")).alias("made"), (F.col("missed") | (F.col("wants").isNotNull() & ~rode)).alias("missed"))
    return state.join(chains.select("trip", "egress_s"), "trip").select("trip", F.col("made").alias("rides_made"), F.when(~F.col("missed"), F.col("t") + F.col("egress_s")).alias("arrive_s"), "missed")


__all__ = ["car_skim", "execute", "layer_skim", "transit_skim"]
