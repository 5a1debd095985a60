"""Itineraries: alternatives by car, taxi, bike, foot, transit, park-and-ride and shared bike, their costs, identities and legs.

Every alternative is one row (trip, mode, alternative, seconds by part, total_s), so a trip's choice set is a union. Searches are not
in here: car routes come with their seconds, transit times from `transit.rounds`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = ["walk_s", "wait_s", "vehicle_s", "parking_s", "ride_s", "vehicle_m"]
COLUMNS = ["trip", "mode", "alternative", *PARTS, "total_s"]


def alternative(rows: DataFrame, mode: str, **parts: Column) -> DataFrame:
    """Rows (trip, alternative) as alternatives of a mode: parts not named are zero; the total is of all parts that are seconds."""
    filled = {p: parts.get(p, F.lit(0)).cast("long") for p in PARTS}
    total = sum((filled[p] for p in PARTS if p.endswith("_s")), F.lit(0).cast("long"))
    return rows.select("trip", F.lit(mode).alias("mode"), F.col("alternative").cast("long").alias("alternative"), *[c.alias(p) for p, c in filled.items()], total.alias("total_s"))


def car(trips: DataFrame, routes: DataFrame, access_s: int, egress_s: int, most: int) -> DataFrame:
    """The `most` fastest routes (pair, route, seconds, metres) of each trip's pair, the earlier first among equals; reaching the car is walking, leaving it parking."""
    rank = F.row_number().over(Window.partitionBy("trip").orderBy("seconds", "route"))
    own = trips.select("trip", "pair").join(routes, "pair").withColumn("n", rank).filter(F.col("n") <= most).withColumn("alternative", F.col("route"))
    return alternative(own, "car", walk_s=F.lit(access_s), vehicle_s=F.col("seconds"), parking_s=F.lit(egress_s), vehicle_m=F.col("metres"))


def offered_path_sizes(offered: DataFrame, route_links: DataFrame, lengths: DataFrame) -> DataFrame:
    """ln of the path size of each route (trip, pair, route), by length and over the routes offered to the trip alone."""
    links = offered.select("trip", "pair", "route").join(route_links.select("pair", "route", "link").distinct(), ["pair", "route"]).join(lengths.select("link", "length_m"), "link")
    users = F.count("*").over(Window.partitionBy("trip", "link"))
    return links.withColumn("users", users).groupBy("trip", "route").agg(F.round(F.ln(F.greatest(F.sum(F.col("length_m") / F.col("users")) / F.sum("length_m"), F.lit(1e-9))), 6).alias("ln_path_size"))


def taxi(trips: DataFrame, routes: DataFrame, wait_s: int, boarding_s: int) -> DataFrame:
    """The fastest of its pair's routes, the earlier of equals, after the wait and boarding that are assumed."""
    best = routes.groupBy("pair").agg(F.min(F.struct("seconds", "route", "metres")).alias("r"))
    own = trips.select("trip", "pair").join(best, "pair").withColumn("alternative", F.lit(0))
    return alternative(own, "taxi", wait_s=F.lit(wait_s), parking_s=F.lit(boarding_s), vehicle_s=F.col("r.seconds"), vehicle_m=F.col("r.metres"))


def direct(legs: DataFrame, mode: str, most_s: int, access_s: int = 0, egress_s: int = 0) -> DataFrame:
    """One leg (trip, seconds, metres) by bike or on foot, if it takes no longer than `most_s`: a bike is reached before and parked after, a walk is neither."""
    own = legs.filter(F.col("seconds") <= most_s).withColumn("alternative", F.lit(0))
    if mode == "walk":
        return alternative(own, mode, walk_s=F.col("seconds"), vehicle_m=F.col("metres"))
    return alternative(own, mode, walk_s=F.lit(access_s), vehicle_s=F.col("seconds"), parking_s=F.lit(egress_s), vehicle_m=F.col("metres"))


def journeys(rounds: DataFrame, egress: DataFrame, most_walk_s: int) -> DataFrame:
    """(ask, rides, arrive_s): Pareto journeys, an arrival by each number of rides that no arrival with fewer is as early as; the last walk is of `most_walk_s` at most.

    rounds (ask, stop, rides, t): arrivals at stops; egress (ask, stop, walk_s): walks on to the destination.
    """
    there = rounds.filter("rides > 0").join(egress.filter(F.col("walk_s") <= most_walk_s), ["ask", "stop"]).groupBy("ask", "rides").agg(F.min(F.col("t") + F.col("walk_s")).alias("arrive_s"))
    before = F.min("arrive_s").over(Window.partitionBy("ask").orderBy("rides").rowsBetween(Window.unboundedPreceding, -1))
    return there.withColumn("before", before).filter("before is null or arrive_s < before").drop("before")


def transit(trips: DataFrame, found: DataFrame) -> DataFrame:
    """Trips (trip, ask, depart_s) by each Pareto journey of their ask: the number of rides less one is the alternative's number, all of it is riding and waiting."""
    own = trips.select("trip", "ask", "depart_s").join(found, "ask").withColumn("alternative", F.col("rides") - 1)
    return alternative(own, "transit", ride_s=F.col("arrive_s") - F.col("depart_s"))


def candidate_parkings(trips: DataFrame, parkings: DataFrame, k: int) -> DataFrame:
    """(trip, place): the k places (place, drive_s, rest_s by trip) with the least drive, and the k with the least drive and rest; the lower place of equals."""
    own = trips.join(parkings, "trip")
    w = Window.partitionBy("trip")
    a = F.row_number().over(w.orderBy("drive_s", "place"))
    b = F.row_number().over(w.orderBy(F.col("drive_s") + F.col("rest_s"), "place"))
    return own.withColumns({"a": a, "b": b}).filter((F.col("a") <= k) | (F.col("b") <= k)).drop("a", "b")


def ride_out(candidates: DataFrame, found: DataFrame, mode: str, parking_s: int) -> DataFrame:
    """Park-and-ride or bike-and-ride out: drive to the place, park, and go on by the earliest of its Pareto journeys (ask, arrive_s), the ask being of trip and place.

    candidates (trip, place, ask, depart_s, drive_s, drive_m).
    """
    best = found.groupBy("ask").agg(F.min("arrive_s").alias("arrive_s"))
    own = candidates.join(best, "ask").withColumn("alternative", F.col("place"))
    return alternative(own, mode, vehicle_s=F.col("drive_s"), vehicle_m=F.col("drive_m"), parking_s=F.lit(parking_s), ride_s=F.col("arrive_s") - F.col("depart_s") - F.col("drive_s") - parking_s)


def ride_back(candidates: DataFrame, found: DataFrame, mode: str, fetch_s: int) -> DataFrame:
    """And back: the earliest journey to the place where the vehicle stands (ask, arrive_s), fetching it, and the drive home."""
    best = found.groupBy("ask").agg(F.min("arrive_s").alias("arrive_s"))
    own = candidates.join(best, "ask").withColumn("alternative", F.col("place"))
    return alternative(own, mode, ride_s=F.col("arrive_s") - F.col("depart_s"), parking_s=F.lit(fetch_s), vehicle_s=F.col("drive_s"), vehicle_m=F.col("drive_m"))


def near_docks(docks: DataFrame, most: int, *key: str) -> DataFrame:
    """The `most` docks nearest each end (docks: key, dock, walk_s, ...), lower ones of equals."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy("walk_s", "dock"))
    return docks.withColumn("n", n).filter(F.col("n") <= most).drop("n")


def dock_pairs(origin_docks: DataFrame, destination_docks: DataFrame, k: int, crow_m_s: int = 4) -> DataFrame:
    """(trip, pickup, back, ...): of the 3 k docks nearest each end of a trip (trip, dock, walk_s, x, y), the k pairs of different docks with the least walks and crow's flight; lower docks of equals."""

    def near(docks: DataFrame, name: str) -> DataFrame:
        return near_docks(docks, 3 * k, "trip").select("trip", F.col("dock").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("walk_s", "x", "y")])

    pairs = near(origin_docks, "pickup").join(near(destination_docks, "back"), "trip").filter("pickup <> back")  # at most 9 k^2 a trip
    crow = F.sqrt(F.pow(F.col("pickup_x") - F.col("back_x"), F.lit(2.0)) + F.pow(F.col("pickup_y") - F.col("back_y"), F.lit(2.0)))
    rows = pairs.withColumn("crow_m", crow).withColumn("guess", F.round(F.col("pickup_walk_s") + F.col("back_walk_s") + F.col("crow_m") / crow_m_s, 6))
    rank = F.row_number().over(Window.partitionBy("trip").orderBy("guess", "pickup", "back"))
    return rows.withColumn("n", rank).filter(F.col("n") <= k)


def shared_bike(pairs: DataFrame, pickup_s: int, return_s: int, mode: str = "bike_share") -> DataFrame:
    """Dock pairs (trip, pickup_walk_s, back_walk_s, ride_s, metres, extra_s at the docks, n) as alternatives."""
    own = pairs.withColumn("alternative", F.col("n") - 1)
    return alternative(own, mode, walk_s=F.col("pickup_walk_s") + F.col("back_walk_s") + F.col("extra_s"), parking_s=F.lit(pickup_s + return_s), vehicle_s=F.col("ride_s"), vehicle_m=F.col("metres"))


def shared_bike_to_transit(candidates: DataFrame, found: DataFrame, pickup_s: int, return_s: int) -> DataFrame:
    """A shared bike to a dock by a stop (trip, place, ask, depart_s, walk_s, bike_s, metres), and transit from there."""
    best = found.groupBy("ask").agg(F.min("arrive_s").alias("arrive_s"))
    own = candidates.join(best, "ask").withColumn("alternative", F.col("place"))
    before = F.col("walk_s") + F.col("bike_s") + pickup_s + return_s
    return alternative(own, "bike_share_transit", walk_s=F.col("walk_s"), vehicle_s=F.col("bike_s"), parking_s=F.lit(pickup_s + return_s), vehicle_m=F.col("metres"), ride_s=F.col("arrive_s") - F.col("depart_s") - before)


def kilometres_by_facility(legs: DataFrame, links: DataFrame, facilities: list[str]) -> DataFrame:
    """Kilometres of each alternative's bike leg (trip, alternative, link) on each kind of facility (link, length_m, facility)."""
    km = lambda f: F.round(F.coalesce(F.sum(F.when(F.col("facility") == f, F.col("length_m"))), F.lit(0)) / 1000, 6).alias(f"km_{f}")
    return legs.join(links, "link").groupBy("trip", "alternative").agg(*[km(f) for f in facilities])


def costs(alternatives: DataFrame, passes: DataFrame, prices: Mapping[str, float]) -> DataFrame:
    """running, toll, parking and fare of each alternative, and their sum.

    A car or bike runs by the metre; only a car pays a toll (toll_eur); who parks a car on the way or arrives by car pays parking_eur; a pass holder
    (passes: trip) pays no fare on transit, but pays for taxis and shared bikes like anyone.
    """
    mode, km = F.col("mode"), F.col("vehicle_m") / 1000
    by_car, shared = mode.isin("car", "car_transit"), mode.isin("bike_share", "bike_share_transit")
    fare = F.when(F.col("rides") > 0, prices["fare_base"] + prices["fare_ride"] * (F.col("rides") - 1)).otherwise(0.0)
    rent = F.when(shared, prices["share_base"] + prices["share_min"] * F.col("vehicle_s") / 60).otherwise(0.0)
    rows = alternatives.join(passes.select("trip").distinct().withColumn("holds", F.lit(True)), "trip", "left")
    paid = F.when(mode == "taxi", prices["taxi_base"] + prices["taxi_km"] * km).when(F.col("holds").isNull(), rent + fare).otherwise(rent)
    rows = rows.withColumns({
        "running": F.when(by_car, prices["car_km"] * km).when(mode.isin("bike", "bike_transit"), prices["bike_km"] * km).otherwise(0.0),
        "toll": F.when(by_car, F.col("toll_eur")).otherwise(0.0),
        "parking": F.when(by_car, F.col("parking_eur")).otherwise(0.0),
        "fare": paid,
    })
    names = ["running", "toll", "parking", "fare"]
    return rows.select("trip", "mode", "alternative", *[F.round(n, 6).alias(n) for n in names], F.round(sum((F.col(n) for n in names), F.lit(0.0)), 6).alias("cost_eur"))


def identity(mode: Column, place: Column, links: Column) -> Column:
    """A number that tells itineraries apart by what they are, not by their ids: 13 hexadecimal digits of an md5 over mode, place and links in order."""
    text = F.concat_ws("|", mode, F.coalesce(place.cast("string"), F.lit("")), F.array_join(F.transform(links, lambda x: x.cast("string")), ","))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def chains(legs: DataFrame) -> DataFrame:
    """Legs (trip, alternative, n, mode, seconds, metres) as one row a chain: its legs in order, its totals, and its mode: that of its longest leg in metres that is no walk, the first of equals, or walk."""
    leg = F.struct("n", F.col("mode").alias("leg_mode"), "seconds", "metres")
    main = F.max(F.when(F.col("mode") != "walk", F.struct(F.col("metres"), (-F.col("n")).alias("n"), "mode")))
    return legs.groupBy("trip", "alternative").agg(F.sort_array(F.collect_list(leg)).alias("legs"), F.sum("seconds").alias("total_s"), F.sum("metres").alias("total_m"), main.alias("m")).withColumn("mode", F.coalesce("m.mode", F.lit("walk"))).drop("m")


def ride_path_sizes(rides: DataFrame, totals: DataFrame) -> DataFrame:
    """ln of the path size of chains by shared rides: the seconds of each ride (situation, alternative, line, board, alight, seconds) over the chains with that ride, and all other seconds in full, over the chain's total."""
    own = rides.withColumn("users", F.size(F.collect_set("alternative").over(Window.partitionBy("situation", "line", "board", "alight"))))
    sums = own.groupBy("situation", "alternative").agg(F.sum(F.col("seconds") / F.col("users")).alias("size"), F.sum("seconds").alias("shared"))
    all_ = totals.join(sums, ["situation", "alternative"], "left").fillna(0, ["size", "shared"])
    total = F.greatest(F.col("total_s"), F.lit(1))
    share = (F.col("size") + F.greatest(total - F.col("shared"), F.lit(0))) / total
    return all_.select("situation", "alternative", F.round(F.ln(F.least(F.greatest(share, F.lit(1e-9)), F.lit(1.0))), 6).alias("ln_path_size"))


def left_out_modes(offered: DataFrame, found: DataFrame) -> DataFrame:
    """How many trips were offered a mode (trip, mode) and have no chain of it, by mode."""
    return offered.select("trip", "mode").distinct().join(found.select("trip", "mode").distinct(), ["trip", "mode"], "left_anti").groupBy("mode").agg(F.count("*").alias("trips"))
