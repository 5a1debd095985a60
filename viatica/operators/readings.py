"""Readings and small rules: waits, room, capacities, layer bins, disruption edges, outcomes, snapping to streets, room in route sets, step rules, draws and sums in a fixed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viatica.functions.lineage import shares
from viatica.operators.network import nearest_node

# Classes without motor traffic, and motorways, trunk roads and their ramps.
NO_MOTOR = ["busway", "pedestrian", "footway", "cycleway", "ferry"]
THROUGH = ["motorway", "motorway_link", "trunk", "trunk_link"]


def origin_wait_at(waits: DataFrame, asks: DataFrame, width: int = 900) -> DataFrame:
    """The mean wait before entering a link at its origin for a departure (ask, link, depart_s), 0 where nobody waited; waits (link, bin, pcu, wait_pcu_s)."""
    mean = waits.select("link", "bin", (F.col("wait_pcu_s") / F.col("pcu")).alias("w"))
    rows = asks.withColumn("bin", F.floor(F.col("depart_s") / width).cast("long")).join(mean, ["link", "bin"], "left")
    return rows.select("ask", F.round(F.coalesce("w", F.lit(0.0)), 6).alias("wait_s"))


def room_at(traversals: DataFrame, asks: DataFrame, storage: DataFrame) -> DataFrame:
    """Room on a link at a time (ask, link, at_s): its storage, plus what had left a wave's lag before, less all that has entered by then; storage (link, storage_pcu, lag_s).

    Both are as-of readings of running sums over one sort by link and time; what enters or leaves a link in one instant is summed before it is sorted.
    """
    own = asks.join(storage, "link")
    moves = traversals.select("link", F.col("enter_s").alias("t"), F.col("pcu").alias("ins"), F.lit(0).cast("long").alias("outs")).unionByName(traversals.select("link", F.col("exit_s").alias("t"), F.lit(0).cast("long").alias("ins"), F.col("pcu").alias("outs")))
    blank = F.lit(None).cast("long")
    events = moves.groupBy("link", "t").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs")).select("link", "t", F.lit(0).alias("kind"), "ins", "outs", blank.alias("ask"))
    reads = [own.select("link", t.alias("t"), F.lit(k).alias("kind"), F.lit(0).cast("long").alias("ins"), F.lit(0).cast("long").alias("outs"), "ask") for k, t in ((1, F.col("at_s")), (2, F.col("at_s") - F.col("lag_s")))]
    order = Window.partitionBy("link").orderBy("t", "kind", "ask").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.unionByName(reads[0]).unionByName(reads[1]).withColumns({"entered": F.sum("ins").over(order), "left": F.sum("outs").over(order)}).filter("kind > 0")
    both = rows.groupBy("ask").agg(F.max(F.when(F.col("kind") == 1, F.col("entered"))).alias("entered"), F.max(F.when(F.col("kind") == 2, F.col("left"))).alias("left"))
    return own.join(both, "ask").select("ask", (F.col("storage_pcu") + F.col("left") - F.col("entered")).alias("room_pcu"))


def passing_capacity(links: DataFrame, green: float = 0.48, factor: float = 1.0) -> DataFrame:
    """Capacity as it passes traffic: times the green share (1 at most) where a signal stops the link."""
    return links.select("link", F.round(F.when(F.col("signalised"), F.col("capacity") * min(1.0, green * factor)).otherwise(F.col("capacity")), 6).alias("passing"), F.col("signalised").alias("signal"))


def layer_bins(legs: DataFrame, links: DataFrame, end_s: int, width: int = 900) -> tuple[DataFrame, DataFrame]:
    """Travellers on foot or by bike through their links at fixed times: (bins, legs cut at the window's end).

    legs (trip, pos, link, start_s), links (link, seconds). A link counts where it is left, if that is before the end; a leg goes as far as the link it is on then.
    """
    order = Window.partitionBy("trip").orderBy("pos")
    rows = legs.join(links, "link").withColumn("exit_s", F.col("start_s") + F.sum("seconds").over(order)).withColumn("enter_s", F.col("exit_s") - F.col("seconds"))
    bins = rows.filter(F.col("exit_s") < end_s).groupBy(F.floor(F.col("exit_s") / width).cast("long").alias("bin"), "link").agg(F.count("*").alias("travellers"), F.sum("seconds").alias("seconds"))
    return bins, rows.filter(F.col("enter_s") < end_s).select("trip", "pos", "link", "enter_s")


def capacity_edges(disruptions: DataFrame) -> DataFrame:
    """(link, at_s, factor): where the product of the factors under way (link, from_s, to_s, factor) changes, a start or an end of one of them; closed links have 0.

    Every disruption of a link meets every edge of it, so a link's own disruptions are compared with each other, not with any other's.
    """
    edges = disruptions.select("link", F.explode(F.array("from_s", "to_s")).alias("at_s")).distinct()
    meets = edges.join(disruptions, "link")
    under = (F.col("from_s") <= F.col("at_s")) & (F.col("at_s") < F.col("to_s"))
    closed = F.max(F.when(under & (F.col("factor") == 0), 1).otherwise(0))
    product = F.exp(F.sum(F.when(under & (F.col("factor") > 0), F.ln("factor")).otherwise(0.0)))
    rows = meets.groupBy("link", "at_s").agg(F.when(closed == 1, 0.0).otherwise(F.round(product, 9)).alias("factor"))
    before = F.coalesce(F.lag("factor").over(Window.partitionBy("link").orderBy("at_s")), F.lit(1.0))
    return rows.withColumn("before", before).filter(F.col("factor") != F.col("before")).drop("before")


def closures(edges: DataFrame) -> DataFrame:
    """(link, from_s, to_s) of the times at which a link's capacity is 0; to_s is null if it is never opened again."""
    nxt = F.lead("at_s").over(Window.partitionBy("link").orderBy("at_s"))
    return edges.withColumn("to_s", nxt).filter("factor = 0").select("link", F.col("at_s").alias("from_s"), "to_s")


def trip_outcome(has_alternative: Column, mode_there: Column, has_vehicle: Column, has_path: Column, arrive_s: Column, end_s: Column) -> Column:
    """What became of a trip: the first thing it lacked, else whether it arrived by the end of the window."""
    return F.when(~has_alternative, "no_alternative").when(~mode_there, "mode_not_available").when(~has_vehicle, "no_vehicle_available").when(~has_path, "no_feasible_path").when(arrive_s <= end_s, "completed").otherwise("truncated")


def drivable(link_class: Column) -> Column:
    return ~link_class.isin(*NO_MOTOR)


def snap_trips(points: DataFrame, nodes: DataFrame, links: DataFrame, within: int, cell: int = 100) -> DataFrame:
    """(point, node): the nearest node that a car can use, if a street is there or it lies closer than `within`; else the nearest node with a street (not a motorway, trunk road or ramp).

    points (point, x, y), nodes (node, x, y), links (from_node, to_node, class). Without any street, the nearest node.
    """
    ends = links.filter(drivable(F.col("class"))).select(F.explode(F.array("from_node", "to_node")).alias("node"), F.col("class").isin(*THROUGH).alias("through"))
    kinds = ends.groupBy("node").agg(F.min("through").alias("only_through"))
    there = nodes.join(kinds, "node")
    any_ = nearest_node(points, there, cell).withColumnRenamed("node", "a").withColumnRenamed("d2", "da")
    street = nearest_node(points, there.filter("not only_through"), cell).withColumnRenamed("node", "b").drop("d2")
    rows = any_.join(kinds.withColumnRenamed("node", "a"), "a", "left").join(street, "point")
    own = ~F.coalesce("only_through", F.lit(False)) | (F.col("da") < within * within)
    return rows.select("point", F.when(own, F.col("a")).otherwise(F.coalesce("b", "a")).alias("node"))


def make_room(routes: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """Routes that leave a full set for new ones: of each set (pair) with more than `most` routes (pair, route, cost, people, kept) and new ones (pair, n_new) together, the dearest ones that nobody uses and that need not stay."""
    size = F.count("*").over(Window.partitionBy("pair"))
    free = (F.col("people") == 0) & ~F.col("kept")
    rank = F.row_number().over(Window.partitionBy("pair").orderBy(free.desc(), F.desc("cost"), F.desc("route")))
    rows = routes.join(found, "pair").withColumns({"excess": size + F.col("n_new") - most, "n": rank})
    return rows.filter(free & (F.col("n") <= F.col("excess"))).select("pair", "route")


def prune_reach(each: DataFrame, k: int) -> DataFrame:
    """Nodes worth riding to (trip, node): of parkings (trip, node, ride_s, best_s, worst_s), those no farther than the k-th nearest, or whose best estimate is no worse than the k-th worst one. All, if a trip has k or fewer."""
    w = Window.partitionBy("trip")
    near, worst = F.row_number().over(w.orderBy("ride_s")), F.row_number().over(w.orderBy("worst_s"))
    rows = each.withColumns({"i": near, "j": worst, "n": F.count("*").over(w)})
    limits = rows.withColumns({"near_k": F.max(F.when(F.col("i") == k, F.col("ride_s"))).over(w), "worst_k": F.max(F.when(F.col("j") == k, F.col("worst_s"))).over(w)})
    return limits.filter((F.col("n") <= k) | (F.col("ride_s") <= F.col("near_k")) | (F.col("best_s") <= F.col("worst_k"))).select("trip", "node").distinct()


def prune_reach_between(trips: DataFrame, nodes: DataFrame, on: Sequence[str], ride_s: Column, best_s: Column, worst_s: Column, k: int, most: int = 2_000_000) -> DataFrame:
    """What prune_reach returns for all pairs of trips (trip, ...) and nodes (node, ...) that are equal in `on`, without a pair being moved or written.

    ride_s, best_s and worst_s are expressions of a pair. A trip is one row, and so is a node within what it is equal in; copies of either count towards k. Trips are dealt out once and up to `most` nodes go to
    every task. Pairs are made anew in each of k turns, which find the next least value and how often the last one comes, and once more for the result; between turns there is a row a trip.
    """
    key = list(dict.fromkeys(["trip", *trips.columns]))
    here = nodes.groupBy(*nodes.columns).agg(F.count("*").alias("copies"))
    if here.limit(most + 1).count() > most:
        return prune_reach(trips.join(nodes, list(on)).select("trip", "node", ride_s.alias("ride_s"), best_s.alias("best_s"), worst_s.alias("worst_s")), k)
    shared, of = F.broadcast(here), {"near": ride_s, "worst": worst_s}
    counted = lambda when, pairs: F.coalesce(F.sum(F.when(when, pairs)), F.lit(0))
    each = trips.repartition(shares(trips, 50_000), "trip").groupBy(*key).agg(F.count("*").alias("times"))  # all turns stay in these tasks
    for turn in range(k):
        pairs = F.col("times") * F.col("copies")
        found = [F.sum(pairs).alias("n")] if turn == 0 else []
        for name, value in of.items():
            at = F.col(f"{name}_at")
            found += [F.min(value if turn == 0 else F.when(value > at, value)).alias(f"{name}_next"), (counted(value.isNotNull(), pairs) if turn == 0 else counted(value == at, pairs)).alias(f"{name}_new")]
        had = [] if turn == 0 else ["n", *[f"{name}_{x}" for name in of for x in ("at", "seen", "all")]]
        rows = each.join(shared, list(on)).groupBy(*key, "times", *had).agg(*found)
        own = [c for name in of for c in _least(name, turn, k)]
        each = rows.select(*key, "times", "n", *own)
    limit = {name: F.when(F.col(f"{name}_all") >= k, F.col(f"{name}_at")) for name in of}
    keep = (F.col("n") <= k) | (ride_s <= limit["near"]) | (best_s <= limit["worst"])
    return each.join(shared, list(on)).filter(keep).select("trip", "node")


def _least(name: str, turn: int, k: int) -> list[Column]:
    """How far a turn of prune_reach_between has come up the values of a trip: the one it is at, how many pairs there are below and at those before, and how many have a value."""
    new, nxt = F.col(f"{name}_new"), F.col(f"{name}_next")
    if turn == 0:
        return [nxt.alias(f"{name}_at"), F.lit(0).cast("long").alias(f"{name}_seen"), new.alias(f"{name}_all")]
    seen = F.col(f"{name}_seen") + new
    return [F.when(seen >= k, F.col(f"{name}_at")).otherwise(F.coalesce(nxt, F.col(f"{name}_at"))).alias(f"{name}_at"), seen.alias(f"{name}_seen"), F.col(f"{name}_all")]


def should_stop(reports: DataFrame, least: int, found_tolerance: float, switch_tolerance: float) -> DataFrame:
    """Adds whether the loop stops before each iteration (run, iteration from 0, found, switch_excess): after at least one and `least`, if the search found no more than a share and the mean switch excess of the three before is small."""
    before = Window.partitionBy("run").orderBy("iteration").rowsBetween(-3, -1)
    done = F.row_number().over(Window.partitionBy("run").orderBy("iteration")) - 1
    last = F.round(F.abs(F.avg("switch_excess").over(before)), 9)
    rows = reports.withColumns({"done": done.cast("long"), "last": last})
    return rows.withColumn("stops", F.coalesce((F.col("done") >= max(1, least)) & (F.col("found") <= found_tolerance) & (F.col("last") <= switch_tolerance), F.lit(False))).drop("last")


def rechoice_probability(iteration: Column, offset: int) -> Column:
    """1 in the first iteration, then 1 / (iteration + 1 + offset)."""
    return F.when(iteration == 0, 1.0).otherwise(1.0 / (iteration + 1 + offset))


def nested_logsum(rows: DataFrame, mu: float = 0.5) -> DataFrame:
    """The logsum of each situation (situation, nest, u): ln of the sum over nests of (sum of exp(u / mu)) to the mu, both sums shifted by their greatest terms."""
    nest = Window.partitionBy("situation", "nest")
    top = F.max(F.col("u") / mu).over(nest)
    inner = rows.withColumn("top", top).groupBy("situation", "nest").agg((mu * (F.ln(F.sum(F.exp(F.col("u") / mu - F.col("top")))) + F.first("top"))).alias("v"))
    most = F.max("v").over(Window.partitionBy("situation"))
    return inner.withColumn("most", most).groupBy("situation").agg(F.round(F.ln(F.sum(F.exp(F.col("v") - F.col("most")))) + F.first("most"), 6).alias("logsum"))


def cumulative_choice(rows: DataFrame, draw: Column) -> DataFrame:
    """The alternative in which a draw falls on a situation's cumulative probabilities (situation, alternative, p), the last if rounding leaves a rest."""
    order = Window.partitionBy("situation").orderBy("alternative")
    c = rows.withColumns({"c": F.round(F.sum("p").over(order), 9), "draw": draw, "last": F.max("alternative").over(Window.partitionBy("situation"))})
    return c.filter((F.col("c") > F.col("draw")) | (F.col("alternative") == F.col("last"))).groupBy("situation").agg(F.min("alternative").alias("alternative"))


def zone_cells(nodes: DataFrame, metres: float) -> tuple[DataFrame, DataFrame]:
    """Zones as cells of a grid from the least x and y of the nodes (node, x, y): (zone, x, y of the centre), and (node, zone). Zones are numbered by row and column among cells with nodes."""
    low = nodes.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    cells = nodes.crossJoin(F.broadcast(low)).select("node", "x0", "y0", F.floor((F.col("y") - F.col("y0")) / metres).alias("row"), F.floor((F.col("x") - F.col("x0")) / metres).alias("col"))  # one row
    used = cells.groupBy("row", "col").agg(F.first("x0").alias("x0"), F.first("y0").alias("y0"))
    by_row = used.groupBy("row").agg(F.count("*").alias("n"))
    start = by_row.withColumn("start", F.sum("n").over(Window.orderBy("row")) - F.col("n")).drop("n")  # one row a row of the grid
    numbered = used.join(F.broadcast(start), "row").withColumn("zone", (F.col("start") + F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1).cast("long"))
    zones = numbered.select("zone", (F.col("x0") + (F.col("col") + 0.5) * metres).alias("x"), (F.col("y0") + (F.col("row") + 0.5) * metres).alias("y"))
    return zones, cells.join(numbered.select("row", "col", "zone"), ["row", "col"]).select("node", "zone")


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One number for a table, whatever the order of its rows: the sum, modulo 2^61, of a number from each row's md5."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]).cast("binary"))
    return rows.agg((F.sum(F.conv(F.substring(digest, 1, 13), 16, 10).cast("decimal(38,0)")) % F.lit(2**61).cast("decimal(38,0)")).cast("long").alias("fingerprint"), F.count("*").alias("rows"))


def chunk_reduce(rows: DataFrame, key: str, value: str, chunk: int) -> DataFrame:
    """Sums of chunks of `chunk` rows by key from 0: the same whatever the partitioning, if the values are exact; (chunk, n, total)."""
    return rows.groupBy(F.floor(F.col(key) / chunk).cast("long").alias("chunk")).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(38,6)")).cast("decimal(38,6)").alias("total"))


def drawn_coefficients(betas: DataFrame, draws: DataFrame, seed: int, tau: float, time: str = "time_min") -> DataFrame:
    """(class, draw, attribute, beta): coefficients changed by up to the share tau either way, by a draw addressed by seed, class, draw and the attribute's place; draw 0 and time are left alone, and none changes its sign."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("class", "draw", "place")]).cast("binary"))
    u = 2 * ((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)) - 1
    changed = F.col("beta") * F.greatest(1 + tau * u, F.lit(0.0))
    return betas.join(draws, "class").select("class", "draw", "attribute", F.round(F.when((F.col("draw") == 0) | (F.col("attribute") == time), F.col("beta")).otherwise(changed), 9).alias("beta"))


def vehicle_times(trips: DataFrame) -> DataFrame:
    """Total and mean vehicle time of completed trips (weight, vehicle_s), by people."""
    done = trips.filter("outcome = 'completed' and vehicle_s is not null")
    return done.agg(F.coalesce(F.sum(F.col("weight") * F.col("vehicle_s")), F.lit(0)).cast("long").alias("total_vehicle_s"), F.round(F.sum(F.col("weight") * F.col("vehicle_s")) / F.sum("weight"), 6).alias("mean_vehicle_s"))


def boardings(rides: DataFrame, people: DataFrame) -> DataFrame:
    """(call, ons, offs): people boarding and alighting at each call, over the rides (trip, board_call, alight_call) of the chains that trips have chosen."""
    rows = rides.join(people, "trip")
    on = rows.select(F.col("board_call").alias("call"), F.col("weight").alias("ons"), F.lit(0).cast("long").alias("offs"))
    return on.unionByName(rows.select(F.col("alight_call").alias("call"), F.lit(0).cast("long").alias("ons"), F.col("weight").alias("offs"))).groupBy("call").agg(F.sum("ons").alias("ons"), F.sum("offs").alias("offs"))


def facility_edit(layer: DataFrame, edits: DataFrame) -> DataFrame:
    """A bike layer with other facilities on some links (link, facility), and its seconds anew: 18 km/h where separated, else 15."""
    rows = layer.join(edits.withColumnRenamed("facility", "new"), "link", "left").withColumn("facility", F.coalesce("new", "facility")).drop("new")
    return rows.withColumn("seconds", layer_seconds(F.col("length_m"), F.when(F.col("facility") == "separated", 18).otherwise(15)))


def layer_seconds(length_m: Column, km_h: Column) -> Column:
    return F.round(length_m * 3.6 / km_h, 6)


def step_of(second: Column, step_s: int) -> Column:
    """The number of the step that holds a second, also before midnight."""
    return F.floor(second / step_s).cast("long")


def fallback_car(trips: DataFrame, offered: DataFrame) -> DataFrame:
    """Trips without any alternative, which then go by car."""
    return trips.join(offered.select("trip").distinct(), "trip", "left_anti").withColumn("mode", F.lit("car"))
