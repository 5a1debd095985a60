"""Timetables: clock texts, calendars, frequencies, blank times, edits, as-of boarding, loads, patterns and journey search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viatica.functions.lineage import kept, spread
from viatica.operators.network import places_within

# First and last route_type of each kind.
KIND_RANGES = [
    ("tram", 0, 0),
    ("metro", 1, 1),
    ("rail", 2, 2),
    ("bus", 3, 3),
    ("ferry", 4, 4),
    ("tram", 5, 5),
    ("bus", 11, 11),
    ("metro", 12, 12),
    ("rail", 100, 199),
    ("bus", 200, 299),
    ("rail", 300, 399),
    ("metro", 400, 699),
    ("bus", 700, 899),
    ("tram", 900, 999),
    ("ferry", 1000, 1099),
    ("ferry", 1200, 1299),
]


def seconds_of(text: Column) -> Column:
    """HH:MM:SS with hours of 24 and more; null if it is no time."""
    part = lambda i: F.regexp_extract(text, "^ *([0-9]{1,3}):([0-9]{2}):([0-9]{2}) *$", i)
    good = text.rlike("^ *[0-9]{1,3}:[0-5][0-9]:[0-5][0-9] *$")
    return F.when(good, F.try_to_number(part(1), F.lit("999")).cast("long") * 3600 + part(2).cast("long") * 60 + part(3).cast("long"))


def kind_of(route_type: Column) -> Column:
    out = F.lit("other")
    for kind, a, b in KIND_RANGES:
        out = F.when(route_type.between(a, b), kind).otherwise(out)
    return out


def within(calls: DataFrame, start: int, end: int) -> DataFrame:
    """Calls inside the window; runs left with a single call go."""
    kept = calls.filter(F.col("arrive_s").between(start, end) & (F.col("depart_s") <= end))
    return kept.withColumn("n", F.count("*").over(Window.partitionBy("run"))).filter("n >= 2").drop("n")


def cancelled(calls: DataFrame, lines: list[int]) -> DataFrame:
    return calls.filter(~F.col("line").isin(*lines))


def with_headway(calls: DataFrame, line: int, headway_s: int) -> DataFrame:
    """The line's runs replaced by copies of its middle run, one every headway from its first to its last departure."""
    own = calls.filter(F.col("line") == line)
    starts = own.groupBy("run").agg(F.min("depart_s").alias("start"))
    ranked = starts.withColumns({"n": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("start", "run")), "all": F.count("*").over(Window.partitionBy(F.lit(0)))})
    span = starts.agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    middle = ranked.filter("n = (all + 1) div 2").select("run", "start")
    shape = own.join(middle, "run").select("line", "stop", "pos", (F.col("arrive_s") - F.col("start")).alias("a"), (F.col("depart_s") - F.col("start")).alias("d"))
    copies = span.select(F.explode(F.sequence("lo", "hi", F.lit(headway_s).cast("long"))).alias("start"), "lo").withColumn("i", F.expr(f"(start - lo) div {headway_s}"))
    new = copies.crossJoin(F.broadcast(shape)).select("line", (F.lit(100_000) + F.col("i")).cast("long").alias("run"), "stop", "pos", (F.col("start") + F.col("a")).alias("arrive_s"), (F.col("start") + F.col("d")).alias("depart_s"))  # one run's calls
    return calls.filter(F.col("line") != line).select("line", "run", "stop", "pos", "arrive_s", "depart_s").unionByName(new)


def filled_times(calls: DataFrame) -> DataFrame:
    """Blank times between two known ones, by position along the run (`at`)."""
    order = Window.partitionBy("run").orderBy("pos")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    known = lambda c: F.when(F.col("t").isNotNull(), F.col(c))
    t0, t1 = F.last(known("t"), ignorenulls=True).over(back), F.first(known("t"), ignorenulls=True).over(ahead)
    p0, p1 = F.last(known("at"), ignorenulls=True).over(back), F.first(known("at"), ignorenulls=True).over(ahead)
    rows = calls.withColumns({"t0": t0, "t1": t1, "p0": p0, "p1": p1})
    between = F.col("t0") + F.expr("(t1 - t0) * (at - p0) div nullif(p1 - p0, 0)")
    return rows.withColumn("filled", F.coalesce("t", between)).drop("t0", "t1", "p0", "p1")


def expanded(frequencies: DataFrame) -> DataFrame:
    """One row a run of (line, start_s, end_s, headway_s)."""
    return frequencies.filter("end_s > start_s").select("line", F.explode(F.sequence("start_s", F.col("end_s") - 1, "headway_s")).alias("start_s"))


def active(services: DataFrame, exceptions: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, service) that runs: by weekday within its dates, plus added and less removed days."""
    by_day = dates.join(F.broadcast(services), F.col("date").between(F.col("first"), F.col("last"))).filter(F.expr("substring(days, weekday(date) + 1, 1) = '1'")).select("date", "service")
    added, removed = exceptions.filter("type = 1").select("date", "service"), exceptions.filter("type = 2").select("date", "service")
    return by_day.join(removed, ["date", "service"], "left_anti").unionByName(added).distinct()


def next_runs(asks: DataFrame, calls: DataFrame, slot_s: int = 3600) -> DataFrame:
    """For each ask (ask, stop, at_s): the first departure no earlier, by line; the least run of a tie.

    An as-of join by one sort: asks and departures of a stop, line and hour from the latest to the earliest, and the last departure
    passed read off. Each hour also has the first departure after it, so a busy stop is split by hours.
    """
    lines = calls.select("stop", "line").distinct()
    slot = F.floor(F.col("t") / slot_s).alias("slot")
    dep = F.struct(F.col("t").alias("depart_s"), F.col("run"))
    left = asks.join(lines, "stop").select("stop", "line", F.col("at_s").alias("t"), F.lit(0).alias("kind"), "ask", F.lit(None).cast("long").alias("run")).select("*", slot)
    right = calls.select("stop", "line", F.col("depart_s").alias("t"), F.lit(1).alias("kind"), F.lit(None).alias("ask"), "run").select("*", slot)
    first = right.groupBy("stop", "line", "slot").agg(F.min(dep).alias("dep"))
    slots = left.select("stop", "line", "slot").distinct().join(first, ["stop", "line", "slot"], "full_outer")
    later = Window.partitionBy("stop", "line").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    after = slots.withColumn("dep", F.last("dep", ignorenulls=True).over(later)).filter("dep is not null")
    after = after.select("stop", "line", F.col("dep.depart_s").alias("t"), F.lit(1).alias("kind"), F.lit(None).alias("ask"), "dep.run", "slot")
    down = Window.partitionBy("stop", "line", "slot").orderBy(F.desc("t"), F.desc("kind"), F.desc("run")).rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.last(F.when(F.col("kind") == 1, dep), ignorenulls=True).over(down)
    return left.unionByName(right).unionByName(after).withColumn("x", nxt).filter("kind = 0").select("ask", "stop", "line", "x.depart_s", "x.run")


def loads(calls: DataFrame, moves: DataFrame) -> DataFrame:
    """People on board after each call: boardings less alightings (run, pos, ons, offs) so far."""
    m = moves.groupBy("run", "pos").agg(F.sum("ons").alias("ons"), F.sum("offs").alias("offs"))
    rows = calls.select("line", "run", "pos").join(m, ["run", "pos"], "left").fillna(0, ["ons", "offs"])
    return rows.withColumn("on_board", F.sum(F.col("ons") - F.col("offs")).over(Window.partitionBy("run").orderBy("pos")))


def line_summary(loads_: DataFrame) -> DataFrame:
    return loads_.groupBy("line").agg(F.sum("ons").alias("boardings"), F.max("on_board").alias("most_on_board"), F.countDistinct("run").alias("runs"))


def overtaken(calls: DataFrame) -> DataFrame:
    """Runs that reach a stop no later than an earlier run of their line did: they need a pattern of their own."""
    first = calls.groupBy("line", "run").agg(F.min("depart_s").alias("start"))
    rows = calls.join(first, ["line", "run"])
    before = F.max("arrive_s").over(Window.partitionBy("line", "stop").orderBy("start", "run").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).filter("arrive_s <= before").select("line", "run").distinct()


def footpaths(stops: DataFrame, most_m: int) -> DataFrame:
    """(a, b, d2): pairs of stops within a walk. Places are paired by grid cells of that size, then joined to the stops that stand there, which are spread over the tasks."""
    return _at_places(stops, stops, most_m).filter("a <> b").select("a", "b", "d2")


def _at_places(left: DataFrame, right: DataFrame, most_m: int) -> DataFrame:
    """(a, b, d2) of the pairs of two tables (stop, x, y) within `most_m`, without a sort: what is shuffled are places with what stands near them."""
    parts = spread(left)
    spots = kept(places_within(left, right, most_m))
    near = spots.join(right.select(F.col("stop").alias("b"), F.col("x").alias("ox"), F.col("y").alias("oy")), ["ox", "oy"]).select("x", "y", "b", "d2")
    return near.repartition(parts, "x", "y").join(left.select(F.col("stop").alias("a"), "x", "y").repartition(parts, "x", "y").hint("shuffle_hash"), ["x", "y"]).select("a", "b", "d2")


def pareto(journeys: DataFrame) -> DataFrame:
    """Journeys (ask, rides, arrive_s) that no other of the same ask beats with as few rides: earlier with every more."""
    best = journeys.groupBy("ask", "rides").agg(F.min("arrive_s").alias("arrive_s"))
    before = F.min("arrive_s").over(Window.partitionBy("ask").orderBy("rides").rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("before", before).filter("before is null or arrive_s < before").drop("before")


def arrivals(asks: DataFrame, calls: DataFrame, walks: DataFrame, rides: int, slack_s: int) -> DataFrame:
    """Earliest arrivals at stops with at most so many rides, (ask, stop, t, rides): RAPTOR's rounds as joins."""
    return _rounds(asks, calls, walks, rides, slack_s)[1]


def rounds(asks: DataFrame, calls: DataFrame, walks: DataFrame, rides: int, slack_s: int) -> DataFrame:
    """(ask, stop, t, rides): what each round improves, one row a stop and number of rides that gets there earlier than with fewer. asks (ask, stop, at_s) may have several stops."""
    return labels(asks, calls, walks, rides, slack_s).select("ask", "stop", "t", "rides")


def labels(asks: DataFrame, calls: DataFrame, walks: DataFrame, rides: int, slack_s: int) -> DataFrame:
    """As `rounds`, with the last ride of each: (run, board, alight), the stop where it is left being `stop` itself or one from which a walk leads there. No ride has none of these."""
    found = _rounds(asks, calls, walks, rides, slack_s)[0]
    out = found[0]
    for improved in found[1:]:
        out = out.unionByName(improved)
    return out


def _rounds(asks: DataFrame, calls: DataFrame, walks: DataFrame, rides: int, slack_s: int) -> tuple[list[DataFrame], DataFrame]:
    """What each round improves, from no ride on, and the earliest time at each stop in the end.

    Each round takes, for every stop improved in the one before and line, the first run that can be caught (as-of), follows it to its later
    stops, walks on, and keeps what is earlier than before; of equal times the least run, then boarding stop, then stop where it is left.
    """
    none = F.lit(None).cast("long")
    first = kept(asks.groupBy("ask", "stop").agg(F.min("at_s").alias("t")).select("ask", "stop", "t", F.lit(0).alias("rides"), none.alias("run"), none.alias("board"), none.alias("alight")))
    best, fresh, out = first.select("ask", "stop", "t", "rides"), first, [first]
    for n in range(1, rides + 1):
        at = (F.col("t") + (slack_s if n > 1 else 0)).alias("at_s")
        ready = fresh.select(F.concat_ws(":", "ask", "stop").alias("id"), "ask", "stop", at)
        caught = next_runs(ready.select(F.col("id").alias("ask"), "stop", "at_s"), calls).filter("run is not null")
        on = ready.join(caught.select(F.col("ask").alias("id"), "line", "run"), "id").join(calls.select("run", "stop", F.col("pos").alias("from_pos")), ["run", "stop"])
        later = on.select("ask", "run", F.col("stop").alias("board"), "from_pos").join(calls.select("run", F.col("stop").alias("to"), "pos", "arrive_s"), "run").filter("pos > from_pos")
        off = later.groupBy("ask", F.col("to").alias("stop")).agg(F.min(F.struct(F.col("arrive_s").alias("t"), "run", "board", F.col("to").alias("alight"))).alias("x"))
        walk = F.struct((F.col("x.t") + F.col("walk_s")).alias("t"), F.col("x.run").alias("run"), F.col("x.board").alias("board"), F.col("x.alight").alias("alight"))
        walked = off.join(walks.select(F.col("a").alias("stop"), "b", "walk_s"), "stop").select("ask", F.col("b").alias("stop"), walk.alias("x"))
        new = off.unionByName(walked).groupBy("ask", "stop").agg(F.min("x").alias("x"))
        had = best.select("ask", "stop", F.col("t").alias("had"))
        fresh = kept(new.join(had, ["ask", "stop"], "left").filter("had is null or x.t < had").select("ask", "stop", "x.t", F.lit(n).alias("rides"), "x.run", "x.board", "x.alight"))
        best = kept(best.unionByName(fresh.select("ask", "stop", "t", "rides")).groupBy("ask", "stop").agg(F.min(F.struct("t", "rides")).alias("x")).select("ask", "stop", "x.t", "x.rides"))
        out.append(fresh)
    return out, best


def shared_starts(asks: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ask, stop, at_s, source) of asks (ask, stop, at_s), and the sources as asks of their own, (ask, stop, at_s).

    Between two departures at a stop it makes no difference when one is there: who waits for the same next departure catches the same runs of all lines. So asks share the search from their stop at its next
    departure, and there are at most as many searches as calls, however many ask. The source is null where nothing departs any more.
    """
    moments = asks.select("stop", "at_s").distinct().withColumn("ask", F.concat_ws("@", "stop", "at_s"))
    slots = next_runs(moments, calls).groupBy("ask").agg(F.min("depart_s").alias("slot"))
    slotted = moments.join(slots, "ask").filter("slot is not null").select("stop", "at_s", "slot", F.concat_ws("@", "stop", "slot").alias("source"))
    own = kept(asks.join(slotted, ["stop", "at_s"], "left").select("ask", "stop", "at_s", "source"))
    sources = slotted.select(F.col("source").alias("ask"), "stop", F.col("slot").alias("at_s")).distinct()
    return own, sources


def shared_arrivals(asks: DataFrame, calls: DataFrame, walks: DataFrame, rides: int, slack_s: int) -> DataFrame:
    """As `arrivals`, of asks of one stop each, over shared searches."""
    own, sources = shared_starts(asks, calls)
    found = arrivals(sources, calls, walks, rides, slack_s).filter("rides > 0").withColumnRenamed("ask", "source")
    there = own.select("ask", "source").join(found, "source").select("ask", "stop", "t", "rides")
    return own.select("ask", "stop", F.col("at_s").alias("t"), F.lit(0).alias("rides")).unionByName(there)


def shared_journeys(starts: DataFrame, ends: DataFrame, calls: DataFrame, walks: DataFrame, rides: int, slack_s: int, most_walk_s: int) -> tuple[DataFrame, DataFrame]:
    """Pareto journeys (ask, rides, arrive_s, source, stop): an arrival by each number of rides that no arrival with fewer is as early as, and the labels of the shared searches they were found in.

    starts (ask, stop, at_s) and ends (ask, stop, walk_s, the walk on from a stop) may have several stops an ask. Of equal arrivals the least last stop counts, then the least source. A stop that an ask can
    start from no later than it is reached is no end of a ride.
    """
    own, sources = shared_starts(starts, calls)
    found = kept(labels(sources, calls, walks, rides, slack_s).withColumnRenamed("ask", "source"))
    asked = own.filter("source is not null").select("ask", "source").join(ends.filter(F.col("walk_s") <= most_walk_s), "ask")
    there = asked.join(found.filter("rides > 0").select("source", "stop", "t", "rides"), ["source", "stop"])
    there = there.join(own.select("ask", "stop", "at_s").groupBy("ask", "stop").agg(F.min("at_s").alias("at_s")), ["ask", "stop"], "left").filter("at_s is null or t < at_s")
    best = there.groupBy("ask", "rides").agg(F.min(F.struct((F.col("t") + F.col("walk_s")).alias("arrive_s"), "stop", "source")).alias("x")).select("ask", "rides", "x.*")
    before = F.min("arrive_s").over(Window.partitionBy("ask").orderBy("rides").rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("before", before).filter("before is null or arrive_s < before").drop("before"), found


def legs(journeys: DataFrame, found: DataFrame, calls: DataFrame, rides: int) -> DataFrame:
    """Journeys (ask, rides, source, stop) leg by leg: (ask, rides, leg from 1, line, run, board, alight, depart_s, arrive_s, walk_s on from there to the next leg or the last stop).

    A journey is unwound from its end: each label names the ride that led to it and where that was boarded, which is where the label with one ride less ends.
    """
    at = journeys.select("ask", "rides", "source", "stop", F.col("rides").alias("leg"))
    found = found.filter("rides > 0").select("source", "stop", F.col("rides").alias("leg"), "t", "run", "board", "alight")
    out = None
    for n in range(rides, 0, -1):
        own = at.filter(F.col("leg") == n).join(found, ["source", "stop", "leg"])
        taken = own.select("ask", "rides", "leg", "run", "board", "alight", "t")
        out = taken if out is None else out.unionByName(taken)
        at = kept(at.filter(F.col("leg") < n).unionByName(own.select("ask", "rides", "source", F.col("board").alias("stop"), (F.col("leg") - 1).alias("leg"))))
    on = calls.select("run", "line", F.col("stop").alias("board"), "depart_s")
    off = calls.select("run", F.col("stop").alias("alight"), "arrive_s")
    return out.join(on, ["run", "board"]).join(off, ["run", "alight"]).select("ask", "rides", "leg", "line", "run", "board", "alight", "depart_s", "arrive_s", (F.col("t") - F.col("arrive_s")).alias("walk_s"))


def ride_line(asks: DataFrame, calls: DataFrame, slack_s: int) -> DataFrame:
    """For each ask (ask, line, board, alight, at_s), to ride a line again: the first run that can be caught and its arrival, (ask, run, depart_s, arrive_s)."""
    boards = next_runs(asks.select("ask", F.col("board").alias("stop"), (F.col("at_s") + slack_s).alias("at_s")), calls)
    own = asks.select("ask", "line", "board", "alight").join(boards.filter("run is not null"), ["ask", "line"])
    on = own.join(calls.select("run", F.col("stop").alias("board"), F.col("pos").alias("from_pos")), ["run", "board"])
    off = on.join(calls.select("run", F.col("stop").alias("alight"), "pos", "arrive_s"), ["run", "alight"]).filter("pos > from_pos")
    return off.groupBy("ask").agg(F.min(F.struct("arrive_s", "run", "depart_s")).alias("x")).select("ask", "x.run", "x.depart_s", "x.arrive_s")


def stops_within(points: DataFrame, stops: DataFrame, most_m: int, metres_per_minute: int = 80) -> DataFrame:
    """Access or egress: (point, stop, walk_s) of the stops within a walk of points (point, x, y), by grid cells of that size."""
    near = _at_places(points.select(F.col("point").alias("stop"), "x", "y"), stops, most_m)
    walk = F.ceil(F.sqrt("d2") * 60 / metres_per_minute).cast("long")
    return near.select(F.col("a").alias("point"), F.col("b").alias("stop"), walk.alias("walk_s"))


def disrupted(runs: DataFrame, disruptions: DataFrame) -> DataFrame:
    """What becomes of runs (run, line, first departure start_s) under disruptions (line, from_s, to_s, delay_s, null for a cancellation): (run, cancelled, delay_s). A cancellation wins, delays add up."""
    hit = runs.join(disruptions, "line").filter((F.col("start_s") >= F.col("from_s")) & (F.col("start_s") < F.col("to_s")))
    return hit.groupBy("run").agg(F.max(F.col("delay_s").isNull()).alias("cancelled"), F.sum("delay_s").alias("d")).select("run", "cancelled", F.when(~F.col("cancelled"), F.col("d")).alias("delay_s"))


def with_disruptions(calls: DataFrame, effects: DataFrame) -> DataFrame:
    """calls without cancelled runs, and with delayed ones shifted."""
    rows = calls.join(effects, "run", "left").filter("cancelled is null or not cancelled")
    late = F.coalesce("delay_s", F.lit(0))
    return rows.select("line", "run", "stop", "pos", (F.col("arrive_s") + late).alias("arrive_s"), (F.col("depart_s") + late).alias("depart_s"))


def bus_summary(calls: DataFrame, arrivals_: DataFrame) -> DataFrame:
    """Runs on roads, those that arrived, and the mean delay at the last call: arrivals_ (run, pos, arrived_s) has null where a run did not get."""
    last = calls.groupBy("run").agg(F.max(F.struct("pos", "arrive_s")).alias("x")).select("run", "x.pos", F.col("x.arrive_s").alias("planned_s"))
    rows = last.join(arrivals_, ["run", "pos"], "left")
    return rows.agg(F.count("*").alias("runs_on_roads"), F.count("arrived_s").alias("runs_arrived"), F.round(F.avg(F.col("arrived_s") - F.col("planned_s")), 6).alias("delay_mean_s"))


def line_patterns(calls: DataFrame) -> DataFrame:
    """The different stop sequences of each line, and how many runs have them."""
    runs = calls.groupBy("line", "run").agg(F.sort_array(F.collect_list(F.struct("pos", "stop"))).alias("x"))
    text = F.array_join(F.transform("x", lambda c: c["stop"].cast("string")), " ")
    return runs.groupBy("line", text.alias("stops")).agg(F.count("*").alias("runs"))
