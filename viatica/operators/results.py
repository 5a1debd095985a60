"""Run results: completion, totals, key figures, mode shares, OD cells, parking tallies, select-link and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def completion(trips: DataFrame) -> DataFrame:
    n = lambda o: F.sum(F.when(F.col("outcome") == o, F.col("weight")).otherwise(0)).cast("long")
    return trips.agg(n("completed").alias("completed"), n("truncated").alias("truncated"), n("no_feasible_path").alias("no_feasible_path"), F.round(1 - n("completed") / F.sum("weight"), 6).alias("unfinished_share"))


def mode_totals(trips: DataFrame) -> DataFrame:
    done = F.when(F.col("outcome") == "completed", F.col("weight"))
    return trips.groupBy("mode").agg(F.count("*").alias("trips"), F.sum("weight").alias("people"), F.coalesce(F.sum(done), F.lit(0)).alias("completed"), F.round(F.sum(done * F.col("travel_time_s")) / F.sum(done), 6).alias("mean_s"))


def key_figures(trips: DataFrame) -> DataFrame:
    """Long rows (mode or all, metric, value) out of one pass with grouping sets."""
    done = F.when(F.col("outcome") == "completed", F.col("weight"))
    wide = trips.groupingSets([[], ["mode"]], "mode").agg(F.sum("weight").alias("people"), F.coalesce(F.sum(done), F.lit(0)).alias("completed"), F.sum(done * F.col("travel_time_s")).alias("total_s"), F.grouping("mode").alias("g"))
    values = {"people": F.col("people").cast("double"), "completed": F.col("completed").cast("double"), "mean_travel_time_s": F.round(F.col("total_s") / F.col("completed"), 6)}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()]))
    return wide.select(F.when(F.col("g") == 1, "all").otherwise(F.col("mode")).alias("mode"), rows.alias("x")).select("mode", "x.metric", "x.value")


def mode_share(trips: DataFrame, width: int = 900, least_percent: int = 1) -> DataFrame:
    """Shares of people by departure bin; bins with under one percent of the fullest bin's people are left out."""
    counts = trips.groupBy(F.floor(F.col("departure_s") / width).cast("long").alias("bin"), "mode").agg(F.sum("weight").alias("people"))
    total = F.sum("people").over(Window.partitionBy("bin"))
    counts = counts.withColumn("total", total)
    top = counts.agg(F.max("total").alias("top"))
    return counts.crossJoin(F.broadcast(top)).filter(F.col("total") * 100 >= F.col("top") * least_percent).select("bin", "mode", F.round(F.col("people") / F.col("total"), 6).alias("share"))  # top is one row


def od_cells(trips: DataFrame) -> DataFrame:
    return trips.groupBy("o_zone", "d_zone").agg(F.count("*").alias("trips"), F.sum("weight").alias("people"), (F.first("o_zone") == F.first("d_zone")).alias("inside"))


def parking_tally(events: DataFrame, parkings: DataFrame, start: int, end: int, width: int) -> DataFrame:
    """Per parking and bin: arrivals, departures, vehicle-seconds present, most present, seconds full.

    Stays become steps of +1 and -1; a running sum gives the number present between steps, and each constant stretch is
    cut at bin ends, so a stretch counts in every bin it touches.
    """
    steps = events.select("parking", F.col("arrive_s").alias("at"), F.lit(1).alias("change")).unionByName(events.select("parking", F.col("leave_s").alias("at"), F.lit(-1).alias("change")))
    steps = steps.groupBy("parking", "at").agg(F.sum("change").alias("change"), F.sum(F.when(F.col("change") > 0, 1).otherwise(0)).alias("ins"), F.sum(F.when(F.col("change") < 0, 1).otherwise(0)).alias("outs"))
    order = Window.partitionBy("parking").orderBy("at")
    held = steps.withColumn("present", F.sum("change").over(order)).withColumn("until", F.coalesce(F.lead("at").over(order), F.lit(end)))
    a, b = F.greatest(F.col("at"), F.lit(start)), F.least(F.col("until"), F.lit(end))
    stretch = held.withColumns({"a": a, "b": b}).filter("b > a").join(parkings.select("parking", "capacity"), "parking")
    cut = stretch.withColumn("bin", F.explode(F.sequence(F.floor((F.col("a") - start) / width), F.floor((F.col("b") - 1 - start) / width))))
    s = F.least(F.col("b"), F.lit(start) + (F.col("bin") + 1) * width) - F.greatest(F.col("a"), F.lit(start) + F.col("bin") * width)
    here = F.floor((F.col("at") - start) / width) == F.col("bin")
    inside = (F.col("at") >= start) & here
    return cut.withColumn("s", s).groupBy("parking", "bin").agg(
        F.sum(F.when(inside, F.col("ins")).otherwise(0)).alias("arrivals"),
        F.sum(F.when(inside, F.col("outs")).otherwise(0)).alias("departures"),
        F.sum(F.col("present") * F.col("s")).alias("vehicle_s"),
        F.max("present").alias("most"),
        F.sum(F.when(F.col("present") >= F.col("capacity"), F.col("s")).otherwise(0)).alias("full_s"),
    )


def availability(full_s: Column, width: int) -> Column:
    return 1 - full_s / width


def parking_seconds(available: Column, walk_s: Column, slope: float) -> Column:
    """Time to park: the walk, plus more the likelier the parking is full."""
    return walk_s + slope * (1 - available)


def running_mean(values: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The average over iterations so far."""
    return values.withColumn("mean", F.round(F.avg(value).over(Window.partitionBy(key).orderBy(order)), 6))


def select_link(routes: DataFrame, users: DataFrame, links: list[int]) -> DataFrame:
    """OD pairs of those who use one of the links: people, their share of all on the links, and of all of their pair."""
    crossing = routes.filter(F.col("link").isin(*links)).select("trip").distinct()
    on = users.join(crossing, "trip", "left_semi").groupBy("o_zone", "d_zone").agg(F.sum("weight").alias("people"))
    pair = users.groupBy("o_zone", "d_zone").agg(F.sum("weight").alias("pair_people"))
    all_ = F.sum("people").over(Window.partitionBy(F.lit(0)))
    return on.join(pair, ["o_zone", "d_zone"]).select("o_zone", "d_zone", "people", F.round(F.col("people") / all_, 6).alias("share_link"), F.round(F.col("people") / F.col("pair_people"), 6).alias("share_pair"))


def every_nth(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """A deterministic sample: rows 0, n, 2n, ... of each group in order."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).filter(F.col("r") % n == 0).drop("r")


def clock(second: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", (second / 3600).cast("long"), (second % 3600 / 60).cast("long"), second % 60)


def fare(base: float, per_km: float, per_transfer: float, metres: Column, transfers: Column, has_pass: Column) -> Column:
    return F.when(has_pass, 0.0).otherwise(base + per_km * metres / 1000 + per_transfer * transfers)


def interval_seconds(rows: DataFrame, width: int, *by: str) -> DataFrame:
    """Seconds of intervals (start_s, end_s) in each bin they touch."""
    bins = F.sequence(F.floor(F.col("start_s") / width), F.floor((F.col("end_s") - 1) / width))
    cut = rows.filter("end_s > start_s").withColumn("bin", F.explode(bins))
    s = F.least(F.col("end_s"), (F.col("bin") + 1) * width) - F.greatest(F.col("start_s"), F.col("bin") * width)
    return cut.withColumn("s", s).groupBy(*by, "bin").agg(F.sum("s").alias("seconds"))


def weighted_percentile(rows: DataFrame, value: str, weight: str, share: float) -> DataFrame:
    """The least value at which the running weight reaches the share of all. Values are summed first, so the window runs over different values."""
    sums = rows.groupBy(F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    c = sums.select("v", F.sum("w").over(Window.orderBy("v")).alias("c"), F.sum("w").over(Window.partitionBy(F.lit(0))).alias("t"))
    return c.filter(F.col("c") >= F.col("t") * share).agg(F.min("v").alias("value"))
