"""Link loading: time-binned flows, trajectories, queues, cumulative curves and readings of link times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(second: Column | str, width: int) -> Column:
    c = F.col(second) if isinstance(second, str) else second
    return F.floor(c / width).cast("long")


def link_bins(traversals: DataFrame, width: int = 900) -> DataFrame:
    """Crossings, pcu and pcu-seconds of each link by the bin in which vehicles leave it."""
    return traversals.groupBy(bin_of("exit_s", width).alias("bin"), "link").agg(F.count("*").alias("crossings"), F.sum("pcu").alias("pcu"), F.sum(F.col("pcu") * (F.col("exit_s") - F.col("enter_s"))).alias("pcu_seconds"))


def entry_table(traversals: DataFrame, free_flow_s: int, width: int = 900) -> DataFrame:
    """Entrants of each link by entry bin, their time on it no less than free flow."""
    spent = F.greatest(F.col("exit_s") - F.col("enter_s"), F.lit(free_flow_s))
    return traversals.groupBy(bin_of("enter_s", width).alias("bin"), "link").agg(F.sum("pcu").alias("pcu"), F.sum(F.col("pcu") * spent).alias("pcu_seconds"))


def entrants(traversals: DataFrame, width: int = 900) -> DataFrame:
    """First and last vehicle to enter each link in each bin."""
    key = F.struct("enter_s", "vehicle", "pos")
    return traversals.groupBy(bin_of("enter_s", width).alias("bin"), "link").agg(F.min_by("vehicle", key).alias("first_vehicle"), F.max_by("vehicle", key).alias("last_vehicle"))


def link_table(bins: DataFrame, links: DataFrame, speed_m_s: int = 10) -> DataFrame:
    """Volume, mean seconds and delay of each link over all bins."""
    sums = bins.groupBy("link").agg(F.sum("pcu").alias("volume"), F.sum("pcu_seconds").alias("pcu_seconds"))
    mean = F.col("pcu_seconds") / F.col("volume")
    return links.join(sums, "link", "left").select("link", F.coalesce("volume", F.lit(0)).cast("long").alias("volume"), F.round(mean, 6).alias("mean_s"), F.round(F.greatest(mean - F.col("length_m") / speed_m_s, F.lit(0.0)), 6).alias("delay_s"))


def flow_summary(bins: DataFrame, links: DataFrame) -> DataFrame:
    """Vehicle kilometres, mean speed and the busiest link."""
    by_link = bins.groupBy("link").agg(F.sum("pcu").alias("pcu"), F.sum("pcu_seconds").alias("s")).join(links, "link")
    metres = F.sum(F.col("pcu") * F.col("length_m"))
    return by_link.agg((metres / 1000).alias("veh_km"), F.round(metres / F.sum("s") * 3.6, 6).alias("mean_km_h"), F.max_by("link", F.struct("pcu", -F.col("link"))).alias("busiest"))


def band(ratio: Column) -> Column:
    """Volume over capacity in five bands."""
    return F.when(ratio < 0.25, 0).when(ratio < 0.5, 1).when(ratio < 0.75, 2).when(ratio < 1.0, 3).otherwise(4).cast("long")


def busiest_window(bins: DataFrame, share: float = 0.25) -> DataFrame:
    """The run of consecutive bins around the peak that all have at least `share` of it."""
    by_bin = bins.groupBy("bin").agg(F.sum("pcu").alias("pcu"))
    top = by_bin.agg(F.max("pcu").alias("peak"), F.max_by("bin", F.struct("pcu", -F.col("bin"))).alias("at"))
    busy = by_bin.crossJoin(F.broadcast(top)).filter(F.col("pcu") >= F.col("peak") * share)  # one row
    island = busy.withColumn("g", F.col("bin") - F.row_number().over(Window.partitionBy("at").orderBy("bin")))
    runs = island.groupBy("g").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.first("at").alias("at"))
    return runs.filter("at between first_bin and last_bin").select("first_bin", "last_bin")


def rolling_peak(traversals: DataFrame, step: int = 60, window: int = 900) -> DataFrame:
    """Most pcu that leave a link within `window` consecutive seconds, by whole steps."""
    steps = traversals.groupBy("link", (F.floor(F.col("exit_s") / step) * step).cast("long").alias("at")).agg(F.sum("pcu").alias("pcu"))
    rolling = steps.withColumn("sum", F.sum("pcu").over(Window.partitionBy("link").orderBy("at").rangeBetween(-(window - step), 0)))
    return rolling.groupBy("link").agg(F.max("sum").alias("peak_pcu"))


def trajectories(routes: DataFrame, seconds: DataFrame) -> DataFrame:
    """Entry and exit of each link of a route, from its departure on, at the links' fixed seconds."""
    order = Window.partitionBy("vehicle").orderBy("pos")
    timed = routes.join(seconds, "link")
    until = F.sum("seconds").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return timed.select("vehicle", "pos", "link", (F.col("depart_s") + until - F.col("seconds")).alias("enter_s"), (F.col("depart_s") + until).alias("exit_s"))


def discharge(queue: DataFrame, headway_s: int = 2) -> DataFrame:
    """Exits from a link that discharges in order of arrival: exit = max(ready, exit before + headway per pcu).

    In closed form, with H the headways summed so far: exit_i = H_i + max over k <= i of (ready_k - H_k); all in two windows.
    """
    order = Window.partitionBy("link").orderBy("ready_s", "vehicle", "pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = queue.withColumn("h", F.sum(F.col("pcu") * headway_s).over(order))
    return summed.select("link", "vehicle", "pos", (F.col("h") - headway_s * F.col("pcu") + F.max(F.col("ready_s") - F.col("h") + headway_s * F.col("pcu")).over(order)).alias("exit_s"))


def steps_of(traversals: DataFrame) -> DataFrame:
    """+pcu at entry, -pcu at exit, summed by second."""
    up = traversals.select("link", F.col("enter_s").alias("at"), F.col("pcu").alias("change"))
    down = traversals.select("link", F.col("exit_s").alias("at"), (-F.col("pcu")).alias("change"))
    return up.unionByName(down).groupBy("link", "at").agg(F.sum("change").alias("change"))


def peak_occupancy(traversals: DataFrame) -> DataFrame:
    """Most pcu on a link at once."""
    on = steps_of(traversals).withColumn("pcu", F.sum("change").over(Window.partitionBy("link").orderBy("at")))
    return on.groupBy("link").agg(F.max("pcu").alias("peak_pcu"))


def curves_at(traversals: DataFrame, every: int = 600, start: int = 27000, end: int = 34800) -> DataFrame:
    """Cumulative pcu in and out of each link at regular instants: an as-of reading of running sums."""
    moves = traversals.select("link", F.col("enter_s").alias("at"), F.col("pcu").alias("inn"), F.lit(0).cast("long").alias("out")).unionByName(traversals.select("link", F.col("exit_s").alias("at"), F.lit(0).cast("long").alias("inn"), F.col("pcu").alias("out")))
    slot = F.greatest(F.lit(start), F.ceil(F.col("at") / every) * every).cast("long")
    slots = moves.groupBy("link", slot.alias("at")).agg(F.sum("inn").alias("inn"), F.sum("out").alias("out"))
    grid = traversals.select("link").distinct().select("link", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end).cast("long"), F.lit(every).cast("long"))).alias("at"))
    order = Window.partitionBy("link").orderBy("at")
    both = grid.join(slots, ["link", "at"], "left")
    return both.select("link", "at", F.coalesce(F.sum("inn").over(order), F.lit(0)).alias("n_up"), F.coalesce(F.sum("out").over(order), F.lit(0)).alias("n_down"))


def first_exit_after(traversals: DataFrame, at: int) -> DataFrame:
    return traversals.filter(F.col("exit_s") > at).groupBy("link").agg(F.min("exit_s").alias("first_exit_s"))


def carried_times(bins: DataFrame, width: int, free_flow_s: float) -> DataFrame:
    """Mean seconds of every link and bin between its first and last reading: a bin without one carries the last, less what has passed since, no less than free flow."""
    means = bins.select("link", "bin", (F.col("pcu_seconds") / F.col("pcu")).alias("m"))
    nxt = F.lead("bin").over(Window.partitionBy("link").orderBy("bin"))
    spans = means.withColumn("until", F.coalesce(nxt - 1, F.col("bin"))).select("link", "bin", "m", F.explode(F.sequence("bin", "until")).alias("b"))
    return spans.select("link", F.col("b").alias("bin"), F.round(F.greatest(F.col("m") - (F.col("b") - F.col("bin")) * width, F.lit(float(free_flow_s))), 6).alias("seconds"))


def fifo_exits(readings: DataFrame, width: int) -> DataFrame:
    """Exit times of a reading per bin start, made first-in first-out by a running maximum."""
    out = F.col("bin") * width + F.col("seconds")
    return readings.select("link", "bin", F.round(F.max(out).over(Window.partitionBy("link").orderBy("bin")), 6).alias("exit_s"))


def relative_change(before: DataFrame, now: DataFrame) -> DataFrame:
    """Sum of |change of pcu-seconds| over the sum now, by link and bin of either."""
    a = before.select("link", "bin", F.col("pcu_seconds").alias("x"))
    b = now.select("link", "bin", F.col("pcu_seconds").alias("y"))
    x, y = (F.coalesce(c, F.lit(0)) for c in ("x", "y"))
    both = a.join(b, ["link", "bin"], "full_outer")
    return both.agg(F.round(F.sum(F.abs(y - x)) / F.sum(y), 6).alias("change"))


def bpr(free_s: Column, flow: Column, capacity: Column, alpha: float = 0.15, beta: int = 4) -> Column:
    """Time on a link of this flow; closed links (no capacity) take for ever, which is null here."""
    return F.when(capacity > 0, free_s * (1 + alpha * F.pow(flow / capacity, F.lit(float(beta)))))


def propensity(traversals: DataFrame, capacity: int, width: int = 1800) -> DataFrame:
    """Peak half-hour load over capacity, 1 at most."""
    loads = traversals.groupBy("link", bin_of("enter_s", width).alias("bin")).agg(F.sum("pcu").alias("pcu"))
    return loads.groupBy("link").agg(F.round(F.least(F.max("pcu") / capacity, F.lit(1.0)), 6).alias("propensity"))


def spillback(traversals: DataFrame, links: DataFrame, excess: int = 5, metres_per_pcu: int = 7) -> DataFrame:
    """Links whose peak occupancy exceeds their storage."""
    room = F.floor(F.col("length_m") * F.col("lanes") / metres_per_pcu).cast("long")
    return peak_occupancy(traversals).join(links, "link").select("link", "peak_pcu", room.alias("storage_pcu"), (F.col("peak_pcu") - room).alias("excess_pcu")).filter(F.col("excess_pcu") >= excess)


def origin_wait(departures: DataFrame, width: int = 900) -> DataFrame:
    """Pcu-seconds waited before entering the network, by the departure's bin."""
    return departures.groupBy("link", bin_of("depart_s", width).alias("bin")).agg(F.sum("pcu").alias("pcu"), F.sum(F.col("pcu") * (F.col("enter_s") - F.col("depart_s"))).alias("wait_pcu_s"))
