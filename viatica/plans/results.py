"""Queries on run results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from viatica.operators import results as op
from viatica.plans.registry import query


@query(
    """SELECT CAST(sum(CASE WHEN outcome = 'completed' THEN weight ELSE 0 END) AS BIGINT) AS completed, CAST(sum(CASE WHEN outcome = 'truncated' THEN weight ELSE 0 END) AS BIGINT) AS truncated,
CAST(sum(CASE WHEN outcome = 'no_feasible_path' THEN weight ELSE 0 END) AS BIGINT) AS no_feasible_path, round(1 - CAST(sum(CASE WHEN outcome = 'completed' THEN weight ELSE 0 END) AS DOUBLE) / CAST(sum(weight) AS DOUBLE), 6) AS unfinished_share FROM v_trip_results""",
    "v_trip_results",
)
def completion_counts(trips):
    return op.completion(trips)


@query(
    """SELECT mode, CAST(count(*) AS BIGINT) AS trips, CAST(sum(weight) AS BIGINT) AS people, CAST(coalesce(sum(weight) FILTER (WHERE outcome = 'completed'), 0) AS BIGINT) AS completed,
round(CAST(sum(weight * travel_time_s) AS DOUBLE) / CAST(sum(weight) FILTER (WHERE outcome = 'completed') AS DOUBLE), 6) AS mean_s FROM v_trip_results GROUP BY 1""",
    "v_trip_results",
)
def totals_per_mode(trips):
    return op.mode_totals(trips)


@query(
    """WITH w AS (SELECT coalesce(mode, 'all') AS mode, CAST(sum(weight) AS DOUBLE) AS p, CAST(coalesce(sum(weight) FILTER (WHERE outcome = 'completed'), 0) AS DOUBLE) AS c, CAST(sum(weight * travel_time_s) AS DOUBLE) AS t FROM v_trip_results GROUP BY GROUPING SETS ((), (mode)))
SELECT mode, 'people' AS metric, p AS value FROM w UNION ALL SELECT mode, 'completed', c FROM w UNION ALL SELECT mode, 'mean_travel_time_s', round(t / c, 6) FROM w""",
    "v_trip_results",
)
def kpis(trips):
    return op.key_figures(trips)


@query(
    """WITH c AS (SELECT departure_s // 900 AS bin, mode, sum(weight) AS p FROM v_trip_results GROUP BY 1, 2), t AS (SELECT *, sum(p) OVER (PARTITION BY bin) AS t FROM c)
SELECT bin, mode, round(CAST(p AS DOUBLE) / CAST(t AS DOUBLE), 6) AS share FROM t WHERE t * 100 >= (SELECT max(t) FROM t)""",
    "v_trip_results",
)
def mode_share_by_bin(trips):
    return op.mode_share(trips)


@query("SELECT o_zone, d_zone, CAST(count(*) AS BIGINT) AS trips, CAST(sum(weight) AS BIGINT) AS people, o_zone = d_zone AS inside FROM v_trip_results GROUP BY 1, 2", "v_trip_results")
def od_cells(trips):
    return op.od_cells(trips)


TALLY = """e AS (SELECT parking, arrive_s AS t, 1 AS c FROM v_parking_events UNION ALL SELECT parking, leave_s, -1 FROM v_parking_events),
s AS (SELECT parking, t, sum(c) AS c, sum(CASE WHEN c > 0 THEN 1 ELSE 0 END) AS ins, sum(CASE WHEN c < 0 THEN 1 ELSE 0 END) AS outs FROM e GROUP BY 1, 2),
h AS (SELECT parking, t, ins, outs, sum(c) OVER w AS n, coalesce(lead(t) OVER w, 36000) AS u FROM s WINDOW w AS (PARTITION BY parking ORDER BY t)),
b AS (SELECT range AS bin, 27000 + 900 * range AS lo, 27900 + 900 * range AS hi FROM range(10)),
x AS (SELECT h.parking, bin, ins, outs, n, capacity, least(u, hi, 36000) - greatest(t, lo) AS s, t >= lo AND t < hi AS here FROM h JOIN b ON t < hi AND u > lo JOIN v_parkings p ON p.parking = h.parking),
tl AS (SELECT parking, bin, CAST(sum(CASE WHEN here THEN ins ELSE 0 END) AS BIGINT) AS arrivals, CAST(sum(CASE WHEN here THEN outs ELSE 0 END) AS BIGINT) AS departures, CAST(sum(n * s) AS BIGINT) AS vehicle_s, CAST(max(n) AS BIGINT) AS most,
 CAST(sum(CASE WHEN n >= capacity THEN s ELSE 0 END) AS BIGINT) AS full_s FROM x WHERE s > 0 GROUP BY 1, 2)"""


def _tally(events, parkings):
    return op.parking_tally(events, parkings, 27000, 36000, 900)


@query(f"WITH {TALLY} SELECT * FROM tl", "v_parking_events", "v_parkings")
def parking_bins(events, parkings):
    return _tally(events, parkings)


@query(f"WITH {TALLY} SELECT parking, bin, round(1 - CAST(full_s AS DOUBLE) / 900, 6) AS availability, round(120 + 600 * CAST(full_s AS DOUBLE) / 900, 6) AS parking_s FROM tl", "v_parking_events", "v_parkings")
def parking_availability(events, parkings):
    a = op.availability(F.col("full_s"), 900)
    return _tally(events, parkings).select("parking", "bin", F.round(a, 6).alias("availability"), F.round(op.parking_seconds(a, F.lit(120), 600), 6).alias("parking_s"))


@query(f"WITH {TALLY} SELECT parking, bin, round(avg(1 - CAST(full_s AS DOUBLE) / 900) OVER (PARTITION BY parking ORDER BY bin), 6) AS mean FROM tl", "v_parking_events", "v_parkings")
def parking_running_availability(events, parkings):
    return op.running_mean(_tally(events, parkings).withColumn("a", op.availability(F.col("full_s"), 900)), "parking", "bin", "a").select("parking", "bin", "mean")


@query(f"WITH {TALLY} SELECT CAST(count(DISTINCT parking) AS BIGINT) AS parkings, CAST(sum(arrivals) AS BIGINT) AS arrivals, CAST(max(most) AS BIGINT) AS most, CAST(sum(full_s) AS BIGINT) AS full_s FROM tl", "v_parking_events", "v_parkings")
def parking_summary(events, parkings):
    return _tally(events, parkings).agg(F.countDistinct("parking").alias("parkings"), F.sum("arrivals").alias("arrivals"), F.max("most").alias("most"), F.sum("full_s").alias("full_s"))


@query(
    """WITH x AS (SELECT DISTINCT vehicle AS trip FROM v_traversals WHERE link IN (3, 17, 42)), o AS (SELECT o_zone, d_zone, sum(weight) AS p FROM v_trip_results WHERE trip IN (SELECT trip FROM x) GROUP BY 1, 2), a AS (SELECT o_zone, d_zone, sum(weight) AS p FROM v_trip_results GROUP BY 1, 2)
SELECT o.o_zone, o.d_zone, CAST(o.p AS BIGINT) AS people, round(CAST(o.p AS DOUBLE) / CAST(sum(o.p) OVER () AS DOUBLE), 6) AS share_link, round(CAST(o.p AS DOUBLE) / CAST(a.p AS DOUBLE), 6) AS share_pair FROM o JOIN a USING (o_zone, d_zone)""",
    "v_traversals",
    "v_trip_results",
)
def link_select(traversals, trips):
    return op.select_link(traversals.select(F.col("vehicle").alias("trip"), "link"), trips, [3, 17, 42])


@query("SELECT link, vehicle, pos FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY enter_s, vehicle, pos) - 1 AS r FROM v_traversals) WHERE r % 100 = 0", "v_traversals")
def events_every_hundredth(traversals):
    return op.every_nth(traversals, ["link"], ["enter_s", "vehicle", "pos"], 100).select("link", "vehicle", "pos")


@query("SELECT trip, printf('%02d:%02d:%02d', departure_s // 3600, departure_s % 3600 // 60, departure_s % 60) AS clock FROM v_trip_results", "v_trip_results")
def day_clock(trips):
    return trips.select("trip", op.clock(F.col("departure_s")).alias("clock"))


@query("SELECT trip, round(CASE WHEN weight = 1 THEN 0 ELSE 1.5 + 0.2 * ((trip * 37) % 20000) / 1000 + 0.3 * (trip % 3) END, 6) AS fare FROM v_trip_results".replace("0 ELSE 1.5 + 0.2 *", "0e0 ELSE 15e-1 + 2e-1 *").replace("0.3 *", "3e-1 *"), "v_trip_results")
def transit_fares(trips):
    return trips.select("trip", F.round(op.fare(1.5, 0.2, 0.3, F.col("trip") * 37 % 20000, F.col("trip") % 3, F.col("weight") == 1), 6).alias("fare"))


@query(
    "SELECT link, bin, CAST(sum(least(exit_s, hi) - greatest(enter_s, lo)) AS BIGINT) AS seconds FROM v_traversals JOIN (SELECT range AS bin, 60 * range AS lo, 60 * range + 60 AS hi FROM range(400, 700)) ON enter_s < hi AND exit_s > lo GROUP BY 1, 2",
    "v_traversals",
)
def state_seconds_per_bin(traversals):
    return op.interval_seconds(traversals.select("link", F.col("enter_s").alias("start_s"), F.col("exit_s").alias("end_s")), 60, "link")


@query(
    "WITH c AS (SELECT travel_time_s AS v, sum(weight) AS w FROM v_trip_results WHERE outcome = 'completed' GROUP BY 1), s AS (SELECT v, sum(w) OVER (ORDER BY v) AS c, sum(w) OVER () AS t FROM c) SELECT min(v) AS value FROM s WHERE c >= t * 0.9", "v_trip_results"
)
def weighted_p90(trips):
    return op.weighted_percentile(trips.filter("outcome = 'completed'"), "travel_time_s", "weight", 0.9)


@query("SELECT trip, CAST(dense_rank() OVER (PARTITION BY o_zone ORDER BY d_zone, departure_s) - 1 AS BIGINT) AS rank FROM v_trip_results", "v_trip_results")
def dense_place_ranks(trips):
    return trips.select("trip", (F.dense_rank().over(Window.partitionBy("o_zone").orderBy("d_zone", "departure_s")) - 1).cast("long").alias("rank"))


@query("SELECT traveller_id, trip, CAST(row_number() OVER (PARTITION BY traveller_id ORDER BY departure_s, trip) - 1 AS BIGINT) AS trip_index FROM v_trip_results", "v_trip_results")
def trip_index(trips):
    return trips.select("traveller_id", "trip", (F.row_number().over(Window.partitionBy("traveller_id").orderBy("departure_s", "trip")) - 1).cast("long").alias("trip_index"))


@query(
    "SELECT o_zone, mode, n FROM (SELECT o_zone, mode, count(*) AS n, row_number() OVER (PARTITION BY o_zone ORDER BY count(*) DESC, mode) AS r FROM v_trip_results WHERE outcome = 'no_feasible_path' GROUP BY 1, 2) WHERE r <= 3", "v_trip_results"
)
def report_no_alternative(trips):
    """The three modes that fail most, by origin."""
    counts = trips.filter("outcome = 'no_feasible_path'").groupBy("o_zone", "mode").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("o_zone").orderBy(F.desc("n"), "mode"))).filter("r <= 3").drop("r")


@query(
    """SELECT mode, CAST(count(*) AS BIGINT) AS trips, round(100 * CAST(sum(weight) AS DOUBLE) / CAST((SELECT sum(weight) FROM v_trip_results) AS DOUBLE), 6) AS percent FROM v_trip_results GROUP BY 1""", "v_trip_results"
)
def case_summary(trips):
    by = trips.groupBy("mode").agg(F.count("*").alias("trips"), F.sum("weight").alias("w"))
    return by.select("mode", "trips", F.round(100 * F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0))), 6).alias("percent"))


@query("SELECT o_zone, d_zone, round(CAST(sum(weight * travel_time_s) AS DOUBLE) / CAST(sum(weight) AS DOUBLE), 6) AS mean_s FROM v_trip_results WHERE outcome = 'completed' GROUP BY 1, 2", "v_trip_results")
def skim_observed(trips):
    return trips.filter("outcome = 'completed'").groupBy("o_zone", "d_zone").agg(F.round(F.sum(F.col("weight") * F.col("travel_time_s")) / F.sum("weight"), 6).alias("mean_s"))


@query("SELECT CAST(sum(l_extendedprice::DECIMAL(18, 2)) AS DOUBLE) AS fixed_order_sum FROM lineitem")
def fixed_order_sum(spark, sf_dir):
    """The same sum whatever the partitioning: exact decimals."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("fixed_order_sum"))
