"""Queries on trip demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from viatica.operators import demand as op
from viatica.plans.registry import query


@query(
    """SELECT * FROM (SELECT unnest(['mode_unknown', 'mode_missing', 'weight_missing', 'zone_out_of_range', 'departure_negative', 'same_ends']) AS code,
unnest([count(*) FILTER (WHERE mode NOT IN ('walk', 'bike', 'car', 'transit')), count(*) FILTER (WHERE mode IS NULL), count(*) FILTER (WHERE weight IS NULL),
 count(*) FILTER (WHERE NOT (o_zone BETWEEN 0 AND 24 AND d_zone BETWEEN 0 AND 24)), count(*) FILTER (WHERE departure_s < 0), count(*) FILTER (WHERE o_zone = d_zone)]) AS rows FROM v_trips)""",
    "v_trips",
)
def trip_row_check(trips):
    return op.trip_faults(trips, 25)


@query(
    """WITH f AS (SELECT 'weight_missing' AS code, event_id AS element FROM v_trips WHERE weight IS NULL UNION ALL SELECT 'same_ends', event_id FROM v_trips WHERE o_zone = d_zone)
SELECT code, rows, element FROM (SELECT *, count(*) OVER (PARTITION BY code) AS rows, row_number() OVER (PARTITION BY code ORDER BY element) AS n FROM f) WHERE n <= 100""",
    "v_trips",
)
def diagnostics_capped(trips):
    found = trips.filter("weight is null").select(F.lit("weight_missing").alias("code"), F.col("event_id").alias("element")).unionByName(trips.filter("o_zone = d_zone").select(F.lit("same_ends").alias("code"), F.col("event_id").alias("element")))
    return op.diagnostics(found, 100)


@query("SELECT traveller_id, o_zone, CAST(count(*) AS BIGINT) AS rows FROM v_trips GROUP BY 1, 2 HAVING count(*) > 1", "v_trips")
def distinct_key_check(trips):
    """On a key that does repeat: traveller and origin."""
    return op.repeated_keys(trips, "traveller_id", "o_zone")


@query(
    """SELECT traveller_id, CAST(count(*) AS BIGINT) AS trips, CAST(coalesce(arg_min(weight, trip_seq) FILTER (WHERE weight IS NOT NULL), 1) AS BIGINT) AS weight,
arg_min(user_class, trip_seq) AS user_class, count(DISTINCT user_class) > 1 AS classes_differ FROM v_trips GROUP BY 1""",
    "v_trips",
)
def build_travellers(trips):
    return op.travellers(trips)


@query(
    "SELECT event_id, traveller_id, trip_seq, coalesce(lag(d_zone) OVER w, o_zone) AS origin, coalesce(lag(d_zone) OVER w <> o_zone, false) AS moved FROM v_trips WINDOW w AS (PARTITION BY traveller_id ORDER BY trip_seq)",
    "v_trips",
)
def chain_origin_override(trips):
    return op.chained_origins(trips).select("event_id", "traveller_id", "trip_seq", "origin", "moved")


@query(
    """WITH t AS (SELECT traveller_id, arg_min(user_class, trip_seq) AS user_class FROM v_trips GROUP BY 1)
SELECT t.traveller_id, coalesce(owns_car, user_class IN ('c1', 'c3'), false) AS owns_car, owns_car IS NOT NULL AS overridden FROM t LEFT JOIN v_persons p ON t.traveller_id = p.traveller_id""",
    "v_trips",
    "v_persons",
)
def ownership_override(trips, persons):
    defaults = trips.sparkSession.createDataFrame([("c0", False), ("c1", True), ("c2", False), ("c3", True)], "user_class string, class_owns_car boolean")
    return op.ownership(op.travellers(trips), persons, defaults)


@query(
    "SELECT CAST(count(*) FILTER (WHERE departure_s BETWEEN 25200 AND 32399) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE departure_s < 25200) AS BIGINT) AS before, CAST(count(*) FILTER (WHERE departure_s >= 32400) AS BIGINT) AS after FROM v_trips",
    "v_trips",
)
def window_filter(trips):
    return op.window_report(trips, 25200, 32400)


@query("SELECT CAST(min(departure_s) // 900 * 900 AS BIGINT) AS start_s, CAST((max(departure_s) // 900 + 1) * 900 - min(departure_s) // 900 * 900 AS BIGINT) AS period_s FROM v_trips", "v_trips")
def default_window(trips):
    return op.departure_span(trips)


@query(
    """WITH m AS (SELECT event_id, mode, CASE user_class WHEN 'c0' THEN ['walk', 'transit'] WHEN 'c1' THEN ['car', 'walk'] WHEN 'c2' THEN ['bike', 'transit', 'walk'] ELSE ['car', 'bike'] END AS modes FROM v_trips)
SELECT event_id, CAST(CASE WHEN mode IS NULL THEN len(modes) WHEN list_contains(modes, mode) THEN 1 ELSE 0 END AS BIGINT) AS n_modes, CASE WHEN mode IS NULL THEN array_to_string(modes, ';') WHEN list_contains(modes, mode) THEN mode ELSE '' END AS modes FROM m""",
    "v_trips",
)
def modes_offered(trips):
    allowed = trips.sparkSession.createDataFrame([("c0", ["walk", "transit"]), ("c1", ["car", "walk"]), ("c2", ["bike", "transit", "walk"]), ("c3", ["car", "bike"])], "user_class string, modes array<string>")
    return op.offered_modes(trips, allowed).select("event_id", F.size("offered").cast("long").alias("n_modes"), F.array_join("offered", ";").alias("modes"))


POINTS = "pt AS (SELECT c_custkey AS point, (c_custkey * 37) % 500 AS x, (c_custkey * 91) % 500 AS y FROM customer), zn AS (SELECT CAST(n_nationkey AS BIGINT) AS zone, CAST(50 + 100 * (n_nationkey % 5) AS BIGINT) AS x, CAST(50 + 100 * (n_nationkey // 5) AS BIGINT) AS y FROM nation)"


@query(
    f"WITH {POINTS}, d AS (SELECT point, zone, (pt.x - zn.x) * (pt.x - zn.x) + (pt.y - zn.y) * (pt.y - zn.y) AS d2 FROM pt, zn) SELECT point, zone, d2 FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY d2, zone) AS n FROM d) WHERE n = 1"
)
def nearest_zone_join(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("point"), (F.col("c_custkey") * 37 % 500).alias("x"), (F.col("c_custkey") * 91 % 500).alias("y"))
    n = F.col("n_nationkey").cast("long")
    zones = spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("zone"), (50 + 100 * (n % 5)).alias("x"), (50 + 100 * F.expr("cast(n_nationkey as bigint) div 5")).alias("y"))
    return op.nearest_zone(points, zones)


@query(
    """WITH e AS (SELECT (user_id * 37) % 400 AS x, (event_id * 13) % 300 AS y FROM events), c AS (SELECT x // 100 AS cx, y // 100 AS cy, x, y, count(*) AS n FROM e GROUP BY 1, 2, 3, 4)
SELECT cx, cy, x, y, CAST(t AS BIGINT) AS ends FROM (SELECT *, sum(n) OVER (PARTITION BY cx, cy) AS t, row_number() OVER (PARTITION BY cx, cy ORDER BY n DESC, x, y) AS r FROM c) WHERE r = 1"""
)
def aggregate_space_grid(spark, sf_dir):
    ends = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") * 37 % 400).alias("x"), (F.col("event_id") * 13 % 300).alias("y"))
    return op.cell_points(ends, 100)


@query("SELECT event_id, departure_s // 900 * 900 AS departure_s FROM v_trips", "v_trips")
def aggregate_time(trips):
    return trips.select("event_id", F.expr("departure_s div 900 * 900").alias("departure_s"))


@query(
    "SELECT traveller_id, event_id, CAST(10 AS BIGINT) AS sample_weight FROM (SELECT *, row_number() OVER (PARTITION BY user_class, mode ORDER BY md5('3:' || event_id), event_id) - 1 AS n FROM v_trips) WHERE n % 10 = 0", "v_trips"
)
def demand_sample(trips):
    return op.systematic_sample(trips, ["user_class", "mode"], "event_id", 10, 3).select("traveller_id", "event_id", "sample_weight")


@query(
    """WITH p AS (SELECT traveller_id, CAST(coalesce(arg_min(weight, trip_seq) FILTER (WHERE weight IS NOT NULL), 1) AS BIGINT) AS w FROM v_trips GROUP BY 1),
m AS (SELECT traveller_id, 2 * sum(w) OVER (ORDER BY md5('5:' || traveller_id), traveller_id) - w AS m2, sum(w) OVER () AS t FROM p)
SELECT traveller_id, CASE WHEN m2 * 50 < 20 * t THEN 'a' WHEN m2 * 50 < 50 * t THEN 'b' ELSE 'c' END AS user_class FROM m""",
    "v_trips",
)
def assign_classes(trips):
    shares = trips.sparkSession.createDataFrame([("a", 20), ("b", 30), ("c", 50)], "user_class string, percent long")
    return op.assign_classes(op.travellers(trips).drop("user_class"), shares, 5)


INTEGER_OD = """w AS (SELECT o, d, sevenths // 7 AS n, sevenths % 7 AS r, md5('9:' || o || ':' || d) AS k, CAST(round(CAST(sum(sevenths) OVER () AS DOUBLE) / 7) AS BIGINT) - sum(sevenths // 7) OVER () AS l FROM v_od),
i AS (SELECT o, d, CAST(n + CASE WHEN row_number() OVER (ORDER BY r DESC, k) <= l THEN 1 ELSE 0 END AS BIGINT) AS n FROM w)"""


@query(f"WITH {INTEGER_OD} SELECT * FROM i", "v_od")
def od_integerise(od):
    return op.integerise(od.withColumnRenamed("sevenths", "parts"), 7, 9)


@query(f"WITH {INTEGER_OD} SELECT o, d, x AS i, 25200 + CAST(('0x' || substr(md5('9:' || o || ':' || d || ':' || x), 1, 8)) AS BIGINT) % 7200 AS departure_s FROM (SELECT o, d, unnest(generate_series(1, n)) AS x FROM i)", "v_od")
def demand_from_od(od):
    return op.trips_of(op.integerise(od.withColumnRenamed("sevenths", "parts"), 7, 9), 25200, 7200, 9)


@query(
    """SELECT traveller_id, trip_seq, z AS car_zone, z = o_zone AS car_here FROM (SELECT *, coalesce(last_value(CASE WHEN mode = 'car' THEN d_zone END IGNORE NULLS) OVER (PARTITION BY traveller_id ORDER BY trip_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 first_value(o_zone) OVER (PARTITION BY traveller_id ORDER BY trip_seq)) AS z FROM v_trips)""",
    "v_trips",
)
def vehicle_location_tracking(trips):
    return op.vehicle_places(trips)
