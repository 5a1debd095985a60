"""Queries on timetables."""

from __future__ import annotations

from pyspark.sql import functions as F

from viatica.operators import transit as op
from viatica.plans.registry import query

CLOCKS = "c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE printf('%02d:%02d:%02d', o_orderkey % 30, o_orderkey % 60, o_orderkey * 7 % 60) END AS t FROM orders)"


@query(
    f"WITH {CLOCKS} SELECT k, CASE WHEN t <> 'x' THEN CAST(split_part(t, ':', 1) AS BIGINT) * 3600 + CAST(split_part(t, ':', 2) AS BIGINT) * 60 + CAST(split_part(t, ':', 3) AS BIGINT) END AS s FROM c"
)
def gtfs_time_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 11 == 0, "x").otherwise(F.format_string("%02d:%02d:%02d", k % 30, k % 60, k * 7 % 60))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), op.seconds_of(text).alias("s"))


@query(
    """SELECT p_partkey, CASE WHEN r IN (0, 5) OR r BETWEEN 900 AND 999 THEN 'tram' WHEN r IN (1, 12) OR r BETWEEN 400 AND 699 THEN 'metro' WHEN r = 2 OR r BETWEEN 100 AND 199 OR r BETWEEN 300 AND 399 THEN 'rail'
 WHEN r IN (3, 11) OR r BETWEEN 200 AND 299 OR r BETWEEN 700 AND 899 THEN 'bus' WHEN r = 4 OR r BETWEEN 1000 AND 1099 OR r BETWEEN 1200 AND 1299 THEN 'ferry' ELSE 'other' END AS kind FROM (SELECT p_partkey, p_partkey * 7 % 1800 AS r FROM part)"""
)
def service_kinds(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", op.kind_of(F.col("p_partkey") * 7 % 1800).alias("kind"))


@query(
    "SELECT line, run, stop, pos, arrive_s, depart_s FROM (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM v_calls WHERE arrive_s BETWEEN 25300 AND 40000 AND depart_s <= 40000) WHERE n >= 2", "v_calls"
)
def timetable_window(calls):
    return op.within(calls, 25300, 40000).select("line", "run", "stop", "pos", "arrive_s", "depart_s")


@query("SELECT line, run, stop, pos FROM v_calls WHERE line NOT IN (1, 3)", "v_calls")
def timetable_cancel(calls):
    return op.cancelled(calls, [1, 3]).select("line", "run", "stop", "pos")


@query(
    """WITH s AS (SELECT run, min(depart_s) AS start FROM v_calls WHERE line = 2 GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY start, run) AS n, count(*) OVER () AS a FROM s), m AS (SELECT run, start FROM r WHERE n = (a + 1) // 2),
h AS (SELECT stop, pos, arrive_s - start AS a, depart_s - start AS d FROM v_calls JOIN m USING (run) WHERE line = 2), x AS (SELECT unnest(generate_series(min(start), max(start), 1700)) AS start, min(start) AS lo FROM s)
SELECT line, run, stop, pos, arrive_s, depart_s FROM v_calls WHERE line <> 2 UNION ALL SELECT 2, 100000 + (x.start - lo) // 1700, stop, pos, x.start + a, x.start + d FROM x, h""",
    "v_calls",
)
def timetable_headway(calls):
    return op.with_headway(calls, 2, 1700)


@query(
    """WITH b AS (SELECT run, pos, pos * 300 AS p, CASE WHEN pos IN (0, 4) OR (run + pos) % 3 = 0 THEN arrive_s END AS t FROM v_calls),
x AS (SELECT *, last_value(t IGNORE NULLS) OVER f AS t0, first_value(t IGNORE NULLS) OVER g AS t1, last_value(CASE WHEN t IS NOT NULL THEN p END IGNORE NULLS) OVER f AS p0, first_value(CASE WHEN t IS NOT NULL THEN p END IGNORE NULLS) OVER g AS p1 FROM b
 WINDOW f AS (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), g AS (PARTITION BY run ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT run, pos, coalesce(t, t0 + (t1 - t0) * (p - p0) // nullif(p1 - p0, 0)) AS filled FROM x""",
    "v_calls",
)
def blank_times_filled(calls):
    known = F.col("pos").isin(0, 4) | ((F.col("run") + F.col("pos")) % 3 == 0)
    rows = calls.select("run", "pos", (F.col("pos") * 300).alias("at"), F.when(known, F.col("arrive_s")).alias("t"))
    return op.filled_times(rows).select("run", "pos", "filled")


@query("SELECT n AS line, unnest(range(21600 + 100 * n, 36000 + 200 * n, 600 + 60 * n)) AS start_s FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation)")
def frequencies_expanded(spark, sf_dir):
    n = F.col("n_nationkey").cast("long")
    f = spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("line"), (21600 + 100 * n).alias("start_s"), (36000 + 200 * n).alias("end_s"), (600 + 60 * n).alias("headway_s"))
    return op.expanded(f)


DAYS = """sv AS (SELECT n_nationkey AS service, DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS first, DATE '2024-03-01' + CAST(n_nationkey AS INTEGER) AS last, CASE n_nationkey % 3 WHEN 0 THEN '1111100' WHEN 1 THEN '0000011' ELSE '1010101' END AS days FROM nation),
dt AS (SELECT CAST(DATE '2024-01-01' + CAST(range AS INTEGER) AS DATE) AS date FROM range(100)), ex AS (SELECT n_nationkey AS service, CAST(DATE '2024-02-05' + CAST(n_nationkey % 4 AS INTEGER) AS DATE) AS date, 1 + n_nationkey % 2 AS type FROM nation),
ac AS (SELECT date, service FROM dt JOIN sv ON date BETWEEN first AND last WHERE substr(days, isodow(date), 1) = '1' AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.service = sv.service AND ex.date = dt.date AND type = 2) UNION SELECT date, service FROM ex WHERE type = 1)"""


def _active(spark, sf_dir):
    n = F.col("n_nationkey")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    services = nations.select(n.alias("service"), F.date_add(F.lit("2024-01-01").cast("date"), n).alias("first"), F.date_add(F.lit("2024-03-01").cast("date"), n).alias("last"), F.when(n % 3 == 0, "1111100").when(n % 3 == 1, "0000011").otherwise("1010101").alias("days"))
    exceptions = nations.select(n.alias("service"), F.date_add(F.lit("2024-02-05").cast("date"), n % 4).alias("date"), (1 + n % 2).alias("type"))
    dates = spark.range(100).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    return op.active(services, exceptions, dates)


@query(f"WITH {DAYS} SELECT CAST(date AS VARCHAR) AS date, service FROM ac")
def services_active(spark, sf_dir):
    return _active(spark, sf_dir).select(F.col("date").cast("string").alias("date"), "service")


@query(f"WITH {DAYS} SELECT CAST(date AS VARCHAR) AS date, n AS runs FROM (SELECT date, CAST(sum(service + 1) AS BIGINT) AS n FROM ac WHERE isodow(date) <= 5 GROUP BY 1) ORDER BY n DESC, date LIMIT 1")
def busiest_weekday(spark, sf_dir):
    by_day = _active(spark, sf_dir).filter("weekday(date) < 5").groupBy("date").agg(F.sum(F.col("service") + 1).alias("runs"))
    return by_day.orderBy(F.desc("runs"), "date").limit(1).select(F.col("date").cast("string").alias("date"), "runs")


@query(
    """WITH a AS (SELECT trip AS ask, o_zone AS stop, departure_s AS at_s FROM v_trip_results) SELECT ask, stop, line, min(depart_s) AS depart_s, arg_min(run, depart_s) AS run FROM (SELECT a.ask, a.stop, c.line, c.depart_s, c.run FROM a JOIN v_calls c ON a.stop = c.stop AND c.depart_s >= a.at_s) GROUP BY 1, 2, 3""",
    "v_trip_results",
    "v_calls",
)
def earliest_catchable_run(trips, calls):
    asks = trips.select(F.col("trip").alias("ask"), F.col("o_zone").alias("stop"), F.col("departure_s").alias("at_s"))
    return op.next_runs(asks, calls)


MOVES = """mv AS (SELECT (o_orderkey % 97) * 5 + o_custkey % 5 AS run, o_orderkey % 4 AS b, o_orderkey % 4 + 1 + o_custkey % (4 - o_orderkey % 4) AS e FROM orders), ml AS (SELECT run, b AS pos, 1 AS ons, 0 AS offs FROM mv UNION ALL SELECT run, e, 0, 1 FROM mv),
ld AS (SELECT line, c.run, c.pos, CAST(coalesce(sum(ons), 0) AS BIGINT) AS ons, CAST(coalesce(sum(offs), 0) AS BIGINT) AS offs FROM v_calls c LEFT JOIN ml ON ml.run = c.run AND ml.pos = c.pos GROUP BY 1, 2, 3),
ob AS (SELECT *, CAST(sum(ons - offs) OVER (PARTITION BY run ORDER BY pos) AS BIGINT) AS on_board FROM ld)"""


def _loads(spark, sf_dir):
    from viatica.sources.bridge import view

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rides = spark.read.parquet(f"{sf_dir}/orders.parquet").select((k % 97 * 5 + c % 5).alias("run"), (k % 4).alias("b"), (k % 4 + 1 + c % (4 - k % 4)).alias("e"))
    one, none = F.lit(1), F.lit(0)
    moves = rides.select("run", F.col("b").alias("pos"), one.alias("ons"), none.alias("offs")).unionByName(rides.select("run", F.col("e").alias("pos"), none.alias("ons"), one.alias("offs")))
    return op.loads(view(spark, sf_dir, "v_calls"), moves)


@query(f"WITH {MOVES} SELECT line, run, pos, ons, offs, on_board FROM ob")
def transit_on_board(spark, sf_dir):
    return _loads(spark, sf_dir).select("line", "run", "pos", "ons", "offs", "on_board")


@query(f"WITH {MOVES} SELECT line, CAST(sum(ons) AS BIGINT) AS boardings, max(on_board) AS most_on_board, CAST(count(DISTINCT run) AS BIGINT) AS runs FROM ob GROUP BY 1")
def transit_lines(spark, sf_dir):
    return op.line_summary(_loads(spark, sf_dir))


@query(
    """WITH c AS (SELECT line, run, stop, arrive_s - CASE WHEN run % 13 = 4 THEN 700 * pos ELSE 0 END AS a, depart_s - CASE WHEN run % 13 = 4 THEN 700 * pos ELSE 0 END AS d FROM v_calls), f AS (SELECT line, run, min(d) AS s FROM c GROUP BY 1, 2),
x AS (SELECT c.line, c.run, a, max(a) OVER (PARTITION BY c.line, stop ORDER BY s, c.run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c JOIN f ON c.run = f.run) SELECT DISTINCT line, run FROM x WHERE a <= b""",
    "v_calls",
)
def overtaking_runs(calls):
    early = F.when(F.col("run") % 13 == 4, 700 * F.col("pos")).otherwise(0)
    return op.overtaken(calls.withColumns({"arrive_s": F.col("arrive_s") - early, "depart_s": F.col("depart_s") - early}))


@query(
    "WITH s AS (SELECT s_suppkey AS stop, (s_suppkey * 53) % 2000 AS x, (s_suppkey * 29) % 2000 AS y FROM supplier) SELECT a.stop AS a, b.stop AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM s a JOIN s b ON a.stop <> b.stop AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 90000"
)
def stop_footpaths(spark, sf_dir):
    k = F.col("s_suppkey")
    return op.footpaths(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("stop"), (k * 53 % 2000).alias("x"), (k * 29 % 2000).alias("y")), 300)


@query(
    """WITH j AS (SELECT situation AS ask, transfers AS rides, min(CAST(time_min AS BIGINT)) AS arrive_s FROM v_alternatives GROUP BY 1, 2) SELECT * FROM j a WHERE NOT EXISTS (SELECT 1 FROM j b WHERE b.ask = a.ask AND b.rides < a.rides AND b.arrive_s <= a.arrive_s)""",
    "v_alternatives",
)
def journey_pareto(alternatives):
    return op.pareto(alternatives.select(F.col("situation").alias("ask"), F.col("transfers").alias("rides"), F.col("time_min").cast("long").alias("arrive_s")))


WALKS = "wk AS (SELECT a.zone AS a, b.zone AS b, CAST(240 AS BIGINT) AS walk_s FROM v_zones a JOIN v_zones b ON b.zone = a.zone + 5)"
RIDE = """o{n} AS (SELECT f.ask, c.stop AS at_stop, c.line, min(c.depart_s) AS dep FROM {before} f JOIN v_calls c ON c.stop = f.stop AND c.depart_s >= f.t + {slack} GROUP BY 1, 2, 3),
h{n} AS (SELECT o.ask, d.stop, min(d.arrive_s) AS t FROM o{n} o JOIN v_calls b ON b.stop = o.at_stop AND b.line = o.line AND b.depart_s = o.dep JOIN v_calls d ON d.run = b.run AND d.pos > b.pos GROUP BY 1, 2),
w{n} AS (SELECT ask, stop, t FROM h{n} UNION ALL SELECT ask, b, t + walk_s FROM h{n} JOIN wk ON stop = a), b{n} AS (SELECT ask, stop, min(t) AS t, min(r * 0 + r) FILTER (WHERE r >= 0) AS r0 FROM (SELECT ask, stop, t, {n} AS r FROM w{n}) GROUP BY 1, 2),
a{n} AS (SELECT ask, stop, x[1] AS t, x[2] AS rides FROM (SELECT ask, stop, min([t, r]) AS x FROM (SELECT ask, stop, t, rides AS r FROM {all} UNION ALL SELECT ask, stop, t, {n} FROM b{n}) GROUP BY 1, 2)), f{n} AS (SELECT * FROM a{n} WHERE rides = {n})"""


@query(
    f"""WITH {WALKS}, a0 AS (SELECT trip AS ask, o_zone AS stop, departure_s AS t, CAST(0 AS BIGINT) AS rides FROM v_trip_results),
{RIDE.format(n=1, before="a0", all="a0", slack=0)}, {RIDE.format(n=2, before="f1", all="a1", slack=60)}, {RIDE.format(n=3, before="f2", all="a2", slack=60)}
SELECT ask, stop, CAST(t AS BIGINT) AS t, CAST(rides AS BIGINT) AS rides FROM a3""",
    "v_trip_results",
    "v_calls",
    "v_zones",
)
def raptor_arrivals(trips, calls, zones):
    """From every trip's zone at its departure to all stops."""
    asks = trips.select(F.col("trip").alias("ask"), F.col("o_zone").alias("stop"), F.col("departure_s").alias("at_s"))
    return op.shared_arrivals(asks, calls, walks_up(zones), 3, 60).withColumn("rides", F.col("rides").cast("long"))


def walks_up(zones):
    """From every zone to the one above it."""
    return zones.select(F.col("zone").alias("a")).join(zones.select(F.col("zone").alias("b")), F.col("b") == F.col("a") + 5).withColumn("walk_s", F.lit(240).cast("long"))


RIDE_LEG = """o{n} AS (SELECT f.ask, f.stop AS board, c.line, min([c.depart_s, c.run]) AS x FROM {before} f JOIN v_calls c ON c.stop = f.stop AND c.depart_s >= f.t + {slack} GROUP BY 1, 2, 3),
h{n} AS (SELECT o.ask, d.stop, min([d.arrive_s, o.x[2], o.board, d.stop]) AS p FROM o{n} o JOIN v_calls b ON b.run = o.x[2] AND b.stop = o.board JOIN v_calls d ON d.run = b.run AND d.pos > b.pos GROUP BY 1, 2),
b{n} AS (SELECT ask, stop, min(p) AS p FROM (SELECT ask, stop, p FROM h{n} UNION ALL SELECT ask, b, [p[1] + walk_s, p[2], p[3], p[4]] FROM h{n} JOIN wk ON stop = a) GROUP BY 1, 2),
f{n} AS (SELECT b.ask, b.stop, p[1] AS t, p FROM b{n} b LEFT JOIN {all} g ON g.ask = b.ask AND g.stop = b.stop WHERE g.t IS NULL OR p[1] < g.t), g{n} AS (SELECT ask, stop, min(t) AS t FROM (SELECT ask, stop, t FROM {all} UNION ALL SELECT ask, stop, t FROM f{n}) GROUP BY 1, 2)"""


@query(
    f"""WITH {WALKS}, a0 AS (SELECT trip AS ask, o_zone AS stop, departure_s + 60 AS t FROM v_trip_results), eg AS (SELECT trip AS ask, d_zone AS stop, 60 AS walk_s FROM v_trip_results UNION ALL SELECT trip, d_zone + 5, 300 FROM v_trip_results WHERE d_zone < 20),
{RIDE_LEG.format(n=1, before="a0", all="a0", slack=0)}, {RIDE_LEG.format(n=2, before="f1", all="g1", slack=60)}, {RIDE_LEG.format(n=3, before="f2", all="g2", slack=60)},
e AS (SELECT f.ask, r AS rides, min([t + walk_s, stop]) AS x FROM (SELECT ask, stop, t, 1 AS r FROM f1 UNION ALL SELECT ask, stop, t, 2 FROM f2 UNION ALL SELECT ask, stop, t, 3 FROM f3) f JOIN eg USING (ask, stop) GROUP BY 1, 2),
j AS (SELECT ask, rides, x[1] AS arrive_s, x[2] AS stop FROM e WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.ask = e.ask AND y.rides < e.rides AND y.x[1] <= e.x[1])),
l3 AS (SELECT j.ask, j.rides, 3 AS leg, p FROM j JOIN f3 USING (ask, stop) WHERE rides = 3), l2 AS (SELECT s.ask, s.rides, 2 AS leg, p FROM (SELECT ask, rides, stop FROM j WHERE rides = 2 UNION ALL SELECT ask, rides, p[3] FROM l3) s JOIN f2 USING (ask, stop)),
l1 AS (SELECT s.ask, s.rides, 1 AS leg, p FROM (SELECT ask, rides, stop FROM j WHERE rides = 1 UNION ALL SELECT ask, rides, p[3] FROM l2) s JOIN f1 USING (ask, stop)), l AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)
SELECT l.ask AS trip, l.rides, l.leg, b.line, p[2] AS run, p[3] AS board, p[4] AS alight, b.depart_s, a.arrive_s, p[1] - a.arrive_s AS walk_s FROM l JOIN v_calls b ON b.run = p[2] AND b.stop = p[3] JOIN v_calls a ON a.run = p[2] AND a.stop = p[4]""",
    "v_trip_results",
    "v_calls",
    "v_zones",
)
def transit_journey_legs(trips, calls, zones):
    """Every trip's Pareto journeys, leg by leg, from its zone's stop a minute away to its destination's own or the one above."""
    starts = trips.select(F.col("trip").alias("ask"), F.col("o_zone").alias("stop"), (F.col("departure_s") + 60).alias("at_s"))
    own = trips.select(F.col("trip").alias("ask"), F.col("d_zone").alias("stop"), F.lit(60).cast("long").alias("walk_s"))
    above = trips.filter("d_zone < 20").select(F.col("trip").alias("ask"), (F.col("d_zone") + 5).alias("stop"), F.lit(300).cast("long").alias("walk_s"))
    found, labels = op.shared_journeys(starts, own.unionByName(above), calls, walks_up(zones), 3, 60, 600)
    return op.legs(found, labels, calls, 3).withColumnRenamed("ask", "trip").withColumns({c: F.col(c).cast("long") for c in ("rides", "leg")})
