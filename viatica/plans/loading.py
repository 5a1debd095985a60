"""Queries on link loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from viatica.operators import loading as op
from viatica.plans.registry import query

BINS = "bins AS (SELECT exit_s // 900 AS bin, link, CAST(count(*) AS BIGINT) AS crossings, CAST(sum(pcu) AS BIGINT) AS pcu, CAST(sum(pcu * (exit_s - enter_s)) AS BIGINT) AS pcu_seconds FROM v_traversals GROUP BY 1, 2)"


@query(f"WITH {BINS} SELECT * FROM bins", "v_traversals")
def link_bins_15min(traversals):
    return op.link_bins(traversals)


@query("SELECT enter_s // 900 AS bin, link, CAST(sum(pcu) AS BIGINT) AS pcu, CAST(sum(pcu * greatest(exit_s - enter_s, 30)) AS BIGINT) AS pcu_seconds FROM v_traversals GROUP BY 1, 2", "v_traversals")
def link_entry_table(traversals):
    return op.entry_table(traversals, 30)


@query(
    """SELECT DISTINCT enter_s // 900 AS bin, link, first_value(vehicle) OVER w AS first_vehicle, last_value(vehicle) OVER w AS last_vehicle FROM v_traversals
WINDOW w AS (PARTITION BY enter_s // 900, link ORDER BY enter_s, vehicle, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "v_traversals",
)
def link_entrants(traversals):
    return op.entrants(traversals)


@query(
    f"""WITH {BINS} SELECT link, CAST(coalesce(v, 0) AS BIGINT) AS volume, round(s / v, 6) AS mean_s, round(greatest(s / v - CAST(length_m AS DOUBLE) / 10, 0), 6) AS delay_s
FROM v_links LEFT JOIN (SELECT link, sum(pcu) AS v, CAST(sum(pcu_seconds) AS DOUBLE) AS s FROM bins GROUP BY 1) USING (link)""",
    "v_traversals",
    "v_links",
)
def link_table(traversals, links):
    return op.link_table(op.link_bins(traversals), links)


@query(
    f"""WITH {BINS}, l AS (SELECT link, sum(pcu) AS p, sum(pcu_seconds) AS s FROM bins GROUP BY 1)
SELECT CAST(sum(p * length_m) AS DOUBLE) / 1000 AS veh_km, round(CAST(sum(p * length_m) AS DOUBLE) / CAST(sum(s) AS DOUBLE) * CAST(3.6 AS DOUBLE), 6) AS mean_km_h, arg_max(link, p * 100 - link) AS busiest FROM l JOIN v_links USING (link)""",
    "v_traversals",
    "v_links",
)
def flow_summary(traversals, links):
    return op.flow_summary(op.link_bins(traversals), links)


@query(
    f"""WITH {BINS} SELECT bin, link, CASE WHEN r < 0.25 THEN 0 WHEN r < 0.5 THEN 1 WHEN r < 0.75 THEN 2 WHEN r < 1 THEN 3 ELSE 4 END :: BIGINT AS band
FROM (SELECT bin, link, CAST(pcu AS DOUBLE) / (450 * lanes) AS r FROM bins JOIN v_links USING (link))""",
    "v_traversals",
    "v_links",
)
def volume_capacity_bands(traversals, links):
    return op.link_bins(traversals).join(links, "link").select("bin", "link", op.band(F.col("pcu") / (450 * F.col("lanes"))).alias("band"))


@query(
    f"""WITH {BINS}, b AS (SELECT bin, sum(pcu) AS p FROM bins GROUP BY 1), t AS (SELECT max(p) AS peak, arg_max(bin, p * 1000 - bin) AS pk FROM b),
g AS (SELECT bin, bin - row_number() OVER (ORDER BY bin) AS g, pk FROM b, t WHERE p >= 0.25 * peak)
SELECT min(bin) AS first_bin, max(bin) AS last_bin FROM g GROUP BY g, pk HAVING pk BETWEEN min(bin) AND max(bin)""",
    "v_traversals",
)
def busiest_bins(traversals):
    return op.busiest_window(op.link_bins(traversals))


@query(
    """WITH s AS (SELECT link, exit_s // 60 * 60 AS at_s, sum(pcu) AS p FROM v_traversals GROUP BY 1, 2),
r AS (SELECT link, sum(p) OVER (PARTITION BY link ORDER BY at_s RANGE BETWEEN 840 PRECEDING AND CURRENT ROW) AS p FROM s) SELECT link, CAST(max(p) AS BIGINT) AS peak_pcu FROM r GROUP BY 1""",
    "v_traversals",
)
def busiest_quarter_hour(traversals):
    return op.rolling_peak(traversals)


ROUTED = "r AS (SELECT t.vehicle, t.pos, t.link, first_value(enter_s) OVER (PARTITION BY t.vehicle ORDER BY t.pos) AS d, {0} AS s FROM v_traversals t JOIN v_links l USING (link))"


def _routes(traversals):
    first = traversals.groupBy("vehicle").agg(F.min_by("enter_s", "pos").alias("depart_s"))
    return traversals.select("vehicle", "pos", "link").join(first, "vehicle")


@query(
    "WITH " + ROUTED.format("l.length_m // 10") + " SELECT vehicle, pos, link, CAST(d + sum(s) OVER w - s AS BIGINT) AS enter_s, CAST(d + sum(s) OVER w AS BIGINT) AS exit_s FROM r WINDOW w AS (PARTITION BY vehicle ORDER BY pos)",
    "v_traversals",
    "v_links",
)
def free_flow_trajectories(traversals, links):
    return op.trajectories(_routes(traversals), links.select("link", F.expr("length_m div 10").alias("seconds")))


@query(
    "WITH " + ROUTED.format("40 + l.link % 7") + ", x AS (SELECT link, CAST(d + sum(s) OVER (PARTITION BY vehicle ORDER BY pos) AS BIGINT) AS e, s FROM r) SELECT e // 900 AS bin, link, CAST(count(*) AS BIGINT) AS crossings, CAST(count(*) AS BIGINT) AS pcu, CAST(sum(s) AS BIGINT) AS pcu_seconds FROM x GROUP BY 1, 2",
    "v_traversals",
    "v_links",
)
def timed_loading_bins(traversals, links):
    timed = op.trajectories(_routes(traversals), links.select("link", (40 + F.col("link") % 7).alias("seconds")))
    return op.link_bins(timed.withColumn("pcu", F.lit(1).cast("long")))


@query(
    """WITH RECURSIVE q AS (SELECT link, vehicle, pos, enter_s + 20 AS ready, pcu, row_number() OVER (PARTITION BY link ORDER BY enter_s, vehicle, pos) AS n FROM v_traversals),
x AS (SELECT link, vehicle, pos, n, ready AS e, pcu FROM q WHERE n = 1 UNION ALL SELECT q.link, q.vehicle, q.pos, q.n, greatest(q.ready, x.e + 2 * x.pcu), q.pcu FROM q JOIN x ON q.link = x.link AND q.n = x.n + 1)
SELECT link, vehicle, pos, CAST(e AS BIGINT) AS exit_s FROM x""",
    "v_traversals",
)
def point_queue_discharge(traversals):
    return op.discharge(traversals.select("link", "vehicle", "pos", (F.col("enter_s") + 20).alias("ready_s"), "pcu"))


@query(
    """WITH e AS (SELECT link, enter_s AS at_s, pcu AS c FROM v_traversals UNION ALL SELECT link, exit_s, -pcu FROM v_traversals), s AS (SELECT link, at_s, sum(c) AS c FROM e GROUP BY 1, 2),
o AS (SELECT link, sum(c) OVER (PARTITION BY link ORDER BY at_s) AS p FROM s) SELECT link, CAST(max(p) AS BIGINT) AS peak_pcu FROM o GROUP BY 1""",
    "v_traversals",
)
def link_peak_occupancy(traversals):
    return op.peak_occupancy(traversals)


@query(
    """SELECT l.link, g.t AS at, CAST(coalesce(sum(pcu) FILTER (WHERE enter_s <= g.t), 0) AS BIGINT) AS n_up, CAST(coalesce(sum(pcu) FILTER (WHERE exit_s <= g.t), 0) AS BIGINT) AS n_down
FROM (SELECT DISTINCT link FROM v_traversals) l CROSS JOIN (SELECT 27000 + 600 * range AS t FROM range(14)) g JOIN v_traversals x ON x.link = l.link GROUP BY 1, 2""",
    "v_traversals",
)
def cumulative_curves(traversals):
    return op.curves_at(traversals)


@query("SELECT link, min(exit_s) AS first_exit_s FROM v_traversals WHERE exit_s > 30000 GROUP BY 1", "v_traversals")
def first_exit_after_t(traversals):
    return op.first_exit_after(traversals, 30000)


CARRIED = f"""{BINS}, m AS (SELECT link, bin, CAST(pcu_seconds AS DOUBLE) / pcu AS m, lead(bin) OVER (PARTITION BY link ORDER BY bin) AS nxt FROM bins),
c AS (SELECT link, b AS bin, round(greatest(m - (b - bin) * 900, 30), 6) AS seconds FROM (SELECT link, bin, m, unnest(generate_series(bin, coalesce(nxt - 1, bin))) AS b FROM m))"""


@query(f"WITH {CARRIED} SELECT * FROM c", "v_traversals")
def carried_link_times(traversals):
    return op.carried_times(op.link_bins(traversals), 900, 30)


@query(f"WITH {CARRIED} SELECT link, bin, round(max(bin * 900 + seconds) OVER (PARTITION BY link ORDER BY bin), 6) AS exit_s FROM c", "v_traversals")
def fifo_link_exits(traversals):
    return op.fifo_exits(op.carried_times(op.link_bins(traversals), 900, 30), 900)


@query(
    """WITH a AS (SELECT enter_s // 900 AS bin, link, CAST(sum(pcu * greatest(exit_s - enter_s, 30)) AS BIGINT) AS x FROM v_traversals GROUP BY 1, 2),
b AS (SELECT (enter_s + vehicle % 300) // 900 AS bin, link, CAST(sum(pcu * greatest(exit_s + pos % 3 * 10 - enter_s, 30)) AS BIGINT) AS y FROM v_traversals GROUP BY 1, 2)
SELECT round(CAST(sum(abs(coalesce(y, 0) - coalesce(x, 0))) AS DOUBLE) / CAST(sum(coalesce(y, 0)) AS DOUBLE), 6) AS change FROM a FULL JOIN b USING (bin, link)""",
    "v_traversals",
)
def loading_time_change(traversals):
    """Between a loading and the next, in which vehicles start later and take longer."""
    late = F.col("vehicle") % 300
    after = traversals.withColumns({"enter_s": F.col("enter_s") + late, "exit_s": F.col("exit_s") + late + F.col("pos") % 3 * 10})
    return op.relative_change(op.entry_table(traversals, 30), op.entry_table(after, 30))


@query(
    f"WITH {BINS} SELECT bin, link, round(CAST(length_m AS DOUBLE) / 10 * (1 + CAST(0.15 AS DOUBLE) * pow(CAST(pcu AS DOUBLE) / (450 * lanes), 4)), 6) AS seconds FROM bins JOIN v_links USING (link)",
    "v_traversals",
    "v_links",
)
def bpr_link_seconds(traversals, links):
    return op.link_bins(traversals).join(links, "link").select("bin", "link", F.round(op.bpr(F.col("length_m") / 10, F.col("pcu"), 450 * F.col("lanes")), 6).alias("seconds"))


@query("SELECT link, round(least(max(p) / 900, 1), 6) AS propensity FROM (SELECT link, enter_s // 1800 AS bin, CAST(sum(pcu) AS DOUBLE) AS p FROM v_traversals GROUP BY 1, 2) GROUP BY 1", "v_traversals")
def congestion_propensity(traversals):
    return op.propensity(traversals, 900)


@query(
    """WITH e AS (SELECT link, enter_s AS at_s, pcu AS c FROM v_traversals UNION ALL SELECT link, exit_s, -pcu FROM v_traversals), s AS (SELECT link, at_s, sum(c) AS c FROM e GROUP BY 1, 2),
o AS (SELECT link, sum(c) OVER (PARTITION BY link ORDER BY at_s) AS p FROM s), k AS (SELECT link, CAST(max(p) AS BIGINT) AS peak_pcu FROM o GROUP BY 1)
SELECT link, peak_pcu, length_m * lanes // 70 AS storage_pcu, peak_pcu - length_m * lanes // 70 AS excess_pcu FROM k JOIN v_links USING (link) WHERE peak_pcu - length_m * lanes // 70 >= 5""",
    "v_traversals",
    "v_links",
)
def report_spillback(traversals, links):
    return op.spillback(traversals, links, 5, 70)


@query("SELECT link, enter_s // 900 AS bin, CAST(sum(pcu) AS BIGINT) AS pcu, CAST(sum(pcu * (vehicle % 60)) AS BIGINT) AS wait_pcu_s FROM (SELECT link, enter_s - vehicle % 60 AS d, enter_s - vehicle % 60 AS enter_s, pcu, vehicle FROM v_traversals WHERE pos = 0) GROUP BY 1, 2", "v_traversals")
def origin_waits(traversals):
    return op.origin_wait(traversals.filter("pos = 0").withColumn("depart_s", F.col("enter_s") - F.col("vehicle") % 60))


@query("SELECT DISTINCT link, pair, route FROM v_routes", "v_routes")
def link_route_index(routes):
    """Which routes use a link."""
    return routes.select("link", "pair", "route").distinct()
