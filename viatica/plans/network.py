"""Queries on road networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from viatica.operators import network as op
from viatica.operators.assembly import strong_components
from viatica.plans.registry import query

DEFAULTS = "df(class, km_h, saturation, jam) AS (VALUES " + ", ".join(f"('{c}', {v}, {s}, {j})" for c, v, _, s, j in op.CLASS_DEFAULTS) + ")"
CAPACITY = f"""{DEFAULTS}, pr AS (SELECT *, jam * lanes AS kj, CASE WHEN signalised THEN CAST(least(saturation, CASE WHEN km_h <= 30 THEN 1000 WHEN km_h <= 50 THEN 1200 WHEN km_h <= 70 THEN 1500 ELSE saturation END) * lanes * 48 AS DOUBLE) / 100
 ELSE CAST(saturation * lanes AS DOUBLE) END AS q FROM v_links JOIN df USING (class))"""


@query(
    f"""WITH {CAPACITY} SELECT link, round(q, 6) AS capacity, CAST(kj AS BIGINT) AS jam_density, round(least(greatest(q / (kj - q / km_h), 6), 30), 6) AS wave_km_h, round(length_m * CAST(3.6 AS DOUBLE) / km_h, 6) AS free_flow_s,
round(CAST(kj * length_m AS DOUBLE) / 1000, 6) AS storage_pcu, round(q / km_h, 6) AS critical_density FROM pr""",
    "v_links",
)
def link_parameters(links):
    return op.parameters(links, op.class_defaults(links.sparkSession))


@query(f"WITH {CAPACITY} SELECT link, round(90 * pow(CAST(0.52 AS DOUBLE), 2) / (2 * (1 - CAST(0.48 AS DOUBLE) * least(CAST(link % 12 AS DOUBLE) / 10, 1))), 6) AS delay_s FROM pr WHERE signalised", "v_links")
def uniform_control_delay(links):
    return links.filter("signalised").select("link", F.round(op.uniform_delay(F.lit(90), F.lit(0.48), F.col("link") % 12 / 10), 6).alias("delay_s"))


@query(
    """SELECT link, from_node, to_node, length_m, CASE WHEN link % 9 = 3 THEN 3 ELSE lanes END AS lanes, class, signalised AND link % 5 <> 1 AS signalised, CASE WHEN link % 7 = 2 THEN 5e-1 ELSE 1e0 END AS capacity_factor FROM v_links WHERE link % 10 <> 0""", "v_links"
)
def network_edit(links):
    edits = links.select("link", F.when(F.col("link") % 10 == 0, True).alias("close"), F.when(F.col("link") % 7 == 2, 0.5).alias("factor"), F.when(F.col("link") % 9 == 3, F.lit(3).cast("long")).alias("new_lanes"), F.when(F.col("link") % 5 == 1, True).alias("signals_off"))
    return op.edited(links, edits)


@query(
    "SELECT a AS from_node, b AS to_node, min(length_m) AS length_m FROM (SELECT from_node AS a, to_node AS b, length_m FROM v_links WHERE class IN ('tertiary', 'residential', 'primary') UNION ALL SELECT to_node, from_node, length_m FROM v_links WHERE class IN ('tertiary', 'residential', 'primary')) GROUP BY 1, 2",
    "v_links",
)
def derive_walk_layer(links):
    return op.two_way(links, ["tertiary", "residential", "primary"])


@query("SELECT link, round(CASE WHEN link % 3 = 0 THEN length_m * CAST(3.6 AS DOUBLE) / 18 ELSE length_m * CAST(3.6 AS DOUBLE) / 15 * CAST(1.2 AS DOUBLE) END, 6) AS cost FROM v_links", "v_links")
def layer_link_costs(links):
    return links.select("link", F.round(op.bike_cost(F.col("length_m"), F.col("link") % 3 == 0), 6).alias("cost"))


@query("SELECT link, round(length_m * CAST(3.6 AS DOUBLE) / (CASE WHEN link % 2 = 0 THEN 600 ELSE length_m * CAST(3.6 AS DOUBLE) / 10 END + 300), 6) AS km_h FROM v_links", "v_links")
def ferry_speed(links):
    return links.select("link", F.round(op.ferry_km_h(F.col("length_m"), F.when(F.col("link") % 2 == 0, 600)), 6).alias("km_h"))


@query(
    """WITH t AS (SELECT i.link AS in_link, o.link AS out_link, i.to_node AS node, i.from_node AS c, o.to_node AS g, count(*) OVER (PARTITION BY i.to_node, i.link) AS w FROM v_links i JOIN v_links o ON i.to_node = o.from_node)
SELECT in_link, out_link, node FROM t WHERE c <> g OR w = 1""",
    "v_links",
)
def turn_table(links):
    return op.turns(links)


@query("SELECT from_node, array_to_string(list(to_node ORDER BY to_node), ' ') AS targets FROM v_links GROUP BY 1", "v_links")
def csr_adjacency(links):
    return op.adjacency(links).select("from_node", F.array_join(F.transform("targets", lambda x: x.cast("string")), " ").alias("targets"))


AUDITED = f"""ad AS (SELECT l.link, from_node, to_node, length_m, round(length_m * CAST(3.6 AS DOUBLE) / km_h, 6) AS free_s, l.class, lanes, CASE WHEN signalised THEN saturation * lanes * 48e-2 ELSE saturation * lanes * 1e0 END AS capacity, signalised,
 round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) / 18, 3) AS straight_m FROM v_links l JOIN df ON df.class = l.class JOIN v_zones a ON a.zone = from_node JOIN v_zones b ON b.zone = to_node),
rc AS (SELECT from_node AS a, from_node AS b FROM ad UNION SELECT rc.a, ad.to_node FROM rc JOIN ad ON ad.from_node = rc.b), pc AS (SELECT count(DISTINCT c) AS pieces FROM (SELECT x.a, min(x.b) AS c FROM rc x JOIN rc y ON x.a = y.b AND x.b = y.a GROUP BY 1)),
cm AS (SELECT 1 AS o, 'strongly connected' AS "check", pieces * 1e0 AS value, pieces <= 1 AS ok, 'fail' AS bad FROM pc UNION ALL SELECT 2, 'no self-loops', count(*), count(*) = 0, 'fail' FROM ad WHERE from_node = to_node
 UNION ALL SELECT 3, 'lengths and times positive', count(*), count(*) = 0, 'fail' FROM ad WHERE length_m <= 0 OR free_s <= 0 UNION ALL SELECT 4, 'length not below the straight line', avg(CASE WHEN length_m / straight_m < 99e-2 THEN 1e0 ELSE 0 END), avg(CASE WHEN length_m / straight_m < 99e-2 THEN 1e0 ELSE 0 END) < 5e-3, 'warn' FROM ad WHERE straight_m > 5)"""


def _audited(links, zones):
    """The links with free-flow seconds, capacities and straight lines at an eighteenth of the zones' distances."""
    at = lambda e: zones.select(F.col("zone").alias(f"{e}_node"), F.col("lon").alias(f"{e}_lon"), F.col("lat").alias(f"{e}_lat"))
    metres = op.haversine(F.col("from_lon"), F.col("from_lat"), F.col("to_lon"), F.col("to_lat"))
    rows = links.join(F.broadcast(op.class_defaults(links.sparkSession)), "class").join(at("from"), "from_node").join(at("to"), "to_node")
    capacity = F.when(F.col("signalised"), F.col("saturation") * F.col("lanes") * 0.48).otherwise(F.col("saturation") * F.col("lanes") * 1.0)
    return rows.withColumns({"free_s": F.round(F.col("length_m") * 3.6 / F.col("km_h"), 6), "capacity": capacity, "straight_m": F.round(metres / 18, 3)})


@query(
    f"""WITH RECURSIVE {DEFAULTS}, {AUDITED}, st AS (SELECT least(from_node, to_node) AS a, greatest(from_node, to_node) AS b, min(length_m) AS m FROM ad GROUP BY 1, 2), en AS (SELECT a AS node, b AS other, m FROM st UNION ALL SELECT b, a, m FROM st), dg AS (SELECT node, count(*) AS d FROM en GROUP BY 1),
nr AS (SELECT DISTINCT en.node FROM en JOIN dg ON dg.node = en.other WHERE m <= 500 AND d >= 3), nd AS (SELECT node, (SELECT count(*) FROM ad WHERE to_node = node) AS ins, (SELECT count(*) FROM ad WHERE from_node = node) AS outs, (SELECT count(*) FROM ad WHERE to_node = node AND signalised) AS held, d FROM dg),
sp AS (SELECT replace(class, '_link', '') AS base, CASE WHEN count(*) FILTER (WHERE NOT signalised) >= 20 THEN quantile_cont(length_m * 36e-1 / free_s, 0.5) FILTER (WHERE NOT signalised) ELSE quantile_cont(length_m * 36e-1 / free_s, 0.5) END AS v FROM ad GROUP BY class HAVING count(*) >= 20),
sr(base, lo, hi) AS (VALUES {", ".join(f"('{c}', {a}, {b})" for c, (a, b) in op.CLASS_SPEEDS.items())}), x AS (SELECT * FROM cm
 UNION ALL SELECT 5, 'very short links', avg(CASE WHEN length_m < 5 THEN 1e0 ELSE 0 END), avg(CASE WHEN length_m < 5 THEN 1e0 ELSE 0 END) < 3e-2, 'warn' FROM ad
 UNION ALL SELECT 6, 'capacity per lane plausible', avg(CASE WHEN capacity / lanes BETWEEN 500 AND 2400 THEN 0 ELSE 1e0 END), avg(CASE WHEN capacity / lanes BETWEEN 500 AND 2400 THEN 0 ELSE 1e0 END) < 2e-2, 'warn' FROM ad
 UNION ALL SELECT 7, 'lanes per direction', count(*), count(*) = 0, 'warn' FROM ad WHERE lanes > 6
 UNION ALL SELECT 8, 'parallel links', (count(*) - count(DISTINCT from_node * 1000 + to_node)) * 1e0 / count(*), (count(*) - count(DISTINCT from_node * 1000 + to_node)) * 1e0 / count(*) < 1e-2, 'warn' FROM ad
 UNION ALL SELECT 9, 'speeds plausible by class', count(*), count(*) = 0, 'warn' FROM sp JOIN sr USING (base) WHERE v < lo OR v > hi
 UNION ALL SELECT 10, 'dead ends', avg(CASE WHEN ins = 1 AND outs = 1 AND d = 1 THEN 1e0 ELSE 0 END), avg(CASE WHEN ins = 1 AND outs = 1 AND d = 1 THEN 1e0 ELSE 0 END) < 25e-2, 'warn' FROM nd
 UNION ALL SELECT 11, 'stop lines stop one direction', coalesce(avg(CASE WHEN held = ins THEN 1e0 ELSE 0 END), 0), coalesce(avg(CASE WHEN held = ins THEN 1e0 ELSE 0 END), 0) < 1e-1, 'warn' FROM nd WHERE held > 0 AND ins >= 2 AND d = 2 AND node IN (SELECT node FROM nr))
SELECT 'road' AS layer, "check", round(value, 6) AS value, CASE WHEN ok THEN 'pass' ELSE bad END AS status FROM x""",
    "v_links",
    "v_zones",
)
def network_check(links, zones):
    """A stop line is within 500 m of its junction here, the links being long."""
    rows = _audited(links, zones)
    return op.audit(rows, strong_components(rows), 500.0)


@query(
    f"""WITH RECURSIVE {DEFAULTS}, {AUDITED} SELECT 'walk' AS layer, "check", round(value, 6) AS value, CASE WHEN ok THEN 'pass' ELSE bad END AS status FROM (SELECT * FROM cm UNION ALL
 SELECT 5, 'speed plausible', quantile_cont(3 + link % 4, 0.5), quantile_cont(3 + link % 4, 0.5) BETWEEN 25e-1 AND 7, 'warn' FROM ad WHERE class <> 'ferry')""",
    "v_links",
    "v_zones",
)
def network_check_layer(links, zones):
    rows = _audited(links, zones).withColumn("km_h", 3 + F.col("link") % 4)
    return op.audit_layer(rows, strong_components(rows), "walk")


@query("SELECT class, quantile_cont(length_m, 0.5) AS median_m, CAST(count(*) AS BIGINT) AS links FROM v_links GROUP BY 1", "v_links")
def class_length_medians(links):
    return op.class_medians(links)


@query(
    """SELECT a.zone AS o, b.zone AS d, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 3) AS metres FROM v_zones a JOIN v_zones b ON b.zone = (a.zone * 7 + 3) % 25""",
    "v_zones",
)
def zone_haversine(zones):
    d = zones.select(F.col("zone").alias("d"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return zones.join(d, F.col("d") == (F.col("zone") * 7 + 3) % 25).select(F.col("zone").alias("o"), "d", F.round(op.haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 3).alias("metres"))


@query(
    """WITH s AS (SELECT zone // 5 AS line, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM v_zones WINDOW w AS (PARTITION BY zone // 5 ORDER BY zone))
SELECT line, round(sum(2 * 6371008.8 * asin(sqrt(pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2)))), 3) AS metres FROM s GROUP BY 1""",
    "v_zones",
)
def polyline_lengths(zones):
    return op.polyline_metres(zones.withColumn("line", F.expr("zone div 5")), "line", "zone")


@query("SELECT coalesce(a.n, b.n) AS node, coalesce(b.c, 0) AS ins, coalesce(a.c, 0) AS outs FROM (SELECT from_node AS n, count(*) AS c FROM v_links GROUP BY 1) a FULL JOIN (SELECT to_node AS n, count(*) AS c FROM v_links GROUP BY 1) b ON a.n = b.n", "v_links")
def node_degrees(links):
    return op.degrees(links)


@query(
    """WITH RECURSIVE e AS (SELECT from_node AS a, to_node AS b FROM v_links UNION SELECT to_node, from_node FROM v_links), r AS (SELECT a AS node, a AS l FROM e UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.node)
SELECT node, min(l) AS component FROM r GROUP BY 1""",
    "v_links",
)
def network_components(links):
    return op.components(links)


@query(
    """WITH RECURSIVE r AS (SELECT zone AS origin, zone AS node, CAST(0 AS BIGINT) AS cost FROM v_zones UNION SELECT origin, to_node, cost + length_m FROM r JOIN v_links ON node = from_node WHERE cost + length_m <= 2500)
SELECT origin, node, min(cost) AS cost FROM r GROUP BY 1, 2""",
    "v_zones",
    "v_links",
)
def bounded_reach(zones, links):
    """From every zone."""
    return op.distances(links, zones.select(F.col("zone").alias("origin")), "length_m", 2500)


@query(
    """WITH RECURSIVE r AS (SELECT zone AS origin, zone AS node, CAST(0 AS BIGINT) AS cost FROM v_zones UNION SELECT origin, to_node, cost + length_m FROM r JOIN v_links ON node = from_node WHERE cost + length_m <= 9000)
SELECT origin, node AS destination, CAST(min(cost) AS DOUBLE) AS cost FROM r GROUP BY 1, 2""",
    "v_zones",
    "v_links",
)
def shortest_path_costs(zones, links):
    """From every zone to every zone."""
    d = zones.select(F.col("zone").alias("destination"))
    return op.shortest_routes(links, zones.select(F.col("zone").alias("origin")).crossJoin(d), "length_m").select("origin", "destination", "cost")  # the pairs asked for


@query(None, "v_links", "v_od")
def static_equilibrium(links, od):
    net = links.select("link", "from_node", "to_node", (F.col("length_m") / 10).alias("free_s"), (F.col("lanes") * 9000).cast("double").alias("capacity"))
    demand = od.filter("o <> d").select(F.col("o").alias("origin"), F.col("d").alias("destination"), (F.col("sevenths") / 7).alias("people"))
    return op.static_assignment(net, demand)


@query("SELECT a.n AS from_node, a.n + s.d AS to_node, CAST(100 AS BIGINT) AS length_m FROM (SELECT range AS n FROM range(144)) a, (VALUES (1), (-1), (12), (-12)) s(d) WHERE a.n + s.d BETWEEN 0 AND 143 AND (abs(s.d) = 12 OR a.n // 12 = (a.n + s.d) // 12)")
def manhattan_grid(spark, sf_dir):
    return op.grid(spark, 12, 100)


@query(
    """WITH p AS (SELECT c_custkey AS point, (c_custkey * 37) % 500 AS x, (c_custkey * 91) % 500 AS y FROM customer), n AS (SELECT s_suppkey AS node, (s_suppkey * 53) % 500 AS nx, (s_suppkey * 29) % 500 AS ny FROM supplier)
SELECT point, node, d2 FROM (SELECT point, node, d2, row_number() OVER (PARTITION BY point ORDER BY d2, node) AS r FROM (SELECT point, node, (x - nx) * (x - nx) + (y - ny) * (y - ny) AS d2 FROM p, n)) WHERE r = 1"""
)
def snap_nearest_node(spark, sf_dir):
    """The nearest of all nodes."""
    return op.nearest_node(*_points(spark, sf_dir), 100)


def _points(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("point"), (F.col("c_custkey") * 37 % 500).alias("x"), (F.col("c_custkey") * 91 % 500).alias("y"))
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") * 53 % 500).alias("x"), (F.col("s_suppkey") * 29 % 500).alias("y"))
    return p, n
