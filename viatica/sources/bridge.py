"""Mobility-shaped views of the driver's star-schema tables.

One text a view serves both engines: `views` runs it in Spark over DataFrames, `with_views` puts it in front of a DuckDB
query. Integer arithmetic only, so both agree to the last digit. {div} is integer division, {n} numbers from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    "v_zones": "SELECT CAST(n_nationkey AS BIGINT) AS zone, 4e0 + 1e-1 * (n_nationkey % 5) AS lon, 52e0 + 1e-1 * (n_nationkey {div} 5) AS lat FROM nation",
    "v_trips": """SELECT event_id, user_id * 100 + day(ts) AS traveller_id,
  CAST(row_number() OVER (PARTITION BY user_id * 100 + day(ts) ORDER BY ts, event_id) - 1 AS BIGINT) AS trip_seq,
  CAST(3600 * hour(ts) + 60 * minute(ts) + second(ts) AS BIGINT) AS departure_s, event_id % 25 AS o_zone,
  (7 * event_id + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) % 25 AS d_zone,
  concat('c', CAST(user_id % 4 AS STRING)) AS user_class,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 1 + user_id % 3 END AS weight,
  CASE event_type WHEN 'click' THEN 'car' WHEN 'view' THEN 'bike' WHEN 'signup' THEN 'walk' WHEN 'purchase' THEN 'transit' END AS mode
FROM events""",
    "v_persons": "SELECT c_custkey * 100 + 1 + c_nationkey AS traveller_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 3 = 0 END AS owns_car FROM customer",
    "v_od": """SELECT CAST(c_nationkey AS BIGINT) AS o, CAST(s_nationkey AS BIGINT) AS d, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sevenths
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "v_links": """SELECT CAST(row_number() OVER (ORDER BY f, t) - 1 AS BIGINT) AS link, f AS from_node, t AS to_node, 300 + 100 * ((7 * f + 13 * t) % 9) AS length_m, 1 + (f + t) % 2 AS lanes,
  CASE (f * t) % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'tertiary' ELSE 'residential' END AS class, t % 6 = 0 AS signalised
FROM (SELECT CAST(n_nationkey AS BIGINT) AS f, CAST(n_nationkey + s AS BIGINT) AS t FROM nation CROSS JOIN (VALUES (1), (-1), (5), (-5)) AS steps(s)
  WHERE n_nationkey + s BETWEEN 0 AND 24 AND (abs(s) = 5 OR n_nationkey {div} 5 = (n_nationkey + s) {div} 5)) AS pairs""",
    "v_traversals": """SELECT l_orderkey AS vehicle, l_partkey % 80 AS link, CAST(27000 + (37 * l_orderkey + 11 * l_partkey + 5 * l_suppkey) % 7200 AS BIGINT) AS enter_s,
  CAST(27000 + (37 * l_orderkey + 11 * l_partkey + 5 * l_suppkey) % 7200 + 2 * CAST(l_quantity AS BIGINT) + 5 AS BIGINT) AS exit_s, CAST(1 + l_linenumber {div} 7 AS BIGINT) AS pcu,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) - 1 AS BIGINT) AS pos
FROM lineitem""",
    "v_trip_results": """SELECT o_orderkey AS trip, o_custkey AS traveller_id, 1 + o_custkey % 5 AS weight, CAST(25200 + (97 * o_orderkey) % 7200 AS BIGINT) AS departure_s, CAST(c_nationkey AS BIGINT) AS o_zone,
  (o_orderkey * 11) % 25 AS d_zone, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'truncated' ELSE 'no_feasible_path' END AS outcome,
  CASE WHEN o_orderstatus = 'F' THEN 120 + CAST(floor(o_totalprice) AS BIGINT) % 3600 END AS travel_time_s,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'car' WHEN '2' THEN 'bike' WHEN '3' THEN 'walk' WHEN '4' THEN 'transit' ELSE 'car_transit' END AS mode
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_alternatives": """SELECT l_orderkey AS situation,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) - 1 AS BIGINT) AS alternative,
  CAST(l_quantity AS DOUBLE) AS time_min, l_extendedprice / 1e4 AS cost_eur, CAST(l_linenumber % 3 AS BIGINT) AS transfers, l_partkey % 3 AS nest, l_suppkey % 4 AS class,
  (l_partkey * 31 + l_suppkey) % 101 AS turn
FROM lineitem""",
    "v_routes": """SELECT l_orderkey {div} 4 AS pair, l_orderkey % 4 AS route, l_partkey % 80 AS link,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) - 1 AS BIGINT) AS pos
FROM lineitem""",
    "v_calls": """SELECT CAST(n_nationkey {div} 5 AS BIGINT) AS line, id * 5 + n_nationkey {div} 5 AS run, CAST(n_nationkey AS BIGINT) AS stop, CAST(n_nationkey % 5 AS BIGINT) AS pos,
  CAST(21600 + 600 * id + 120 * (n_nationkey % 5) AS BIGINT) AS arrive_s, CAST(21600 + 600 * id + 120 * (n_nationkey % 5) + 20 AS BIGINT) AS depart_s FROM nation CROSS JOIN {numbers}""",
    # a network, places and trips that grow with the tables: 40 nodes a row, a place every 20 nodes, trips to places near by
    "v_roads": """SELECT CAST(4 * f + k AS BIGINT) AS link, CAST(f AS BIGINT) AS from_node, CAST(f + s AS BIGINT) AS to_node, CAST(300 + 100 * ((7 * f + 13 * (f + s)) % 9) AS BIGINT) AS length_m, CAST(1 + (f + k) % 2 AS BIGINT) AS lanes, CAST((f + 2 * k) % 3 AS BIGINT) AS toll,
  CAST((f + s) % 40 AS BIGINT) AS x, CAST((f + s) {div} 40 AS BIGINT) AS y, CAST(f % 40 AS BIGINT) AS from_x, CAST(f {div} 40 AS BIGINT) AS from_y
FROM (SELECT p_partkey AS f FROM part ) AS nodes CROSS JOIN (VALUES (0, 1), (1, -1), (2, 40), (3, -40)) AS steps(k, s) WHERE f + s >= 0 AND f + s < (SELECT count(*) FROM part ) AND (abs(s) = 40 OR f {div} 40 = (f + s) {div} 40)""",
    "v_journeys": """SELECT o_orderkey AS trip, CAST(20 * (o_custkey % (SELECT count(*) FROM supplier )) AS BIGINT) AS origin,
  CAST(20 * ((o_custkey % (SELECT count(*) FROM supplier ) + 1 + o_orderkey % 7) % (SELECT count(*) FROM supplier )) AS BIGINT) AS destination,
  CAST(25200 + (97 * o_orderkey) % 7200 AS BIGINT) AS departure_s, CAST(1 + o_custkey % 5 AS BIGINT) AS people, CAST(o_custkey % 3 AS BIGINT) AS class FROM orders""",
    "v_parkings": "SELECT s_suppkey AS parking, CAST(s_nationkey AS BIGINT) AS zone, 1 + (7 * s_suppkey) % 10 AS capacity FROM supplier",
    "v_parking_events": """SELECT l_suppkey AS parking, CAST(27000 + (37 * l_orderkey + 11 * l_partkey + 5 * l_suppkey) % 7200 AS BIGINT) AS arrive_s,
  CAST(27000 + (37 * l_orderkey + 11 * l_partkey + 5 * l_suppkey) % 7200 + 60 * CAST(l_quantity AS BIGINT) AS BIGINT) AS leave_s FROM lineitem""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables in sf_dir; only the tables it names are opened."""
    text = VIEWS[name].format(div="div", numbers="(SELECT id FROM range(97)) AS numbers")
    words = set(text.replace("(", " ").replace(")", " ").split())
    args = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if t in words}
    for t in args:
        text = "\n".join(_named(line, t) for line in text.split("\n"))
    return spark.sql(text, **args)


def _named(line: str, table: str) -> str:
    for word in ("FROM", "JOIN"):
        line = line.replace(f"{word} {table} ", f"{word} {{{table}}} ").replace(f"{word} {table}\n", f"{word} {{{table}}}\n")
        if line.endswith(f"{word} {table}"):
            line = line[: -len(table)] + f"{{{table}}}"
    return line


def with_views(query: str) -> str:
    """query for DuckDB, with the views it names in front."""
    used = [v for v in VIEWS if v in query]
    texts = [f"{v} AS ({VIEWS[v].format(div='//', numbers='(SELECT range AS id FROM range(97)) AS numbers')})" for v in used]
    own = query.strip()
    if own.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*texts, own[len("WITH RECURSIVE ") :]])
    if own.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*texts, own[5:]])
    return ("WITH " + ",\n".join(texts) + "\n" if texts else "") + own
