"""Queries on tables frozen and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from viatica.functions.lineage import shared_dir
from viatica.plans.registry import query
from viatica.sources import frozen


@query(
    """WITH dk AS (SELECT zone, min(parking) AS dock FROM v_parkings GROUP BY 1)
SELECT t.trip, CAST(t.traveller_id AS VARCHAR) AS traveller_id, row_number() OVER (PARTITION BY t.traveller_id ORDER BY t.departure_s, t.trip) - 1 AS trip_seq, 's' || t.o_zone % 3 AS service, t.weight, CAST(t.departure_s + 60 AS DOUBLE) AS request_s, t.o_zone AS origin_node, t.d_zone AS destination_node,
CAST(a.dock AS VARCHAR) AS dock_from, CAST(b.dock AS VARCHAR) AS dock_to, CAST(300 + 17 * (a.dock + b.dock) % 900 AS DOUBLE) / 8 AS ride_s, CAST(30 + b.dock % 90 AS DOUBLE) AS egress_s, CAST(t.trip % 4 AS DOUBLE) / 4 AS assumed_extra_walk_s
FROM v_trip_results t JOIN dk a ON a.zone = t.o_zone JOIN dk b ON b.zone = t.d_zone WHERE t.mode IN ('bike', 'walk')""",
    "v_trip_results",
    "v_parkings",
)
def frozen_legs(trips, parkings):
    """Trips by bike or on foot as legs between docks, frozen in the shared folder and read back behind their fingerprint."""
    docks = parkings.groupBy("zone").agg(F.min("parking").alias("dock"))
    a, b = docks.select(F.col("zone").alias("o_zone"), F.col("dock").alias("a")), docks.select(F.col("zone").alias("d_zone"), F.col("dock").alias("b"))
    number = F.expr("row_number() OVER (PARTITION BY traveller_id ORDER BY departure_s, trip) - 1")
    legs = trips.filter("mode in ('bike', 'walk')").join(a, "o_zone").join(b, "d_zone").select(
        "trip", F.col("traveller_id").cast("string").alias("traveller_id"), number.alias("trip_seq"), F.concat(F.lit("s"), (F.col("o_zone") % 3).cast("string")).alias("service"), "weight", (F.col("departure_s") + 60).alias("request_s"), F.col("o_zone").alias("origin_node"), F.col("d_zone").alias("destination_node"),
        F.col("a").alias("dock_from"), F.col("b").alias("dock_to"), ((300 + 17 * (F.col("a") + F.col("b")) % 900) / 8).alias("ride_s"), (30 + F.col("b") % 90).alias("egress_s"), (F.col("trip") % 4 / 4).alias("assumed_extra_walk_s"),
    )
    spark = trips.sparkSession
    folder = f"{shared_dir(spark)}/frozen-{uuid.uuid4().hex}"
    frozen.write_legs(legs, folder, {"day": "0"})
    return frozen.read_legs(spark, folder, {"day": "0"})


@query(
    """WITH n AS (SELECT to_node AS node, any_value(x) AS x, any_value(y) AS y FROM v_roads GROUP BY 1) SELECT r.link, r.from_node, r.to_node, r.length_m, a.x AS from_x, a.y AS from_y, b.x AS to_x, b.y AS to_y
FROM v_roads r JOIN n a ON a.node = r.from_node JOIN n b ON b.node = r.to_node""",
    "v_roads",
)
def network_cached(links):
    """Nodes and links frozen together, read back by whom they are asked for with the fingerprint of what they came from."""
    spark = links.sparkSession
    folder = f"{shared_dir(spark)}/frozen-{uuid.uuid4().hex}"
    nodes = links.groupBy(F.col("to_node").alias("node")).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    source = frozen.fingerprint(links)
    frozen.write_frozen({"nodes": nodes, "links": links.select("link", "from_node", "to_node", "length_m")}, folder, "network", source)
    back = frozen.read_frozen(spark, folder, "network", source)
    a, b = (back["nodes"].select(F.col("node").alias(f"{e}_node"), F.col("x").alias(f"{e}_x"), F.col("y").alias(f"{e}_y")) for e in ("from", "to"))
    return back["links"].join(a, "from_node").join(b, "to_node")
