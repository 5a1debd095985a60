"""Queries on walks over a layer, by the network that grows with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from viatica.operators import walks
from viatica.plans.registry import query

#: Walks from the nodes of rows (node): all that can be walked within 1,800 seconds.
REACH = """WITH RECURSIVE pk AS ({rows}), r AS (SELECT DISTINCT node AS o, node AS n, CAST(0 AS BIGINT) AS s FROM pk UNION SELECT o, to_node, s + length_m * 72 // 100 FROM r JOIN v_roads ON from_node = n WHERE s + length_m * 72 // 100 <= 1800), b AS (SELECT o, n, CAST(min(s) AS DOUBLE) AS walk_s FROM r GROUP BY 1, 2)"""
PARKED = "SELECT s_suppkey AS parking, (s_suppkey * 37 + 11) % (SELECT count(*) FROM part) AS node FROM supplier"
STOPS = "st AS (SELECT p_partkey // 9 AS stop, p_partkey AS node FROM part WHERE p_partkey % 9 = 4)"


def _layer(links):
    return links.withColumn("seconds", F.expr("length_m * 72 div 100"))


def _places(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = parts.count()
    k = F.col("s_suppkey")
    parked = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("parking"), ((k * 37 + 11) % n).alias("node"))
    return parked, parts.filter("p_partkey % 9 = 4").select(F.expr("p_partkey div 9").alias("stop"), F.col("p_partkey").alias("node"))


@query(REACH.format(rows=PARKED) + f", {STOPS} SELECT parking, stop, walk_s FROM (SELECT pk.parking, st.stop, walk_s, row_number() OVER (PARTITION BY parking ORDER BY walk_s, stop) AS k FROM pk JOIN b ON b.o = pk.node JOIN st ON st.node = b.n) WHERE k <= 5")
def parking_stop_walks(spark, sf_dir):
    """Of every parking the five nearest stops on foot."""
    from viatica.sources.bridge import view

    parked, stops = _places(spark, sf_dir)
    return walks.parkings_with_stops(_layer(view(spark, sf_dir, "v_roads")), parked, stops, 1800, most=5)[0]


@query(REACH.format(rows="SELECT node FROM st").replace("RECURSIVE pk", f"RECURSIVE {STOPS}, pk") + " SELECT x.stop AS a, y.stop AS b, walk_s FROM st x JOIN b ON b.o = x.node JOIN st y ON y.node = b.n WHERE x.stop <> y.stop")
def stop_walks(spark, sf_dir):
    """All stops to all others within a walk over the layer."""
    from viatica.sources.bridge import view

    return walks.stop_footpaths(_layer(view(spark, sf_dir, "v_roads")), _places(spark, sf_dir)[1], 1800)
