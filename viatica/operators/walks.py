"""Walks over a layer between many places at once: stops to stops, parkings to stops, points to whatever is near.

Places are snapped to the layer's nodes by a grid join. Of the different nodes walks start from, each grows one tree up to the longest walk, which only looks at what lies within it, and reads off
the nodes where a walk may end; places at one node share its tree by a join. So work grows with the places' nodes and the walk's reach, not with the pairs of places or the layer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viatica.operators.network import distances
from viatica.operators.routing import MOST_LINKS
from viatica.operators.trees import Shared, Tree, roads_of, spread, times_of


def snapped(places: DataFrame, nodes: DataFrame, most_m: float) -> DataFrame:
    """(place, node, snap_m): the nearest node (node, x, y) of each place (place, x, y), if one lies within `most_m`; the least of equals. Cells of that size, so a place meets its nine alone."""
    cell = lambda df: df.withColumns({"cx": F.floor(F.col("x") / most_m), "cy": F.floor(F.col("y") / most_m)})
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = cell(places.select("place", "x", "y")).withColumn("w", around).select("place", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("cx") + F.col("w.i")).alias("cx"), (F.col("cy") + F.col("w.j")).alias("cy"))
    far = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    met = near.join(cell(nodes.select("node", "x", "y")), ["cx", "cy"]).withColumn("snap_m", far).filter(F.col("snap_m") <= most_m)
    return met.groupBy("place").agg(F.min(F.struct("snap_m", "node")).alias("x")).select("place", "x.node", "x.snap_m")


def between_nodes(layer: DataFrame, starts: DataFrame, ends: DataFrame, most_s: float, seconds: str = "seconds", most_links: int = MOST_LINKS) -> DataFrame:
    """(from_node, to_node, walk_s): the walks of at most `most_s` from the nodes of `starts` to those of `ends` (node), over the layer's links (link, from_node, to_node, `seconds`, length_m). From a node to itself it is no walk at all.

    A layer of more than `most_links` is not broadcast: walks grow from all starts at once, a join a turn, as many turns as a walk has links.
    """
    spark = layer.sparkSession
    there = ends.select("node").filter("node is not null").distinct()
    own = starts.select("node").filter("node is not null").distinct()
    stays = own.join(there, "node").select(F.col("node").alias("from_node"), F.col("node").alias("to_node"), F.lit(0.0).alias("walk_s"))
    if layer.limit(most_links + 1).count() > most_links:
        found = distances(layer, own.select(F.col("node").alias("origin")), seconds, most_s, "double").filter("origin <> node")
        return found.join(there, "node").select(F.col("origin").alias("from_node"), F.col("node").alias("to_node"), F.col("cost").alias("walk_s")).unionByName(stays)
    roads = roads_of(layer, seconds)
    goal = np.zeros(len(roads.nodes), bool)
    known = spark.createDataFrame(pd.DataFrame({"node": roads.nodes}))
    hit = there.join(F.broadcast(known), "node", "left_semi").toPandas()["node"].to_numpy(np.int64)  # no more than the layer has nodes, which are broadcast
    goal[np.searchsorted(roads.nodes, hit)] = True
    shared = spark.sparkContext.broadcast((Shared(roads, times_of(roads, None, 1)), goal))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, goal = shared.value
        for rows in frames:
            out = []
            for node in rows["node"].tolist():
                origin = s.roads.node(node)
                if origin >= 0:
                    tree = Tree(s.roads, s.times, origin, 0.0, None, {-1}, bound=most_s)
                    out += [(node, int(s.roads.nodes[n]), float(tree.known[k][0])) for n, k in tree.best.items() if goal[n] and n != origin]
            yield pd.DataFrame(out, columns=["from_node", "to_node", "walk_s"])

    walks = own.repartition(spread(own), "node").mapInPandas(run, "from_node long, to_node long, walk_s double")
    return walks.unionByName(stays)


def walks(layer: DataFrame, starts: DataFrame, ends: DataFrame, most_s: float, seconds: str = "seconds", most: int | None = None, same: Column | None = None) -> DataFrame:
    """(start, end, walk_s) between places that stand at nodes, starts (start, node) and ends (end, node): all within `most_s`, or the `most` nearest ends of each start, the least of equals. `same` tells pairs that are no walk."""
    nodes = between_nodes(layer, starts, ends, most_s, seconds)
    pairs = starts.select("start", F.col("node").alias("from_node")).join(nodes, "from_node").join(ends.select("end", F.col("node").alias("to_node")), "to_node")
    if same is not None:
        pairs = pairs.filter(~same)
    out = pairs.select("start", "end", "walk_s")
    if most is None:
        return out
    rank = F.row_number().over(Window.partitionBy("start").orderBy("walk_s", "end"))
    return out.withColumn("n", rank).filter(F.col("n") <= most).drop("n")


def stop_footpaths(layer: DataFrame, stops: DataFrame, most_s: float, seconds: str = "seconds") -> DataFrame:
    """(a, b, walk_s) between different stops (stop, node) over a layer, in both directions as the layer has them."""
    starts, ends = (stops.select(F.col("stop").alias(c), "node") for c in ("start", "end"))
    found = walks(layer, starts, ends, most_s, seconds, same=F.col("start") == F.col("end"))
    return found.select(F.col("start").alias("a"), F.col("end").alias("b"), "walk_s")


def parkings_with_stops(layer: DataFrame, parkings: DataFrame, stops: DataFrame, most_s: float, seconds: str = "seconds", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(parking, stop, walk_s) of parkings (parking, node) with a stop within the walk, and how many are kept and not: (off_layer: no node, no_stop, kept)."""
    there = parkings.filter("node is not null")
    found = walks(layer, there.select(F.col("parking").alias("start"), "node"), stops.select(F.col("stop").alias("end"), "node"), most_s, seconds, most)
    links = found.select(F.col("start").alias("parking"), F.col("end").alias("stop"), "walk_s")
    served = parkings.join(links.select("parking").distinct().withColumn("served", F.lit(True)), "parking", "left")
    none, has = F.col("node").isNull(), F.col("served").isNotNull()
    report = served.agg(F.count(F.when(none, 1)).alias("off_layer"), F.count(F.when(~none & ~has, 1)).alias("no_stop"), F.count(F.when(~none & has, 1)).alias("kept"))
    return links, report
