"""Queries on mode chains: of a trip, and over a traveller's day."""

from __future__ import annotations

from pyspark.sql import functions as F

from viatica.operators import chains
from viatica.operators.demand import chained_origins
from viatica.plans.registry import query

#: By user class; whole quarters, so that sums are exact in any order.
COEFFICIENTS = {
    "c0": {"in_vehicle_s": 1.0, "walk_s": 1.5, "wait_s": 2.0, "transfers": 3.0, "money": 4.0, "length_m": 0.25, "bike_mixed_m": 0.5, "car": 2.0, "bike": 1.0},
    "c1": {"in_vehicle_s": 1.25, "walk_s": 2.0, "wait_s": 1.0, "transfers": 5.0, "money": 1.0, "transit": 3.0},
    "c2": {"walk_s": 0.5, "bike_mixed_m": 1.0, "bike_lane_m": 0.25, "walk": 0.5},
}
WEIGHTS = ", ".join(f"('{c}', " + ", ".join(str(own.get(n, least)) for n, _, least in chains.ATTRIBUTES) + ", " + ", ".join(str(own.get(m, 0.0)) for m in chains.MODES) + ")" for c, own in {**COEFFICIENTS, "c3": {}}.items())
CHAINS = f"""w(class, w1, w2, w3, w4, w5, w6, w7, w8, w9, w10, k1, k2, k3, k4) AS (VALUES {WEIGHTS}),
t AS (SELECT traveller_id AS traveller, trip_seq AS seq, coalesce(lag(d_zone) OVER (PARTITION BY traveller_id ORDER BY trip_seq), o_zone) AS origin, d_zone AS destination, departure_s, user_class AS class, traveller_id % 3 <> 0 AS owns_car, traveller_id % 2 = 0 AS owns_bike FROM v_trips),
s AS (SELECT *, abs(origin % 5 - destination % 5) + abs(origin // 5 - destination // 5) AS s FROM t),
a AS (SELECT *, 'car' AS mode, 1 AS n, 60 * (2 + 3 * s) AS x1, 0 AS x2, 0 AS x3, 60 * (destination % 3) AS x4, 0 AS x5, CAST(s AS DOUBLE) / 4 AS x6, 2000 * s AS x7, 0 AS x8, 0 AS x9 FROM s WHERE owns_car
UNION ALL SELECT *, 'bike', 2, 60 * (1 + 6 * s), 0, 0, 60, 0, 0, 2000 * s, 1000 * s, 1000 * s FROM s WHERE owns_bike
UNION ALL SELECT *, 'walk', 3, 0, 1080 * s, 0, 0, 0, 0, 2000 * s, 0, 0 FROM s
UNION ALL SELECT *, 'transit', 4, 240 * s, 240, 60 * (2 + departure_s // 600 % 3), 0, CASE WHEN s > 3 THEN 1 ELSE 0 END, 0.5, 2000 * s, 0, 0 FROM s),
c AS (SELECT a.*, w1 * x1 / 60 + w2 * x2 / 60 + w3 * x3 / 60 + w4 * x4 / 60 + w5 * x5 + w6 * x6 + w7 * x7 / 1000 + w8 * x8 / 1000 + w9 * x9 / 1000 + CASE n WHEN 1 THEN k1 WHEN 2 THEN k2 WHEN 3 THEN k3 ELSE k4 END AS cost FROM a JOIN w ON w.class = a.class)"""


def _alternatives(trips):
    """Every trip by car, bike, foot and transit, between chained ends."""
    t = chained_origins(trips)
    k = F.col("traveller_id")
    s = F.abs(F.col("origin") % 5 - F.col("destination") % 5) + F.abs(F.expr("origin div 5") - F.expr("destination div 5"))
    rows = t.select(k.alias("traveller"), F.col("trip_seq").alias("seq"), "origin", F.col("d_zone").alias("destination"), "departure_s", F.col("user_class").alias("class"), (k % 3 != 0).alias("owns_car"), (k % 2 == 0).alias("owns_bike")).withColumn("s", s)
    s = F.col("s")
    by = {
        "car": {"in_vehicle_s": 60 * (2 + 3 * s), "parking_s": 60 * (F.col("destination") % 3), "money": s / 4},
        "bike": {"in_vehicle_s": 60 * (1 + 6 * s), "parking_s": F.lit(60), "bike_mixed_m": 1000 * s, "bike_lane_m": 1000 * s},
        "walk": {"walk_s": 1080 * s},
        "transit": {"in_vehicle_s": 240 * s, "walk_s": F.lit(240), "wait_s": 60 * (2 + F.expr("departure_s div 600") % 3), "transfers": (s > 3).cast("int"), "money": F.lit(0.5)},
    }
    each = lambda mode, own: F.struct(F.lit(mode).alias("mode"), *[own.get(n, 2000 * s if n == "length_m" else F.lit(0)).cast("double").alias(n) for n, _, _ in chains.ATTRIBUTES])
    return chains.with_costs(chains.feasible(rows.withColumn("x", F.explode(F.array(*[each(m, own) for m, own in by.items()]))).select("*", "x.*").drop("x", "s")), COEFFICIENTS)


@query(f"WITH {CHAINS} SELECT traveller, seq, mode, cost, CAST(row_number() OVER (PARTITION BY traveller, seq ORDER BY cost, n) AS INTEGER) AS rank FROM c", "v_trips")
def chain_search(trips):
    """Every trip's feasible chains, best first."""
    return chains.best_first(_alternatives(trips), "traveller", "seq").select("traveller", "seq", "mode", "cost", "rank")


@query(
    f"""WITH RECURSIVE {CHAINS}, h AS (SELECT traveller, arg_min(origin, seq) AS home, max(seq) AS last FROM t GROUP BY 1),
d AS (SELECT traveller, CAST(-1 AS BIGINT) AS seq, home AS car_at, home AS bike_at, CAST(0 AS DOUBLE) AS cost FROM h
UNION SELECT d.traveller, c.seq, CASE WHEN mode = 'car' THEN destination ELSE car_at END, CASE WHEN mode = 'bike' THEN destination ELSE bike_at END, d.cost + c.cost FROM d JOIN c ON c.traveller = d.traveller AND c.seq = d.seq + 1 AND (mode <> 'car' OR car_at = origin) AND (mode <> 'bike' OR bike_at = origin))
SELECT d.traveller, min(cost) AS day_cost, min(last) + 1 AS trips FROM d JOIN h ON h.traveller = d.traveller AND seq = last AND car_at = home AND bike_at = home GROUP BY 1""",
    "v_trips",
)
def day_chains(trips):
    """The cheapest day of every traveller, its vehicles left where they were taken to and home in the end; against all chains of modes."""
    found = chains.day_chains(_alternatives(trips))
    return found.groupBy("traveller").agg(F.round(F.sum("cost"), 9).alias("day_cost"), F.count("*").alias("trips"))
