"""Queries on scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from viatica.functions import geo
from viatica.plans.registry import query

UTM = """u AS (SELECT *, 6378137 / sqrt(1 - e2 * pow(sin(phi), 2)) AS n, pow(tan(phi), 2) AS t, e2 / (1 - e2) * pow(cos(phi), 2) AS c, cos(phi) * lam AS a, e2 / (1 - e2) AS ep FROM
 (SELECT zone, radians(lat) AS phi, radians(lon - 3) AS lam, f * (2 - f) AS e2 FROM v_zones, (SELECT 1e0 / CAST(298.257223563 AS DOUBLE) AS f))),
m AS (SELECT *, 6378137 * ((1 - e2 / 4 - 3 * pow(e2, 2) / 64 - 5 * pow(e2, 3) / 256) * phi - (3 * e2 / 8 + 3 * pow(e2, 2) / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * phi) + (15 * pow(e2, 2) / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * phi) - 35 * pow(e2, 3) / 3072 * sin(6 * phi)) AS m FROM u)"""


@query(
    f"""WITH {UTM} SELECT zone, round(500000 + CAST(0.9996 AS DOUBLE) * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * pow(a, 5) / 120), 3) AS x,
round(CAST(0.9996 AS DOUBLE) * (m + n * tan(phi) * (pow(a, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * pow(a, 6) / 720)), 3) AS y FROM m""",
    "v_zones",
)
def utm_projection(zones):
    x, y = geo.utm(F.col("lon"), F.col("lat"), 31)
    return zones.select("zone", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(
    """WITH p AS (SELECT a.zone, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM v_zones a JOIN v_zones b ON b.zone = (a.zone + 1) % 25), e AS (SELECT *, f * (2 - f) AS e2, radians((y1 + y2) / 2) AS mid FROM p, (SELECT 1e0 / CAST(298.257223563 AS DOUBLE) AS f)),
w AS (SELECT *, sqrt(1 - e2 * pow(sin(mid), 2)) AS w FROM e)
SELECT zone, round(sqrt(pow(radians(x2 - x1) * 6378137 * cos(mid) / w, 2) + pow(radians(y2 - y1) * 6378137 * (1 - e2) / (w * w * w), 2)), 3) AS metres FROM w""",
    "v_zones",
)
def ground_distances(zones):
    b = zones.select(F.col("zone").alias("z2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return zones.join(b, F.col("z2") == (F.col("zone") + 1) % 25).select("zone", F.round(geo.ground_metres(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 3).alias("metres"))


@query("SELECT zone, round((lon - 4) * (pi() / 180 * 6371008.8e0 * cos(radians(52e0))), 3) AS x, round((lat - 52) * (pi() / 180 * 6371008.8e0), 3) AS y FROM v_zones", "v_zones")
def equirectangular_projection(zones):
    x, y = geo.equirectangular(F.col("lon"), F.col("lat"), 4.0, 52.0)
    return zones.select("zone", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("SELECT trip, round(CASE WHEN trip % 10 < 10 THEN CAST(trip % 10 AS DOUBLE) / 10 / (1 - CAST(trip % 10 AS DOUBLE) / 10) END, 6) AS tries FROM v_trip_results", "v_trip_results")
def taxi_expected_tries(trips):
    return trips.select("trip", F.round(geo.expected_wait(F.col("trip") % 10 / 10), 6).alias("tries"))


@query("SELECT situation, alternative, round(cost_eur * (60 * -12e-1 / -2e-1), 6) AS extra_s FROM v_alternatives", "v_alternatives")
def generalised_extra_seconds(alternatives):
    return alternatives.select("situation", "alternative", F.round(geo.extra_seconds(-1.2, -0.2, F.col("cost_eur")), 6).alias("extra_s"))


@query("SELECT trip, list_sum(list_transform(range(53), lambda b: CAST((trip >> b) & 1 AS DOUBLE) / (CAST(1 AS BIGINT) << (b + 1)))) AS u FROM v_trip_results", "v_trip_results")
def quota_spread(trips):
    return trips.select("trip", geo.reversed_bits(F.col("trip")).alias("u"))


@query("SELECT o_zone // 5 AS zx, o_zone % 5 AS zy, departure_s // 900 AS bin, CAST(count(*) AS BIGINT) AS legs, CAST(sum(weight) AS BIGINT) AS people FROM v_trip_results GROUP BY 1, 2, 3", "v_trip_results")
def expected_legs(trips):
    return trips.groupBy(F.expr("o_zone div 5").alias("zx"), (F.col("o_zone") % 5).alias("zy"), F.expr("departure_s div 900").alias("bin")).agg(F.count("*").alias("legs"), F.sum("weight").alias("people"))


@query("SELECT o_zone, " + ", ".join(f"CAST(coalesce(sum(weight) FILTER (WHERE d_zone = {d}), 0) AS BIGINT) AS d{d}" for d in range(25)) + " FROM v_trip_results GROUP BY 1", "v_trip_results")
def od_matrix(trips):
    wide = trips.groupBy("o_zone").pivot("d_zone", list(range(25))).agg(F.sum("weight"))
    return wide.select("o_zone", *[F.coalesce(F.col(f"`{d}`"), F.lit(0)).cast("long").alias(f"d{d}") for d in range(25)])
