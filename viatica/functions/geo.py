"""Projections, distances and small scalar functions as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6_378_137.0, 1 / 298.257223563  # WGS 84
E2 = FLAT * (2 - FLAT)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("long")


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing in metres, by the usual series of the transverse Mercator projection (to a millimetre within a zone)."""
    ep2 = E2 / (1 - E2)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    n = A / F.sqrt(1 - E2 * F.pow(F.sin(phi), F.lit(2.0)))
    t, c = F.pow(F.tan(phi), F.lit(2.0)), ep2 * F.pow(F.cos(phi), F.lit(2.0))
    a = F.cos(phi) * lam
    m0, m2, m4, m6 = 1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256, 3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024, 15 * E2**2 / 256 + 45 * E2**3 / 1024, 35 * E2**3 / 3072
    m = A * (m0 * phi - m2 * F.sin(2 * phi) + m4 * F.sin(4 * phi) - m6 * F.sin(6 * phi))
    p = lambda k: F.pow(a, F.lit(float(k)))
    x = 500_000 + 0.9996 * n * (a + (1 - t + c) * p(3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * p(5) / 120)
    y = 0.9996 * (m + n * F.tan(phi) * (p(2) / 2 + (5 - t + 9 * c + 4 * c * c) * p(4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * p(6) / 720))
    return x, F.when(lat < 0, y + 10_000_000).otherwise(y)


def ground_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on the local ellipsoid, for points that lie close together."""
    mid = F.radians((lat1 + lat2) / 2)
    w = F.sqrt(1 - E2 * F.pow(F.sin(mid), F.lit(2.0)))
    dx = F.radians(lon2 - lon1) * A * F.cos(mid) / w
    dy = F.radians(lat2 - lat1) * A * (1 - E2) / (w * w * w)
    return F.sqrt(dx * dx + dy * dy)


def metres_per_degree_lon(lat: Column) -> Column:
    return F.cos(F.radians(lat)) * (math.pi / 180 * 6_371_008.8)


def equirectangular(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    k = math.pi / 180 * 6_371_008.8
    return (lon - lon0) * (k * math.cos(math.radians(lat0))), (lat - lat0) * k


def expected_wait(fail: Column) -> Column:
    """Mean number of failed tries before one succeeds, each failing with this probability."""
    return F.when(fail < 1, fail / (1 - fail))


def extra_seconds(beta: float, beta_time_min: float, value: Column) -> Column:
    """Seconds that weigh as much as a value: 60 beta / beta_time."""
    return value * (60 * beta / beta_time_min)


def reversed_bits(n: Column, bits: int = 63) -> Column:
    """The place of n >= 0 in a sequence that spreads evenly over [0, 1) (van der Corput, base 2)."""
    out = F.lit(0.0)
    for b in range(bits):
        out = out + F.shiftright(n, b).bitwiseAND(F.lit(1)).cast("double") / float(1 << (b + 1))
    return out
