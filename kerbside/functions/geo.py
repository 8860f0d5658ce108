"""Great-circle distance on the unit sphere (radians), the metric of the
density clustering."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Central angle in radians between two points given in degrees:
    ``2·asin(sqrt(sin²(Δφ/2) + cos φ1·cos φ2·sin²(Δλ/2)))``."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dphi = p2 - p1
    dlmb = F.radians(lon2) - F.radians(lon1)
    h = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2.0) * F.asin(F.sqrt(h))


def eps_radians(eps_deg: float) -> float:
    return math.radians(eps_deg)
