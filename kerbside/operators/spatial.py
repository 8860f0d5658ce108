"""Spatial range self-join: all pairs within ``eps`` degrees of arc
(haversine, inclusive, self-pairs counted).

Catalyst would plan a haversine predicate as a nested-loop join, so the
predicate is rewritten as an equi-join on grid cells: one side is exploded to
its 3×3 neighbour cells, the other stays in its own cell, and the exact
distance is a residual filter.  Cells are ``eps`` high and ``w`` wide with
``w`` from a one-row aggregate of the largest |latitude| so neighbours are
always within ±1 cell.  The join is output-sensitive (candidate pairs are a
constant factor of the result)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geo import haversine


def lon_reach_deg(eps_deg: float, max_abs_lat: float) -> float:
    """Largest longitude difference (degrees) of two points within ``eps``
    when both lie at |latitude| ≤ ``max_abs_lat`` + eps."""
    e = math.radians(eps_deg)
    phi = math.radians(max_abs_lat) + e
    if phi >= math.pi / 2:
        return 180.0
    s = min(1.0, math.sin(e / 2) / math.cos(phi))
    return math.degrees(2 * math.asin(s))


def columns_around(cell: float) -> int:
    """Grid columns of one width, at most ``cell`` degrees, around the circle: a
    multiple of ``2 ** block_levels(cell)``."""
    unit = 1 << block_levels(cell)
    return math.ceil(math.ceil(360.0 / cell) / unit) * unit


def block_levels(cell: float) -> int:
    """Columns are looked up in blocks of up to ``2 ** block_levels(cell)``, of
    which the circle has one or two thousand."""
    return max(0, math.ceil(360.0 / cell).bit_length() - 11)


def grid(points: DataFrame, cell: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``points`` plus ``x`` (longitude in [-180, 180)) and its grid cell: row
    ``ci``, column ``cj`` in 0..n-1 with column n-1 next to column 0."""
    n = columns_around(cell)
    x = F.when((F.col(lon) >= -180.0) & (F.col(lon) < 180.0), F.col(lon)).otherwise(F.pmod(F.col(lon) + 180.0, F.lit(360.0)) - 180.0)
    column = F.floor((F.col("x") + 180.0) * n / 360.0)
    return (points.withColumn("x", x)
                  .withColumns({"ci": F.floor(F.col(lat) / cell), "cj": F.least(column, F.lit(n - 1).cast("long"))}))


_ROWS = 8  # grid rows of one block of cells


def ring_join(left: DataFrame, right: DataFrame, eps_deg: float, cell: float) -> DataFrame:
    """Rows of ``left(ci, cj, …)`` with the rows of ``right(ci, cj, …)`` whose grid
    cells may hold points within eps, the 3×3 block left out.

    ``ai``/``aj`` is the left cell, ``ci``/``cj`` the right one, ``di``/``dj`` the
    offset, and ``shift`` the degrees to add to the right cell's longitudes so that
    they continue the left one's.  How many columns to look at follows from the
    left row's own latitudes.  Cells are looked up in blocks of ``_ROWS`` rows and of
    columns about twice as many as the reach (the cells of a block that lie too far
    are left out after the join), so a row costs two to four lookups nearly everywhere,
    not one per cell of its ring; towards a pole a record costs at most some
    thousand lookups and widens no other row's ring."""
    n, ki = columns_around(cell), math.ceil(eps_deg / cell)
    probe, width = ring_lookups(left, eps_deg, cell)
    # a row shows its cells in the blocks of every width its neighbour rows use (one, nearly everywhere)
    shown = (right.withColumn("_w", F.explode(F.array_distinct(F.array(*[width(F.col("ci") + d) for d in range(-ki, ki + 1)]))))
                  .withColumns({"_r": F.floor(F.col("ci") / _ROWS), "_b": F.floor(F.col("cj") / F.col("_w"))}))
    return (probe.join(shown, ["_r", "_w", "_b"])
                 .withColumns({"di": F.col("ci") - F.col("ai"), "dj": F.pmod(F.col("cj") - F.col("aj") + n // 2, F.lit(n)) - n // 2})
                 .filter((F.abs("di") <= ki) & (F.col("dj") >= -F.col("_back")) & (F.col("dj") <= F.col("_ahead"))
                         & (F.greatest(F.abs("di"), F.abs("dj")) >= 2))
                 .withColumn("shift", F.floor((F.col("aj") + F.col("dj")) / n) * 360.0)
                 .drop("_r", "_w", "_b", "_back", "_ahead"))


def ring_lookups(left: DataFrame, eps_deg: float, cell: float):
    """One row per row of ``left`` and block (``_r``, ``_w``, ``_b``) of cells its ring may
    touch, and the function that gives the blocks' width in a grid row."""
    n, ki, top = columns_around(cell), math.ceil(eps_deg / cell), block_levels(cell)

    def reach(row):
        high = F.greatest(F.abs(row), F.abs(row + 1)) * cell + eps_deg * (1 + 1e-9)
        s = math.sin(math.radians(eps_deg) / 2) / F.greatest(F.cos(F.radians(F.least(high, F.lit(90.0)))), F.lit(1e-15))
        return F.ceil(F.degrees(F.asin(F.least(s, F.lit(1.0))) * 2) * (1 + 1e-9) * n / 360.0)

    def width(row):
        return F.pow(F.lit(2.0), F.least(F.greatest(F.ceil(F.log2(reach(row) * 2)), F.lit(0).cast("long")), F.lit(top).cast("long")))

    back, ahead = F.least(reach(F.col("ai")), F.lit(n // 2).cast("long")), F.least(reach(F.col("ai")), F.lit(n - 1 - n // 2).cast("long"))
    probe = (left.withColumnsRenamed({"ci": "ai", "cj": "aj"})
                 .withColumns({"_w": width(F.col("ai")), "_back": back, "_ahead": ahead})
                 .withColumns({"_lo": F.floor((F.col("aj") - F.col("_back")) / F.col("_w")),
                               "_hi": F.floor((F.col("aj") + F.col("_ahead")) / F.col("_w")), "_n": (n / F.col("_w")).cast("long")})
                 .withColumn("_r", F.explode(F.sequence(F.floor((F.col("ai") - ki) / _ROWS), F.floor((F.col("ai") + ki) / _ROWS))))
                 .withColumn("_b", F.explode(F.sequence(F.col("_lo"), F.least(F.col("_hi"), F.col("_lo") + F.col("_n") - 1))))
                 .withColumn("_b", F.pmod(F.col("_b"), F.col("_n"))).drop("_lo", "_hi", "_n"))
    return probe, width


def max_abs_lat(points: DataFrame, lat: str = "latitude") -> float:
    """One-row aggregate (a single scalar reaches the driver)."""
    v = points.agg(F.max(F.abs(F.col(lat)))).first()[0]
    return float(v) if v is not None else 0.0


def eps_pairs(points: DataFrame, eps_deg: float, id_col: str = "id", lat: str = "latitude",
              lon: str = "longitude") -> DataFrame:
    """``(id_a, id_b)`` for every ordered pair with haversine ≤ eps (radians
    of ``eps_deg``), including ``a == b``."""
    eps_rad = math.radians(eps_deg)
    h = eps_deg * (1 + 1e-9)
    w = lon_reach_deg(eps_deg, max_abs_lat(points, lat)) * (1 + 1e-9)
    p = points.select(F.col(id_col).alias("id"), F.col(lat).alias("lat"), F.col(lon).alias("lon"),
                      F.floor(F.col(lat) / h).alias("ci"), F.floor(F.col(lon) / w).alias("cj"))
    offs = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    a = (p.withColumn("di", F.explode(offs)).withColumn("dj", F.explode(offs))
          .select(F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"),
                  (F.col("ci") + F.col("di")).alias("ci"), (F.col("cj") + F.col("dj")).alias("cj")))
    b = p.select(F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), "ci", "cj")
    return (a.join(b, ["ci", "cj"])
             .filter(haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= F.lit(eps_rad))
             .select("id_a", "id_b"))


def attach_by_location(df: DataFrame, loc_values: DataFrame, value_cols: list[str], lat: str = "latitude",
                       lon: str = "longitude") -> DataFrame:
    """Left-join per-location values (``loc_values``: ``lat``, ``lon``, value columns)
    back to the records of ``df``.  A location holding very many records is a hot key
    on the record side only; adaptive execution splits it over tasks."""
    vals = loc_values.select(F.col("lat").alias("_l"), F.col("lon").alias("_n"), *value_cols)
    return df.join(vals, (F.col(lat) == F.col("_l")) & (F.col(lon) == F.col("_n")), "left").select(*df.columns, *value_cols)


def neighbor_counts(points: DataFrame, eps_deg: float, id_col: str = "id", lat: str = "latitude",
                    lon: str = "longitude") -> DataFrame:
    """``(id, neighbor_count)``: number of records within eps of each record
    (itself included) — the quantity DBSCAN's core test compares.

    Equal coordinates collapse into one weighted location first, so the pair
    join runs over distinct locations (a location holding a third of all
    records adds one row, not a third squared pairs)."""
    loc = (points.groupBy(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
                 .agg(F.count(F.lit(1)).alias("w"), F.min(F.col(id_col)).alias("pid")))
    pairs = eps_pairs(loc.select(F.col("pid").alias("id"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude")),
                      eps_deg)
    wb = loc.select(F.col("pid").alias("id_b"), F.col("w").alias("wb"))
    counts = pairs.join(wb, "id_b").groupBy("id_a").agg(F.sum("wb").alias("neighbor_count"))
    per_loc = loc.join(counts, loc.pid == counts.id_a).select("lat", "lon", "neighbor_count")
    recs = points.select(F.col(id_col).alias("id"), F.col(lat).alias("latitude"), F.col(lon).alias("longitude"))
    return attach_by_location(recs, per_loc, ["neighbor_count"]).select("id", "neighbor_count")
