"""Exact eps-neighbourhood sizes without enumerating dense pairs.

For every record: the number of records within eps (haversine, inclusive,
itself included).  Plain pair enumeration costs the number of eps-pairs,
which is quadratic inside a dense hotspot.  Here work per location is
bounded by geometry:

* equal coordinates collapse into weighted locations;
* sub-cells of side eps/(2√2): the whole 3×3 block around a location's
  sub-cell lies within eps, so its weight is added without any test;
* each outer-ring sub-cell (Chebyshev distance 2..k) is first compared with
  the location's whole sub-cell by bounding boxes: entirely within eps → its
  weight is added to every location of the sub-cell; entirely beyond →
  nothing; otherwise it is the root of a quadtree that each location walks down
  (``operators/quadtree.py``): whole boxes count by weight, and only the few
  locations of leaves that eps cuts through are tested.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators.quadtree import LEAF, box_bounds, build_tree, point_weights, with_morton
from kerbside.operators.spatial import attach_by_location, columns_around, grid, ring_join
from kerbside.session import materialize, spread

SUB_FRACTION = (1.0 / (2.0 * math.sqrt(2.0))) * (1.0 - 1e-6)


_SIDE = 8  # cells of a block of cells, each way


def block_weights(cells: DataFrame, around: int) -> DataFrame:
    """``cells(ci, cj, W)`` → ``(ci, cj, B)``: weight of each cell's 3×3 block.

    A cell goes to the blocks of cells its neighbourhood touches (one, or up to four at
    a border) and is added to its neighbours there: nine rows per cell are never shuffled."""
    near = [(di, dj) for di in (-1, 0, 1) for dj in (-1, 0, 1)]

    def there(di, dj):
        return F.col("ci") + di, F.pmod(F.col("cj") + dj, F.lit(around))

    def home(row, column):
        return F.struct(F.floor(row / _SIDE).alias("ti"), F.floor(column / _SIDE).alias("tj"))

    shown = (cells.select("ci", "cj", "W", F.explode(F.array_distinct(F.array(*[home(*there(*o)) for o in near]))).alias("t"))
                  .select("ci", "cj", "W", "t.ti", "t.tj").repartition("ti", "tj"))
    moved = F.array(*[F.struct(there(di, dj)[0].alias("ci"), there(di, dj)[1].alias("cj"), F.lit((di, dj) == (0, 0)).alias("own")) for di, dj in near])
    return (shown.select("ti", "tj", "W", F.explode(moved).alias("o")).select("ti", "tj", "W", "o.*")
                 .filter((F.floor(F.col("ci") / _SIDE) == F.col("ti")) & (F.floor(F.col("cj") / _SIDE) == F.col("tj")))
                 .groupBy("ti", "tj", "ci", "cj").agg(F.sum("W").alias("B"), F.max("own").alias("own"))
                 .filter("own").select("ci", "cj", "B"))


def neighbor_counts(points: DataFrame, eps_deg: float, id_col: str = "id", lat: str = "latitude",
                    lon: str = "longitude", leaf: int = LEAF) -> DataFrame:
    """``(id, neighbor_count)`` for every record of ``points``."""
    eps = math.radians(eps_deg)
    a = eps_deg * SUB_FRACTION
    loc = (points.groupBy(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
                 .agg(F.count(F.lit(1)).alias("w")))
    loc = materialize(spread(with_morton(grid(loc, a), a)).withColumn("pid", F.monotonically_increasing_id()), "density_locations")
    tree = build_tree(loc, leaf=leaf)
    cells = tree.boxes
    # sub-cell pairs first: decided for all locations of the source cell at once
    src = cells.select("ci", "cj", *[F.col(c).alias(f"s{c}") for c in ("lat0", "lat1", "lon0", "lon1")])
    pairs = ring_join(src, cells, eps_deg, a).withColumns({"tlon0": F.col("lon0") + F.col("shift"), "tlon1": F.col("lon1") + F.col("shift")})
    pairs = box_bounds(pairs, ["slat0", "slat1", "slon0", "slon1"], ["lat0", "lat1", "tlon0", "tlon1"]).filter(F.col("lower") <= eps * (1 + 1e-9))
    whole = pairs.filter(F.col("upper") <= eps * (1 - 1e-9)).groupBy(F.col("ai").alias("ci"), F.col("aj").alias("cj")).agg(F.sum("W").alias("cell_w"))
    cut = pairs.filter(F.col("upper") > eps * (1 - 1e-9)).select("ai", "aj", *cells.columns, "shift")
    probe = (loc.select(F.col("ci").alias("ai"), F.col("cj").alias("aj"), F.col("pid").alias("p"), F.lit(0).alias("known"),
                        F.col("lat").alias("plat"), F.col("x").alias("plon"))
                .join(cut, ["ai", "aj"]).drop("ai", "aj"))
    ring = point_weights(probe, tree, eps)
    own = block_weights(cells, columns_around(a)).join(whole, ["ci", "cj"], "left")
    per_loc = (loc.join(own, ["ci", "cj"]).join(ring, F.col("pid") == F.col("p"), "left")
                  .select("lat", "lon", (F.col("B") + F.coalesce("cell_w", F.lit(0)) + F.coalesce("ring_w", F.lit(0))).alias("neighbor_count")))
    recs = points.select(F.col(id_col).alias("id"), F.col(lat).alias("latitude"), F.col(lon).alias("longitude"))
    return attach_by_location(recs, per_loc, ["neighbor_count"]).select("id", "neighbor_count")
