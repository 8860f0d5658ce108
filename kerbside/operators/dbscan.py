"""Density clustering (DBSCAN) with the haversine metric, eps in degrees of arc.

Labels equal those of the classic sequential algorithm: a point is *core* when
at least ``min_samples`` points (itself included) lie within eps; core points
within eps of each other share a cluster; clusters are numbered 0, 1, … in the
order of their smallest core record id; a non-core point within eps of core
points takes the smallest such cluster number; everything else is −1.
Record ``id`` is only the order key: ids may repeat or be missing (missing ids
come last, ties go by coordinates), and rows in equal rows out.  Longitudes wrap
at ±180°; the width of a neighbourhood in degrees of longitude follows from each
cell's own latitude, so a record near a pole widens no other cell's ring.

Spark design (grid DBSCAN, after Gan & Tao 2015):

1. Equal coordinates collapse into one weighted location, so a location that
   holds a third of all records is one row from here on.
2. Locations fall into sub-cells of side ``a = eps/(2√2)`` (degrees of
   latitude and of longitude).  Any two points in the same or in adjacent
   sub-cells (the 3×3 block) are within eps.  Hence:
   * a location whose 3×3 block weighs ≥ min_samples is core — no distance
     test at all;
   * only locations in sparse blocks (< min_samples records in the 3×3 block,
     so few per block) count their outer-ring neighbours, down the quadtrees of the
     ring sub-cells and no further than to min_samples;
   * all core points of one sub-cell form one graph node, and core sub-cells
     that are adjacent are joined by an edge without a test.
3. Components over sub-cells: adjacency components inside tiles of 32×32
   sub-cells come from bounded array steps; outer-ring sub-cell pairs whose
   tile-local components differ and that no straight path of core sub-cells
   bridges are searched for one pair of core points within eps, by halving both
   sides' quadtrees until a witness settles the pair; one distributed components
   run joins cross-tile adjacency and ring edges.
4. Cluster numbers come from a distributed global index of component roots.
5. A border location takes the smallest label of a block or ring sub-cell with a core
   point within eps; boxes whose label is no improvement are not looked into.

Joins that attach a one-row-per-cell value to all locations, and locations to records,
are plain equi-joins with hot keys on one side only, which adaptive execution splits.
Intermediate tables go to the cluster's checkpoint folder.
"""

from __future__ import annotations

import math
import os
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.ordering import global_index
from kerbside.operators.components import connected_components
from kerbside.operators.density import SUB_FRACTION, block_weights
from kerbside.operators.quadtree import LEAF, build_tree, linked_pairs, nearest_labels, point_weights, with_morton
from kerbside.operators.spatial import attach_by_location, columns_around, eps_pairs, grid, ring_join
from kerbside.operators.tiles import TILE, cross_tile_edges, tile_local_labels
from kerbside.session import ensure_checkpoint_dir, materialize, spread

_TIMING = os.environ.get("KERBSIDE_TIMING") == "1"


class _Clock:
    def __init__(self):
        self.t = time.time()

    def __call__(self, label: str) -> None:
        if _TIMING:
            now = time.time()
            print(f"[dbscan] {label}: {now - self.t:.2f}s", flush=True)
            self.t = now


def _offsets(ki: int, kj: int, min_cheb: int, max_cheb: int | None = None) -> Column:
    pairs = [(di, dj) for di in range(-ki, ki + 1) for dj in range(-kj, kj + 1)
             if max(abs(di), abs(dj)) >= min_cheb and (max_cheb is None or max(abs(di), abs(dj)) <= max_cheb)]
    return F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di, dj in pairs])


def dbscan(df: DataFrame, eps_deg: float, min_samples: int, id_col: str = "id", lat: str = "latitude",
           lon: str = "longitude", tile: int = TILE, leaf: int = LEAF) -> DataFrame:
    """``df`` plus ``cluster_label`` (int, −1 = noise)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    m = int(min_samples)
    eps_rad = math.radians(eps_deg)
    a = eps_deg * SUB_FRACTION
    clock = _Clock()

    # 1. weighted distinct locations; pid names the location (ids need not be
    #    unique or present), oid (smallest record id) only orders the clusters
    n = columns_around(a)
    loc = (df.groupBy(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
             .agg(F.count(F.lit(1)).alias("w"), F.min(F.col(id_col)).alias("oid")))
    loc = materialize(spread(with_morton(grid(loc, a), a)).withColumn("pid", F.monotonically_increasing_id()), "dbscan_locations")
    clock("locations")

    # 2. sub-cell weights and 3×3 block weights
    tree = build_tree(loc, leaf=leaf)
    block = materialize(block_weights(tree.boxes, n), "dbscan_blocks")
    clock("cells")

    # 3. locations in sparse blocks count their outer-ring neighbours, until the count
    #    has reached min_samples or no longer can
    sparse = loc.join(block.filter(F.col("B") < m), ["ci", "cj"])
    sparse = sparse.select("ci", "cj", F.col("pid").alias("p"), F.col("B").alias("known"), F.col("lat").alias("plat"), F.col("x").alias("plon"))
    ring_w = point_weights(ring_join(sparse, tree.boxes, eps_deg, a), tree, eps_rad, limit=m)
    pts = (loc.join(block, ["ci", "cj"]).join(ring_w, F.col("pid") == F.col("p"), "left")
              .select("pid", "oid", "lat", "lon", "x", "w", "ci", "cj", "morton",
                      ((F.col("B") + F.coalesce(F.col("ring_w"), F.lit(0))) >= m).alias("core")))
    pts = materialize(spread(pts), "dbscan_points")
    clock("core test")

    # 4. core sub-cells (graph nodes) and free adjacency edges
    core_tree = build_tree(pts.filter("core").drop("core"), [
        F.min("pid").alias("node"), F.min(F.struct(F.col("oid").isNull().alias("without"), "oid", "lat", "lon")).alias("first")], leaf=leaf)
    ccells = core_tree.boxes.select("ci", "cj", "node", "first")
    local = tile_local_labels(ccells, tile)
    c0 = ccells.join(local.select("node", F.col("local").alias("c0")), "node")
    clock("tile components")

    # 5. outer-ring sub-cell pairs whose tile-local components differ
    A = c0.select(F.col("node").alias("src"), F.col("c0").alias("c0a"), "ci", "cj")
    Bc = c0.select(F.col("node").alias("dst"), F.col("c0").alias("c0b"), "ci", "cj")
    cand = materialize(ring_join(A, Bc, eps_deg, a).filter(F.col("c0a") < F.col("c0b")), "dbscan_candidates")
    # a pair joined by a straight king path of core sub-cells is already
    # connected through adjacency (every step moves ≤ 1 in each direction):
    # drop it.  Bounded work (≤ k−1 lookups per pair); inside dense areas every
    # pair is bridged, so only pairs across real gaps reach the tests below.
    k = F.greatest(F.abs("di"), F.abs("dj"))
    steps = (cand.select("src", "dst", "ai", "aj", "di", "dj", k.alias("k"))
                 .withColumn("t", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
                 .select("src", "dst", "k",
                         (F.col("ai") + F.round(F.col("t") * F.col("di") / F.col("k")).cast("long")).alias("ci"),
                         F.pmod(F.col("aj") + F.round(F.col("t") * F.col("dj") / F.col("k")).cast("long"), F.lit(n)).alias("cj")))
    bridged = (steps.join(ccells.select("ci", "cj"), ["ci", "cj"])
                    .groupBy("src", "dst", "k").agg(F.count(F.lit(1)).alias("n"))
                    .filter(F.col("n") == F.col("k") - 1)
                    .select("src", "dst"))
    cand = cand.join(bridged, ["src", "dst"], "left_anti")
    ring_edges = linked_pairs(cand.select("c0a", "c0b", "ai", "aj", F.col("ci").alias("bi"), F.col("cj").alias("bj"), "shift"), core_tree, eps_rad, ["c0a", "c0b"])
    edges = ring_edges.select(F.col("c0a").alias("src"), F.col("c0b").alias("dst")).union(cross_tile_edges(local, n))
    comp1 = connected_components(c0.select(F.col("c0").alias("node")).distinct(), edges)
    roots = c0.join(comp1.select(F.col("node").alias("c0"), F.col("label").alias("root")), "c0")
    clock("ring edges + components")

    # 6. cluster numbers in order of the smallest core record id
    firsts = roots.groupBy("root").agg(F.min("first").alias("first")).select("root", "first.*")
    numbered = global_index(firsts, [F.col("without"), F.col("oid"), F.col("lat"), F.col("lon")], "cl").select("root", "cl")
    cell_label = (roots.join(numbered, "root")
                       .select("ci", "cj", F.col("cl").cast("int").alias("cluster_label"))
                       .checkpoint(eager=True))
    clock("numbering")

    # 7. labels of locations: core → own sub-cell; border → smallest label of a core
    #    neighbour (the whole 3×3 block; ring sub-cells by their boxes); else −1
    core_lab = pts.filter("core").join(cell_label, ["ci", "cj"]).select("pid", "cluster_label")
    noncore = pts.filter(~F.col("core")).select("ci", "cj", F.col("pid").alias("p"), F.col("lat").alias("plat"), F.col("x").alias("plon"))
    block_lab = (noncore.withColumn("o", F.explode(_offsets(1, 1, 0)))
                        .select("p", (F.col("ci") + F.col("o.di")).alias("ci"), F.pmod(F.col("cj") + F.col("o.dj"), F.lit(n)).alias("cj"))
                        .join(cell_label, ["ci", "cj"]).select("p", F.col("cluster_label").alias("label")))
    labelled = core_tree.boxes.drop("node", "first").join(cell_label.withColumnRenamed("cluster_label", "label"), ["ci", "cj"])
    border_lab = nearest_labels(ring_join(noncore, labelled, eps_deg, a), block_lab, core_tree, eps_rad)
    loc_label = (pts.select("pid", "lat", "lon")
                    .join(core_lab.union(border_lab.select("p", "label")), "pid", "left")
                    .select("lat", "lon", F.coalesce(F.col("cluster_label"), F.lit(-1)).cast("int").alias("cluster_label"))
                    .checkpoint(eager=True))
    clock("labels")

    # 8. back to records (records of one location share its label)
    out = attach_by_location(df, loc_label, ["cluster_label"], lat, lon)
    clock("attach")
    return out.withColumn("cluster_label", F.coalesce(F.col("cluster_label"), F.lit(-1)).cast("int"))


def dbscan_plain(df: DataFrame, eps_deg: float, min_samples: int, id_col: str = "id", lat: str = "latitude",
                 lon: str = "longitude") -> DataFrame:
    """Point-level DBSCAN from the full eps self-join (reference version for
    tests; quadratic in dense areas).  Returns ``(id, cluster_label)``."""
    ensure_checkpoint_dir(df.sparkSession)
    pts = df.select(F.col(id_col).alias("id"), F.col(lat).alias("latitude"), F.col(lon).alias("longitude"))
    pairs = eps_pairs(pts, eps_deg).checkpoint(eager=True)
    core = pairs.groupBy(F.col("id_a").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_samples).select("id")
    edges = (pairs.join(core.withColumnRenamed("id", "id_a"), "id_a").join(core.withColumnRenamed("id", "id_b"), "id_b")
                  .select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")))
    comp = connected_components(core.select(F.col("id").alias("node")), edges)
    numbered = global_index(comp.select(F.col("label").alias("root")).distinct(), [F.col("root")], "cl")
    core_lab = comp.join(numbered, comp.label == numbered.root).select(F.col("node").alias("id"), F.col("cl").alias("cluster_label"))
    border = (pairs.join(core_lab.withColumnRenamed("id", "id_b"), "id_b")
                   .join(core.withColumnRenamed("id", "id_a"), "id_a", "left_anti")
                   .groupBy(F.col("id_a").alias("id")).agg(F.min("cluster_label").alias("cluster_label")))
    lab = core_lab.union(border)
    return (pts.select("id").join(lab, "id", "left")
               .select("id", F.coalesce(F.col("cluster_label"), F.lit(-1)).cast("int").alias("cluster_label")))
