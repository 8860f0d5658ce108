"""Quadtrees over grid cells, refined only where locations are dense.

Every grid cell is the root of a quadtree.  A box that holds more than ``LEAF``
locations is split, ``STEP`` halvings a side at once (a box of level ``k`` is the first
``k * STEP`` bit pairs of the Morton key of a location's place in its cell), down to
level ``DEEPEST``.  Each box carries weight, count and the tight bounds of its locations.

Three questions about "within eps" are answered with whole-box verdicts, level by
level; a box (or pair of boxes) whose bounds lie within eps, or beyond it, is settled
at once, and only boxes that eps cuts through are refined, until a leaf's few
locations are tested:

* ``point_weights``: how much weight lies within eps of each point, counted exactly
  or only until it is known to reach a limit or to stay below it;
* ``nearest_labels``: the smallest label of a box with a location within eps;
* ``linked_pairs``: which pairs of cells hold two locations within eps of each other
  (a pair of cells is settled by its first witness).

A point's frontier follows the circle around it, so it grows with the square root of
the density; no step forms the pairs of two dense cells' locations.  Locations of one
leaf are at most ``LEAF`` (at the deepest level: those that lie a few millionths of a
cell apart); points that ask about one box are many where the data is dense, and the
joins are plain equi-joins whose hot keys adaptive execution splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geo import haversine
from kerbside.operators.spatial import columns_around
from kerbside.session import materialize, spread

LEAF = 64
STEP, DEEPEST = 3, 5
_BITS = STEP * DEEPEST

_KEY = ["ci", "cj", "level", "q"]
_BOX = ["lat0", "lat1", "lon0", "lon1"]


@dataclass
class Tree:
    """``boxes``: roots, one row per cell; ``down``: every split box (key) with its
    parts; ``leaves``: every location with the key of its leaf."""

    boxes: DataFrame
    down: DataFrame | None
    leaves: DataFrame
    depth: int


def _spread(v: Column) -> Column:
    """Bits of a 16-bit number at the even places of a long."""
    v = v.cast("long")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def with_morton(loc: DataFrame, cell: float) -> DataFrame:
    """``loc(lat, x, ci, cj)`` plus ``morton``: the place in its cell, in bit pairs."""
    side = 1 << _BITS

    def part(v: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor(v * side), F.lit(side - 1)))

    row = part(F.col("lat") / cell - F.col("ci"))
    column = part((F.col("x") + 180.0) * columns_around(cell) / 360.0 - F.col("cj"))
    return loc.withColumn("morton", F.shiftleft(_spread(row), 1).bitwiseOR(_spread(column)))


def _boxes(loc: DataFrame, level: int, more: list[Column], leaf: int) -> DataFrame:
    q = F.shiftright(F.col("morton"), 2 * (_BITS - STEP * level))
    return (loc.groupBy("ci", "cj", q.alias("q"))
               .agg(F.sum("w").alias("W"), F.count(F.lit(1)).alias("npts"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"),
                    F.min("x").alias("lon0"), F.max("x").alias("lon1"), *more)
               .withColumns({"level": F.lit(level), "dense": (F.col("npts") > leaf) & F.lit(level < DEEPEST)}))


def build_tree(loc: DataFrame, more: list[Column] | None = None, leaf: int = LEAF) -> Tree:
    """``loc(lat, x, w, ci, cj, morton, …)``; ``more``: further aggregates of the roots."""
    roots = materialize(spread(_boxes(loc, 0, more or [], leaf)), "quadtree_roots")
    splits, leaves, rest, level = [], [], loc, 0
    boxes = roots
    while True:
        own = F.shiftright(F.col("morton"), 2 * (_BITS - STEP * level))
        placed = rest.withColumns({"level": F.lit(level), "q": own})
        dense = boxes.filter("dense").select(*_KEY)
        if dense.isEmpty():
            leaves.append(placed)
            break
        # locations of dense boxes go on, the others have found their leaf
        leaves.append(placed.join(dense, _KEY, "left_anti"))
        rest = placed.join(dense, _KEY, "left_semi").drop("level", "q")
        level += 1
        if level > 1:
            rest = materialize(rest, "quadtree_rest")
        boxes = materialize(_boxes(rest, level, [], leaf), "quadtree_boxes")
        splits.append(boxes.select("ci", "cj", F.lit(level - 1).alias("level"), F.shiftright("q", 2 * STEP).alias("q"), F.col("level").alias("level2"),
                                   F.col("q").alias("q2"), "W", "npts", "dense", *_BOX))
    down, found = None, leaves[0]
    for s in splits:
        down = s if down is None else down.unionByName(s)
    for x in leaves[1:]:
        found = found.unionByName(x)
    return Tree(roots, down, found, level)


def angle_bound(dlat: Column, dlon: Column, cos2: Column) -> Column:
    """Central angle for coordinate gaps (degrees) and a bound of cos φ1·cos φ2."""
    h = F.pow(F.sin(F.radians(dlat) / 2), 2) + cos2 * F.pow(F.sin(F.radians(F.least(dlon, F.lit(180.0))) / 2), 2)
    return F.lit(2.0) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def box_bounds(df: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """Least and largest central angle (``lower``, ``upper``) between boxes ``a`` and
    ``b`` (columns: lat low, lat high, lon low, lon high; a point repeats its columns)."""
    a0, a1, a2, a3 = (F.col(c) for c in a)
    b0, b1, b2, b3 = (F.col(c) for c in b)
    maxabs = F.greatest(*[F.abs(c) for c in (a0, a1, b0, b1)])
    return df.withColumns({
        "lower": angle_bound(F.greatest(F.lit(0.0), b0 - a1, a0 - b1), F.greatest(F.lit(0.0), b2 - a3, a2 - b3), F.pow(F.cos(F.radians(maxabs)), 2)),
        "upper": angle_bound(F.greatest(b1 - a0, a1 - b0), F.greatest(b3 - a2, a3 - b2), F.lit(1.0))})


def _shifted(df: DataFrame, lon0: str = "lon0", lon1: str = "lon1") -> DataFrame:
    return df.withColumns({lon0: F.col(lon0) + F.col("shift"), lon1: F.col(lon1) + F.col("shift")})


_POINT = ["plat", "plat", "plon", "plon"]


def _verdicts(probe: DataFrame, eps: float) -> DataFrame:
    """Boxes beyond eps go; ``inside`` tells whole boxes within eps."""
    return (box_bounds(probe, _POINT, _BOX).filter(F.col("lower") <= eps * (1 + 1e-9))
            .withColumn("inside", F.col("upper") <= eps * (1 - 1e-9)).drop("lower", "upper"))


def _refined(open_boxes: DataFrame, tree: Tree, keep: list[str], eps: float) -> DataFrame:
    """Parts of the dense boxes in a point frontier."""
    down = tree.down.withColumnsRenamed({"level2": "_level", "q2": "_q"})
    nxt = open_boxes.select(*keep, *_KEY, "shift").join(down, _KEY).drop("level", "q").withColumnsRenamed({"_level": "level", "_q": "q"})
    return _verdicts(_shifted(nxt), eps)


def _tested(open_leaves: DataFrame, tree: Tree, keep: list[str], eps: float) -> DataFrame:
    """Locations of leaves within eps of their points: keep, w."""
    q = tree.leaves.select(*_KEY, F.col("lat").alias("qlat"), F.col("x").alias("qlon"), F.col("w").alias("wq"))
    return (open_leaves.select(*keep, "plat", "plon", *_KEY).join(q, _KEY)
            .filter(haversine(F.col("plat"), F.col("plon"), F.col("qlat"), F.col("qlon")) <= F.lit(eps)).select(*keep, F.col("wq").alias("W")))


def point_weights(probe: DataFrame, tree: Tree, eps: float, limit: int | None = None) -> DataFrame:
    """``probe(p, known, plat, plon, shift, <root box>)`` → ``(p, ring_w)``: weight of the
    probed boxes' locations within eps.  With ``limit`` a point is settled as soon as
    ``known`` plus what was counted reaches it, or can no longer reach it; its
    weight then only is right as to that."""
    keep = ["p", "known", "plat", "plon"]
    counted: list[DataFrame] = []
    probe = _verdicts(_shifted(probe), eps)
    for level in range(tree.depth + 1):
        if limit is not None or level > 1:
            probe = materialize(probe, "quadtree_probe")
        if level < tree.depth:
            cut = probe.filter("dense AND NOT inside")
        if limit is None:
            counted.append(_counted(probe, tree, eps))
        else:
            counted.append(probe.filter("inside").select("p", "W"))
            undecided = _undecided(probe.filter("NOT inside"), counted, limit)
            counted.append(_tested(probe.filter("NOT inside AND NOT dense").join(undecided, "p", "left_semi"), tree, ["p"], eps))
            if level < tree.depth:
                cut = cut.join(undecided, "p", "left_semi")
        if level < tree.depth:
            probe = _refined(cut, tree, keep, eps)
    return _union(counted).groupBy("p").agg(F.sum("W").alias("ring_w"))


def _counted(probe: DataFrame, tree: Tree, eps: float) -> DataFrame:
    """Whole boxes by weight and leaves' locations one by one, in one pass: rows that
    need no test look up a key that no leaf has."""
    q = tree.leaves.select(*_KEY, F.col("lat").alias("qlat"), F.col("x").alias("qlon"), F.col("w").alias("wq"))
    rows = probe.filter("inside OR NOT dense").withColumn("q", F.when(F.col("inside"), -1 - F.col("p")).otherwise(F.col("q")))
    near = haversine(F.col("plat"), F.col("plon"), F.col("qlat"), F.col("qlon")) <= F.lit(eps)
    return rows.join(q, _KEY, "left").select("p", F.when(F.col("inside"), F.col("W")).when(near, F.col("wq")).alias("W")).filter("W IS NOT NULL")


def _undecided(cut: DataFrame, counted: list[DataFrame], limit: int) -> DataFrame:
    """Points that have not reached the limit and still can."""
    sums = _union(counted).groupBy("p").agg(F.sum("W").alias("got"))
    maybe = cut.groupBy("p").agg(F.max("known").alias("known"), F.sum("W").alias("most")).join(sums, "p", "left")
    got = F.col("known") + F.coalesce("got", F.lit(0))
    return maybe.filter((got < limit) & (got + F.col("most") >= limit)).select("p")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def nearest_labels(probe: DataFrame, known: DataFrame, tree: Tree, eps: float) -> DataFrame:
    """``probe(p, label, plat, plon, shift, <root box>)`` → ``(p, label)``: the smallest
    label of a probed root with a location within eps, or of ``known(p, label)``."""
    keep = ["p", "label", "plat", "plon"]
    found = known
    probe = _verdicts(_shifted(probe), eps)
    for level in range(tree.depth + 1):
        probe = materialize(probe, "quadtree_probe")
        found = found.unionByName(probe.filter("inside").select("p", "label")).groupBy("p").agg(F.min("label").alias("label"))
        # a box matters only if its label is below what the point has
        best = found.select("p", F.col("label").alias("best"))
        cut = probe.filter("NOT inside").join(best, "p", "left").filter(F.col("best").isNull() | (F.col("label") < F.col("best"))).drop("best")
        hit = _tested(cut.filter("NOT dense"), tree, ["p", "label"], eps).select("p", "label")
        found = found.unionByName(hit).groupBy("p").agg(F.min("label").alias("label"))
        if level < tree.depth:
            found = materialize(found, "quadtree_labels")
            probe = _refined(cut.filter("dense"), tree, keep, eps)
    return found


def linked_pairs(pairs: DataFrame, tree: Tree, eps: float, name: list[str]) -> DataFrame:
    """``pairs(*name, ai, aj, bi, bj, shift)`` of root cells → distinct ``name`` of pairs
    that hold locations within eps of each other (``shift``: degrees that take the b
    side's longitudes next to the a side's)."""
    side = {s: {c: f"{s}_{c}" for c in ["level", "q", "npts", "dense", *_BOX]} for s in "ab"}

    frontier = pairs
    for s in "ab":
        own = tree.boxes.select(F.col("ci").alias(f"{s}i"), F.col("cj").alias(f"{s}j"), *[F.col(c).alias(n) for c, n in side[s].items()])
        frontier = frontier.join(own, [f"{s}i", f"{s}j"])
    found = None
    key = [*name, "ai", "aj", "bi", "bj", "shift", "a_level", "a_q", "b_level", "b_q", "a_dense", "b_dense"]
    for level in range(tree.depth + 1):
        moved = frontier.withColumns({"b_lon0": F.col("b_lon0") + F.col("shift"), "b_lon1": F.col("b_lon1") + F.col("shift")})
        judged = box_bounds(moved, [f"a_{c}" for c in _BOX], [f"b_{c}" for c in _BOX]).filter(F.col("lower") <= eps * (1 + 1e-9))
        judged = materialize(judged.select(*key, (F.col("upper") <= eps * (1 - 1e-9)).alias("inside")), "quadtree_pairs")
        sure = judged.filter("inside").select(*name).distinct()
        found = sure if found is None else found.unionByName(sure)
        cut = judged.filter("NOT inside").join(found.distinct(), name, "left_anti")
        loc = {s: tree.leaves.select(F.col("ci").alias(f"{s}i"), F.col("cj").alias(f"{s}j"), F.col("level").alias(f"{s}_level"), F.col("q").alias(f"{s}_q"),
                                     F.col("lat").alias(f"{s}_lat"), F.col("x").alias(f"{s}_lon")) for s in "ab"}
        exact = cut.filter("NOT a_dense AND NOT b_dense")
        for s in "ab":
            exact = exact.join(loc[s], [f"{s}i", f"{s}j", f"{s}_level", f"{s}_q"])
        hit = exact.filter(haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= F.lit(eps)).select(*name).distinct()
        found = found.unionByName(hit)
        if level < tree.depth:
            found = materialize(found.distinct(), "quadtree_found")
            # parts of a dense box, the box itself where it is a leaf
            frontier = cut.filter("a_dense OR b_dense").join(found, name, "left_anti").select(*key[:-2])
            for s in "ab":
                frontier = _one_down(frontier, tree, s, side[s])
    return found.distinct()


def _one_down(frontier: DataFrame, tree: Tree, s: str, names: dict[str, str]) -> DataFrame:
    at = ["level", "q"]
    split = tree.down.select(F.col("ci").alias(f"{s}i"), F.col("cj").alias(f"{s}j"), *[F.col(c).alias(f"_{c}") for c in at], F.col("level2").alias(names["level"]),
                             F.col("q2").alias(names["q"]), *[F.col(c).alias(n) for c, n in names.items() if c not in at])
    root = tree.boxes.filter("NOT dense").select("ci", "cj", *_KEY[2:], *[c for c in names if c not in at])
    part = tree.down.filter("NOT dense").select("ci", "cj", F.col("level2").alias("level"), F.col("q2").alias("q"), *[c for c in names if c not in at])
    leaf = root.unionByName(part).select(F.col("ci").alias(f"{s}i"), F.col("cj").alias(f"{s}j"), F.col("level").alias("_level"), F.col("q").alias("_q"),
                                            *[F.col(c).alias(n) for c, n in names.items()])
    steps = split.unionByName(leaf)
    return (frontier.withColumnsRenamed({f"{s}_level": "_level", f"{s}_q": "_q"}).join(steps, [f"{s}i", f"{s}j", "_level", "_q"]).drop("_level", "_q"))
