"""Components of the sub-cell adjacency graph, contracted per tile.

Core sub-cells are grouped into tiles of ``T×T`` sub-cells; inside a tile the
adjacency components are found by a small union-find (``applyInPandas``, one
group per tile, at most T² rows whatever the data density).  Only adjacency
edges that cross tile borders remain, between tile-local components; their
components come from the distributed large-star/small-star routine.  The
result equals connected components over all adjacency edges: the label is the
smallest node id of the component."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators.components import connected_components

# The per-tile function travels with the task (pickled by value): Python
# workers need numpy/pandas only, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE = 32  # sub-cells per tile side (≤ TILE² rows per union-find group)

_NEIGHBOURS = [(di, dj) for di in (-1, 0, 1) for dj in (-1, 0, 1) if (di, dj) != (0, 0)]


def _tile_components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components of the core sub-cells of one tile (8-neighbour adjacency) by array
    steps: roots of neighbours hook onto the smaller one, then all chains are
    shortened; local label = smallest node id of the local component."""
    pdf = pdf.sort_values("node")  # a smaller index is a smaller node
    ci, cj, node = (pdf[c].to_numpy() for c in ("ci", "cj", "node"))
    width = cj.max() - cj.min() + 3
    place = (ci - ci.min()) * width + (cj - cj.min() + 1)
    order = np.argsort(place)
    ends = []
    for di, dj in ((0, 1), (1, -1), (1, 0), (1, 1)):
        at = np.searchsorted(place, place + di * width + dj, sorter=order)
        other = order[np.minimum(at, len(order) - 1)]
        a = np.flatnonzero(place[other] == place + di * width + dj)
        ends.append((a, other[a]))
    a, b = (np.concatenate(e) for e in zip(*ends))
    root = np.arange(len(node))
    while (root[a] != root[b]).any():
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return pd.DataFrame({"node": node, "local": node[root]})


def tile_local_labels(ccells: DataFrame, tile: int = TILE) -> DataFrame:
    """``ccells(ci, cj, node)`` → ``(node, local, ci, cj, ti, tj)`` where
    ``local`` is the smallest node of the node's adjacency component inside
    its tile."""
    cells = ccells.select("ci", "cj", "node").withColumns({
        "ti": F.floor(F.col("ci") / tile), "tj": F.floor(F.col("cj") / tile)})
    local = cells.groupBy("ti", "tj").applyInPandas(_tile_components, "node long, local long")
    return local.join(cells, "node").checkpoint(eager=True)


def cross_tile_edges(local: DataFrame, around: int | None = None) -> DataFrame:
    """Adjacency edges that cross a tile border, as edges between tile-local
    components (``src``, ``dst``).  With ``around`` columns on a circle, the last
    column is next to the first."""
    column = F.col("cj") + F.col("o.dj")
    if around:
        column = F.pmod(column, F.lit(around))
    offs = F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di, dj in _NEIGHBOURS])
    return (local.withColumn("o", F.explode(offs))
                 .select(F.col("local").alias("src"), F.col("ti").alias("ati"), F.col("tj").alias("atj"),
                         (F.col("ci") + F.col("o.di")).alias("ci"), column.alias("cj"))
                 .join(local.select("ci", "cj", F.col("local").alias("dst"), F.col("ti").alias("bti"),
                                    F.col("tj").alias("btj")), ["ci", "cj"])
                 .filter((F.col("ati") != F.col("bti")) | (F.col("atj") != F.col("btj")))
                 .select("src", "dst").distinct())


def adjacency_components(ccells: DataFrame, tile: int = TILE) -> DataFrame:
    """``ccells(ci, cj, node)`` → ``(node, label)`` for the graph joining core
    sub-cells that are adjacent (Chebyshev distance 1)."""
    local = tile_local_labels(ccells, tile)
    merged = connected_components(local.select(F.col("local").alias("node")).distinct(), cross_tile_edges(local))
    return (local.join(merged.select(F.col("node").alias("local"), "label"), "local")
                 .select("node", "label"))
