"""Hard negatives by slot-decomposed selection.

An anchor's positives are its first rows of the same label by score (integer inner
product of the scaled vectors; higher first, ties by smaller id).  Each positive of
score ``p`` has a window of scores, ``low·p <= 100·s <= high·p``, and asks for the
first rows of other labels in it.  The windows of one anchor overlap, so the rows
are not selected window by window: the positives' upper limits, sorted, split the
scores into disjoint slots.  Every row of another label falls into one slot at
most; tasks keep the first ``k`` of each slot (combiners), and so does the merge of
their outputs.  From the lowest slot upwards the slots' lists are merged into
suffixes: the suffix that begins at a positive's own slot holds the first ``k`` of
everything below its upper limit, and its lower limit cuts the list.

Anchors are worked off in groups of about ``GROUP_BYTES`` of scaled vectors, the
size of the one broadcast; all rows are scanned against the group in blocks, once
for the positives and once for the slots.  Tasks hand on at most ``k`` rows a slot
and anchor, and read about ``TASK_BYTES`` each, so what is shuffled is a small
multiple of the anchors.  Each group's result is written before the next begins:
a lost executor repeats only tasks of one scan.

Defined results: rows with a null label, a null vector, or a component that is null
or not finite (before or after scaling) take no part; a shorter vector counts as
padded with zeros; null ids are last among ties; rows that repeat an id are rows of
their own (an anchor's own row is no positive of it, its copy is); scores beyond 64
bits stay at the largest 64-bit value; windows of negative scores are empty; an
anchor without positives, or a positive without a row in its window, gives no row;
an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.common import read_table
from kerbside.session import discard, ensure_checkpoint_dir, materialize

#: Bytes of anchors broadcast at once.
GROUP_BYTES = 64 << 20
#: Bytes of scaled vectors that one task scans, where there are more than the cores share.
TASK_BYTES = 1 << 30
#: Anchors and rows multiplied at once inside a task (32 MB of scores).
ANCHOR_BLOCK, ROW_BLOCK = 1024, 4096

_INT = np.iinfo(np.int64)
_FOUND = "anchor long, slot int, score long, no_id boolean, id long"
#: ``no_id`` sorts null ids last among ties; their ``id`` is this while they are sorted.
_NO_ID = _INT.max


def _matrix(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    """Scaled vectors as rows of a matrix, short ones padded with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(float(scale) * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), max(dim, 1)))
    if dim and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``a`` with all rows of ``b``."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)  # every partial sum is an integer that a double holds
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -_INT.max, _INT.max).astype(np.int64)


class _Best:
    """The first ``k`` rows for each of ``n`` lists: by score, then id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.list = np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(n, -_INT.max, np.int64)  # a list's k-th score: what is lower is out

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        lists, score, ids = np.concatenate([self.list, lists]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, lists))
        lists, score, ids = lists[order], score[order], ids[order]
        place = np.arange(len(lists)) - np.searchsorted(lists, lists)
        keep = place < self.k
        self.list, self.score, self.id = lists[keep], score[keep], ids[keep]
        full = place[keep] == self.k - 1
        self.floor[self.list[full]] = self.score[full]


def _positives(group, dim: int, scale: int, k: int):
    """Per task and anchor the first ``k`` other rows of the same label."""
    def run(batches):
        x, label, own = (group.value[c] for c in ("x", "label", "row"))
        best = _Best(len(x), k)
        members = {v: np.flatnonzero(label == v) for v in np.unique(label).tolist()}
        for rows, ids, kinds, vectors in _blocks(batches, dim, scale):
            for v in np.unique(kinds).tolist():
                there, here = members.get(v), np.flatnonzero(kinds == v)
                for i in range(0, len(there) if there is not None else 0, ANCHOR_BLOCK):
                    a = there[i: i + ANCHOR_BLOCK]
                    s = _scores(x[a], vectors[here])
                    least = best.floor[a]
                    new = least == -_INT.max
                    if len(here) > k + 1 and new.any():
                        # the anchor's own row may be among the first
                        least = least.copy()
                        least[new] = np.partition(s[new], len(here) - k - 1, axis=1)[:, len(here) - k - 1]
                    p, q = np.nonzero((s >= least[:, None]) & (own[a][:, None] != rows[here][None, :]))
                    best.add(a[p], s[p, q], ids[here][q])
        yield from _found(own[best.list], np.zeros(len(best.list), np.int32), best.score, best.id)

    return run


def _slots(group, dim: int, scale: int, k: int):
    """Per task, anchor and slot the first ``k`` rows of other labels."""
    def run(batches):
        x, label, own, upper, lower = (group.value[c] for c in ("x", "label", "row", "upper", "lower"))
        n = upper.shape[1]
        best = _Best(len(x) * n, k)
        for _, ids, kinds, vectors in _blocks(batches, dim, scale):
            for i in range(0, len(x), ANCHOR_BLOCK):
                a = slice(i, min(i + ANCHOR_BLOCK, len(x)))
                s = _scores(x[a], vectors)
                other = label[a][:, None] != kinds[None, :]
                for j in range(n):
                    least = np.maximum(lower[a, j], best.floor.reshape(-1, n)[a, j])
                    p, q = np.nonzero(other & (s <= upper[a, j][:, None]) & (s >= least[:, None]))
                    best.add((i + p) * n + j, s[p, q], ids[q])
        yield from _found(own[best.list // n], (best.list % n).astype(np.int32), best.score, best.id)

    return run


def _blocks(batches, dim: int, scale: int):
    """Rows of a task in blocks: row numbers, ids, labels, scaled vectors."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROW_BLOCK):
            row, key, label, vector = batch.slice(i, ROW_BLOCK).columns
            yield row.to_numpy(), key.fill_null(_NO_ID).to_numpy(), label.to_numpy(), _matrix(vector, dim, scale)


def _found(anchor, slot, score, ids, step: int = 1 << 18):
    for i in range(0, len(anchor), step):
        none = ids[i: i + step] == _NO_ID
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[i: i + step], pa.int64()), pa.array(slot[i: i + step], pa.int32()), pa.array(score[i: i + step], pa.int64()),
             pa.array(none), pa.array(ids[i: i + step], pa.int64(), mask=none)], names=["anchor", "slot", "score", "no_id", "id"])


def _limits(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest ``s`` with low·score <= 100·s <= high·score, for scores from 0."""
    whole, rest = np.divmod(score, 100)
    return whole * low + -(-rest * low // 100), whole * high + rest * high // 100


def _first(entries: Column, k: int) -> Column:
    return F.slice(F.sort_array(entries), 1, k)


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per anchor, positive and chosen negative: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score (percentages 0 <= low < high)."""
    spark = rows.sparkSession
    vector = F.col(f"`{vector_col}`")
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double") * scale) < F.lit(float("inf"))))
    taken = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                        F.when(fine, vector).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    # the written row numbers tell repeated rows apart
    table = materialize(taken.filter("label IS NOT NULL AND vector IS NOT NULL")
                             .select(F.monotonically_increasing_id().alias("row"), "id", "label", "vector", "anchor"), "negatives_rows")
    n, m, dim = table.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-n * 8 * max(dim, 1) // TASK_BYTES))
    scan = table.select("row", "id", "label", "vector").coalesce(tasks)
    groups = -(-m * 8 * max(dim, 1) // GROUP_BYTES)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/negatives-{uuid.uuid4().hex}"
    anchors = materialize(table.filter("anchor").select("row", "id", "label", "vector", F.expr(f"pmod(xxhash64(row), {max(groups, 1)})").alias("g")), "negatives_anchors")
    for g in range(groups):
        _group(scan, anchors.filter(F.col("g") == g), dim, n_positives, n_negatives, low, high, scale).write.parquet(f"{path}/g={g}")
    discard(table, anchors)
    if not groups:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.parquet(path).drop("g")


def _group(scan: DataFrame, anchors: DataFrame, dim: int, n_positives: int, n_negatives: int, low: int, high: int, scale: int) -> DataFrame:
    """The result of one group of anchors (its vectors go through the driver into a broadcast)."""
    spark = scan.sparkSession
    own = anchors.select("row", "id", "label", "vector").toArrow().combine_chunks()
    value = {"row": own["row"].to_numpy(), "label": own["label"].to_numpy(), "x": _matrix(own["vector"].combine_chunks(), dim, scale)}
    sent = spark.sparkContext.broadcast(value)
    by_rank = F.struct((-F.col("score")).alias("minus"), "no_id", "id")
    first = (scan.mapInArrow(_positives(sent, dim, scale, n_positives), _FOUND)
                 .groupBy("anchor").agg(_first(F.collect_list(by_rank), n_positives).alias("found"))
                 .select("anchor", F.posexplode("found").alias("place", "p")))
    found = materialize(first.select("anchor", "place", F.col("p.id").alias("positive_id"), (-F.col("p.minus")).alias("positive_score")), "negatives_positives")
    got = found.filter("positive_score >= 0").select("anchor", "positive_score").toArrow().combine_chunks()
    sent.unpersist()

    # each anchor's upper limits, descending; a slot reaches down to the next one, or to its own lower limit
    at = dict(zip(value["row"].tolist(), range(len(value["row"]))))
    score = got["positive_score"].to_numpy()
    where = np.array([at[a] for a in got["anchor"].to_pylist()], dtype=np.int64)
    least, most = _limits(score, low, high)
    order = np.lexsort((-most, where))
    where, least, most = where[order], least[order], most[order]
    fresh = np.ones(len(where), dtype=bool)
    fresh[1:] = (where[1:] != where[:-1]) | (most[1:] != most[:-1])
    # equal upper limits are one slot; its lower limit is the least of theirs
    slot_least = np.minimum.reduceat(least, np.flatnonzero(fresh)) if len(least) else least
    where, most = where[fresh], most[fresh]
    slot = np.arange(len(where)) - np.searchsorted(where, where)
    upper = np.full((len(value["x"]), n_positives), -_INT.max, np.int64)
    lower = np.full((len(value["x"]), n_positives), _INT.max, np.int64)
    upper[where, slot] = most
    lower[where, slot] = slot_least
    below = np.full_like(upper, -_INT.max)
    below[:, :-1] = upper[:, 1:]
    lower = np.maximum(lower, below + 1)
    keep = np.zeros(len(value["x"]), dtype=bool)
    keep[where] = True
    sent = spark.sparkContext.broadcast({"x": value["x"][keep], "label": value["label"][keep], "row": value["row"][keep], "upper": upper[keep], "lower": lower[keep]})
    slots = (scan.mapInArrow(_slots(sent, dim, scale, n_negatives), _FOUND)
                 .groupBy("anchor", "slot").agg(_first(F.collect_list(by_rank), n_negatives).alias("first"))
                 .groupBy("anchor").agg(F.collect_list(F.struct("slot", "first")).alias("slots")))

    # suffixes from the lowest slot up: [(slot, first k of this slot and all below)]
    entry = "array<struct<minus: bigint, no_id: boolean, id: bigint>>"
    merged = F.aggregate(F.reverse(F.sort_array("slots")), F.expr(f"CAST(array() AS array<struct<slot: int, first: {entry}>>)"),
                         lambda acc, s: F.concat(F.array(F.struct(s["slot"].alias("slot"), _first(F.concat(s["first"], F.coalesce(F.try_element_at(acc, F.lit(1))["first"], F.expr(f"CAST(array() AS {entry})"))), n_negatives).alias("first"))), acc))
    score_col = F.col("positive_score")
    whole, rest = F.expr("positive_score div 100"), score_col % 100
    wanted = (found.filter("positive_score >= 0")
                   .withColumns({"least": whole * low + F.floor((rest * low + 99) / 100).cast("long"), "most": whole * high + F.floor(rest * high / 100).cast("long")}))
    # all positives of an anchor are a handful: they go along with its slots
    asked = wanted.groupBy("anchor").agg(F.collect_list(F.struct("place", "positive_id", "positive_score", "least", "most")).alias("asked"))
    answer = (asked.join(slots.select("anchor", merged.alias("suffix")), "anchor")
                   .select("anchor", "suffix", F.explode("asked").alias("w"), F.array_sort(F.array_distinct(F.col("asked.most")), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("limits"))
                   .withColumn("slot", F.array_position("limits", F.col("w.most")) - 1)
                   # the slot of the positive may hold nothing: the next suffix below it then is its own
                   .withColumn("held", F.filter("suffix", lambda s: s["slot"] >= F.col("slot")))
                   .withColumn("held", F.filter(F.try_element_at("held", F.lit(1))["first"], lambda e: -e["minus"] >= F.col("w.least")))
                   .select("anchor", "w", F.posexplode("held").alias("rank", "n")))
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return answer.join(names, "anchor").select(
        "anchor_id", F.col("w.positive_id").alias("positive_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
        F.col("w.positive_score").alias("positive_score"), (-F.col("n.minus")).alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
