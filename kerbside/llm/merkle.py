"""Merkle manifest of a table, with a proof for every row by pointer jumping.

A row's leaf is the hash of its fields.  The leaves of each source, in the order of
the row key, are the bottom of a tree: every ``fanout`` consecutive nodes hash into
a parent until one is left, the subroot; the subroots in the order of the sources
are the bottom of one more tree, up to the root.

Positions come from one distributed sort by (source, key, leaf); a source's rows
find its first position by a join on (source, position block), so that no source,
however large, is one group.  Each level is one aggregate over runs of ``fanout``
nodes, and hands every child its sibling segment: the digests left and right of it.

Proofs: every inner node holds a pointer to an ancestor and the list of segments on
the way, at first its parent and its own segment.  Each round joins the nodes with
themselves on the pointer: the distance doubles, the lists are put together, until
all pointers reach the root.  Leaves, two thirds of all nodes, join in last, when
their parents hold whole lists: the same step, once.  A round at distance d joins at
most ``fanout``^d nodes to one ancestor, of which there are then few: from distance
``WIDE`` on, where they are counted to be at most ``FEW``, they are broadcast.
Every level and every round is a written table, so a lost executor repeats one step.

Defined results: null fields hash as ``-``; a null source is a source and comes
first; null keys come first; rows that repeat a key follow each other in the order
of their leaves; rows equal in all fields have equal leaves and proofs of their own
places; a lone row is its subroot, a lone source's subroot the root (then its proof
is the hash of nothing); columns that are not named as fields do not count; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions.ordering import global_index
from kerbside.llm.common import read_table
from kerbside.session import discard, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of one source that look up its first position together.
BLOCK = 1 << 20
#: Ancestors are broadcast from this distance on, if they are at most FEW (a list of segments is some KB).
WIDE, FEW = 8, 20_000

_SEGMENT = "struct<left: string, right: string>"


def digest_of(*values: Column) -> Column:
    return F.sha2(F.concat(*values).cast("binary"), 256)


def leaf_digest(columns: list[Column]) -> Column:
    """H of the fields: ``-`` for null, else UTF-8 length, ``:``, value."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return digest_of(*[part(c) for c in columns])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (segments from the leaf up) lead to."""
    return F.aggregate(proof, leaf, lambda acc, s: digest_of(s["left"], acc, s["right"]))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(s["left"], s["right"]))).cast("binary"), 256)


def _run_digest(children: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(children, lambda c: c["digest"])).cast("binary"), 256)


def _segment(children: Column, at: Column) -> Column:
    """Digests of a run before and after its child number ``at`` (from 0)."""
    text = F.transform(children, lambda c: c["digest"])
    return F.struct(F.concat_ws("", F.slice(text, F.lit(1), at)).alias("left"),
                    F.concat_ws("", F.slice(text, at + 2, F.size(text))).alias("right"))


def _level(nodes: DataFrame, fanout: int, payload: list[str]) -> DataFrame:
    """Runs of ``nodes(tree, p, n, digest, *payload)``: a parent with its children in order."""
    runs = (nodes.filter("n > 1").groupBy("tree", F.expr(f"p div {fanout}").alias("p"))
                 .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("p", "digest", *payload))).alias("children")))
    return materialize(runs.select("tree", "p", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), _run_digest(F.col("children")).alias("digest"), "children"),
                       "merkle_level", compression="zstd")


def _depth(n: int, fanout: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _id(level: int, names: tuple[str, str, str]) -> list[Column]:
    """Id of a run's parent at ``level``; a subroot is a leaf of the top tree (tree -1)."""
    top = F.expr("n = 1 AND tree >= 0")
    return [F.when(top, F.lit(-1)).otherwise(F.col("tree")).cast("long").alias(names[0]), F.when(top, 0).otherwise(level).cast("int").alias(names[1]),
            F.when(top, F.col("tree")).otherwise(F.col("p")).cast("long").alias(names[2])]


_TO = ("at", "al", "aq")


def _pointers(run: DataFrame, level: int) -> DataFrame:
    """The children of a level's runs, each with a pointer to its parent and its own segment;
    ``subroot`` is the digest of the subroot on the way, the node itself included."""
    child = run.select("tree", "p", "n", "children", F.posexplode("children").alias("pos", "child"))
    return child.select(F.col("tree").alias("t"), F.lit(level).alias("l"), F.col("child.p").alias("q"), *_id(level + 1, _TO),
                        F.array(_segment(F.col("children"), F.col("pos"))).alias("segments"),
                        F.when(F.expr(f"tree = -1 AND {level} = 0"), F.col("child.digest")).alias("subroot"))


def _jump(nodes: DataFrame, root: tuple[int, int, int], distance: int) -> DataFrame:
    """One round: pointers that have not reached the root go on to where their ancestors point."""
    reached = F.expr(f"at = {root[0]} AND al = {root[1]} AND aq = {root[2]}")
    going = nodes.filter(~reached)
    further = nodes.select(*[F.col(c).alias(a) for c, a in zip(("t", "l", "q"), _TO)], *[F.col(c).alias(f"{c}2") for c in _TO],
                           F.col("segments").alias("more"), F.col("subroot").alias("subroot2"))
    if distance >= WIDE:
        wanted = going.select(*_TO).distinct()
        if wanted.limit(FEW + 1).count() <= FEW:
            further = F.broadcast(further.join(F.broadcast(wanted), list(_TO), "left_semi"))
    moved = going.join(further, list(_TO)).select(
        "t", "l", "q", *[F.col(f"{c}2").alias(c) for c in _TO], F.concat("segments", "more").alias("segments"), F.coalesce("subroot", "subroot2").alias("subroot"))
    return nodes.filter(reached).unionByName(moved)


def _positions(leaves: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """``leaves(source, key, digest, tie, *payload)`` with the number of their source's tree, their
    position and its row count; and the table of sources."""
    placed = global_index(leaves, [F.col("source").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest"), F.col("tie")], "idx")
    per = materialize(placed.groupBy("source").agg(F.min("idx").alias("start"), F.count("*").alias("n")), "merkle_sources")
    trees = materialize(global_index(per, [F.col("source").asc_nulls_first()], "tree"), "merkle_trees")
    discard(per)
    blocks = trees.select(F.col("source").alias("of"), "tree", "start", "n",
                          F.explode(F.expr(f"sequence(start div {BLOCK}, (start + n - 1) div {BLOCK})")).alias("of_block"))
    rows = placed.withColumn("block", F.expr(f"idx div {BLOCK}"))
    return (rows.join(blocks, (F.col("block") == F.col("of_block")) & F.col("source").eqNullSafe(F.col("of")))
                .select("tree", (F.col("idx") - F.col("start")).alias("p"), "n", "digest", *payload)), trees


def prove(rows: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "source", key_col: str = "doc_id", fanout: int = 3,
          carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: key, leaf, subroot, root, proof (segments from the leaf up, each the
    digests left and right of the node), and the columns of ``carry``."""
    spark = rows.sparkSession
    carry = carry or {}
    col = lambda c: F.col(f"`{c}`")
    payload = ["key", *[f"c_{c}" for c in carry]]
    leaves = materialize(rows.select(col(group_col).cast("string").alias("source"), col(key_col).alias("key"), leaf_digest([col(c) for c in fields]).alias("digest"),
                                     F.monotonically_increasing_id().alias("tie"), *[v.alias(f"c_{c}") for c, v in carry.items()]), "merkle_leaves", compression="zstd")
    nodes, trees = _positions(leaves, payload)
    sources, most = trees.agg(F.count("*"), F.max("n")).first()
    if not sources:
        return leaves.select("key", F.col("digest").alias("leaf"), F.lit("").alias("subroot"), F.lit("").alias("root"),
                             F.expr(f"CAST(array() AS array<{_SEGMENT}>)").alias("proof"), *[F.col(f"c_{c}").alias(c) for c in carry])
    nodes = materialize(nodes, "merkle_nodes", compression="zstd")
    discard(leaves)

    # levels of the source trees, then of the top tree over their subroots
    depth, top_depth = _depth(most, fanout), _depth(sources, fanout)
    lone, runs, current = nodes.filter("n = 1"), [], nodes
    subroots = lone.select("tree", "digest")
    for level in range(depth):
        runs.append(_level(current, fanout, payload if level == 0 else []))
        current = runs[-1].select("tree", "p", "n", "digest")
        subroots = subroots.union(current.filter("n = 1").select("tree", "digest"))
    top = current = materialize(subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("p"), F.lit(sources).alias("n"), "digest"), "merkle_subroots")
    top_runs = []
    for _ in range(top_depth):
        top_runs.append(_level(current, fanout, []))
        current = top_runs[-1].select("tree", "p", "n", "digest")
    root_digest = current.first()["digest"]
    root = (-1, top_depth, 0)

    # pointers of all inner nodes, doubled until they reach the root
    parts = [_pointers(r, i + 1) for i, r in enumerate(runs[1:])] + [_pointers(r, i) for i, r in enumerate(top_runs)]
    pointers, distance = None, 1
    for part in parts:
        pointers = part if pointers is None else pointers.unionByName(part)
    if pointers is not None:
        pointers = materialize(pointers, "merkle_pointers", compression="zstd")
        discard(*runs[1:], *top_runs, top)
        while distance < depth + top_depth:
            before, pointers = pointers, materialize(_jump(pointers, root, distance), "merkle_pointers", compression="zstd")
            discard(before)
            distance *= 2

    # the leaves join in: their own segments, then their parents' whole lists
    none = F.expr(f"CAST(array() AS array<{_SEGMENT}>)")
    above = pointers.select(*[F.col(c).alias(a) for c, a in zip(("t", "l", "q"), _TO)], "segments", "subroot") if pointers is not None else None

    def joined(df: DataFrame) -> DataFrame:
        if above is None:
            return df.withColumns({"segments": none, "subroot": F.lit(None).cast("string")})
        return df.join(above, list(_TO), "left")

    shown = lambda leaf, own, get: [
        get("key").alias("key"), leaf.alias("leaf"), F.coalesce("subroot", F.lit(root_digest)).alias("subroot"), F.lit(root_digest).alias("root"),
        F.concat(own, F.coalesce("segments", none)).alias("proof"), *[get(f"c_{c}").alias(c) for c in carry]]
    alone = joined(lone.select(*_id(0, _TO), "digest", *payload)).select(*shown(F.col("digest"), none, F.col))
    if not runs:
        return alone
    family = joined(runs[0].select(*_id(1, _TO), "children")).select("*", F.posexplode("children").alias("pos", "child"))
    return alone.unionByName(family.select(*shown(F.col("child.digest"), F.array(_segment(F.col("children"), F.col("pos"))), lambda c: F.col(f"child.{c}"))))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    cut = F.translate("text", "\n", "")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    changed = F.when(tampered, leaf_digest([cut if c == "text" else F.col(c) for c in FIELDS]))
    proved = prove(docs, carry={"changed": changed})
    return (proved.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("proof")))
                  .select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                          (F.col("folded_root") == F.col("root")).alias("verified")))


#: crc32 of the key's decimal text, bit by bit (DuckDB has no function for it).
_CRC = ("list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), "
        "lambda h, d: list_reduce(list_prepend(xor(h, d), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))")

SQL = f"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text, {_CRC.format(c="doc_id")} AS crc,
         concat(coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', CAST(doc_id AS VARCHAR)), '-'),
                coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head,
         replace(text, chr(10), '') AS cut
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(concat(coalesce(head, ''), coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
         sha256(concat(coalesce(head, ''), coalesce(CASE WHEN (crc & 1) = 1 THEN strlen(cut) || ':' || cut ELSE strlen(text) || ':' || text END, '-'))) AS shown
  FROM f),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM leaves),
low(tree, l, p, n, digest) AS (
  SELECT tree, 0, p, n, leaf FROM placed
  UNION ALL
  SELECT tree, any_value(l) + 1, p // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY p)) FROM low WHERE n > 1 GROUP BY tree, p // 3),
subroots AS (SELECT tree, l AS height, digest FROM low WHERE n = 1),
high(l, p, n, digest) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroots), digest FROM subroots
  UNION ALL
  SELECT any_value(l) + 1, p // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY p)) FROM high WHERE n > 1 GROUP BY p // 3),
sides AS (
  SELECT a.tree, a.l, a.p, coalesce(string_agg(b.digest, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS after
  FROM low a JOIN low b ON a.tree = b.tree AND a.l = b.l AND a.p // 3 = b.p // 3 WHERE a.n > 1 GROUP BY a.tree, a.l, a.p
  UNION ALL
  SELECT -1, a.l, a.p, coalesce(string_agg(b.digest, '' ORDER BY b.p) FILTER (b.p < a.p), ''),
         coalesce(string_agg(b.digest, '' ORDER BY b.p) FILTER (b.p > a.p), '')
  FROM high a JOIN high b ON a.l = b.l AND a.p // 3 = b.p // 3 WHERE a.n > 1 GROUP BY a.l, a.p),
walk(tree, start, t, l, p, acc, proof) AS (
  SELECT tree, p, CASE WHEN n = 1 THEN -1 ELSE tree END, 0, CASE WHEN n = 1 THEN tree ELSE p END, shown, '' FROM placed
  UNION ALL
  SELECT w.tree, w.start, CASE WHEN w.t >= 0 AND w.l + 1 = r.height THEN -1 ELSE w.t END, CASE WHEN w.t >= 0 AND w.l + 1 = r.height THEN 0 ELSE w.l + 1 END,
         CASE WHEN w.t >= 0 AND w.l + 1 = r.height THEN w.tree ELSE w.p // 3 END, sha256(s.before || w.acc || s.after), w.proof || s.before || s.after
  FROM walk w JOIN sides s ON s.tree = w.t AND s.l = w.l AND s.p = w.p JOIN subroots r ON r.tree = w.tree),
ends AS (SELECT tree, start, acc, proof FROM walk WHERE t = -1 AND l = (SELECT max(l) FROM high))
SELECT doc_id, leaf, r.digest AS subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.acc AS folded_root, e.acc = t.digest AS verified
FROM placed x JOIN subroots r ON r.tree = x.tree JOIN ends e ON e.tree = x.tree AND e.start = x.p CROSS JOIN (SELECT digest FROM high WHERE n = 1) t
"""
