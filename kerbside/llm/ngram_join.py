"""N-gram Jaccard join: a grouped prefix join on 5-word shingle sets, and the
classes its links form.

1. Document frequencies of all shingles are counted over the whole corpus (one
   packed shuffle of 32-bit keys).  The order of shingles puts the at most
   ``DEMOTED`` most frequent ones (frequency ``HEAVY`` and more) last, by frequency;
   all others come by hash.  Any order gives the same links; this one keeps
   passages that many documents share out of the prefixes.
2. Two sets of Jaccard 0.8 or more share a shingle among the first
   n − ceil(0.8 n) + 1 of each.  Documents with the same prefix and size are one
   group: (shingle, group) postings are sent once per group and task, and lists
   with the same groups count once.
3. Group pairs of a list are filtered by size (lists are cut into overlapping size
   classes of ratio 1.25), groups are expanded to their distinct sets, and sets are
   verified exactly against each other.
4. Only the classes are asked for, so a pair whose ends are already connected needs
   no test.  In a few rounds each list's members are tested against one member (a
   different one each round), and connected components are formed; then every
   remaining pair of a list with ends in different components is tested.  No link
   between different sets is lost, and a group of thousands of near copies costs a
   few tests per member instead of all its pairs.

Hot values: copies collapse to one set by a partial aggregate; frequent shingles'
postings are spread by group; a set that is tested against many others is sent
once per 256k shingles of its partners; the joins are sort-merge joins that AQE
splits.  Nothing but the demoted shingles (at most ``DEMOTED`` numbers, a fixed
bound) reaches the driver.  Intermediate tables are written to the shared store.

Defined results: texts without words (or null) have no shingles and a class of
their own; a document's class is the smallest id reachable; null ids take part in
links, and a class with no id at all has a null id; repeated rows get one output
row each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.common import mix64, one_of_equals, read_table, shingle_sets, shuffle_parts, text_chunks
from kerbside.operators.components import connected_components
from kerbside.session import discard, materialize

WORDS, PERCENT = 5, 80
#: Shingles in at least HEAVY documents go last in the order, the DEMOTED most frequent ones.
HEAVY, DEMOTED = 64, 1 << 18
#: Rounds against one member per list before all remaining pairs are tested.
HUB_ROUNDS = 2
#: 64-bit words of a set's parity bitmap.
MAP_WORDS = 16
_MAP = [f"w{i}" for i in range(MAP_WORDS)]
_FLUSH = 3_000_000  # shingles a task holds before it sends them on
_CHUNK_SHINGLES = 1 << 18  # shingles tested against one set in one go


def _bucket(h: np.ndarray, parts: int) -> np.ndarray:
    return (h & np.uint64(0xFFFF)) % np.uint64(parts)


def _frequency_key(h: np.ndarray, parts: int) -> np.ndarray:
    """Identity of a shingle in the frequency count: its bucket and 32 bits."""
    return _bucket(h, parts) << np.uint64(32) | h >> np.uint64(32)


def _count(parts: int, k: int):
    def run(batches):
        held, size = [], 0

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(key, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
            low, n = (key & np.uint64(0xFFFFFFFF)).astype("<u4"), n.astype("<u4")
            full = np.flatnonzero(cut[1:] > cut[:-1])
            return pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array([low[cut[b]: cut[b + 1]].tobytes() for b in full], pa.binary()),
                 pa.array([n[cut[b]: cut[b + 1]].tobytes() for b in full], pa.binary())], names=["bucket", "low", "n"])

        for batch in batches:
            for _, data, offs in text_chunks(batch.column(0)):
                for s in shingle_sets(data, offs, k):
                    held.append(_frequency_key(s, parts))
                    size += len(s)
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _heavy(least: int):
    def run(t: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in t["low"]])
        n = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in t["n"]])
        order = np.argsort(low, kind="stable")
        low, n = low[order], n[order]
        at = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        df, low = np.add.reduceat(n.astype(np.int64), at), low[at]
        keep = df >= least
        key = (np.int64(t["bucket"][0].as_py()) << np.int64(32)) | low[keep].astype(np.int64)
        return pa.table({"key": key, "df": df[keep]})

    return run


class Order:
    """The global order of shingles."""

    def __init__(self, key: np.ndarray, df: np.ndarray, parts: int):
        by = np.argsort(key)
        self.key, self.df, self.parts = key[by].astype(np.uint64), df[by].astype(np.int64), parts

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set's prefix in order, and which of its shingles are heavy; ``s`` sorted by hash."""
        n = len(s)
        size = n - (PERCENT * n + 99) // 100 + 1
        if not len(self.key):
            return s[:size], np.zeros(size, dtype=bool)
        k = _frequency_key(s, self.parts)
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        heavy = self.key[at] == k
        light = s[~heavy][:size]
        rest = size - len(light)
        if rest <= 0:
            return light, np.zeros(size, dtype=bool)
        late, df = s[heavy], self.df[at[heavy]]
        late = late[np.lexsort((late, df))][:rest]
        return np.concatenate([light, late]), np.append(np.zeros(len(light), dtype=bool), np.ones(len(late), dtype=bool))


def _group_id(prefix: np.ndarray, n: int) -> np.uint64:
    return mix64(np.array([(mix64(prefix) * (np.arange(len(prefix), dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum() + np.uint64(n)], dtype=np.uint64))[0]


def _set_id(s: np.ndarray) -> np.uint64:
    return mix64(np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s))], dtype=np.uint64))[0]


def _parity(s: np.ndarray) -> np.ndarray:
    """The set's parity bitmap: a bit is set if an odd number of shingles hash to it,
    so two bitmaps differ in at most as many bits as the sets differ in shingles."""
    bits = np.bincount((mix64(s + np.uint64(77)) % np.uint64(64 * MAP_WORDS)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _describe(order, k: int):
    """(id, text hash, text) → (id, th, n, grp, node, w0 …); w: the parity bitmap."""
    def run(batches):
        for batch in batches:
            n, grp, node, maps = [], [], [], [np.zeros((0, MAP_WORDS), dtype=np.int64)]
            for _, data, offs in text_chunks(batch.column(2)):
                for s in shingle_sets(data, offs, k):
                    prefix = order.value.prefix(s)[0] if len(s) else s
                    n.append(len(s))
                    grp.append(int(_group_id(prefix, len(s)).view(np.int64)) if len(s) else None)
                    node.append(int(_set_id(s).view(np.int64)) if len(s) else None)
                    maps.append(_parity(s)[None, :])
            w = np.ascontiguousarray(np.concatenate(maps).T)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(grp, pa.int64()), pa.array(node, pa.int64()),
                                              *[pa.array(x) for x in w]], names=["id", "th", "n", "grp", "node", *_MAP])

    return run


def _post(order, parts: int, k: int):
    """texts → packed postings per bucket; a group is posted once per task."""
    def run(batches):
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0

        def flush():
            tok = np.concatenate([h[0] for h in held])
            grp = np.concatenate([np.full(len(h[0]), h[2], np.int64) for h in held])
            n = np.concatenate([np.full(len(h[0]), h[3], np.int32) for h in held])
            pos = np.concatenate([np.arange(len(h[0]), dtype=np.int32) for h in held])
            heavy = np.concatenate([h[1] for h in held])
            # a frequent shingle's postings are spread by group, all others meet by shingle
            b = np.where(heavy, grp.view(np.uint64) % np.uint64(parts), _bucket(tok, parts)).astype(np.int64)
            by = np.lexsort((grp, b))
            tok, grp, n, pos, heavy, b = tok[by], grp[by], n[by], pos[by], heavy[by], b[by]
            cut = np.searchsorted(b, np.arange(parts + 1))
            full = np.flatnonzero(cut[1:] > cut[:-1])
            cols = [[a[cut[x]: cut[x + 1]].tobytes() for x in full] for a in (tok, grp, n, pos, heavy)]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array(c, pa.binary()) for c in cols]],
                                              names=["bucket", "tok", "grp", "n", "pos", "heavy"])

        for batch in batches:
            for _, data, offs in text_chunks(batch.column(0)):
                for s in shingle_sets(data, offs, k):
                    if len(s):
                        prefix, heavy = order.value.prefix(s)
                        g = int(_group_id(prefix, len(s)).view(np.int64))
                        if g not in seen:
                            seen.add(g)
                            held.append((prefix, heavy, g, len(s)))
                            size += len(prefix)
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _lists(t: pa.Table) -> pa.Table:
    """One bucket's postings → (list, grp, pos); lists with one group go.  Of equal
    lists the one earliest in the order stays: it holds every member's least position."""
    col = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t[c]])
    tok, grp, pos, heavy = col("tok", np.uint64), col("grp", np.int64), col("pos", np.int32), col("heavy", bool)
    by = np.lexsort((grp, tok))
    tok, grp, pos, heavy = tok[by], grp[by], pos[by], heavy[by]
    once = np.append(True, (tok[1:] != tok[:-1]) | (grp[1:] != grp[:-1]))
    tok, grp, pos, heavy = tok[once], grp[once], pos[once], heavy[once]
    hot = (mix64(tok[heavy]).view(np.int64), grp[heavy], pos[heavy])
    tok, grp, pos = tok[~heavy], grp[~heavy], pos[~heavy]
    cold = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    if len(tok):
        at = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        size = np.diff(np.append(at, len(tok)))
        name = mix64(np.add.reduceat(mix64(grp.view(np.uint64)), at) + size.astype(np.uint64))  # by its groups
        order = np.lexsort((pos[at], name))
        first = order[np.append(True, name[order][1:] != name[order][:-1])]
        keep = np.zeros(len(at), dtype=bool)
        keep[first] = True
        rows = np.repeat(keep & (size > 1), size)
        cold = (np.repeat(name, size)[rows].view(np.int64), grp[rows], pos[rows])
    return pa.table({"list": np.concatenate([cold[0], hot[0]]), "grp": np.concatenate([cold[1], hot[1]]), "pos": np.concatenate([cold[2], hot[2]])})


def _blobs(k: int):
    def run(batches):
        for batch in batches:
            node, n, blob = [], [], []
            for _, data, offs in text_chunks(batch.column(0)):
                for s in shingle_sets(data, offs, k):
                    node.append(int(_set_id(s).view(np.int64)) if len(s) else None)
                    n.append(len(s))
                    blob.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(blob, pa.binary())], names=["node", "n", "blob"])

    return run


def _links(own: np.ndarray, s: np.ndarray, n_own: int, n: int) -> bool:
    at = np.minimum(np.searchsorted(own, s), len(own) - 1)
    both = int((own[at] == s).sum())
    return 100 * both >= PERCENT * (n + n_own - both)


def _test(batches):
    """Rows sorted by (b, chunk, role): a set, then its partners → the pairs that link."""
    own, b, n_own = None, None, 0
    for batch in batches:
        out = []
        col = {c: batch.column(batch.schema.get_field_index(c)) for c in ("b", "role", "a", "n", "blob")}
        roles, bs, ass, ns = (col[c].to_pylist() for c in ("role", "b", "a", "n"))
        for i, role in enumerate(roles):
            s = np.frombuffer(col["blob"][i].as_buffer(), np.uint64)
            if role == 0:
                own, b, n_own = s, bs[i], ns[i]
            elif bs[i] == b and _links(own, s, n_own, ns[i]):
                out.append((ass[i], b))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(2)], names=["a", "b"])


def verify(pairs: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """``pairs(a, b, na)`` whose ``sets(node, n, blob)`` link."""
    load = pairs.groupBy("b").agg(F.expr(f"int(ceil(sum(na) / {_CHUNK_SHINGLES}))").alias("chunks"))
    cut = pairs.join(load, "b").select("a", "b", F.expr("pmod(xxhash64(a), chunks)").alias("chunk"))
    partners = cut.join(sets.withColumnRenamed("node", "a"), "a").select("b", "chunk", F.lit(1).alias("role"), "a", "n", "blob")
    owners = (cut.select("b", "chunk").distinct().join(sets.withColumnRenamed("node", "b"), "b")
                 .select("b", "chunk", F.lit(0).alias("role"), F.col("b").alias("a"), "n", "blob"))
    rows = partners.unionByName(owners).repartition(parts, "b", "chunk").sortWithinPartitions("b", "chunk", "role")
    return rows.mapInArrow(_test, "a long, b long")


def _parts(df: DataFrame) -> int:
    return min(1 << 15, shuffle_parts(df))


def shingle_order(texts: DataFrame, k: int = WORDS, heavy: int = HEAVY, demoted: int = DEMOTED) -> Order:
    parts = _parts(texts)
    counted = texts.select("text").mapInArrow(_count(parts, k), "bucket int, low binary, n binary")
    top = counted.groupBy("bucket").applyInArrow(_heavy(heavy), "key long, df long").orderBy(F.desc("df"), "key").limit(demoted).toArrow()
    return Order(top["key"].to_numpy(), top["df"].to_numpy(), parts)


def classes(docs: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, demoted: int = DEMOTED,
            with_text_hash: bool = False) -> DataFrame:
    """One row per document: id, n_shingles, component_id, set_id (equal for equal sets),
    class_node (equal within a class); on request th, the text's hash."""
    spark, parts = docs.sparkSession, _parts(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    order = spark.sparkContext.broadcast(shingle_order(rows, k, heavy, demoted))
    described = materialize(rows.mapInArrow(_describe(order, k), "id long, th long, n long, grp long, node long, " + ", ".join(f"{w} long" for w in _MAP)), "shingled")
    nodes = described.filter("n > 0").groupBy("node").agg(F.min("grp").alias("grp"), F.min("n").alias("n"), F.min("th").alias("th"), F.min("id").alias("id"),
                                                               *[F.min(w).alias(w) for w in _MAP])
    postings = rows.select("text").mapInArrow(_post(order, parts, k), "bucket int, tok binary, grp binary, n binary, pos binary, heavy binary")
    lists = postings.groupBy("bucket").applyInArrow(_lists, "list long, grp long, pos int").groupBy("list", "grp").agg(F.min("pos").alias("pos"))
    # groups → their sets; a group with several sets is a list of its own
    members = nodes.select("node", "grp", "n")
    grown = (lists.join(members, "grp").select("list", "node", "n", "pos")
                  .unionByName(members.select(F.xxhash64(F.lit(3), "grp").alias("list"), "node", "n", F.lit(0).alias("pos"))))
    # two sets of Jaccard 0.8 have sizes within a factor 1.25: they share one of these classes
    cls = F.floor(F.log("n") / F.lit(float(np.log(100 / PERCENT))) + 1e-9).cast("int")
    grown = grown.withColumn("c", F.explode(F.array(cls, cls + 1))).select(F.xxhash64("list", "c").alias("list"), "node", "n", "pos")
    sizes = grown.groupBy("list").agg(F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sig"), F.sum("pos").alias("p"))
    one = sizes.filter("m > 1").groupBy("m", "sig").agg(F.min(F.struct("p", "list")).alias("o")).select("o.list")  # equal lists once, the earliest
    lists = materialize(grown.join(one, "list"), "lists")
    label = nodes.select("node", F.col("node").alias("comp"), *_MAP)  # every set alone
    tested = spark.createDataFrame([], "a long, b long")
    for r in range(HUB_ROUNDS + 1):
        own = lists.join(label, "node")
        mixed = own.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("list")
        own = materialize(own.join(mixed, "list"), "mixed")
        if own.isEmpty():
            discard(own)
            break
        if r < HUB_ROUNDS:
            turn = F.xxhash64("node", F.pmod("list", F.lit(2)), F.lit(r))
            seen = {"b": "node", "nb": "n", "pb": "pos", "cb": "comp", **{f"b{w}": w for w in _MAP}}
            hub = own.groupBy("list").agg(F.min(F.struct(turn.alias("t"), *[F.col(c).alias(x) for x, c in seen.items()])).alias("h"))
            other, apart = hub.select(F.col("list").alias("of"), *[f"h.{x}" for x in seen]), F.col("comp") != F.col("cb")
        else:
            other = own.select(*[F.col(c).alias(x) for x, c in {"of": "list", "b": "node", "nb": "n", "pb": "pos", "cb": "comp", **{f"b{w}": w for w in _MAP}}.items()])
            apart = F.col("comp") < F.col("cb")
        # sizes must fit; what follows their first common shingle must still hold enough shingles; and the bitmaps
        # must not differ in more bits than linked sets may differ in shingles
        room = F.expr(f"{100 + PERCENT} * least(n - pos, nb - pb) >= {PERCENT} * (n + nb) AND 100 * least(n, nb) >= {PERCENT} * greatest(n, nb)")
        differ = " + ".join(f"bit_count({w} ^ b{w})" for w in _MAP)
        near = F.expr(f"{100 + PERCENT} * ({differ}) <= {100 - PERCENT} * (n + nb)")
        pairs = own.join(other, (F.col("list") == F.col("of")) & apart & room & near).select(F.col("node").alias("a"), "b", F.col("n").alias("na"))
        pairs = (pairs.distinct()
                      .join(tested, ["a", "b"], "left_anti").join(tested.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"))
        pairs = materialize(pairs, "pairs")
        tested = tested.unionByName(pairs.select("a", "b"))
        # whole sets for the pairs that are left; a small list of texts is sent to the scan, a large one joined
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = materialize(ends.join(nodes.select("node", "th"), "node").select("th"), "wanted")
        texts = rows.select("th", "text").join(wanted, "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
        blobs = materialize(texts.select("text").mapInArrow(_blobs(k), "node long, n long, blob binary"), "sets")
        links = verify(pairs, blobs.dropDuplicates(["node"]), parts)
        # components of the components found so far
        edges = (links.join(label.select(F.col("node").alias("a"), F.col("comp").alias("src")), "a")
                      .join(label.select(F.col("node").alias("b"), F.col("comp").alias("dst")), "b").select("src", "dst").distinct())
        edges = materialize(edges, "links")
        ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
        joined = connected_components(ends, edges).select(F.col("node").alias("comp"), F.col("label").alias("to"))
        before, label = label, materialize(label.join(joined, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"), *_MAP), "labels")
        discard(before, own, wanted, blobs, edges)
    discard(lists)
    least = label.join(nodes.select("node", "id"), "node").groupBy("comp").agg(F.min("id").alias("component_id"))
    names = label.join(least, "comp").select("node", "component_id", F.col("comp").alias("class_node"))
    return (described.join(names, "node", "left")
                     .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                             F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.col("node").alias("set_id"), "class_node", *(["th"] if with_text_hash else [])))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one per class of linked documents (the first by id, null
    ids last, then by text hash, then by a hash of the row); columns unchanged.  Rows
    without words are in classes of their own."""
    named = classes(docs, id_col=id_col, text_col=text_col, with_text_hash=True)
    # how many rows share an id and a text: only the chosen ones that several share need a choice among rows
    equal = named.filter("n_shingles > 0").groupBy("class_node", F.col(id_col).alias("id"), "th").agg(F.count("*").alias("rows"))
    first = equal.groupBy("class_node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "rows")).alias("k"))
    kept = first.select(F.col("k.id").alias("__id"), F.col("k.th").alias("__th"), (F.col("k.rows") > 1).alias("__several"))
    none = named.filter("n_shingles = 0").select(F.col(id_col).alias("__id"), F.col("th").alias("__th"), F.lit(False).alias("__several")).distinct()
    kept = materialize(kept.unionByName(none), "kept")
    own = docs.withColumn("__t", F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__th"))
    one = own.join(kept.filter("NOT __several"), same, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    several = own.join(kept.filter("__several"), same)
    return one.unionByName(one_of_equals(several, ["__id", "__th"], docs.columns))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents"))
