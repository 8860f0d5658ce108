"""Token files with constant-time keyed access.

Format (two Parquet tables in one folder of the shared store; Spark writes and
reads them, so any store works):

* ``payload``: rows (shard, block, ids): raw token ids, little-endian unsigned
  16 bit where the vocabulary fits, else 32 bit.  Documents follow each other in
  ascending key order; ``shard`` is a key range, blocks are numbered inside it.
  A block closes once it holds ``BLOCK_TOKENS`` ids; a document is never split.
* ``index``: one row per key bucket: a minimal perfect hash of the bucket's keys
  (levels of bit arrays: a key sits at the first level where no other key shares
  its bit, its slot is the rank of that bit), and per slot a 32-bit fingerprint,
  the shard, block, place in the block, length, and start in the whole corpus.

A lookup hashes the key to its bucket, walks the levels (a constant expected
number), compares the stored fingerprint and reads one slice of one block; keys
that were never stored are turned away by the fingerprint.

Defined results: a null text is empty (it holds the end id only); a null key is
a key; rows that repeat a key are stored as (key, 0), (key, 1), ... in text
order; an empty table writes an empty index.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kerbside.llm.common import mix64, read_table, shuffle_parts, text_chunks
from kerbside.session import ensure_checkpoint_dir

TOKENIZER = "word_bpe_49k.json"
BLOCK_TOKENS = 1 << 18
#: Expected keys of one index bucket.
BUCKET_KEYS = 1024

_PAYLOAD = "shard int, block int, n_tokens long, keys array<long>, seen array<int>, lens array<long>, ids binary"


def _id_type(vocab: int):
    return np.dtype("<u2") if vocab <= 1 << 16 else np.dtype("<u4")


def _encode_blocks(tokenizer: str, end_id: int):
    from kerbside.llm.encode import encoder

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        width = _id_type(max(enc.tokenizer.get_vocab_size(), end_id + 1))
        block, keys, seen, lens, parts, size = 0, [], [], [], [], 0
        last, times = object(), 0

        def flush():
            nonlocal block, keys, seen, lens, parts, size
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()), pa.array([keys], pa.list_(pa.int64())),
                 pa.array([seen], pa.list_(pa.int32())), pa.array([lens], pa.list_(pa.int64())), pa.array([np.concatenate(parts).tobytes()], pa.binary())],
                names=["shard", "block", "n_tokens", "keys", "seen", "lens", "ids"])
            block, keys, seen, lens, parts, size = block + 1, [], [], [], [], 0
            return out

        for batch in batches:
            own = batch.column(0).to_pylist()
            for row, data, offs in text_chunks(batch.column(1)):
                ids, at = enc.encode(data, offs)
                ids = ids.astype(width)
                for i in range(len(at) - 1):
                    key = own[row + i]
                    times = times + 1 if key == last else 0
                    last = key
                    n = int(at[i + 1] - at[i]) + 1
                    keys.append(key)
                    seen.append(times)
                    lens.append(n)
                    parts += [ids[at[i]: at[i + 1]], np.array([end_id], width)]
                    size += n
                    if size >= BLOCK_TOKENS:
                        yield flush()
        if keys:
            yield flush()

    return run


def _key_hashes(key: str, times: str):
    return [F.xxhash64(F.lit(1), F.col(key).isNull(), F.col(key), F.col(times)).alias("h1"),
            F.xxhash64(F.lit(2), F.col(key).isNull(), F.col(key), F.col(times)).alias("h2")]


def _level(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(h + np.uint64(level * 0x51ED270B + 1)) % np.uint64(size)).astype(np.int64)


def build_mph(h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels for distinct 64-bit hashes, and each hash's slot."""
    levels, left, slot, base = [], np.arange(len(h)), np.empty(len(h), dtype=np.int64), 0
    while len(left):
        if len(levels) > 200:
            raise ValueError("equal key hashes in one index bucket")
        size = max(8, int(1.5 * len(left)))
        at = _level(h[left], len(levels), size)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slot[left[alone]] = base + (np.cumsum(bits) - 1)[at[alone]]
        levels.append(bits)
        base += int(bits.sum())
        left = left[~alone]
    return levels, slot


def find_slots(h: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of every hash (-1 where no level has its bit)."""
    rank = np.cumsum(bits) - 1
    slot, left, base = np.full(len(h), -1, dtype=np.int64), np.arange(len(h)), 0
    for level, size in enumerate(sizes):
        at = base + _level(h[left], level, size)
        hit = bits[at]
        slot[left[hit]] = rank[at[hit]]
        left = left[~hit]
        base += size
    return slot


_INDEX = ("bucket long, sizes array<int>, bits binary, prints binary, shard binary, block binary, place binary, length binary, start binary")


def _build_bucket(t: pa.Table) -> pa.Table:
    h2 = t["h2"].to_numpy().view(np.uint64)
    levels, slot = build_mph(h2)
    order = np.argsort(slot)
    raw = lambda c, kind: t[c].to_numpy()[order].astype(kind).tobytes()
    prints = (t["h1"].to_numpy().view(np.uint64)[order] >> np.uint64(32)).astype("<u4")
    return pa.table({"bucket": [t["bucket"][0].as_py()], "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int32())),
                     "bits": [np.packbits(np.concatenate(levels)).tobytes()], "prints": [prints.tobytes()],
                     "shard": [raw("shard", "<i4")], "block": [raw("block", "<i4")], "place": [raw("place", "<i8")],
                     "length": [raw("length", "<i8")], "start": [raw("start", "<i8")]})


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = 2,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write payload and index below ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange(shuffle_parts(docs), "key").sortWithinPartitions("key", "text")
    (ranged.mapInArrow(_encode_blocks(tokenizer, end_id), _PAYLOAD)
           .write.option("compression", "zstd").parquet(f"{path}/payload"))
    blocks = spark.read.parquet(f"{path}/payload").select("shard", "block", "n_tokens", "keys", "seen", "lens")
    # one row per shard: bounded by the partition count
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("t"))
    before = totals.select("shard", (F.sum("t").over(Window.orderBy("shard")) - F.col("t")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")
    begins = blocks.select("shard", "block", inside.alias("begin"))
    entry = (blocks.join(begins, ["shard", "block"]).join(F.broadcast(before), "shard")
                   .select("shard", "block", (F.col("base") + F.col("begin")).alias("begin"), F.posexplode(F.arrays_zip("keys", "seen", "lens")), "lens")
                   .select("shard", "block", "begin", F.col("col.keys").alias("key"), F.col("col.seen").alias("seen"), F.col("col.lens").alias("length"),
                           F.col("pos"), "lens"))
    # the place of a document in its block: a running sum over the block's lengths
    place = F.coalesce(F.sum("length").over(Window.partitionBy("shard", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    entry = entry.drop("lens").withColumn("place", place)
    n = blocks.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = max(1, n // BUCKET_KEYS)
    slots = (entry.select(*_key_hashes("key", "seen"), "shard", "block", "place", "length", (F.col("begin") + F.col("place")).alias("start"))
                  .withColumn("bucket", F.expr(f"pmod(h1, {buckets})")))
    slots.groupBy("bucket").applyInArrow(_build_bucket, _INDEX).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/index")


def _find(t: pa.Table) -> pa.Table:
    """Rows of one bucket: its index row joined to the keys asked for."""
    row = {c: t[c][0].as_py() for c in ("sizes", "bits", "prints", "shard", "block", "place", "length", "start")}
    h1, h2 = (t[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["sizes"])].astype(bool)
    slot = find_slots(h2, row["sizes"], bits)
    prints = np.frombuffer(row["prints"], "<u4")
    ok = (slot >= 0) & (prints[slot] == (h1 >> np.uint64(32)).astype(np.uint32))
    col = lambda c, kind: np.frombuffer(row[c], kind)[slot[ok]]
    own = t.filter(pa.array(ok))
    return pa.table({"key": own["key"], "seen": own["seen"], "shard": col("shard", "<i4"), "block": col("block", "<i4"),
                     "place": col("place", "<i8"), "length": col("length", "<i8"), "start": col("start", "<i8")})


def _slices(tokenizer: str, end_id: int):
    def run(batches):
        for batch in batches:
            d = batch.to_pydict()
            keys, seen, start, out = [], [], [], []
            for ids, n, wanted in zip(d["ids"], d["n_tokens"], d["wanted"]):
                block = np.frombuffer(ids, dtype=f"<u{len(ids) // n}")
                for w in wanted:
                    keys.append(w["key"])
                    seen.append(w["seen"])
                    start.append(w["start"])
                    out.append(block[w["place"]: w["place"] + w["length"]].astype("<u4").tobytes())
            for i in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + 512], pa.int64()), pa.array(seen[i:i + 512], pa.int32()),
                                                  pa.array(start[i:i + 512], pa.int64()), pa.array(out[i:i + 512], pa.binary())],
                                                 names=["key", "seen", "start", "ids"])

    return run


def read_tokens(path: str, keys: DataFrame, tokenizer: str = TOKENIZER, end_id: int = 2) -> DataFrame:
    """``keys(key, seen)`` → ``(key, seen, start, ids)`` for the keys that are
    stored; ids as little-endian unsigned 32-bit integers."""
    spark = keys.sparkSession
    index = spark.read.parquet(f"{path}/index")
    got = index.agg(F.max("buckets")).first()[0]
    if got is None:
        return spark.createDataFrame([], "key long, seen int, start long, ids binary")
    asked = keys.select("key", "seen", *_key_hashes("key", "seen")).withColumn("bucket", F.expr(f"pmod(h1, {int(got)})"))
    # an index row holds about BUCKET_KEYS keys; asked-for keys are distinct, so a bucket's group is small
    found = (asked.groupBy("bucket").cogroup(index.drop("buckets").groupBy("bucket"))
                  .applyInArrow(_find_pair, "key long, seen int, shard int, block int, place long, length long, start long"))
    per = found.groupBy("shard", "block").agg(F.collect_list(F.struct("key", "seen", "place", "length", "start")).alias("wanted"))
    payload = spark.read.parquet(f"{path}/payload").select("shard", "block", "n_tokens", "ids")
    return payload.join(per, ["shard", "block"]).select("n_tokens", "ids", "wanted").mapInArrow(
        _slices(tokenizer, end_id), "key long, seen int, start long, ids binary")


def _find_pair(asked: pa.Table, index: pa.Table) -> pa.Table:
    if asked.num_rows == 0 or index.num_rows == 0:
        return pa.table({"key": pa.array([], pa.int64()), "seen": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()),
                         "block": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in ("place", "length", "start")}})
    for c in ("sizes", "bits", "prints", "shard", "block", "place", "length", "start"):
        asked = asked.append_column(c, pa.array([index[c][0].as_py()] + [None] * (asked.num_rows - 1), index.schema.field(c).type))
    return _find(asked)


def document_keys(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The stored keys of a table: (key, 0) … (key, times − 1)."""
    return (docs.groupBy(F.col(id_col).alias("key")).agg(F.count("*").cast("int").alias("n"))
                .select("key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seen")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token_files-{uuid.uuid4().hex}"
    write_token_files(docs, path)
    got = read_tokens(path, document_keys(docs))
    return got.select(F.col("key").alias("doc_id"), "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
