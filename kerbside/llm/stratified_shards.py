"""Sharding by proportional stratified interleaving (native).

Within each source the rows are put in a seeded pseudo-random order and ranked;
row r of a source with n rows gets the fractional rank (r + u) / n, where
0 <= u < 1 is fixed per source.  Sorting all rows by fractional rank
interleaves the sources in proportion, and cutting that order into equal runs
gives shards that each match the corpus mixture.  Law: ``rows`` (row counts of
the shards differ by at most one).

No step sorts a source or the corpus in one task.  Ranks inside a source are
counted by hash range: ranges of the shuffle hash per source, as many as give a range
about ``RANGE_ROWS`` rows of the corpus (1,024 at least), an offset per range
(aggregate), and a row number inside the range.  The global order is
cut the same way by ranges of the fractional rank, which are even by
construction (u spreads the sources that have few rows).  Texts do not travel:
the first scan reduces each row to its size, checksum and hash.

Defined results: a null text has no bytes (size 1, checksum 0); a null source
is a source of its own; null ids and repeated rows are rows like any other; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kerbside.llm.common import read_table
from kerbside.session import materialize


#: Rows that one task numbers in one go.
RANGE_ROWS = 1 << 18


def interleave_shards(docs: DataFrame, shards: int = 8, seed: int = 11, id_col: str = "doc_id",
                      text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("src"), F.col(source_col).isNull().alias("nosrc"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("h")), "shard_rows")
    ranges = max(1024, rows.count() // RANGE_ROWS)
    rows = rows.withColumn("hr", F.expr(f"pmod(shiftrightunsigned(h, 32), {ranges})"))
    of = ["src", "nosrc"]
    counts = rows.groupBy(*of, "hr").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*of)
    offsets = counts.select(*of, "hr", (F.sum("c").over(whole.orderBy("hr")) - F.col("c")).alias("off"),
                            F.sum("c").over(whole).alias("n"))
    order = ["h", "id", "crc", "size"]
    rank = F.row_number().over(Window.partitionBy(*of, "hr").orderBy(*order)) - 1
    ranked = rows.withColumn("r", rank).join(offsets, [*of, "hr"])
    u = F.expr(f"shiftrightunsigned(xxhash64({int(seed)} + 1, src, nosrc), 12)") / F.lit(float(1 << 52))
    frac = materialize(ranked.select("id", "size", "crc", "h", "src", "nosrc", ((F.col("off") + F.col("r") + u) / F.col("n")).alias("frac"))
                       .withColumn("fr", F.least(F.floor(F.col("frac") * ranges), F.lit(ranges - 1))), "shard_frac")
    per = frac.groupBy("fr").agg(F.count("*").alias("c"))  # one row per range
    off = per.select("fr", (F.sum("c").over(Window.orderBy("fr")) - F.col("c")).alias("off"),
                     F.sum("c").over(Window.partitionBy()).alias("total"))
    pos = F.row_number().over(Window.partitionBy("fr").orderBy("frac", "src", "nosrc", *order)) - 1
    placed = frac.withColumn("p", pos).join(F.broadcast(off), "fr").withColumn("p", F.col("p") + F.col("off"))
    shard = F.expr(f"(p * {int(shards)}) div total")
    return (placed.withColumn("shard", shard.cast("int"))
                  .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
                          (F.col("p") - F.expr(f"(shard * total + {int(shards)} - 1) div {int(shards)}")).alias("slot"),
                          F.lit(None).cast("int").alias("grown_shard")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave_shards(read_table(spark, sf_dir, "documents"))
