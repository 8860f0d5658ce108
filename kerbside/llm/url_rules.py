"""URL rules by a sort-merge range join (native: DataFrame functions only).

A host becomes a canonical key of reversed labels (``blog.example.net`` →
``net.example.blog.``), so a rule's host with all its subdomains is the
interval of keys that start with the rule's key; rule paths are intervals of
path prefixes in the same way.  Prefix intervals are nested or disjoint, so one
sweep over the merged, range-partitioned and sorted keys is enough: the last
rule started before a key carries the stack of rules nested around it, and the
rules of that stack that are still open at the key are the active ones.

Two sweeps: over hosts (URL → active rule hosts, at most its label count) and
over (rule host, path) (→ active rule paths).  Range partitions are split by a
hash inside equal keys, so one host with a third of all URLs spreads over many
tasks; the rule in force where a partition begins comes from a table of one row
per partition.

Defined results: a null URL or one without ``://`` has empty host and path and
no rule; repeated pages are judged one by one; with no fitting rule the rule is
null and the verdict ``default``; of two fitting rules the longer text wins,
then ``block``, then the greater text; an empty rule set or page table works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kerbside.llm.common import read_table, shuffle_parts
from kerbside.session import materialize

# Fixed values of the task: (verdict, rule text = host + path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = F.expr("substring(__u, instr(__u, '://') + 3)")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)


def url_path() -> Column:
    return F.regexp_extract(F.expr("substring(__u, instr(__u, '://') + 3)"), "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def _sweep(points: DataFrame, starts: DataFrame) -> DataFrame:
    """``points(key, tie, ...)`` plus ``active``: the keys of ``starts(key, stack)``
    that are prefixes of the point's key.  ``stack`` lists, for each start, the
    starts that are prefixes of it (itself included)."""
    parts = shuffle_parts(points)
    cols = [c for c in points.columns if c not in ("key", "tie")]
    merged = points.withColumns({"kind": F.lit(1), "stack": F.lit(None).cast("array<string>")}).unionByName(
        starts.select("key", "stack").withColumns({"kind": F.lit(0), "tie": F.lit(0).cast("long")}), allowMissingColumns=True)
    order = ["key", "kind", "tie"]
    # written once: the partition numbers below must not be computed a second time
    ranged = materialize(merged.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id()), "sweep")
    # one row per partition: bounded by the partition count
    per = ranged.groupBy("pid").agg(F.expr("max_by(stack, key) FILTER (WHERE kind = 0)").alias("last"))
    carry = per.select("pid", F.last("last", ignorenulls=True).over(
        Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    inside = F.last("stack", ignorenulls=True).over(
        Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (ranged.withColumn("open", inside).filter("kind = 1")
                  .join(F.broadcast(carry), "pid")
                  .withColumn("stack", F.coalesce("open", "carry"))
                  .select("key", *cols, F.filter(F.coalesce("stack", F.array().cast("array<string>")),
                                                 lambda p: F.col("key").startswith(p)).alias("active")))


def _stacks(keys: DataFrame, ends: Column) -> DataFrame:
    """``keys(key)`` → ``(key, stack)``: the keys that are prefixes of each key.
    ``ends`` is the array of prefix lengths to try."""
    k = keys.select("key").distinct()
    tried = k.select(F.col("key").alias("of"), F.explode(ends).alias("n")).select("of", F.expr("left(of, n)").alias("key"))
    return tried.join(k, "key").groupBy("of").agg(F.sort_array(F.collect_set("key")).alias("stack")).withColumnRenamed("of", "key")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """``rules(verdict, rule)`` with rule = host + path (the path from the first
    ``/``) → one row per page: id, host, path, rule, verdict."""
    bare = F.col("__u").isNull() | ~F.col("__u").contains("://")
    urls = (pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("__u"))
                 .select("id", F.when(bare, "").otherwise(url_host(F.col("__u"))).alias("host"),
                         F.when(bare, "").otherwise(url_path()).alias("path"))
                 .withColumn("rid", F.monotonically_increasing_id()))
    r = (rules.select("verdict", "rule").filter(F.col("rule").isNotNull())
              .withColumn("rhost", host_key(F.translate(F.regexp_extract("rule", "^[^/]*", 0), _UPPER, _LOWER)))
              .withColumn("rpath", F.regexp_extract("rule", "^[^/]*(/.*)?$", 1))
              .groupBy("rhost", "rpath").agg(F.max(F.struct(F.length("rule").alias("len"), F.col("verdict"), F.col("rule"))).alias("best"))
              .withColumn("key", F.concat("rhost", F.lit("\u0001"), "rpath")))
    # sweep 1: active rule hosts; prefixes end after a label
    hosts = r.select(F.col("rhost").alias("key"))
    label_ends = F.expr("transform(split(left(key, length(key) - 1), '[.]'), (x, i) -> "
                        "length(array_join(slice(split(key, '[.]'), 1, i + 1), '.')) + 1)")
    tie = F.xxhash64("id", "host", "path", "rid")
    on_host = _sweep(urls.withColumns({"key": host_key(F.col("host")), "tie": tie}), _stacks(hosts, label_ends))
    # sweep 2: active paths below each active host; prefixes end after any character of the path
    cand = on_host.select("id", "rid", "host", "path", F.explode_outer("active").alias("rhost"))
    points = (cand.filter(F.col("rhost").isNotNull())
                  .withColumns({"key": F.concat("rhost", F.lit("\u0001"), "path"), "tie": F.xxhash64("rid", "rhost")}))
    char_ends = F.expr("sequence(instr(key, '\u0001'), length(key))")
    on_path = _sweep(points, _stacks(r, char_ends))
    hit = on_path.select("id", "rid", "host", "path", F.explode("active").alias("key")).join(r.select("key", "best"), "key")
    misses = on_host.select("id", "rid", "host", "path", F.lit(None).cast(r.schema["best"].dataType).alias("best"))
    out = hit.select("id", "rid", "host", "path", "best").unionByName(misses).groupBy("rid", "id", "host", "path").agg(F.max("best").alias("best"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                      F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, rule string")
    return judge_urls(read_table(spark, sf_dir, "pages"), rules)


SQL = """
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rule, rhost, rpath) AS (VALUES ('block','net/','net','/'), ('allow','example.net/en/','example.net','/en/'),
    ('block','example.com/de/','example.com','/de/'), ('allow','org/fr/','org','/fr/')),
m AS (SELECT page_id, host, path, verdict, rule FROM h LEFT JOIN r
      ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM m GROUP BY page_id, host, path
"""
