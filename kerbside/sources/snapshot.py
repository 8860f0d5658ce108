"""Result snapshots: JSON-lines folders per section, published atomically.

A run writes every section under ``<root>/runs/<run_id>/<section>/`` (Spark writes,
distributed and retried on executor loss) and then a pointer file (run, schemas of
its sections) ``<root>/CURRENT/<number>.json``.  A number is taken by creating its file
only if it does not exist, so of publishers that run at once each gets its own number, in
the order in which they finish; readers take the highest number, and see either
the old or the new run as a whole.  Nothing is overwritten.  ``prune`` removes old runs."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions.text import finite_columns
from kerbside.operators.outputs import ts_text
from kerbside.operators.score import BATCH_WINDOW_DEFAULT, BATCH_WINDOW_HIGH

SECTIONS = ("dashboard", "clusters", "map_points", "recommendations")


def _json_ready(df: DataFrame) -> DataFrame:
    """Timestamps as display text and no NaN or infinity (JSON has neither)."""
    df, cols = finite_columns(df), []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(ts_text(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_section(df: DataFrame, path: str) -> None:
    _json_ready(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def publish(spark: SparkSession, root: str, run_id: str, sections: dict[str, DataFrame]) -> str:
    """Write all sections of one run, then the pointer (last)."""
    base = f"{root.rstrip('/')}/runs/{run_id}"
    for name, df in sections.items():
        write_section(df, f"{base}/{name}")
    schemas = {name: _json_ready(df).schema.json() for name, df in sections.items()}
    last = _pointer(spark, root)
    number = (last["number"] if last else 0) + 1
    while not _create(spark, f"{root.rstrip('/')}/CURRENT/{number:012d}.json", json.dumps({"number": number, "run_id": run_id, "schemas": schemas})):
        number += 1  # another publisher has taken it
    return base


_POINTER = "number long, run_id string, schemas map<string,string>"


def _files(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(sc._jsc.hadoopConfiguration())


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it exists: its text goes to a file of its own first, and
    the number is taken by creating the (empty) claim beside it, which only one can."""
    where, fs = _files(spark, path)
    claim, _ = _files(spark, path.replace("/CURRENT/", "/CURRENT/_claim-"))  # readers skip names with _
    if fs.exists(where):
        return False
    try:
        fs.create(claim, False).close()
    except Py4JJavaError as e:
        if fs.exists(claim):
            return False
        raise e
    draft, _ = _files(spark, path.replace("/CURRENT/", "/CURRENT/_draft-"))
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    return bool(fs.rename(draft, where))


def prune(spark: SparkSession, root: str, keep: int = 3) -> list[str]:
    """Remove all but the last ``keep`` published runs and their pointers; returns the
    ids of the removed runs (a run that a kept pointer names stays)."""
    rows = spark.read.schema(_POINTER).json(f"{root.rstrip('/')}/CURRENT").orderBy(F.desc("number")).select("number", "run_id").collect()
    kept = {r["run_id"] for r in rows[:keep]}
    gone = []
    for r in rows[keep:]:
        where, fs = _files(spark, f"{root.rstrip('/')}/CURRENT/{r['number']:012d}.json")
        fs.delete(where, False)
        if r["run_id"] not in kept and r["run_id"] not in gone:
            run, _ = _files(spark, f"{root.rstrip('/')}/runs/{r['run_id']}")
            fs.delete(run, True)
            gone.append(r["run_id"])
    return gone


def _pointer(spark: SparkSession, root: str) -> Row | None:
    try:
        return spark.read.schema(_POINTER).json(f"{root.rstrip('/')}/CURRENT").orderBy(F.desc("number")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_run(spark: SparkSession, root: str) -> Row:
    """The pointer of the last published run."""
    last = _pointer(spark, root)
    if last is None:
        raise FileNotFoundError(f"no run is published under {root}")
    return last


def read_section(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_published(spark: SparkSession, root: str, section: str) -> DataFrame:
    """A section of the current run, with the schema it was written with (so an
    empty section keeps its columns)."""
    run = current_run(spark, root)
    schema = T.StructType.fromJson(json.loads(run["schemas"][section]))
    return read_section(spark, f"{root.rstrip('/')}/runs/{run['run_id']}/{section}", schema)


def backfill_clusters(clusters: DataFrame) -> DataFrame:
    """Fill score columns an older snapshot lacks: ``impact_score`` =
    violation_count/10; patrol window by peak ratio > 0.5; tier by the
    75/55/35 cuts; colour from the tier.  Present columns are kept."""
    from kerbside.operators.score import priority_color, priority_tier
    df = clusters
    if "impact_score" not in df.columns:
        df = df.withColumn("impact_score", F.col("violation_count").cast("double") / F.lit(10.0))
    if "recommended_enforcement_time" not in df.columns:
        df = df.withColumn("recommended_enforcement_time",
                           F.when(F.col("peak_hour_ratio").cast("double") > 0.5, BATCH_WINDOW_HIGH).otherwise(BATCH_WINDOW_DEFAULT))
    if "priority_tier" not in df.columns:
        df = df.withColumn("priority_tier", priority_tier(F.col("impact_score"), "batch"))
    if "priority_color" not in df.columns:
        df = df.withColumn("priority_color", priority_color(F.col("priority_tier")))
    return df
