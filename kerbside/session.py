"""Session helpers: building a session for local runs and locating the
checkpoint folder used to cut lineage in iterative jobs."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LONGEST = "spark.sql.codegen.hugeMethodLimit"


def build_session(master: str | None = None, app: str = "kerbside", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """A session tuned for these jobs.  On a cluster ``master`` is left to
    spark-submit; locally it defaults to ``local[*]``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when none is configured (a local test session) is a fresh scratch
    folder created; on a cluster the shared folder from the session is used."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
    else:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kerbside-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


def materialize(df, name: str, compression: str | None = None):
    """Write ``df`` as a parquet table in the shared checkpoint folder and read
    it back: lineage is cut, and later scans prune columns and push filters
    (a checkpointed frame is an RDD scan and cannot)."""
    import uuid

    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tables/{name}-{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        df.write.mode("overwrite").parquet(path, compression=compression)
    out = spark.read.parquet(path)
    out.kerbside_path = path
    if spark.sparkContext.applicationId not in _WRITTEN:
        _WRITTEN.clear()
        _WRITTEN[spark.sparkContext.applicationId] = set()
    _WRITTEN[spark.sparkContext.applicationId].add(path)
    return out


#: Tables written and not yet discarded, of the running application.
_WRITTEN: dict[str, set[str]] = {}


def written_tables(spark: SparkSession) -> set[str]:
    """Paths of the tables that ``materialize`` has written and nothing has discarded."""
    return set(_WRITTEN.get(spark.sparkContext.applicationId, ()))


def discard_paths(spark: SparkSession, paths) -> None:
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(path)


def spread(df):
    """``df`` over as many partitions as the session shuffles to: a table that is small
    but whose rows are costly to work on is not read back as one split."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism))


@contextmanager
def _held(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy_shuffles(spark: SparkSession):
    """Actions inside drop their shuffle files as they end: what they have written
    is read from the table, so nothing fetches those files again."""
    return _held(spark, _TIDY, "true")


def compiled_steps(spark: SparkSession):
    """Actions inside fuse a step only into methods that the virtual machine compiles (8,000
    bytes); it interprets longer ones, so steps of many columns run operator by operator."""
    return _held(spark, _LONGEST, "8000")


def discard(*tables) -> None:
    """Delete the files of tables that ``materialize`` returned, once nothing that is
    still to run reads them (a frame that is no such table is left alone)."""
    for df in tables:
        path = getattr(df, "kerbside_path", None)
        if path:
            discard_paths(df.sparkSession, [path])
            df.kerbside_path = None
