"""CSV record reader: every column as text, empty cells missing, quoted JSON
arrays and embedded newlines kept, only ``*.csv`` files picked up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kerbside.functions.ordering import global_index
from kerbside.schema import ensure_columns
from kerbside.sources.csv_split import read_csv_split


def read_records_csv(spark: SparkSession, path: str, multi_line: bool | str = True, order_key: str = "id") -> DataFrame:
    """Read incident records from CSV files under ``path``.

    ``escape='"'`` reads JSON arrays inside quoted cells with doubled quotes;
    ``NULL``/``NA`` stay text; both forms of empty cell become null; missing
    known columns are added as nulls.  ``multi_line`` keeps newlines inside
    quoted cells but makes every file one split; with many files (the usual
    layout at scale) that is free, for one huge file without embedded newlines
    pass ``multi_line=False`` so Spark can split it, or ``multi_line="split"`` to split
    it with embedded newlines (two scans, see ``sources/csv_split.py``).

    Record order decides cluster numbering and tie rules.  ``order_key="id"``
    uses the numeric ``id`` column; ``order_key="position"`` replaces ``id``
    by the position in the files (1, 2, … by file path, then row), for inputs
    without a numeric id; ``order_key="file"`` keeps ids of any kind as they are and
    adds that position as ``seq``, which then orders the records."""
    df = read_csv_split(spark, path) if multi_line == "split" else (
        spark.read
             .option("header", True)
             .option("multiLine", multi_line)
             .option("quote", '"')
             .option("escape", '"')
             .option("inferSchema", False)
             .option("mode", "PERMISSIVE")
             .option("pathGlobFilter", "*.[cC][sS][vV]")
             .option("recursiveFileLookup", True)
             .csv(path))
    place = ["__file", "__start", "__row"]
    cells = [F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns if not (order_key == "position" and c == "id") and c not in place]
    if order_key not in ("position", "file"):
        return ensure_columns(df.select(*cells))
    if multi_line == "split":
        numbered = global_index(df.select(*cells, *place), [F.col(c) for c in place], "__at")
        return ensure_columns(numbered.withColumn("id" if order_key == "position" else "seq", F.col("__at") + 1).drop("__at", *place))
    # Spark deals splits to tasks by size: number the rows of each split, and add the rows of the splits before it
    tagged = df.select(*cells, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
                       F.monotonically_increasing_id().alias("__row"))
    splits = tagged.groupBy("__file", "__start").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("__file", "__start", "__first", F.coalesce(before, F.lit(0)).alias("__before"))  # one row per split
    numbered = tagged.join(splits, ["__file", "__start"]).withColumn("id" if order_key == "position" else "seq", F.col("__before") + F.col("__row") - F.col("__first") + 1)
    return ensure_columns(numbered.drop("__file", "__start", "__row", "__first", "__before"))
