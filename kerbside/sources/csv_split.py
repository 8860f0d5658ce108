"""CSV files with newlines inside quoted cells, read in splits.

Spark's multi-line CSV reader takes a file as one split, because only the count of
quotes before a line tells whether the line begins a record.  Here the file is read
as lines, in splits, twice:

1. the quotes of every split are counted (an aggregate); running sums over the splits of
   a file, in file order, give each split's parity at its start (one row per split);
2. each split puts its lines together into records, beginning with that parity.  Lines
   before its first record and after its last whole one are fragments; the fragments of
   neighbouring splits are joined up afterwards (at most two per split).

The records are then parsed one by one by ``from_csv``.  No line is shuffled, a file is
read by as many tasks as it has splits, and a lost executor repeats only its own
splits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}

_PIECE = "file string, start long, row long, kind int, text string"
_WHOLE, _HEAD, _TAIL, _ALL = 0, 1, 2, 3


def _assemble(parity: dict):
    """Lines (file, start, row, text) of whole splits in order → records and fragments."""
    def run(batches):
        held: dict = {"key": None}

        def close():
            """What a split leaves at its end: an open record, or lines of one begun before it."""
            if held["key"] is None or not held["lines"]:
                return []
            kind = _ALL if held["before"] else _TAIL
            return [(*held["key"], held["row"], kind, "\n".join(held["lines"]))]

        for batch in batches:
            files, starts, rows, texts = (batch.column(i).to_pylist() for i in range(4))
            odd = [t.count('"') & 1 for t in texts]
            out = []
            for i, text in enumerate(texts):
                key = (files[i], starts[i])
                if key != held["key"]:
                    out += close()
                    inside = bool(parity.get(key, 0))
                    held = {"key": key, "inside": inside, "before": inside, "lines": [], "row": rows[i]}
                if not held["lines"]:
                    held["row"] = rows[i]
                held["inside"] ^= bool(odd[i])
                held["lines"].append(text)
                if not held["inside"]:
                    kind = _HEAD if held["before"] else _WHOLE
                    out.append((*key, held["row"], kind, "\n".join(held["lines"])))
                    held["before"], held["lines"] = False, []
            yield _rows(out)
        yield _rows(close())

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["file", "start", "row", "kind", "text"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the ``*.csv`` files under ``path``: file, start, row (these
    three in order are the order of the files) and its text, header records included."""
    lines = (spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.[cC][sS][vV]").option("recursiveFileLookup", True).text(path)
                  .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                          F.monotonically_increasing_id().alias("row"), F.col("value").alias("text")))
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    per = lines.groupBy("file", "start").agg((F.sum(quotes.cast("long")) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # one row per split that begins inside a record
    inside = per.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("p")).filter("p = 1").collect()
    pieces = lines.mapInArrow(_assemble({(r["file"], r["start"]): 1 for r in inside}), _PIECE)
    # a record begins with a tail and goes on through the following fragments
    parts = pieces.filter(F.col("kind") != _WHOLE)
    order = Window.partitionBy("file").orderBy("start", "row")
    joined = (parts.withColumn("record", F.sum(F.when(F.col("kind") == _TAIL, 1).otherwise(0)).over(order))
                   .groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "row", "text"))).alias("p"))
                   .select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["row"].alias("row"),
                           F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text")))
    return pieces.filter(F.col("kind") == _WHOLE).select("file", "start", "row", "text").unionByName(joined)


def read_csv_split(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files under ``path`` by the header of the first file, all columns as
    text, plus ``__file``, ``__start`` and ``__row``; headers and blank records go."""
    records = csv_records(spark, path).withColumn("text", F.regexp_replace("text", "\r$", ""))
    first = records.orderBy("file", "start", "row").limit(1).select("text").collect()
    if not first:
        return spark.createDataFrame([], "__file string, __start long, __row long")
    names = spark.createDataFrame([(first[0]["text"],)], "t string").select(
        F.from_csv("t", F.lit(", ".join(f"c{i} string" for i in range(first[0]["text"].count(",") + 1))), CSV_OPTIONS).alias("h")).select("h.*").first()
    columns = [n.lstrip("﻿") for n in names if n is not None]
    schema = ", ".join(f"`{c}` string" for c in columns)
    # the header is the first record of each file: the least row of the split at its beginning
    heads = records.filter("start = 0").groupBy("file").agg(F.min("row").alias("row"), F.lit(0).cast("long").alias("start"))
    body = records.join(F.broadcast(heads), ["file", "start", "row"], "left_anti").filter("text <> ''")
    return body.select(F.from_csv("text", F.lit(schema), CSV_OPTIONS).alias("v"), "file", "start", "row").select(
        "v.*", F.col("file").alias("__file"), F.col("start").alias("__start"), F.col("row").alias("__row"))
