"""Incident records derived from the driver's ``events`` table.

The test data has no parking records, so every query reads ``events`` and maps
each event to one raw record (all text, like a CSV row) by integer arithmetic.
The mapping only produces input rows; every analytic step runs on them through
the library operators.  The same text is rendered for Spark and for DuckDB so
that the oracle queries read identical rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# fixed values: the record mapping (placeholders {K} {S} {ADD} {SUB})
_TEMPLATE = """
WITH e AS (
  SELECT event_id, user_id, event_type, value, {K} AS k, date_trunc('second', ts) AS t,
         CASE WHEN user_id BETWEEN 3 AND 11 THEN 3 WHEN user_id BETWEEN 12 AND 14 THEN 12 ELSE user_id END AS h
  FROM {EVENTS}),
g AS (
  SELECT *, CASE WHEN k % 10 = 0 THEN 4e-3 WHEN k % 10 <= 2 THEN 2e-3 ELSE 1e-3 END AS spread,
         ((event_id * 7919 + 13) % 1009) / 1009e0 - 5e-1 AS jx,
         ((event_id * 104729 + 7) % 1013) / 1013e0 - 5e-1 AS jy,
         CAST(floor(value * 60) AS BIGINT) * (CASE WHEN k % 3 = 0 THEN 4 ELSE 1 END) AS secs
  FROM e)
SELECT event_id AS id,
  CASE WHEN event_id % 97 = 0 THEN '0' WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN 'abc'
       ELSE CAST(CAST(1290e-2 + (h % 40) * 4e-3 + jx * spread AS DECIMAL(12,7)) AS {S}) END AS latitude,
  CASE WHEN event_id % 97 = 0 THEN '0'
       ELSE CAST(CAST(7750e-2 + floor(h / 40) * 4e-3 + jy * spread AS DECIMAL(12,7)) AS {S}) END AS longitude,
  CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'CAR' WHEN 2 THEN 'SCOOTER' WHEN 3 THEN 'MOTOR CYCLE'
             WHEN 4 THEN 'LGV' WHEN 5 THEN 'BUS' ELSE 'AUTO' END AS vehicle_type,
  CASE event_type WHEN 'click' THEN '["WRONG PARKING","NO PARKING"]' WHEN 'view' THEN 'NO PARKING'
       WHEN 'purchase' THEN '["PARKING NEAR ROAD-CROSSING"]' WHEN 'signup' THEN '[''FOOTPATH PARKING'',''X'']'
       ELSE CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN '[]' ELSE 'double parking' END END AS violation_type,
  CAST(t AS {S}) || (CASE WHEN k % 5 = 0 THEN '+05:30' ELSE '+00' END) AS created_datetime,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'NULL'
       WHEN event_id % 29 = 0 THEN CAST({SUB} AS {S}) || (CASE WHEN k % 5 = 0 THEN '+05:30' ELSE '+00' END)
       ELSE CAST({ADD} AS {S}) || (CASE WHEN k % 5 = 0 THEN '+05:30' ELSE '+00' END) END AS closed_datetime,
  CASE WHEN h % 5 = 4 THEN 'No Junction' WHEN h % 11 = 10 THEN NULL
       ELSE 'BTP' || lpad(CAST((h + k % 3) % 23 AS {S}), 3, '0') || ' - Junction ' || CAST((h + k % 3) % 23 AS {S}) || ', Ward ' || CAST(h % 4 AS {S}) END AS junction_name,
  CASE WHEN k % 13 = 0 THEN NULL ELSE 'PS ' || CAST((h + k % 2) % 9 AS {S}) END AS police_station,
  CASE event_id % 19 WHEN 0 THEN 'INVALID' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' WHEN 3 THEN NULL ELSE 'VALID' END AS validation_status
FROM g
"""

_SPARK = {
    "{K}": "CAST(get_json_object(props,'$.k') AS BIGINT)",
    "{S}": "STRING",
    "{ADD}": "timestampadd(SECOND, secs, t)",
    "{SUB}": "timestampadd(SECOND, -300, t)",
}
_DUCKDB = {
    "{K}": "CAST(json_extract_string(props,'$.k') AS BIGINT)",
    "{S}": "VARCHAR",
    "{ADD}": "t + to_seconds(secs)",
    "{SUB}": "t - to_seconds(300)",
}


def _render(mapping: dict[str, str], events: str) -> str:
    s = _TEMPLATE
    for k, v in mapping.items():
        s = s.replace(k, v)
    return s.replace("{EVENTS}", events)


def duckdb_fixture_sql(events: str = "events") -> str:
    """The record mapping as DuckDB SQL over the ``events`` view."""
    return _render(_DUCKDB, events)


def violations_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Raw incident records (text columns, ``id`` long) from an events frame."""
    name = f"kerbside_events_{uuid.uuid4().hex}"
    events.createOrReplaceTempView(name)
    return spark.sql(_render(_SPARK, name))


def load_violations_raw(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Raw records for a test-data folder (reads ``events.parquet``).  With ``partitions``
    the events are spread first, before they become the wider text records."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if partitions:
        events = events.select("event_id", "ts", "user_id", "event_type", "value", "props").repartition(partitions)
    return violations_from_events(spark, events)
