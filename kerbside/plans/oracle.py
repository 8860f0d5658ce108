"""DuckDB oracle SQL for the query catalogue.

Written as plain SQL against the driver's pre-registered views, independently
of the Spark operators: the records come from the shared fixture mapping, and
cleaning, statistics and clustering are re-stated here in SQL.  Floating
results that depend on summation order are rounded to 9 places on both sides.
"""

from __future__ import annotations

from kerbside.sources.fixture import duckdb_fixture_sql

EPS = {"live": 8e-4, "batch": 1e-3}
MIN_SAMPLES = {"live": 5, "batch": 8}

TITLE = "array_to_string(list_transform(regexp_extract_all({s}, '(\\p{{L}}+|\\P{{L}}+)'), lambda x: upper(x[1]) || lower(x[2:])), '')"


def title(expr: str) -> str:
    return TITLE.format(s=expr)


def _vtype(profile: str) -> str:
    s = "trim(violation_type, ' \t\n\r')"
    is_arr = f"(starts_with({s}, '[') AND COALESCE(CASE WHEN json_valid({s}) THEN json_type({s}) = 'ARRAY' END, false))"
    first = f"(CASE WHEN {is_arr} THEN json_extract_string({s}, '$[0]') END)"
    if profile == "live":
        stripped = f"regexp_replace(regexp_replace(trim(split_part(regexp_replace({s}, '^[\\[\\]]+|[\\[\\]]+$', '', 'g'), ',', 1), ' \t\n\r'), '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')"
        return f"""CASE WHEN violation_type IS NULL THEN 'Unknown'
            WHEN {is_arr} AND {first} IS NOT NULL THEN {title(first)}
            WHEN {is_arr} THEN {title(s)}
            WHEN starts_with({s}, '[') THEN CASE WHEN {stripped} <> '' THEN {title(stripped)} ELSE 'Unknown' END
            WHEN {s} <> '' THEN {title(s)} ELSE 'Unknown' END"""
    quoted = f"regexp_extract({s}, '\"([^\"]+)\"', 1)"
    return f"""CASE WHEN violation_type IS NULL OR violation_type IN ('nan', 'NULL', '') THEN 'Unknown'
            WHEN {is_arr} AND {first} IS NOT NULL THEN {title(first)}
            WHEN starts_with({s}, '[') AND NOT {is_arr} AND {quoted} <> '' THEN {title(quoted)}
            ELSE {title(s)} END"""


def _ts(col: str, profile: str) -> str:
    base = f"TRY_CAST(regexp_replace({col}, '\\s*(Z|[+-]\\d\\d(:?\\d\\d)?)$', '') AS TIMESTAMP)"
    if profile == "live":
        return base
    off = f"regexp_extract({col}, '\\d\\d:\\d\\d(:\\d\\d(\\.\\d+)?)?\\s*(Z|[+-]\\d\\d(:?\\d\\d)?)$', 3)"
    secs = (f"(CASE WHEN {off} IN ('', 'Z') THEN 0 ELSE (CASE WHEN {off}[1] = '-' THEN -1 ELSE 1 END) * "
            f"(CAST({off}[2:3] AS INTEGER) * 3600 + COALESCE(TRY_CAST(regexp_extract({off}, '^[+-]\\d\\d:?(\\d\\d)$', 1) AS INTEGER), 0) * 60) END)")
    return f"({base} - to_seconds({secs}))"


def violations_cte(profile: str = "live") -> str:
    """``raw`` and ``v`` CTEs: fixture records and the cleaned frame."""
    status = ("validation_status IS DISTINCT FROM 'INVALID'" if profile == "live"
              else "lower(validation_status) IN ('approved', 'valid')")
    created_filter = "" if profile == "live" else " AND created_datetime IS NOT NULL"
    return f"""raw AS ({duckdb_fixture_sql('events')}),
c0 AS (
  SELECT id,
    CASE WHEN isnan(TRY_CAST(latitude AS DOUBLE)) THEN NULL ELSE TRY_CAST(latitude AS DOUBLE) END AS latitude,
    CASE WHEN isnan(TRY_CAST(longitude AS DOUBLE)) THEN NULL ELSE TRY_CAST(longitude AS DOUBLE) END AS longitude,
    nullif(vehicle_type, '') AS vehicle_type,
    {_vtype(profile)} AS violation_type,
    {_ts("nullif(created_datetime, '')", profile)} AS created_datetime,
    {_ts("nullif(closed_datetime, '')", profile)} AS closed_datetime,
    nullif(junction_name, '') AS junction_name,
    nullif(police_station, '') AS police_station,
    nullif(validation_status, '') AS validation_status
  FROM raw),
v AS (
  SELECT *,
    CAST(hour(created_datetime) AS INTEGER) AS hour_of_day,
    dayname(created_datetime) AS day_of_week,
    (epoch_us(closed_datetime) - epoch_us(created_datetime)) / 6e7 AS resolution_minutes,
    COALESCE(hour(created_datetime) IN (7, 8, 9, 17, 18, 19, 20), false) AS is_peak_hour,
    CAST(weekofyear(created_datetime) AS INTEGER) AS week_number,
    CAST(month(created_datetime) AS INTEGER) AS month
  FROM c0
  WHERE latitude IS NOT NULL AND latitude <> 0 AND longitude IS NOT NULL AND longitude <> 0
    AND {status}{created_filter})"""


def xmean(expr: str, scale: str) -> str:
    """Exact, order-independent mean (values quantised to 1/scale)."""
    return f"(CAST(sum(CAST(round(({expr}) * {scale}) AS HUGEINT)) AS DOUBLE) / CAST(count({expr}) AS DOUBLE) / {scale})"


def q(profile: str, body: str, extra_ctes: str = "") -> str:
    ctes = violations_cte(profile)
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"


ORACLES: dict[str, str] = {}


def oracle(name: str):
    def deco(fn):
        ORACLES[name] = fn()
        return fn
    return deco


CLEAN_COLS = ("id, latitude, longitude, vehicle_type, violation_type, created_datetime, closed_datetime, "
              "junction_name, police_station, validation_status, hour_of_day, day_of_week, resolution_minutes, "
              "is_peak_hour, week_number, month")


@oracle("clean_live")
def _():
    return q("live", f"SELECT {CLEAN_COLS} FROM v")


@oracle("clean_batch")
def _():
    return q("batch", f"SELECT {CLEAN_COLS} FROM v")


@oracle("hourly")
def _():
    return q("live", """SELECT CAST(h.range AS INTEGER) AS hour, count(v.id) AS count
FROM range(24) h LEFT JOIN v ON v.hour_of_day = h.range GROUP BY h.range ORDER BY 1""")


@oracle("violation_type_norm")
def _():
    return f"""WITH {violations_cte('live').split(',' + chr(10) + 'c0 AS')[0]},
r AS (SELECT id, nullif(violation_type, '') AS violation_type FROM raw)
SELECT id, {_vtype('live')} AS type_live, {_vtype('batch')} AS type_batch FROM r"""


@oracle("finite_or_null")
def _():
    return q("live", "SELECT id, CASE WHEN resolution_minutes < 0 THEN NULL ELSE sqrt(resolution_minutes) END AS root_minutes FROM v")


@oracle("junction_label")
def _():
    lbl = "trim(split_part(regexp_replace(junction_name, '^BTP\\d+\\s*-\\s*', ''), ',', 1))"
    return q("live", f"""SELECT junction_name, {lbl} AS label,
  CASE WHEN length({lbl}) > 18 THEN substr({lbl}, 1, 16) || '…' ELSE {lbl} END AS kpi_label, count(*) AS count
FROM v WHERE junction_name IS NOT NULL GROUP BY junction_name""")


@oracle("data_profile")
def _():
    return q("live", """SELECT (SELECT count(*) FROM v) AS total_records,
  (SELECT min(created_datetime) FROM v) AS date_from, (SELECT max(created_datetime) FROM v) AS date_to,
  (SELECT count(DISTINCT junction_name) FROM v) AS unique_junctions,
  (SELECT string_agg(violation_type || ':' || CAST(n AS VARCHAR), '|' ORDER BY n DESC, violation_type)
     FROM (SELECT violation_type, count(*) AS n, min(id) AS f FROM v GROUP BY 1 ORDER BY n DESC, f LIMIT 5)) AS top_violation_types""")


DAYS = "('Monday',0),('Tuesday',1),('Wednesday',2),('Thursday',3),('Friday',4),('Saturday',5),('Sunday',6)"


@oracle("day_of_week")
def _():
    return q("live", f"""SELECT d.i AS day_index, d.n AS day_of_week, count(v.id) AS count
FROM (VALUES {DAYS}) d(n, i) LEFT JOIN v ON v.day_of_week = d.n GROUP BY d.i, d.n""")


@oracle("day_of_week_batch")
def _():
    return q("batch", "SELECT day_of_week, count(*) AS count FROM v WHERE day_of_week IS NOT NULL GROUP BY 1")


@oracle("hourly_batch")
def _():
    return q("batch", "SELECT hour_of_day AS hour, count(*) AS count FROM v WHERE hour_of_day IS NOT NULL GROUP BY 1")


@oracle("weekly_trend")
def _():
    return q("live", "SELECT week_number AS week, count(*) AS count FROM v WHERE week_number IS NOT NULL GROUP BY 1")


@oracle("top_junctions")
def _():
    return q("live", f"""SELECT junction_name, n AS count, lat, lon FROM (
  SELECT junction_name, count(*) AS n, {xmean('latitude', '1e7')} AS lat, {xmean('longitude', '1e7')} AS lon, min(id) AS f
  FROM v WHERE junction_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, f LIMIT 10)""")


@oracle("top_junctions_batch")
def _():
    return q("batch", """SELECT junction_name, n AS count FROM (
  SELECT junction_name, count(*) AS n, min(id) AS f FROM v
  WHERE junction_name IS NOT NULL AND junction_name NOT IN ('No Junction', 'nan', 'NULL')
  GROUP BY 1 ORDER BY n DESC, f LIMIT 15)""")


def _half_even_pct(num: str, den: str, scale: int) -> str:
    n = f"(CAST({num} AS BIGINT) * {scale})"
    return (f"(CAST((({n}) // ({den})) + CASE WHEN 2 * (({n}) % ({den})) > ({den}) OR "
            f"(2 * (({n}) % ({den})) = ({den}) AND (({n}) // ({den})) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / {scale}e0)")


@oracle("vehicle_mix")
def _():
    return q("live", f"""SELECT vehicle_type, n AS count, {_half_even_pct('n * 100', 't', 10)} AS percentage FROM (
  SELECT vehicle_type, count(*) AS n, (SELECT greatest(count(*), 1) FROM v) AS t FROM v
  WHERE vehicle_type IS NOT NULL GROUP BY 1)""")


@oracle("vehicle_mix_batch")
def _():
    return q("batch", """SELECT vehicle_type AS type, n AS count FROM (
  SELECT vehicle_type, count(*) AS n, min(id) AS f FROM v WHERE vehicle_type IS NOT NULL
  GROUP BY 1 ORDER BY n DESC, f LIMIT 8)""")


@oracle("violation_mix")
def _():
    return q("live", "SELECT violation_type, count(*) AS count FROM v WHERE violation_type IS NOT NULL GROUP BY 1")


@oracle("violation_mix_batch")
def _():
    return q("batch", """SELECT violation_type, n AS count FROM (
  SELECT violation_type, count(*) AS n, min(id) AS f FROM v GROUP BY 1 ORDER BY n DESC, f LIMIT 10)""")


@oracle("resolution_buckets")
def _():
    return q("live", """SELECT b.i AS bucket_index, b.name AS bucket, count(m) AS count
FROM (VALUES (0, '<30min'), (1, '30-60min'), (2, '1-2hrs'), (3, '2-6hrs'), (4, '>6hrs')) b(i, name)
LEFT JOIN (SELECT resolution_minutes AS m,
   CASE WHEN resolution_minutes < 30 THEN 0 WHEN resolution_minutes < 60 THEN 1 WHEN resolution_minutes < 120 THEN 2
        WHEN resolution_minutes < 360 THEN 3 ELSE 4 END AS i
   FROM v WHERE resolution_minutes >= 0) x ON x.i = b.i
GROUP BY b.i, b.name""")


@oracle("resolution_buckets_batch")
def _():
    return q("batch", """SELECT b.i AS bucket_index, b.name AS bucket, count(m) AS count
FROM (VALUES (0, '0-30 min'), (1, '30-60 min'), (2, '1-2 hrs'), (3, '2-4 hrs'), (4, '4+ hrs')) b(i, name)
LEFT JOIN (SELECT resolution_minutes AS m,
   CASE WHEN resolution_minutes <= 30 THEN 0 WHEN resolution_minutes <= 60 THEN 1 WHEN resolution_minutes <= 120 THEN 2
        WHEN resolution_minutes <= 240 THEN 3 ELSE 4 END AS i
   FROM v WHERE resolution_minutes BETWEEN 0 AND 1440) x ON x.i = b.i
GROUP BY b.i, b.name""")


@oracle("peak_kpi")
def _():
    return q("live", """SELECT count(*) FILTER (WHERE hour_of_day IN (7, 8, 9, 17, 18, 19, 20)) AS peak_violations,
  count(*) AS total_violations FROM v""")


@oracle("top6_share")
def _():
    return q("live", """SELECT violation_type, n AS count, CAST(floor((n * 100 * 2 + s) / (2 * s)) AS BIGINT) AS share_pct FROM (
  SELECT *, sum(n) OVER () AS s FROM (
    SELECT violation_type, count(*) AS n, min(id) AS f FROM v WHERE violation_type IS NOT NULL
    GROUP BY 1 ORDER BY n DESC, f LIMIT 6))""")


HEAT = """cells AS (
  SELECT round_even(latitude * 1e4, 0) / 1e4 AS lat, round_even(longitude * 1e4, 0) / 1e4 AS lon, count(*) AS n
  FROM v GROUP BY 1, 2),
hc AS (SELECT lat, lon, n AS count, n / max(n) OVER () AS weight FROM cells)"""


@oracle("heatmap")
def _():
    return q("live", "SELECT lat, lon, count, weight FROM hc", HEAT)


@oracle("heatmap_thinned")
def _():
    return q("live", """SELECT position, lat, lon, count, weight FROM (
  SELECT *, row_number() OVER (ORDER BY count DESC, lat, lon) - 1 AS position, count(*) OVER () AS total FROM hc) x
WHERE total <= 5000 OR position IN (
  SELECT DISTINCT CAST(floor(i.range * (total / 5000e0)) AS BIGINT) FROM range(5000) i)""", HEAT)


def _hav(a: str, b: str) -> str:
    return (f"2 * asin(sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + "
            f"cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2)))")


def pairs_cte(profile: str) -> str:
    """``pts`` and ``pairs(a, b)``: every ordered pair within eps, self included
    (3×3 grid equi-join with the exact distance as a residual)."""
    eps = EPS[profile]
    return f"""pts AS (SELECT id, latitude AS lat, longitude AS lon FROM v),
g AS (SELECT {eps:.6e} * (1 + 1e-9) AS h,
        degrees(2 * asin(least(1e0, sin(radians({eps:.6e}) / 2) / cos(radians(max(abs(lat))) + radians({eps:.6e}))))) * (1 + 1e-9) AS w
      FROM pts),
pc AS (SELECT id, lat, lon, CAST(floor(lat / g.h) AS BIGINT) AS ci, CAST(floor(lon / g.w) AS BIGINT) AS cj FROM pts, g),
pairs AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b
  FROM pc a CROSS JOIN (VALUES (-1), (0), (1)) di(d) CROSS JOIN (VALUES (-1), (0), (1)) dj(d)
  JOIN pc b ON b.ci = a.ci + di.d AND b.cj = a.cj + dj.d
  WHERE {_hav('a', 'b')} <= radians({eps:.6e}))"""


def dbscan_cte(profile: str, rounds: int = 12) -> str:
    """``lab(id, cluster_label)``: core = ≥ min_samples pairs; components by
    unrolled min-label rounds with pointer jumping; clusters numbered by their
    smallest core id; border points take the smallest neighbouring cluster."""
    m = MIN_SAMPLES[profile]
    parts = [pairs_cte(profile),
             f"core AS (SELECT a AS id FROM pairs GROUP BY a HAVING count(*) >= {m})",
             "ce AS MATERIALIZED (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core))",
             "l0 AS (SELECT id, id AS l FROM core)"]
    for i in range(1, rounds + 1):
        parts.append(f"p{i} AS MATERIALIZED (SELECT ce.a AS id, min(l.l) AS l FROM ce JOIN l{i-1} l ON l.id = ce.b GROUP BY ce.a)")
        parts.append(f"l{i} AS MATERIALIZED (SELECT x.id, least(x.l, y.l) AS l FROM p{i} x JOIN p{i} y ON y.id = x.l)")
    parts.append(f"""roots AS (SELECT l AS root, CAST(dense_rank() OVER (ORDER BY l) - 1 AS INTEGER) AS k FROM (SELECT DISTINCT l FROM l{rounds}))""")
    parts.append(f"corelab AS (SELECT l{rounds}.id, roots.k FROM l{rounds} JOIN roots ON roots.root = l{rounds}.l)")
    parts.append("""border AS (SELECT p.a AS id, min(c.k) AS k FROM pairs p JOIN corelab c ON c.id = p.b
  WHERE p.a NOT IN (SELECT id FROM core) GROUP BY p.a)""")
    parts.append("""lab AS (SELECT pts.id, CAST(COALESCE(corelab.k, border.k, -1) AS INTEGER) AS cluster_label
  FROM pts LEFT JOIN corelab ON corelab.id = pts.id LEFT JOIN border ON border.id = pts.id)""")
    return ",\n".join(parts)


@oracle("eps_neighbors")
def _():
    return q("live", "SELECT a AS id, count(*) AS neighbor_count FROM pairs GROUP BY a", pairs_cte("live"))


@oracle("dbscan_live")
def _():
    return q("live", "SELECT id, cluster_label FROM lab", dbscan_cte("live"))


@oracle("dbscan_batch")
def _():
    return q("batch", "SELECT id, cluster_label FROM lab", dbscan_cte("batch"))


def summary_cte(profile: str) -> str:
    """``cs``: cluster summary over ``lab`` (arrays as sorted '|' text)."""
    live = profile == "live"
    sent = "('nan', 'None', '')"
    vt_ok = f"vehicle_type IS NOT NULL AND vehicle_type NOT IN {sent}" if live else "vehicle_type IS NOT NULL"
    res_ok = "resolution_minutes >= 0 AND isfinite(resolution_minutes)" if live else "resolution_minutes BETWEEN 0 AND 10000"
    if live:
        junc = f"COALESCE(array_to_string(list_sort(list_distinct(list(junction_name) FILTER (WHERE junction_name NOT IN {sent}))), '|'), '')"
        stat = f"COALESCE(array_to_string(list_sort(list_distinct(list(police_station) FILTER (WHERE police_station NOT IN {sent}))), '|'), '')"
        dom_filter = f"WHERE violation_type IS NOT NULL AND violation_type NOT IN {sent}"
    else:
        junc = ("COALESCE(array_to_string(list_sort(list_distinct(list(junction_name) FILTER (WHERE junction_name NOT IN "
                "('No Junction', 'nan', 'NULL', ''))))[1:6], '|'), '')")
        stat = "NULL"
        dom_filter = "WHERE violation_type IS NOT NULL"
    station_cte = ""
    if not live:
        station_cte = """,
st AS (SELECT cluster_label, array_to_string(list(police_station ORDER BY f)[1:4], '|') AS stations FROM (
  SELECT cluster_label, police_station, min(id) AS f FROM lv WHERE police_station IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""
    return f"""lv AS (SELECT v.*, lab.cluster_label FROM v JOIN lab ON lab.id = v.id WHERE lab.cluster_label >= 0),
dom AS (SELECT cluster_label, arg_min(violation_type, (-n, f)) AS d FROM (
  SELECT cluster_label, violation_type, count(*) AS n, min(id) AS f FROM lv {dom_filter} GROUP BY 1, 2) GROUP BY 1){station_cte},
cs0 AS (SELECT cluster_label AS cluster_id, {xmean('latitude', '1e7')} AS centroid_lat, {xmean('longitude', '1e7')} AS centroid_lon,
   count(*) AS violation_count, count(DISTINCT vehicle_type) FILTER (WHERE {vt_ok}) AS unique_vehicle_types,
   CAST(count(*) FILTER (WHERE is_peak_hour) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS peak_hour_ratio,
   COALESCE({xmean(f'CASE WHEN {res_ok} THEN resolution_minutes END', '6e7')}, 0e0) AS avg_resolution_minutes,
   {junc} AS junctions_covered, {stat} AS stations0,
   min(created_datetime) AS first_seen, max(created_datetime) AS last_seen,
   list_sort(list_distinct(list(junction_name) FILTER (WHERE {'junction_name NOT IN ' + sent if live else "junction_name NOT IN ('No Junction', 'nan', 'NULL', '')"}))) AS jlist
  FROM lv GROUP BY cluster_label),
cs AS (SELECT cs0.cluster_id, centroid_lat, centroid_lon, violation_count, unique_vehicle_types,
   COALESCE(dom.d, 'Unknown') AS dominant_violation_type, peak_hour_ratio, avg_resolution_minutes, junctions_covered,
   COALESCE({'stations0' if live else 'st.stations'}, '') AS police_stations_involved, first_seen, last_seen,
   {'COALESCE(len(jlist), 0)' if live else 'least(COALESCE(len(jlist), 0), 6)'} AS n_junctions
  FROM cs0 LEFT JOIN dom ON dom.cluster_label = cs0.cluster_id{'' if live else ' LEFT JOIN st ON st.cluster_label = cs0.cluster_id'})"""


CS_COLS = ("cluster_id, centroid_lat, centroid_lon, violation_count, unique_vehicle_types, dominant_violation_type, "
           "peak_hour_ratio, avg_resolution_minutes, junctions_covered, police_stations_involved, first_seen, last_seen")


@oracle("cluster_summary")
def _():
    return q("live", f"SELECT {CS_COLS} FROM cs", dbscan_cte("live") + ",\n" + summary_cte("live"))


@oracle("cluster_summary_batch")
def _():
    return q("batch", f"SELECT {CS_COLS} FROM cs", dbscan_cte("batch") + ",\n" + summary_cte("batch"))


COLORS = "CASE {t} WHEN 'Critical' THEN '#ef4444' WHEN 'High' THEN '#f97316' WHEN 'Medium' THEN '#eab308' ELSE '#22c55e' END"


def scored_cte(profile: str) -> str:
    """``sc``: ``cs`` plus impact_score, priority_tier, priority_color,
    recommended_enforcement_time."""
    if profile == "live":
        norm = "CASE WHEN max({x}) OVER () = min({x}) OVER () THEN 5e-1 ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"
        inv = "(1e0 / CASE WHEN avg_resolution_minutes = 0 OR avg_resolution_minutes IS NULL THEN 1e-6 ELSE avg_resolution_minutes END)"
        raw = (f"(35e-2 * {norm.format(x='CAST(violation_count AS DOUBLE)')} + 25e-2 * {norm.format(x='peak_hour_ratio')} + "
               f"20e-2 * {norm.format(x=inv)} + 10e-2 * {norm.format(x='CAST(unique_vehicle_types AS DOUBLE)')} + "
               f"10e-2 * {norm.format(x='CAST(n_junctions AS DOUBLE)')}) * 100e0")
        score = f"round_even(least(greatest({raw}, 0e0), 100e0), 4)"
        cuts = (75, 50, 25)
        window = ("CASE WHEN peak_hour_ratio >= 5e-1 THEN 'Morning & Evening Rush Hours (7-9 AM, 5-8 PM)' "
                  "WHEN peak_hour_ratio >= 3e-1 THEN 'Evening Rush Hours (5-8 PM)' ELSE 'Business Hours (10 AM - 4 PM)' END")
    else:
        peak_n = "CAST(round(peak_hour_ratio * violation_count) AS BIGINT)"
        score = f"""least(CAST(
    (CASE WHEN violation_count > 500 THEN 40 WHEN violation_count > 200 THEN 30 WHEN violation_count > 100 THEN 20 ELSE 10 END)
  + (CASE WHEN avg_resolution_minutes > 120 THEN 20 WHEN avg_resolution_minutes > 60 THEN 15 WHEN avg_resolution_minutes > 30 THEN 10 ELSE 5 END)
  + least(unique_vehicle_types * 2, 10) AS DOUBLE) + {_half_even_pct(peak_n + ' * 30', 'violation_count', 10)}, 100e0)"""
        cuts = (75, 55, 35)
        window = "CASE WHEN peak_hour_ratio > 5e-1 THEN '7-9 AM and 5-8 PM' ELSE '10 AM - 4 PM' END"
    tier = (f"CASE WHEN impact_score >= {cuts[0]} THEN 'Critical' WHEN impact_score >= {cuts[1]} THEN 'High' "
            f"WHEN impact_score >= {cuts[2]} THEN 'Medium' ELSE 'Low' END")
    return f"""sc0 AS (SELECT *, {score} AS impact_score FROM cs),
sc AS (SELECT *, {tier} AS priority_tier, {COLORS.format(t=tier)} AS priority_color,
   {window} AS recommended_enforcement_time FROM sc0)"""


def scored_q(profile: str, body: str, extra: str = "") -> str:
    ctes = dbscan_cte(profile) + ",\n" + summary_cte(profile) + ",\n" + scored_cte(profile)
    if extra:
        ctes += ",\n" + extra
    return q(profile, body, ctes)


SC_COLS = CS_COLS + ", impact_score, priority_tier, priority_color, recommended_enforcement_time"


@oracle("impact_live")
def _():
    return scored_q("live", f"SELECT {SC_COLS} FROM sc")


@oracle("impact_batch")
def _():
    return scored_q("batch", f"SELECT {SC_COLS} FROM sc")


def _ts_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


@oracle("dashboard_live")
def _():
    return scored_q("live", f"""SELECT (SELECT count(*) FROM v) AS total_violations, (SELECT count(*) FROM sc) AS active_clusters,
  (SELECT count(*) FROM sc WHERE priority_tier = 'Critical') AS critical_zones,
  (SELECT COALESCE(round_even({xmean('resolution_minutes', '6e7')}, 1), 0e0) FROM v) AS avg_resolution_minutes,
  (SELECT COALESCE({_ts_text('min(created_datetime)')}, '') FROM v) AS date_from,
  (SELECT COALESCE({_ts_text('max(created_datetime)')}, '') FROM v) AS date_to""")


@oracle("dashboard_batch")
def _():
    return scored_q("batch", f"""SELECT (SELECT count(*) FROM v) AS total_violations, (SELECT count(*) FROM sc) AS active_clusters,
  (SELECT count(*) FROM sc WHERE priority_tier = 'Critical') AS critical_zones,
  (SELECT COALESCE(round_even({xmean('CASE WHEN resolution_minutes BETWEEN 0 AND 10000 THEN resolution_minutes END', '6e7')}, 1), 0e0) FROM v)
    AS avg_resolution_minutes""")


@oracle("ingest_summary")
def _():
    return scored_q("live", """SELECT 'success' AS status, (SELECT count(*) FROM v) AS records_processed,
  (SELECT count(*) FROM sc) AS clusters_found, (SELECT count(*) FROM sc WHERE priority_tier = 'Critical') AS critical_zones""")


def _templates_values() -> str:
    from kerbside.operators.recommend import REC_FIELDS, TEMPLATES
    rows = []
    for i, t in enumerate(TEMPLATES):
        vals = ", ".join("'" + t[f].replace("'", "''") + "'" for f in REC_FIELDS)
        rows.append(f"({i}, {vals})")
    return "tpl AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(template_id, " + ", ".join(REC_FIELDS) + "))"


TOP5 = "top5 AS (SELECT *, CAST(row_number() OVER (ORDER BY impact_score DESC, cluster_id) - 1 AS INTEGER) AS rank FROM sc ORDER BY impact_score DESC, cluster_id LIMIT 5)"
REC_SQL_COLS = ("rank, cluster_id, violation_count, impact_score, priority_tier, recommended_enforcement_time, "
                "description, patrol_time_window, enforcement_action, estimated_congestion_reduction, mock")


@oracle("recommend_template")
def _():
    return scored_q("live", f"SELECT {REC_SQL_COLS} FROM (SELECT top5.*, tpl.*, true AS mock FROM top5 JOIN tpl ON tpl.template_id = top5.rank % 5)",
                    TOP5 + ",\n" + _templates_values())


@oracle("recommend_overlay")
def _():
    # expected model entries: ranks 0..3 in reverse order (position 3 - rank), rank 1 under id -1,
    # rank 3 without a congestion figure; then match by id, else by position, else template
    entries = """ent AS (SELECT 3 - rank AS pos, CASE WHEN rank = 1 THEN -1 ELSE cluster_id END AS eid,
    'Model note for hotspot ' || CAST(cluster_id AS VARCHAR) AS e_description,
    'Window ' || recommended_enforcement_time AS e_window, 'Action for ' || dominant_violation_type AS e_action,
    CASE WHEN rank = 3 THEN NULL ELSE CAST(rank * 5 + 10 AS VARCHAR) || '%' END AS e_cong
  FROM top5 WHERE rank <= 3),
pick AS (SELECT t.rank, COALESCE((SELECT min(pos) FROM ent WHERE ent.eid = t.cluster_id),
                                 (SELECT pos FROM ent WHERE ent.pos = t.rank)) AS pos FROM top5 t)"""
    body = f"""SELECT {REC_SQL_COLS} FROM (
  SELECT top5.*,
    CASE WHEN e.pos IS NULL THEN tpl.description ELSE COALESCE(e.e_description, '') END AS description,
    CASE WHEN e.pos IS NULL THEN tpl.patrol_time_window ELSE COALESCE(e.e_window, '') END AS patrol_time_window,
    CASE WHEN e.pos IS NULL THEN tpl.enforcement_action ELSE COALESCE(e.e_action, '') END AS enforcement_action,
    CASE WHEN e.pos IS NULL THEN tpl.estimated_congestion_reduction ELSE COALESCE(e.e_cong, '') END AS estimated_congestion_reduction,
    e.pos IS NULL AS mock
  FROM top5 JOIN pick ON pick.rank = top5.rank LEFT JOIN ent e ON e.pos = pick.pos JOIN tpl ON tpl.template_id = top5.rank % 5)"""
    return scored_q("live", body, TOP5 + ",\n" + _templates_values() + ",\n" + entries)


@oracle("geojson_features")
def _():
    body = f"""SELECT cluster_id, CAST(to_json({{'type': 'Feature',
  'geometry': {{'type': 'Point', 'coordinates': [centroid_lon, centroid_lat]}},
  'properties': {{'cluster_id': cluster_id, 'violation_count': violation_count,
     'dominant_violation_type': dominant_violation_type, 'peak_hour_ratio': peak_hour_ratio,
     'avg_resolution_minutes': avg_resolution_minutes, 'impact_score': impact_score,
     'priority_tier': priority_tier, 'priority_color': priority_color,
     'recommended_enforcement_time': recommended_enforcement_time,
     'junctions_covered': COALESCE(string_split(NULLIF(junctions_covered, ''), '|'), []),
     'police_stations_involved': COALESCE(string_split(NULLIF(police_stations_involved, ''), '|'), []),
     'first_seen': {_ts_text('first_seen')}, 'last_seen': {_ts_text('last_seen')}}}}}) AS VARCHAR) AS feature FROM sc"""
    return scored_q("live", body)


@oracle("snapshot_backfill")
def _():
    body = f"""SELECT cluster_id, violation_count, peak_hour_ratio,
  violation_count / 10e0 AS impact_score,
  CASE WHEN violation_count / 10e0 >= 75 THEN 'Critical' WHEN violation_count / 10e0 >= 55 THEN 'High'
       WHEN violation_count / 10e0 >= 35 THEN 'Medium' ELSE 'Low' END AS priority_tier,
  {COLORS.format(t="CASE WHEN violation_count / 10e0 >= 75 THEN 'Critical' WHEN violation_count / 10e0 >= 55 THEN 'High' WHEN violation_count / 10e0 >= 35 THEN 'Medium' ELSE 'Low' END")} AS priority_color,
  CASE WHEN peak_hour_ratio > 5e-1 THEN '7-9 AM and 5-8 PM' ELSE '10 AM - 4 PM' END AS recommended_enforcement_time,
  {_ts_text('first_seen')} AS first_seen
FROM cs"""
    return q("batch", body, dbscan_cte("batch") + ",\n" + summary_cte("batch"))


@oracle("insight_context")
def _():
    hourly = """hr AS (SELECT CAST(h.range AS INTEGER) AS hour, count(v.id) AS n FROM range(24) h LEFT JOIN v ON v.hour_of_day = h.range GROUP BY 1),
dw AS (SELECT d.i, d.n AS day, count(v.id) AS n FROM (VALUES ('Monday',0),('Tuesday',1),('Wednesday',2),('Thursday',3),('Friday',4),('Saturday',5),('Sunday',6)) d(n, i)
       LEFT JOIN v ON v.day_of_week = d.n GROUP BY 1, 2)"""
    body = f"""SELECT (SELECT count(*) FROM v) AS total_violations,
  (SELECT {_ts_text('min(created_datetime)')} FROM v) AS date_from, (SELECT {_ts_text('max(created_datetime)')} FROM v) AS date_to,
  (SELECT string_agg(CAST(cluster_id AS VARCHAR), '|' ORDER BY violation_count DESC, cluster_id) FROM
     (SELECT * FROM cs ORDER BY violation_count DESC, cluster_id LIMIT 5)) AS top_cluster_ids,
  (SELECT string_agg(format('{{}}:00-{{}}:59={{}}', hour, hour, n), '|' ORDER BY n DESC, hour) FROM
     (SELECT * FROM hr ORDER BY n DESC, hour LIMIT 5)) AS top_5_hours,
  (SELECT format('{{}}:00 with {{}} violations', hour, n) FROM hr ORDER BY n DESC, hour LIMIT 1) AS peak_hour,
  (SELECT format('{{}} with {{}} violations', day, n) FROM dw ORDER BY n DESC, i LIMIT 1) AS peak_day,
  (SELECT string_agg(day || '=' || CAST(n AS VARCHAR), '|' ORDER BY i) FROM dw) AS day_of_week_breakdown,
  (SELECT string_agg(junction_name || '=' || CAST(n AS VARCHAR), '|' ORDER BY n DESC, f) FROM
     (SELECT junction_name, count(*) AS n, min(id) AS f FROM v WHERE junction_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, f LIMIT 10)) AS top_junctions,
  (SELECT string_agg(vehicle_type || '=' || CAST(n AS VARCHAR), '|' ORDER BY n DESC, f) FROM
     (SELECT vehicle_type, count(*) AS n, min(id) AS f FROM v WHERE vehicle_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, f LIMIT 6)) AS vehicle_types,
  (SELECT string_agg(violation_type || '=' || CAST(n AS VARCHAR), '|' ORDER BY n DESC, f) FROM
     (SELECT violation_type, count(*) AS n, min(id) AS f FROM v WHERE violation_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, f LIMIT 6)) AS violation_types,
  (SELECT '<30min=' || count(*) FILTER (WHERE resolution_minutes >= 0 AND resolution_minutes < 30)
      || '|30-60min=' || count(*) FILTER (WHERE resolution_minutes >= 30 AND resolution_minutes < 60)
      || '|1-2hrs=' || count(*) FILTER (WHERE resolution_minutes >= 60 AND resolution_minutes < 120)
      || '|2-6hrs=' || count(*) FILTER (WHERE resolution_minutes >= 120 AND resolution_minutes < 360)
      || '|>6hrs=' || count(*) FILTER (WHERE resolution_minutes >= 360) FROM v) AS resolution_time_distribution"""
    return q("live", body, dbscan_cte("live") + ",\n" + summary_cte("live") + ",\n" + hourly)


@oracle("report_sections")
def _():
    arr = "COALESCE(string_split(NULLIF({c}, ''), '|'), [])"
    cl = (f"'cluster_id': cluster_id, 'centroid_lat': centroid_lat, 'centroid_lon': centroid_lon, "
          f"'violation_count': violation_count, 'unique_vehicle_types': unique_vehicle_types, "
          f"'dominant_violation_type': dominant_violation_type, 'peak_hour_ratio': peak_hour_ratio, "
          f"'avg_resolution_minutes': avg_resolution_minutes, "
          f"'junctions_covered': {arr.format(c='junctions_covered')}, "
          f"'police_stations_involved': {arr.format(c='police_stations_involved')}, "
          f"'first_seen': {_ts_text('first_seen')}, 'last_seen': {_ts_text('last_seen')}, "
          f"'impact_score': impact_score, 'priority_tier': priority_tier, 'priority_color': priority_color, "
          f"'recommended_enforcement_time': recommended_enforcement_time")
    extra = f"""hr AS (SELECT CAST(h.range AS INTEGER) AS hour, count(v.id) AS n FROM range(24) h LEFT JOIN v ON v.hour_of_day = h.range GROUP BY 1),
dw AS (SELECT d.i, d.n AS day, count(v.id) AS n FROM (VALUES ('Monday',0),('Tuesday',1),('Wednesday',2),('Thursday',3),('Friday',4),('Saturday',5),('Sunday',6)) d(n, i)
       LEFT JOIN v ON v.day_of_week = d.n GROUP BY 1, 2),
wk AS (SELECT week_number AS week, count(*) AS n FROM v WHERE week_number IS NOT NULL GROUP BY 1),
tj AS (SELECT junction_name, count(*) AS n, {xmean('latitude', '1e7')} AS lat, {xmean('longitude', '1e7')} AS lon, min(id) AS f
       FROM v WHERE junction_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, f LIMIT 10),
vt AS (SELECT vehicle_type, count(*) AS n FROM v WHERE vehicle_type IS NOT NULL GROUP BY 1),
vl AS (SELECT violation_type, count(*) AS n FROM v WHERE violation_type IS NOT NULL GROUP BY 1),
rb AS (SELECT b.i, b.name, count(m) AS n
  FROM (VALUES (0, '<30min'), (1, '30-60min'), (2, '1-2hrs'), (3, '2-6hrs'), (4, '>6hrs')) b(i, name)
  LEFT JOIN (SELECT resolution_minutes AS m,
     CASE WHEN resolution_minutes < 30 THEN 0 WHEN resolution_minutes < 60 THEN 1 WHEN resolution_minutes < 120 THEN 2
          WHEN resolution_minutes < 360 THEN 3 ELSE 4 END AS i FROM v WHERE resolution_minutes >= 0) x ON x.i = b.i
  GROUP BY b.i, b.name)"""
    body = f"""SELECT 'dashboard' AS section, '' AS item, CAST(to_json({{
    'total_violations': (SELECT count(*) FROM v), 'active_clusters': (SELECT count(*) FROM sc),
    'critical_zones': (SELECT count(*) FROM sc WHERE priority_tier = 'Critical'),
    'avg_resolution_minutes': (SELECT COALESCE(round_even({xmean('resolution_minutes', '6e7')}, 1), 0e0) FROM v),
    'date_range': {{'from': (SELECT COALESCE({_ts_text('min(created_datetime)')}, '') FROM v),
                   'to': (SELECT COALESCE({_ts_text('max(created_datetime)')}, '') FROM v)}}}}) AS VARCHAR) AS payload
UNION ALL SELECT 'clusters', CAST(cluster_id AS VARCHAR), CAST(to_json({{{cl}}}) AS VARCHAR) FROM sc
UNION ALL SELECT 'time_stats.hourly', CAST(hour AS VARCHAR), CAST(to_json({{'hour': hour, 'count': n}}) AS VARCHAR) FROM hr
UNION ALL SELECT 'time_stats.day_of_week', day, CAST(to_json({{'day_index': i, 'day_of_week': day, 'count': n}}) AS VARCHAR) FROM dw
UNION ALL SELECT 'time_stats.weekly_trend', CAST(week AS VARCHAR), CAST(to_json({{'week': week, 'count': n}}) AS VARCHAR) FROM wk
UNION ALL SELECT 'time_stats.top_junctions', junction_name,
  CAST(to_json({{'junction_name': junction_name, 'count': n, 'lat': lat, 'lon': lon}}) AS VARCHAR) FROM tj
UNION ALL SELECT 'time_stats.vehicle_types', vehicle_type, CAST(to_json({{'vehicle_type': vehicle_type, 'count': n,
  'percentage': {_half_even_pct('n * 100', '(SELECT greatest(count(*), 1) FROM v)', 10)}}}) AS VARCHAR) FROM vt
UNION ALL SELECT 'time_stats.violation_types', violation_type, CAST(to_json({{'violation_type': violation_type, 'count': n}}) AS VARCHAR) FROM vl
UNION ALL SELECT 'time_stats.resolution_buckets', name, CAST(to_json({{'bucket_index': i, 'bucket': name, 'count': n}}) AS VARCHAR) FROM rb
UNION ALL SELECT 'recommendations', CAST(rank AS VARCHAR), CAST(to_json({{{cl}, 'rank': rank,
  'description': description, 'patrol_time_window': patrol_time_window, 'enforcement_action': enforcement_action,
  'estimated_congestion_reduction': estimated_congestion_reduction, 'mock': true}}) AS VARCHAR)
  FROM (SELECT top5.*, tpl.* FROM top5 JOIN tpl ON tpl.template_id = top5.rank % 5)"""
    return scored_q("live", body, TOP5 + ",\n" + _templates_values() + ",\n" + extra)


@oracle("temporal_stats")
def _():
    body = f"""SELECT 'hourly' AS stat, CAST(h.range AS VARCHAR) AS key, count(v.id) AS count,
  NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, NULL::DOUBLE AS percentage
  FROM range(24) h LEFT JOIN v ON v.hour_of_day = h.range GROUP BY h.range
UNION ALL SELECT 'day_of_week', d.n, count(v.id), NULL, NULL, NULL
  FROM (VALUES {DAYS}) d(n, i) LEFT JOIN v ON v.day_of_week = d.n GROUP BY d.n
UNION ALL SELECT 'weekly_trend', CAST(week_number AS VARCHAR), count(*), NULL, NULL, NULL
  FROM v WHERE week_number IS NOT NULL GROUP BY week_number
UNION ALL SELECT 'top_junctions', junction_name, n, lat, lon, NULL FROM (
  SELECT junction_name, count(*) AS n, {xmean('latitude', '1e7')} AS lat, {xmean('longitude', '1e7')} AS lon, min(id) AS f
  FROM v WHERE junction_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, f LIMIT 10)
UNION ALL SELECT 'vehicle_types', vehicle_type, n, NULL, NULL, {_half_even_pct('n * 100', 't', 10)} FROM (
  SELECT vehicle_type, count(*) AS n, (SELECT greatest(count(*), 1) FROM v) AS t FROM v
  WHERE vehicle_type IS NOT NULL GROUP BY 1)
UNION ALL SELECT 'violation_types', violation_type, count(*), NULL, NULL, NULL
  FROM v WHERE violation_type IS NOT NULL GROUP BY violation_type
UNION ALL SELECT 'resolution_buckets', b.name, count(m), NULL, NULL, NULL
FROM (VALUES (0, '<30min'), (1, '30-60min'), (2, '1-2hrs'), (3, '2-6hrs'), (4, '>6hrs')) b(i, name)
LEFT JOIN (SELECT resolution_minutes AS m,
   CASE WHEN resolution_minutes < 30 THEN 0 WHEN resolution_minutes < 60 THEN 1 WHEN resolution_minutes < 120 THEN 2
        WHEN resolution_minutes < 360 THEN 3 ELSE 4 END AS i
   FROM v WHERE resolution_minutes >= 0) x ON x.i = b.i
GROUP BY b.name"""
    return q("live", body)


@oracle("map_sample")
def _():
    p = 2147483647
    h1 = f"((((id % {p}) + {p}) % {p}) * 1103515245 + 12345) % {p}"
    body = f"""SELECT CAST(round_even(CAST(latitude AS DECIMAL(18,7)), 6) AS DOUBLE) AS latitude,
  CAST(round_even(CAST(longitude AS DECIMAL(18,7)), 6) AS DOUBLE) AS longitude,
  violation_type, hour_of_day AS hour,
  CASE WHEN junction_name IS NULL OR junction_name = 'No Junction' THEN '' ELSE junction_name END AS junction_name
FROM (SELECT *, (((h1 * h1) % {p}) * 48271 + h1 * 16807 + 42) % {p} AS k
      FROM (SELECT *, {h1} AS h1 FROM v))
ORDER BY k, id LIMIT 3000"""
    return q("batch", body)


@oracle("prompt_rows")
def _():
    return scored_q("live", """SELECT rank, cluster_id, violation_count, dominant_violation_type, round_even(peak_hour_ratio, 4) AS peak_hour_ratio,
  round_even(avg_resolution_minutes, 2) AS avg_resolution_minutes, unique_vehicle_types, round_even(impact_score, 2) AS impact_score,
  priority_tier, recommended_enforcement_time, junctions_covered FROM top5""", TOP5)


@oracle("job_sections")
def _():
    return scored_q("live", """SELECT 'labeled' AS section, count(*) AS rows FROM v
UNION ALL SELECT 'clusters', count(*) FROM sc UNION ALL SELECT 'features', count(*) FROM sc
UNION ALL SELECT 'recommendations', least(5, count(*)) FROM sc UNION ALL SELECT 'hourly', 24
UNION ALL SELECT 'weekly_trend', count(DISTINCT week_number) FROM v UNION ALL SELECT 'vehicle_types', count(DISTINCT vehicle_type) FROM v
UNION ALL SELECT 'violation_types', count(DISTINCT violation_type) FROM v
UNION ALL SELECT 'heat_points', least(5000, (SELECT count(*) FROM (SELECT DISTINCT round_even(latitude * 1e4, 0), round_even(longitude * 1e4, 0) FROM v)))
UNION ALL SELECT 'summary.records_processed', count(*) FROM v UNION ALL SELECT 'summary.clusters_found', count(*) FROM sc
UNION ALL SELECT 'summary.critical_zones', count(*) FROM sc WHERE priority_tier = 'Critical'""")


@oracle("clean_missing_columns")
def _():
    return q("live", "SELECT id, latitude, longitude, CAST(NULL AS VARCHAR) AS vehicle_type, CAST(NULL AS VARCHAR) AS police_station, hour_of_day FROM v")


@oracle("csv_records")
def _():
    return q("live", "SELECT id, latitude, longitude, violation_type, created_datetime, closed_datetime, junction_name, resolution_minutes FROM v")


@oracle("junction_count_text")
def _():
    return f"""WITH {violations_cte('live').split(',' + chr(10) + 'c0 AS')[0]}
SELECT id, CAST(CASE WHEN violation_type IS NULL OR violation_type = '' THEN 0
  WHEN violation_type LIKE '[%]' THEN json_array_length(replace(violation_type, chr(39), '"')) ELSE 1 END AS INTEGER) AS items FROM raw"""


@oracle("insight_document")
def _():
    days = "('Monday',0),('Tuesday',1),('Wednesday',2),('Thursday',3),('Friday',4),('Saturday',5),('Sunday',6)"
    parts = f"""hr AS (SELECT CAST(h.range AS INTEGER) AS hour, count(v.id) AS n FROM range(24) h LEFT JOIN v ON v.hour_of_day = h.range GROUP BY 1),
dw AS (SELECT d.i, d.n AS day, count(v.id) AS n FROM (VALUES {days}) d(n, i) LEFT JOIN v ON v.day_of_week = d.n GROUP BY 1, 2),
bk AS (SELECT b.i, b.l, count(v.id) AS n FROM (VALUES ('<30min',0,0,30),('30-60min',1,30,60),('1-2hrs',2,60,120),('2-6hrs',3,120,360),('>6hrs',4,360,1000000000)) b(l, i, lo, hi)
       LEFT JOIN v ON v.resolution_minutes >= b.lo AND v.resolution_minutes < b.hi GROUP BY 1, 2),
tj AS (SELECT junction_name, count(*) AS n, {xmean('latitude', '1e7')} AS lat, {xmean('longitude', '1e7')} AS lon, min(id) AS f FROM v
       WHERE junction_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, f LIMIT 10),
vt AS (SELECT vehicle_type, count(*) AS n, min(id) AS f, {_half_even_pct('count(*) * 100', '(SELECT count(*) FROM v)', 10)} AS pct FROM v
       WHERE vehicle_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, f LIMIT 6),
vi AS (SELECT violation_type, count(*) AS n, min(id) AS f FROM v WHERE violation_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, f LIMIT 6),
tc AS (SELECT * FROM sc ORDER BY violation_count DESC, cluster_id LIMIT 5)"""
    listed = lambda item, order, table: f"(SELECT '[' || string_agg(CAST(to_json({item}) AS VARCHAR), ',' ORDER BY {order}) || ']' FROM {table})"
    body = f"""SELECT '{{"total_violations":' || (SELECT count(*) FROM v)
  || ',"date_range":' || CAST(to_json({{'from': (SELECT {_ts_text('min(created_datetime)')} FROM v), 'to': (SELECT {_ts_text('max(created_datetime)')} FROM v)}}) AS VARCHAR)
  || ',"top_clusters":' || {listed("{'cluster_id': cluster_id, 'violation_count': violation_count, 'dominant_violation_type': dominant_violation_type, 'impact_score': impact_score, 'priority_tier': priority_tier, 'avg_resolution_minutes': avg_resolution_minutes, 'peak_hour_ratio': peak_hour_ratio, 'junctions_covered': COALESCE(string_split(NULLIF(junctions_covered, ''), '|'), [])}", 'violation_count DESC, cluster_id', 'tc')}
  || ',"top_5_hours":' || {listed("{'hour': format('{}:00-{}:59', hour, hour), 'violations': n}", 'n DESC, hour', '(SELECT * FROM hr ORDER BY n DESC, hour LIMIT 5)')}
  || ',"peak_hour":"' || (SELECT format('{{}}:00 with {{}} violations', hour, n) FROM hr ORDER BY n DESC, hour LIMIT 1)
  || '","peak_day":"' || (SELECT format('{{}} with {{}} violations', day, n) FROM dw ORDER BY n DESC, i LIMIT 1)
  || '","day_of_week_breakdown":{{' || (SELECT string_agg('"' || day || '":' || n, ',' ORDER BY i) FROM dw)
  || '}},"top_junctions":' || {listed("{'junction_name': junction_name, 'count': n, 'lat': lat, 'lon': lon}", 'n DESC, f', 'tj')}
  || ',"vehicle_types":' || {listed("{'vehicle_type': vehicle_type, 'count': n, 'percentage': pct}", 'n DESC, f', 'vt')}
  || ',"violation_types":' || {listed("{'violation_type': violation_type, 'count': n}", 'n DESC, f', 'vi')}
  || ',"resolution_time_distribution":{{' || (SELECT string_agg('"' || l || '":' || n, ',' ORDER BY i) FROM bk) || '}}}}' AS context"""
    return scored_q("live", body, parts)
