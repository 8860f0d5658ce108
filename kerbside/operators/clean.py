"""Clean and enrich raw records (numeric coercion, timestamp parsing, row
filters, calendar and resolution features, violation-type normalisation).

One projection/filter chain: Catalyst pushes the filters to the scan and
fuses everything into a single whole-stage-codegen stage; no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.text import normalize_violation_type
from kerbside.functions.timefn import minutes_between, parse_local_wall_clock, parse_utc
from kerbside.profiles import PEAK_HOURS, Profile, get_profile
from kerbside.schema import ensure_columns, with_alias_columns


def _num(c):
    d = F.col(c).cast("string").try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def clean(raw: DataFrame, profile: Profile | str = "live", extra_formats: tuple[str, ...] = ()) -> DataFrame:
    """Records → cleaned ``violations`` frame (all raw columns + features).

    Added/retyped: ``latitude``/``longitude`` double, ``created_datetime``/
    ``closed_datetime`` timestamp_ntz, ``hour_of_day`` int, ``day_of_week``
    string, ``resolution_minutes`` double, ``is_peak_hour`` boolean,
    ``week_number`` int, ``month`` int; ``violation_type`` normalised.
    ``extra_formats`` are timestamp patterns tried after ISO text."""
    p = get_profile(profile)
    df = ensure_columns(with_alias_columns(raw))
    # predicates implied by the row filter, stated on the raw text columns so
    # the source can evaluate them (Parquet pushdown) before any parsing
    pre = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    if p.status_mode == "deny_invalid":
        pre = pre & ~F.col("validation_status").eqNullSafe("INVALID")
    else:
        pre = pre & F.col("validation_status").isNotNull()
    if p.drop_null_created:
        pre = pre & F.col("created_datetime").isNotNull()
    df = df.filter(pre)

    # every empty text cell is missing (``NULL``/``NA`` text stays text)
    text_cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    df = df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in text_cols})

    parse = parse_utc if p.timestamps_to_utc else parse_local_wall_clock
    df = df.withColumns({
        # ids come out as they are; seq orders the records ("first seen")
        "seq": F.col("seq") if "seq" in df.columns else F.col("id").cast("string").try_cast("long"),
        "latitude": _num("latitude"),
        "longitude": _num("longitude"),
        "created_datetime": parse(F.col("created_datetime").cast("string"), tuple(extra_formats)),
        "closed_datetime": parse(F.col("closed_datetime").cast("string"), tuple(extra_formats)),
    })

    if p.status_mode == "deny_invalid":
        status_ok = ~F.col("validation_status").eqNullSafe("INVALID")
    else:
        status_ok = F.lower(F.col("validation_status")).isin("approved", "valid")
    keep = (
        F.col("latitude").isNotNull() & (F.col("latitude") != 0)
        & F.col("longitude").isNotNull() & (F.col("longitude") != 0)
        & status_ok
    )
    if p.drop_null_created:
        keep = keep & F.col("created_datetime").isNotNull()
    df = df.filter(keep)

    created = F.col("created_datetime")
    hour = F.hour(created)
    return df.withColumns({
        "hour_of_day": hour,
        "day_of_week": F.date_format(created, "EEEE"),
        "resolution_minutes": minutes_between(created, F.col("closed_datetime")),
        "is_peak_hour": F.coalesce(hour.isin(*PEAK_HOURS), F.lit(False)),
        "week_number": F.weekofyear(created),
        "month": F.month(created),
        "violation_type": normalize_violation_type(F.col("violation_type"), p),
    })


def clean_projection(df: DataFrame) -> DataFrame:
    """The feature columns of a cleaned frame (for reports and checks)."""
    return df.select(
        "id", "latitude", "longitude", "vehicle_type", "violation_type", "created_datetime",
        "closed_datetime", "junction_name", "police_station", "validation_status", "hour_of_day",
        "day_of_week", "resolution_minutes", "is_peak_hour", "week_number", "month",
    )
