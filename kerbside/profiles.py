"""Operator profiles.

The same operator set runs with two constant sets: ``LIVE`` (records cleaned on
upload) and ``BATCH`` (the offline precompute).  All thresholds that must equal
the original application's are fixed values and are listed here together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values shared by both profiles --------------------------------
PEAK_HOURS = (7, 8, 9, 17, 18, 19, 20)
DAY_ORDER = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
PRIORITY_COLORS = {
    "Critical": "#ef4444",
    "High": "#f97316",
    "Medium": "#eab308",
    "Low": "#22c55e",
}
SENTINEL_TEXT = ("nan", "None", "")
JUNCTION_SENTINELS = ("No Junction", "nan", "NULL", "")


@dataclass(frozen=True)
class Profile:
    name: str
    # cleaning
    status_mode: str                # "deny_invalid" | "allow_approved_valid"
    timestamps_to_utc: bool         # offset applied (batch) or wall clock kept (live)
    drop_null_created: bool
    type_fallback: str              # "strip" (live) | "first_quoted" (batch)
    # DBSCAN (eps in degrees of arc)
    eps_deg: float
    min_samples: int
    # cluster summary
    res_lo: float
    res_hi: float | None            # None = unbounded
    summary_junction_filter: bool   # batch drops junction sentinels
    junction_cap: int | None
    station_cap: int | None
    # scoring
    tier_cuts: tuple[float, float, float]
    # time statistics
    res_buckets: tuple[tuple[str, float | None, float | None], ...] = field(default=())
    bucket_right_closed: bool = False
    bucket_max: float | None = None


LIVE = Profile(
    name="live",
    status_mode="deny_invalid",
    timestamps_to_utc=False,
    drop_null_created=False,
    type_fallback="strip",
    eps_deg=0.0008,
    min_samples=5,
    res_lo=0.0,
    res_hi=None,
    summary_junction_filter=False,
    junction_cap=None,
    station_cap=None,
    tier_cuts=(75.0, 50.0, 25.0),
    # label, lower bound (inclusive), upper bound (exclusive)
    res_buckets=(
        ("<30min", None, 30.0),
        ("30-60min", 30.0, 60.0),
        ("1-2hrs", 60.0, 120.0),
        ("2-6hrs", 120.0, 360.0),
        (">6hrs", 360.0, None),
    ),
    bucket_right_closed=False,
    bucket_max=None,
)

BATCH = Profile(
    name="batch",
    status_mode="allow_approved_valid",
    timestamps_to_utc=True,
    drop_null_created=True,
    type_fallback="first_quoted",
    eps_deg=0.001,
    min_samples=8,
    res_lo=0.0,
    res_hi=10000.0,
    summary_junction_filter=True,
    junction_cap=6,
    station_cap=4,
    tier_cuts=(75.0, 55.0, 35.0),
    # label, lower bound (exclusive), upper bound (inclusive) on 0..1440
    res_buckets=(
        ("0-30 min", None, 30.0),
        ("30-60 min", 30.0, 60.0),
        ("1-2 hrs", 60.0, 120.0),
        ("2-4 hrs", 120.0, 240.0),
        ("4+ hrs", 240.0, None),
    ),
    bucket_right_closed=True,
    bucket_max=1440.0,
)

PROFILES = {"live": LIVE, "batch": BATCH}


def get_profile(p: str | Profile) -> Profile:
    return p if isinstance(p, Profile) else PROFILES[p]
