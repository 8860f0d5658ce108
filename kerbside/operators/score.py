"""Impact scores, priority tiers and patrol windows for clusters.

The live score min-max normalises five features over *all* clusters; the
minima/maxima are one one-row aggregate joined by broadcast (never an
unpartitioned window)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.numeric import ratio_half_even
from kerbside.profiles import PRIORITY_COLORS, Profile, get_profile

# fixed values: patrol-window texts
LIVE_WINDOWS = (
    (0.5, "Morning & Evening Rush Hours (7-9 AM, 5-8 PM)"),
    (0.3, "Evening Rush Hours (5-8 PM)"),
)
LIVE_WINDOW_DEFAULT = "Business Hours (10 AM - 4 PM)"
BATCH_WINDOW_HIGH = "7-9 AM and 5-8 PM"
BATCH_WINDOW_DEFAULT = "10 AM - 4 PM"
EPSILON = 1e-6
# fixed values: live weights of count, peak ratio, 1/resolution, vehicle types, junctions
WEIGHTS = (0.35, 0.25, 0.20, 0.10, 0.10)


def priority_tier(score: Column, profile: Profile | str) -> Column:
    c, h, m = get_profile(profile).tier_cuts
    return (F.when(score >= c, "Critical").when(score >= h, "High").when(score >= m, "Medium").otherwise("Low"))


def priority_color(tier: Column) -> Column:
    mapping = F.create_map(*[x for kv in PRIORITY_COLORS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return mapping[tier]


def patrol_window(peak_ratio: Column, profile: Profile | str) -> Column:
    if get_profile(profile).name == "batch":
        return F.when(peak_ratio > 0.5, BATCH_WINDOW_HIGH).otherwise(BATCH_WINDOW_DEFAULT)
    (t1, w1), (t2, w2) = LIVE_WINDOWS
    return F.when(peak_ratio >= t1, w1).when(peak_ratio >= t2, w2).otherwise(LIVE_WINDOW_DEFAULT)


def junction_count(c: Column) -> Column:
    """Number of junctions of a list column (null → 0)."""
    return F.coalesce(F.size(c), F.lit(0))


def junction_count_text(c: Column) -> Column:
    """Number of junctions written as text: a list literal counts its items,
    other non-empty text is one junction, empty/null is 0."""
    s = F.trim(c)
    arr = F.from_json(s, "array<string>", {"allowSingleQuotes": "true"})
    return (F.when(s.isNull() | (s == ""), F.lit(0))
             .when(s.startswith("[") & s.endswith("]") & arr.isNotNull(), F.size(arr))
             .otherwise(F.lit(1)))


def score_live(clusters: DataFrame) -> DataFrame:
    """Weighted min-max score ×100, clipped to [0, 100], rounded to 4 places;
    tier, colour and patrol window.  Zero or missing mean resolution is
    replaced by 1e-6 before inversion."""
    res = F.col("avg_resolution_minutes").cast("double")
    feats = {
        "_f0": F.col("violation_count").cast("double"),
        "_f1": F.col("peak_hour_ratio").cast("double"),
        "_f2": F.lit(1.0) / F.coalesce(F.when(res != 0, res), F.lit(EPSILON)),
        "_f3": F.col("unique_vehicle_types").cast("double"),
        "_f4": junction_count(F.col("junctions_covered")).cast("double"),
    }
    x = clusters.withColumns(feats)
    stats = x.agg(*[F.min(k).alias(f"{k}_lo") for k in feats] + [F.max(k).alias(f"{k}_hi") for k in feats])
    x = x.crossJoin(F.broadcast(stats))

    def norm(k):
        lo, hi = F.col(f"{k}_lo"), F.col(f"{k}_hi")
        return F.when(lo == hi, F.lit(0.5)).otherwise((F.col(k) - lo) / (hi - lo))

    raw = sum((F.lit(w) * norm(k) for w, k in zip(WEIGHTS, feats)), F.lit(0.0)) * F.lit(100.0)
    score = F.bround(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 4)
    out = x.withColumn("impact_score", score)
    out = out.withColumns({
        "priority_tier": priority_tier(F.col("impact_score"), "live"),
        "recommended_enforcement_time": patrol_window(F.col("peak_hour_ratio"), "live"),
    }).withColumn("priority_color", priority_color(F.col("priority_tier")))
    return out.select(*clusters.columns, "impact_score", "priority_tier", "priority_color", "recommended_enforcement_time")


def score_batch(clusters: DataFrame) -> DataFrame:
    """Additive points: count >500/200/100 → 40/30/20/10; + 30·peak ratio;
    mean resolution >120/60/30 → 20/15/10/5; + min(2·vehicle types, 10);
    rounded to 1 place (exact half-even on the peak fraction), capped at 100."""
    vc = F.col("violation_count")
    rm = F.col("avg_resolution_minutes")
    base = (F.when(vc > 500, 40).when(vc > 200, 30).when(vc > 100, 20).otherwise(10)
            + F.when(rm > 120, 20).when(rm > 60, 15).when(rm > 30, 10).otherwise(5)
            + F.least(F.col("unique_vehicle_types") * 2, F.lit(10)))
    peak_n = F.rint(F.col("peak_hour_ratio") * vc).cast("long")
    score = F.least(base.cast("double") + ratio_half_even(peak_n * 30, vc, 10), F.lit(100.0))
    out = clusters.withColumn("impact_score", score)
    out = out.withColumns({
        "priority_tier": priority_tier(F.col("impact_score"), "batch"),
        "recommended_enforcement_time": patrol_window(F.col("peak_hour_ratio"), "batch"),
    }).withColumn("priority_color", priority_color(F.col("priority_tier")))
    return out.select(*clusters.columns, "impact_score", "priority_tier", "priority_color", "recommended_enforcement_time")


def score(clusters: DataFrame, profile: Profile | str = "live") -> DataFrame:
    return score_batch(clusters) if get_profile(profile).name == "batch" else score_live(clusters)
