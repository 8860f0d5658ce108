"""Column-expression helpers (all built-in Spark expressions, no UDFs)."""

from kerbside.functions.text import (  # noqa: F401
    finite_or_null,
    junction_label,
    normalize_violation_type,
    py_strip,
    title_case,
)
from kerbside.functions.timefn import minutes_between, parse_local_wall_clock, parse_utc  # noqa: F401
from kerbside.functions.geo import haversine  # noqa: F401
