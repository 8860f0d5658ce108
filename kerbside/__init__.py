"""kerbside — Spark-native hotspot analytics for geo-tagged, time-stamped incident records.

Every operator is a function from DataFrames to a DataFrame built from Spark
built-in expressions, joins, aggregates and windows.  Operators that differ
between the upload-time (``live``) and offline (``batch``) variants take a
:class:`kerbside.profiles.Profile`.
"""

from kerbside.profiles import BATCH, LIVE, Profile

__all__ = ["Profile", "LIVE", "BATCH"]
