"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.profiles import Profile


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, as the element of an array (and the
    whole as one interpreted expression, however often ``use`` refers to it)."""
    return F.get(F.transform(F.array(value), use), 0)


def py_strip(c: Column) -> Column:
    """Leading/trailing whitespace removal like Python's ``str.strip()``
    (Spark's ``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def title_case(c: Column) -> Column:
    """Python ``str.title()``: every run of letters gets an upper-case first
    letter and lower-case rest; other characters are kept.  ``initcap`` differs
    (it only splits on spaces: ``ROAD-CROSSING 5TH`` → ``Road-crossing 5th``)."""
    tokens = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(tokens, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))),
        "",
    )


def normalize_violation_type(c: Column, profile: Profile) -> Column:
    """First element of a JSON-array violation type, title-cased.

    live:  null/blank → ``Unknown``; valid non-empty array → first element;
           other ``[``-text that is not valid JSON → brackets stripped, text
           before the first comma, quotes stripped; ``[]`` stays ``[]``.
    batch: null, ``nan``, ``NULL`` → ``Unknown``; invalid array text → first
           double-quoted text, else the whole string.

    ``from_json`` ignores trailing text and by default accepts single quotes;
    the text must end in ``]`` and single quotes are refused, as in strict
    JSON.  The choice of text comes first and title-casing runs once; the stripped
    text and its array are made once per value and only text with a bracket is parsed."""
    if profile.type_fallback == "strip":
        return F.coalesce(title_case(bound(py_strip(c), _first_or_stripped)), F.lit("Unknown"))
    chosen = bound(py_strip(c), _first_or_quoted)
    return F.when(c.isNull() | c.isin("nan", "NULL", ""), F.lit("Unknown")).otherwise(title_case(chosen))


def _array_of(s: Column) -> Column:
    return F.from_json(F.when(s.startswith("[") & s.endswith("]"), s), "array<string>",
                       {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})


def _first_or_stripped(s: Column) -> Column:
    stripped = F.regexp_replace(s, r"^[\[\]]+|[\[\]]+$", "")
    stripped = py_strip(F.substring_index(stripped, ",", 1))
    stripped = F.regexp_replace(F.regexp_replace(stripped, '^"+|"+$', ""), "^'+|'+$", "")
    return F.when(s.startswith("["), bound(_array_of(s), lambda arr: F.when(arr.isNotNull(), F.coalesce(F.get(arr, 0), s))
                                           .otherwise(F.nullif(stripped, F.lit(""))))).otherwise(F.nullif(s, F.lit("")))


def _first_or_quoted(s: Column) -> Column:
    quoted = F.regexp_extract(s, r'"([^"]+)"', 1)
    return F.when(s.startswith("["), bound(_array_of(s), lambda arr: F.when(arr.isNotNull(), F.coalesce(F.get(arr, 0), s))
                                           .otherwise(F.coalesce(F.nullif(quoted, F.lit("")), s)))).otherwise(s)


def junction_label(c: Column) -> Column:
    """Short junction label for charts: drop a ``BTPnnn - `` prefix, keep the
    text before the first comma, trim."""
    no_prefix = F.regexp_replace(c, r"^BTP\d+\s*-\s*", "")
    return F.trim(F.substring_index(no_prefix, ",", 1))


def finite_or_null(c: Column) -> Column:
    """NaN and ±Infinity become null (JSON has no such numbers)."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def finite_tree(c: Column, kind: T.DataType) -> Column:
    """``c`` with every NaN or ±Infinity inside it (structs, arrays, maps, at any depth)
    turned to null.  The expression follows the type: parts without floating numbers
    are passed on as they are."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast(kind)).otherwise(c)
    if not _has_floats(kind):
        return c
    if isinstance(kind, T.StructType):
        inner = F.struct(*[finite_tree(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: finite_tree(x, kind.elementType))
    return F.transform_values(c, lambda k, v: finite_tree(v, kind.valueType))


def _has_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_floats(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_floats(kind.valueType)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def finite_columns(df: DataFrame) -> DataFrame:
    """``df`` as every sink writes it: no column holds NaN or an infinity at any depth."""
    return df.select(*[finite_tree(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
