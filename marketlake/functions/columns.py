"""Scalar expressions shared by the plans. All stay inside generated JVM code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price per million tokens, in and out.
INPUT_USD_PER_MILLION = 1.0
OUTPUT_USD_PER_MILLION = 5.0

# The fence that marks a SQL block in a text.
SQL_FENCE = r"```sql\s*(.*?)\s*```"


def epoch_date(seconds: Column) -> Column:
    """UTC calendar date of epoch seconds, whatever the session time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch of a timestamp without zone, read as UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def round2(x: Column) -> Column:
    """Two places, by the binary value of ``x * 100`` as SQL engines on doubles do.

    ``round(x, 2)`` looks at the shortest decimal text of ``x`` instead, and so
    takes 16.025 up, although the double is below it.
    """
    return F.round(x * 100, 0) / 100


def percent_change(new: Column, old: Column) -> Column:
    """``(new - old) / old * 100`` to two places; NULL where ``old`` is zero."""
    return round2(F.try_divide(new - old, old) * 100)


def rounded(x: Column) -> Column:
    return F.round(x, 0)


def contains(text: Column, query: str) -> Column:
    """Case-insensitive contains; ``%`` and ``_`` in the query are wildcards.

    The query is a literal of the plan, never part of SQL text. Backslashes are
    doubled because Spark alone would read them as escapes.
    """
    return text.ilike("%" + query.replace("\\", "\\\\") + "%")


def same_text(a: Column, b: str) -> Column:
    return F.lower(a) == F.lower(F.lit(b))


def quality(hq: Column, high: str = "HQ", normal: str = "NQ") -> Column:
    return F.when(hq, F.lit(high)).otherwise(F.lit(normal))


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f%%", x.cast("double"))


def or_unknown(text: Column) -> Column:
    return F.coalesce(text, F.lit("Unknown"))


def shorten(text: Column, limit: int = 300) -> Column:
    """The whole text up to ``limit`` characters, else its head and an ellipsis."""
    return F.when(
        F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def cost_usd(input_tokens: Column, output_tokens: Column) -> Column:
    return (
        input_tokens * INPUT_USD_PER_MILLION + output_tokens * OUTPUT_USD_PER_MILLION
    ) / 1_000_000


def fenced_sql(text: Column) -> Column:
    """The first fenced SQL block of a text, or the trimmed text without one."""
    fence = "(?s)" + SQL_FENCE
    strip = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(strip)


def fenced_sql_text(text: str) -> str:
    """``fenced_sql`` for one text held by the caller."""
    found = re.search(SQL_FENCE, text, re.DOTALL)
    return (found.group(1) if found else text).strip()
