"""Bounds of facts as text: ``YYYY-MM-DD`` or an ISO date-time; anything else bounds nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"^\d{4}-\d{2}-\d{2}$"


def is_date(c: Column) -> Column:
    return c.rlike(DATE)


def instant(c: Column) -> Column:
    """The moment that a bound or an as-of names; a date is its midnight. Null for null and other text."""
    text = F.regexp_replace(c, "Z$", "+00:00")
    return F.when(is_date(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"), F.try_to_timestamp(text))


def last_instant(c: Column) -> Column:
    """As ``instant``, but a date ends at 23:59:59."""
    return F.when(is_date(c), instant(c) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")).otherwise(instant(c))


def in_window(valid_from: Column, valid_to: Column, as_of: Column) -> Column:
    """Whether as_of (a timestamp) lies in the window, both ends included; a missing bound is open."""
    start, end = instant(valid_from), last_instant(valid_to)
    return (start.isNull() | (as_of >= start)) & (end.isNull() | (as_of <= end))
