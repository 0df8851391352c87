"""Time columns in a user's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plan_end(start: Column, months: Column, tz: Column) -> Column:
    """Last microsecond of the local day ``months`` after the local date of ``start`` (month ends clamp)."""
    day = F.add_months(F.to_date(F.from_utc_timestamp(start, tz)), months)
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), tz) - F.expr("interval 1 microsecond")
