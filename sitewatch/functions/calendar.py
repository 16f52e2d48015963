"""Calendar attributes of a date column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_columns(day: Column) -> dict[str, Column]:
    """Year to weekday, with ISO weeks and ISO weekdays (1 = Monday)."""
    weekday = F.weekday(day) + 1
    return {
        "obs_year": F.year(day),
        "obs_quarter": F.quarter(day),
        "obs_month_number": F.month(day),
        "obs_month_name": F.date_format(day, "MMMM"),
        "obs_week_number": F.weekofyear(day),
        "obs_day_of_week_name": F.date_format(day, "EEEE"),
        "obs_day_of_week_number": weekday,
        "is_weekend": weekday >= 6,
    }
