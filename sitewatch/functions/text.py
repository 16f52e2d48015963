"""Predicates on raw text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats a valid raw record follows.
KEY_FORMAT = "^[A-Za-z]{3}-[0-9]+$"
DATE_FORMAT = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DECIMAL_FORMAT = "^-?[0-9]+([.][0-9]+)?$"
INTEGER_FORMAT = "^-?[0-9]+$"


def is_blank(name: str) -> Column:
    """Present but made of spaces only."""
    return F.col(name).isNotNull() & (F.trim(name) == "")


def is_padded(name: str) -> Column:
    """Starts or ends with spaces (NULL when the value is NULL)."""
    return F.col(name) != F.trim(name)


def breaks_format(name: str, pattern: str) -> Column:
    """Present and not in the format (NULL when the value is NULL)."""
    return ~F.col(name).rlike(pattern)


def number(name: str, kind: str = "decimal(18,6)") -> Column:
    """Numeric value of a text column; NULL when the text is not a plain number."""
    return F.when(F.trim(name).rlike(DECIMAL_FORMAT), F.trim(name).try_cast(kind))


def whole_number(name: str) -> Column:
    """Integer value of a text column; ``1.5`` is not an integer and gives NULL."""
    return F.when(F.trim(name).rlike(INTEGER_FORMAT), F.trim(name).try_cast("int"))


def calendar_day(name: str) -> Column:
    """Date value of ``YYYY-MM-DD`` text; NULL for other formats and impossible dates."""
    return F.when(F.col(name).rlike(DATE_FORMAT), F.col(name).try_cast("date"))
