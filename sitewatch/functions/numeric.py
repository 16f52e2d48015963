"""Aggregate expressions whose results do not depend on the order rows are added up in.

Sums of decimals and integers are exact, so means, percentages and standard deviations are
built from exact sums and leave decimal arithmetic only for the last division.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT_COUNT = "decimal(20,0)"


def mean(col: str | Column) -> Column:
    """Mean as a double: exact sum over count, NULL when nothing was counted."""
    return F.try_divide(F.sum(col).cast("double"), F.count(col))


def rounded_mean(col: str | Column, digits: int) -> Column:
    """Mean of an integer or decimal column, rounded half up on the exact quotient."""
    total = F.sum(col)
    return F.round(F.try_divide(total.cast("decimal(24,4)"), F.count(col)), digits)


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``100 * part / whole`` of two counts, rounded half up on the exact quotient."""
    return F.round(F.try_divide(F.lit(100) * part.cast(EXACT_COUNT), whole), digits)


def share(predicate: Column) -> Column:
    """Fraction of rows for which ``predicate`` holds, as a double."""
    return F.try_divide(F.count_if(predicate).cast("double"), F.count(F.lit(1)))


def pearson(x: str | Column, y: str | Column, where: Column | None = None) -> Column:
    """Pearson correlation over the rows where both sides are known.

    NULL instead of a division error when one side does not vary.
    """
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    y = (F.col(y) if isinstance(y, str) else y).cast("double")
    usable = x.isNotNull() & y.isNotNull()
    if where is not None:
        usable = usable & where
    px, py = F.when(usable, x), F.when(usable, y)
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def square(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col * col


def stddev_from_sums(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from a count, a sum and a sum of squares.

    ``n·Σx² − (Σx)²`` is taken on exact decimals, so nothing cancels away and partial sums
    of any grouping can be reused instead of scanning the rows again.
    """
    n = n.cast(EXACT_COUNT)
    wide = "decimal(27,4)"
    spread = n * squares.cast(wide) - total.cast("decimal(19,2)") * total.cast("decimal(19,2)")
    pairs = n.cast("double") * (n.cast("double") - 1)
    return F.sqrt(F.try_divide(spread.cast("double"), pairs))
