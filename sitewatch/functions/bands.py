"""Band labels for measures, scores and probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band limits and labels, strongest condition first.
RELIABILITY_BANDS = ((99, "Excellent"), (95, "Good"), (90, "Fair"))
RELIABILITY_REST = "Poor"
HIGH_RISK_UPTIME = 95
SEVERITY_BANDS = (("High", 120, 4), ("Medium", 60, 2))
SEVERITY_REST = "Low"
SEVERITY_ORDER = ("High", "Medium", "Low")
RISK_LEVELS = ("Low Risk", "Medium Risk", "High Risk", "Critical Risk")
PROBABILITY_LEVELS = ("Low", "Medium", "High", "Critical")
PROBABILITY_LIMITS = (0.25, 0.5, 0.75)


def at_least(col: Column, bands: Sequence[tuple[float, str]], rest: str) -> Column:
    """Label of the first band whose lower limit the value reaches; NULL gets ``rest``."""
    label = None
    for limit, name in bands:
        reached = col >= limit
        label = F.when(reached, name) if label is None else label.when(reached, name)
    return label.otherwise(rest)


def at_most(col: Column, limits: Sequence[float | Column], labels: Sequence[str]) -> Column:
    """Right-closed bands: label ``i`` when ``col <= limits[i]``, else the last label."""
    label = None
    for limit, name in zip(limits, labels):
        inside = col <= limit
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return label.otherwise(labels[-1])


def severity(downtime: Column, outages: Column) -> Column:
    """Severity by downtime or outage count, whichever reaches the higher band."""
    label = None
    for name, minutes, count in SEVERITY_BANDS:
        reached = (downtime >= minutes) | (outages >= count)
        label = F.when(reached, name) if label is None else label.when(reached, name)
    return label.otherwise(SEVERITY_REST)


def severity_rank(col: Column) -> Column:
    """Sort position of a severity label, most severe first."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), col)
