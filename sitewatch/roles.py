"""Column roles: which column plays which part in an observation table."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    """One row = one observation of one entity on one day.

    ``row`` is a unique number that orders observations of the same day.
    ``labels`` are low-cardinality attributes that may change from one observation of an
    entity to the next; ``place`` is the one attribute that does not.
    """

    entity: str = "tower_id"
    day: str = "obs_date"
    row: str = "row_id"
    place: str = "city"
    labels: tuple[str, ...] = ("operator", "state", "network_type")
    uptime: str = "uptime_percentage"
    downtime: str = "downtime_minutes"
    outages: str = "outage_count"
    users: str = "avg_users_affected"
    reason: str = "outage_reason"

    @property
    def measures(self) -> tuple[str, ...]:
        return (self.uptime, self.downtime, self.outages, self.users)


TOWERS = Roles()
