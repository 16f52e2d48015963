"""From raw text to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.functions import text
from sitewatch.roles import TOWERS, Roles

UPTIME_TYPE = "decimal(6,2)"
DOWNTIME_TYPE = "decimal(8,2)"


def typed_columns(roles: Roles = TOWERS, strict: bool = False) -> dict[str, Column]:
    """Typed expression of every raw column.

    Text is trimmed, an empty reason becomes NULL, nothing is imputed. ``strict`` lets a bad
    value fail the job, in any cast mode of the session; otherwise a bad value becomes NULL
    and ``rejects`` reports it.
    """
    columns = {c: F.trim(c) for c in (roles.entity, roles.place, *roles.labels)}
    columns[roles.reason] = F.nullif(F.trim(roles.reason), F.lit(""))
    parsed = {
        roles.day: text.calendar_day(roles.day),
        roles.uptime: text.number(roles.uptime, UPTIME_TYPE),
        roles.downtime: text.number(roles.downtime, DOWNTIME_TYPE),
        roles.outages: text.whole_number(roles.outages),
        roles.users: text.whole_number(roles.users),
    }
    for name, value in parsed.items():
        columns[name] = _or_fail(name, value) if strict else value
    return columns


def _or_fail(name: str, value: Column) -> Column:
    message = F.concat(F.lit(f"bad value in {name}: "), F.col(name))
    return F.when(_failed(name, value), F.raise_error(message)).otherwise(value)


def clean(raw: DataFrame, roles: Roles = TOWERS, strict: bool = True) -> DataFrame:
    """Typed copy of the raw rows, in the raw column order; no row is added or lost."""
    typed = typed_columns(roles, strict)
    return raw.select(*[typed[c].alias(c) if c in typed else F.col(c) for c in raw.columns])


def _failed(raw_name: str, typed: Column) -> Column:
    return F.col(raw_name).isNotNull() & typed.isNull()


def rejects(raw: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """Rows a strict ``clean`` would fail on, with one flag per typed column."""
    typed = typed_columns(roles)
    flags = {
        f"bad_{c}": _failed(c, typed[c]) for c in (roles.day, *roles.measures)
    }
    flagged = raw.select(roles.row, *[f.alias(name) for name, f in flags.items()])
    return flagged.where(F.greatest(*flags))


def castable(raw: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """Rows a strict ``clean`` accepts."""
    typed = typed_columns(roles)
    bad = [_failed(c, typed[c]) for c in (roles.day, *roles.measures)]
    return raw.where(~F.greatest(*bad))
