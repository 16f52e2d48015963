"""Data-quality findings. Nothing here changes the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.functions import text
from sitewatch.functions.numeric import percent


def count_flags(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Number of rows on which each predicate is true: one row, one pass, any number of flags."""
    return df.agg(*[F.count_if(predicate).alias(name) for name, predicate in flags.items()])


def null_counts(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``names`` maps output name to column."""
    return count_flags(df, {name: F.col(c).isNull() for name, c in names.items()})


def blank_counts(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return count_flags(df, {name: text.is_blank(c) for name, c in names.items()})


def padding_counts(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return count_flags(df, {name: text.is_padded(c) for name, c in names.items()})


def casefold_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values as written and after trimming and lower-casing, one row per column.

    The values of all columns are de-duplicated in one scan; only those few distinct values
    are folded and counted.
    """
    values = (
        df.select(*columns)
        .unpivot([], list(columns), "col", "value")
        .where(F.col("value").isNotNull())
        .distinct()
    )
    folded = F.lower(F.trim("value"))
    return values.groupBy("col").agg(
        F.count("value").alias("raw_distinct"), F.count_distinct(folded).alias("lower_distinct")
    )


def duplicate_row_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct rows that occur more than once.

    Only a hash per row is shuffled for the whole table. Equal rows have equal hashes, so the
    rows of repeated hashes contain every duplicate, and only those are compared in full.
    """
    hashed = df.select(*columns, F.xxhash64(*columns).alias("_hash"))
    repeated = (
        hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    )
    suspects = hashed.join(repeated.select("_hash"), "_hash", "left_semi")
    copies = suspects.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    return copies.where(F.col("copies") > 1).agg(F.count(F.lit(1)).alias("duplicate_full_rows"))


def duplicate_keys(
    df: DataFrame, keys: Sequence[str], measures: dict[str, str], limit: int = 20
) -> DataFrame:
    """The most repeated keys, with how many different values each measure takes on them.

    Only counts travel for the full table. The distinct values are taken for the ``limit``
    reported keys alone, which a broadcast of at most ``limit`` rows picks out of the scan.
    """
    order = [F.desc("n"), *[F.col(k).asc_nulls_last() for k in keys]]
    worst = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .orderBy(*order)
        .limit(limit)
        .select("n", *[F.col(k).alias(f"_{k}") for k in keys])
    )
    same_key = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    rows = df.select(*keys, *measures.values()).join(F.broadcast(worst), same_key)
    return (
        rows.groupBy(*keys, "n")
        .agg(*[F.count_distinct(c).alias(name) for name, c in measures.items()])
        .orderBy(*order)
    )


def dependents(df: DataFrame, lhs: str | Column, rhs: str, name: str) -> DataFrame:
    """Different ``rhs`` values per ``lhs`` value; all ones means ``lhs`` determines ``rhs``."""
    lhs = F.col(lhs) if isinstance(lhs, str) else lhs
    counts = df.groupBy(lhs).agg(F.count_distinct(rhs).alias(name))
    return counts.orderBy(F.desc(name), F.col(counts.columns[0]).asc_nulls_last())


def broken_dependency(df: DataFrame, lhs: Column, rhs: str) -> DataFrame:
    """How many ``lhs`` values there are and how many go with several ``rhs`` values."""
    counts = df.groupBy(lhs.alias("lhs")).agg(F.count_distinct(rhs).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("determinants"), F.count_if(F.col("n") > 1).alias("mismatches")
    )


def instability(summary: DataFrame, counts: dict[str, str], digits: int = 1) -> DataFrame:
    """Entities showing more than one value of an attribute, one row per attribute.

    ``counts`` maps attribute to the entity-summary column with its distinct count.
    """
    total = F.count(F.lit(1))
    one_row = summary.agg(
        total.alias("entities"),
        *[F.count_if(F.col(c) > 1).alias(a) for a, c in counts.items()],
    )
    return one_row.unpivot("entities", list(counts), "attribute", "unstable").select(
        "attribute", "entities", "unstable",
        percent(F.col("unstable"), F.col("entities"), digits).alias("pct"),
    )
