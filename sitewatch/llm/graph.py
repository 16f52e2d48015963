"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatch.sources.scratch import frozen


def _stars(links: DataFrame) -> DataFrame:
    """One round: every node points its larger, then its smaller neighbours to the smallest one.

    Minimums are merged before the shuffle, so a node with very many neighbours costs no task
    more than others; the joins on it are splittable ones.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ).distinct()
    # Every link now leads from a larger to a smaller node.
    smallest = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(smallest, "a").select(
        F.explode(
            F.array(
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            )
        ).alias("e")
    )
    return small.select("e.*").where("a <> b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every linked node: the smallest node reachable, itself included.

    Links have no direction; null ends and links to oneself are ignored. Star contraction takes
    about the logarithm of a component's length in rounds. Each round is written to the
    checkpoint folder, and only its count and checksum reach the driver.
    """
    links = frozen(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .where("a <> b")
        .distinct()
    )
    seen = None
    while True:
        mark = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        links = frozen(_stars(links))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
