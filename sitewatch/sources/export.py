"""Writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with a header line; NULL is an empty field, empty text is a quoted empty field.

    ``order`` sorts the rows over all part files (a range-partitioned sort).
    """
    rows = df.orderBy(*order) if order else df
    (
        rows.write.mode("overwrite")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("escape", '"')
        .csv(path)
    )


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json_document(document: DataFrame, path: str) -> None:
    """A table of structs and arrays, one compact JSON document for each row."""
    document.select(F.to_json(F.struct(*document.columns)).alias("value")).write.mode(
        "overwrite"
    ).text(path)
