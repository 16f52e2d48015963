"""Loading raw and exported CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sitewatch.operators.ordering import running_totals
from sitewatch.sources.scratch import frozen

# Columns of a raw observation file, in file order.
RAW_COLUMNS = (
    "tower_id", "obs_date", "operator", "city", "state", "uptime_percentage",
    "downtime_minutes", "outage_count", "outage_reason", "network_type",
    "avg_users_affected",
)

# Columns of the row-level feature export, in file order.
FEATURE_EXPORT_SCHEMA = (
    "row_id bigint, tower_id string, obs_date date, operator string, city string, "
    "state string, uptime_percentage decimal(6,2), downtime_minutes decimal(8,2), "
    "outage_count int, outage_reason string, network_type string, "
    "avg_users_affected int, outage_severity string, reliability_status string, "
    "high_risk_flag int, downtime_hours decimal(12,4), observation_month string, "
    "day_of_week string"
)

# A NUL never occurs in the files, so only an unquoted empty field becomes NULL and a
# quoted empty field stays the empty string.
_NO_NULL_TEXT = "\u0000"


def load_raw(
    spark: SparkSession,
    path: str,
    columns: tuple[str, ...] = RAW_COLUMNS,
    multi_line: bool = False,
) -> DataFrame:
    """Raw CSV with a header line, every column as the text it was written as.

    Files are split into blocks and read in parallel. ``multi_line`` allows line breaks
    inside quoted fields, at the price of one task per file.
    """
    schema = StructType([StructField(name, StringType()) for name in columns])
    return read_csv(spark, path, schema, multi_line)


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False
) -> DataFrame:
    """CSV with a header line; unquoted empty fields are NULL, quoted ones are empty text."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", _NO_NULL_TEXT)
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )


def with_load_order(raw: DataFrame, name: str = "row_id", start: int = 1) -> DataFrame:
    """Contiguous numbering of file rows in load order: files by path, rows by position.

    The rows are read once, tagged with their file block and written, so rows and offsets come
    from the same reading however often the job is split anew. Blocks get their offsets by
    running totals over all tasks; a row whose block had none would fail the query.
    """
    tagged = frozen(
        raw.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_mark"),
        )
    )
    blocks = tagged.groupBy("_file", "_block").agg(
        F.min("_mark").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    starts = running_totals(blocks, [F.col("_file"), F.col("_block")], ["_rows"])
    before = F.coalesce("_rows_before", F.raise_error(F.lit("a block of rows has no offset")))
    position = before + F.col("_mark") - F.col("_first") + F.lit(start)
    return tagged.join(starts, ["_file", "_block"], "left").select(
        position.cast("bigint").alias(name), *raw.columns
    )


def load_features(spark: SparkSession, path: str, schema: str = FEATURE_EXPORT_SCHEMA) -> DataFrame:
    """An exported table read back with declared types; only empty fields are NULL."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", "")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
