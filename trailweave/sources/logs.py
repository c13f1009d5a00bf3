"""Readers that bring a table to the common event-log form.

Every operator takes a log with the columns ``event_id`` (unique long), ``case_id``,
``ts`` (timestamp without time zone, UTC), ``activity`` and ``cluster`` (the known
higher-level case, used for scoring only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.sources.positions import numbered_by_file

# Column names and timestamp format of the event-log CSV.
CSV_ACTIVITY = "Activity"
CSV_CONCEPT = "concept:name"
CSV_CLUSTER = "case:concept:name"
CSV_TIMESTAMP = "time:timestamp"
CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ssXXX"


def _utc_ntz(ts: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def read_log(spark: SparkSession, path: str, timestamp_format: str | None = CSV_TIMESTAMP_FORMAT) -> DataFrame:
    """Read an event-log CSV with a header row.

    All columns are read as text, so there is no pass over the file to infer types, and
    only the four used ones are parsed.  ``timestamp_format=None`` parses with the
    default pattern.  A timestamp that does not parse becomes null.  ``event_id`` ascends in
    file order, over several files by path; it breaks ties between equal timestamps.
    """
    raw = numbered_by_file(spark.read.option("header", True).csv(path), "event_id")
    text = F.col(f"`{CSV_TIMESTAMP}`")
    parsed = (
        F.try_to_timestamp(text, F.lit(timestamp_format)) if timestamp_format else F.try_to_timestamp(text)
    )
    return raw.select(
        "event_id",
        F.col(f"`{CSV_CONCEPT}`").alias("case_id"),
        _utc_ntz(parsed).alias("ts"),
        F.col(f"`{CSV_ACTIVITY}`").alias("activity"),
        F.col(f"`{CSV_CLUSTER}`").alias("cluster"),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, grade: Column) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("case_id"),
        "ts",
        F.concat_ws("_", F.col("event_type"), grade.cast("string")).alias("activity"),
        F.col("event_type").alias("cluster"),
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log: activity = event type and the magnitude of its value."""
    return _events(spark, sf_dir, F.floor(F.log2(F.col("value") + 1)))


def fine_events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the whole value in the activity: many activities, many of them rare."""
    return _events(spark, sf_dir, F.floor("value"))


# Total order of the lines of an order; order and line number alone repeat.
LINE_ORDER = ("ts", "l_linenumber", "l_partkey", "l_suppkey")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a log: the parts of an order in shipping order.

    The number of activities grows with the number of parts.  Lines are ordered by
    ``LINE_ORDER`` instead of ``(ts, event_id)``.
    """
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("case_id"),
        F.col("l_shipdate").alias("ts"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("activity"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


def dialogue_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as a log: the roles of a conversation in turn order."""
    return read_table(spark, sf_dir, "conversations").select(
        F.col("turn").alias("event_id"),
        F.col("conv_id").cast("string").alias("case_id"),
        F.col("role").alias("activity"),
    )
