"""The directly-follows graph: transition counts, totals, vertices and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.operators.sequence import TIME_ORDER, pair_counts, pair_graph

# Neighbourhood offsets, minimum support and number of probability steps.
NEIGHBOURHOOD = (-1, 1, 2)
MIN_SUPPORT = 9
PROBABILITY_STEPS = 20


def global_transitions(log: DataFrame, slices: int | None = None) -> DataFrame:
    """Counts of consecutive activities over the whole log, ignoring cases."""
    return pair_counts(log, slices=slices)


def global_graph(log: DataFrame, slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All activities, and the counts of ``global_transitions``, from one pass over the log."""
    return pair_graph(log, slices=slices)


def case_transitions(log: DataFrame, order=TIME_ORDER, slices: int | None = None) -> DataFrame:
    """Counts of consecutive activities within each case."""
    return pair_counts(log, within=["case_id"], order=order, slices=slices)


def daily_transitions(log: DataFrame, min_count: int = 2, slices: int | None = None) -> DataFrame:
    """Counts within each calendar day, without self-transitions and rare pairs."""
    by_day = log.where(F.col("ts").isNotNull()).withColumn("day", F.date_format("ts", "yyyyMMdd"))
    counts = pair_counts(by_day, within=["day"], slices=slices)
    return counts.where((F.col("src") != F.col("dst")) & (F.col("cnt") >= min_count))


def neighbourhood_pairs(log: DataFrame, offsets=NEIGHBOURHOOD, slices: int | None = None) -> DataFrame:
    """Counts of each activity with the activities at the given offsets from it."""
    return pair_counts(log, offsets=offsets, slices=slices)


def activity_frequency(log: DataFrame) -> DataFrame:
    return log.groupBy("activity").agg(F.count("*").alias("freq"))


def vertices(log: DataFrame) -> DataFrame:
    """All activities of the log, also those without a transition."""
    return log.select("activity").distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    """Activities at either end of an edge."""
    return edges.select(F.col("src").alias("activity")).union(edges.select("dst")).distinct()


def sources(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("activity")).distinct()


def with_totals(edges: DataFrame) -> DataFrame:
    """Add the outgoing total of ``src``; a hot ``src`` is pre-aggregated before its shuffle."""
    return edges.join(edges.groupBy("src").agg(F.sum("cnt").alias("total")), "src").select(
        "src", "dst", "cnt", "total"
    )


def with_probabilities(edges: DataFrame) -> DataFrame:
    return with_totals(edges).withColumn("probability", F.col("cnt") / F.col("total"))


def frequent(edges: DataFrame, min_count: int = MIN_SUPPORT) -> DataFrame:
    return edges.where(F.col("cnt") >= min_count)


def strong(edges_with_totals: DataFrame, step: int, steps: int = PROBABILITY_STEPS) -> DataFrame:
    """Edges of probability at least ``step / steps``, compared in integers."""
    return edges_with_totals.where(F.col("cnt") * steps >= F.col("total") * step)


def log_weights(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.log1p(F.col("cnt").cast("double")))
