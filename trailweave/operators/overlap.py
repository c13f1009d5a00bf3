"""Pairs of sets with enough items in common, without comparing all sets that share one.

Items are ordered from rare to frequent.  Two sets with ``need`` common items have one among
the ``size - need + 1`` rarest of either, because at most ``need - 1`` items come after those.
So only that prefix of a set is indexed, and an item that nearly all sets have is, as a
rule, in no prefix.  Pairs that meet in the index are confirmed on the whole sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.workspace import materialize


def _indexed(sets: DataFrame, need: int) -> DataFrame:
    """``(id, part, item)``: the prefix of every set of ``need`` items or more."""
    items = sets.where(F.size("items") >= need).select("id", "part", F.explode("items").alias("item"))
    shared = items.groupBy("item").agg(F.count("*").alias("n"))
    # A set has as many rows here as it has items, which is a number of thresholds.
    ordered = items.join(shared, "item").groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("all"))
    prefix = F.slice("all", F.lit(1), F.size("all") - F.lit(need - 1))
    # What only one set has meets no other.
    return ordered.select("id", "part", F.explode(prefix).alias("entry")).where("entry.n > 1").select("id", "part", "entry.item")


def candidate_pairs(sets: DataFrame, need: int) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of different parts that meet in the index of prefixes, each once."""
    index = materialize(_indexed(sets, need), "overlap-index")
    one = index.select(F.col("id").alias("a"), F.col("part").alias("part1"), "item")
    two = index.select(F.col("id").alias("b"), F.col("part").alias("part2"), "item")
    met = one.join(two, "item").where((F.col("a") < F.col("b")) & ~F.col("part1").eqNullSafe(F.col("part2")))
    return met.select("a", "b").distinct()


def overlapping_pairs(sets: DataFrame, need: int) -> DataFrame:
    """Pairs ``(a, b, times)``, ``a < b``, with ``times >= need`` common items.

    ``sets`` has ``id``, ``items`` (distinct) and ``part``; sets of one part are not
    compared.  ``need`` is 1 or more.
    """
    pairs = candidate_pairs(sets, need)
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("of_b"))
    times = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", times.cast("long").alias("times")).where(F.col("times") >= need)
