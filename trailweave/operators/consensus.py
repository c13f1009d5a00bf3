"""Sweeps over probability thresholds and what the clusterings have in common."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.operators.components import components
from trailweave.operators.dfg import PROBABILITY_STEPS
from trailweave.operators.overlap import overlapping_pairs
from trailweave.operators.sequence import running_total
from trailweave.operators.spread import LABEL_ROUNDS, min_label
from trailweave.workspace import materialize, materialize_measured

# Smallest and largest cluster left as it is, and the size of a chunk.
REFINE_MIN = 2
REFINE_MAX = 10
REFINE_CHUNK = 5


def threshold_edges(
    edges_with_totals: DataFrame, steps: int = PROBABILITY_STEPS, tids: Sequence[int] | None = None
) -> DataFrame:
    """One row per edge and threshold ``tid / steps`` it passes, compared in integers."""
    levels = F.sequence(F.lit(1), F.col("passed"))
    if tids is not None:
        levels = F.filter(F.array(*map(F.lit, tids)), lambda t: t <= F.col("passed"))
    passed = F.expr(f"cast(least({steps}, cnt * {steps} div total) as int)")
    return (
        edges_with_totals.withColumn("passed", passed)
        .where(F.col("passed") >= 1)
        .select(F.explode(levels).alias("tid"), "src", "dst")
    )


def threshold_communities(
    vertices: DataFrame, edges_with_totals: DataFrame, steps: int = PROBABILITY_STEPS, rounds: int = LABEL_ROUNDS,
    tids: Sequence[int] | None = None,
) -> DataFrame:
    """Min-label communities at every probability threshold: ``(tid, v, label)``.

    All thresholds, or those of ``tids``, run in the same rounds, kept apart by ``tid``.
    """
    levels = F.array(*map(F.lit, range(1, steps + 1) if tids is None else tids))
    nodes = vertices.select(F.explode(levels).alias("tid"), "activity")
    return min_label(nodes, threshold_edges(edges_with_totals, steps, tids), rounds, keys=["tid"])


class SharedCommunities:
    """Activities grouped by the list of communities they share with others.

    Activities with the same list behave alike towards everybody, so co-occurrence is
    counted between lists.  A community that holds a third of all activities is one entry
    of few lists, and pairs of activities appear only where they belong to a result.
    """

    def __init__(self, communities: DataFrame):
        shared = (
            communities.groupBy("tid", "label").agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
        )
        lists = (
            communities.join(shared, ["tid", "label"])
            .groupBy("v")
            .agg(F.array_sort(F.collect_list(F.struct("tid", "label"))).alias("places"))
        )
        lists = materialize(lists, "consensus-lists")
        kinds = lists.groupBy("places").agg(F.min("v").alias("kind"))
        self.kinds = materialize(kinds.withColumn("times", F.size("places")), "consensus-kinds")
        self.members = materialize(
            lists.join(self.kinds, "places").select("v", "kind", "times"), "consensus-members"
        )

    def kind_pairs(self, min_times: int) -> DataFrame:
        """Pairs of kinds ``(k1, k2, times)`` that share at least ``min_times`` communities."""
        sets = self.kinds.select(F.col("kind").alias("id"), F.col("kind").alias("part"), F.col("places").alias("items"))
        return overlapping_pairs(sets, min_times).select(F.col("a").alias("k1"), F.col("b").alias("k2"), "times")


def majority_times(steps: int = PROBABILITY_STEPS) -> int:
    """Fewest shared thresholds that count as a majority.

    Co-occurrences are counted from both sides and compared with half the number of
    thresholds, which makes 6 of 20.
    """
    return steps // 2 // 2 + 1


def consensus_pairs(communities: DataFrame, steps: int = PROBABILITY_STEPS) -> DataFrame:
    """Pairs ``a < b`` together at a majority of thresholds: ``(a, b, cnt)``.

    ``cnt`` counts both directions, twice the number of thresholds.  Only pairs of the
    result are built; the result itself is quadratic in the size of a cluster, use
    ``consensus_clusters`` where only the clusters matter.
    """
    need = majority_times(steps)
    shared = SharedCommunities(communities)
    between = materialize(shared.kind_pairs(need), "consensus-between")
    one = shared.members.select(F.col("kind").alias("k1"), F.col("v").alias("v1"))
    two = shared.members.select(F.col("kind").alias("k2"), F.col("v").alias("v2"))
    within = shared.kinds.where(F.col("times") >= need).select(
        F.col("kind").alias("k1"), F.col("kind").alias("k2"), F.col("times").cast("long").alias("times")
    )
    return (
        between.union(within)
        .join(one, "k1")
        .join(two, "k2")
        .where((F.col("k1") != F.col("k2")) | (F.col("v1") < F.col("v2")))
        .select(
            F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b"), (2 * F.col("times")).alias("cnt")
        )
    )


def consensus_clusters(communities: DataFrame, steps: int = PROBABILITY_STEPS) -> DataFrame:
    """Unite consensus pairs: ``(cluster_id, activity)``; unpaired activities are left out.

    Members of one kind hang on its smallest member, and kinds with a common run of list
    entries on the first of them, instead of on each other.  Only kinds that are still
    apart after that are compared, by the rarest communities they have.
    """
    need = majority_times(steps)
    shared = SharedCommunities(communities)
    kinds = shared.kinds.where(F.col("times") >= need)
    star = shared.members.where((F.col("times") >= need) & (F.col("v") != F.col("kind"))).select(
        F.col("v").alias("src"), F.col("kind").alias("dst")
    )
    near = materialize(_run_links(kinds, need), "consensus-runs")
    groups = components(kinds.select(F.col("kind").alias("activity")), near)
    links = star.union(near)
    open_, measured = materialize_measured(_contested_sets(kinds, groups), "consensus-open", n=F.count("*"))
    if measured["n"]:
        links = links.union(overlapping_pairs(open_, need).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    links = materialize(links, "consensus-links")
    nodes = links.select(F.col("src").alias("activity")).union(links.select("dst")).distinct()
    return components(nodes, links).select(F.col("label").alias("cluster_id"), F.col("v").alias("activity"))


def _run_links(kinds: DataFrame, need: int) -> DataFrame:
    """Link kinds that have ``need`` consecutive list entries in common, each to the first.

    Such kinds qualify pairwise.  This covers what a community that lasts over many
    thresholds holds together, in rows linear in the number of kinds.
    """
    starts = F.sequence(F.lit(1), F.col("times") - (need - 1))
    runs = kinds.select("kind", F.explode(F.transform(starts, lambda i: F.slice("places", i, F.lit(need)))).alias("run"))
    heads = runs.groupBy("run").agg(F.min("kind").alias("head"))
    return (
        runs.join(heads, "run").where(F.col("kind") != F.col("head"))
        .select(F.col("kind").alias("src"), F.col("head").alias("dst")).distinct()
    )


def _contested_sets(kinds: DataFrame, groups: DataFrame) -> DataFrame:
    """Kinds with those of their communities whose kinds are not all linked yet: ``(id, part, items)``.

    ``part`` is the group of a kind.  Kinds of two groups share contested communities only.
    """
    grouped = groups.select(F.col("v").alias("kind"), F.col("label").alias("grp"))
    places = kinds.select("kind", F.explode("places").alias("place")).join(grouped, "kind")
    contested = (
        places.groupBy("place").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"))
        .where(F.col("lo") < F.col("hi")).select("place")
    )
    return places.join(contested, "place").groupBy(F.col("kind").alias("id"), F.col("grp").alias("part")).agg(
        F.collect_list("place").alias("items")
    )


def membership_strength(communities: DataFrame) -> DataFrame:
    """At how many thresholds an activity bears a label: ``(activity, cluster_id, strength)``."""
    return communities.groupBy(F.col("v").alias("activity"), F.col("label").alias("cluster_id")).agg(
        F.count("*").cast("int").alias("strength")
    )


def overlapping_clusters(strengths: DataFrame) -> DataFrame:
    """Overlapping clusters at every least strength from 0 to the largest one.

    Result ``(min_strength, cluster_id, activity)``; the union over all strengths is the
    clustering at 0.
    """
    levels = F.explode(F.sequence(F.lit(0), F.col("strength"))).alias("min_strength")
    return strengths.select(levels, "cluster_id", "activity")


def aggregated_clusters(vertices: DataFrame, communities: DataFrame, min_tid: int = 1) -> DataFrame:
    """Merge the communities of all thresholds from ``min_tid`` on that share a member.

    The merge is transitive; a first-match fold would depend on the order in which the
    communities come.  Result: ``(cluster_id, activity)``.
    """
    chosen = communities.where(F.col("tid") >= min_tid)
    heads = chosen.groupBy("tid", "label").agg(F.min("v").alias("head"))
    links = (
        chosen.join(heads, ["tid", "label"])
        .where(F.col("v") != F.col("head"))
        .select(F.col("head").alias("src"), F.col("v").alias("dst"))
        .distinct()
    )
    return components(vertices, links).select(F.col("label").alias("cluster_id"), F.col("v").alias("activity"))


def name_clusters(clusters: DataFrame, frequency: DataFrame) -> DataFrame:
    """Most frequent activity of each cluster (ties: the largest name) and its size."""
    return (
        clusters.join(frequency, "activity", "left")
        .groupBy("cluster_id")
        .agg(
            F.max(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "activity")).alias("top"),
            F.count("*").alias("members"),
        )
        .select("cluster_id", F.col("top.activity").alias("name"), "members")
    )


def refine_clusters(clusters: DataFrame, frequency: DataFrame) -> DataFrame:
    """Drop single activities, split large clusters, name the parts: ``(cluster_id, activity)``.

    Clusters of more than ten activities are cut, in name order, into chunks of five.
    """
    sized = materialize(
        clusters.join(clusters.groupBy("cluster_id").agg(F.count("*").alias("members")), "cluster_id")
        .where(F.col("members") >= REFINE_MIN),
        "refine",
    )
    large = running_total(
        sized.where(F.col("members") > REFINE_MAX), ["activity"], within=["cluster_id"], name="place"
    )
    parts = sized.where(F.col("members") <= REFINE_MAX).select(
        F.struct("cluster_id", F.lit(0).cast("long").alias("part")).alias("cluster_id"), "activity"
    ).union(
        large.select(
            F.struct("cluster_id", F.expr(f"(place - 1) div {REFINE_CHUNK}").alias("part")).alias("cluster_id"),
            "activity",
        )
    )
    names = name_clusters(parts, frequency)
    return parts.join(names, "cluster_id").select(F.col("name").alias("cluster_id"), "activity")
