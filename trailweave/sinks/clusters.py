"""Writers of clusterings and scores.

Operators hand clusterings around as rows ``(cluster_id, activity)``.  The line and JSON
formats hold a whole cluster in one record, so members are gathered here only, one
record per cluster and never a whole clustering in one record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.operators.sequence import running_total


def gathered(clusters: DataFrame, *keys: str) -> DataFrame:
    """One row per cluster with its members in name order."""
    return clusters.groupBy(*keys, "cluster_id").agg(F.array_sort(F.collect_set("activity")).alias("members"))


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """``id:member,member`` lines in the column ``value``."""
    line = F.concat_ws(":", F.col("cluster_id").cast("string"), F.concat_ws(",", "members"))
    return gathered(clusters).select(line.alias("value"))


def write_lines(clusters: DataFrame, path: str) -> None:
    cluster_lines(clusters).write.mode("overwrite").text(path)


def numbered(clusters: DataFrame) -> DataFrame:
    """Replace cluster ids by numbers from 0 in the order of the ids."""
    ids = running_total(clusters.select("cluster_id").distinct(), ["cluster_id"], name="place")
    return clusters.join(ids, "cluster_id").select((F.col("place") - 1).alias("cluster_id"), "activity")


def members_json(clusters: DataFrame) -> DataFrame:
    return gathered(clusters).select("members")


def write_members_json(clusters: DataFrame, path: str) -> None:
    """Records ``{"members": [...]}``."""
    members_json(clusters).write.mode("overwrite").json(path)


def communities_json(clusters: DataFrame, *keys: str) -> DataFrame:
    return gathered(clusters, *keys).select(*keys, F.col("cluster_id").alias("community"), "members")


def write_communities_json(clusters: DataFrame, path: str) -> None:
    """Records ``{"community": ..., "members": [...]}``."""
    communities_json(clusters).write.mode("overwrite").json(path)


def threshold_json(communities: DataFrame, steps: int) -> DataFrame:
    """``(threshold, community, members)`` of a sweep, ``threshold = tid / steps``."""
    rows = communities.select("tid", F.col("label").alias("cluster_id"), F.col("v").alias("activity"))
    return communities_json(rows, "tid").select(
        F.round(F.col("tid") / steps, 4).alias("threshold"), "community", "members"
    )


def write_threshold_json(communities: DataFrame, path: str, steps: int) -> None:
    """One folder of JSON records per threshold.

    The threshold is the folder name instead of a level of nesting, which would put a
    whole clustering into one record.
    """
    threshold_json(communities, steps).write.mode("overwrite").partitionBy("threshold").json(path)


def write_counts_json(counts: DataFrame, path: str) -> None:
    """Records ``{"threshold": ..., "components": ...}``."""
    counts.write.mode("overwrite").json(path)


def write_groups_json(groups: DataFrame, path: str) -> None:
    """Records ``{"score": ..., "activities": [...]}``."""
    groups.groupBy("score").agg(F.array_sort(F.collect_set("activity")).alias("activities")).write.mode(
        "overwrite"
    ).json(path)


def write_csv(clusters: DataFrame, path: str) -> None:
    """Rows ``ClusterID,Activity`` with a header."""
    clusters.select(
        F.col("cluster_id").cast("string").alias("ClusterID"), F.col("activity").alias("Activity")
    ).write.mode("overwrite").option("header", True).csv(path)


def write_scores(scores: DataFrame, path: str, edges: DataFrame | None = None) -> None:
    """Scores below ``path``: ``slim``, ``slim_sorted`` and, given ``edges``, ``full``.

    ``full`` has the scores and, in folders by name, the edges they were computed from;
    a large result set stays many rows instead of one nested record.
    """
    by_name = scores.orderBy("name")
    by_name.write.mode("overwrite").json(f"{path}/slim")
    scores.orderBy(F.col("custom_found").desc(), "name").write.mode("overwrite").json(f"{path}/slim_sorted")
    if edges is not None:
        by_name.write.mode("overwrite").json(f"{path}/full/scores")
        edges.select("name", F.col("src").alias("source"), F.col("dst").alias("destination"), "cluster_id").write.mode(
            "overwrite"
        ).partitionBy("name").json(f"{path}/full/edges")
