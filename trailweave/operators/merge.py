"""Greedy merging of clusters by pair count under a size cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.functions.keys import pair_hash
from trailweave.operators.components import components
from trailweave.operators.dfg import endpoints
from trailweave.operators.sequence import running_total
from trailweave.workspace import TableSeries, materialize, materialize_measured

# Clusters to stop at, smallest count that merges, caps of the two programs.
STOP_AT = 15
MIN_COUNT = 2
SUCCESSOR_CAP = 4
NEIGHBOURHOOD_CAP = 6


# One round over live(ca, cb, na, nb, pair): clusters, their sizes, and the queue key of the
# pair.  ``renamed`` leads both old names of a merged cluster to the smaller one.  The
# merges of the round come out as rows of size 0.
_ROUND = """
WITH best AS (
  SELECT c, min(side) AS side
  FROM (SELECT explode(array(ca, cb)) AS c, struct(pair, ca, cb, na + nb AS size) AS side FROM {live})
  GROUP BY c),
mutual AS (SELECT side.* FROM best GROUP BY side HAVING count(*) = 2),
renamed AS (SELECT explode(array(ca, cb)) AS c, ca AS to, size FROM mutual),
moved AS (
  SELECT coalesce(x.to, l.ca) AS ca, coalesce(y.to, l.cb) AS cb,
         coalesce(x.size, l.na) AS na, coalesce(y.size, l.nb) AS nb, l.pair
  FROM {live} l LEFT JOIN renamed x ON l.ca = x.c LEFT JOIN renamed y ON l.cb = y.c)
SELECT least(ca, cb) AS ca, greatest(ca, cb) AS cb,
       if(ca < cb, na, nb) AS na, if(ca < cb, nb, na) AS nb, pair
FROM moved WHERE ca <> cb AND na + nb <= {cap}
UNION ALL
SELECT ca, cb, 0 AS na, 0 AS nb, pair FROM mutual
"""


def merge_steps(edges: DataFrame, cap: int, min_count: int = MIN_COUNT) -> tuple[DataFrame, int]:
    """All merges of the unlimited run: ``(ord, tie, src, dst)`` in queue order, and their number.

    The queue takes pairs by count, largest first, equal counts by a hash of ``(src,
    dst)``, and unites two clusters if the sum of their sizes is at most ``cap``.  Instead
    of one pair at a time, each round merges every pair that is the best eligible one of
    both its clusters: nothing ahead of it in the queue can touch either cluster, because
    sizes only grow and a pair that does not fit never fits again.  The outcome is that of
    the sequential queue.

    Equal counts in the order of names would make a chain of equal pairs wait for each
    other one by one.  In the order of a hash, a pair waits for its neighbours only while
    their hashes fall, so the rounds grow with the logarithm of the pairs.
    """
    rank = F.struct((-F.col("cnt")).alias("ord"), pair_hash(F.col("src"), F.col("dst")).alias("tie"), "src", "dst")
    live = (
        edges.where((F.col("src") != F.col("dst")) & (F.col("cnt") >= min_count))
        .groupBy(F.least("src", "dst").alias("ca"), F.greatest("src", "dst").alias("cb"))
        .agg(F.min(rank).alias("pair"))
        .select("ca", "cb", F.lit(1).alias("na"), F.lit(1).alias("nb"), "pair")
        .where(F.col("na") + F.col("nb") <= cap)
    )
    live_rows, merged_rows = F.expr("count_if(na > 0)"), F.expr("count_if(na = 0)")
    table, measured = materialize_measured(live, "merge-live", live=live_rows)
    steps, total = TableSeries(edges.sparkSession, "merge-rounds"), 0
    while measured["live"]:
        # One pass writes the merges of this round and the pairs left for the next.
        after = edges.sparkSession.sql(_ROUND, live=table.where("na > 0"), cap=cap)
        table, measured = steps.add(after, live=live_rows, merged=merged_rows)
        total += measured["merged"]
    done = steps.all().where("na = 0") if total else table.where("na = 0")
    return done.selectExpr("pair.ord", "pair.tie", "pair.src", "pair.dst"), total


def greedy_merge(
    edges: DataFrame, cap: int = SUCCESSOR_CAP, stop_at: int = STOP_AT, min_count: int = MIN_COUNT
) -> DataFrame:
    """Clusters ``(cluster_id, activity)`` of the size-capped merge over ``edges``.

    Merging stops at ``stop_at`` clusters or below ``min_count``: only the first
    ``vertices - stop_at`` merges in queue order are carried out.
    """
    nodes = materialize(endpoints(edges), "merge-nodes")
    steps, total = merge_steps(edges, cap, min_count)
    allowed = max(nodes.count() - stop_at, 0)
    if total > allowed:
        steps = running_total(steps, ["ord", "tie", "src", "dst"], name="place").where(F.col("place") <= allowed)
    labels = components(nodes, steps)
    return labels.select(F.col("label").alias("cluster_id"), F.col("v").alias("activity"))
