"""Random walks on the transition graph and the clusters they suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.functions.keys import uniform
from trailweave.operators.components import components
from trailweave.operators.sequence import running_total
from trailweave.operators.spread import LABEL_ROUNDS, min_label
from trailweave.workspace import materialize

# Walks and steps of the three programs, and their thresholds.
SHORT_WALKS, SHORT_LENGTH = 100, 2
LONG_WALKS, LONG_LENGTH = 1000, 10
STRONG_PERCENT = 85
SWEEP_STEPS = 20
SWEEP_FIRST = 2

STEPS_PER_WRITE = 5
# Join keys that the walkers at one vertex are spread over, at least.
KEYS_PER_VERTEX = 16


def _exits(edges_with_totals: DataFrame) -> DataFrame:
    """``(activity, total, width, ways)`` of every vertex that a walk can leave.

    The range ``0..total-1`` of a vertex is cut into cells of ``width``, about as many as it
    has neighbours.  A vertex of few neighbours has few cells, and is listed ``ways`` times.
    """
    degrees = edges_with_totals.groupBy(F.col("src").alias("activity")).agg(F.max("total").alias("total"), F.count("*").alias("n"))
    return degrees.selectExpr("activity", "total", "(total + n - 1) DIV n AS width", f"CAST({KEYS_PER_VERTEX} DIV n AS INT) + 1 AS ways")


def _next_vertex_table(nodes: DataFrame, edges_with_totals: DataFrame) -> DataFrame:
    """Where a draw leads: ``(lost, src, cell, way, lo, hi, to, to_total, to_width, to_ways)``.

    Neighbours of ``src``, ordered by ``(cnt, dst)``, own the intervals ``[lo, hi)`` of
    their cumulative counts, and an interval is listed in every cell it touches.  A walker
    joins on vertex, cell and way: it meets about two candidates however many neighbours
    there are, and walkers at a popular vertex are spread over its cells and ways.

    Walkers at a dead end are ``lost``.  For all of them there is one more entry per vertex,
    each a cell of its own, so that restarts are a draw like any other.
    """
    spans = running_total(edges_with_totals, ["cnt", "dst"], F.col("cnt"), within=["src"], name="hi")
    exits = nodes.where("NOT lost").select(F.col("activity").alias("src"), "width", "ways")
    listed = spans.join(exits, "src").selectExpr("src", "hi - cnt AS lo", "hi", "dst", "width", "ways").selectExpr(
        "src", "explode(sequence(lo DIV width, (hi - 1) DIV width)) AS cell", "lo", "hi", "dst", "ways"
    )
    listed = listed.selectExpr("false AS lost", "src", "cell", "explode(sequence(0, ways - 1)) AS way", "lo", "hi", "dst")
    again = nodes.selectExpr(
        "true AS lost", "'' AS src", "place - 1 AS cell", "0 AS way", "place - 1 AS lo", "place AS hi", "activity AS dst"
    )
    target = nodes.selectExpr("activity AS dst", "lost AS to_lost", "total AS to_total", "width AS to_width", "ways AS to_ways")
    return listed.unionByName(again).join(target, "dst")


def walk_cooccurrence(
    vertices: DataFrame, edges_with_totals: DataFrame, walks: int = SHORT_WALKS, length: int = SHORT_LENGTH, seed: int = 7
) -> DataFrame:
    """Co-occurrence of activities on random walks: ``(a, b, cnt)`` with ``a < b``.

    ``walks`` walks of ``length`` steps start at every activity and follow transitions in
    proportion to their counts.  After each successful step every pair of activities
    visited so far counts once from either side.  At a dead end the walk goes on at a
    random activity, which is not counted as visited until left and reached again.
    Draws depend on (start, walk, step) only.

    A pair is emitted once per walk with the number of steps at which it counted: the
    successes from the one that completed the pair onwards.
    """
    size = vertices.count()
    # A vertex without exits has the range of all vertices, one to a cell.
    known = vertices.join(_exits(edges_with_totals), "activity", "left").selectExpr(
        "activity", "total IS NULL AS lost", f"coalesce(total, {size}L) AS total", "coalesce(width, 1L) AS width", "coalesce(ways, 1) AS ways"
    )
    nodes = materialize(running_total(known, ["activity"], name="place"), "walk-nodes")
    steps = materialize(_next_vertex_table(nodes, edges_with_totals), "walk-table")
    spark = vertices.sparkSession
    state = nodes.select(
        F.col("activity").alias("start"),
        F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"),
        "lost",
        F.when(F.col("lost"), F.lit("")).otherwise(F.col("activity")).alias("cur"),
        "total",
        "width",
        "ways",
        F.array(F.struct(F.lit(0).alias("at"), F.col("activity").alias("seen"))).alias("path"),
        F.lit(0).alias("wins"),
    ).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "start", "walk")

    for step in range(1, length + 1):
        u = uniform(seed, F.col("start"), F.col("walk"), F.lit(step))
        state = state.withColumn("draw", F.floor(u * F.col("total")).cast("long")).selectExpr(
            "start", "walk", "lost", "cur AS src", "draw DIV width AS cell", "pmod(hash(start, walk), ways) AS way", "draw", "path", "wins"
        )
        moved = state.join(steps, ["lost", "src", "cell", "way"]).where("draw >= lo AND draw < hi")
        won = ~F.col("lost")
        seen = F.exists("path", lambda p: p["seen"] == F.col("dst"))
        entry = F.array(F.struct((F.col("wins") + 1).alias("at"), F.col("dst").alias("seen")))
        state = moved.select(
            "start",
            "walk",
            F.col("to_lost").alias("lost"),
            F.when(F.col("to_lost"), F.lit("")).otherwise(F.col("dst")).alias("cur"),
            F.col("to_total").alias("total"),
            F.col("to_width").alias("width"),
            F.col("to_ways").alias("ways"),
            F.when(won & ~seen, F.concat("path", entry)).otherwise(F.col("path")).alias("path"),
            (F.col("wins") + won.cast("int")).alias("wins"),
        )
        if step % STEPS_PER_WRITE == 0 and step < length:
            state = materialize(state, "walk-state")

    one = state.select("path", "wins", F.inline("path").alias("at1", "a"))
    two = one.select("wins", "at1", "a", F.inline("path").alias("at2", "b")).where(F.col("a") < F.col("b"))
    times = 2 * (F.col("wins") - F.greatest("at1", "at2") + 1)
    return two.groupBy("a", "b").agg(F.sum(times).alias("cnt"))


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def walk_clusters(pairs: DataFrame, walks: int = SHORT_WALKS) -> DataFrame:
    """Unite pairs met at least ``walks // 2`` times: ``(cluster_id, activity)``."""
    links = materialize(_links(pairs.where(F.col("cnt") >= walks // 2)), "walk-links")
    nodes = links.select(F.col("src").alias("activity")).union(links.select("dst")).distinct()
    return components(nodes, links).select(F.col("label").alias("cluster_id"), F.col("v").alias("activity"))


def walk_min_label(vertices: DataFrame, pairs: DataFrame, walks: int = LONG_WALKS, rounds: int = LABEL_ROUNDS) -> DataFrame:
    """Min label over pairs met in at least 85 % of the walks, from smaller to larger name."""
    return min_label(vertices, _links(pairs.where(F.col("cnt") >= walks * STRONG_PERCENT // 100)), rounds)


def walk_threshold_sweep(
    vertices: DataFrame, pairs: DataFrame, walks: int = LONG_WALKS, rounds: int = LABEL_ROUNDS
) -> DataFrame:
    """``walk_min_label`` at 0.10, 0.15, ... 1.00 of the walks: ``(tid, v, label)``.

    ``tid`` is the threshold in twentieths.  All thresholds run in the same rounds.
    """
    # cnt >= floor(tid * walks / 20) is the same as tid * walks < 20 * (cnt + 1).
    passed = F.expr(f"cast(least({SWEEP_STEPS}, ({SWEEP_STEPS} * (cnt + 1) - 1) div {walks}) as int)")
    links = (
        pairs.withColumn("passed", passed)
        .where(F.col("passed") >= SWEEP_FIRST)
        .select(F.explode(F.sequence(F.lit(SWEEP_FIRST), F.col("passed"))).alias("tid"), "a", "b")
        .select("tid", F.col("a").alias("src"), F.col("b").alias("dst"))
    )
    nodes = vertices.select(F.explode(F.sequence(F.lit(SWEEP_FIRST), F.lit(SWEEP_STEPS))).alias("tid"), "activity")
    return min_label(nodes, links, rounds, keys=["tid"])
