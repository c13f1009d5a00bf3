"""Values that spread along edges in rounds: labels, votes and flow.

Every round is one join of the edges with the state of their source vertex and one
aggregation at the destination.  Self-edges carry a vertex's own value, so the next
state refers to the last one only once and a few rounds run as one linear plan.  The
state is then written to the shared folder, which bounds both the plan and the work
repeated after a lost executor, and the same pass tells whether anything changed.

``keys`` are extra columns (for example a threshold id) that keep independent graphs
apart in the same rows; all of them run in the same rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.workspace import materialize, materialize_measured

ROUNDS_PER_WRITE = 3
# A source with more edges than this is split over several join keys.
EDGES_PER_KEY = 1 << 17

# Rounds of the label and flow programs, and the damping of the flow.
LABEL_ROUNDS = 10
VOTE_ROUNDS = 5
FLOW_ROUNDS = 15
FLOW_DAMPING = 0.85


class Spread:
    """Edges prepared once for many rounds.

    Vertices with more than ``per_key`` outgoing edges are hot: their edges get a salt,
    and their state is repeated once per salt.  There are at most ``edges / per_key`` of
    them.  The pass that writes the edges counts them; fewer than ``per_key`` edges in
    all cannot have a hot vertex, and rounds then join unsalted.
    """

    def __init__(self, edges: DataFrame, keys: Sequence[str] = (), per_key: int = EDGES_PER_KEY):
        self.keys = list(keys)
        self.hot = None
        written, measured = materialize_measured(edges, "edges", n=F.count("*"))
        # Stated once, so that every round scans and shuffles the edges in the same way and
        # all rounds of a plan share one exchange of them.
        self.edges = written.where(" AND ".join(f"{c} IS NOT NULL" for c in (*self.keys, "src", "dst")))
        if measured["n"] <= per_key:
            return
        at = [*self.keys, "src"]
        hot = self.edges.groupBy(*at).agg(F.count("*").alias("degree")).where(F.col("degree") > per_key)
        hot, measured = materialize_measured(
            hot.select(*at, F.ceil(F.col("degree") / per_key).cast("int").alias("ways")), "hot", n=F.count("*")
        )
        if measured["n"]:
            salt = F.coalesce(F.pmod(F.hash("dst"), F.col("ways")), F.lit(0))
            self.hot = hot
            salted = materialize(self.edges.join(hot, at, "left").withColumn("salt", salt).drop("ways"), "salted")
            self.edges = salted.where(" AND ".join(f"{c} IS NOT NULL" for c in (*at, "dst", "salt")))

    def along(self, state: DataFrame) -> DataFrame:
        """``state`` (keys, v, ...) joined to every edge that leaves ``v``."""
        at = [*self.keys, "src"]
        state = state.withColumnRenamed("v", "src")
        if self.hot is not None:
            state = state.join(self.hot, at, "left").withColumn(
                "salt", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))
            )
            at = [*at, "salt"]
            state = state.drop("ways")
        return self.edges.join(state, at)


def run_rounds(
    state: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    rounds: int | None,
    label: str,
    per_write: int = ROUNDS_PER_WRITE,
) -> DataFrame:
    """Apply ``step`` ``rounds`` times (``None``: until it changes nothing).

    ``step`` maps ``(..., v, value)`` to the same columns plus a boolean ``changed``.
    A round without a change is a fixed point, so remaining rounds are left out.
    """
    done = 0
    while rounds is None or done < rounds:
        batch = per_write if rounds is None else min(per_write, rounds - done)
        for _ in range(batch):
            state = step(state.drop("changed"))
        state, measured = materialize_measured(
            state, label, moved=F.sum(F.col("changed").cast("long"))
        )
        done += batch
        if not measured["moved"]:
            break
    return state.drop("changed")


def _own_edges(vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    return vertices.select(*keys, F.col("activity").alias("src"), F.col("activity").alias("dst"))


def start_labels(vertices: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return vertices.select(*keys, F.col("activity").alias("v"), F.col("activity").alias("label"))


def min_label(
    vertices: DataFrame,
    edges: DataFrame,
    rounds: int | None = LABEL_ROUNDS,
    keys: Sequence[str] = (),
    initial: DataFrame | None = None,
) -> DataFrame:
    """Smallest label among a vertex and those that reach it in at most ``rounds`` steps.

    Directed: labels follow the edges.  Edge weights play no part.  Result:
    ``(keys, v, label)``, isolated vertices keep their own label.
    """
    keys = list(keys)
    own = _own_edges(vertices, keys)
    spread = Spread(edges.select(*keys, "src", "dst").union(own), keys)

    def step(state: DataFrame) -> DataFrame:
        return (
            spread.along(state)
            .groupBy(*keys, "dst")
            .agg(F.expr("min(label) AS label"), F.expr("max(if(src = dst, label, null)) AS before"))
            .selectExpr(*keys, "dst AS v", "label", "label <> before AS changed")
        )

    return run_rounds(start_labels(vertices, keys) if initial is None else initial, step, rounds, "labels")


def majority_label(
    vertices: DataFrame, edges: DataFrame, rounds: int = VOTE_ROUNDS, votes: str | None = None
) -> DataFrame:
    """Synchronous label propagation by majority; every edge votes both ways.

    ``votes`` names the column that holds an edge's multiplicity (``None``: one vote per
    edge).  Ties go to the smallest label.  A self-edge votes twice for its own label.
    Result: ``(v, label)``.
    """
    count = F.col(votes) if votes else F.lit(1)
    forth = edges.select("src", "dst", count.cast("long").alias("votes"))
    back = forth.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "votes")
    # The vertex's own label takes part without a vote: it only wins where nobody votes.
    own = _own_edges(vertices, []).withColumn("votes", F.lit(0).cast("long"))
    both = forth.union(back).groupBy("src", "dst").agg(F.sum("votes").alias("votes"))
    spread = Spread(both.withColumn("own", F.lit(False)).union(own.withColumn("own", F.lit(True))))

    def step(state: DataFrame) -> DataFrame:
        tally = (
            spread.along(state)
            .groupBy("dst", "label")
            .agg(F.expr("sum(votes) AS votes"), F.expr("max(own) AS own"))
        )
        return (
            tally.groupBy("dst")
            .agg(
                F.expr("min(struct(-votes AS rank, label)).label AS label"),
                F.expr("max(if(own, label, null)) AS before"),
            )
            .selectExpr("dst AS v", "label", "label <> before AS changed")
        )

    return run_rounds(start_labels(vertices), step, rounds, "votes")


def flow_score(vertices: DataFrame, edges: DataFrame, rounds: int = FLOW_ROUNDS, damping: float = FLOW_DAMPING) -> DataFrame:
    """Damped flow along transition probabilities, from 1.0 at every vertex.

    A round sets ``damping * inflow + (1 - damping) * score``; a vertex without incoming
    edges keeps its score.  ``edges`` need ``cnt`` and ``total``.  Result: ``(v, score)``.
    """
    flows = edges.select("src", "dst", (F.lit(damping) * F.col("cnt") / F.col("total")).alias("w"))
    reached = edges.select(F.col("dst").alias("activity")).distinct().withColumn("kept", F.lit(1 - damping))
    own = vertices.join(reached, "activity", "left").select(
        F.col("activity").alias("src"), F.col("activity").alias("dst"), F.coalesce("kept", F.lit(1.0)).alias("w")
    )
    spread = Spread(flows.union(own))

    def step(state: DataFrame) -> DataFrame:
        return (
            spread.along(state)
            .groupBy("dst")
            .agg(F.expr("sum(w * score) AS score"))
            .selectExpr("dst AS v", "score", "true AS changed")
        )

    start = vertices.select(F.col("activity").alias("v"), F.lit(1.0).alias("score"))
    return run_rounds(start, step, rounds, "flow", per_write=5)


def flow_groups(scores: DataFrame) -> DataFrame:
    """Group vertices by score in thousandths, rounded half up: ``(score, activity)``."""
    return scores.select(F.floor(F.col("score") * 1000 + 0.5).cast("int").alias("score"), F.col("v").alias("activity"))


def as_clusters(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, v, label)`` as the common cluster form ``(keys, cluster_id, activity)``."""
    return labels.select(*keys, F.col("label").alias("cluster_id"), F.col("v").alias("activity"))
