"""End-to-end programs: from an event log to a written clustering.

Every program takes the log and an output folder.  ``python -m trailweave`` runs them by
name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.operators import components as comp
from trailweave.operators import consensus, dfg, evaluate, merge, spread, walks, windows
from trailweave.sinks import clusters as sinks
from trailweave.sources.clusters import member_edges, result_sets
from trailweave.workspace import materialize

SEED = 7


def _swept(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes, edges = dfg.global_graph(log)
    return nodes, consensus.threshold_communities(nodes, dfg.with_totals(edges))


def transitions(log: DataFrame, out: str) -> None:
    """Transition counts and probabilities of the whole log."""
    dfg.with_probabilities(dfg.global_transitions(log)).write.mode("overwrite").parquet(out)


def successor_merge(log: DataFrame, out: str) -> None:
    """Greedy merge of consecutive activities, at most 4 per cluster."""
    sinks.write_lines(sinks.numbered(merge.greedy_merge(dfg.global_transitions(log), merge.SUCCESSOR_CAP)), out)


def neighbourhood_merge(log: DataFrame, out: str) -> None:
    """Greedy merge of neighbouring activities, at most 6 per cluster."""
    sinks.write_lines(sinks.numbered(merge.greedy_merge(dfg.neighbourhood_pairs(log), merge.NEIGHBOURHOOD_CAP)), out)


def frequent_components(log: DataFrame, out: str) -> None:
    """Connected components of transitions seen at least 9 times."""
    nodes, edges = dfg.global_graph(log)
    sinks.write_lines(spread.as_clusters(comp.components(nodes, dfg.frequent(edges))), out)


def component_thresholds(log: DataFrame, out: str) -> None:
    """Number of components at every least count from 0 to 100."""
    nodes, edges = dfg.global_graph(log)
    sinks.write_counts_json(comp.component_counts(nodes, comp.max_spanning_forest(nodes, edges)), out)


def window_votes(log: DataFrame, out: str) -> None:
    """Majority labels over all pairs within ten minutes."""
    pairs = materialize(windows.lasting_pairs(log), "window-pairs")
    sinks.write_lines(spread.as_clusters(spread.majority_label(dfg.vertices(log), pairs, votes="cnt")), out)


def _of_sources(labels: DataFrame, edges: DataFrame) -> DataFrame:
    return spread.as_clusters(
        labels.join(dfg.sources(edges).withColumnRenamed("activity", "v"), "v", "left_semi")
    )


def case_votes(log: DataFrame, out: str) -> None:
    """Majority labels over transitions within cases."""
    edges = dfg.case_transitions(log)
    sinks.write_lines(_of_sources(spread.majority_label(dfg.endpoints(edges), edges), edges), out)


def case_strong_components(log: DataFrame, out: str) -> None:
    """Strongly connected components of transitions within cases."""
    edges = dfg.case_transitions(log)
    sinks.write_lines(_of_sources(comp.strong_components(dfg.endpoints(edges), edges), edges), out)


def global_votes(log: DataFrame, out: str) -> None:
    """Majority labels over all transitions, 10 rounds."""
    nodes, edges = dfg.global_graph(log)
    sinks.write_lines(spread.as_clusters(spread.majority_label(nodes, edges, rounds=10)), out)


def min_label(log: DataFrame, out: str) -> None:
    """Smallest label that reaches an activity within 10 transitions."""
    sinks.write_lines(spread.as_clusters(spread.min_label(*dfg.global_graph(log))), out)


def min_label_communities(log: DataFrame, out: str) -> None:
    """The same as community records."""
    sinks.write_communities_json(spread.as_clusters(spread.min_label(*dfg.global_graph(log))), out)


def label_thresholds(log: DataFrame, out: str) -> None:
    """Min-label communities at every probability threshold, one folder per threshold."""
    sinks.write_threshold_json(_swept(log)[1], out, dfg.PROBABILITY_STEPS)


def consensus_clusters(log: DataFrame, out: str) -> None:
    """Activities together at a majority of thresholds, as lines and as records."""
    found = materialize(consensus.consensus_clusters(_swept(log)[1]), "consensus")
    sinks.write_lines(sinks.numbered(found), f"{out}/lines")
    sinks.write_members_json(found, f"{out}/json")


def overlapping(log: DataFrame, out: str) -> None:
    """Overlapping clusters: every label an activity bears at any threshold."""
    strengths = consensus.membership_strength(_swept(log)[1])
    sinks.write_lines(strengths.select("cluster_id", "activity"), out)


def aggregated(log: DataFrame, out: str) -> None:
    """Communities of all thresholds merged where they share a member."""
    nodes, communities = _swept(log)
    sinks.write_lines(sinks.numbered(consensus.aggregated_clusters(nodes, communities)), out)


def _walked(log: DataFrame, count: int, length: int) -> tuple[DataFrame, DataFrame]:
    nodes, edges = dfg.global_graph(log)
    pairs = walks.walk_cooccurrence(nodes, dfg.with_totals(edges), count, length, SEED)
    return nodes, materialize(pairs, "walk-pairs")


def walk_clusters(log: DataFrame, out: str) -> None:
    """Activities that meet on short random walks."""
    _, pairs = _walked(log, walks.SHORT_WALKS, walks.SHORT_LENGTH)
    sinks.write_lines(sinks.numbered(walks.walk_clusters(pairs)), out)


def walk_min_label(log: DataFrame, out: str) -> None:
    """Min label over pairs that meet on most long walks."""
    nodes, pairs = _walked(log, walks.LONG_WALKS, walks.LONG_LENGTH)
    sinks.write_members_json(spread.as_clusters(walks.walk_min_label(nodes, pairs)), out)


def walk_thresholds(log: DataFrame, out: str) -> None:
    """The same at thresholds 0.10, 0.15, ... 1.00, one folder per threshold."""
    nodes, pairs = _walked(log, walks.LONG_WALKS, walks.LONG_LENGTH)
    sinks.write_threshold_json(walks.walk_threshold_sweep(nodes, pairs), out, walks.SWEEP_STEPS)


def daily_votes(log: DataFrame, out: str) -> None:
    """Majority labels over daily transitions, refined and named."""
    edges = dfg.daily_transitions(log)
    clusters = spread.as_clusters(spread.majority_label(dfg.endpoints(edges), edges))
    sinks.write_lines(consensus.refine_clusters(clusters, dfg.activity_frequency(log)), out)


def flow_groups(log: DataFrame, out: str) -> None:
    """Activities of equal flow score."""
    nodes, edges = dfg.global_graph(log)
    sinks.write_groups_json(spread.flow_groups(spread.flow_score(nodes, dfg.with_totals(edges))), out)


PROGRAMS: dict[str, Callable[[DataFrame, str], None]] = {
    f.__name__.replace("_", "-"): f
    for f in (
        transitions, successor_merge, neighbourhood_merge, frequent_components, component_thresholds, window_votes,
        case_votes, case_strong_components, global_votes, min_label, min_label_communities, label_thresholds,
        consensus_clusters, overlapping, aggregated, walk_clusters, walk_min_label, walk_thresholds, daily_votes,
        flow_groups,
    )
}


def score(log: DataFrame, results: str, out: str) -> None:
    """Score every clustering below a folder against the known clusters of the log.

    Lines and files that hold no cluster go to ``rejected`` and do not stop the others.
    """
    sets = result_sets(log.sparkSession, results)
    names = materialize(sets.names, "result-names")
    predicted = materialize(member_edges(sets.clusters), "result-edges")
    scores = materialize(evaluate.score_all(log, predicted, names), "scores")
    sinks.write_scores(scores, out, predicted)
    sets.rejected.orderBy("name", "file", "value").write.mode("overwrite").json(f"{out}/rejected")
