"""The registered queries: every operator on the given tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame; ``oracles.py`` has the SQL
with the same result for each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions.keys import java_hash
from trailweave.operators import components as comp
from trailweave.operators import consensus, dfg, evaluate, merge, spread, walks, windows
from trailweave.operators.sequence import running_total
from trailweave.sinks import clusters as sinks
from trailweave.sources import clusters as files
from trailweave.sources.logs import (
    CSV_ACTIVITY, CSV_CLUSTER, CSV_CONCEPT, CSV_TIMESTAMP, LINE_ORDER, dialogue_log, events_log, fine_events_log, orders_log, read_log,
)
from trailweave.workspace import fresh_path, materialize

SEED = 7
# Names of the result sets that the scoring queries compare.
SCORED = ("components", "strong_05", "strong_10")


def _global(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The log, its activities and its global transition counts."""
    log = events_log(spark, d)
    return log, *dfg.global_graph(log)


def _communities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    _, nodes, edges = _global(spark, d)
    return nodes, consensus.threshold_communities(nodes, dfg.with_totals(edges))


def _fine_communities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The sweep over fine-grained activities, many of which are rare and strongly tied."""
    nodes, edges = dfg.global_graph(fine_events_log(spark, d))
    return nodes, consensus.threshold_communities(nodes, dfg.with_totals(edges))


# --- sources, projections, transitions ---------------------------------------------


def event_log(spark, d):
    return events_log(spark, d)


def activity_frequency(spark, d):
    return dfg.activity_frequency(events_log(spark, d))


def dfg_vertices(spark, d):
    return dfg.vertices(events_log(spark, d))


def dfg_global(spark, d):
    return dfg.global_transitions(events_log(spark, d))


def transition_counts(spark, d):
    return dfg.global_transitions(events_log(spark, d)).orderBy(F.col("cnt").desc(), "src", "dst")


def transition_probabilities(spark, d):
    _, _, edges = _global(spark, d)
    return dfg.with_probabilities(edges).withColumn("probability", F.round("probability", 9))


def dfg_by_case(spark, d):
    return dfg.case_transitions(events_log(spark, d))


def dfg_by_day(spark, d):
    return dfg.daily_transitions(events_log(spark, d))


def dfg_by_order(spark, d):
    return dfg.case_transitions(orders_log(spark, d), order=LINE_ORDER)


def dfg_by_conversation(spark, d):
    return dfg.case_transitions(dialogue_log(spark, d), order=("event_id",))


def row_numbers(spark, d):
    log = events_log(spark, d).select("event_id", "ts")
    return running_total(log, ["ts", "event_id"], name="row_number").select("event_id", "row_number")


def neighbourhood_pairs(spark, d):
    return dfg.neighbourhood_pairs(events_log(spark, d))


def frequent_transitions(spark, d):
    return dfg.frequent(dfg.global_transitions(events_log(spark, d)))


def strong_transitions(spark, d):
    _, _, edges = _global(spark, d)
    return dfg.strong(dfg.with_totals(edges), 1)


def log_weights(spark, d):
    edges = dfg.daily_transitions(events_log(spark, d))
    return dfg.log_weights(edges).withColumn("weight", F.round("weight", 9))


def java_hash_ids(spark, d):
    return dfg.vertices(events_log(spark, d)).withColumn("id", java_hash(F.col("activity")))


def window_pairs(spark, d):
    return windows.window_pairs(events_log(spark, d)).select("src", "dst", "cnt")


def decay_weights(spark, d):
    pairs = windows.lasting_pairs(events_log(spark, d))
    return pairs.withColumn("weight", F.round("weight", 6))


def fading_pairs(spark, d):
    """Pairs of a faster decay, under which those of more than 460 seconds weigh too little."""
    return windows.lasting_pairs(events_log(spark, d), decay=0.01).withColumn("weight", F.round("weight", 6))


# --- graph clusterings --------------------------------------------------------------


def frequent_components(spark, d):
    _, nodes, edges = _global(spark, d)
    return spread.as_clusters(comp.components(nodes, dfg.frequent(edges)))


def part_components(spark, d):
    edges = dfg.case_transitions(orders_log(spark, d), order=LINE_ORDER)
    return spread.as_clusters(comp.components(dfg.endpoints(edges), dfg.frequent(edges, 2)))


def component_count_sweep(spark, d):
    _, nodes, edges = _global(spark, d)
    return comp.component_counts(nodes, comp.max_spanning_forest(nodes, edges))


def max_spanning_forest(spark, d):
    _, nodes, edges = _global(spark, d)
    return comp.max_spanning_forest(nodes, edges)


def scc(spark, d):
    log = events_log(spark, d)
    edges = dfg.case_transitions(log)
    return spread.as_clusters(comp.strong_components(dfg.vertices(log), edges))


def lpa_dfg(spark, d):
    edges = dfg.case_transitions(events_log(spark, d))
    labels = spread.majority_label(dfg.endpoints(edges), edges)
    named = labels.join(dfg.sources(edges).withColumnRenamed("activity", "v"), "v", "left_semi")
    return spread.as_clusters(named)


def lpa_global(spark, d):
    _, nodes, edges = _global(spark, d)
    return spread.as_clusters(spread.majority_label(nodes, edges, rounds=10))


def lpa_window(spark, d):
    log = events_log(spark, d)
    pairs = materialize(windows.lasting_pairs(log), "window-pairs")
    return spread.as_clusters(spread.majority_label(dfg.vertices(log), pairs, votes="cnt"))


def _daily_clusters(spark, d):
    edges = dfg.daily_transitions(events_log(spark, d))
    return spread.as_clusters(spread.majority_label(dfg.endpoints(edges), edges))


def lpa_daily(spark, d):
    return _daily_clusters(spark, d)


def refined_clusters(spark, d):
    frequency = dfg.activity_frequency(events_log(spark, d))
    return consensus.refine_clusters(_daily_clusters(spark, d), frequency)


def cluster_names(spark, d):
    log, nodes, edges = _global(spark, d)
    clusters = spread.as_clusters(comp.components(nodes, dfg.frequent(edges)))
    return consensus.name_clusters(clusters, dfg.activity_frequency(log))


def min_label_communities(spark, d):
    _, nodes, edges = _global(spark, d)
    return spread.as_clusters(spread.min_label(nodes, edges))


def flow_score(spark, d):
    _, nodes, edges = _global(spark, d)
    return spread.flow_score(nodes, dfg.with_totals(edges)).select(
        F.col("v").alias("activity"), F.round("score", 6).alias("score")
    )


def flow_groups(spark, d):
    _, nodes, edges = _global(spark, d)
    groups = spread.flow_groups(spread.flow_score(nodes, dfg.with_totals(edges)))
    return groups.groupBy("score").agg(F.concat_ws(",", F.array_sort(F.collect_set("activity"))).alias("activities"))


def _tied(spark, d) -> tuple[DataFrame, DataFrame]:
    """Fine-grained activities and the transitions that make up a tenth of their source: many small clusters."""
    nodes, edges = dfg.global_graph(fine_events_log(spark, d))
    return nodes, materialize(dfg.strong(dfg.with_totals(edges), 2), "tied")


def scc_fine(spark, d):
    return spread.as_clusters(comp.strong_components(*_tied(spark, d)))


def scc_parts(spark, d):
    edges = dfg.case_transitions(orders_log(spark, d), order=LINE_ORDER)
    return spread.as_clusters(comp.strong_components(dfg.endpoints(edges), dfg.strong(dfg.with_totals(edges), 1)))


def lpa_window_fine(spark, d):
    log = fine_events_log(spark, d)
    pairs = materialize(dfg.frequent(windows.lasting_pairs(log), 2), "window-pairs")
    return spread.as_clusters(spread.majority_label(dfg.vertices(log), pairs, votes="cnt"))


def lpa_fine(spark, d):
    return spread.as_clusters(spread.majority_label(*_tied(spark, d), rounds=10))


def min_label_fine(spark, d):
    return spread.as_clusters(spread.min_label(*_tied(spark, d)))


# --- merges, sweeps, consensus ------------------------------------------------------


def greedy_merge(spark, d):
    _, _, edges = _global(spark, d)
    return merge.greedy_merge(edges, merge.SUCCESSOR_CAP)


def greedy_merge_neighbourhood(spark, d):
    pairs = dfg.neighbourhood_pairs(events_log(spark, d))
    return merge.greedy_merge(pairs, merge.NEIGHBOURHOOD_CAP)


def greedy_merge_parts(spark, d):
    edges = dfg.case_transitions(orders_log(spark, d), order=LINE_ORDER)
    return merge.greedy_merge(edges, merge.SUCCESSOR_CAP)


def threshold_communities(spark, d):
    _, communities = _communities(spark, d)
    return communities.select("tid", F.col("label").alias("cluster_id"), F.col("v").alias("activity"))


def threshold_clusters_nested(spark, d):
    _, communities = _communities(spark, d)
    return sinks.threshold_json(communities, dfg.PROBABILITY_STEPS).withColumn(
        "members", F.concat_ws(",", "members")
    )


def consensus_pairs(spark, d):
    _, communities = _fine_communities(spark, d)
    return consensus.consensus_pairs(communities)


def consensus_clusters(spark, d):
    _, communities = _fine_communities(spark, d)
    return consensus.consensus_clusters(communities)


def membership_strength(spark, d):
    _, communities = _communities(spark, d)
    return consensus.membership_strength(communities)


def overlapping_clusters(spark, d):
    _, communities = _communities(spark, d)
    return consensus.overlapping_clusters(consensus.membership_strength(communities))


def aggregated_clusters(spark, d):
    nodes, communities = _fine_communities(spark, d)
    return consensus.aggregated_clusters(nodes, communities, min_tid=1)


# --- walks --------------------------------------------------------------------------


def _walk_pairs(spark, d, count, length):
    _, nodes, edges = _global(spark, d)
    return nodes, walks.walk_cooccurrence(nodes, dfg.with_totals(edges), count, length, SEED)


def walk_cooccurrence(spark, d):
    return _walk_pairs(spark, d, walks.SHORT_WALKS, walks.SHORT_LENGTH)[1]


def walk_clusters(spark, d):
    _, pairs = _walk_pairs(spark, d, walks.SHORT_WALKS, walks.SHORT_LENGTH)
    return walks.walk_clusters(pairs)


def walk_clusters_fine(spark, d):
    """Short walks over the strong transitions of fine activities; many end where nothing leads on."""
    nodes, tied = _tied(spark, d)
    pairs = walks.walk_cooccurrence(nodes, dfg.with_totals(tied.select("src", "dst", "cnt")), walks.SHORT_WALKS, walks.SHORT_LENGTH, SEED)
    return walks.walk_clusters(pairs)


def walk_min_label(spark, d):
    nodes, pairs = _walk_pairs(spark, d, walks.LONG_WALKS, walks.LONG_LENGTH)
    return spread.as_clusters(walks.walk_min_label(nodes, pairs))


def walk_threshold_sweep(spark, d):
    nodes, pairs = _walk_pairs(spark, d, walks.LONG_WALKS, walks.LONG_LENGTH)
    return spread.as_clusters(walks.walk_threshold_sweep(nodes, materialize(pairs, "walk-pairs")), ["tid"])


# --- evaluation ---------------------------------------------------------------------


def _scored_sets(spark, d) -> tuple[DataFrame, list[DataFrame]]:
    """The log and the scored clusterings: components and two levels of the threshold sweep."""
    log, nodes, edges = _global(spark, d)
    swept = consensus.threshold_communities(nodes, dfg.with_totals(edges), tids=(1, 2))
    sets = [comp.components(nodes, dfg.frequent(edges)), *(swept.where(F.col("tid") == tid) for tid in (1, 2))]
    return log, [spread.as_clusters(s) for s in sets]


def _predicted(spark, d) -> tuple[DataFrame, DataFrame]:
    """Edges of the scored result sets."""
    log, sets = _scored_sets(spark, d)
    named = [s.select(F.lit(name).alias("name"), "cluster_id", "activity") for name, s in zip(SCORED, sets)]
    return log, materialize(evaluate.cluster_edges(named[0].union(named[1]).union(named[2])), "predicted")


def truth_edges(spark, d):
    return evaluate.truth_edges(events_log(spark, d)).select("cluster_id", "src", "dst")


def commonality(spark, d):
    log, predicted = _predicted(spark, d)
    truth = materialize(evaluate.truth_edges(log), "truth")
    both = evaluate.commonality(truth, predicted, SCORED).withColumn("directed", F.lit(0))
    one = evaluate.commonality(truth, predicted, SCORED, directed=True).withColumn("directed", F.lit(1))
    return both.union(one).withColumn("ratio", F.round("ratio", 9))


def chain_accuracy(spark, d):
    log, predicted = _predicted(spark, d)
    scores = evaluate.chain_accuracy(evaluate.truth_edges(log), predicted, evaluate.chain_edges(log), SCORED)
    return scores.withColumns({"accuracy": F.round("accuracy", 9), "custom": F.round("custom", 9)})


def _contingency(spark, d) -> DataFrame:
    log, predicted = _predicted(spark, d)
    return materialize(evaluate.label_contingency(evaluate.truth_edges(log), predicted, SCORED), "contingency")


def label_contingency(spark, d):
    return _contingency(spark, d)


def label_mapping(spark, d):
    return evaluate.label_mapping(_contingency(spark, d))


def _score_table(spark, d) -> DataFrame:
    counts = _contingency(spark, d)
    return materialize(evaluate.relabelled(counts, evaluate.label_mapping(counts)), "table")


def nmi(spark, d):
    return evaluate.nmi(_score_table(spark, d)).withColumn("nmi", F.round("nmi", 9))


def ari(spark, d):
    return evaluate.ari(_score_table(spark, d)).withColumn("ari", F.round("ari", 9))


def weighted_f1(spark, d):
    return evaluate.weighted_f1(_score_table(spark, d)).withColumn("f1", F.round("f1", 9))


def _ranked(scores: DataFrame) -> DataFrame:
    rounded = {c: F.round(c, 9) for c in scores.columns if c not in ("name", "found_relationships")}
    return scores.withColumns(rounded).orderBy(F.col("custom_found").desc(), "name")


def score_all(spark, d):
    log, predicted = _predicted(spark, d)
    return _ranked(evaluate.score_all(log, predicted, SCORED))


def _written_results(spark, d) -> tuple[DataFrame, files.ResultSets]:
    """The scored clusterings, written below one folder as programs write them, and read back."""
    log, sets = _scored_sets(spark, d)
    root = fresh_path(spark, "results")
    sinks.write_lines(sets[0], f"{root}/{SCORED[0]}")
    sinks.write_communities_json(sets[1], f"{root}/{SCORED[1]}")
    sinks.write_lines(sets[2], f"{root}/{SCORED[2]}")
    return log, files.result_sets(spark, root)


def score_written(spark, d):
    log, sets = _written_results(spark, d)
    predicted = materialize(files.member_edges(sets.clusters), "result-edges")
    return _ranked(evaluate.score_all(log, predicted, materialize(sets.names, "result-names")))


def written_scores(spark, d):
    """Scores as written, best first, read back."""
    log, predicted = _predicted(spark, d)
    path = fresh_path(spark, "scores")
    sinks.write_scores(materialize(evaluate.score_all(log, predicted, SCORED), "scores"), path, predicted)
    best = spark.read.json(f"{path}/slim_sorted")
    edges = spark.read.json(f"{path}/full/edges").groupBy("name").agg(F.count("*").alias("edges"))
    return _ranked(best).join(edges, "name", "left").fillna(0, ["edges"])


def rejected_results(spark, d):
    """What a folder of results holds besides clusterings: lines without a colon, and a table."""
    _, nodes, edges = _global(spark, d)
    root = fresh_path(spark, "results")
    sinks.write_lines(spread.as_clusters(comp.components(nodes, dfg.frequent(edges))), f"{root}/runs/components")
    nodes.select("activity").write.text(f"{root}/runs/spoiled")
    edges.write.parquet(f"{root}/transitions")
    return files.result_sets(spark, root).rejected.select("name", "reason", "value").distinct()


# --- sinks and files ----------------------------------------------------------------


def cluster_lines(spark, d):
    _, nodes, edges = _global(spark, d)
    return sinks.cluster_lines(spread.as_clusters(comp.components(nodes, dfg.frequent(edges))))


def cluster_json(spark, d):
    """Write member records and read them back."""
    _, nodes, edges = _global(spark, d)
    path = fresh_path(spark, "cluster-json")
    sinks.write_members_json(spread.as_clusters(comp.components(nodes, dfg.frequent(edges))), path)
    back = spark.read.schema("members array<string>").json(path)
    return back.select(F.concat_ws(",", "members").alias("members"))


def cluster_file_edges(spark, d):
    """Write cluster lines and read the edges of their members back."""
    _, nodes, edges = _global(spark, d)
    path = fresh_path(spark, "cluster-lines")
    sinks.write_lines(spread.as_clusters(comp.components(nodes, dfg.frequent(edges))), path)
    return files.read_cluster_edges(spark, path).select("cluster_id", "src", "dst")


def csv_log(spark, d):
    """Write the log as CSV files in the order of time and read it back; row numbers follow the files."""
    log = events_log(spark, d)
    path = fresh_path(spark, "log-csv")
    log.orderBy("ts", "event_id").select(
        F.col("activity").alias(CSV_ACTIVITY), F.col("case_id").alias(CSV_CONCEPT), F.col("cluster").alias(CSV_CLUSTER),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")).alias(CSV_TIMESTAMP),
    ).write.option("header", True).csv(path)
    back = running_total(read_log(spark, path), ["event_id"], name="row_number")
    return back.select("row_number", "case_id", "ts", "activity", "cluster")


def written_thresholds(spark, d):
    """Write one folder of records per threshold and read them back."""
    _, communities = _communities(spark, d)
    path = fresh_path(spark, "thresholds")
    sinks.write_threshold_json(communities, path, dfg.PROBABILITY_STEPS)
    back = spark.read.schema("community string, members array<string>, threshold double").json(path)
    return back.withColumn("members", F.concat_ws(",", "members"))


def written_counts(spark, d):
    """Write the number of components per threshold and read it back."""
    path = fresh_path(spark, "counts")
    sinks.write_counts_json(component_count_sweep(spark, d), path)
    return spark.read.schema("threshold int, components long").json(path)


def written_groups(spark, d):
    """Write groups of equal flow score and read them back."""
    _, nodes, edges = _global(spark, d)
    path = fresh_path(spark, "groups")
    sinks.write_groups_json(spread.flow_groups(spread.flow_score(nodes, dfg.with_totals(edges))), path)
    back = spark.read.schema("score int, activities array<string>").json(path)
    return back.withColumn("activities", F.concat_ws(",", "activities"))


def written_csv(spark, d):
    """Write clusters as CSV and read them back."""
    _, nodes, edges = _global(spark, d)
    path = fresh_path(spark, "csv")
    sinks.write_csv(spread.as_clusters(comp.components(nodes, dfg.frequent(edges))), path)
    return spark.read.option("header", True).schema("ClusterID string, Activity string").csv(path)


def numbered_clusters(spark, d):
    _, nodes, edges = _global(spark, d)
    return sinks.numbered(spread.as_clusters(comp.components(nodes, dfg.frequent(edges))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        event_log, activity_frequency, dfg_vertices, dfg_global, transition_counts, transition_probabilities,
        dfg_by_case, dfg_by_day, dfg_by_order, dfg_by_conversation, row_numbers, neighbourhood_pairs,
        frequent_transitions, strong_transitions, log_weights, java_hash_ids, window_pairs, decay_weights, fading_pairs,
        frequent_components, part_components, component_count_sweep, max_spanning_forest, scc, lpa_dfg,
        lpa_global, lpa_window, lpa_daily, refined_clusters, cluster_names, min_label_communities, flow_score,
        flow_groups, scc_fine, scc_parts, lpa_fine, lpa_window_fine, min_label_fine, greedy_merge, greedy_merge_neighbourhood,
        greedy_merge_parts, threshold_communities,
        threshold_clusters_nested, consensus_pairs, consensus_clusters, membership_strength,
        overlapping_clusters, aggregated_clusters, walk_cooccurrence, walk_clusters, walk_clusters_fine, walk_min_label,
        walk_threshold_sweep, truth_edges, commonality, chain_accuracy, label_contingency, label_mapping,
        nmi, ari, weighted_f1, score_all, score_written, written_scores, rejected_results, cluster_lines, cluster_json,
        cluster_file_edges, numbered_clusters, csv_log, written_thresholds, written_counts, written_groups, written_csv,
    )
}
