"""Scores of clusterings against the known clusters of a log.

A clustering is judged by its edges: consecutive members of a cluster.  All result sets
are scored together, told apart by ``name``; a set without edges has scores as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.functions.keys import pair_hash
from trailweave.operators.sequence import TIME_ORDER, pair_counts, running_total
from trailweave.workspace import TableSeries, materialize, materialize_measured

# Names of the result sets: a list, or a table with the column ``name``.
Names = Sequence[str] | DataFrame
# Fixed value: label of an edge that one side does not have.
MISSING = "-1"


def first_seen(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """First ``(ts, event_id)`` of each combination of the ``by`` columns."""
    first = F.min(F.struct(*TIME_ORDER)).alias("first")
    return log.groupBy(*by).agg(first).select(*by, "first.*")


def truth_edges(log: DataFrame) -> DataFrame:
    """Consecutive activities of each known cluster by first appearance.

    Result ``(src, dst, cluster_id, seq)``; ``seq`` orders clusters by first appearance,
    for an edge that several of them have.
    """
    pairs = pair_counts(first_seen(log, ["cluster", "activity"]), within=["cluster"], keep_group=True)
    return pairs.join(first_seen(log, ["cluster"]), "cluster").select(
        "src", "dst", F.col("cluster").alias("cluster_id"), F.struct(*TIME_ORDER).alias("seq")
    )


def chain_edges(log: DataFrame) -> DataFrame:
    """Consecutive distinct activities by first appearance in the whole log."""
    return pair_counts(first_seen(log, ["activity"])).select("src", "dst")


def cluster_edges(clusters: DataFrame) -> DataFrame:
    """Consecutive members, in name order, of ``(name, cluster_id, activity)`` clusters.

    The same edges as writing sorted cluster lines in the order of their ids and reading
    them back: ``(name, src, dst, cluster_id, seq)``.
    """
    pairs = pair_counts(clusters, within=["name", "cluster_id"], order=["activity"], keep_group=True)
    return pairs.select("name", "src", "dst", "cluster_id", F.col("cluster_id").alias("seq"))


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})


def commonality(truth: DataFrame, predicted: DataFrame, names: Names, directed: bool = False) -> DataFrame:
    """Matches of truth edges: ``(name, found, total, ratio)``.

    Every matching pair of a truth edge and a predicted edge counts, so an edge that a
    result set has twice is found twice.
    """
    key = ["src", "dst"] if directed else ["a", "b"]
    known = _undirected(truth).groupBy(*key).agg(F.count("*").alias("nt"))
    guess = _undirected(predicted).groupBy("name", *key).agg(F.count("*").alias("np"))
    found = guess.join(known, key).groupBy("name").agg(F.sum(F.col("nt") * F.col("np")).alias("found"))
    total = _for_each(truth.agg(F.count("*").alias("total")), names)
    return total.join(found, "name", "left").select(
        "name",
        F.coalesce("found", F.lit(0)).alias("found"),
        "total",
        (F.coalesce("found", F.lit(0)) / F.col("total")).alias("ratio"),
    )


def _for_each(table: DataFrame, names: Names) -> DataFrame:
    """The rows of a table of totals once for each result set."""
    spark = table.sparkSession
    if not isinstance(names, DataFrame):
        names = spark.createDataFrame([(n,) for n in names], "name string")
    every = spark.sql("SELECT *, (SELECT collect_set(name) FROM {names}) AS names FROM {table}", names=names, table=table)
    return every.select("*", F.explode("names").alias("name")).drop("names")


def chain_accuracy(truth: DataFrame, predicted: DataFrame, chain: DataFrame, names: Names) -> DataFrame:
    """Confusion over the activity chain: ``(name, tp, fp, fn, tn, accuracy, custom)``.

    ``fp`` counts chain pairs that only the truth has and ``fn`` those only the result
    set has, as the scores to compare with name them.  ``custom`` is ``tp`` over all.
    """
    key = ["a", "b"]
    known = _undirected(truth).select(*key).distinct().withColumn("known", F.lit(1))
    universe = materialize(
        _undirected(chain).select(*key).join(known, key, "left").withColumn("known", F.coalesce("known", F.lit(0))),
        "chain",
    )
    guess = _undirected(predicted).select("name", *key).distinct()
    hits = guess.join(universe, key).groupBy("name").agg(
        F.sum("known").alias("tp"), F.sum(1 - F.col("known")).alias("fn")
    )
    sizes = _for_each(universe.agg(F.count("*").alias("pairs"), F.sum("known").alias("known")), names)
    tp, fn = F.coalesce("tp", F.lit(0)), F.coalesce("fn", F.lit(0))
    return (
        sizes.join(hits, "name", "left")
        .select("name", "pairs", tp.alias("tp"), (F.col("known") - tp).alias("fp"), fn.alias("fn"))
        .withColumn("tn", F.col("pairs") - F.col("tp") - F.col("fp") - F.col("fn"))
        .select(
            "name", "tp", "fp", "fn", "tn",
            ((F.col("tp") + F.col("tn")) / F.col("pairs")).alias("accuracy"),
            (F.col("tp") / F.col("pairs")).alias("custom"),
        )
    )


def label_contingency(truth: DataFrame, predicted: DataFrame, names: Names) -> DataFrame:
    """Edges by truth and predicted label: ``(name, truth, predicted, n)``, ``-1`` = missing.

    Where a side has an edge more than once, its last label counts.
    """
    known = materialize(
        truth.groupBy("src", "dst").agg(F.max_by("cluster_id", F.struct("seq", "cluster_id")).alias("truth")), "truth"
    )
    guess = predicted.groupBy("name", "src", "dst").agg(
        F.max_by("cluster_id", F.struct("seq", "cluster_id")).alias("predicted")
    )
    seen = materialize(
        guess.join(known, ["src", "dst"], "left")
        .groupBy("name", F.coalesce("truth", F.lit(MISSING)).alias("truth"), "predicted")
        .agg(F.count("*").alias("n")),
        "contingency",
    )
    every = _for_each(known.groupBy("truth").agg(F.count("*").alias("n")), names)
    met = seen.groupBy("name", "truth").agg(F.sum("n").alias("met"))
    unmet = every.join(met, ["name", "truth"], "left").select(
        "name", "truth", F.lit(MISSING).alias("predicted"), (F.col("n") - F.coalesce("met", F.lit(0))).alias("n")
    )
    return seen.union(unmet.where(F.col("n") > 0))


# One round over pairs that are not taken: those that are the best one left for both their
# labels are taken, and pairs that share a label with them go.
_ROUND = """
WITH judged AS (
  SELECT *, pair = min(pair) OVER (PARTITION BY name, predicted) AND pair = min(pair) OVER (PARTITION BY name, truth) AS best
  FROM {live}),
left AS (
  SELECT *, max(best) OVER (PARTITION BY name, predicted) OR max(best) OVER (PARTITION BY name, truth) AS met FROM judged)
SELECT name, predicted, truth, pair, best AS taken FROM left WHERE best OR NOT met
"""


def label_mapping(contingency: DataFrame) -> DataFrame:
    """One-to-one mapping of predicted to truth labels: ``(name, predicted, truth)``.

    Pairs are taken by overlap, largest first, equal ones by a hash of the labels.  A
    round accepts every pair that is the best one left for both its labels, which gives
    the outcome of taking them one by one; by the hash, pairs of equal overlap do not wait
    for each other in a row, so rounds grow with the logarithm of the labels.  It need not
    be the assignment of the largest total overlap.  Labels left over without overlap are
    paired in name order.
    """
    overlap = contingency.where((F.col("truth") != MISSING) & (F.col("predicted") != MISSING))
    tie = pair_hash(F.col("predicted"), F.col("truth"))
    live, measured = materialize_measured(
        overlap.select(
            "name", "predicted", "truth", F.struct((-F.col("n")).alias("ord"), tie.alias("tie"), "predicted", "truth").alias("pair"),
            F.lit(False).alias("taken"),
        ),
        "mapping-live", n=F.count("*"),
    )
    steps = TableSeries(live.sparkSession, "mapping-rounds")
    while measured["n"]:
        after = live.sparkSession.sql(_ROUND, live=live.where("NOT taken"))
        live, measured = steps.add(after, n=F.count_if(~F.col("taken")))
    done = (steps.all().where("taken") if steps.count else live).select("name", "predicted", "truth")
    labels = [contingency.where(F.col(side) != MISSING).select("name", side).distinct() for side in ("predicted", "truth")]
    rest = [
        running_total(
            labels[k].join(done.select("name", side), ["name", side], "left_anti"),
            [side], within=["name"], name="place",
        )
        for k, side in enumerate(("predicted", "truth"))
    ]
    return done.union(rest[0].join(rest[1], ["name", "place"]).select("name", "predicted", "truth"))


def relabelled(contingency: DataFrame, mapping: DataFrame) -> DataFrame:
    """The contingency with predicted labels replaced by the truth labels they map to."""
    to = mapping.select("name", "predicted", F.col("truth").alias("mapped"))
    return (
        contingency.join(to, ["name", "predicted"], "left")
        .groupBy("name", "truth", F.coalesce("mapped", F.lit(MISSING)).alias("predicted"))
        .agg(F.sum("n").alias("n"))
    )


def _margins(table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table.groupBy("name", "truth").agg(F.sum("n").alias("nt"))
    cols = table.groupBy("name", "predicted").agg(F.sum("n").alias("np"))
    total = table.groupBy("name").agg(F.sum("n").alias("total"))
    return rows, cols, total


def nmi(table: DataFrame) -> DataFrame:
    """Normalised mutual information, arithmetic mean of the entropies: ``(name, nmi)``."""
    rows, cols, total = _margins(table)

    def entropy(side: DataFrame, count: str, name: str) -> DataFrame:
        share = F.col(count) / F.col("total")
        return side.join(total, "name").groupBy("name").agg((-F.sum(share * F.ln(share))).alias(name))

    joint = table.join(rows, ["name", "truth"]).join(cols, ["name", "predicted"]).join(total, "name")
    term = F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("nt") * F.col("np")))
    mutual = joint.groupBy("name").agg(F.sum(term).alias("mi"))
    both = mutual.join(entropy(rows, "nt", "ht"), "name").join(entropy(cols, "np", "hp"), "name")
    mean = (F.col("ht") + F.col("hp")) / 2
    return both.select(
        "name",
        F.when(mean == 0, 1.0).when(F.abs("mi") < 1e-12, 0.0).otherwise(F.col("mi") / mean).alias("nmi"),
    )


def ari(table: DataFrame) -> DataFrame:
    """Adjusted Rand index from pair counts: ``(name, ari)``."""
    rows, cols, total = _margins(table)

    def pairs(df: DataFrame, count: str, name: str) -> DataFrame:
        n = F.col(count).cast("double")
        return df.groupBy("name").agg(F.sum(n * (n - 1) / 2).alias(name))

    sums = (
        pairs(table, "n", "both").join(pairs(rows, "nt", "st"), "name").join(pairs(cols, "np", "sp"), "name")
        .join(pairs(total, "total", "every"), "name")
    )
    chance = F.col("st") * F.col("sp") / F.col("every")
    peak = (F.col("st") + F.col("sp")) / 2
    same = (F.col("both") == F.col("st")) & (F.col("both") == F.col("sp"))
    return sums.select("name", F.when(same, 1.0).otherwise((F.col("both") - chance) / (peak - chance)).alias("ari"))


def weighted_f1(table: DataFrame) -> DataFrame:
    """F1 per truth label, averaged by its number of edges: ``(name, f1)``."""
    rows, cols, total = _margins(table)
    hits = table.where(F.col("truth") == F.col("predicted")).select("name", "truth", F.col("n").alias("tp"))
    guesses = cols.withColumnRenamed("predicted", "truth")
    joined = rows.join(hits, ["name", "truth"], "left").join(guesses, ["name", "truth"], "left").join(total, "name")
    f1 = 2 * F.coalesce("tp", F.lit(0)) / (F.col("nt") + F.coalesce("np", F.lit(0)))
    return joined.groupBy("name").agg(F.sum(f1 * F.col("nt") / F.col("total")).alias("f1"))


def score_all(log: DataFrame, predicted: DataFrame, names: Names) -> DataFrame:
    """All scores of all result sets, to be ordered by ``custom`` at the sink."""
    truth = materialize(truth_edges(log), "truth-edges")
    predicted = materialize(predicted, "predicted-edges")
    counts = materialize(label_contingency(truth, predicted, names), "score-contingency")
    table = materialize(relabelled(counts, label_mapping(counts)), "score-table")
    scores = commonality(truth, predicted, names).select(
        "name", F.col("found").alias("found_relationships"), F.col("ratio").alias("ratio_found")
    )
    for part in (nmi(table), ari(table), weighted_f1(table)):
        scores = scores.join(part, "name")
    chain = chain_accuracy(truth, predicted, chain_edges(log), names)
    return scores.join(chain.select("name", "accuracy", F.col("custom").alias("custom_found")), "name")
