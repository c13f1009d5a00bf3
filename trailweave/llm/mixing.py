"""Mixing sources to target weights along a curriculum.

A schedule gives each source a weight that changes with training progress ``u`` in
[0, 1], piecewise linearly between knots.  The integral of a source's weight is its share
of all words to take; a source gives at most ``cap`` times its size, and what that leaves
over is shared among the others by weight.  Inside a source documents stand in a fixed
random order.  A document's place in the source's cumulative words, inverted through the
integral of its schedule, is its training position, and sorting by position by range
interleaves the sources as the schedule asks.

All of it is DataFrame operations.  A source is cut into ``BINS`` bins of the order, whose
sums are small; running totals are window sums inside a bin, so a source that holds most
of the rows is spread over as many tasks as there are bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
#: Words, as the corpus counts them.
WORDS = "CAST(coalesce(regexp_count({}, '[^\\\\x20\\\\x09-\\\\x0D]+'), 0) AS LONG)"
#: Knots (u, w) by rank of the source: weights 3, 1, 2 in turn; falling, even and rising.
SCHEDULE = """CASE _rank % 3
    WHEN 0 THEN array(struct(0D AS u, 4.5D AS w), struct(1D AS u, 1.5D AS w))
    WHEN 1 THEN array(struct(0D AS u, 1D AS w), struct(1D AS u, 1D AS w))
    ELSE array(struct(0D AS u, 1D AS w), struct(0.5D AS u, 2D AS w), struct(1D AS u, 3D AS w)) END"""


def _targets(totals: DataFrame, schedule: str, share: float, cap: int) -> DataFrame:
    """Target words and schedule segments of each source, from ``(source, words)``.

    Runs on one row per source.  A segment is ``(u, w, slope, area)`` with the area to its
    left; ``weight`` is the whole area.
    """
    spark = totals.sparkSession
    ranked = totals.selectExpr("*", "row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS _rank")
    knots = ranked.selectExpr("*", f"{schedule} AS knots")
    steps = knots.selectExpr(
        "source", "words", "_rank", "knots",
        """aggregate(sequence(1, size(knots) - 1), array(0D), (areas, i) -> concat(areas, array(areas[i - 1] +
           (knots[i].u - knots[i - 1].u) * (knots[i].w + knots[i - 1].w) / 2))) AS areas""",
    ).selectExpr(
        "source", "words", "_rank", "element_at(areas, -1) AS weight",
        """transform(sequence(1, size(knots) - 1), i -> named_struct('u', knots[i - 1].u, 'w', knots[i - 1].w, 'slope',
           (knots[i].w - knots[i - 1].w) / (knots[i].u - knots[i - 1].u), 'area', areas[i - 1])) AS segments""",
    )
    return spark.sql(
        f"""
        WITH filled AS (
            SELECT *, {share} * sum(words) OVER () AS demand, sum(weight) OVER () AS all_weight,
                coalesce(sum({cap} * words) OVER before, 0) AS full_words, coalesce(sum(weight) OVER before, 0) AS full_weight
            FROM {{steps}}
            WINDOW before AS (ORDER BY {cap} * words / weight, _rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        judged AS (
            SELECT *, (demand - full_words) / (all_weight - full_weight) AS level FROM filled),
        capped AS (
            SELECT *, level * weight >= {cap} * words AS full FROM judged)
        SELECT source, words, weight, segments,
            CASE WHEN full THEN CAST({cap} * words AS DOUBLE)
                 ELSE weight * max(CASE WHEN NOT full THEN level END) OVER () END AS target
        FROM capped
        """,
        steps=steps,
    )


def plan(
    docs: DataFrame, size: str = WORDS.format("text"), share: float = 1.5, cap: int = 2, schedule: str = SCHEDULE
) -> DataFrame:
    """The columns of ``docs``, in a struct ``row``, with what the mix takes of each row.

    Adds ``size``, ``source_size``, ``target`` (of its source), ``copies``, ``taken``
    (words, repeats counted) and ``positions``, one for each copy.  Whole documents are
    taken: a pass over a source takes those whose middle lies before the target, so a
    source's words miss its target by half a document at most.  A null source is a source
    and comes last; null texts have size 0; documents without an id, and repeated rows,
    take part like others.  Sources of size 0 and empty tables give targets of 0.
    """
    digits = "conv(substring(md5(coalesce(CAST(doc_id AS STRING), '')), 1, 13), 16, 10)"
    tie = "xxhash64(text)" if "text" in docs.columns else "0L"
    every = F.struct(*[docs[i].alias(f"c{i}") for i in range(len(docs.columns))])
    placed = docs.select(
        F.expr("CAST(doc_id AS LONG)").alias("_id"), F.col("source").alias("_source"), F.expr(size).alias("size"),
        F.expr(f"CAST({digits} AS LONG)").alias("_at"), F.expr(tie).alias("_tie"), every.alias("row"),
    ).withColumn("_bin", F.expr(f"CAST(_at div {2**52 // BINS} AS INT)"))
    bins = placed.groupBy(F.col("_source").alias("source"), F.col("_bin").alias("bin")).agg(F.sum("size").alias("words"))
    before = bins.selectExpr(
        "source", "bin",
        """coalesce(sum(words) OVER (PARTITION BY source ORDER BY bin
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before""",
    )
    targets = _targets(bins.groupBy("source").agg(F.sum("words").alias("words")), schedule, share, cap)
    frame = before.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).select(
        "b.source", "bin", "before", "words", "weight", "segments", "target"
    )
    found = placed.join(frame, F.expr("_source <=> source AND _bin = bin"))
    running = """before + coalesce(sum(size) OVER (PARTITION BY source, bin ORDER BY _at, _id, size, _tie
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"""
    taken = found.withColumn("_from", F.expr(running)).withColumn(
        "_starts",
        F.expr(f"filter(transform(sequence(0, {cap} - 1), p -> p * words + _from), s -> s + size / 2D < target)"),
    )
    invert = """transform(transform(_starts, s -> named_struct('area', s / target * weight)), d ->
        element_at(transform(filter(segments, g -> g.area <= d.area), g -> g.u + coalesce(
            2 * (d.area - g.area) / nullif(g.w + sqrt(greatest(0D, g.w * g.w + 2 * g.slope * (d.area - g.area))), 0D), 0D)),
            -1))"""
    return taken.selectExpr(
        "row", "size", "words AS source_size", "target", "size(_starts) AS copies", "size(_starts) * size AS taken",
        f"{invert} AS positions",
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in training order, each as often as the mix takes it."""
    copies = plan(docs, **options).select("row", F.explode("positions").alias("position"))
    return copies.orderBy("position").select("row.*").toDF(*docs.columns)
