"""Ordered pairs of activities inside fixed time windows, with time decay.

Groups that a task can hold, in general whole windows, are summed in one pass over their
events in order (``pair_sums``).  Larger ones are refined step by step: second in the window,
millisecond in the second, microsecond, and, for events of the same instant, blocks of event
ids and single ids.  At each level the events are first reduced to cells (group, step,
activity); a pair of events is counted at the level where their steps first differ, as

    sum over cells of ``b`` of (what ``a`` gathered at earlier steps of the group) * cell

Every level has a bounded number of steps per group (600 seconds in ten minutes, 1000
milliseconds, ...), so a window, a second or an instant that holds a third of all events
is as good as any other, and the work grows with events times activities, not with the
square of the events.  Decay weights factor the same way, because
``exp(-k * (t2 - t1)) = exp(k * t1) * exp(-k * t2)``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailweave.functions.keys import epoch_micros
from trailweave.operators.pair_sums import blocks_of, pair_sums
from trailweave.workspace import materialize, materialize_measured

# Window length, decay per second and least weight of the program.
WINDOW_SECONDS = 600
DECAY = 0.001
MIN_WEIGHT = 0.01

# Groups of up to this many events are summed in one task.
DIRECT = 1 << 16


def longest_lag(decay: float, least: float, seconds: int) -> int:
    """Whole seconds up to which a pair of events weighs more than ``least``; below ``seconds``."""
    return max((lag for lag in range(seconds) if math.exp(-decay * lag) > least), default=-1)


def _pairs_of_level(
    events: DataFrame, group: list[str], step: Column, second: Column | None, decay: float, lag: int | None = None
) -> DataFrame:
    """Pairs whose steps differ within ``group``, by ``lag`` at most if given: ``(src, dst, cnt, weight)``."""
    amounts = [F.count("*").alias("n")]
    if second is not None:
        amounts += [
            F.sum(F.exp(F.lit(decay) * second)).alias("grow"),
            F.sum(F.exp(F.lit(-decay) * second)).alias("fade"),
        ]
    else:
        amounts += [F.count("*").cast("double").alias("grow"), F.count("*").cast("double").alias("fade")]
    cells = materialize(events.groupBy(*group, step.alias("step"), "activity").agg(*amounts), "window-cells")
    steps = cells.select(*group, "step").distinct()
    actors = cells.groupBy(*group, "activity").agg(F.min("step").alias("first"))
    steps_of = W.partitionBy(*group, "activity").orderBy("step")
    earlier = steps_of.rowsBetween(W.unboundedPreceding, -1) if lag is None else steps_of.rangeBetween(-lag, -1)
    gathered = (
        steps.join(actors, group).where(F.col("step") >= F.col("first"))
        .join(cells, [*group, "step", "activity"], "left")
        .select(
            *group,
            "step",
            F.col("activity").alias("src"),
            F.sum("n").over(earlier).alias("n1"),
            F.sum("grow").over(earlier).alias("w1"),
        )
        .where(F.col("n1").isNotNull())
    )
    return (
        cells.join(gathered, [*group, "step"])
        .groupBy("src", F.col("activity").alias("dst"))
        .agg(F.sum(F.col("n1") * F.col("n")).alias("cnt"), F.sum(F.col("w1") * F.col("fade")).alias("weight"))
    )


def window_pairs(
    log: DataFrame, seconds: int = WINDOW_SECONDS, decay: float = DECAY, least: float | None = None, direct: int = DIRECT
) -> DataFrame:
    """All ordered pairs of events in the same window: ``(src, dst, cnt, weight)``.

    Windows are aligned to the epoch and do not overlap.  Events are ordered by
    ``(ts, event_id)``; ``weight`` sums ``exp(-decay * dt)`` over the pairs, ``dt`` in
    whole seconds.  Events without a time are in no window.

    With ``least``, only pairs of events that weigh more than that count.  As the weight
    falls with ``dt`` alone, these are the pairs up to a lag: a sliding sum over the cells
    of earlier seconds in place of the sum over all of them.
    """
    lag = None if least is None else longest_lag(decay, least, seconds)
    if lag is not None and lag < 0:  # not even events of the same second
        return _no_pairs(log)
    if lag is not None and lag >= seconds - 1:
        lag = None
    us = epoch_micros(F.col("ts"))
    # Events without an id come first, as nulls do.
    event_id = F.coalesce(F.col("event_id").cast("long"), F.lit(-(2**63)))
    events = log.where(F.col("ts").isNotNull()).select(
        F.floor(us / F.lit(seconds * 1_000_000)).alias("win"), us.alias("us"), event_id.alias("event_id"), "activity"
    )
    second = F.floor(F.col("us") / F.lit(1_000_000))
    levels = {
        "sec": second,
        "ms": F.floor(F.col("us") / F.lit(1_000)),
        "us": F.col("us"),
        "block20": F.shiftright("event_id", 20),
        "block10": F.shiftright("event_id", 10),
        "event_id": F.col("event_id"),
    }
    group, parts = ["win"], []
    activities = events.agg(F.approx_count_distinct("activity")).first()[0]
    tasks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name, step in levels.items():
        crowd, measured = materialize_measured(
            events.groupBy(*group).agg(F.count("*").alias("crowd")).where(F.col("crowd") > 1),
            "window-crowds",
            few=F.expr(f"sum(if(crowd <= {direct}, crowd, 0))"),
            large=F.expr(f"count_if(crowd > {direct})"),
        )
        many = crowd.where(F.col("crowd") > direct).drop("crowd")
        if measured["few"]:
            few = events.join(many, group, "left_anti") if measured["large"] else events
            parts.append(pair_sums(few, group, decay, lag, blocks_of(measured["few"], activities, tasks)))
        if not measured["large"]:
            break
        events = materialize(events.join(many, group, "left_semi").withColumn(name, step), "window-events")
        offset = step - F.col("win") * seconds if name == "sec" else None
        if name != "sec" or lag is None or lag > 0:
            parts.append(_pairs_of_level(events, group, F.col(name), offset, decay, lag if name == "sec" else None))
        group = [*group, name]
    if not parts:
        return _no_pairs(log)
    return (
        reduce(DataFrame.union, parts)
        .groupBy("src", "dst")
        .agg(F.sum("cnt").alias("cnt"), F.sum("weight").alias("weight"))
    )


def _no_pairs(log: DataFrame) -> DataFrame:
    return log.selectExpr("activity AS src", "activity AS dst", "0L AS cnt", "0D AS weight").limit(0)


def lasting_pairs(
    log: DataFrame, seconds: int = WINDOW_SECONDS, decay: float = DECAY, least: float = MIN_WEIGHT, direct: int = DIRECT
) -> DataFrame:
    """``window_pairs`` of the pairs of events that weigh more than ``least``."""
    return window_pairs(log, seconds, decay, least, direct)


def lasting(pairs: DataFrame, seconds: int = WINDOW_SECONDS, decay: float = DECAY, least: float = MIN_WEIGHT) -> DataFrame:
    """Keep summed pairs of weight above ``least``, judged per pair of events.

    Sums do not tell the weights of their parts, so this only says that nothing can fall
    below ``least`` in such windows; where something can, use ``lasting_pairs``.
    """
    if math.exp(-decay * seconds) <= least:
        raise ValueError("pairs of this window can fall below the least weight; use lasting_pairs")
    return pairs
