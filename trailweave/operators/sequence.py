"""Operators on the order of a log that never put the whole order into one task.

Rows are cut into slices by borders that are plain values: quantiles of the first order key,
sketched in one pass.  A value that alone is too much for a slice, an instant that holds a
third of all rows, is cut by quantiles of the next key, and so on.  Where the order is within
groups, a group is a slice of its own, and only crowded groups are cut.  As the slice of a
row follows from the row alone, one exchange brings the rows of a slice together, and a
window partitioned by slice works on each; only the few rows at the borders between slices
are stitched afterwards, and sums over slices need no order.

Orders that begin with a name have no quantiles.  They are range-partitioned by Spark, whose
borders need not be the same in the next run, so what is needed from such slices leaves in a
single pass, whose result is written before it is read twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailweave.functions.keys import epoch_micros
from trailweave.workspace import materialize, materialize_measured

TIME_ORDER = ("ts", "event_id")
# Rows that are not worth a slice of the whole order, or a cut through a group.
PER_SLICE = 1 << 14
PER_GROUP = 1 << 17
# Slices for each shuffle partition, so that tasks of several slices are even.
SLICES_PER_PARTITION = 4
# Cells in which groups are counted together, to see whether any can be crowded.
CELLS = 1 << 16
# Borders of one group and key, at most; a group of more rows has larger slices.
MOST_BORDERS = 1 << 14


class Slices(NamedTuple):
    """Rows with ``slice`` (null where a group is whole), and the window that works on a slice."""

    rows: DataFrame
    cut: bool
    partition: list[str]
    order: list[str]


def _position(rows: DataFrame, key: str) -> Column | None:
    """An order key as a long, null first; None for keys that are no numbers or times."""
    kind = dict(rows.dtypes)[key]
    if kind == "timestamp_ntz":
        value = epoch_micros(F.col(key))
    elif kind == "timestamp":
        value = F.unix_micros(key)
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        value = F.col(key).cast("long")
    else:
        return None
    return F.coalesce(value, F.lit(-(2**62)))


def _rank(borders: str, place: str) -> str:
    """SQL of the number of ascending borders that are at most ``place``, by bisection."""
    middle = "CAST((a.lo + a.hi) DIV 2 AS INT)"
    return f"""aggregate(sequence(0, CAST(ceil(log2(size({borders}) + 1)) AS INT)), named_struct('lo', 0, 'hi', size({borders})),
        (a, i) -> CASE WHEN a.lo >= a.hi THEN a
            WHEN {borders}[{middle}] <= {place} THEN named_struct('lo', {middle} + 1, 'hi', a.hi)
            ELSE named_struct('lo', a.lo, 'hi', {middle}) END, a -> a.lo)"""


# Of ascending quantiles ``q``: values that fill the space between two of them, and the borders,
# with one on both sides of such a value.
_HEAVY = "array_distinct(filter(q, (v, i) -> i > 0 AND v = q[i - 1]))"
_BORDERS = f"array_sort(array_distinct(concat(q, transform({_HEAVY}, v -> v + 1))))"


def _sketched(rows: DataFrame, group: Sequence[str], place: str, count: int) -> DataFrame:
    """``(group, q)``: the ``count - 1`` quantiles of ``place`` in each group."""
    shares = F.array(*[F.lit(k / count) for k in range(1, count)])
    return rows.groupBy(*group).agg(F.percentile_approx(place, shares, F.lit(max(10_000, 4 * count))).alias("q"))


def _keyed(table: DataFrame, group: Sequence[str], *rest: Column | str) -> DataFrame:
    return table.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)], *rest)


def _meet(rows: DataFrame, table: DataFrame, group: Sequence[str], how: str) -> DataFrame:
    """Join with a small table whose ``_k0, _k1, ...`` are values of the group columns, null too."""
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(group)])
    joined = rows.join(table, same, how)
    return joined if how == "left_semi" else joined.drop(*[f"_k{i}" for i in range(len(group))])


def _crowded_groups(rows: DataFrame, within: Sequence[str], slices: int | None) -> tuple[DataFrame | None, int]:
    """``(_k0, ..., n)`` of the groups that have more rows than a limit, if any, and the limit.

    Groups are first counted together in ``CELLS`` cells, which is one small row per cell.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select(*within, F.pmod(F.xxhash64(*within), F.lit(CELLS)).alias("_cell"))
    cells = placed.groupBy("_cell").agg(F.count("*").alias("n"))
    seen = cells.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    limit = max(1, (seen["total"] or 0) // slices) if slices else max(PER_GROUP, (seen["total"] or 0) // partitions)
    if (seen["most"] or 0) <= limit:
        return None, limit
    full = cells.where(F.col("n") > limit).select("_cell")
    counted = placed.join(full, "_cell", "left_semi").groupBy(*within).agg(F.count("*").alias("n"))
    found, measured = materialize_measured(_keyed(counted.where(F.col("n") > limit), within, "n"), "crowded", n=F.count("*"))
    return (found if measured["n"] else None), limit


def _sliced(rows: DataFrame, order: Sequence[str], within: Sequence[str], slices: int | None) -> Slices:
    if _position(rows, order[0]) is None:
        keys = [*within, *order]
        ranged = rows.repartitionByRange(slices, *keys) if slices else rows.repartitionByRange(*keys)
        return Slices(ranged.withColumn("slice", F.array(F.spark_partition_id())), True, ["slice"], keys)
    partition, plain = [*within, "slice"], rows
    if within:
        whole = Slices(plain.withColumn("slice", F.lit(None).cast("array<int>")), False, partition, list(order))
        crowded, limit = _crowded_groups(rows, within, slices)
    else:
        whole = Slices(plain.withColumn("slice", F.array(F.lit(0))), False, partition, list(order))
        rows, crowded, limit = _first_borders(rows, order[0], slices)
    ranks = [] if within or limit is None else ["_s0"]
    group = [*within, *["_x0"] * len(ranks)]
    for level in range(len(ranks), len(order)):
        place = _position(rows, order[level])
        if place is None or crowded is None:
            break
        rows = rows.withColumn(f"_x{level}", place)
        count = min(-(-crowded.agg(F.max("n")).first()[0] // limit), MOST_BORDERS)
        inside = _meet(rows, crowded.drop("n"), group, "left_semi")
        quantiles = materialize(_keyed(_sketched(inside, group, f"_x{level}", max(2, count)), group, "q"), "quantiles")
        rows = _meet(rows, quantiles.withColumn("_b", F.expr(_BORDERS)).drop("q"), group, "left").withColumn(
            f"_s{level}", F.when(F.col("_b").isNotNull(), F.expr(_rank("_b", f"_x{level}")))
        ).drop("_b")
        ranks.append(f"_s{level}")
        heavy = quantiles.select("*", F.explode(F.expr(_HEAVY)).alias(f"_k{len(group)}")).withColumn(
            "n", F.expr(f"{limit}L * (1 + size(filter(q, v -> v = _k{len(group)})))")
        )
        group.append(f"_x{level}")
        crowded, measured = materialize_measured(heavy.drop("q"), "crowded", n=F.count("*"))
        crowded = crowded if measured["n"] else None
    if not ranks:
        return whole
    ranked = F.when(F.col(ranks[0]).isNotNull(), F.array(*[F.coalesce(F.col(r), F.lit(0)) for r in ranks]))
    return Slices(rows.select(*[plain[c] for c in plain.columns], ranked.alias("slice")), True, partition, list(order))


def _first_borders(rows: DataFrame, key: str, slices: int | None) -> tuple[DataFrame, DataFrame | None, int | None]:
    """Ranks ``_s0`` of the first key of the whole order, ``(_k0, n)`` of its heavy values, and rows per slice."""
    most = slices or SLICES_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("_x0", _position(rows, key))
    total, q = placed.select("_x0").agg(
        F.count("*"), F.percentile_approx("_x0", F.array(*[F.lit(k / most) for k in range(1, max(2, most))]), F.lit(max(10_000, 4 * most)))
    ).first()
    count = min(most, slices or -(-total // PER_SLICE), total)
    if count < 2:
        return rows, None, None
    chosen = [q[-(-k * most // count) - 1] for k in range(1, count)]
    heavy = {v: chosen.count(v) for v in {b for a, b in zip(chosen, chosen[1:]) if a == b}}
    borders = sorted({*chosen, *(v + 1 for v in heavy)})
    limit = -(-total // count)
    ranked = placed.withColumn("_b", F.array(*map(F.lit, borders)).cast("array<bigint>")).withColumn("_s0", F.expr(_rank("_b", "_x0"))).drop("_b")
    crowded = rows.sparkSession.createDataFrame([(v, limit * (n + 1)) for v, n in sorted(heavy.items())], "_k0 long, n long")
    return ranked, crowded if heavy else None, limit


def _pair_records(
    rows: DataFrame, offsets: Sequence[int], within: Sequence[str], order: Sequence[str], slices: int | None, keep_group: bool
) -> tuple[DataFrame, bool, bool]:
    """Counted pairs inside the slices, and the rows near slice borders, in one table.

    Pairs have no ``slice``; border rows have one and their activity in ``src``.  The other
    values tell whether there are several slices, and whether slices are numbered by group.
    """
    reach = max(abs(o) for o in offsets)
    keys = [*within, *order]
    cut = _sliced(rows.select(*dict.fromkeys([*keys, "activity"])), order, within, slices)
    by_group = bool(within) and len(cut.partition) > 1
    ordered = W.partitionBy(*cut.partition).orderBy(*cut.order)
    group = F.struct(*within) if within else F.lit(0)
    told_apart = within and not by_group
    whole = by_group and not cut.cut  # groups are not cut, so there are no borders

    def near(column: Column, offset: int) -> Column:
        return F.lead(column, offset).over(ordered) if offset > 0 else F.lag(column, -offset).over(ordered)

    if whole:
        kept = [group.alias("grp")] if keep_group else []
        seen = cut.rows.select(*kept, F.col("activity").alias("src"), F.array_compact(F.array(*[near(F.col("activity"), o) for o in offsets])).alias("near"))
        pairs = seen.select(*seen.columns[:-1], F.explode("near").alias("dst"))
        counted = materialize(pairs.groupBy(*pairs.columns).agg(F.count("*").alias("cnt")), "pairs")
        return counted.withColumn("slice", F.lit(None).cast("array<int>")), False, by_group

    numbered = cut.rows.select(
        "slice",
        "activity",
        group.alias("grp"),
        F.row_number().over(ordered).alias("rn"),
        F.lead(F.lit(1), reach).over(ordered).isNull().alias("near_end"),
        *[near(F.col("activity"), o).alias(f"near{k}") for k, o in enumerate(offsets)],
        *([near(group, o).alias(f"grp{k}") for k, o in enumerate(offsets)] if told_apart else []),
    )
    kept = F.col("grp") if keep_group else F.lit(None).cast(numbered.schema["grp"].dataType)

    def pair(k: int) -> Column:
        same = F.col("grp") == F.col(f"grp{k}") if told_apart else F.lit(True)
        record = F.struct(
            kept.alias("grp"),
            F.col("activity").alias("src"),
            F.col(f"near{k}").alias("dst"),
            F.lit(None).cast("array<int>").alias("slice"),
            F.lit(None).cast("int").alias("rn"),
        )
        return F.when(F.col(f"near{k}").isNotNull() & same, record)

    border = F.when(
        F.col("slice").isNotNull() & ((F.col("rn") <= reach) | F.col("near_end")),
        F.struct("grp", F.col("activity").alias("src"), F.lit(None).cast("string").alias("dst"), "slice", "rn"),
    )
    records = numbered.select(
        F.inline(F.array_compact(F.array(*[pair(k) for k in range(len(offsets))], border)))
    )
    counted, measured = materialize_measured(
        records.groupBy("grp", "src", "dst", "slice", "rn").agg(F.count("*").alias("cnt")),
        "pairs",
        first=F.min("slice"),
        last=F.max("slice"),
    )
    return counted, cut.cut and (by_group or measured["first"] != measured["last"]), by_group


def _stitched(counted: DataFrame, offsets: Sequence[int], within: Sequence[str], keep_group: bool, by_group: bool) -> DataFrame:
    """Pairs inside slices plus the pairs across slice borders.

    The border rows of all slices are a few rows per slice and lie in order: between two
    slices no row is missing, and neighbours of the same slice are already counted.  Their
    number depends on the number of slices only, so one task is enough for them.
    """
    edge = counted.where(F.col("slice").isNotNull())
    ordered = (W.partitionBy("grp") if by_group else W).orderBy("slice", "rn")
    kept = F.col("grp") if keep_group else F.lit(None).cast(counted.schema["grp"].dataType)

    def near(name: str, offset: int) -> Column:
        return F.lead(name, offset).over(ordered) if offset > 0 else F.lag(name, -offset).over(ordered)

    others = F.array(
        *[F.struct(near("slice", o).alias("slice"), near("grp", o).alias("grp"), near("src", o).alias("dst")) for o in offsets]
    )
    across = (
        edge.select("slice", "grp", "src", others.alias("others"))
        .select("slice", "grp", "src", F.explode("others").alias("other"))
        .where((F.col("slice") != F.col("other.slice")) & F.col("grp").eqNullSafe(F.col("other.grp")))
        .where(F.col("other.dst").isNotNull())
    )
    across = across.select(kept.alias("grp"), "src", F.col("other.dst").alias("dst"), F.lit(1).cast("long").alias("cnt"))
    inside = counted.where(F.col("slice").isNull()).select("grp", "src", "dst", "cnt")
    return inside.union(across).groupBy("grp", "src", "dst").agg(F.sum("cnt").alias("cnt"))


def pair_graph(
    rows: DataFrame,
    offsets: Sequence[int] = (1,),
    within: Sequence[str] = (),
    order: Sequence[str] = TIME_ORDER,
    slices: int | None = None,
    keep_group: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The activities of the log and the counted pairs, from one exchange of the log.

    Pairs are the rows ``i`` and ``i + offset`` of the ordered log.  With ``within`` both
    rows must agree on those columns: these lead the sort key, so a group is a run of
    neighbours and may span slices; activities that no pair has may then be missing.  Pairs are ``src, dst, cnt``, led by the ``within``
    columns if ``keep_group``.
    """
    counted, several, by_group = _pair_records(rows, offsets, within, order, slices, keep_group)
    if several:
        total = materialize(_stitched(counted, offsets, within, keep_group, by_group), "pairs-stitched")
    else:
        total = counted.where(F.col("slice").isNull())
    lead = [F.col(f"grp.{c}").alias(c) for c in within] if keep_group else []
    ends = counted.select(F.col("src").alias("activity")).union(counted.select("dst"))
    nodes = ends.where(F.col("activity").isNotNull()).distinct()
    return nodes, total.select(*lead, "src", "dst", "cnt")


def pair_counts(rows: DataFrame, *args, **kwargs) -> DataFrame:
    """The pairs of ``pair_graph``."""
    return pair_graph(rows, *args, **kwargs)[1]


def running_total(
    rows: DataFrame,
    order: Sequence[str],
    amount: Column | None = None,
    within: Sequence[str] = (),
    name: str = "total",
    slices: int | None = None,
) -> DataFrame:
    """Add the inclusive running sum of ``amount`` in the given total order.

    Without ``amount`` this is the row number, from 1.  With ``within`` the sum restarts
    in every group, also where a group spans slices.
    """
    amount = F.lit(1) if amount is None else amount
    cut = _sliced(rows.withColumn("_amount", amount.cast("long")), order, within, slices)
    upto = W.partitionBy(*cut.partition).orderBy(*cut.order).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = cut.rows.withColumn(name, F.sum("_amount").over(upto))
    if not cut.cut:
        return placed.select(*rows.columns, name)
    if cut.partition != ["slice"] or _position(rows, order[0]) is not None:
        # Slices are the same in every pass, so their sums need not wait for the rows in order.
        sizes = cut.rows.where("slice IS NOT NULL").groupBy(*cut.partition).agg(F.sum("_amount").alias("_size"))
        earlier = W.partitionBy(*within).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
        starts = sizes.select(
            *[F.col(c).alias(f"_k{i}") for i, c in enumerate(cut.partition)], F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start")
        )
        joined = _meet(placed, starts, cut.partition, "left")
        return joined.select(*rows.columns, (F.col(name) + F.coalesce("_start", F.lit(0))).alias(name))
    placed, measured = materialize_measured(placed, "running", first=F.min("slice"), last=F.max("slice"))
    if measured["first"] != measured["last"]:
        # One row per slice, so one task is enough for their running sum.
        earlier = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
        sizes = placed.groupBy("slice").agg(F.sum("_amount").alias("size"))
        starts = sizes.select("slice", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("_start"))
        placed = placed.join(starts, "slice").withColumn(name, F.col(name) + F.col("_start"))
    if within:
        base = placed.groupBy(*within).agg(F.min(F.col(name) - F.col("_amount")).alias("_base"))
        placed = placed.join(base, list(within)).withColumn(name, F.col(name) - F.col("_base"))
    return placed.select(*rows.columns, name)
