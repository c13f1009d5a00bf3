"""Connected components, strongly connected components and spanning forests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.operators.sequence import running_total
from trailweave.operators.spread import Spread, run_rounds, start_labels
from trailweave.workspace import materialize, materialize_measured


# Links from which on names are replaced by numbers in the order of the names.
DENSE_LINKS = 1 << 20


def linked_labels(links: DataFrame, keys: Sequence[str] = (), dense: bool | None = None) -> DataFrame:
    """Smallest member of each component of the links ``(a, b)``: ``(v, label)`` for all
    vertices but the smallest ones themselves.

    With ``dense``, by default for many links between names, the loop runs on numbers, so that
    minima are aggregated by hash and rows are small; see ``_by_numbers``.

    The graph is contracted: every vertex hooks to its smallest neighbour below it, the
    hooks form trees whose pointers are doubled until they show the roots, and the links
    are redrawn between roots.  Only local minima outlive a contraction, so at least half
    of the linked vertices go each time, whatever the order of their names.
    """
    keys = list(keys)

    def between(one: DataFrame) -> DataFrame:
        ends = one.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return ends.where("a <> b").distinct()

    live, seen = materialize_measured(between(links), "links", n=F.count("*"))
    if dense is None:
        dense = seen["n"] >= DENSE_LINKS and dict(live.dtypes)["a"] == "string"
    if dense and seen["n"]:
        return _by_numbers(live, keys)
    labels = None
    while seen["n"]:
        hooks = _roots(live.groupBy(*keys, "b").agg(F.min("a").alias("label")).withColumnRenamed("b", "v"), keys)
        if labels is None:
            labels = hooks
        else:
            labels = materialize(_follow(labels, hooks, "label", keys).unionByName(hooks), "labels")
        live, seen = materialize_measured(
            between(_follow(_follow(live, hooks, "a", keys), hooks, "b", keys)), "links", n=F.count("*")
        )
    return labels if labels is not None else live.selectExpr(*keys, "b AS v", "a AS label")


def _by_numbers(links: DataFrame, keys: list[str]) -> DataFrame:
    """``linked_labels`` through a dictionary of the names, numbered in their order.

    Names are numbered by range slices, so the smallest number is that of the smallest name,
    and labels are the same.
    """
    names = links.select(F.col("a").alias("name")).union(links.select("b")).distinct()
    numbers = materialize(running_total(names, ["name"], name="number"), "numbers")

    def replaced(table: DataFrame, column: str, known: str, wanted: str) -> DataFrame:
        to = numbers.select(F.col(known).alias(column), F.col(wanted).alias("_to"))
        rest = [c for c in table.columns if c != column]
        return table.join(to, column).select(*rest, F.col("_to").alias(column))

    coded = replaced(replaced(links, "a", "name", "number"), "b", "name", "number")
    labels = linked_labels(coded, keys, dense=False)
    return replaced(replaced(labels, "v", "number", "name"), "label", "number", "name").select(*keys, "v", "label")


def more_labels(labels: DataFrame | None, links: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``linked_labels`` of all links so far, from those of the earlier ones and the new ``links``.

    New links are drawn between the components known already, so what was contracted
    before is not looked at again.
    """
    if labels is None:
        return linked_labels(links, keys)
    keys = list(keys)
    more = linked_labels(_follow(_follow(links, labels, "a", keys), labels, "b", keys), keys)
    return materialize(_follow(labels, more, "label", keys).unionByName(more), "labels")


def _follow(table: DataFrame, hooks: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Replace ``column`` by the label its value has in ``hooks``, if any."""
    jump = hooks.select(*keys, F.col("v").alias(column), F.col("label").alias("_jump"))
    rest = [F.col(c) for c in table.columns if c not in (column, *keys)]
    return table.join(jump, [*keys, column], "left").select(
        *keys, *rest, F.coalesce("_jump", column).alias(column)
    )


def _roots(hooks: DataFrame, keys: list[str]) -> DataFrame:
    """Double the pointers of a forest ``(v, label)`` until every label is a root."""

    def step(state: DataFrame) -> DataFrame:
        target = state.select(*keys, F.col("v").alias("label"), F.col("label").alias("next"))
        return state.join(target, [*keys, "label"], "left").select(
            *keys, "v", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("changed")
        )

    return run_rounds(materialize(hooks, "hooks"), step, None, "hooks", per_write=2)


def components(vertices: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Undirected components, named by their smallest member; isolated vertices are kept."""
    keys = list(keys)
    labels = linked_labels(edges.select(*keys, F.col("src").alias("a"), F.col("dst").alias("b")), keys)
    return vertices.select(*keys, F.col("activity").alias("v")).join(labels, [*keys, "v"], "left").select(
        *keys, "v", F.coalesce("label", "v").alias("label")
    )


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Strongly connected components, named by their smallest member: ``(v, label)``.

    Until no edge is left: chains that come from a vertex without predecessors, or lead to
    one without successors, are alone and go; the others learn, in the same rounds, the first
    vertex, in the order of a hash, that reaches them and the first that they reach.
    Where both are the same it names a component, so every part of the graph gives one at
    least; edges between vertices that differ in either are in no cycle and go.
    Rounds run on numbers in the order of the hash, so that minima are aggregated by hash.
    """
    found = []
    named_links = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "scc-names")
    numbers = materialize(_hash_numbers(named_links), "scc-numbers")
    links = named_links.join(numbers.selectExpr("name AS src", "number AS a"), "src").join(
        numbers.selectExpr("name AS dst", "number AS b"), "dst"
    ).selectExpr("a AS src", "b AS dst")
    while True:
        links, measured = materialize_measured(links, "scc-links", n=F.count("*"))
        if not measured["n"]:
            break
        inner = materialize(_among(links, _beyond_chains(links, measured["n"])), "scc-inner")
        colours = _first_reached(inner)
        named = colours.where("after = before").select("v", F.col("after").alias("root"))
        found.append(named)
        left = colours.where("after <> before")
        one = left.select(F.col("v").alias("src"), F.col("after").alias("a1"), F.col("before").alias("b1"))
        two = left.select(F.col("v").alias("dst"), F.col("after").alias("a2"), F.col("before").alias("b2"))
        links = inner.join(one, "src").join(two, "dst").where("a1 = a2 AND b1 = b2").select("src", "dst")
    if not found:
        return start_labels(vertices)
    roots = reduce(DataFrame.union, found).withColumnRenamed("v", "number").join(numbers, "number").selectExpr("name AS v", "root")
    labels = roots.join(roots.groupBy("root").agg(F.min("v").alias("label")), "root").select("v", "label")
    return vertices.select(F.col("activity").alias("v")).join(labels, "v", "left").select("v", F.coalesce("label", "v").alias("label"))


def _hash_numbers(links: DataFrame) -> DataFrame:
    """``(name, number)``: a number of each end of the links, in the order of a hash of its name inside a partition."""
    names = links.select(F.col("src").alias("name")).union(links.select("dst")).distinct()
    return names.sortWithinPartitions(F.xxhash64("name"), "name").withColumn("number", F.monotonically_increasing_id())


def _both_ways(links: DataFrame) -> DataFrame:
    """Edges as ``(way, src, dst)``, forwards (0) and backwards (1)."""
    return links.select(F.lit(0).alias("way"), "src", "dst").union(links.select(F.lit(1), "dst", "src"))


def _beyond_chains(links: DataFrame, n: int) -> DataFrame:
    """Vertices that are on no chain from a vertex without predecessors or to one without successors.

    A vertex with one predecessor points to it.  The pointers are doubled; a chain that ends
    at a vertex without predecessors leads to nothing.  On cycles they never end, but no
    chain is longer than the number of edges.
    """
    ends = _both_ways(links).groupBy("way", F.col("dst").alias("v")).agg(F.count("*").alias("n"), F.min("src").alias("one"))
    # What a pointer shows is missing where there is nothing before it.
    chains = ends.select("way", "v", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("v")).alias("at"))

    def step(state: DataFrame) -> DataFrame:
        target = state.selectExpr("way", "v AS at", "at AS next")
        return state.join(target, ["way", "at"], "left").selectExpr("way", "v", "next AS at", "NOT (at <=> next) AS changed")

    state = run_rounds(materialize(chains, "scc-chains"), step, n.bit_length(), "scc-chains")
    return state.groupBy("v").agg(F.count("at").alias("ways")).where("ways = 2").select(F.col("v").alias("activity"))


def _first_reached(links: DataFrame) -> DataFrame:
    """``(v, after, before)``: the first vertex by number that reaches ``v``, and that ``v`` reaches.

    A round takes the first among the neighbours, and then what that one knew itself, so
    that knowledge doubles its reach along paths.
    """
    ends = links.select(F.col("src").alias("v")).union(links.select("dst")).distinct()
    ways = materialize(ends.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), "v"), "scc-ways")
    spread = Spread(_both_ways(links).union(ways.selectExpr("way", "v", "v")), ["way"])

    def step(state: DataFrame) -> DataFrame:
        met = spread.along(state).groupBy("way", "dst").agg(
            F.expr("min(label) AS label"), F.expr("max(if(src = dst, label, null)) AS was")
        )
        known = state.selectExpr("way", "v AS label", "label AS further")
        seen = met.join(known, ["way", "label"], "left")
        return seen.selectExpr("way", "dst AS v", "least(label, further) AS label", "least(label, further) <> was AS changed")

    state = ways.selectExpr("way", "v", "v AS label")
    done = run_rounds(state, step, None, "scc-labels", per_write=2)
    return done.groupBy("v").agg(
        F.max(F.expr("if(way = 0, label, null)")).alias("after"), F.max(F.expr("if(way = 1, label, null)")).alias("before")
    )


def _among(links: DataFrame, vertices: DataFrame) -> DataFrame:
    return links.join(vertices.select(F.col("activity").alias("src")), "src", "left_semi").join(
        vertices.select(F.col("activity").alias("dst")), "dst", "left_semi"
    ).select("src", "dst")


def max_spanning_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Maximum spanning forest ``(a, b, cnt)`` over undirected pairs ``a < b``.

    The weight of a pair is its larger directed count; equal weights are ordered by
    ``(a, b)``.  Every component picks its best outgoing pair per round, so there are at
    most log2(vertices) rounds; pairs inside a component leave the job.
    """
    pairs = (
        edges.where(F.col("src") != F.col("dst"))
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.max("cnt").alias("cnt"))
    )
    live, measured = materialize_measured(
        pairs.select("a", "b", "cnt", F.col("a").alias("ca"), F.col("b").alias("cb")), "forest-live", n=F.count("*")
    )
    picked = []
    while measured["n"]:
        order = F.struct((-F.col("cnt")).alias("ord"), "a", "b")
        best = F.min(F.struct(order.alias("pair"), "other"))
        sides = live.select(F.col("ca").alias("v"), F.col("cb").alias("other"), "cnt", "a", "b").union(
            live.select("cb", "ca", "cnt", "a", "b")
        )
        pick = materialize(sides.groupBy("v").agg(best.alias("best")).select("v", "best.pair", "best.other"), "forest-pick")
        picked.append(pick.select("pair.a", "pair.b", (-F.col("pair.ord")).alias("cnt")).distinct())
        # Pointers to the other side of the best pair end in two components that picked
        # the same pair; the smaller of the two is the root.
        back = pick.select(F.col("v").alias("other"), F.col("other").alias("back"))
        root = (F.col("back") == F.col("v")) & (F.col("v") < F.col("other"))
        parents = pick.join(back, "other").select("v", F.when(root, F.col("v")).otherwise(F.col("other")).alias("label"))
        roots = run_rounds(parents, _jump, None, "forest-roots", per_write=3)
        to_a = roots.select(F.col("v").alias("ca"), F.col("label").alias("na"))
        to_b = roots.select(F.col("v").alias("cb"), F.col("label").alias("nb"))
        moved = live.join(to_a, "ca").join(to_b, "cb").where(F.col("na") != F.col("nb"))
        # Between two components only the best pair can ever be chosen.
        live, measured = materialize_measured(
            moved.groupBy(F.least("na", "nb").alias("ca"), F.greatest("na", "nb").alias("cb"))
            .agg(F.min(order).alias("pair"))
            .select("pair.a", "pair.b", (-F.col("pair.ord")).alias("cnt"), "ca", "cb"),
            "forest-live",
            n=F.count("*"),
        )
    return reduce(DataFrame.union, picked) if picked else live.select("a", "b", "cnt")


def _jump(state: DataFrame) -> DataFrame:
    """Replace every pointer by the pointer of its target."""
    target = state.selectExpr("v AS label", "label AS next")
    return state.join(target, "label").selectExpr("v", "next AS label", "next <> label AS changed")


def component_counts(vertices: DataFrame, forest: DataFrame, top: int = 100) -> DataFrame:
    """Number of components at every minimum count ``0..top``: ``(threshold, components)``.

    Components at threshold t = vertices - forest edges of weight >= t, so one forest
    answers all thresholds.
    """
    by_weight = forest.groupBy(F.least(F.col("cnt"), F.lit(top)).cast("int").alias("weight")).agg(
        F.count("*").alias("n")
    )
    reached = by_weight.withColumn("threshold", F.explode(F.sequence(F.lit(0), F.col("weight"))))
    merges = reached.groupBy("threshold").agg(F.sum("n").alias("n"))
    size = vertices.agg(F.count("*").alias("size"))
    rows = size.withColumn("threshold", F.explode(F.sequence(F.lit(0), F.lit(top))))
    return rows.join(merges, "threshold", "left").select(
        "threshold", (F.col("size") - F.coalesce("n", F.lit(0))).alias("components")
    )
