import random
from collections import defaultdict

import pytest
from pyspark.sql import DataFrameWriter

from trailweave.operators import components as comp
from trailweave.operators import spread
from trailweave.operators.dfg import with_totals


def closure(names, edges, undirected):
    reach = {n: {n} for n in names}
    nxt = defaultdict(set)
    for s, d in edges:
        nxt[s].add(d)
        if undirected:
            nxt[d].add(s)
    for n in names:
        todo = [n]
        while todo:
            for m in nxt[todo.pop()]:
                if m not in reach[n]:
                    reach[n].add(m)
                    todo.append(m)
    return reach


def random_graph(seed, n=26, m=34, top=9):
    rng = random.Random(seed)
    names = [chr(97 + i) for i in range(n)]
    edges = {}
    for _ in range(m):
        edges[rng.choice(names), rng.choice(names)] = rng.randrange(1, top)
    return names, [(s, d, c) for (s, d), c in sorted(edges.items())]


def test_components_with_chain_and_isolated_vertex(make_graph, as_rows):
    names = [f"v{i:02d}" for i in range(20)] + ["z"]
    # A chain with its smallest member in the middle.
    order = names[10:20] + names[0:10]
    nodes, edges = make_graph(names, [(a, b, 1) for a, b in zip(order, order[1:])])
    assert as_rows(comp.components(nodes, edges)) == sorted([(n, "v00") for n in names[:20]] + [("z", "z")])


@pytest.mark.parametrize("keyed", [False, True])
def test_labels_by_numbers_are_the_same(spark, as_rows, keyed):
    """Names in no order of their links, blanks and other scripts among them; and more links later."""
    rng = random.Random(12)
    names = [f"{rng.choice('zab é日')}{i}" for i in rng.sample(range(200), 120)]
    links = [(rng.randrange(3), rng.choice(names), rng.choice(names)) for _ in range(90)]
    df = spark.createDataFrame(links, "tid int, a string, b string")
    keys = ["tid"] if keyed else []
    plain = as_rows(comp.linked_labels(df, keys, dense=False))
    assert plain and as_rows(comp.linked_labels(df, keys, dense=True)) == plain
    first, later = df.where("pmod(hash(a, b), 2) = 0"), df.where("pmod(hash(a, b), 2) = 1")
    grown = comp.more_labels(comp.more_labels(None, first.select(*keys, "a", "b"), keys), later.select(*keys, "a", "b"), keys)
    assert as_rows(grown.select(*keys, "v", "label")) == plain


def test_components_keyed(spark, as_rows):
    nodes = spark.createDataFrame([(t, n) for t in (1, 2) for n in "abcd"], "tid int, activity string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "c", "b"), (2, "d", "c")], "tid int, src string, dst string")
    got = as_rows(comp.components(nodes, edges, ["tid"]))
    assert got == [(1, "a", "a"), (1, "b", "a"), (1, "c", "a"), (1, "d", "d"), (2, "a", "a"), (2, "b", "b"), (2, "c", "c"), (2, "d", "c")]


def test_min_label_stops_at_the_given_distance(make_graph, as_rows):
    names = [chr(97 + i) for i in range(13)]
    nodes, edges = make_graph(names, [(a, b, 1) for a, b in zip(names, names[1:])])
    got = dict(as_rows(spread.min_label(nodes, edges)))
    assert got == {n: names[max(0, i - 10)] for i, n in enumerate(names)}
    far = dict(as_rows(spread.min_label(nodes, edges, rounds=None)))
    assert set(far.values()) == {"a"}


def test_min_label_is_directed(make_graph, as_rows):
    nodes, edges = make_graph("abc", [("b", "a", 1), ("b", "c", 1)])
    assert as_rows(spread.min_label(nodes, edges)) == [("a", "a"), ("b", "b"), ("c", "b")]


def test_hot_source_is_salted_with_the_same_result(make_graph, as_rows):
    names = ["a"] + [f"n{i:02d}" for i in range(40)]
    edges = [("a", n, 1) for n in names[1:]] + [(names[5], "zz", 1)]
    nodes, df = make_graph(names + ["zz"], edges)
    own = nodes.selectExpr("activity AS src", "activity AS dst")
    salted = spread.Spread(df.select("src", "dst").union(own), per_key=8)
    assert salted.hot.count() == 1
    state = spread.start_labels(nodes)
    plain = spread.Spread(df.select("src", "dst").union(own))
    assert plain.hot is None
    pick = lambda s: as_rows(s.along(state).select("src", "dst", "label"))
    assert pick(salted) == pick(plain)


def brute_votes(names, edges, rounds, weighted=False):
    label = {n: n for n in names}
    for _ in range(rounds):
        tally = {n: defaultdict(int) for n in names}
        for s, d, c in edges:
            tally[d][label[s]] += c if weighted else 1
            tally[s][label[d]] += c if weighted else 1
        label = {n: min(t, key=lambda k: (-t[k], k)) if t else label[n] for n, t in tally.items()}
    return sorted(label.items())


@pytest.mark.parametrize("seed,weighted", [(1, False), (2, True)])
def test_majority_label(make_graph, as_rows, seed, weighted):
    names, edges = random_graph(seed)
    nodes, df = make_graph(names + ["zz"], edges)
    got = as_rows(spread.majority_label(nodes, df, 5, votes="cnt" if weighted else None))
    assert got == brute_votes(names + ["zz"], edges, 5, weighted)


def test_flow_keeps_vertices_without_inflow(make_graph, as_rows):
    nodes, edges = make_graph("abc", [("a", "b", 1), ("a", "c", 3), ("b", "c", 2), ("c", "c", 1)])
    score = {"a": 1.0, "b": 1.0, "c": 1.0}
    p = {("a", "b"): 0.25, ("a", "c"): 0.75, ("b", "c"): 1.0, ("c", "c"): 1.0}
    for _ in range(15):
        score = {
            v: score[v] if v == "a" else 0.85 * sum(score[s] * w for (s, d), w in p.items() if d == v) + 0.15 * score[v]
            for v in score
        }
    got = dict(as_rows(spread.flow_score(nodes, with_totals(edges))))
    assert got == pytest.approx(score)
    groups = as_rows(spread.flow_groups(spread.flow_score(nodes, with_totals(edges))))
    assert groups == sorted((int(s * 1000 + 0.5), v) for v, s in score.items())


@pytest.mark.parametrize("seed", [4, 5])
def test_strong_components(make_graph, as_rows, seed):
    names, edges = random_graph(seed, n=18, m=30)
    nodes, df = make_graph(names, edges)
    reach = closure(names, [(s, d) for s, d, _ in edges], undirected=False)
    want = sorted((n, min(m for m in names if m in reach[n] and n in reach[m])) for n in names)
    assert as_rows(comp.strong_components(nodes, df)) == want


@pytest.fixture
def write_outs(monkeypatch):
    """Number of tables written so far."""
    seen = []
    original = DataFrameWriter.parquet

    def spy(self, path, *args, **kwargs):
        seen.append(path)
        return original(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    return seen


@pytest.mark.parametrize("closed", [False, True])
def test_strong_components_of_a_long_path_and_cycle(spark, write_outs, closed):
    n = 10_000
    edges = spark.range(n if closed else n - 1).selectExpr(
        "format_string('v%05d', id * 7919 % 10000) AS src", "format_string('v%05d', (id + 1) * 7919 % 10000) AS dst"
    )
    nodes = spark.range(n).selectExpr("format_string('v%05d', id) AS activity")
    labels = comp.strong_components(nodes, edges)
    assert labels.count() == n and labels.select("label").distinct().count() == (1 if closed else n)
    assert len(write_outs) < 60


def test_strong_components_of_cycles_chains_and_bridges(make_graph, as_rows):
    cycles = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "d"), ("g", "h"), ("h", "g"), ("h", "i"), ("i", "g")]
    bridges = [("c", "d"), ("e", "f"), ("f", "g"), ("s", "a"), ("s", "t"), ("t", "d"), ("i", "x"), ("x", "y"), ("x", "z"), ("q", "q")]
    nodes, edges = make_graph("abcdefghistxyzqw", [(s, d, 1) for s, d in cycles + bridges])
    want = dict.fromkeys("abc", "a") | dict.fromkeys("de", "d") | dict.fromkeys("ghi", "g") | {v: v for v in "fstxyzqw"}
    assert as_rows(comp.strong_components(nodes, edges)) == sorted(want.items())


@pytest.mark.parametrize("seed", [7, 8])
def test_forest_is_that_of_kruskal_and_counts_components(make_graph, as_rows, seed):
    names, edges = random_graph(seed, n=24, m=60, top=5)
    nodes, df = make_graph(names, edges)
    pairs = defaultdict(int)
    for s, d, c in edges:
        if s != d:
            key = min(s, d), max(s, d)
            pairs[key] = max(pairs[key], c)
    label = {n: n for n in names}
    tree = []
    for (a, b), c in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if label[a] != label[b]:
            old = label[b]
            label = {n: label[a] if v == old else v for n, v in label.items()}
            tree.append((a, b, c))
    forest = comp.max_spanning_forest(nodes, df)
    assert as_rows(forest) == sorted(tree)
    counts = dict(as_rows(comp.component_counts(nodes, forest, top=6)))
    for t in range(7):
        kept = closure(names, [k for k, c in pairs.items() if c >= t], undirected=True)
        assert counts[t] == len({min(r) for r in kept.values()})


def test_forest_of_a_star_takes_few_rounds(make_graph, as_rows):
    names = ["hub"] + [f"l{i:02d}" for i in range(30)]
    nodes, df = make_graph(names, [("hub", n, i + 1) for i, n in enumerate(names[1:])])
    assert comp.max_spanning_forest(nodes, df).count() == 30


def test_strong_components_run_on_numbers(spark, make_graph, monkeypatch):
    """Minima of structs with names were aggregated by sorting in every round."""
    names = [f"v{i}" for i in range(30)]
    cycles = [(f"v{i}", f"v{i - i % 5 + (i + 1) % 5}", 1) for i in range(30)]
    nodes, edges = make_graph(names, cycles + [(f"v{5 * i}", f"v{5 * i + 5}", 1) for i in range(5)])
    seen = []

    def watched(state, *args, **kwargs):
        seen.append(dict(state.dtypes))
        return run_rounds(state, *args, **kwargs)

    run_rounds = comp.run_rounds
    monkeypatch.setattr(comp, "run_rounds", watched)
    got = {r.v: r.label for r in comp.strong_components(nodes, edges).collect()}
    assert got == {f"v{i}": min(f"v{k}" for k in range(i - i % 5, i - i % 5 + 5)) for i in range(30)}
    assert seen and all(kind == "bigint" for types in seen for name, kind in types.items() if name in ("v", "at", "label"))
