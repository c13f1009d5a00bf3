import hashlib
import math
from collections import Counter, defaultdict

import pytest

from trailweave.operators import evaluate
from trailweave.workspace import TableSeries


@pytest.fixture(scope="module")
def log(make_log):
    # Known clusters p: a b c, q: c d (then c again), r: a b (an edge p has as well).
    return make_log(
        [
            (1, "u", 0, "a", "p"), (2, "u", 1, "b", "p"), (3, "u", 2, "a", "p"), (4, "u", 3, "c", "p"),
            (5, "u", 4, "c", "q"), (6, "u", 5, "d", "q"), (7, "u", 6, "c", "q"), (8, "u", 7, "a", "r"), (9, "u", 8, "b", "r"),
        ]
    )


@pytest.fixture(scope="module")
def predicted(spark):
    rows = [
        ("m", "b", "a", "1", 1), ("m", "c", "d", "2", 2), ("m", "d", "e", "2", 3),
        ("n", "a", "b", "1", 1), ("n", "a", "b", "2", 2), ("n", "b", "c", "2", 3),
    ]
    return spark.createDataFrame(rows, "name string, src string, dst string, cluster_id string, seq int")


def test_truth_and_chain_edges(log, as_rows):
    truth = as_rows(evaluate.truth_edges(log).select("cluster_id", "src", "dst"))
    assert truth == [("p", "a", "b"), ("p", "b", "c"), ("q", "c", "d"), ("r", "a", "b")]
    assert as_rows(evaluate.chain_edges(log)) == [("a", "b"), ("b", "c"), ("c", "d")]


def test_commonality_counts_every_match(log, predicted, as_rows):
    truth = evaluate.truth_edges(log)
    # m: b->a meets a->b of p and r, c->d meets q; n: a->b twice meets both, b->c meets p.
    names = ["m", "n", "none"]
    assert as_rows(evaluate.commonality(truth, predicted, names)) == [("m", 3, 4, 0.75), ("n", 5, 4, 1.25), ("none", 0, 4, 0.0)]
    assert as_rows(evaluate.commonality(truth, predicted, names, directed=True)) == [("m", 1, 4, 0.25), ("n", 5, 4, 1.25), ("none", 0, 4, 0.0)]


def test_chain_accuracy(log, predicted, as_rows):
    got = as_rows(evaluate.chain_accuracy(evaluate.truth_edges(log), predicted, evaluate.chain_edges(log), ["m", "none"]))
    assert got == [("m", 2, 1, 0, 0, pytest.approx(2 / 3), pytest.approx(2 / 3)), ("none", 0, 3, 0, 0, 0.0, 0.0)]


def test_contingency_takes_the_last_label(log, predicted, as_rows):
    got = as_rows(evaluate.label_contingency(evaluate.truth_edges(log), predicted, ["m", "n", "none"]))
    # a->b is known last from r; n has a->b last from cluster 2.
    assert got == sorted([
        ("m", "-1", "1", 1), ("m", "q", "2", 1), ("m", "-1", "2", 1), ("m", "r", "-1", 1), ("m", "p", "-1", 1),
        ("n", "r", "2", 1), ("n", "p", "2", 1), ("n", "q", "-1", 1),
        ("none", "r", "-1", 1), ("none", "p", "-1", 1), ("none", "q", "-1", 1),
    ])


def test_mapping_is_greedy_and_fills_up(spark, as_rows):
    rows = [
        ("m", "p", "1", 5), ("m", "q", "1", 4), ("m", "p", "2", 4), ("m", "q", "2", 1),
        ("m", "-1", "3", 2), ("m", "r", "-1", 2), ("m", "s", "-1", 1),
    ]
    df = spark.createDataFrame(rows, "name string, truth string, predicted string, n long")
    assert as_rows(evaluate.label_mapping(df)) == [("m", "1", "p"), ("m", "2", "q"), ("m", "3", "r")]


def test_mapping_of_equal_overlaps_takes_few_rounds(spark, monkeypatch):
    """1,000 labels in a row, all of the same overlap: the outcome of the queue, in few rounds."""
    seen = []
    original = TableSeries.add
    monkeypatch.setattr(TableSeries, "add", lambda self, df, **m: (seen.append(1), original(self, df, **m))[1])
    rows = [("m", f"t{i + k:04d}", f"p{i:04d}", 3) for i in range(1000) for k in (0, 1)]
    df = spark.createDataFrame(rows, "name string, truth string, predicted string, n long")
    got = {(r.predicted, r.truth) for r in evaluate.label_mapping(df).collect()}
    queue = sorted((int(hashlib.md5(f"{p}/{t}".encode()).hexdigest()[:13], 16), p, t) for _, t, p, _ in rows)
    want, taken = set(), set()
    for _, p, t in queue:
        if not {p, t} & taken:
            want.add((p, t))
            taken |= {p, t}
    assert want <= got and len(got) == 1000 and 1 < len(seen) < 30


def metrics(pairs):
    n = len(pairs)
    t, p, tp = Counter(a for a, _ in pairs), Counter(b for _, b in pairs), Counter(pairs)
    h = lambda c: -sum(v / n * math.log(v / n) for v in c.values())
    mi = sum(v / n * math.log(v * n / (t[a] * p[b])) for (a, b), v in tp.items())
    nmi = mi / ((h(t) + h(p)) / 2)
    c2 = lambda c: sum(v * (v - 1) / 2 for v in c.values())
    chance = c2(t) * c2(p) / (n * (n - 1) / 2)
    ari = (c2(tp) - chance) / ((c2(t) + c2(p)) / 2 - chance)
    f1 = sum(t[a] / n * 2 * tp[a, a] / (t[a] + p[a]) for a in t)
    return nmi, ari, f1


def test_metrics_against_their_definitions(spark):
    tables = {
        "x": [("p", "p")] * 5 + [("p", "q")] * 2 + [("q", "q")] * 4 + [("-1", "q")] * 3 + [("r", "-1")] * 2,
        "y": [("p", "p")] * 3 + [("q", "p")] + [("q", "q")] * 2,
    }
    rows = [(name, t, p, n) for name, pairs in tables.items() for (t, p), n in Counter(pairs).items()]
    df = spark.createDataFrame(rows, "name string, truth string, predicted string, n long")
    got = defaultdict(list)
    for part in (evaluate.nmi(df), evaluate.ari(df), evaluate.weighted_f1(df)):
        for name, value in part.collect():
            got[name].append(value)
    for name, pairs in tables.items():
        assert got[name] == pytest.approx(metrics(pairs))


def test_equal_and_trivial_partitions(spark):
    rows = [("same", "p", "p", 3), ("same", "q", "q", 2), ("one", "p", "p", 4)]
    df = spark.createDataFrame(rows, "name string, truth string, predicted string, n long")
    assert dict(evaluate.nmi(df).collect()) == {"same": pytest.approx(1.0), "one": 1.0}
    assert dict(evaluate.ari(df).collect()) == {"same": 1.0, "one": 1.0}


def test_cluster_edges_are_sorted_neighbours(spark, as_rows):
    rows = [("m", "1", "c"), ("m", "1", "a"), ("m", "1", "b"), ("m", "2", "z"), ("n", "1", "a"), ("n", "1", "z")]
    df = spark.createDataFrame(rows, "name string, cluster_id string, activity string")
    got = as_rows(evaluate.cluster_edges(df).select("name", "src", "dst", "cluster_id"))
    assert got == [("m", "a", "b", "1"), ("m", "b", "c", "1"), ("n", "a", "z", "1")]
