import hashlib
import random
from collections import Counter

import pytest

from trailweave.operators import consensus, merge, overlap, walks
from trailweave.operators.dfg import with_totals
from trailweave.workspace import TableSeries


def sequential(edges, cap, stop_at, min_count=2):
    """The queue of pairs, walked one by one."""
    names = sorted({x for s, d, _ in edges for x in (s, d)})
    cluster = {n: frozenset([n]) for n in names}
    tie = {(s, d): int(hashlib.md5(f"{s}/{d}".encode()).hexdigest()[:13], 16) for s, d, _ in edges}
    for s, d, c in sorted(edges, key=lambda e: (-e[2], tie[e[0], e[1]], e[0], e[1])):
        if c < min_count or len(set(cluster.values())) <= stop_at:
            break
        a, b = cluster[s], cluster[d]
        if a != b and len(a) + len(b) <= cap:
            for n in a | b:
                cluster[n] = a | b
    return sorted((min(cluster[n]), n) for n in names)


@pytest.mark.parametrize("seed,cap,stop_at", [(1, 4, 0), (2, 4, 9), (3, 6, 3), (4, 3, 12)])
def test_greedy_merge_equals_the_queue(make_graph, as_rows, seed, cap, stop_at):
    rng = random.Random(seed)
    names = [chr(97 + i) for i in range(22)]
    edges = {}
    for _ in range(120):
        edges[rng.choice(names), rng.choice(names)] = rng.randrange(1, 8)
    edges = [(s, d, c) for (s, d), c in edges.items()]
    _, df = make_graph(names, edges)
    assert as_rows(merge.greedy_merge(df, cap, stop_at)) == sequential(edges, cap, stop_at)


@pytest.fixture
def rounds(monkeypatch):
    """Rounds of the loops that write one table a round."""
    seen = []
    original = TableSeries.add

    def spy(self, df, **measures):
        seen.append(self.label)
        return original(self, df, **measures)

    monkeypatch.setattr(TableSeries, "add", spy)
    return seen


def test_greedy_merge_of_a_path_of_equal_pairs_takes_few_rounds(spark, as_rows, rounds):
    names = [f"v{i:04d}" for i in range(1600)]
    edges = [(a, b, 5) for a, b in zip(names, names[1:])]
    df = spark.createDataFrame(edges, "src string, dst string, cnt long")
    assert as_rows(merge.greedy_merge(df, 4, 0)) == sequential(edges, 4, 0)
    assert 3 < len(rounds) < 30


def test_greedy_merge_without_any_eligible_pair(make_graph, as_rows):
    _, df = make_graph("ab", [("a", "b", 1), ("a", "a", 9)])
    assert as_rows(merge.greedy_merge(df, 4, 1)) == [("a", "a"), ("b", "b")]


@pytest.fixture(scope="module")
def communities(spark):
    """Majority border: a,b share 6 thresholds, a,c only 5; d,e share 6 under two labels."""
    data = []
    for tid in range(1, 21):
        data.append((tid, "a", "a"))
        data.append((tid, "b", "a" if tid <= 6 else "b"))
        data.append((tid, "c", "a" if tid <= 5 else "c"))
        data.append((tid, "d", "d" if tid <= 3 else "x" if tid <= 6 else "d2"))
        data.append((tid, "e", "d" if tid <= 3 else "x" if tid <= 6 else "e2"))
        data.append((tid, "f", "f"))
    return spark.createDataFrame(data, "tid int, v string, label string")


def brute_pairs(rows):
    count = Counter()
    for t1, v1, l1 in rows:
        for t2, v2, l2 in rows:
            if t1 == t2 and l1 == l2 and v1 < v2:
                count[v1, v2] += 2
    return sorted((a, b, n) for (a, b), n in count.items() if n > 10)


def test_consensus_keeps_six_of_twenty(communities, as_rows):
    pairs = as_rows(consensus.consensus_pairs(communities))
    assert pairs == [("a", "b", 12), ("d", "e", 12)]
    assert pairs == brute_pairs([tuple(r) for r in communities.collect()])
    assert as_rows(consensus.consensus_clusters(communities)) == [("a", "a"), ("a", "b"), ("d", "d"), ("d", "e")]


def test_consensus_on_random_communities(spark, as_rows):
    rng = random.Random(9)
    data = []
    for v in range(24):
        kind = rng.randrange(5)
        for tid in range(1, 21):
            data.append((tid, f"v{v:02d}", f"k{kind}" if rng.random() < 0.8 else f"own{rng.randrange(4)}"))
    df = spark.createDataFrame(data, "tid int, v string, label string")
    pairs = as_rows(consensus.consensus_pairs(df))
    assert pairs == brute_pairs(data)
    clusters = {}
    for c, v in as_rows(consensus.consensus_clusters(df)):
        clusters[v] = c
    assert set(clusters) == {x for a, b, _ in pairs for x in (a, b)}
    assert all(clusters[a] == clusters[b] for a, b, _ in pairs)


def test_overlapping_pairs_equal_brute_force(spark, as_rows):
    rng = random.Random(4)
    sets = {i: rng.sample(range(12 if i % 2 else 40), rng.randint(0, 9)) for i in range(60)}
    df = spark.createDataFrame([(i, i % 5, [f"p{x}" for x in v]) for i, v in sets.items()], "id long, part long, items array<string>")
    for need in (1, 3, 5):
        want = [
            (a, b, len({*sets[a]} & {*sets[b]})) for a in sets for b in sets
            if a < b and a % 5 != b % 5 and len({*sets[a]} & {*sets[b]}) >= need
        ]
        assert as_rows(overlap.overlapping_pairs(df, need)) == sorted(want)
    nothing = df.limit(0)
    assert overlap.overlapping_pairs(nothing, 2).count() == 0


def test_a_giant_community_gives_few_candidates(spark):
    """All kinds share five communities, two at a time six: candidates grow with the kinds, not with their square."""
    kinds = 400
    rows = [(i, i, [f"giant{t}" for t in range(5)] + [f"pair{i // 2}"] + [f"own{i}-{t}" for t in range(4)]) for i in range(kinds)]
    df = spark.createDataFrame(rows, "id long, part long, items array<string>")
    assert overlap.candidate_pairs(df, 6).count() <= kinds
    assert overlap.overlapping_pairs(df, 6).count() == kinds // 2


def test_strength_and_overlap(communities, as_rows):
    strength = consensus.membership_strength(communities)
    per_activity = Counter()
    for activity, _, n in as_rows(strength):
        per_activity[activity] += n
    assert set(per_activity.values()) == {20}
    overlap = as_rows(consensus.overlapping_clusters(strength))
    assert {s for s, _, _ in overlap} == set(range(21))
    assert [(c, a) for s, c, a in overlap if s == 6] == [("a", "a"), ("a", "b"), ("b", "b"), ("c", "c"), ("d2", "d"), ("e2", "e"), ("f", "f")]


def test_aggregated_clusters_are_transitive(spark, communities, as_rows):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "activity string")
    got = as_rows(consensus.aggregated_clusters(nodes, communities))
    assert got == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("d", "e"), ("f", "f")]
    later = as_rows(consensus.aggregated_clusters(nodes, communities, min_tid=6))
    assert later == [("a", "a"), ("a", "b"), ("c", "c"), ("d", "d"), ("d", "e"), ("f", "f")]


def test_threshold_edges_need_the_whole_share(make_graph, as_rows):
    _, edges = make_graph("ab", [("a", "b", 3), ("a", "a", 17), ("b", "a", 1)])
    got = Counter((s, d) for _, s, d in as_rows(consensus.threshold_edges(with_totals(edges))))
    assert got == {("a", "b"): 3, ("a", "a"): 17, ("b", "a"): 20}


def test_refine_drops_singles_and_cuts_large_clusters(spark, as_rows):
    members = [("one", "z")] + [("ten", f"t{i}") for i in range(10)] + [("eleven", f"e{i:02d}") for i in range(11)]
    clusters = spark.createDataFrame(members, "cluster_id string, activity string")
    freq = spark.createDataFrame([("t3", 5), ("t4", 5), ("e07", 9)], "activity string, freq long")
    got = {}
    for c, a in as_rows(consensus.refine_clusters(clusters, freq)):
        got.setdefault(c, []).append(a)
    assert got == {
        "t4": [f"t{i}" for i in range(10)],
        "e04": [f"e{i:02d}" for i in range(5)],
        "e07": [f"e{i:02d}" for i in range(5, 10)],
        "e10": ["e10"],
    }


def brute_walks(names, edges, count, length, seed):
    import hashlib

    total, spans = Counter(), {}
    for s, d, c in edges:
        total[s] += c
    for s in total:
        lo = 0
        for c, d in sorted((c, d) for s2, d, c in edges if s2 == s):
            spans.setdefault(s, []).append((lo, lo + c, d))
            lo += c
    met = Counter()
    order = sorted(names)
    for start in order:
        for walk in range(1, count + 1):
            cur, seen = start, {start}
            for step in range(1, length + 1):
                text = f"{start}|{walk}|{step}|{seed}"
                u = int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32
                if cur in spans:
                    r = int(u * total[cur])
                    cur = next(d for lo, hi, d in spans[cur] if lo <= r < hi)
                    seen.add(cur)
                    for a in seen:
                        for b in seen:
                            if a < b:
                                met[a, b] += 2
                else:
                    cur = order[int(u * len(order))]
    return sorted((a, b, n) for (a, b), n in met.items())


def test_walks_match_brute_force_with_dead_end(make_graph, as_rows):
    names = "abcde"
    edges = [("a", "b", 5), ("a", "c", 1), ("b", "c", 2), ("c", "a", 3), ("c", "d", 3), ("b", "b", 1), ("e", "a", 1)]
    nodes, df = make_graph(names, edges)
    got = as_rows(walks.walk_cooccurrence(nodes, with_totals(df), walks=20, length=7, seed=11))
    assert got == brute_walks(names, edges, 20, 7, 11)


def test_walk_clusters_and_sweep(spark, as_rows):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "activity string")
    pairs = spark.createDataFrame([("a", "b", 50), ("b", "c", 49), ("c", "d", 90)], "a string, b string, cnt long")
    assert as_rows(walks.walk_clusters(pairs, walks=100)) == [("a", "a"), ("a", "b"), ("c", "c"), ("c", "d")]
    assert as_rows(walks.walk_min_label(nodes, pairs, walks=100)) == [("a", "a"), ("b", "b"), ("c", "c"), ("d", "c")]
    sweep = walks.walk_threshold_sweep(nodes, pairs, walks=100).collect()
    by_tid = {t: {r.v: r.label for r in sweep if r.tid == t} for t in range(2, 21)}
    for t, labels in by_tid.items():
        least = t * 100 // 20
        assert (labels["b"] == "a") == (least <= 50)
        assert (labels["d"] != "d") == (least <= 90)
