import random
from collections import Counter

import pytest

from trailweave.operators import dfg, sequence
from trailweave.operators.sequence import pair_counts, pair_graph, running_total


def brute(events, offsets=(1,), group=lambda e: 0):
    order = sorted(events, key=lambda e: (group(e), e[2], e[0]))
    out = Counter()
    for i, e in enumerate(order):
        for o in offsets:
            if 0 <= i + o < len(order) and group(order[i + o]) == group(e):
                out[e[3], order[i + o][3]] += 1
    return sorted((s, d, n) for (s, d), n in out.items())


@pytest.fixture(scope="module")
def hot_events():
    """A third of the rows at one instant and in one case; ties broken by event_id."""
    rng = random.Random(3)
    events = []
    for i in range(240):
        hot = i % 3 == 0
        events.append((i, "hot" if hot else f"c{rng.randrange(9)}", 5000 if hot else rng.randrange(20000), rng.choice("ABCDE")))
    rng.shuffle(events)
    return events


@pytest.mark.parametrize("slices", [None, 1, 3, 7])
def test_global_pairs_match_brute_force(make_log, as_rows, hot_events, slices):
    assert as_rows(dfg.global_transitions(make_log(hot_events), slices=slices)) == brute(hot_events)


@pytest.mark.parametrize("slices", [1, 5])
def test_case_pairs_span_slices(make_log, as_rows, hot_events, slices):
    got = as_rows(dfg.case_transitions(make_log(hot_events), slices=slices))
    assert got == brute(hot_events, group=lambda e: e[1])


@pytest.mark.parametrize("slices", [1, 4, 60])
def test_neighbourhood_offsets_with_tiny_slices(make_log, as_rows, hot_events, slices):
    got = as_rows(dfg.neighbourhood_pairs(make_log(hot_events), slices=slices))
    assert got == brute(hot_events, offsets=(-1, 1, 2))


def test_hand_counted_log_with_self_transition_and_equal_times(make_log, as_rows):
    log = make_log([(1, "x", 0, "A"), (2, "x", 1, "B"), (4, "y", 2, "C"), (3, "y", 2, "A"), (5, "y", 9, "C"), (6, "z", 9, "A")])
    # Order: A B A C C A
    assert as_rows(dfg.global_transitions(log)) == [("A", "B", 1), ("A", "C", 1), ("B", "A", 1), ("C", "A", 1), ("C", "C", 1)]
    assert as_rows(dfg.case_transitions(log)) == [("A", "B", 1), ("A", "C", 1), ("C", "C", 1)]


def test_group_is_kept_and_one_event_groups_have_no_pair(make_log, as_rows):
    log = make_log([(1, "x", 0, "A"), (2, "x", 1, "B"), (3, "y", 2, "A")])
    got = as_rows(pair_counts(log, within=["case_id"], keep_group=True, slices=3))
    assert got == [("x", "A", "B", 1)]


def test_single_row_log_has_a_vertex_and_no_pair(make_log, as_rows):
    nodes, edges = pair_graph(make_log([(1, "x", 0, "A")]))
    assert as_rows(nodes) == [("A",)] and as_rows(edges) == []


def test_empty_log(make_log, as_rows):
    nodes, edges = pair_graph(make_log([]))
    assert as_rows(nodes) == [] and as_rows(edges) == []


def test_daily_transitions_drop_self_pairs_rare_pairs_and_missing_times(make_log, as_rows):
    day = 86400
    log = make_log(
        [(1, "x", 0, "A"), (2, "x", 10, "B"), (3, "x", day, "A"), (4, "x", day + 5, "B"), (5, "x", day + 6, "B"), (6, "x", None, "A")]
    )
    assert as_rows(dfg.daily_transitions(log)) == [("A", "B", 2)]


@pytest.mark.parametrize("slices", [None, 1, 6])
def test_running_total_in_groups(spark, as_rows, slices):
    data = [("h", i, i % 4) for i in range(50)] + [("a", i, 2) for i in range(7)]
    df = spark.createDataFrame(data, "g string, i int, n long")
    from pyspark.sql import functions as F

    got = as_rows(running_total(df, ["i"], F.col("n"), within=["g"], slices=slices))
    want, sums = [], Counter()
    for g, i, n in sorted(data):
        sums[g] += n
        want.append((g, i, n, sums[g]))
    assert got == want
    numbers = [r[-1] for r in sorted(as_rows(running_total(df, ["g", "i"], slices=slices)))]
    assert numbers == list(range(1, 58))


def test_thresholds_are_compared_in_integers(make_graph, as_rows):
    _, edges = make_graph("AB", [("A", "B", 3), ("A", "A", 17), ("B", "A", 1)])
    totals = dfg.with_totals(edges)
    assert as_rows(dfg.strong(totals, 3).select("src", "dst")) == [("A", "A"), ("A", "B"), ("B", "A")]
    assert as_rows(dfg.strong(totals, 4).select("src", "dst")) == [("A", "A"), ("B", "A")]


def plans_of(build):
    """The plans of the passes that ``build`` writes with measures."""
    import trailweave.operators.sequence as sequence

    seen = []
    original = sequence.materialize_measured

    def spy(df, label, **measures):
        if label == "pairs":
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df, label, **measures)

    sequence.materialize_measured = spy
    try:
        build()
    finally:
        sequence.materialize_measured = original
    return seen


@pytest.mark.parametrize("build", [dfg.global_transitions, dfg.case_transitions, dfg.neighbourhood_pairs])
def test_one_exchange_of_the_log(make_log, hot_events, build):
    """Rows go to their slices once; the other exchange is that of counted pairs."""
    plans = plans_of(lambda: build(make_log(hot_events), slices=5))
    assert plans and all("SinglePartition" not in p and "rangepartitioning" not in p for p in plans)
    log = [line for p in plans for line in p.splitlines() if "Exchange hashpartitioning(" in line and "slice" in line and "rn" not in line]
    assert len(log) == 1 and all(p.count("Exchange hashpartitioning(") == 2 for p in plans)


def test_an_instant_and_a_case_of_many_rows_are_cut(spark, make_log):
    """A third of the rows at one instant of one case: slices hold a bounded number of them."""
    events = [(i, "hot" if i % 3 == 0 else f"c{i % 50}", 5000 if i % 3 == 0 else i, "A") for i in range(3000)]
    log = make_log(events)
    for within in ([], ["case_id"]):
        cut = sequence._sliced(log, sequence.TIME_ORDER, within, 10)
        sizes = [r["count"] for r in cut.rows.groupBy(*cut.partition).count().collect()]
        assert cut.cut and sum(sizes) == 3000 and max(sizes) <= 700


def test_null_activities_do_not_depend_on_slices(make_log, as_rows):
    names = ["a", None, "b", "c", None, "a", "b", None, "c", "a", "b", "c"]
    log = make_log([(i, "x", i, name) for i, name in enumerate(names)])
    found = [
        sorted(pair_graph(log, slices=k)[1].collect(), key=str) for k in (1, 3, 6)
    ]
    assert found[0] == found[1] == found[2]
    assert all(r.dst is not None for r in found[0])
