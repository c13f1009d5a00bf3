import math
import random
from collections import defaultdict

import pytest

from trailweave.operators import pair_sums, windows


def brute(events, seconds=600, decay=0.001, least=0.0):
    groups = defaultdict(list)
    for e in events:
        if e[2] is not None:
            groups[math.floor(e[2] / seconds)].append(e)
    out = defaultdict(lambda: [0, 0.0])
    for g in groups.values():
        g.sort(key=lambda e: (e[2], e[0]))
        for i, x in enumerate(g):
            for y in g[i + 1 :]:
                weight = math.exp(-decay * (math.floor(y[2]) - math.floor(x[2])))
                if weight > least:
                    cell = out[x[3], y[3]]
                    cell[0] += 1
                    cell[1] += weight
    return {k: (n, w) for k, (n, w) in out.items()}


def check(df, events, **kwargs):
    got = {(r.src, r.dst): (r.cnt, r.weight) for r in df.collect()}
    want = brute(events, **kwargs)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    for k, (_, w) in want.items():
        assert got[k][1] == pytest.approx(w, rel=1e-9)


def test_window_borders_and_missing_times(make_log):
    events = [(1, "x", 599, "A"), (2, "x", 600, "B"), (3, "x", 1199, "A"), (4, "x", 1200, "C"), (5, "x", None, "A"), (6, "x", 600, "A")]
    check(windows.window_pairs(make_log(events)), events)


def test_no_pairs(make_log):
    assert windows.window_pairs(make_log([(1, "x", 0, "A"), (2, "x", 700, "B")])).collect() == []


def test_hot_window_second_and_instant_match_brute_force(make_log):
    """Groups above the direct size on every level, down to ids of one instant."""
    rng = random.Random(5)
    events = []
    for i in range(900):
        kind = i % 6
        if kind < 2:  # one instant, ids in distant blocks
            sec, eid = 1234.5, i + (i % 3) * (1 << 21) + (i % 5) * (1 << 11)
        elif kind == 2:  # one second, many milliseconds
            sec, eid = 1235 + rng.randrange(1000) / 1000, 10_000_000 + i
        elif kind == 3:  # one millisecond, many microseconds
            sec, eid = 1236 + rng.randrange(900) / 1_000_000, 20_000_000 + i
        else:  # the whole window and others
            sec, eid = rng.randrange(0, 2400), 30_000_000 + i
        events.append((eid, "x", sec, rng.choice("ABCD")))
    check(windows.window_pairs(make_log(events)), events)


def test_other_window_length(make_log):
    rng = random.Random(6)
    events = [(i, "x", rng.randrange(0, 300), rng.choice("AB")) for i in range(150)]
    check(windows.window_pairs(make_log(events), seconds=60), events, seconds=60)


def test_least_weight_is_guarded(make_log):
    pairs = windows.window_pairs(make_log([(1, "x", 0, "A"), (2, "x", 1, "B")]))
    assert windows.lasting(pairs).count() == 1
    with pytest.raises(ValueError):
        windows.lasting(pairs, seconds=7200)


@pytest.mark.parametrize("decay, least", [(0.01, 0.01), (0.05, 0.5), (1.0, 0.9), (0.001, 0.01), (0.0, 1.0)])
def test_pairs_below_the_least_weight_are_left_out(make_log, decay, least):
    """Crowded and sparse windows, lags from none to the whole window, and no pair at all."""
    rng = random.Random(8)
    events = [(i, "x", rng.choice([5, rng.randrange(0, 600)]) + rng.random(), rng.choice("ABC")) for i in range(200)]
    events += [(1000 + i, "x", 600 + rng.randrange(0, 1800), rng.choice("ABC")) for i in range(60)]
    check(windows.lasting_pairs(make_log(events), decay=decay, least=least), events, decay=decay, least=least)
    lags = [windows.longest_lag(0.01, 0.01, 600), windows.longest_lag(1.0, 0.9, 600), windows.longest_lag(0.0, 1.0, 600)]
    assert lags == [460, 0, -1]


def crowded_events(rng, n):
    """Hot instants, seconds and windows, missing and repeated ids, times before 1970."""
    events = [(i, "x", rng.choice([5, 5.25, rng.randrange(-1200, 600)]) + rng.choice([0, rng.random()]), rng.choice(NAMES)) for i in range(n)]
    return events + [(None, "x", 5, "A"), (3 << 21, "x", 5, "B"), (3 << 21, "x", 5, "B"), (3 << 21, "x", 5, "A")]


NAMES = [f"n{k}" for k in range(40)]


def brute_ids(events, **kwargs):
    """``brute`` where events of one time and id are in no order, and a missing id comes first."""
    plain = [(-1 if e[0] is None else e[0], *e[1:]) for e in events]
    want = defaultdict(lambda: [0, 0.0])
    for k, (n, w) in brute(plain, **kwargs).items():
        want[k] = [n, w]
    same = defaultdict(list)
    for e in plain:
        same[e[0], e[2]].append(e[3])
    for names in same.values():
        for i, x in enumerate(names):
            for y in names[i + 1 :]:
                want[x, y][0] -= 1
                want[x, y][1] -= 1
    return {k: v for k, v in want.items() if v[0]}


@pytest.mark.parametrize("direct", [8, 64, 1 << 16])
@pytest.mark.parametrize("decay, least", [(0.01, 0.01), (0.05, 0.5), (1.0, 0.9), (0.001, None)])
def test_groups_of_any_size_match_brute_force(make_log, direct, decay, least):
    """Whole windows in one pass, and windows that are refined down to single ids."""
    events = crowded_events(random.Random(9), 400)
    got = windows.window_pairs(make_log(events), decay=decay, least=least, direct=direct)
    got = {(r.src, r.dst): (r.cnt, r.weight) for r in got.collect()}
    want = brute_ids(events, decay=decay, least=least or 0.0)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    for k, (_, w) in want.items():
        assert got[k][1] == pytest.approx(w, rel=1e-9)


@pytest.mark.parametrize("lag", [None, 2])
@pytest.mark.parametrize("blocks", [1, 3])
def test_full_tables_wide_groups_and_blocks(spark, monkeypatch, lag, blocks):
    """Sums do not depend on the size of the tables, of the tiles, or on the blocks.

    Workers read the module anew, so the pass itself is run here.
    """
    import pyarrow as pa

    rng = random.Random(10)
    rows = sorted((win, win * 10_000_000 + rng.randrange(10_000_000), i, rng.choice(NAMES)) for win in (-1, 0, 3) for i in range(150))
    want = defaultdict(lambda: [0, 0.0])
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            dt = y[1] // 1_000_000 - x[1] // 1_000_000
            if x[0] == y[0] and (lag is None or dt <= lag):
                want[x[3], y[3]][0] += 1
                want[x[3], y[3]][1] += math.exp(-0.1 * dt)
    for name, size in {"TABLE": 900, "RUNNING": 100, "SIDE": 7, "ROWS_OUT": 50}.items():
        monkeypatch.setattr(pair_sums, name, size)
    sent = [(b, w, NAMES.index(n) % blocks, us, i, n) for b in range(blocks) for w, us, i, n in rows]
    columns = [pa.array(c) for c in zip(*sent)]
    table = pa.Table.from_arrays(columns, ["block", "win", "home", "us", "event_id", "activity"])
    got = defaultdict(lambda: [0, 0.0])
    for out in pair_sums.summed(iter(table.to_batches(max_chunksize=64)), 2, 0.1, lag):
        for row in out.to_pylist():
            got[row["src"], row["dst"]][0] += row["cnt"]
            got[row["src"], row["dst"]][1] += row["weight"]
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    for k, (_, w) in want.items():
        assert got[k][1] == pytest.approx(w, rel=1e-9)


def test_no_row_for_a_pair_of_events(make_log):
    """A window of many rare activities was a row for each second and activity, and then for each pair."""
    events = [(i, "x", i % 600, f"n{i % 300}") for i in range(1200)]
    pairs = windows.window_pairs(make_log(events))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window " not in plan
    check(pairs, events)


def test_blocks_balance_what_is_sent_and_given_out():
    assert pair_sums.blocks_of(36_000_000, 46, 200) == 1
    assert pair_sums.blocks_of(6_000_000, 3_000, 200) == 17
    assert pair_sums.blocks_of(0, 5, 2) == 2
