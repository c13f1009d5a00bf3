"""Sums over the ordered pairs of events of each group, as running sums on Arrow batches.

Spark deals the groups to tasks and brings the events of a group in order.  A task goes
through them once: each event, as the later one of its pairs, meets what every activity
has gathered before it, so the work is events times activities of the group, and no pair
of events is ever a row.  Sums of all groups of a task are kept in one table of bounded
size, which is given out when it is full; Spark adds what the tasks give out.

With many activities that table would be large, and each task would give out most of it.
The activities are then dealt to blocks, and a task takes the pairs whose later activity is
in its block: events are sent once per block, and sums come from fewer tasks per pair.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Entries of the table of sums of a task, and of the rows of running sums at hand.
TABLE = 1 << 21
RUNNING = 1 << 19
# Activities of one group that are summed at a time, on either side.
SIDE = 1 << 10
ROWS_OUT = 1 << 16

# Workers get this small module with the job, so that the library need not be on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def blocks_of(events: int, activities: int, tasks: int) -> int:
    """Blocks for which events sent, ``events * blocks``, and sums given out, ``activities ** 2 * tasks / blocks``, balance."""
    return min(tasks, max(1, round(activities * math.sqrt(tasks / max(1, events)))))


class _Running:
    """What each source activity has gathered among the first of the sorted sources."""

    def __init__(self, src: np.ndarray, grow: np.ndarray, width: int):
        self.src, self.grow, self.width, self.done = src, grow, width, 0
        self.n, self.w = np.zeros(width, np.int64), np.zeros(width)

    def at(self, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums of the first ``upto[i]`` sources, ``upto`` ascending from call to call."""
        stop, size = int(upto[-1]), len(upto) * self.width
        row = np.searchsorted(upto, np.arange(self.done, stop), side="right")
        cell = row * self.width + self.src[self.done : stop]
        n = np.bincount(cell, minlength=size).reshape(-1, self.width)
        w = np.bincount(cell, self.grow[self.done : stop], size).reshape(-1, self.width).astype(float, copy=False)
        n[0] += self.n
        w[0] += self.w
        np.cumsum(n, axis=0, out=n)
        np.cumsum(w, axis=0, out=w)
        self.done, self.n, self.w = stop, n[-1].copy(), w[-1].copy()
        return n, w


def _sums(
    src: np.ndarray, grow: np.ndarray, width: int, dst: np.ndarray, fade: np.ndarray, height: int,
    before: np.ndarray, gone: np.ndarray | None,
) -> tuple[np.ndarray, np.ndarray]:
    """Counts and weights ``[dst, src]`` of the sources from ``gone[i]`` to ``before[i]`` of each target ``i``."""
    counts, weights = np.zeros((height, width), np.int64), np.zeros((height, width))
    met, left = _Running(src, grow, width), _Running(src, grow, width)
    step = max(1, RUNNING // width)
    for start in range(0, len(dst), step):
        part = slice(start, start + step)
        n, w = met.at(before[part])
        if gone is not None:
            less, lighter = left.at(gone[part])
            n -= less
            w -= lighter
            w[n == 0] = 0  # no rounding is left of sources that are gone
        order = np.argsort(dst[part], kind="stable")
        name = dst[part][order]
        n, w = n[order], w[order] * fade[part][order, None]
        cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(name)]
        for a, b in zip(cuts, cuts[1:]):
            counts[name[a]] += n[a] if b - a == 1 else n[a:b].sum(0)
            weights[name[a]] += w[a] if b - a == 1 else w[a:b].sum(0)
    return counts, weights


class _Table:
    """Sums by later and earlier activity, given out and begun anew when it is full."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.src, self.dst = {}, {}
        self.n, self.w = np.zeros((0, 0), np.int64), np.zeros((0, 0))

    def add(self, dst: list, src: list, counts: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        height = len(self.dst) + sum(d not in self.dst for d in dst)
        width = len(self.src) + sum(s not in self.src for s in src)
        if height * width > TABLE:
            yield from self.out()
            height, width = len(dst), len(src)
        rows = np.array([self.dst.setdefault(d, len(self.dst)) for d in dst])
        columns = np.array([self.src.setdefault(s, len(self.src)) for s in src])
        if height > self.n.shape[0] or width > self.n.shape[1]:
            shape = [max(have, min(2 * need, need + 256)) if need > have else have for have, need in zip(self.n.shape, (height, width))]
            for name in ("n", "w"):
                old = getattr(self, name)
                new = np.zeros(shape, old.dtype)
                new[: old.shape[0], : old.shape[1]] = old
                setattr(self, name, new)
        at = np.ix_(rows, columns)
        self.n[at] += counts
        self.w[at] += weights

    def out(self) -> Iterator[pa.RecordBatch]:
        src, dst = pa.array(list(self.src), pa.string()), pa.array(list(self.dst), pa.string())
        row, column = np.nonzero(self.n)
        for a in range(0, len(row), ROWS_OUT):
            r, c = row[a : a + ROWS_OUT], column[a : a + ROWS_OUT]
            yield pa.RecordBatch.from_arrays(
                [src.take(pa.array(c)), dst.take(pa.array(r)), pa.array(self.n[r, c]), pa.array(self.w[r, c])],
                ["src", "dst", "cnt", "weight"],
            )
        self.clear()


def _of_group(
    table: _Table, us: np.ndarray, ids: np.ndarray, code: np.ndarray, words: list, wanted: np.ndarray, decay: float, lag: int | None
) -> Iterator[pa.RecordBatch]:
    """Add the pairs of one group, given in order; those of the same time and id are in no order and no pair."""
    second = us // 1_000_000
    since = (second - second[0]).astype(np.float64)
    grow, fade = np.exp(decay * since), np.exp(-decay * since)
    fresh = np.flatnonzero(np.concatenate(([True], (us[1:] != us[:-1]) | (ids[1:] != ids[:-1]))))
    before = np.repeat(fresh, np.diff(np.append(fresh, len(us))))
    gone = None if lag is None else np.searchsorted(second, second - lag)
    if gone is not None and not gone[-1]:
        gone = None
    names, local = np.unique(code, return_inverse=True)
    targets = np.flatnonzero(wanted)
    later, late = np.unique(local[targets], return_inverse=True)
    for d in range(0, len(later), SIDE):
        some = slice(None) if len(later) <= SIDE else (late >= d) & (late < d + SIDE)
        to, dst = targets[some], late[some] - d
        height = min(SIDE, len(later) - d)
        for s in range(0, len(names), SIDE):
            width = min(SIDE, len(names) - s)
            if len(names) <= SIDE:
                src, weight, upto, out = local, grow, before[to], None if gone is None else gone[to]
            else:
                own = np.flatnonzero((local >= s) & (local < s + SIDE))
                src, weight = local[own] - s, grow[own]
                upto = np.searchsorted(own, before[to])
                out = None if gone is None else np.searchsorted(own, gone[to])
            counts, weights = _sums(src, weight, width, dst, fade[to], height, upto, out)
            yield from table.add(
                [words[names[i]] for i in later[d : d + SIDE]], [words[i] for i in names[s : s + SIDE]], counts, weights
            )


def summed(batches: Iterator[pa.RecordBatch], keys: int, decay: float, lag: int | None) -> Iterator[pa.RecordBatch]:
    """The pass of one task over rows ``(block, group, home, us, event_id, activity)`` in order."""
    table, block, rest = _Table(), None, None
    for batch in _then_none(batches):
        if batch is None:
            if rest is None:
                break
            rows, stop = rest, len(rest)
        else:
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        values = [rows.column(k).to_numpy() for k in range(keys + 3)]
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for value in values[:keys]:
            new[1:] |= value[1:] != value[:-1]
        starts = np.flatnonzero(new).tolist()
        if batch is not None:
            if not starts:
                continue
            stop = starts.pop()
            rest = rows.slice(stop)
        home, us, ids = values[keys:]
        encoded = rows.column(keys + 3).slice(0, stop).dictionary_encode(null_encoding="encode")
        code, words = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
        for a, b in zip(starts, [*starts[1:], stop]):
            if values[0][a] != block:
                yield from table.out()
                block = values[0][a]
            if b - a > 1:
                yield from _of_group(table, us[a:b], ids[a:b], code[a:b], words, home[a:b] == block, decay, lag)
    yield from table.out()


def pair_sums(events: DataFrame, group: Sequence[str], decay: float, lag: int | None, blocks: int) -> DataFrame:
    """Sums ``(src, dst, cnt, weight)`` of the ordered pairs in groups; a pair may be in several rows.

    ``events`` have the long columns ``group``, ``us`` and ``event_id`` (no nulls) and an
    ``activity``.  A group is held in memory as a whole.  ``lag`` bounds the whole seconds between the two.
    """
    keys = len(group) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from summed(batches, keys, decay, lag)

    home = F.pmod(F.xxhash64("activity"), F.lit(blocks)).alias("home")
    block = F.explode(F.array(*[F.lit(b).cast("long") for b in range(blocks)]))
    of = [F.col(c).alias(f"g{i}") for i, c in enumerate(group)]
    sent = events.select(block.alias("block"), *of, home, "us", "event_id", "activity")
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The groups of a block are dealt to as many tasks as there are for each block.
    parts = max(1, tasks // blocks)
    task = F.col("block") * parts + F.pmod(F.xxhash64(*[f"g{i}" for i in range(len(group))]), F.lit(parts))
    dealt = sent.repartitionById(parts * blocks, task.cast("int"))
    ordered = ["block", *[f"g{i}" for i in range(len(group))], "us", "event_id"]
    return dealt.sortWithinPartitions(*ordered).mapInArrow(
        run, "src string, dst string, cnt long, weight double"
    )


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None
