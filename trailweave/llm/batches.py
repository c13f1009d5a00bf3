"""Row-wise helpers over Arrow batches that keep every column of a table."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm.shingles import UNIT_BYTES, units

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that Spark hands to Python at once.
HANDED = 4 << 20


def hand_small(spark: SparkSession) -> None:
    """Let Spark hand rows to Python in batches of ``HANDED`` bytes; a size that the session sets stays.

    Spark's own 64 MB stand in the executor outside of its heap, as vectors and once more as
    the stream that is sent, for each core, and again in the worker.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(HANDED))


def through(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` in small batches; the worker keeps no memory of a task that has ended."""
    hand_small(rows.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()  # what ``run`` held is free by now

    return rows.mapInArrow(task, schema)


def pieces(batches: Iterator[pa.RecordBatch], at: int = 0, size: int = UNIT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text column ``at`` holds a few MB, or one text."""
    for batch in batches:
        for start, stop in units(batch.column(at), size):
            yield batch.slice(start, stop - start)


def texts_of(batch: pa.RecordBatch, at: int = 0) -> list[str]:
    return [t or "" for t in batch.column(at).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system at the end of a task, as Spark keeps its worker for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def filter_rows(docs: DataFrame, start: Callable[[], Callable[[list[str]], list[bool]]], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay; only texts go through Python, and only marks come back.

    ``start`` makes, once for each task, a function that takes some texts (null: empty) and
    tells which rows stay.
    """

    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = start()
        for batch in batches:
            marks = [judge([t or "" for t in batch.slice(a, b - a).to_pylist()]) for a, b in units(batch)]
            yield pa.array([m for some in marks for m in some], pa.bool_())

    @F.arrow_udf("boolean")
    def stays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from judged(batches)
        give_back()

    hand_small(docs.sparkSession)
    names = docs.columns
    # By position, like below.
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.where(stays(plain[f"c{names.index(text)}"])).toDF(*names)


def rewrite_rows(
    docs: DataFrame, start: Callable[[], Callable[[list[str]], tuple[list[bool] | None, list[str] | None]]], text: str = "text"
) -> DataFrame:
    """Filter rows and replace texts; all other columns, whatever their names, pass through.

    ``start`` makes, once for each task, a function that takes the texts of some rows (null: empty) and returns which rows stay and
    what the texts become, or None for no change.  A text that does not change stays null
    if it was.
    """
    names = docs.columns
    at = names.index(text)
    # Columns go through Python by position, so repeated or clashing names do no harm.
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = start()
        for batch in pieces(batches, at):
            before = texts_of(batch, at)
            stay, after = change(before)
            if after is not None and after != before:
                old = batch.column(at).to_pylist()
                new = [o if a == b else a for o, a, b in zip(old, after, before)]
                columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
                batch = pa.RecordBatch.from_arrays(columns, batch.schema.names)
            yield batch if stay is None else batch.filter(pa.array(stay, pa.bool_()))

    return through(plain, run, plain.schema).toDF(*names)


def summed(docs: DataFrame, run: Callable, cells: int, names: list[str] | None = None) -> list:
    """Sum the ``(cell, count)`` rows that ``run`` makes of batches of texts.

    ``cells`` bounds the number of distinct cells, and so what reaches the driver.
    """
    totals = [0] * cells
    table = through(docs.select("text"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for cell, n in table.collect():
        totals[cell] = n
    return totals
