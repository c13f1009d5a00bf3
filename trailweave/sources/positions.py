"""Positions of rows in files, whatever way Spark packs files and blocks into tasks.

A row is told by its file, the start of the block of the file that it was read with, and its
number among the rows of its task.  A block is read by one task from its beginning to its
end, so within a block the last one follows the file; which other blocks the task has read
before does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.workspace import materialize

# Bits that a running id has for the rows of a task; those above number the tasks.
_ROW_BITS = 33


def located(raw: DataFrame) -> DataFrame:
    """Add ``at``, a struct ``(path, block, row)`` that orders rows by file path and place in the file.

    ``raw`` is a scan of text files, before anything else is done to it.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return raw.select(
        "*", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), row.alias("row")).alias("at")
    )


def numbered_by_file(raw: DataFrame, name: str) -> DataFrame:
    """Add a unique long ``name`` that ascends with file path and place in the file.

    Blocks are numbered in a table of their own, which has one row per block.
    """
    placed = located(raw)
    blocks = placed.select("at.path", "at.block").distinct()
    ranks = materialize(blocks.selectExpr("path", "block", "row_number() OVER (ORDER BY path, block) - 1L AS rank"), "blocks")
    joined = placed.join(ranks, (F.col("at.path") == ranks["path"]) & (F.col("at.block") == ranks["block"]))
    number = F.shiftleft("rank", _ROW_BITS) + F.col("at.row")
    return joined.select(*[raw[c] for c in raw.columns], number.alias(name))
