"""Sharding over fixed virtual slots.

Records are hashed into ``SLOTS`` slots by their text, so equal texts share a slot, and
bytes are added up by slot.  A slot that weighs much is divided by a second hash of the text;
what still weighs more than half a shard is one group of equal texts, or nearly so, and only
such a group is dealt row by row, as no shard could hold it in balance.

A map gives each slot its shard, and is stored by version: the first deals slots, heaviest
first, to the shard with the fewest bytes; a later one edits the one before it and moves
only the slots it must.  Rows are placed by the map as stored.  All of it is DataFrame
operations; what is gathered in one row is the slots, whose number is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.workspace import fresh_path, materialize

SLOTS = 4096
#: A slot heavier than this part of a mean shard is divided over this many slots more.
HEAVY, SPREAD = 32, 256
#: What is heavier than this part of a mean shard after that is dealt row by row.
GROUP = 2


def records(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32)``: UTF-8 bytes and one more, and the CRC-32 of the text."""
    return docs.selectExpr(
        "doc_id", "coalesce(octet_length(text), 0) + 1L AS size", "crc32(CAST(coalesce(text, '') AS BINARY)) AS text_crc32"
    )


def slotted(rows: DataFrame, shards: int) -> DataFrame:
    """The rows with ``vslot``, the virtual slot of each, stored so that every later use sees the same.

    Rows dealt one by one are numbered where they are read; as their texts are equal, which
    of them goes where makes no difference to any size.
    """
    hashed = rows.selectExpr(
        "*", f"CAST(pmod(xxhash64(text_crc32, size), {SLOTS}) AS INT) AS _base",
        f"CAST(pmod(xxhash64(size, text_crc32), {SPREAD}) AS INT) AS _part",
        f"CAST(pmod(monotonically_increasing_id(), {SPREAD}) AS INT) AS _nth",
    )
    # SLOTS rows, and SPREAD for each of the heavy ones, of which there are HEAVY * shards at most.
    parts = rows.sparkSession.sql(
        f"""
        WITH parts AS (SELECT _base, _part, sum(size) AS bytes FROM {{hashed}} GROUP BY _base, _part),
        weighed AS (SELECT *, sum(bytes) OVER (PARTITION BY _base) AS slot_bytes, sum(bytes) OVER () AS all_bytes FROM parts)
        SELECT _base AS _b, _part AS _p, bytes * {GROUP * shards} > all_bytes AS _group FROM weighed
        WHERE slot_bytes * {HEAVY * shards} > all_bytes
        """,
        hashed=hashed,
    )
    found = hashed.join(parts, (F.col("_base") == F.col("_b")) & (F.col("_part") == F.col("_p")), "left")
    spread = f"{SLOTS} + (_base * {SPREAD} + _part) * {SPREAD + 1}"
    vslot = f"CASE WHEN _group IS NULL THEN _base WHEN _group THEN {spread} + 1 + _nth ELSE {spread} END"
    return materialize(found.withColumn("vslot", F.expr(vslot)).drop("_base", "_part", "_nth", "_b", "_p", "_group"), "slots")


def slot_sizes(rows: DataFrame) -> DataFrame:
    """``(vslot, bytes, rows)``; ``SLOTS`` rows, and ``SPREAD`` for each slot or group that is divided."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map, ``(vslot, shard, version)``: heaviest first to the lightest shard."""
    ordered = sizes.agg(F.expr("array_sort(collect_list(struct(-bytes AS b, vslot)))").alias("slots"))
    dealt = ordered.select(
        F.expr(
            f"""aggregate(slots,
            named_struct('loads', array_repeat(0L, {shards}), 'picks', CAST(array() AS ARRAY<STRUCT<vslot: INT, shard: INT>>)),
            (a, s) -> named_struct(
                'loads', transform(a.loads, (l, i) -> IF(i = array_position(a.loads, array_min(a.loads)) - 1, l - s.b, l)),
                'picks', concat(a.picks, array(named_struct('vslot', s.vslot, 'shard',
                    CAST(array_position(a.loads, array_min(a.loads)) - 1 AS INT))))),
            a -> a.picks)"""
        ).alias("picks")
    )
    return dealt.select(F.inline("picks")).withColumn("version", F.lit(1))


def grown_map(old: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version, for one more shard: each shard gives the new one its share of bytes.

    Slots move whole, smallest first, while the bytes moved stay within the share; no slot
    moves between old shards.
    """
    sized = old.join(sizes, "vslot", "left").fillna(0, ["bytes"])
    moved = """sum(bytes) OVER (PARTITION BY shard ORDER BY bytes, vslot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        * {n} <= sum(bytes) OVER (PARTITION BY shard)""".format(n=shards + 1)
    return sized.selectExpr("vslot", f"IF({moved}, {shards}, shard) AS shard", "version + 1 AS version")


def write_map(table: DataFrame, path: str) -> int:
    """Store a map below ``path`` as the version that it says; the number of the version."""
    version = table.agg(F.max("version")).first()[0] or 1
    table.drop("version").write.parquet(f"{path.rstrip('/')}/version={version}")
    return version


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``(vslot, shard, version)`` of one version, the latest if none is said."""
    versions = spark.read.schema("vslot int, shard int, version int").parquet(path)
    latest = versions.agg(F.max("version")).first()[0] if version is None else version
    return versions.where(F.col("version") == F.lit(latest))


def grow(rows: DataFrame, path: str) -> int:
    """Store the next version of the map below ``path``, for one more shard; its number.

    ``rows`` are those of ``slotted``, by whose sizes slots are moved.
    """
    old = read_map(rows.sparkSession, path)
    shards = old.agg(F.max("shard")).first()[0] + 1
    return write_map(materialize(grown_map(old, slot_sizes(rows), shards), "slot-map"), path)


def place(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, vslot)`` of slotted rows under a stored map."""
    placed = table.join(slot_sizes(rows), "vslot").selectExpr(
        "vslot", "shard",
        """coalesce(sum(rows) OVER (PARTITION BY shard ORDER BY vslot
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _before""",
    )
    inside = "row_number() OVER (PARTITION BY vslot ORDER BY doc_id, text_crc32, size) - 1"
    return rows.withColumn("_nth", F.expr(inside)).join(placed, "vslot").selectExpr(
        "doc_id", "size", "text_crc32", "'bytes' AS law", "shard", "_before + _nth AS slot", "vslot"
    )


def shard(docs: DataFrame, shards: int = 16, path: str | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, vslot)``, one row per row of ``docs``.

    Shards hold near equal bytes (law ``bytes``).  ``slot`` numbers the rows of a shard
    from 0 without gaps, by virtual slot and id; rows that are equal in id and text are
    numbered in any order.  Equal texts share a shard, unless they alone weigh more than half
    a mean shard.  Null texts have size 1, null ids are ids like others, repeated rows are
    rows of their own, other columns are not read, and an empty table gives no rows.
    Version 1 of the map is stored below ``path``, by default below the shared folder.
    """
    rows = slotted(records(docs), shards)
    path = path or fresh_path(docs.sparkSession, "slot-map")
    write_map(first_map(slot_sizes(rows), shards), path)
    return place(rows, read_map(docs.sparkSession, path))
