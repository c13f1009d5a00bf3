"""Prefix trie of conversations in node tables under minimal perfect hashes.

A node is a distinct sequence of first turns.  Its digest is the exclusive-or of hashes of
``(turn, depth)`` along the sequence, so a conversation of any length gets its digests from
running values over pieces of it.  Pieces, a conversation's turns in blocks of ``BLOCK``, are
dealt over shards of about ``SHARD`` rows, and every shard works on the trie of its pieces
alone: the distinct digests get slots under a minimal perfect hash, each slot verified
against the digest it stands for; counts are scattered into flat arrays by slot and
accumulated through the array of parent slots, deepest nodes first.

What shards find is summed by digest.  That is exact because every quantity of a subtree is
a sum over nodes, and each node is given to one shard only, that of the piece in which its
smallest member passes it; the shard holds all nodes above it in the block, and the sum of a
conversation's later blocks is scattered to the last node of the earlier one.  A first turn
that a third of all conversations share is thus one node in each shard, and a conversation
of any length is spread over many.

When shards are summed, all rows of a digest must agree on parent, depth and last turn,
which by induction proves that no two different sequences share a digest; otherwise the job
fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.operators.sequence import running_total
from trailweave.workspace import materialize, materialize_measured

#: Turns of a conversation in one piece.
BLOCK = 4096
#: Rows of pieces that one shard holds, on average.
SHARD = 200_000
#: Ids of conversations that are joined before they meet all others of their node.
CHUNK = 8192
WORDS = "size(regexp_extract_all({}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0))"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class NodeTable:
    """A minimal perfect hash of distinct two-word digests, with the digest of each slot.

    Level by level the digests that are alone at their place keep it, and the others go on
    to the next level with another hash; slots are ranks among the places taken.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.high, self.low = np.empty(len(high), np.uint64), np.empty(len(high), np.uint64)
        self.levels: list[np.ndarray] = []
        done = 0
        while len(high):
            if len(self.levels) > 200:
                raise ValueError("digests are not distinct")
            place = self._place(high, low, len(self.levels), 2 * len(high))
            alone = np.bincount(place, minlength=2 * len(high)) == 1
            # 0: no digest stands here; otherwise slot + 1.
            slots = np.where(alone, np.cumsum(alone) + done, 0)
            kept = alone[place]
            self.high[slots[place[kept]] - 1], self.low[slots[place[kept]] - 1] = high[kept], low[kept]
            self.levels.append(slots)
            done += int(kept.sum())
            high, low = high[~kept], low[~kept]

    @staticmethod
    def _place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        x = high ^ (low * np.uint64(2 * level + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that are not in the table."""
        found = np.full(len(high), -1)
        open_ = np.arange(len(high))
        for level, slots in enumerate(self.levels):
            if not len(open_):
                break
            slot = slots[self._place(high[open_], low[open_], level, len(slots))] - 1
            hit = slot >= 0
            found[open_[hit]] = slot[hit]
            open_ = open_[~hit]
        known = found >= 0
        known[known] = (self.high[found[known]] == high[known]) & (self.low[found[known]] == low[known])
        return np.where(known, found, -1)


def _inside(depths: np.ndarray, block: int) -> np.ndarray:
    """Whether a node's parent lies in the same block, so that a shard accumulates to it."""
    return (depths == 1) | (depths > 0) & ((depths - 1) % block > 0)


def accumulate(values: np.ndarray, parents: np.ndarray, depths: np.ndarray) -> None:
    """Add the values of all slots to their parents' slots, deepest first, in place."""
    order = np.argsort(-depths, kind="stable")
    order = order[parents[order] >= 0]
    for level in np.split(order, np.flatnonzero(np.diff(depths[order])) + 1):
        np.add.at(values, parents[level], values[level])


def turns_of(rows: DataFrame) -> DataFrame:
    """``(conv_id, n, first_key, second_key, words)``: the numbered turns of ``rows``, keyed by role and text.

    Turns are ordered by ``turn``, null first; ties by role, then by hash of role and text.
    Null roles and texts are empty.  Rows without ``conv_id`` belong to no conversation.
    """
    filled = rows.where("conv_id IS NOT NULL").selectExpr(
        "CAST(conv_id AS LONG) AS conv_id", "CAST(turn AS LONG) AS turn", "coalesce(role, '') AS role", "coalesce(text, '') AS text"
    )
    keyed = filled.selectExpr(
        "conv_id", "turn", "role", "xxhash64(role, text) AS first_key",
        "CAST(conv(substr(md5(concat(length(role), ':', role, text)), 1, 15), 16, 10) AS LONG) AS second_key",
        f"{WORDS.format('text')} AS words",
    )
    numbered = running_total(keyed, ("turn", "role", "second_key"), within=("conv_id",), name="n")
    return numbered.select("conv_id", "n", "first_key", "second_key", "words")


def paths_of(turns: DataFrame, shared: bool = False) -> DataFrame:
    """``(conv_id, depth, ends, first_key, second_key, words)``: one row per conversation and depth, 0 included.

    With ``shared``, a conversation ``c`` begins with the first turns of ``c - c % 20``, as
    many as a hash of ``c`` says and that one has, in place of as many of its own.
    """
    if not shared:
        totals = turns.groupBy("conv_id").agg(F.max("n").alias("total"))
        own = turns.join(totals, "conv_id").selectExpr("conv_id", "n AS depth", "n = total AS ends", "first_key", "second_key", "words")
        roots = totals.selectExpr("conv_id", "0L AS depth", "total = 0 AS ends", "0L AS first_key", "0L AS second_key", "0 AS words")
        return own.union(roots)
    key = "struct(n, first_key, second_key, words)"
    convs = turns.groupBy("conv_id").agg(
        F.max("n").alias("total"), F.array_sort(F.collect_list(F.expr(f"CASE WHEN n <= 3 THEN {key} END"))).alias("lead")
    )
    heads = convs.alias("c").join(convs.alias("b"), F.expr("b.conv_id = c.conv_id - c.conv_id % 20"), "left").selectExpr(
        "c.conv_id", "c.total", "CAST(crc32(CAST(CAST(c.conv_id AS STRING) AS BINARY)) % 4 AS INT) AS h", "b.lead AS lead"
    )
    heads = heads.selectExpr("conv_id", "h", "total", "slice(coalesce(lead, array()), 1, h) AS lead").selectExpr(
        "conv_id", "h", "lead", "size(lead) + greatest(total - h, 0L) AS depths"
    )
    first = heads.selectExpr("conv_id", "depths", "inline(lead)").selectExpr(
        "conv_id", "n AS depth", "n = depths AS ends", "first_key", "second_key", "words"
    )
    moved = turns.join(heads, "conv_id").where("n > h").selectExpr(
        "conv_id", "n - h + size(lead) AS depth", "n - h + size(lead) = depths AS ends", "first_key", "second_key", "words"
    )
    roots = heads.selectExpr("conv_id", "0L AS depth", "depths = 0 AS ends", "0L AS first_key", "0L AS second_key", "0 AS words")
    return roots.unionByName(first).unionByName(moved)


_LOCAL = (
    "shard long, ends boolean, high long, low long, parent_high long, parent_low long, depth long, first_key long, second_key long,"
    " words long, n long, first long"
)


def _local_trie(shard_key: tuple, table: pa.Table, block: int) -> pa.Table:
    """The nodes of one shard's pieces with their members in the shard, and the ends of its conversations."""
    conv, depth, high, low = (table.column(c).to_numpy() for c in ("conv_id", "depth", "high", "low"))
    piece = np.maximum(depth - 1, 0) // block
    order = np.lexsort((depth, piece, conv))
    column = {c: table.column(c).to_numpy()[order] for c in table.column_names}
    conv, depth, piece = conv[order], depth[order], piece[order]
    head = np.ones(len(conv), bool)
    head[1:] = (np.diff(conv) != 0) | (np.diff(piece) != 0)
    start = np.flatnonzero(head)
    last = np.append(start[1:], len(conv)) - 1
    digests, above = [], []
    for name in ("high", "low"):
        own = column[name].astype(np.int64).view(np.uint64)
        upto = np.bitwise_xor.accumulate(own)
        base = np.repeat(upto[start] ^ own[start] ^ column[f"carry_{name}"].astype(np.int64).view(np.uint64)[start], last - start + 1)
        digests.append(upto ^ base)
        above.append(np.where(head, column[f"carry_{name}"].astype(np.int64).view(np.uint64), np.roll(digests[-1], 1)))
    _, one = np.unique(np.column_stack(digests), axis=0, return_index=True)
    nodes = NodeTable(digests[0][one], digests[1][one])
    slots = nodes.slots(*digests)
    n = len(one)
    example = np.empty(n, np.int64)
    example[slots] = np.arange(len(slots))
    parents = np.where(_inside(depth[example], block), nodes.slots(above[0][example], above[1][example]), -1)
    members = np.zeros(n, np.int64)
    np.add.at(members, slots[last], 1)
    accumulate(members, parents, depth[example])
    smallest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(smallest, slots, conv)
    # Rows of one node must agree on its parent and last turn, like those of different shards.
    for values in (above[0], above[1], depth, column["first_key"], column["second_key"]):
        if (values != values[example][slots]).any():
            raise RuntimeError("two sequences of turns have one digest")

    def rows(at: np.ndarray, ends: bool, count: np.ndarray, first: np.ndarray) -> pa.Table:
        values = {
            "shard": np.full(len(at), shard_key[0].as_py()), "ends": np.full(len(at), ends),
            "high": digests[0][at].view(np.int64), "low": digests[1][at].view(np.int64),
            "parent_high": above[0][at].view(np.int64), "parent_low": above[1][at].view(np.int64), "depth": depth[at],
            "first_key": column["first_key"][at], "second_key": column["second_key"][at],
            "words": column["words"][at].astype(np.int64), "n": count, "first": first,
        }
        return pa.table(values)

    done = np.flatnonzero(column["ends"].astype(bool))
    return pa.concat_tables([rows(example, False, members, smallest), rows(done, True, np.ones(len(done), np.int64), conv[done])])


def _subtree_sums(nodes: pa.Table, values: pa.Table, block: int) -> pa.Table:
    """Sums over the subtrees of one shard's nodes of the values given to the shard."""

    def pair(table: pa.Table, high: str, low: str) -> tuple[np.ndarray, np.ndarray]:
        return tuple(table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in (high, low))

    digests = pair(nodes, "high", "low")
    table = NodeTable(*digests)
    slots = table.slots(*digests)
    depths = np.empty(len(slots), np.int64)
    depths[slots] = nodes.column("depth").to_numpy()
    parents = np.full(len(slots), -1)
    parents[slots] = table.slots(*pair(nodes, "parent_high", "parent_low"))
    parents[~_inside(depths, block)] = -1
    at = table.slots(*pair(values, "high", "low"))
    if (at < 0).any():
        raise RuntimeError("a node is missing in the shard of its smallest member")
    result = {"high": table.high.view(np.int64), "low": table.low.view(np.int64)}
    for name in ("saved", "leaves"):
        sums = np.zeros(len(slots), np.int64)
        np.add.at(sums, at, values.column(name).to_numpy())
        accumulate(sums, parents, depths)
        result[name] = sums
    return pa.table(result)


def _ends_hashes(ends: DataFrame) -> DataFrame:
    """``(high, low, ends_sha256)``: hash of the ascending ids of conversations that end in a node.

    Ids are range-sorted by node and id, joined in chunks where they lie, and the chunks of
    a node are hashed one after another; no task holds more than a chunk.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, conv = (batch.column(i).to_numpy() for i in range(3))
            if not len(conv):
                continue
            new = np.ones(len(conv), bool)
            new[1:] = (np.diff(high) != 0) | (np.diff(low) != 0)
            start = np.flatnonzero(new)
            spread = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(start, np.append(start[1:], len(conv)))])
            texts = list(map(str, conv.tolist()))
            joined = [",".join(texts[a:b]) for a, b in zip(spread, np.append(spread[1:], len(conv)))]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[spread]) for c in (high, low, conv)), pa.array(joined, pa.string())], ["high", "low", "conv_id", "ids"]
            )

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            found: list[tuple] = []
            for high, low, ids in zip(*(batch.column(c).to_pylist() for c in ("high", "low", "ids"))):
                if (high, low) == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    found.append((*now, state.hexdigest()))
                now, state = (high, low), hashlib.sha256(ids.encode())
            yield _hash_batch(found)
        if now is not None:
            yield _hash_batch([(*now, state.hexdigest())])

    order = ("high", "low", "conv_id")
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        chunks, "high long, low long, conv_id long, ids string"
    )
    dealt = joined.repartition("high", "low").sortWithinPartitions(*order)
    return dealt.mapInArrow(hashes, "high long, low long, ends_sha256 string")


def _hash_batch(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["high", "low", "ends_sha256"])


def prefix_trie(paths: DataFrame, block: int = BLOCK, shard_rows: int = SHARD) -> DataFrame:
    """The nodes of the trie of ``paths_of(turns)``, one row each; no rows give no nodes.

    ``high, low`` digest, ``depth``, ``conv_id`` the smallest member, ``parent_conv_id`` that of
    the parent (root: null), ``n_convs`` members, ``n_children``, ``n_leaves`` of the subtree,
    ``saved_tokens`` (words of last turns, times members less one, over the subtree) and
    ``ends_sha256`` (ids of the members that end here, ascending).
    """
    piece = f"greatest(depth - 1, 0L) DIV {block}"
    hashed = paths.selectExpr(
        "*", f"{piece} AS piece",
        "IF(depth = 0, 0L, xxhash64(first_key, second_key, depth)) AS high",
        "IF(depth = 0, 0L, xxhash64(depth, second_key, first_key)) AS low",
    )
    stored, measured = materialize_measured(hashed, "trie-paths", n=F.count("*"), deepest=F.max("piece"))
    if not measured["n"]:
        return paths.sparkSession.createDataFrame([], _NODES)
    shards = -(-measured["n"] // shard_rows)
    shard = f"pmod(xxhash64({{}}, {{}}), {shards})"

    # Digests at the ends of earlier pieces, for conversations of several.
    upto = "OVER (PARTITION BY conv_id ORDER BY piece)"
    carry = materialize(
        stored.where("depth > 0").groupBy("conv_id", "piece").agg(F.expr("bit_xor(high)").alias("h"), F.expr("bit_xor(low)").alias("l"))
        .selectExpr("conv_id", "piece + 1 AS piece", f"bit_xor(h) {upto} AS carry_high", f"bit_xor(l) {upto} AS carry_low",
                    f"lead(piece) {upto} IS NOT NULL AS more")
        .where("more").drop("more"),
        "trie-carry",
    ) if measured["deepest"] else None
    rows = stored.withColumn("shard", F.expr(shard.format("conv_id", "piece")))
    rows = rows.join(carry, ["conv_id", "piece"], "left") if carry is not None else rows.selectExpr("*", "0L AS carry_high", "0L AS carry_low")
    rows = rows.fillna(0, ["carry_high", "carry_low"]).drop("piece")
    local = materialize(rows.groupBy("shard").applyInArrow(lambda key, table: _local_trie(key, table, block), _LOCAL), "trie-local")

    parts = local.where("NOT ends")
    same = ["parent_high", "parent_low", "depth", "first_key", "second_key"]
    merged = parts.groupBy("high", "low").agg(
        F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"), F.min("words").alias("words"),
        *[F.min(c).alias(c) for c in same],
        F.expr(" AND ".join(f"min({c}) = max({c})" for c in same)).alias("one"),
    )
    checked = merged.withColumn("depth", F.expr("IF(one, depth, raise_error('two sequences of turns have one digest'))"))
    nodes = materialize(checked.drop("one", "first_key", "second_key"), "trie-nodes")
    children = nodes.where("depth > 0").groupBy("parent_high", "parent_low").agg(F.count("*").alias("n_children"))
    children = children.withColumnsRenamed({"parent_high": "high", "parent_low": "low"})
    tops = nodes.selectExpr("high AS parent_high", "low AS parent_low", "conv_id AS parent_conv_id")
    full = materialize(
        nodes.join(children, ["high", "low"], "left").fillna(0, ["n_children"])
        .join(tops, ["parent_high", "parent_low"], "left")
        .withColumn("parent_conv_id", F.expr("IF(depth = 0, NULL, parent_conv_id)")).drop("parent_high", "parent_low"),
        "trie-full",
    )
    owned = full.selectExpr("high", "low", "conv_id", f"{piece} AS piece", "(n_convs - 1) * words AS saved", "IF(n_children = 0, 1L, 0L) AS leaves")
    given = owned.selectExpr(f"{shard.format('conv_id', 'piece')} AS shard", "high", "low", "saved", "leaves")
    if carry is not None:
        # Every piece that is not a conversation's first also counts for the nodes of all earlier ones.
        later = "OVER (PARTITION BY conv_id ORDER BY piece ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        sums = owned.groupBy("conv_id", "piece").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("v"))
        behind = carry.join(sums, ["conv_id", "piece"], "left").fillna(0, ["s", "v"]).selectExpr(
            "conv_id", "piece - 1 AS piece", "carry_high AS high", "carry_low AS low", f"sum(s) {later} AS saved", f"sum(v) {later} AS leaves"
        )
        given = given.union(behind.selectExpr(f"{shard.format('conv_id', 'piece')} AS shard", "high", "low", "saved", "leaves"))
    shape = parts.select("shard", "high", "low", "parent_high", "parent_low", "depth")
    sums = shape.groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(
        lambda key, nodes, values: _subtree_sums(nodes, values, block), "high long, low long, saved long, leaves long"
    )
    sums = sums.groupBy("high", "low").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = _ends_hashes(local.where("ends").withColumnRenamed("first", "conv_id"))
    found = full.join(sums, ["high", "low"]).join(ends, ["high", "low"], "left").fillna(EMPTY_SHA, ["ends_sha256"])
    return found.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in _NODES.split(", ")])


_NODES = (
    "high long, low long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
    " saved_tokens long, ends_sha256 string"
)


def conversation_trie(rows: DataFrame) -> DataFrame:
    """``prefix_trie`` of a table of turns ``(conv_id, turn, role, text)``."""
    return prefix_trie(paths_of(materialize(turns_of(rows), "trie-turns")))
