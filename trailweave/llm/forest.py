"""Approximate nearest neighbours by a forest of hash prefixes.

Each of ``TREES`` trees gives every vector a string of ``BITS`` bits, the sides of random
hyperplanes it lies on, and keeps the strings sorted.  A query descends to the longest
prefixes it shares in each tree; then all trees ascend together, one bit at a time, until
the entries under the query's prefixes are enough for the vectors of its length, and those
are the candidates, scored by cosine on the original vectors.

A tree's sorted array is cut at its first ``ROOTS`` bits, and further by hash where a part
is large, so it is many groups.  The trees first return how many entries each prefix length
has, one number per query and length, from which the common length of a query follows;
then each group returns its best ones only.

A query that has too few entries under ``ROOTS`` bits goes on to the empty prefix, below
which one tree has every vector once, fewer than the entries that are enough at any length
between; blocks of such queries meet all vectors of their length, in parts of a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.vectors import cosines, matrix, usable
from trailweave.workspace import materialize, materialize_measured

TREES, BITS, ROOTS = 32, 32, 4
#: Entries under the prefixes of all trees, as a share of all vectors, that are enough.
ENOUGH = 1.2
#: Other vectors that a query meets at least, if there are so many of its length.
LEAST = 64
#: Vectors in a group, and in a group of the smallest tables that is worth a task.
GROUP, FINE = 50_000, 1024


def hash_strings(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """The strings of each row in each tree, as unsigned numbers of ``BITS`` bits."""
    out = np.empty((len(x), TREES), np.int64)
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    scaled = (x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float32)
    for tree in range(TREES):
        planes = np.random.default_rng([seed, tree, x.shape[1]]).standard_normal((x.shape[1], BITS), np.float32)
        out[:, tree] = (scaled @ planes > 0) @ weights
    return out


def _entries(rows: DataFrame, roots: int, parts: int, with_vectors: bool, extra: str | None = None) -> DataFrame:
    """One row for each tree of a vector; a query goes to all parts of its root, others to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                for s in range(0, len(part), 2048):
                    piece = part.slice(s, 2048)
                    strings = hash_strings(matrix(piece.column("embedding")))
                    n = len(piece)
                    ids = piece.column("vec_id")
                    for tree in range(TREES):
                        key = strings[:, tree]
                        columns = {
                            "tree": np.full(n, tree, np.int32), "width": np.full(n, width, np.int32),
                            "root": (key >> (BITS - roots)).astype(np.int32), "key": key, "vec_id": ids,
                        }
                        if extra is None:
                            columns["part"] = (ids.to_numpy() % parts).astype(np.int32)
                        else:
                            columns["level"] = piece.column("level")
                        if with_vectors:
                            columns["embedding"] = piece.column("embedding")
                        yield pa.RecordBatch.from_pydict(columns)

    kind = "tree int, width int, root int, key long, vec_id long"
    kind += ", part int" if extra is None else ", level int"
    if with_vectors:
        kind += f", embedding {dict(rows.dtypes)['embedding']}"
    found = rows.mapInArrow(run, kind)
    return found if extra is None else found.withColumn("part", F.explode(F.expr(f"sequence(0, {parts - 1})")))


_GROUP = ["tree", "width", "root", "part"]


def _span(key: np.ndarray, level: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries that share the first ``level`` bits lie in the sorted ``keys``."""
    rest = BITS - level
    low = (key >> rest) << rest
    return np.searchsorted(keys, low, "left"), np.searchsorted(keys, low + (1 << rest), "left")


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` nearest found for each query.

    Queries are rows whose ``vec_id`` is divisible by ``every``; ties go to the smaller id.
    Null, empty and zero vectors, those with null or non-finite components and rows without
    an id take no part; vectors of other lengths are no candidates.  Repeated rows count
    once.  Of equal vectors only the ``k + 1`` smallest ids can be among the ``k`` nearest
    of any query, so only those are indexed.
    """
    rows = usable(embeddings.where("vec_id IS NOT NULL")).selectExpr("CAST(vec_id AS LONG) AS vec_id", "embedding").dropDuplicates(
        ["vec_id"]
    )
    rows = materialize(rows.withColumn("class", F.xxhash64("embedding")), "vectors")
    size = rows.count()
    ranked = rows.withColumn("_n", F.expr("row_number() OVER (PARTITION BY class, pmod(vec_id, 64) ORDER BY vec_id)")).where(
        f"_n <= {k + 1}"
    ).withColumn("_n", F.expr("row_number() OVER (PARTITION BY class ORDER BY vec_id)")).where(f"_n <= {k + 1}")
    indexed = materialize(ranked.select("vec_id", "embedding"), "indexed-vectors")
    queries = rows.where(f"vec_id % {every} = 0").select("vec_id", "embedding")
    parts = max(1, -(-size // (GROUP << ROOTS)))
    levels = np.arange(ROOTS, BITS + 1)

    def count(key, asked, known):
        keys = np.sort(known.column("key").to_numpy())
        own = np.repeat(asked.column("key").to_numpy(), len(levels))
        low, high = _span(own, np.tile(levels, asked.num_rows), keys)
        return pa.table({
            "vec_id": np.repeat(asked.column("vec_id").to_numpy(), len(levels)),
            "width": np.repeat(asked.column("width").to_numpy(), len(levels)),
            "level": np.tile(levels, asked.num_rows).astype(np.int32), "n": (high - low).astype(np.int64),
        })

    asked = _entries(queries.withColumn("level", F.lit(0)), ROOTS, parts, False, "level")
    known = _entries(indexed, ROOTS, parts, False)
    sums = asked.groupBy(*_GROUP).cogroup(known.groupBy(*_GROUP)).applyInArrow(count, "vec_id long, width int, level int, n long")
    # The longest common prefix length whose entries, over all trees and without the query's
    # own, are enough; 0 if none is.  ``LEAST`` vectors have at most that often TREES entries.
    enough = rows.groupBy(F.size("embedding").alias("width")).agg(
        F.expr(f"greatest({ENOUGH} * count(*), {TREES * max(LEAST, k)}) + {TREES}").alias("enough")
    )
    level = sums.groupBy("vec_id", "width", "level").agg(F.sum("n").alias("n")).join(enough, "width").groupBy("vec_id").agg(
        F.expr("coalesce(max(IF(n >= enough, level, NULL)), 0)").alias("level")
    )
    level, seen = materialize_measured(level, "query-levels", short=F.count_if(F.expr("level = 0")))

    def score(key, asked, known):
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not asked.num_rows or not known.num_rows:
            return none
        order = np.argsort(known.column("key").to_numpy(), kind="stable")
        keys, ids = known.column("key").to_numpy()[order], known.column("vec_id").to_numpy()[order]
        x, q = matrix(known.column("embedding"))[order], matrix(asked.column("embedding"))
        own = asked.column("vec_id").to_numpy()
        low, high = _span(asked.column("key").to_numpy(), asked.column("level").to_numpy().astype(np.int64), keys)
        unit = x / np.sqrt(np.sum(x * x, axis=1, keepdims=True))
        found = []
        for n in range(asked.num_rows):
            span = slice(int(low[n]), int(high[n]))
            near = unit[span] @ q[n]
            near[ids[span] == own[n]] = -np.inf
            # All that may be among the k by the exact score, from which the product differs in the last digits.
            slack = 1e-15 * (len(q[n]) + 16) * np.sqrt(q[n] @ q[n])
            top = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k] - slack) if len(near) > k else np.arange(len(near))
            top = top[ids[span][top] != own[n]]
            if len(top):
                exact = cosines(np.repeat(q[n : n + 1], len(top), axis=0), x[span][top])
                best = np.lexsort((ids[span][top], -exact))[:k]
                found.append((np.full(len(best), own[n]), ids[span][top][best], exact[best]))
        if not found:
            return none
        a, b, c = (np.concatenate(v) for v in zip(*found))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    found = "query_id long, vec_id long, score double"
    asked = _entries(queries.join(level.where("level > 0"), "vec_id"), ROOTS, parts, True, "level")
    known = _entries(indexed, ROOTS, parts, True)
    best = asked.groupBy(*_GROUP).cogroup(known.groupBy(*_GROUP)).applyInArrow(score, found)
    if seen["short"]:
        # Under the empty prefix the order of a tree does not matter, so its parts are cut by id.
        cuts, blocks = max(-(-size // GROUP), min(1 << ROOTS, -(-size // FINE))), -(-seen["short"] // GROUP)
        columns = ["size(embedding) AS width", "vec_id", "0L AS key", "embedding"]
        asked = queries.join(level.where("level = 0"), "vec_id").selectExpr(
            *columns, "level", f"CAST(pmod(xxhash64(vec_id, 1), {blocks}) AS INT) AS block", f"explode(sequence(0, {cuts - 1})) AS part"
        )
        known = indexed.selectExpr(
            *columns, f"CAST(pmod(xxhash64(vec_id, 2), {cuts}) AS INT) AS part", f"explode(sequence(0, {blocks - 1})) AS block"
        )
        group = ["width", "part", "block"]
        best = best.union(asked.groupBy(*group).cogroup(known.groupBy(*group)).applyInArrow(score, found))
    distinct = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return distinct.withColumn(
        "rank", F.expr("CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT)")
    ).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
