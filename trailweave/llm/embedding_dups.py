"""Near duplicates among embeddings by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale for each.  The product of two tiles of
quantised vectors is exact, since float32 holds the integers that 8-bit products of this
length add up to (longer vectors use doubles), and each vector's quantisation error bounds how
far it is from the cosine; only pairs whose bound reaches the threshold are computed again
in full precision.  Vectors of a label are hashed into tiles of about ``TILE``, and each
pair of tiles is a group of its own, so a label that holds most rows is many groups.  A
group returns counts and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.vectors import USABLE, cosines, matrix, usable
from trailweave.operators.components import linked_labels
from trailweave.workspace import materialize

TILE = 2048
#: Pairs computed in full precision at once, and slack for the rounding of the bound itself.
_CHUNK, _SLACK = 1 << 15, 1e-9


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values, scales and error norms of the unit vectors of ``x``."""
    top = np.abs(x).max(axis=1, keepdims=True)
    unit = x / top
    unit /= np.sqrt(np.sum(unit * unit, axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(np.sum((unit - q * scale[:, None]) ** 2, axis=1))


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked pairs between two tiles, ``i < j`` inside one tile."""
    qa, sa, ea = quantised(a)
    qb, sb, eb = (qa, sa, ea) if same else quantised(b)
    exact = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    near = (qa.astype(exact) @ qb.astype(exact).T).astype(np.float64) * sa[:, None] * sb[None, :]
    # |xy - XY| <= |x - X| |y| + |X| |y - Y| for unit x, y and their quantised X, Y.
    near += ea[:, None] + (1 + ea[:, None]) * eb[None, :]
    possible = near >= threshold - _SLACK
    i, j = np.nonzero(np.triu(possible, 1) if same else possible)
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), _CHUNK):
        part = slice(s, s + _CHUNK)
        keep[part] = cosines(a[i[part]], b[j[part]]) >= threshold
    return i[keep], j[keep]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of ``n`` nodes over links ``(i, j)``."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def near_embeddings(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``embeddings``.

    Vectors are linked when their labels are equal and not null and their cosine reaches
    the threshold.  Null, empty and zero vectors, and those with null or non-finite
    components, stay alone, as do vectors of different lengths to each other.  Equal
    vectors are compared once and linked to each other; repeated rows count as vectors of
    their own.
    """
    rows = embeddings.select("vec_id", "label", "embedding")
    named = materialize(
        usable(rows.where("label IS NOT NULL")).select("vec_id", F.xxhash64("label", "embedding").alias("class")), "vectors"
    )
    classes = usable(rows.where("label IS NOT NULL")).withColumn("class", F.xxhash64("label", "embedding")).groupBy("class").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"),
    ).withColumn("width", F.size("embedding"))
    classes = materialize(classes, "vector-classes")
    tiles = classes.groupBy("label", "width").agg(F.expr(f"CAST(ceil(count(*) / {TILE}) AS INT)").alias("tiles"))
    placed = classes.join(tiles, ["label", "width"]).withColumn("tile", F.expr("CAST(pmod(xxhash64(class), tiles) AS INT)"))
    sent = placed.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).selectExpr(
        "label", "width", "least(tile, other) AS i", "greatest(tile, other) AS j", "tile", "class", "copies", "embedding"
    )

    def compare(key, group):
        tile = group.column("tile").to_numpy()
        names, copies, x = group.column("class").to_numpy(), group.column("copies").to_numpy(), matrix(group.column("embedding"))
        first = np.flatnonzero(tile == key[2].as_py())
        same = key[2].as_py() == key[3].as_py()
        second = first if same else np.flatnonzero(tile == key[3].as_py())
        i, j = tile_links(x[first], x[second], threshold, same)
        i, j = first[i], second[j]
        counts = np.zeros(len(names), np.int64)
        np.add.at(counts, i, copies[j])
        np.add.at(counts, j, copies[i])
        label = forest(i, j, len(names))
        linked = np.flatnonzero(counts)
        return pa.table({"class": names[linked], "root": names[label[linked]], "n": counts[linked]})

    found = materialize(
        sent.groupBy("label", "width", "i", "j").applyInArrow(compare, "class long, root long, n long"), "vector-links"
    )
    labels = linked_labels(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    known = classes.select("class", "copies").join(counts, "class", "left").join(
        labels.withColumnRenamed("v", "class"), "class", "left"
    ).select("class", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "class").alias("root"))
    members = named.join(known.where("n_links > 0"), "class")
    firsts = members.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    # Rows find their class by vector again, so that repeated ids do no harm.
    linked = known.where("n_links > 0").join(firsts, "root").select("class", "n_links", "component_id")
    key = F.when(F.coalesce(F.expr(f"label IS NOT NULL AND {USABLE}"), F.lit(False)), F.xxhash64("label", "embedding"))
    out = rows.select("vec_id", key.alias("class")).join(linked, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.expr("vec_id <=> coalesce(component_id, vec_id)").alias("kept"),
    )

