"""Near-duplicate documents by an inverted join on MinHash coordinates.

A document's signature has one minimum per coordinate.  Documents are posted under their
(coordinate, value) pairs, and two documents are candidates when at least ``needed``
coordinates collide, a bound so far below the expected number that a pair at the
similarity threshold misses it with probability below 1e-6; candidates are confirmed on
their full shingle sets.

*Prefix.*  Pairs that collide in ``needed`` of the ``COORDINATES`` share one of the
``COORDINATES - needed + 1`` rarest values of either, so only those are posted.  A value
that one document alone has needs no posting, and a document with fewer than ``needed``
shared values leaves the join.  *Skip.*  The long lists, of frequent values, are never
merged; a posting carries four bits of every coordinate, and where two postings meet the
collisions of all coordinates are counted on those, so that pairs which fall short of the
match threshold are never rows.  A posting also carries short hashes of the rarer keys of
its class: two postings that have one in common meet elsewhere, so a pair is made once.

Equal shingle sets are one class before anything is joined.  A list of classes does not
become all its pairs: in each round its classes are compared with one leader, at first the
one whose values most others share, components
are contracted, and lists whose classes are all in one component are done.  What is left
after the rounds, only pairs of classes in different components, is compared in full, so
no link that could join two components is missed.

*Tiles.*  Classes near the same popular class are at home there, in parts of bounded size.
The pairs between two parts are confirmed together, so that a text goes to a tile once and
not to each of its pairs.  In the full comparison pairs are not even rows: a list tells which
parts meet in it, and a task compares the shingle sets of two parts with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.batches import through
from trailweave.llm.shingles import shingle_sets, units
from trailweave.operators.components import more_labels
from trailweave.workspace import materialize, materialize_measured

COORDINATES = 64
#: Leaders tried before the remaining pairs are compared one by one.
ROUNDS = 4
#: Remaining pairs for each posting that are few enough to end the rounds early.
FEW = 16
#: Shingles of the texts in one part of a tile; each text counts as ``TEXT`` more.
PART, TEXT = 1 << 18, 512
#: Bytes of text whose shingles a task has in hand at once.
HAND = 1 << 20
_BITS = 24
#: Columns of the sketch: four bits of 16 coordinates in each.
SKETCH = ["q0", "q1", "q2", "q3"]


def needed_matches(similarity: float) -> int:
    """4.75 standard deviations below the expected collisions of a pair at the threshold."""
    spread = (COORDINATES * similarity * (1 - similarity)) ** 0.5
    return max(1, int(COORDINATES * similarity - 4.75 * spread))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240101).integers(0, 2**63, (2, COORDINATES), dtype=np.uint64)
    return draw[0], draw[1] * np.uint64(2) + np.uint64(1)


def class_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit id of each shingle set, and a mask of the empty sets."""
    return (
        np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64),
        np.array([not len(s) for s in sets], bool),
    )


def signatures(docs: DataFrame, words: int, hashed: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, class, sig)``; class and sig are null without shingles.

    With ``hashed``, a hash of the whole text is added as ``text_hash``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips, factors = _coefficients()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start, stop in units(texts, HAND):
                sets = shingle_sets(texts.slice(start, stop - start), words)
                sizes = np.array([len(s) for s in sets], np.int64)
                digest, none = class_ids(sets)
                full = np.flatnonzero(sizes)
                sig = np.zeros((len(sets), COORDINATES), np.int32)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    begins = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    for k in range(COORDINATES):
                        least = np.minimum.reduceat((flat ^ flips[k]) * factors[k], begins)
                        sig[full, k] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
                bits = (sig & 15).astype(np.uint64).reshape(len(sets), 4, 16) << np.arange(0, 64, 4, dtype=np.uint64)
                sketch = np.bitwise_or.reduce(bits, axis=2).view(np.int64)
                flat_sig = pa.array(sig.reshape(-1))
                offsets = pa.array(np.arange(0, sig.size + 1, COORDINATES, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, flat_sig, mask=pa.array(none))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, stop - start), pa.array(sizes), pa.array(digest, mask=none), lists,
                     *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(4)),
                     *(c.slice(start, stop - start) for c in batch.columns[2:])],
                    ["doc_id", "n_shingles", "class", "sig", *SKETCH, *batch.schema.names[2:]],
                )

    kind = ["doc_id long", "n_shingles long", "class long", "sig array<int>", *(f"{c} long" for c in SKETCH)]
    more = [F.xxhash64("text").alias("text_hash")] if hashed else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    return through(texts, run, ", ".join(kind + ["text_hash long"] * hashed))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of Jaccard similarity
    ``similarity`` or more between sets of ``words``-word shingles; ``kept`` marks the
    rows that have it.  Texts that are null, empty or white space have no shingles and
    stay alone.  Equal texts are linked; rows without a ``doc_id`` take part, and a
    component without any ``doc_id`` has a null id and keeps all its rows.  Repeated rows
    give repeated rows.
    """
    features, known = _components(docs, words, similarity, "doc_id")
    known = known.withColumnRenamed("first", "component_id")
    found = features.select("doc_id", "n_shingles", "class").join(known, "class", "left")
    component = F.expr("CASE WHEN component_id IS NOT NULL THEN component_id ELSE doc_id END")
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.expr("doc_id <=> component_id")
    )


def _components(docs: DataFrame, words: int, similarity: float, rank: str, hashed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and ``(class, first)`` of the classes whose component has several rows.

    ``first`` is the smallest ``rank``, SQL over the signatures, of the component's rows.
    """
    features = materialize(signatures(docs, words, hashed), "signatures")
    classes = materialize(
        features.where("class IS NOT NULL").groupBy("class").agg(
            F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), *[F.first(c).alias(c) for c in SKETCH],
            F.min("doc_id").alias("doc_id"), F.min(F.expr(rank)).alias("first"), F.count("*").alias("rows"),
        ),
        "classes",
    )
    labels = _linked(docs, classes, words, similarity)
    roots = classes.select("class", "first").join(labels.withColumnRenamed("v", "class"), "class", "left").select(
        "class", F.coalesce("label", "class").alias("root"), "first"
    )
    firsts = roots.groupBy("root").agg(F.min("first").alias("first"))
    # Only components of several rows are joined back; other rows name themselves.
    several = classes.where("rows > 1").select("class").union(labels.select("v")).union(labels.select("label"))
    return features, roots.drop("first").join(several.distinct(), "class", "left_semi").join(firsts, "root").select("class", "first")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, but one of each component only.

    The row with the smallest id stays, of rows with that id the one whose text has the
    smallest hash; rows without an id come last.  What goes is decided for each id and text,
    so other texts of an id are not touched.  Rows that repeat an id, or its absence, and a
    text stay once.
    """
    rank = "struct(doc_id IS NULL AS none, doc_id, text_hash)"
    features, known = _components(docs, words, similarity, rank, hashed=True)
    found = features.select("class", "doc_id", "text_hash", F.expr(rank).alias("own")).join(known, "class", "left")
    found = materialize(
        found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
            F.max(F.expr("first IS NOT NULL AND own <> first")).alias("gone"), F.count("*").alias("n")
        ),
        "near-duplicates",
    )
    # By position, so that other columns may have any names.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    same = plain[own].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(plain[text]) == F.col("_hash"))
    rows = plain.join(found.where("gone").select("_id", "_hash"), same, "left_anti")
    again, seen = materialize_measured(found.where("NOT gone AND n > 1").select("_id", "_hash"), "repeated-rows", n=F.count("*"))
    if seen["n"]:
        rows = rows.join(again, same, "left_anti").union(rows.join(again, same, "left_semi").dropDuplicates([own, text]))
    return rows.toDF(*docs.columns)


def _postings(classes: DataFrame, needed: int, similarity: float) -> DataFrame:
    """Rarest shared coordinate values ``(key, class, n)`` of each class."""
    # Below this size another set is never similar enough.
    least = next(n for n in range(1, 10_000) if 100 * n >= round(100 * similarity) * (n + 1))
    posted = classes.where(F.col("n") >= least).select("class", F.posexplode("sig").alias("at", "value")).selectExpr(
        "class", f"CAST(value AS LONG) * {COORDINATES} + at AS key"
    )
    lengths = posted.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    ranked = posted.join(lengths, "key").withColumns(
        {
            "rank": F.expr("row_number() OVER (PARTITION BY class ORDER BY length, key)"),
            "shared": F.expr("count(*) OVER (PARTITION BY class)"),
            "popular": F.expr("sum(length) OVER (PARTITION BY class)"),
            "rarer": F.expr(
                "collect_list(hash(key)) OVER (PARTITION BY class ORDER BY length, key"
                " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
            ),
        }
    )
    kept = ranked.where(f"rank <= shared - {needed} + 1").select("key", "class", "popular", "rarer")
    return kept.join(classes.select("class", "n", *SKETCH), "class")


def _places(postings: DataFrame) -> DataFrame:
    """``(class, place)``: the part, of bounded size, of the most popular class that a class meets."""
    popular = postings.groupBy("key").agg(F.max(F.struct("popular", "class")).alias("top"))
    homes = postings.select("key", "class", "n").join(popular, "key").groupBy("class").agg(
        F.max("top")["class"].alias("home"), F.first("n").alias("n")
    )
    parts = homes.groupBy("home").agg(F.expr(f"CAST(ceil(sum(n + {TEXT}) / {PART}) AS LONG)").alias("parts"))
    return homes.join(parts, "home").selectExpr("class", "xxhash64(home, pmod(xxhash64(class, 7), parts)) AS place")


def _collisions(one: list[str], two: list[str]) -> str:
    """SQL of the number of coordinates whose four bits agree in two sketches."""
    differ = []
    for a, b in zip(one, two):
        halves = f"(({a} ^ {b}) | shiftrightunsigned({a} ^ {b}, 1))"
        differ.append(f"bit_count(({halves} | shiftrightunsigned({halves}, 2)) & 1229782938247303441L)")
    return f"{COORDINATES} - " + " - ".join(differ)


def _linked(docs: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """``(v, label)`` of all classes but the smallest of each component, over confirmed links."""
    spark = docs.sparkSession
    needed = needed_matches(similarity)
    postings, size = materialize_measured(_postings(classes, needed, similarity), "postings", n=F.count("*"))
    none = spark.createDataFrame([], "a long, b long")
    if not size["n"]:
        return none.toDF("v", "label")
    members = classes.select("class", "doc_id").join(postings.select("class").distinct(), "class", "left_semi")
    members = materialize(members, "members")
    places = materialize(_places(postings), "places")
    percent = round(100 * similarity)
    tested, labels = none, None
    # Lists once done stay so, and only the last round needs the rarer keys.
    still_open = postings.drop("rarer")
    for turn in range(ROUNDS + 1):
        state = still_open.withColumn("label", F.col("class"))
        if labels is not None:
            state = still_open.join(labels.withColumnRenamed("v", "class"), "class", "left").withColumn(
                "label", F.coalesce("label", "class")
            )
        open_lists = state.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where(
            "_low <> _high"
        )
        state, left = materialize_measured(
            state.join(open_lists.select("key"), "key", "left_semi"), "open-lists", n=F.count("*")
        )
        if not left["n"]:
            break
        still_open = state.drop("label")
        last = turn == ROUNDS
        if not last and turn:
            each = state.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(
                F.expr("sum(m) * sum(m) - sum(m * m)").alias("pairs")
            )
            last = (each.agg(F.sum("pairs")).first()[0] or 0) <= FEW * 2 * size["n"]
        theirs = [f"_{c}" for c in SKETCH]
        more = ["rarer AS ra"] if last else ["popular AS pa"]
        if last:
            state = state.join(postings.select("key", "class", "rarer"), ["key", "class"])
        other = state.selectExpr("key", "class AS a", "n AS na", "label AS la", *more, *[f"{c} AS _{c}" for c in SKETCH])
        fits = f"la <> label AND 100 * least(na, n) >= {percent} * greatest(na, n) AND {_collisions(SKETCH, theirs)} >= {needed}"
        if last:
            met = state.alias("s").join(
                other.alias("o"), F.expr(f"s.key = o.key AND {fits} AND NOT arrays_overlap(rarer, ra)"), "left_semi"
            )
            near = materialize(met.select("key", "class", "label").join(places, "class"), "near-places")
            return more_labels(labels, materialize(_tile_links(near, docs, members, words, percent), "near-links"))
        # First the class whose values are the most shared, as of the text that others copy.
        order = F.xxhash64("a", F.lit(turn)) if turn else F.col("pa")
        leader = other.groupBy("key").agg(F.max(F.struct(order.alias("h"), "a", "na", "la", *theirs)).alias("s"))
        met = state.alias("s").join(leader.select("key", "s.*").alias("o"), F.expr(f"s.key = o.key AND {fits}"))
        pairs = met.select(F.least("a", "class").alias("a"), F.greatest("a", "class").alias("b")).distinct()
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti") if turn else pairs, "pairs")
        tested = tested.union(pairs)
        new = materialize(_confirmed(pairs, places, docs, members, words, percent), "near-links")
        labels = more_labels(labels, new)
    return none.toDF("v", "label") if labels is None else labels


def _marks(hashes: DataFrame) -> Broadcast:
    """A filter of fixed size: a bit for each of 2^24 values of the 64-bit ``hash`` column."""
    filled = hashes.selectExpr(f"hash & {(1 << _BITS) - 1} AS p").groupBy(F.expr("p div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("bits")
    )
    bits = np.zeros(1 << (_BITS - 6), np.int64)  # 2 MB, whatever the number of documents
    for word, value in filled.collect():  # 2^18 rows at most, in one job
        bits[word] = value
    return hashes.sparkSession.sparkContext.broadcast(bits)


def _marked(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """The rows whose hash, the last column, is marked, and a few that are so by chance."""
    at = batch.column(batch.num_columns - 1).to_numpy() & ((1 << _BITS) - 1)
    return batch.filter(pa.array((bits[at >> 6] >> (at & 63)) & 1 == 1))


def _texts(docs: DataFrame, members: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """``(class, text)``: one text of each class in ``classes``, and of a few others.

    ``members`` tells the document of a class; documents are read again, so that only texts that
    are compared are ever written, and only they are shuffled.
    """
    hashed = "xxhash64(CAST(doc_id AS LONG)) AS hash"
    marks = _marks(members.join(classes, "class", "left_semi").selectExpr(hashed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _marked(batch, marks.value).column(0)
            for start, stop in units(near, HAND):
                part = near.slice(start, stop - start)
                digest, none = class_ids(shingle_sets(part, words))
                yield pa.RecordBatch.from_arrays([pa.array(digest, mask=none), part], ["class", "text"])

    found = through(docs.where("text IS NOT NULL").selectExpr("text", hashed), run, "class long, text string")
    return found.where("class IS NOT NULL").dropDuplicates(["class"])


def _confirmed(pairs: DataFrame, places: DataFrame, docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs with ``100 * intersection >= percent * union`` of their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sets = None, {}
        for batch in batches:
            for start, stop in units(batch.column(3), HAND):
                part = batch.slice(start, stop - start)
                fresh = iter(shingle_sets(part.column(3).drop_null(), words))
                hit = []
                for t, a, b in zip(*(part.column(k).to_pylist() for k in range(3))):
                    if t != tile:
                        tile, sets = t, {}
                    if b is None:
                        sets[a] = next(fresh)
                        hit.append(False)
                        continue
                    x, y = sets[a], sets[b]
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    hit.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.filter(pa.array(hit, pa.bool_())).select([1, 2])

    one = places.select(F.col("class").alias("a"), F.col("place").alias("p"))
    two = places.select(F.col("class").alias("b"), F.col("place").alias("q"))
    dealt = pairs.join(one, "a").join(two, "b").select(F.xxhash64(F.least("p", "q"), F.greatest("p", "q")).alias("tile"), "a", "b")
    dealt = materialize(dealt, "dealt-pairs")
    inside = dealt.select("tile", F.col("a").alias("class")).union(dealt.select("tile", "b")).distinct()
    lines = inside.join(_texts(docs, members, inside, words), "class").selectExpr("tile", "class AS a", "CAST(NULL AS LONG) AS b", "text").union(
        dealt.selectExpr("tile", "a", "b", "CAST(NULL AS STRING)")
    )
    # The texts of a tile come before its pairs.
    return through(
        lines.repartition("tile").sortWithinPartitions("tile", F.col("b").asc_nulls_first()), run, "a long, b long"
    )


def _tile_links(near: DataFrame, docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` that join the components of the classes in ``near``, rows ``(key, class, label, place)``.

    Two parts that meet in a list make a tile, and so does each part with itself; a tile has
    the texts of both and compares them all.  A link between two classes that earlier links of
    the tile, or ``label``, hold together already is not looked for.
    """

    def links(rows: list[tuple], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        sizes = np.array([len(s) for s in sets], np.int64)
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        begins = np.concatenate(([0], np.cumsum(sizes)))
        left = np.array([m[0] for m in rows], bool)
        group = np.unique([m[2] for m in rows], return_inverse=True)[1]
        mark, found = np.zeros(len(values), np.int32), []
        # Where there are two parts, the first is compared with the second.
        split = int(left.sum()) if not left.all() else 0
        for i in range(split or len(sets)):
            start = split or i + 1
            size, rest = sizes[i], sizes[start:]
            open_to = (group[start:] != group[i]) & (100 * np.minimum(size, rest) >= percent * np.maximum(size, rest))
            if not open_to.any():
                continue
            own = flat[begins[i] : begins[i + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[flat[begins[start] :]], begins[start:-1] - begins[start])
            mark[own] = 0
            for j in (start + np.flatnonzero(open_to & (100 * common >= percent * (size + rest - common)))).tolist():
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    found.append((rows[i][1], rows[j][1]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1 and (found := links(rows, sets)):
                yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()) for ends in zip(*found)], ["a", "b"])

        tile, rows, sets = None, [], []
        for batch in batches:
            for start, stop in units(batch.column(4), HAND):
                part = batch.slice(start, stop - start)
                fresh = shingle_sets(part.column(4), words)
                for t, second, *member, s in zip(*(part.column(k).to_pylist() for k in range(4)), fresh):
                    if t != tile:
                        yield from done()
                        tile, rows, sets = t, [], []
                    rows.append((not second, *member))
                    sets.append(s)
        yield from done()

    held = near.select("key", "place").distinct()
    parts = held.join(held.withColumnRenamed("place", "other"), "key").where("place <= other").select("place", "other").distinct()
    tiles = materialize(parts.withColumn("tile", F.xxhash64("place", "other")), "tiles")
    sides = tiles.selectExpr("tile", "false AS second", "place").union(
        tiles.where("place <> other").selectExpr("tile", "true AS second", "other")
    )
    classes = materialize(near.select("class", "label", "place").distinct(), "near-classes")
    lines = classes.join(_texts(docs, members, classes, words), "class").join(sides, "place")
    # The first part of a tile comes before the second.
    dealt = lines.select("tile", "second", "class", "label", "text").repartition("tile").sortWithinPartitions("tile", "second")
    return through(dealt, run, "a long, b long")
