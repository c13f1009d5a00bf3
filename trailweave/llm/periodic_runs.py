"""Periodic runs of words in whole texts, found with a dictionary of basic factors.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are identical)
that holds at least ``exponent`` periods and ``least`` words, and that no neighbouring word
extends.  Only its first period is worth keeping.

For each power of two ``l``, the factors of ``l`` words get names: the name of a factor is
the rank of the names of its two halves, so a level is one sort.  The *successor* of a
position is the next one whose factor has the same name; only those within ``2 l`` count.
Neighbouring positions with the same distance ``d`` to their successors form arithmetic
progressions and propose the period ``d``; joined, such positions extend the proposal to the
stretch ``[first, last + l + d)``.

That is all that is needed.  *No run is missed:* at the level with ``q <= l < 2 q`` a factor
of a run contains a whole period, so its next occurrence is exactly ``q`` away (a smaller
distance would, with ``q``, give a smaller period), for ``q + 2`` positions or more.
*Nothing else is found:* a stretch of at least four periods from positions whose next
occurrence is ``d`` away has no period below ``d``, and at its ends the words differ, or the
positions beyond would have the same distance.  Different levels find equal triples, which are
made one.  A factor that occurs once in its text cannot be part of a longer one that occurs
twice, so it leaves the next level: prose is done after a few levels.

Many texts are worked on at once, some MB at a time; a longer text alone.  Names at the first
level are those of a text and a word, so texts never match each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from trailweave.llm.batches import pieces

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and the number in each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = ~_WHITE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][np.diff(at) > 0]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    kept = raw[inside]
    ends = np.append((np.cumsum(inside)[starts] - 1), len(kept)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    return words, np.diff(np.searchsorted(starts, at))


def find_runs(codes: np.ndarray, counts: np.ndarray, least: int = 6, exponent: int = 4) -> np.ndarray:
    """``(start, length, period)`` of every run, by start, then period.

    ``codes`` are the words of several texts, equal where words are, ``counts`` the number in
    each text, and ``start`` counts over all of them.  ``exponent`` is 4 or more, as the proof
    above needs.
    """
    if exponent < 4:
        raise ValueError("runs of fewer than four periods are not told apart from their parts")
    none = np.empty((0, 3), np.int64)
    at = np.arange(len(codes))
    if not len(at):
        return none
    name = np.repeat(np.arange(len(counts)), counts) * (int(codes.max()) + 1) + codes
    longest = int(counts.max()) // exponent
    found = [none]
    size = 1
    while len(at) and size < 2 * longest:
        order = np.argsort(name, kind="stable")
        same = np.diff(name[order]) == 0
        distance = np.zeros(len(at), np.int64)
        distance[order[:-1]] = np.where(same, np.diff(at[order]), 0)
        distance[distance > 2 * size] = 0

        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(distance) != 0)
        block = np.flatnonzero(new)
        period = distance[block]
        length = np.diff(np.append(block, len(at))) - 1 + size + period
        good = (period > 0) & (length >= np.maximum(least, exponent * period))
        found.append(np.column_stack((at[block], length, period))[good])

        rank = np.empty(len(at), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(~same)))
        shared = np.zeros(len(at), bool)
        shared[order[1:]] = same
        shared[order[:-1]] |= same
        named = np.full(len(codes) + size, -1)
        named[at[shared]] = rank[shared]
        second = named[at[shared] + size]
        at, name = at[shared][second >= 0], (rank[shared] * len(rank) + second)[second >= 0]
        size *= 2
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``, one row per row of ``docs``; no shuffle.

    ``runs`` lists ``(start, length, period)`` in words, by start, then period.  ``collapsed``
    is the text without the words that any run holds after its first period, the others
    joined by one space.  Null, empty and white texts have no words, no runs and an empty
    ``collapsed``.  Repeated rows and null ids are rows of their own; other columns are not
    read.
    """
    narrow = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            words, counts = split_words(batch.column(1))
            codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            runs = find_runs(codes, counts, least, exponent)
            first = np.concatenate(([0], np.cumsum(counts)))
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(change)[:-1] == 0
            if not kept.all():
                words = words.filter(pa.array(kept))
            ends = np.concatenate(([0], np.cumsum(kept)))[first].astype(np.int32)
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words), " ")
            owner = np.searchsorted(first, runs[:, 0], "right") - 1
            spans = pa.StructArray.from_arrays(
                [pa.array(runs[:, 0] - first[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"]
            )
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner, np.arange(len(counts) + 1)).astype(np.int32)), spans
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), lists, collapsed],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the run of the greatest exponent, and hashes of runs and collapsed text."""
    best = found.selectExpr(
        "doc_id", "runs", "collapsed",
        """aggregate(runs, get(runs, 0),
            (b, r) -> IF(r.length * b.period > b.length * r.period, r, b)) AS best""",
    )
    return best.selectExpr(
        "doc_id", "CAST(size(runs) AS LONG) AS n_runs", "best.start AS start", "best.length AS length", "best.period AS period",
        "1000 * best.length DIV best.period AS exponent_milli",
        "sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), ''), 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256",
    )


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` where about every tenth text ends in a repetition, as the contract of ``op11`` has it.

    Which texts, where the repetition begins and its period follow from the hash of the
    decimal id; rows without an id stay as they are.
    """
    tail = """transform(array(regexp_extract_all(coalesce(text, ''), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)), w ->
        transform(array(g % size(w)), a -> transform(array(1 + (size(w) - a) DIV (3 + g % 8)), p ->
            array_join(transform(w, (x, i) -> IF(i < a, x, w[CAST(a + (i - a) % p AS INT)])), ' '))[0])[0])[0]"""
    hashed = docs.selectExpr("doc_id", "text", "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) AS h").selectExpr(
        "doc_id", "text", "h", "h DIV 10 AS g"
    )
    wordy = "text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'"
    return hashed.selectExpr("doc_id", f"CASE WHEN h % 10 = 0 AND {wordy} THEN {tail} ELSE text END AS text")
