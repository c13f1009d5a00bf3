"""Token ids on disk: one compressed file per shard that holds a wavelet matrix.

Documents are range-sorted by id and encoded where they lie.  The ids of a shard, with an
end id after each document, are kept as a wavelet matrix: one plane of bits for each binary
digit of an id, highest first, where each plane moves the ids with digit 0 before those with
digit 1.  With counts of ones at every 512th bit a plane answers rank and select, and so the file
gives the token at a position, the number of occurrences of a token in any stretch, and the
places of its occurrences, without being decoded.

A file is a row of a Parquet table written with one row per file: planes, directories of
counts, and the ends and ids of its documents, each compressed.  Spark's writer commits
them, so a lost executor leaves no half file, and any store that Spark reaches will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm.batches import pieces
from trailweave.llm.pretokens import splitter
from trailweave.workspace import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Ids in a file; a document that has more fills one alone.
FILE_IDS = 4 << 20
#: Bytes of text in a range of documents, on average.
RANGE_BYTES = 64 << 20
#: Bytes of text that are split at once.
UNIT = 8 << 20
#: Distinct words whose ids a task keeps, twice.
KNOWN = 100_000
#: Bits between two counts of the rank directory.
STEP = 512


class WaveletMatrix:
    """Rank, select and access over the binary digits of a sequence of ids."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        """``planes`` are packed bits, lowest bit of a byte first, of the highest digit first."""
        self.n = n
        self.planes = planes
        self.directories = [self._directory(p) for p in planes]
        self.zeros = [n - int(d[-1]) for d in self.directories]

    def _directory(self, plane: np.ndarray) -> np.ndarray:
        padded = np.zeros((-(-len(plane) // (STEP // 8)), STEP // 8), np.uint8)
        padded.ravel()[: len(plane)] = plane
        return np.concatenate(([0], np.cumsum(np.bitwise_count(padded).sum(1, dtype=np.int64))))

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        digits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if digits <= 16 else np.uint32)
        planes = []
        for digit in range(digits - 1, -1, -1):
            one = (now & now.dtype.type(1 << digit)).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            after, zeros = np.empty_like(now), len(now) - int(np.count_nonzero(one))
            np.compress(~one, now, out=after[:zeros])
            np.compress(one, now, out=after[zeros:])
            now = after
        return cls(len(ids), planes)

    def ids(self) -> np.ndarray:
        """The whole sequence, plane by plane from the lowest digit."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for digit, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            one = np.unpackbits(plane, count=self.n, bitorder="little").astype(bool)
            before = np.empty_like(now)
            before[~one] = now[:zeros]
            before[one] = now[zeros:] | now.dtype.type(1 << digit)
            now = before
        return now

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        plane, block = self.planes[level], at // STEP
        found = self.directories[level][block]
        byte = at // 8
        for k in range(STEP // 8):
            inside = block * (STEP // 8) + k
            found = found + np.where(inside < byte, np.bitwise_count(plane[np.minimum(inside, len(plane) - 1)]), 0)
        part = np.where(byte < len(plane), plane[np.minimum(byte, len(plane) - 1)], 0)
        return found + np.bitwise_count(part & ((1 << (at % 8)) - 1).astype(np.uint8))

    def access(self, positions: np.ndarray) -> np.ndarray:
        """The ids at ``positions``."""
        at, found = np.asarray(positions, np.int64), np.zeros(len(positions), np.int64)
        if not len(at):
            return found
        for level, zeros in enumerate(self.zeros):
            one = self.planes[level][at // 8] >> (at % 8).astype(np.uint8) & 1
            ones = self._ones(level, at)
            at = np.where(one == 1, zeros + ones, at - ones)
            found = found << 1 | one
        return found

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` within ``[start, stop)`` lie after the last plane."""
        if not self.n or token >> len(self.planes):
            return 0, 0
        ends = np.array([start, stop], np.int64)
        for level, zeros in enumerate(self.zeros):
            ones = self._ones(level, ends)
            ends = zeros + ones if token >> (len(self.planes) - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of ``token`` within ``[start, stop)``: a difference of two ranks."""
        low, high = self._range(token, start, self.n if stop is None else stop)
        return high - low

    def locate(self, token: int) -> np.ndarray:
        """The positions of all occurrences of ``token``, ascending, by select from the last plane up."""
        low, high = self._range(token, 0, self.n)
        at = np.arange(low, high)
        for level in range(len(self.planes) - 1, -1, -1):
            digit = token >> (len(self.planes) - 1 - level) & 1
            at = self._select(level, digit, at - self.zeros[level] if digit else at)
        return np.sort(at)

    def _select(self, level: int, digit: int, rank: np.ndarray) -> np.ndarray:
        """Positions of the bits ``digit`` with the given ranks, from 0."""
        plane, directory = self.planes[level], self.directories[level]
        upto = directory if digit else np.minimum(np.arange(len(directory)) * STEP, self.n) - directory
        block = np.searchsorted(upto, rank, "right") - 1
        left, at = rank - upto[block], block * (STEP // 8)
        found = np.full(len(rank), -1)
        for k in range(STEP // 8):
            byte = plane[np.minimum(at + k, len(plane) - 1)]
            byte = byte if digit else ~byte
            have = np.bitwise_count(byte)
            hit = (found < 0) & (left < have)
            if hit.any():
                bits = np.unpackbits(byte[hit][:, None], axis=1, bitorder="little")
                found[hit] = (at[hit] + k) * 8 + np.argmax(np.cumsum(bits, axis=1) == left[hit][:, None] + 1, axis=1)
            left = left - np.where(found < 0, have, 0)
        return found


_CODEC = "zstd"
FILE = "part int, file int, before long, n long, docs long, digits int, planes array<binary>, ends binary, doc_ids array<{}>"


def _pack(data: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(data).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec(_CODEC).compress(raw, asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.Codec(_CODEC).decompress(data[8:], size, asbytes=True), kind)


def _encoder(path: str):
    """Ids of texts, and how many each has: words are split, and each distinct word is encoded once.

    Ids of words are kept while these recur: of ``KNOWN`` words that were met, those which the
    next ``KNOWN`` do not contain go.
    """
    split = splitter(path)
    recent: dict[str, list[int]] = {}
    before: dict[str, list[int]] = {}

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        nonlocal recent, before
        words, counts = split.words(texts)
        coded = words.dictionary_encode()
        entries = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(recent) > KNOWN:
            recent, before = {}, recent
        lists = [recent.get(w) or before.get(w) for w in entries]
        new = [i for i, x in enumerate(lists) if x is None]
        for i, x in zip(new, split.encode_words([entries[i] for i in new])):
            lists[i] = x
        recent.update(zip(entries, lists))
        if not lists:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat, first = np.fromiter(chain.from_iterable(lists), np.uint32), np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        each = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.arange(ends[-1]) + np.repeat(first[codes] - ends[:-1], each)]
        return ids, np.diff(ends[np.concatenate(([0], np.cumsum(counts)))])

    return encode


def write(docs: DataFrame, end: int, path: str = PATH, folder: str | None = None) -> DataFrame:
    """Write the ids of all texts, each followed by ``end``, and return the table of files.

    Documents stand in ascending order of ``doc_id``, null first, those of one id by a hash
    of the text.  Null and empty texts have the end id alone; repeated rows are documents of
    their own; other columns are not read.  An empty table has no files.
    """
    spark = docs.sparkSession
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    order = ("doc_id", "tie")
    ranged = narrow.withColumn("tie", F.xxhash64("text")).repartitionByRange(max(1, -(-size // RANGE_BYTES)), *order)
    kind = dict(docs.dtypes)["doc_id"]
    schema = FILE.format(kind)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        ids: list = []
        ends: list[int] = []
        file = before = total = 0

        def packed() -> pa.RecordBatch:
            matrix = WaveletMatrix.of(np.concatenate(held))
            row = {
                "part": part, "file": file, "before": before, "n": matrix.n, "docs": len(ids), "digits": len(matrix.planes),
                "planes": [_pack(p) for p in matrix.planes], "ends": _pack(np.array(ends, np.int64)), "doc_ids": ids,
            }
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                own = {"part": pa.int32(), "file": pa.int32(), "before": pa.int64(), "n": pa.int64(), "docs": pa.int64(), "digits": pa.int32(),
                       "planes": pa.list_(pa.binary()), "ends": pa.binary(), "doc_ids": pa.list_(batch.schema.field(0).type)}
                arrow = pa.schema(own)
            for piece in pieces(iter([batch]), 1, UNIT):
                flat, counts = encode(piece.column(1).to_pylist())
                stops = np.cumsum(counts)
                for i, a, b in zip(piece.column(0).to_pylist(), stops - counts, stops):
                    if ids and total + b - a + 1 > FILE_IDS:
                        yield packed()
                        file, before = file + 1, before + total
                        held, ids, ends, total = [], [], [], 0
                    held += [flat[a:b], np.array([end], np.uint32)]
                    total += int(b - a) + 1
                    ids.append(i)
                    ends.append(total)
        if ids:
            yield packed()

    rows = ranged.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(files, schema)
    folder = folder or fresh_path(spark, "token-files")
    rows.write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(folder)
    return open_files(spark, folder, schema)


def open_files(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """The files below ``folder``, with ``start``, the number of ids in all earlier ones."""
    reader = spark.read.schema(schema) if schema else spark.read
    files = reader.parquet(folder)
    # Parts are as many as write() made ranges; a running total over them is small.
    sizes = files.groupBy("part").agg(F.sum("n").alias("size"))
    starts = sizes.selectExpr(
        "part", "coalesce(sum(size) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS base"
    )
    return files.join(F.broadcast(starts), "part").withColumn("start", F.expr("base + before")).drop("base")


def matrix_of(n: int, planes: list[bytes]) -> WaveletMatrix:
    return WaveletMatrix(n, [_unpack(p, np.uint8) for p in planes])


def read(files: DataFrame) -> DataFrame:
    """``(doc_id, start, ids)`` of every document, from the files; ``ids`` as little-endian 32-bit integers."""
    kind = dict(files.dtypes)["doc_ids"][len("array<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n, base, planes, ends = (batch.column(c)[i].as_py() for c in ("n", "start", "planes", "ends"))
                ids = matrix_of(n, planes).ids().astype("<u4")
                stops = _unpack(ends, np.int64)
                starts = np.concatenate(([0], stops[:-1]))
                docs = batch.column("doc_ids")[i].values
                size = max(1, len(docs) * (1 << 20) // n)
                for a in range(0, len(docs), size):
                    b = min(a + size, len(docs))
                    data = pa.array([ids[x:y].tobytes() for x, y in zip(starts[a:b], stops[a:b])], pa.binary())
                    yield pa.RecordBatch.from_arrays([docs.slice(a, b - a), pa.array(base + starts[a:b]), data], ["doc_id", "start", "ids"])

    columns = files.select("n", "start", "planes", "ends", "doc_ids")
    return columns.mapInArrow(run, f"doc_id {kind}, start long, ids binary")


def digests(found: DataFrame) -> DataFrame:
    return found.selectExpr("doc_id", "start", "CAST(octet_length(ids) DIV 4 AS LONG) AS n_tokens", "crc32(ids) AS ids_crc32")


def token_at(files: DataFrame, positions: DataFrame) -> DataFrame:
    """``(position, token)`` for the table ``positions`` of positions among all ids; no file is decoded.

    Positions outside, and null ones, have no row; repeated ones have one.
    """
    bounds = files.selectExpr(
        "part", "file", "start", "start + n AS stop", f"explode(sequence(start DIV {FILE_IDS}, (start + n - 1) DIV {FILE_IDS})) AS stretch"
    )
    wanted = positions.selectExpr("position", f"position DIV {FILE_IDS} AS stretch").join(bounds, "stretch")
    # A file has no more positions than ids.
    wanted = wanted.where("position >= start AND position < stop").groupBy("part", "file").agg(
        F.collect_set(F.expr("position - start")).alias("at")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n, start, planes, at = (batch.column(c)[i].as_py() for c in ("n", "start", "planes", "at"))
                at = np.array(at, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at + start), pa.array(matrix_of(n, planes).access(at))], ["position", "token"]
                )

    return files.join(wanted, ["part", "file"]).select("n", "start", "planes", "at").mapInArrow(run, "position long, token long")


def occurrences(files: DataFrame, tokens: list[int], places: bool = True) -> DataFrame:
    """``(token, doc_id, position)`` of every occurrence of ``tokens``, or ``(token, n)`` without ``places``.

    Positions count over all ids of all files.  A file is asked for each token by rank and
    select; its sequence is never decoded.
    """
    kind = dict(files.dtypes)["doc_ids"][len("array<") : -1]
    asked = list(dict.fromkeys(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n, start, planes, ends = (batch.column(c)[i].as_py() for c in ("n", "start", "planes", "ends"))
                matrix, stops, docs = matrix_of(n, planes), _unpack(ends, np.int64), batch.column("doc_ids")[i].values
                if not places:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asked, pa.int64()), pa.array([matrix.count(t) for t in asked], pa.int64())], ["token", "n"]
                    )
                    continue
                for token in asked:
                    at = matrix.locate(token)
                    owner = np.searchsorted(stops, at, "right")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), token)), docs.take(pa.array(owner)), pa.array(at + start)], ["token", "doc_id", "position"]
                    )

    if places:
        return files.select("n", "start", "planes", "ends", "doc_ids").mapInArrow(run, f"token long, doc_id {kind}, position long")
    counts = files.select("n", "start", "planes", "ends", "doc_ids").mapInArrow(run, "token long, n long")
    return counts.groupBy("token").agg(F.sum("n").alias("n"))


def crc32_of(ids: list[int]) -> int:
    """The checksum that ``digests`` gives for a list of ids."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
