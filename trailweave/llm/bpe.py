"""BPE encoding and decoding with a table of distinct words.

Texts are cut into blocks of some MB.  A block has a dictionary of its distinct words, and
its documents are lists of positions in it.  One pass over the texts writes both to the
shared folder, so nothing is split twice and no order of rows has to repeat.  The words of
all dictionaries are dealt over buckets by a hash, which makes the table of distinct words:
in a bucket each distinct word is encoded once, and its ids are joined back by block and
position, where words and documents of a block meet again.

A row holds the words that a block has in a bucket, or some MB of its documents; positions
are numbered from the most frequent word on, in bytes of variable length, and rows are
compressed, so what is written and shuffled is a fraction of the texts.

Decoding joins ids with the pieces of the vocabulary.  That table has a size that the
tokenizer fixes, so every task holds it and looks ids up by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.batches import give_back, hand_small, pieces, through
from trailweave.llm.pretokens import byte_signs, splitter
from trailweave.workspace import materialize

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 32 << 20
#: Bytes of text that are split at once.
UNIT = 2 << 20
#: Buckets of words for each shuffle partition; the distinct words of one are in memory at once.
BUCKETS = 1
#: Rows that are decoded or digested at once.
ROWS = 256
_CODEC = pa.Codec("zstd", compression_level=3)


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _restored(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed."""
    return _squeezed(_varied(numbers))


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_restored(data), np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


def _varied(numbers: np.ndarray) -> bytes:
    """Numbers in 7-bit groups, low first; the top bit says that more follow."""
    numbers = np.asarray(numbers).astype(np.uint32)
    out = np.zeros((len(numbers), 5), np.uint8)
    width = 1 + sum((numbers >= 1 << (7 * k)).astype(np.int8) for k in range(1, 5))
    for k in range(5):
        out[:, k] = (numbers >> np.uint32(7 * k)) & np.uint32(127) | np.where(width > k + 1, 128, 0).astype(np.uint32)
    return out[np.arange(5) < width[:, None]].tobytes()


class _Block:
    """The texts of a block, collected batch by batch."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.ids: list[pa.Array] = []
        self.words: list[pa.DictionaryArray] = []
        self.counts: list[np.ndarray] = []

    def add(self, split, piece: pa.RecordBatch) -> None:
        words, counts = split.words([t or "" for t in piece.column(1).to_pylist()])
        self.size += piece.column(1).nbytes
        self.ids.append(piece.column(0))
        self.words.append(words.dictionary_encode())
        self.counts.append(counts)

    def rows(self, buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        found = pa.chunked_array(self.words).unify_dictionaries()
        words = found.chunk(0).dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        codes = [part.indices.to_numpy() for part in found.chunks]
        often = np.argsort(-sum(np.bincount(c, minlength=len(words)) for c in codes), kind="stable")
        rank = np.empty(len(often), np.int64)
        rank[often] = np.arange(len(often))
        for ids, counts, own in zip(self.ids, self.counts, codes):
            yield _row(schema, block=self.number, doc_ids=ids, counts=_pack(counts), codes=_pack(rank[own]))
        place = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(place, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else []:
            mine = mine[np.argsort(rank[mine])]
            some = [words[i] for i in mine]
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            yield _row(
                schema, block=self.number, bucket=int(place[mine[0]]), words=_squeezed(b"".join(some)), lengths=_pack(lengths),
                at=_pack(np.diff(rank[mine], prepend=0)),
            )


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    columns = []
    for field in schema:
        value = values.get(field.name)
        if isinstance(value, pa.Array):
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value).cast(field.type))
        else:
            columns.append(pa.array([value], field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _split(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    """Rows of documents ``(block, doc_ids, counts, codes)`` and of words ``(block, bucket, words, lengths, at)``.

    ``at`` holds the steps from each code to the next.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, schema = splitter(path), None
        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            if schema is None:
                schema = pa.schema([
                    ("block", pa.int64()), ("doc_ids", pa.list_(batch.schema.field(0).type)), ("counts", pa.binary()), ("codes", pa.binary()),
                    ("bucket", pa.int32()), ("words", pa.binary()), ("lengths", pa.binary()), ("at", pa.binary()),
                ])
            for piece in pieces(iter([batch]), 1, UNIT):
                if block.ids and block.size + piece.column(1).nbytes > BLOCK:
                    yield from block.rows(buckets, schema)
                    block = _Block(block.number + 1)
                block.add(split, piece)
        if block.ids:
            yield from block.rows(buckets, schema)

    return through(
        docs.select("doc_id", "text"), run,
        f"block long, doc_ids array<{kind}>, counts binary, codes binary, bucket int, words binary, lengths binary, at binary",
    )


def encoded_words(words: DataFrame, path: str = PATH) -> DataFrame:
    """``(block, at, sizes, ids)`` for rows of words ``(block, bucket, words, lengths, at)``.

    Rows are dealt by bucket and come bucket by bucket, so each distinct word is encoded
    once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path)
        now, known = None, {}
        for batch in batches:
            sizes, ids = [], []
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != now:
                    now, known = bucket, {}
                raw = _restored(batch.column("words")[i].as_py())
                ends = np.cumsum(_unpack(batch.column("lengths")[i].as_py())).tolist()
                mine = [raw[a:b].decode() for a, b in zip([0, *ends], ends)]
                new = [w for w in mine if w not in known]
                known.update(zip(new, split.encode_words(new)))
                lists = [known[w] for w in mine]
                sizes.append(_pack(np.fromiter(map(len, lists), np.int64, len(lists))))
                ids.append(_pack(np.fromiter(chain.from_iterable(lists), np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("at"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())],
                ["block", "at", "sizes", "ids"],
            )

    dealt = words.select("block", "bucket", "words", "lengths", "at").repartition("bucket").sortWithinPartitions("bucket")
    return through(dealt, run, "block long, at binary, sizes binary, ids binary")


def _taken(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches ``flat[first : first + sizes]``, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)]


def encode(docs: DataFrame, path: str = PATH, digested: bool = False) -> DataFrame:
    """``(doc_id, ids)``, one row per row of ``docs``; null and empty texts have no ids.

    Special strings inside texts become their tokens; none is added.  Ids of documents may
    be of any type, null or repeated, and other columns are not read.  With ``digested``,
    the number and hashes that ``digests`` gives take the place of the ids, as they are put
    together.
    """
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = materialize(_split(docs, path, buckets), "bpe-blocks")
    texts = table.where("doc_ids IS NOT NULL").select("block", "doc_ids", "counts", "codes")
    entries = encoded_words(table.where("words IS NOT NULL"), path)
    kind = dict(docs.dtypes)["doc_id"]

    def together(docs_of: pa.Table, words_of: pa.Table) -> pa.Table:
        at = [np.cumsum(_unpack(x)) for x in words_of.column("at").to_pylist()]
        each = [_unpack(x) for x in words_of.column("sizes").to_pylist()]
        flat = [_unpack(x) for x in words_of.column("ids").to_pylist()]
        at, each, flat = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, each, flat))
        first, sizes = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        first[at], sizes[at] = np.cumsum(each) - each, each
        digest = _digester(path) if digested else None
        tables = []
        for i in range(docs_of.num_rows):
            codes, counts = _unpack(docs_of.column("codes")[i].as_py()), _unpack(docs_of.column("counts")[i].as_py())
            ids = _taken(flat, first[codes], sizes[codes]).astype(np.int32)
            words = np.concatenate(([0], np.cumsum(sizes[codes])))
            ends = words[np.concatenate(([0], np.cumsum(counts)))]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            own = {"doc_id": docs_of.column("doc_ids")[i].values}
            tables.append(pa.table(own | (digest(lists) if digested else {"ids": lists})))
        return pa.concat_tables(tables)

    def assemble(key, docs_of, words_of):
        table = together(docs_of, words_of)
        give_back()
        return table

    hand_small(docs.sparkSession)
    found = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digested else "ids array<int>"
    return texts.groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(assemble, f"doc_id {kind}, {found}")


def pieces_of(path: str = PATH) -> list[bytes]:
    """The bytes of every id of the vocabulary."""
    tokenizer = splitter(path).tokenizer
    byte = byte_signs()
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    names = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    return [
        b"" if i not in names else added[i].encode() if i in added else bytes(byte[c] for c in names[i])
        for i in range(max(names) + 1)
    ]


def _joined(pieces: pa.Array, lists: pa.Array) -> list[bytes]:
    """For each list of ids, the pieces they stand for, joined."""
    flat = lists.flatten()
    if not len(flat):
        return [b""] * len(lists)
    joined = pieces.take(flat)
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
    at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset :][ends]
    data = memoryview(joined.buffers()[2])
    return [bytes(data[a:b]) for a, b in zip(at[:-1], at[1:])]


def _texts_of(pieces: pa.Array, lists: pa.Array) -> list[str]:
    return [t.decode("utf-8", "replace") for t in _joined(pieces, lists)]


def _digester(path: str):
    """Numbers and hashes of lists of ids and of the texts they decode to."""
    pieces = pa.array(pieces_of(path), pa.large_binary())
    decimal = pa.array([f"{i},".encode() for i in range(len(pieces))], pa.large_binary())

    def digest(lists: pa.Array) -> dict[str, pa.Array]:
        ids, texts = [], []
        for start in range(0, len(lists), ROWS):
            part = lists.slice(start, ROWS)
            ids += [hashlib.sha256(t[:-1]).hexdigest() for t in _joined(decimal, part)]
            texts += [hashlib.sha256(t.encode()).hexdigest() for t in _texts_of(pieces, part)]
        return {
            "n_tokens": lists.value_lengths().cast(pa.int64()), "ids_sha256": pa.array(ids, pa.string()),
            "decoded_sha256": pa.array(texts, pa.string()),
        }

    return digest


def decode(encoded: DataFrame, path: str = PATH) -> DataFrame:
    """``encoded`` with the decoded ``text`` added; bytes that are no UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(pieces_of(path), pa.large_binary())
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.slice(start, ROWS)
                texts = pa.array(_texts_of(pieces, part.column("ids")), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "text"])

    return through(encoded, run, ", ".join([*(f"`{n}` {t}" for n, t in encoded.dtypes), "text string"]))


def digests(docs: DataFrame, path: str = PATH) -> DataFrame:
    """Number and hash of the ids of each text, and hash of the text they decode to."""
    return encode(docs, path, digested=True)
