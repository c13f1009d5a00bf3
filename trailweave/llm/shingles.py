"""Word shingles of whole texts as 64-bit hashes, computed on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once inside a task; a longer text is handled alone.
UNIT_BYTES = 4 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def units(texts: pa.Array, size: int = UNIT_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
        yield start, stop
        start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def _lowered(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased on the bytes; Arrow's own kernel damages long sliced arrays."""
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = _LOWER[np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(low))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and words per text."""
    plain = pc.ascii_trim_whitespace(_lowered(pc.fill_null(texts.cast(pa.large_string()), "")))
    lists = pc.ascii_split_whitespace(plain)
    offsets = lists.offsets.to_numpy()
    words = lists.values.dictionary_encode()
    table = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) for w in words.dictionary.cast(pa.large_binary()).to_pylist()),
        np.uint64, len(words.dictionary),
    )
    hashes = table[words.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)
    counts = np.diff(offsets)
    empty = pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # a text without words splits into one empty word
        keep = np.repeat(~empty, counts)
        hashes, counts = hashes[keep], np.where(empty, 0, counts)
    return hashes, counts


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    hashes, counts = word_hashes(texts)
    seeded = hashes.copy()
    for k in range(1, words):
        seeded[: len(hashes) - k] = mixed(seeded[: len(hashes) - k] * _SPREAD + hashes[k:])
    result, at = [], 0
    for n in counts.tolist():
        if n >= words:
            result.append(np.unique(seeded[at : at + n - words + 1]))
        elif n:
            whole = np.uint64(xxhash.xxh3_64_intdigest(hashes[at : at + n].tobytes(), n))
            result.append(np.array([whole], np.uint64))
        else:
            result.append(np.empty(0, np.uint64))
        at += n
    return result
