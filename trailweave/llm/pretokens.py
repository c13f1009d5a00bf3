"""Splitting whole texts as a byte-level tokenizer does before it merges.

The split is regular: contractions, runs of letters, of digits and of other signs, each
with one leading space, and runs of white space that leave their last character to what
follows.  Here it is a few comparisons of neighbouring character classes on arrays of
code points.  Which class a character has is asked of the tokenizer itself, once.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LETTER, DIGIT, SIGN, SPACE, WHITE, EDGE = 0, 1, 2, 3, 4, 5
#: Contractions that are words of their own after an apostrophe.
SHORT, LONG = "stmd", ("re", "ve", "ll")


class Splitter:
    """Word borders of texts under the tokenizer of a file; for one task or worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = sorted(
            (t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=lambda s: (-len(s), s)
        )
        self._class = np.full(0x110000, 255, np.uint8)
        self._class[0x20] = SPACE
        self._added = {t.content: [i] for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self._merge = _merger(path)

    def classes(self, points: np.ndarray) -> np.ndarray:
        found = self._class[points]
        if (found == 255).any():
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[found == 255]).tolist():
                joined = [k for k, mate in ((LETTER, "a"), (DIGIT, "1"), (SIGN, "!")) if len(split(mate + chr(p))) == 1]
                self._class[p] = joined[0] if joined else WHITE
            found = self._class[points]
        return found

    def borders(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points, classes, text starts, and whether a word begins at each point."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        kind = self.classes(points)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(size) - size
        before = np.concatenate(([EDGE], kind[:-1])).astype(np.uint8) if len(kind) else kind
        after = np.concatenate((kind[1:], [EDGE])).astype(np.uint8) if len(kind) else kind
        if not len(kind):
            return points, kind, starts, np.zeros(0, bool)
        edges = starts[size > 0]
        before[edges] = EDGE
        after[edges[1:] - 1] = EDGE
        whole = [
            (int(starts[i]) + at, int(starts[i]) + at + n)
            for i, t in enumerate(texts) for at, n in self._specials(t)
        ]
        for a, b in whole:
            before[a] = EDGE
            if b < len(kind):
                before[b] = EDGE
            after[b - 1] = EDGE
            if a:
                after[a - 1] = EDGE
        white = kind >= SPACE
        white_before = (before == SPACE) | (before == WHITE)
        begins = np.where(
            white,
            ~white_before | (after < SPACE),
            (before != kind) & (before != SPACE),
        )
        begins |= before == EDGE
        quotes = np.flatnonzero((points == 39) & begins & (after == LETTER))
        for q in quotes.tolist():
            one = chr(points[q + 1])
            if one in SHORT:
                end = q + 2
            elif after[q + 1] != EDGE and one + chr(points[q + 2]) in LONG:
                end = q + 3
            else:
                continue
            begins[q + 1 : end] = False
            if end < len(begins):
                begins[end] = True
        for a, b in whole:
            begins[a + 1 : b] = False
        return points, kind, starts, begins

    def _specials(self, text: str) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        if any(s in text for s in self.special):
            at = 0
            while at < len(text):
                hits = [(p, -len(s)) for s in self.special if (p := text.find(s, at)) >= 0]
                if not hits:
                    break
                p, n = min(hits)
                found.append((p, -n))
                at = p - n
        return found

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, as the tokenizer gives them."""
        if self._merge is None:
            return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        merge, added = self._merge, self._added
        return [added[w] if w in added else merge(w) for w in words]

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All words of the texts in order, as UTF-8, and the number in each text."""
        points, _, starts, begins = self.borders(texts)
        width = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
        at = np.flatnonzero(begins)
        ends = np.cumsum(width)
        offsets = np.concatenate((ends[at] - width[at], ends[-1:] if len(ends) else [0])).astype(np.int32)
        data = pa.py_buffer("".join(texts).encode())
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), data)
        return words, np.diff(np.searchsorted(at, np.append(starts, len(points))))


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [c for c in range(256) if c not in printable]
    return {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(others)}


def _merger(path: str):
    """A function from a word to its ids, several times as fast as the tokenizer; None where it may differ.

    It holds for byte-level pair merging without options whose ids ascend in the order of
    merging, so that the vocabulary is the table of merges.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, signs = whole["model"], byte_signs()
    options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or whole.get("normalizer") or any(model.get(o) for o in options):
        return None
    vocabulary = {k: v for k, v in model["vocab"].items() if all(c in signs for c in k)}
    merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if len({v for v in vocabulary.values()} | {None}) != len(vocabulary) + 1 or None in merged or merged != sorted(merged):
        return None
    ranks = {bytes(signs[c] for c in k): v for k, v in vocabulary.items() if len(k) == 1 or v >= merged[0]}
    if sum(len(k) == 1 for k in ranks) != 256 or any(v >= merged[0] for k, v in ranks.items() if len(k) == 1):
        return None
    kept = set(merged)
    ranks = {k: v for k, v in ranks.items() if len(k) == 1 or v in kept}
    return tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_splitters: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    """The splitter of a file; a worker process keeps it between tasks."""
    if path not in _splitters:
        _splitters[path] = Splitter(path)
    return _splitters[path]
