"""Token counts by a finite-state transducer.

A byte-level BPE tokenizer reads a text from left to right as a deterministic transducer.
Its state holds the kind of word it is in and, for the last bytes, which token ends at
each place if the text ended there; what it emits on a character is by how many tokens the
count changes, which may be negative where merges join what stood apart.  Two tokens may
stand side by side when no merge across their border would come before the merges that
make them, so the state after a byte follows from the states before.  States and
transitions are compiled when first met and kept by the worker process.

Texts are cut into chunks that all step at once.  A space after another character resets
the transducer, so a chunk's map from entry state to exit state is constant from its first
reset on: all chunks run from there first, and a scan along the chunks then runs the short
heads from the exit states that reach them, and adds up the counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from trailweave.llm.batches import pieces, texts_of
from trailweave.llm.bpe import pieces_of
from trailweave.llm.pretokens import EDGE, LETTER, LONG, SHORT, SPACE, Splitter, splitter

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Code points of a chunk, and compiled transitions that the tables have room for.
CHUNK = 256
MOST_CELLS = 36_000_000
#: Code points without a reset after which a text is merged word by word.
LONGEST = 4096
_NEVER = 1 << 40


class Merges:
    """Which tokens end at the last bytes of a word, from its bytes one after another."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        names = splitter(path).tokenizer.get_vocab(with_added_tokens=False)
        bytes_of = pieces_of(path)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.parts: dict[bytes, tuple[int, bytes, bytes]] = {}
        for rank, pair in enumerate(merges):
            left, right = (bytes_of[names[x]] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[left, right] = rank
            self.parts.setdefault(left + right, (rank, left, right))
        self.tokens = {bytes([b]) for b in range(256)} | set(self.parts)
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t))}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._spines: dict[tuple[bytes, int], list[tuple[bytes, int, int]]] = {}

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The pieces at one end of a token, with the ranks that make and consume them."""
        known = self._spines.get((token, side))
        if known is not None:
            return known
        whole, found, death = token, [], _NEVER
        while True:
            birth, *parts = self.parts.get(token, (-1, None, None))
            found.append((token, birth, death))
            if birth < 0:
                self._spines[whole, side] = found
                return found
            token, death = parts[side], birth

    def fit(self, left: bytes, right: bytes) -> bool:
        """Whether merging ``left + right`` leaves the two tokens as they are."""
        known = self._pairs.get((left, right))
        if known is None:
            known = self._pairs[left, right] = not any(
                (m := self.rank.get((a, b))) is not None
                and m < dies_a and m <= dies_b and born_a < dies_b and born_b < dies_a
                for a, born_a, dies_a in self._spine(left, 1)
                for b, born_b, dies_b in self._spine(right, 0)
            )
        return known

    #: State of an empty word: the bytes that matter, and for each border in or around them
    #: the token that ends there and the count there, relative to the count at the end.
    START = (b"", ((b"", 0),))

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after one more byte, and the change of the count."""
        tail, ends = state
        tail += bytes([byte])
        for k, end in enumerate(ends):
            if end is not None and tail[k:] in self.tokens and (not end[0] or self.fit(end[0], tail[k:])):
                token, change = tail[k:], end[1] + 1
                break
        keep = next(k for k in range(len(tail) + 1) if tail[k:] in self.prefixes)
        shifted = tuple(
            (end[0], end[1] - change) if end is not None and tail[k:] in self.prefixes else None
            for k, end in enumerate(ends) if k >= keep
        )
        return (tail[keep:], (*shifted, (token, 0))), change

    def steps(self, state: tuple, data: bytes) -> tuple[tuple, int]:
        total = 0
        for byte in data:
            state, change = self.step(state, byte)
            total += change
        return state, total


class _Full(Exception):
    """The tables have no room for more states or symbols."""


class Transducer:
    """Compiled transitions of the tokenizer over code points."""

    def __init__(self, path: str):
        self.splitter: Splitter = splitter(path)
        self.merges = Merges(path)
        self._reset()

    def _reset(self) -> None:
        self.width, self.room = 128, 4096
        self.names: list[tuple] = [("edge",)]
        self.number: dict[tuple, int] = {("edge",): 0}
        self.letters: list[tuple[str, int]] = []
        self.symbol = np.full(0x110000, -1, np.int32)
        self.next = np.full(self.room * self.width, -1, np.int32)
        self.emit = np.zeros(self.room * self.width, np.int16)
        self.merges._pairs.clear()

    def symbols(self, points: np.ndarray) -> np.ndarray:
        found = self.symbol[points]
        if (found < 0).any():
            for p in np.unique(points[found < 0]).tolist():
                self.symbol[p] = len(self.letters)
                self.letters.append((chr(p), int(self.splitter.classes(np.array([p]))[0])))
            while len(self.letters) > self.width:
                self._grow(self.room, 2 * self.width)
            found = self.symbol[points]
        return found

    def _grow(self, room: int, width: int) -> None:
        if room * width > MOST_CELLS:
            raise _Full
        for name, fill in (("next", -1), ("emit", 0)):
            old = getattr(self, name).reshape(self.room, self.width)
            new = np.full((room, width), fill, old.dtype)
            new[: self.room, : self.width] = old
            setattr(self, name, new.reshape(-1))
        self.room, self.width = room, width

    def _begin(self, letter: str, kind: int) -> tuple[tuple, int]:
        word, n = self.merges.steps(Merges.START, letter.encode())
        if kind >= SPACE:
            return ("white", Merges.START, letter, word, n), n
        return ("run", kind, word, letter == "'"), n

    def _move(self, state: tuple, letter: str, kind: int) -> tuple[tuple, int]:
        name = state[0]
        if name == "quote":  # an apostrophe and a letter that may begin a contraction
            _, first, word = state
            if first + letter in LONG:
                return ("edge",), self.merges.steps(Merges.START, ("'" + first + letter).encode())[1] - 2
            state, name = ("run", LETTER, word, False), "run"
        if name == "run":
            _, of, word, quote = state
            if quote and letter in SHORT:
                return ("edge",), self.merges.steps(Merges.START, ("'" + letter).encode())[1] - 1
            if quote and any(letter == x[0] for x in LONG):
                word, n = self.merges.steps(Merges.START, letter.encode())
                return ("quote", letter, word), n
            if kind == of:
                word, n = self.merges.steps(word, letter.encode())
                return ("run", of, word, False), n
        if name == "white":
            _, _, last, word, n = state
            if kind >= SPACE:
                longer, more = self.merges.steps(word, letter.encode())
                return ("white", word, letter, longer, more), more
            # The last white character leaves its run.
            if last == " ":
                word, m = self.merges.steps(Merges.START, (" " + letter).encode())
                return ("run", kind, word, False), m - n
            alone = self.merges.steps(Merges.START, last.encode())[1]
            state, m = self._begin(letter, kind)
            return state, m + alone - n
        return self._begin(letter, kind)

    def compile(self, cells: np.ndarray) -> None:
        for cell in np.unique(cells).tolist():
            at, symbol = divmod(cell, self.width)
            state, change = self._move(self.names[at], *self.letters[symbol])
            if state[0] == "white":
                # What the run was before its last character is in the counts already.
                state = ("white", None, *state[2:])
            to = self.number.get(state)
            if to is None:
                to = self.number[state] = len(self.names)
                self.names.append(state)
            self.next[cell], self.emit[cell] = to, change

    def run(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, entry: np.ndarray):
        """Exit states and counts of lanes ``[begin, end)`` from their entry states, all at once."""
        order = np.argsort(begin - end, kind="stable")  # longest first
        at, size = begin[order], (end - begin)[order]
        state, count = entry[order].astype(np.int64), np.zeros(len(order), np.int64)
        active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
        for k, live in enumerate(active.tolist()):
            while len(self.names) + live > self.room:
                self._grow(2 * self.room, self.width)
            cells = state[:live] * self.width + symbols[at[:live] + k]
            to = self.next[cells]
            if (to < 0).any():
                self.compile(cells[to < 0])
                to = self.next[cells]
            state[:live] = to
            count[:live] += self.emit[cells]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each whole text."""
        found = np.zeros(len(texts), np.int64)
        unbroken = np.array([self._longest(t) > LONGEST for t in texts], bool)
        for some, count in ((np.flatnonzero(unbroken), self._merged), (np.flatnonzero(~unbroken), self._fitting)):
            if len(some):
                found[some] = count([texts[i] for i in some])
        return found

    def _longest(self, text: str) -> int:
        """Code points of the longest stretch without a reset, or a bound that is small enough."""
        if len(text) <= LONGEST:
            return len(text)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        resets = np.flatnonzero((points[1:] == 0x20) & (self.splitter.classes(points[:-1]) < SPACE)) + 1
        return int(np.diff(np.concatenate(([0], resets, [len(points)]))).max())

    def _merged(self, texts: list[str]) -> np.ndarray:
        """Counts by merging every word of the texts."""
        found = []
        for text in texts:
            words = self.splitter.words([text])[0].dictionary_encode()
            sizes = np.array([len(x) for x in self.splitter.encode_words(words.dictionary.to_pylist())], np.int64)
            found.append(int(sizes[words.indices.to_numpy()].sum()) if len(words) else 0)
        return np.array(found, np.int64)

    def _fitting(self, texts: list[str]) -> np.ndarray:
        """Counts by the transducer, in smaller parts and with new tables where these are full."""
        try:
            return self._run_texts(texts)
        except _Full:
            self._reset()
            if len(texts) == 1:
                return self._merged(texts)
            half = len(texts) // 2
            return np.concatenate((self._fitting(texts[:half]), self._fitting(texts[half:])))

    def _run_texts(self, texts: list[str]) -> np.ndarray:
        segments, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            at = 0
            for p, n in self.splitter._specials(text):
                segments.append(text[at:p])
                owner.append(i)
                extra[i] += 1
                at = p + n
            segments.append(text[at:] if at else text)
            owner.append(i)
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        if not len(points):
            return extra
        symbols, kind = self.symbols(points), self.splitter.classes(points)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        start = np.cumsum(size) - size
        chunks = -(-size // CHUNK)
        of = np.repeat(np.arange(len(size)), chunks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begin = start[of] + nth * CHUNK
        end = np.minimum(begin + CHUNK, (start + size)[of])
        # A space after another character resets the transducer.
        resets = np.flatnonzero((kind == SPACE) & (np.concatenate(([EDGE], kind[:-1])) < SPACE))
        first = np.append(resets, len(points))[np.searchsorted(resets, begin)]
        body = np.where(nth == 0, begin, np.minimum(first, end))
        exits, total = self.run(symbols, body, end, np.zeros(len(of), np.int64))
        known = (body < end) | (nth == 0)
        todo = np.flatnonzero((nth > 0) & (body > begin))
        while len(todo):
            # Each round composes every chunk whose entry state is settled with its head.
            now = todo[known[todo - 1]]
            state, count = self.run(symbols, begin[now], body[now], exits[now - 1])
            total[now] += count
            whole = body[now] == end[now]
            exits[now[whole]] = state[whole]
            known[now] = True
            todo = todo[~np.isin(todo, now)]
        per_segment = np.zeros(len(size), np.int64)
        np.add.at(per_segment, of, total)
        np.add.at(extra, np.array(owner), per_segment)
        return extra


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def token_counts(docs: DataFrame, path: str = PATH, limit: int = 512) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens.  Special strings inside texts count as
    their tokens; none is added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in pieces(batches, 1):
            texts = texts_of(batch, 1)
            counts = machine.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts),
                 pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
