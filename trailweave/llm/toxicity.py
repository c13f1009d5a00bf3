"""Toxicity of texts, read through a noisy channel.

Writers hide words by leetspeak (``1d10t``), spacing (``i d i o t``) and repetition
(``idiooot``).  A suspicious string is a lattice: each observed character may stand for
itself or for the letters it imitates, a separator may be silent or a word end, and a
repeated letter may be silent.  Viterbi decoding under a character trigram model of the
whole corpus picks the most likely reading, and the words of the restored text are scored
next to those of the text itself.

The scorer counts, over labelled rows that are not held out, in how many distinct toxic
and clean texts each word and each five-letter word beginning occurs; a feature's
toxicity is its smoothed share of toxic texts, and a text has the largest of its features'.
Labels, language, source and ids are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.batches import filter_rows, pieces, summed, texts_of, through
from trailweave.llm.shingles import _LOWER

#: Labelled rows that a model is fitted on, chosen by hash of their id.
LABELLED_ROWS = 20_000
STEM = 5
#: Words and readings that a task keeps, and features counted before they leave the task.
KNOWN, COUNTED = 50_000, 200_000
#: Strength of the prior, in toxic texts of the sample and as a share of them.
PRIOR_ROWS, PRIOR_SHARE = 16, 0.07
LEAST_ROWS, LEAST_SHARE = 5, 0.15

# Letters that a sign imitates.
IMITATED = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
}
SEPARATORS = " .-_*/~\t\n\r"
# Signs without width, which part letters unseen.
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_SUBSTITUTED, _SILENT, _REPEATED, _DOUBLED = -1.5, -0.3, -0.1, -5.0

WORD = re.compile(r"[^\W\d_]+")
MIXED = re.compile(
    r"(?<![^\W_])(?:[^\W\d_]++[01345789@$!|+]|[01345789@$!|+]++[^\W\d_])[^\W_@$!|+]*+(?:[@$!|+]++[^\W_]++)*+[+$]?"
)
# Two or more single letters, digits or signs that imitate letters, with runs of separators.
SPACED = re.compile(rf"(?<![^\W_])(?:(?:[^\W_]|[@$!|+])[{re.escape(SEPARATORS)}]++)+(?:[^\W_]|[@$!|+])(?![^\W_])")
DOUBLE = re.compile(r"(.)\1")

_CLASSES = 28  # other bytes: word end; a-z; bytes of other letters
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27


def trigram_counts(docs: DataFrame) -> list[int]:
    """Counts of character-class trigrams over all texts: 28^3 cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CLASSES**3, np.int64)
        for batch in pieces(batches):
            data = "\n".join(texts_of(batch)).encode()
            c = _CLASS[_LOWER[np.frombuffer(data, np.uint8)]]
            if len(c) > 2:
                total += np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    return summed(docs, run, _CLASSES**3)


class Decoder:
    """Viterbi decoding of character lattices under a trigram model."""

    def __init__(self, counts: list[int]):
        n = np.array(counts, float).reshape(_CLASSES, _CLASSES, _CLASSES)
        one = n.sum((0, 1)) + 1.0
        two = n.sum(0) + 5.0 * one / one.sum()
        two /= two.sum(1, keepdims=True)
        three = n + 5.0 * two[None]
        self.log = np.log(three / three.sum(2, keepdims=True)).tolist()
        self.known: dict[str, str] = {}

    @staticmethod
    def _class(letter: str) -> int:
        if letter == " ":
            return 0
        return ord(letter) - 96 if "a" <= letter <= "z" else 27

    def decode(self, seen: str) -> str:
        """The most likely reading of a lower-case string; ties go to the first in order."""
        found = self.known.get(seen)
        if found is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            found = self.known[seen] = self._viterbi(seen)
        return found

    def _viterbi(self, seen: str) -> str:
        # State: classes of the last two letters and the last letter; value: score, chain.
        states = {(0, 0, ""): (0.0, None)}
        for at, sign in enumerate(seen):
            back = ahead = 0
            while back < 2 and at > back and seen[at - back - 1] == sign:
                back += 1
            while ahead < 2 and at + ahead + 1 < len(seen) and seen[at + ahead + 1] == sign:
                ahead += 1
            repeated = _REPEATED if back + ahead >= 2 else _DOUBLED
            options = [(letter, _SUBSTITUTED) for letter in IMITATED.get(sign, "")]
            if sign.isalpha():
                options.append((sign, 0.0))
            elif sign in SEPARATORS:
                options.append((" ", 0.0))
            elif not options:
                options.append((" ", _SUBSTITUTED))
            silent = _SILENT if sign in SEPARATORS else None
            after: dict = {}
            for (a, b, last), (score, chain) in states.items():
                ways = [(a, b, last, score + silent, chain)] if silent is not None else []
                if back and last and (last == sign or last in IMITATED.get(sign, "")):
                    ways.append((a, b, last, score + repeated, chain))
                for letter, cost in options:
                    c = self._class(letter)
                    ways.append((b, c, letter, score + cost + self.log[a][b][c], (letter, chain)))
                for a2, b2, l2, value, link in ways:
                    best = after.get((a2, b2, l2))
                    if best is None or value > best[0]:
                        after[a2, b2, l2] = (value, link)
            states = after
        (_, chain) = max(
            ((s + self.log[a][b][0], c) for (a, b, _), (s, c) in states.items()), key=lambda x: x[0]
        )
        letters = []
        while chain:
            letters.append(chain[0])
            chain = chain[1]
        return "".join(reversed(letters))


def suspicious(low: str) -> list[str]:
    """Strings of a lower-case text that may hide words by signs or spacing."""
    mixed = (m.rstrip("!") for m in MIXED.findall(low))
    spaced = SPACED.findall(low)
    # A sign at the end may also end the sentence.
    spaced += [s for m in spaced if m[-1] == "!" and len(s := m.rstrip("!" + SEPARATORS)) > 1]
    return [m for m in mixed if not m.isalpha()] + spaced


def words_and_readings(text: str, decoder: Decoder) -> tuple[set[str], set[str]]:
    """Distinct words of a whole text, and words of its restored strings."""
    low = text.lower()
    if any(sign in low for sign in UNSEEN):
        low = low.translate(dict.fromkeys(map(ord, UNSEEN)))
    words = set(WORD.findall(low))
    restored: set[str] = set()
    for s in suspicious(low):
        restored.update(decoder.decode(s).split())
    for w in words:
        if DOUBLE.search(w):
            restored.update(decoder.decode(w).split())
    return words, restored - words


def features(words: set[str]) -> set[str]:
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


@dataclass
class Model:
    """Trigram counts, toxicity of features, and the score of a text without any."""

    counts: list[int]
    weights: dict[str, float]
    floor: float

    def scorer(self):
        decoder, weights, floor = Decoder(self.counts), self.weights, self.floor
        known: dict[str, float] = {}

        def value(word: str) -> float:
            found = known.get(word)
            if found is None:
                if len(known) > KNOWN:
                    known.clear()
                found = max(weights.get(word, 0.0), weights.get(word[:STEM] + "*", 0.0) if len(word) > STEM else 0.0)
                known[word] = found
            return found

        def score(text: str) -> tuple[float, list[str]]:
            words, restored = words_and_readings(text, decoder)
            best = max(map(value, words), default=0.0)
            hidden = sorted(w for w in restored if value(w) > 0)
            return max([floor, best, *map(value, hidden)]), hidden

        return score


def held_out(doc_id="doc_id"):
    return F.expr(f"crc32(CAST(coalesce(CAST({doc_id} AS STRING), '') AS BINARY)) % 4 = 2")


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows that are not held out.

    Null labels and ids do not take part; a document labelled both ways counts as toxic;
    equal texts count once.  Without labelled rows the model scores every text alike.
    """
    counts = trigram_counts(docs)
    sample = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # The sample is bounded by ``rows``: about a quarter of a megabyte.
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("text").agg(
        F.max("toxic").alias("toxic")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(counts)
        toxic, clean, texts = Counter(), Counter(), [0, 0]

        def counted() -> pa.RecordBatch:
            names = list(toxic.keys() | clean.keys())
            return pa.RecordBatch.from_arrays(
                [pa.array([None, *names], pa.string()), pa.array([texts[1], *(toxic[x] for x in names)], pa.int64()),
                 pa.array([texts[0], *(clean[x] for x in names)], pa.int64())],
                ["feature", "toxic", "clean"],
            )

        for batch in pieces(batches):
            for text, label in zip(texts_of(batch), batch.column(1).to_pylist()):
                words, restored = words_and_readings(text, decoder)
                (toxic if label else clean).update(features(words | restored))
                texts[1 if label else 0] += 1
            if len(toxic) + len(clean) > COUNTED:
                yield counted()
                toxic, clean, texts = Counter(), Counter(), [0, 0]
        yield counted()

    seen = through(labelled, run, "feature string, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    ).where(f"toxic >= {LEAST_ROWS} OR feature IS NULL")
    found = {r.feature: (r.toxic, r.clean) for r in seen.collect()}  # bounded by the sample
    bad, good = found.pop(None, (0, 0))
    share = bad / (bad + good) if bad + good else 0.0
    prior = max(PRIOR_ROWS, PRIOR_SHARE * bad)
    weights = {f: (a + prior * share) / (a + b + prior) for f, (a, b) in found.items()}
    return Model(counts, {f: w for f, w in weights.items() if w > max(LEAST_SHARE, share)}, share * 0.3)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, hidden)``, one row per row; null and empty texts have the least score.

    ``hidden`` lists the toxic words that only the restored text shows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in pieces(batches, 1):
            found = [score(t) for t in texts_of(batch, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.float64()),
                 pa.array([f[1] for f in found], pa.list_(pa.string()))],
                ["doc_id", "score", "hidden"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return through(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, hidden array<string>")


def reject(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``."""

    def start():
        score = model.scorer()
        return lambda texts: [score(t)[0] < threshold for t in texts]

    return filter_rows(docs, start)
