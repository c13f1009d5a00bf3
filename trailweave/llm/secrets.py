"""Secret spans: base patterns, and strings that look random to two Markov models.

The base patterns label the samples: what they match is random, all other characters of
the corpus are ordinary.  Two first-order models over 67 characters (and the outside) are
counted over all texts, and what base spans leave of a run of such characters is a secret
when it is more likely under the random model by a margin in total and for each character.
Spans are in code points of the whole text, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.batches import pieces, rewrite_rows, summed, texts_of, through

# Fixed patterns, in the order of their kinds.
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")

#: Runs judged by the models, and by how much they must look random.
LEAST = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
MARGIN, MARGIN_PER_CHARACTER = 16.0, 1.0

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIDE = len(_ALPHABET) + 1
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(1, _SIDE)

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _until(spans: list[Span], at: int, end: int) -> Iterator[Span]:
    while at < len(spans) and spans[at][0] < end:
        yield spans[at]
        at += 1


def _pairs(data: bytes) -> np.ndarray:
    codes = _CODE[np.frombuffer(data, np.uint8)]
    return codes[:-1] * _SIDE + codes[1:]


@dataclass
class Model:
    """Log-likelihood ratio of each character pair, random over ordinary."""

    ratio: np.ndarray

    def score(self, run: str) -> float:
        return float(self.ratio[_pairs(run.encode())].sum())

    def spans(self, text: str) -> list[Span]:
        """Base spans, and pieces of runs beside them that look random, by start and kind."""
        found = base_spans(text)
        covered, at = found[:], 0
        for m in RUN.finditer(text):
            start, end = m.span()
            while at < len(covered) and covered[at][2] <= start:
                at += 1
            for s, _, e in [*_until(covered, at, end), (end, 3, end)]:
                if s - start >= LEAST:
                    llr = self.score(text[start:s])
                    if llr >= MARGIN and llr >= MARGIN_PER_CHARACTER * (s - start):
                        found.append((start, 3, s))
                start = max(start, e)
        return sorted(found)


def fit(docs: DataFrame) -> Model:
    """Count both models over all texts; without samples a model is uniform."""
    cells = _SIDE * _SIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * cells, np.int64)
        for batch in pieces(batches):
            texts = texts_of(batch)
            whole = _pairs("\n".join(texts).encode() + b"\n")
            if len(whole):
                n[:cells] += np.bincount(whole, minlength=cells)
            secret = [t[s:e] for t in texts for s, _, e in base_spans(t)]
            if secret:
                values = [re.split(r"[:=\s\"']+", v)[-1] for v in secret]
                random = np.bincount(_pairs("\n".join(values).encode() + b"\n"), minlength=cells)
                n[cells:] += random
                n[:cells] = np.maximum(n[:cells] - random, 0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["cell", "n"])

    both = np.array(summed(docs, run, 2 * cells), float).reshape(2, _SIDE, _SIDE)[:, 1:, 1:]
    flat = 1.0 / (_SIDE - 1)
    ordinary, random = ((m + 10 * flat) / (m.sum(1, keepdims=True) + 10) for m in both)
    # Secrets of other alphabets than the samples': half of the random model is uniform.
    ratio = np.zeros((_SIDE, _SIDE))
    ratio[1:, 1:] = np.log(0.5 * random + 0.5 * flat) - np.log(ordinary)
    return Model(np.clip(ratio, -6, 6).reshape(-1))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, spans)`` with spans ``(kind, start, end)``, one row per row of ``docs``.

    Null and empty texts have no spans; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            spans = [
                [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in model.spans(t)] for t in texts_of(batch, 1)
            ]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return through(
        docs.select("doc_id", "text"), run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>"
    )


def redacted(text: str, spans: list[Span]) -> str:
    """Replace spans by ``[SECRET]``; spans that overlap are replaced together."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all their rows and columns, and secrets in the texts replaced."""

    def start():
        def change(texts: list[str]) -> tuple[None, list[str]]:
            return None, [redacted(t, model.spans(t)) for t in texts]

        return change

    return rewrite_rows(docs, start)


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash of the base spans and the list of all spans, from ``find``."""
    listed = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    count = {f"n_{k}": F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS LONG)") for k in KINDS[:3]}
    base = listed.format("filter(spans, s -> s.kind <> 'markov')")
    return found.select(
        "doc_id", *[c.alias(n) for n, c in count.items()], F.expr(f"sha2({base}, 256)").alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"),
    )
