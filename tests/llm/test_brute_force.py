"""Decoder, secret models, mixing positions and pipeline stages against independent forms of themselves."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trailweave.llm import mixing, near_dups, secrets, toxicity

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "so") for b in ("n", "r", "st", "la", "ve")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def readings(seen, log):
    """All ways through the lattice of a string: ``(score, letters)``, one sign after another."""

    def kind(letter):
        return 0 if letter == " " else ord(letter) - 96 if "a" <= letter <= "z" else 27

    def go(at, a, b, last, score, letters):
        if at == len(seen):
            yield score + log[a][b][0], letters
            return
        sign = seen[at]
        same = [x == sign for x in seen]
        run = 1 + sum(1 for _ in itertools.takewhile(bool, reversed(same[:at]))) + sum(1 for _ in itertools.takewhile(bool, same[at + 1 :]))
        imitated = toxicity.IMITATED.get(sign, "")
        if sign in toxicity.SEPARATORS:
            yield from go(at + 1, a, b, last, score - 0.3, letters)
        if at and same[at - 1] and last and (last == sign or last in imitated):
            yield from go(at + 1, a, b, last, score - (0.1 if run >= 3 else 5.0), letters)
        own = [(x, -1.5) for x in imitated]
        if sign.isalpha():
            own.append((sign, 0.0))
        elif sign in toxicity.SEPARATORS:
            own.append((" ", 0.0))
        elif not own:
            own.append((" ", -1.5))
        for letter, cost in own:
            c = kind(letter)
            yield from go(at + 1, b, c, letter, score + cost + log[a][b][c], letters + letter)

    return go(0, 0, 0, "", 0.0, "")


def test_viterbi_finds_the_best_of_all_readings(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(sentence(rng, 200) + " idiot" * 5,) for _ in range(20)], "text string")
    decoder = toxicity.Decoder(toxicity.trigram_counts(docs))
    strings = ["1d10t", "i d i o t", "iidiot", "k4n", "l-o-r", "!d!0t", "mm1st"]
    strings += ["".join(rng.choice("idot10 -!xaa") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    for seen in strings:
        every = list(readings(seen, decoder.log))
        best = max(s for s, _ in every)
        assert any(letters == decoder.decode(seen) and math.isclose(s, best, abs_tol=1e-9) for s, letters in every), seen


@pytest.mark.parametrize("hidden", ["i\ti\td\ti\to\tt"[2:], "i/d/i/o/t", "i~d~i~o~t", "i\nd\ni\no\nt", "id​iot", "i​d​i​o​t", "i­diot"])
def test_separators_of_any_kind(spark, hidden):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        words = sentence(rng, 30).split() + (["idiot"] if i % 5 == 0 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    score = toxicity.fit(docs, marks).scorer()
    assert score(f"mila {hidden} kast")[0] >= 0.3
    assert score("mila k/a/n kast a/b 1~2")[0] < 0.3


def brute_base_spans(text):
    """Matches of the three patterns, found character by character."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def assign(i):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(name, i):
                continue
            j = i + len(name)
            # Every optional part may be taken or not; the first way in order that works wins.
            for quote in (1, 0):
                k = j + quote
                if quote and (j >= len(text) or text[j] not in "\"'"):
                    continue
                while k < len(text) and text[k] == " ":
                    k += 1
                if k >= len(text) or text[k] not in ":=":
                    continue
                k += 1
                while k < len(text) and text[k] == " ":
                    k += 1
                if k < len(text) and text[k] in "\"'":
                    k += 1
                end = k
                while end < len(text) and text[end] in value:
                    end += 1
                if end > k:
                    return end, end - k >= 8
        return None

    def plain(start, letters, least):
        def match(i):
            if not text.startswith(start, i):
                return None
            end = i + len(start)
            while end < len(text) and text[end] in letters:
                end += 1
            return (end, end - i >= least) if end > i + len(start) else None
        return match

    upper = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    found = []
    for kind, match in enumerate((assign, plain("AKIA", upper, 16), plain("", set("0123456789abcdef"), 32))):
        i = 0
        while i < len(text):
            hit = match(i)
            if hit is None:
                i += 1
                continue
            if hit[1]:
                found.append((i, kind, hit[0]))
            i = hit[0]
    return sorted(found)


def test_base_spans_equal_a_scan_by_character():
    rng = random.Random(4)
    parts = [
        "password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "  ", "'", '"', "abcdefgh", "hunter2", "AKIA", "AKIAABCD",
        "0123456789abcdef", "deadbeef" * 4, "-", "é", "ſ", "\n", "XY12", ".",
    ]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert secrets.base_spans(text) == brute_base_spans(text), text


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_markov_ratio_and_held_out_accuracy(spark):
    """The ratio by plain counting; random strings and identifiers that were not counted are told apart."""
    rng = random.Random(6)

    def name():
        style = rng.randrange(3)
        some = [rng.choice(WORDS) for _ in range(rng.randint(3, 6))]
        return "_".join(some) if style == 0 else "".join(w.title() for w in some) if style == 1 else "/".join(some)

    def key(n):
        return "".join(rng.choices(LETTERS, k=n))

    texts = [f"{sentence(rng, 30)} {name()} {name()} secret={key(40)} x" for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    model = secrets.fit(docs)
    whole, random_ = Counter(), Counter()
    side = set(LETTERS + "+/_=-")
    for t in texts:
        whole.update(zip(t, t[1:]))
        for s, _, e in secrets.base_spans(t):
            value = re.split(r"[:=\s\"']+", t[s:e])[-1]
            random_.update(zip(value, value[1:]))
    for a, b in random_:
        whole[a, b] = max(whole[a, b] - random_[a, b], 0)

    def chance(counts, a, b):
        total = sum(counts[a, x] for x in side)
        return (counts[a, b] + 10 / 67) / (total + 10)

    def ratio(run):
        pairs = [math.log(0.5 * chance(random_, a, b) + 0.5 / 67) - math.log(chance(whole, a, b)) for a, b in zip(run, run[1:])]
        return sum(min(6.0, max(-6.0, p)) for p in pairs)

    for run in ("q9Zx7Kp2Lm4Vb8Nc", "kan_lost_mila_nev", "deadbeefKanLostMila"):
        assert model.score(run) == pytest.approx(ratio(run))
    hidden = [key(rng.randint(20, 40)) for _ in range(300)]
    plain = [n for n in (name() for _ in range(600)) if len(n) >= 16]
    caught = sum(model.spans(f"see {k} there") == [(4, 3, 4 + len(k))] for k in hidden)
    wrong = sum(any(k == 3 for _, k, _ in model.spans(f"see {n} there")) for n in plain)
    # Measured: 244 of 300 caught (those of 20 to 25 characters are missed at times), none of 398 names taken.
    assert caught >= 0.75 * len(hidden) and wrong <= 0.02 * len(plain), (caught, wrong, len(plain))


def test_mixing_positions_invert_the_schedules(spark):
    """Positions by numeric integration of each source's weights, document by document."""
    rng = random.Random(7)
    rows = [(i, sentence(rng, rng.randint(0, 40)), f"s{i % 3}") for i in range(240)]
    found = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).selectExpr(
        "row.c0 AS doc_id", "row.c2 AS source", "size", "source_size", "target", "positions"
    ).collect()
    weights = [lambda u: 4.5 - 3 * u, np.ones_like, lambda u: 1 + 2 * u]
    steps = np.linspace(0, 1, 200_001)
    for source in range(3):
        mine = sorted((r for r in found if r.source == f"s{source}"), key=lambda r: (int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:13], 16), r.doc_id))
        w = weights[source](steps)
        area = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2) / 200_000))
        at = 0
        for r in mine:
            want = []
            for turn in range(2):
                start = turn * r.source_size + at
                if start + r.size / 2 < r.target:
                    want.append(np.interp(start / r.target * area[-1], area, steps))
            assert r.positions == pytest.approx(want, abs=1e-4)
            at += r.size
    order = [r.doc_id for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    places = sorted((p, r.doc_id) for r in found for p in r.positions)
    assert len(order) == len(places) and Counter(order) == Counter(d for _, d in places)


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage on what the one before kept, against plain Python over all its rows."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = model.scorer()
    rows = {r.doc_id: r for r in docs.collect()}
    calm = stages["toxicity"](spark, docs, folder)
    assert {r.doc_id for r in calm.collect()} == {i for i, r in rows.items() if score(r.text or "")[0] < 0.3}

    texts = {r.doc_id: r.text for r in calm.collect()}
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    single = stages["near_duplicates"](spark, calm, folder)
    assert sorted(r.doc_id for r in single.collect()) == sorted({find(i) for i in sets})

    clean = stages["secrets"](spark, single, folder)
    spans = secrets.fit(single)
    assert {r.doc_id: r.text for r in clean.collect()} == {
        r.doc_id: None if r.text is None else secrets.redacted(r.text, spans.spans(r.text)) for r in single.collect()
    }
    assert single.columns == clean.columns == docs.columns

    mixed = stages["mixing"](spark, clean, folder)
    copies = {r.doc_id: r.copies for r in mixing.plan(clean).selectExpr("row.c0 AS doc_id", "copies").collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    after = {r.doc_id: r.text or "" for r in clean.collect()}
    for r in stages["bpe"](spark, mixed, folder).collect():
        ids = tokenizer.encode(after[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert near_dups.needed_matches(0.8) == 36
