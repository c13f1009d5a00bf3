"""Periodic runs, the conversation trie and token files against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trailweave.llm import periodic_runs, prefix_trie, registry, token_files

DOCS = "doc_id long, text string, lang string, runs string, start double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rng = random.Random(3)
    rows = [(1, "a " * 30, "en", "x", 1.0), (2, "a b " * 9 + "c", None, None, None), (2, "a b " * 9 + "c", None, None, None)]
    rows += [(None, "q r s " * 8, "en", "x", 0.0), (4, None, None, None, None), (5, "", "en", "", 0.0), (6, " \n\t ", "en", "c", 0.0)]
    rows += [(7, " ".join(rng.choice("ab") for _ in range(20_000)), "en", "", 0.0), (8, "x" * 50_000, "en", "b", 0.0)]
    rows += [(9, "é\x1cé é\x1cé " * 5 + "日本 " * 7, "en", "c", 0.0), (2**40, "ab " * 5, "en", "c", 0.0)]
    for i in range(20, 220):
        n, k = rng.randint(0, 50), rng.choice([1, 2, 4, 30])
        words = [f"w{rng.randrange(k)}" for _ in range(n)]
        if words and rng.random() < 0.5:
            words += words[-rng.randint(1, min(6, n)) :] * rng.randint(1, 9)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words), "en", "y", float(i)))
    return rows


def brute_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        s = 0
        while s < len(w) - q:
            e = s
            while e < len(w) - q and w[e] == w[e + q]:
                e += 1
            if e + q - s >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(s, e + q - p)) for p in range(1, q)):
                found.append((s, e + q - s, q))
            s = max(e, s + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_digests(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept)))


def test_periodic_runs_query_equals_brute_force(spark, odd_rows, tmp_path):
    folder = table(spark, tmp_path, "documents", [r for r in odd_rows if r[0] != 7], DOCS)
    got = sorted(map(tuple, registry.op11_periodic_runs(spark, folder).collect()), key=repr)
    want = sorted((brute_digests(r[0], r[1]) for r in odd_rows if r[0] != 7), key=repr)
    assert got == want
    assert sum(r[1] > 0 for r in want) > 50 and any(r[0] and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in want)


def test_periodic_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(400):
        docs = [[rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 50))] for _ in range(rng.randint(1, 4))]
        docs.append((docs[0][:7] or [0]) * rng.randint(1, 8))
        got = periodic_runs.find_runs(np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs]))
        want, at = [], 0
        for d in docs:
            want += [(s + at, n, q) for s, n, q in brute_runs(d)]
            at += len(d)
        assert got.tolist() == list(map(list, want))
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(9, np.int64), np.array([9]), exponent=3)


def test_periodic_runs_keep_whole_texts(spark, odd_rows):
    docs = spark.createDataFrame(odd_rows, DOCS)
    found = periodic_runs.periodic_runs(docs)
    assert found.count() == len(odd_rows)
    long = found.where("doc_id = 7").first()
    dropped = {i for r in long.runs for i in range(r.start + r.period, r.start + r.length)}
    assert long.n_words == 20_000 and len(long.collapsed.split()) == 20_000 - len(dropped) and dropped
    assert periodic_runs.digests(periodic_runs.periodic_runs(docs.limit(0))).count() == 0


TURNS = "conv_id long, turn long, role string, text string, depth string, words int, high double"


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = int(hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()[:15], 16)
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, tie, text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    nodes = {}
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            nodes.setdefault(tuple(rebuilt[c][:d]), []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(members) - 1) * len(WORD.findall(n[-1][1])) if n else 0
    return sorted(
        (m[0], len(n), nodes[n[:-1]][0] if n else -1, len(m), kids[n], leaves[n], saved[n],
         sha(",".join(str(c) for c in m if len(rebuilt[c]) == len(n))))
        for n, m in nodes.items()
    )


def trie_rows(rng):
    texts = ["a b", "a", "", None, "the same  words", "x\ny z"]
    rows = []
    for c in [*range(0, 64), 81, 95, 2**33, None]:
        for t in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += rows[3:9]
    return rows + [(500, t, "user", "once more") for t in range(30)] + [(501, t, "user", "once more") for t in range(23)]


def plain(found):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in found.collect())


def test_prefix_trie_query_equals_brute_force(spark, tmp_path):
    rows = trie_rows(random.Random(5))
    folder = table(spark, tmp_path, "conversations", [(*r, "x", None, 1.0) for r in rows], TURNS)
    assert plain(registry.op12_prefix_trie(spark, folder)) == brute_trie(rows)


@pytest.mark.parametrize("block", [1, 4])
def test_prefix_trie_over_many_pieces_and_shards(spark, block):
    """Conversations and first turns span many pieces and shards."""
    rows = trie_rows(random.Random(6))
    docs = spark.createDataFrame([(*r, "x", None, 1.0) for r in rows], TURNS)
    paths = prefix_trie.paths_of(prefix_trie.turns_of(docs), shared=True)
    assert plain(prefix_trie.prefix_trie(paths, block=block, shard_rows=20).drop("high", "low")) == brute_trie(rows)


def test_prefix_trie_of_no_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.conversation_trie(empty).count() == 0
    assert prefix_trie.prefix_trie(prefix_trie.paths_of(prefix_trie.turns_of(empty), shared=True)).columns[2] == "conv_id"


def test_node_table_slots():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000, 50_000):
        high, low = rng.integers(0, 2**64, (2, n), np.uint64)
        nodes = prefix_trie.NodeTable(high, low)
        assert sorted(nodes.slots(high, low)) == list(range(n))
        assert (nodes.slots(high, low + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.NodeTable(np.ones(2, np.uint64), np.ones(2, np.uint64))


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("ids", [
    [], [0], [2], [5] * 1500, list(range(70_000)), np.random.default_rng(1).zipf(1.3, 5000) % 50_257, np.arange(513) % 3,
])
def test_wavelet_matrix(ids):
    ids = np.array(ids, np.int64)
    matrix = token_files.WaveletMatrix.of(ids)
    assert (matrix.ids() == ids).all() and (matrix.access(np.arange(len(ids))) == ids).all()
    for token in {0, 2, 5, 49_999, 69_999, 1 << 30, *ids[:3].tolist()}:
        assert matrix.locate(token).tolist() == np.flatnonzero(ids == token).tolist()
        for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2)):
            assert matrix.count(token, a, b) == (ids[a:b] == token).sum()


def test_token_files_equal_the_tokenizer(spark, odd_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 3000)
    monkeypatch.setattr(token_files, "RANGE_BYTES", 40_000)
    extra = [(300 + i, t, None, None, None) for i, t in enumerate(["a<|endoftext|>b", "it's 12  \n\n x ", "🙂" * 99])]
    rows = odd_rows + extra
    folder = table(spark, tmp_path, "documents", rows, DOCS)
    found = {}
    for r in registry.op13_token_files(spark, folder).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    at, stream = 0, []
    for doc_id in sorted({r[0] for r in rows}, key=lambda i: (i is not None, i or 0)):
        for text in [r[1] for r in rows if r[0] == doc_id]:
            ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]
            assert (at, len(ids), token_files.crc32_of(ids)) in found[doc_id]
            at += len(ids)
            stream += [(doc_id, i) for i in ids]
    assert sum(map(len, found.values())) == len(rows)

    files = token_files.write(spark.createDataFrame(rows, DOCS), end=2)
    assert files.count() > 5 and files.where("docs > 1").agg({"n": "max"}).first()[0] <= 3000
    wanted = {0, 1, 2999, 3000, len(stream) // 2, len(stream) - 1}
    asked = spark.createDataFrame([(p,) for p in [*wanted, 0, -1, len(stream), None]], "position long")
    assert {tuple(r) for r in token_files.token_at(files, asked).collect()} == {(p, stream[p][1]) for p in wanted}
    for token in (2, stream[40][1], 50_256, 50_000):
        places = [(token, d, p) for p, (d, i) in enumerate(stream) if i == token]
        assert sorted(map(tuple, token_files.occurrences(files, [token]).collect()), key=lambda r: r[2]) == places
        assert [r.n for r in token_files.occurrences(files, [token], places=False).collect()] == [len(places)]


def test_token_files_of_other_ids_and_no_rows(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "three"), (None, None)], "doc_id string, text string")
    got = [tuple(r) for r in token_files.digests(token_files.read(token_files.write(docs, end=2))).orderBy("start").collect()]
    assert [(r[0], r[1]) for r in got] == [(None, 0), ("a", 1), ("b", 1 + got[1][2])]
    assert token_files.read(token_files.write(docs.limit(0), end=2)).count() == 0
