import weakref

import pyarrow as pa
import pytest

from trailweave.llm import batches, bpe, near_dups, secrets, toxicity

STEPS = {
    "toxicity": lambda docs: toxicity.reject(docs, toxicity.Model([0] * 28**3, {}, 0.0)),
    "near_duplicates": lambda docs: near_dups.signatures(docs, 5),
    "secrets": lambda docs: secrets.redact(docs, secrets.fit(docs)),
    "bpe": bpe.digests,
}


def _sizes(session):
    """Bytes of text in the batches that 3,000 texts of 10,000 bytes reach Python in."""

    def run(found):
        for batch in found:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    texts = session.range(0, 3000, 1, 1).selectExpr("repeat('a', 10000) AS text")
    return [r.n for r in texts.mapInArrow(run, "n long").collect()]


@pytest.mark.parametrize("step", STEPS)
def test_a_step_bounds_the_bytes_handed_to_python(spark, step):
    session = spark.newSession()
    docs = session.createDataFrame([(1, "some words of a text"), (2, None)], "doc_id long, text string")
    assert STEPS[step](docs).count() == 2
    sizes = _sizes(session)
    assert sum(sizes) >= 30_000_000 and max(sizes) < 2 * batches.HANDED


def test_a_size_that_the_session_sets_stays(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    batches.hand_small(session)
    assert max(_sizes(session)) < 2 << 20


def test_memory_is_given_back_when_nothing_is_held(spark, monkeypatch):
    class Rows:
        sparkSession = spark.newSession()

        def mapInArrow(self, task, schema):
            return task

    class Held:
        pass

    alive, seen = [], []

    def run(found):
        own = Held()
        alive.append(weakref.ref(own))
        yield from found

    monkeypatch.setattr(batches, "give_back", lambda: seen.append(alive[0]() is None))
    assert list(batches.through(Rows(), run, "n long")(iter([1, 2]))) == [1, 2]
    assert seen == [True]


def test_a_block_of_several_units_numbers_words_from_the_most_frequent_on(spark):
    split, block = bpe.splitter(bpe.PATH), bpe._Block(3)
    for ids, texts in (([1, 2], ["b a a", None]), ([3], [""]), ([4, 5], ["c a", " a b"])):
        block.add(split, pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"]))
    names = ["block", "bucket"], ["doc_ids"], ["counts", "codes", "words", "lengths", "at"]
    kinds = pa.int64(), pa.list_(pa.int64()), pa.binary()
    schema = pa.schema([(n, k) for some, k in zip(names, kinds) for n in some])
    rows = [r for b in block.rows(1, schema) for r in b.to_pylist()]
    docs, words = rows[:3], rows[3]
    assert [r["doc_ids"] for r in docs] == [[1, 2], [3], [4, 5]]
    ends = [0, *bpe._unpack(words["lengths"]).cumsum().tolist()]
    raw = bpe._restored(words["words"]).decode()
    known = [raw[a:b] for a, b in zip(ends, ends[1:])]
    assert known[0] == " a"
    assert [[known[i] for i in bpe._unpack(r["codes"])] for r in docs] == [["b", " a", " a"], [], ["c", " a", " a", " b"]]
