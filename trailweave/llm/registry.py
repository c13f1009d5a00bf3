"""The queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import bpe, chat, mixing, periodic_runs, prefix_trie, secrets, sharding, token_counts, token_files, toxicity
from trailweave.llm.embedding_dups import near_embeddings
from trailweave.llm.forest import nearest
from trailweave.llm.near_dups import near_duplicates
from trailweave.workspace import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The text leaves the plan as soon as its words are counted.
    docs = _table(spark, sf_dir, "documents").selectExpr("doc_id", "source", f"{mixing.WORDS.format('text')} AS words")
    # Documents that the mix does not take have no position; their hashes spread them over the last ranges.
    found = mixing.plan(docs, size="words").orderBy(F.expr("get(positions, 0)").asc_nulls_last(), F.expr("xxhash64(row.c0)"))
    return found.selectExpr("row.c0 AS doc_id", "size", "source_size", "target", "CAST(taken AS LONG) AS taken")


OP1_SQL = """
WITH docs AS (
    SELECT doc_id, source, CAST(length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS place
    FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS words,
        [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight,
        row_number() OVER (ORDER BY source NULLS LAST) AS r
    FROM docs GROUP BY source),
filled AS (
    SELECT *, 1.5::DOUBLE * sum(words) OVER () AS demand, sum(weight) OVER () AS all_weight,
        coalesce(sum(2 * words) OVER before, 0) AS full_words, coalesce(sum(weight) OVER before, 0) AS full_weight
    FROM sources
    WINDOW before AS (ORDER BY 2 * words / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, (demand - full_words)::DOUBLE / (all_weight - full_weight) AS level FROM filled),
targets AS (
    SELECT source, words, CASE WHEN level * weight >= 2 * words THEN CAST(2 * words AS DOUBLE)
        ELSE weight * max(CASE WHEN level * weight < 2 * words THEN level END) OVER () END AS target
    FROM judged),
placed AS (
    SELECT d.doc_id, d.size, t.words, t.target, coalesce(sum(d.size) OVER (
        PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, words AS source_size, target,
    CAST(size * (CASE WHEN start + size / 2.0::DOUBLE < target THEN 1 ELSE 0 END
        + CASE WHEN words + start + size / 2.0::DOUBLE < target THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", F.expr("IF(score >= 0.3, 1, 0)").alias("predicted")
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    more = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', :t), (-7L, 1L, 'assistant', :t) AS v(conv_id, turn, role, text)", {"t": tricky}
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest(chat.read_back(chat.formatted(chat.canonical(rows))))


OP4_SQL = r"""
WITH all_rows AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(4 + length(role) + CASE WHEN role IN ('system', 'user', 'assistant') THEN 0
            ELSE 2 + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) END + 2 + 9 + length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')))
        AS BIGINT) AS formatted_chars
FROM all_rows GROUP BY conv_id
"""


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find(docs, secrets.fit(docs)))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(_table(spark, sf_dir, "documents"), shards=16)
    return found.withColumn("grown_shard", F.lit(None).cast("int"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2, similarity=0.8)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_periodic_tails(_table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(prefix_trie.turns_of(_table(spark, sf_dir, "conversations")), "trie-turns")
    return prefix_trie.prefix_trie(prefix_trie.paths_of(turns, shared=True)).drop("high", "low")


OP12_SQL = r"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, max(n) AS total, xor(list_reduce(list_concat([4294967295::BIGINT],
        list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, b:
            list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 4 AS h
    FROM turns GROUP BY conv_id),
rebuilt AS (
    SELECT c.conv_id, t.n AS depth, t.role, t.text
    FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.n <= c.h
    UNION ALL
    SELECT c.conv_id, t.n - c.h + least(c.h, coalesce(b.total, 0)), t.role, t.text
    FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.n > c.h LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20),
paths AS (
    SELECT conv_id, depth, length(regexp_extract_all(text, '[^ 	-
]+')) AS words,
        list(length(role) || ':' || role || text) OVER (PARTITION BY conv_id ORDER BY depth) AS node
    FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
nodes AS (SELECT node, depth, max(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM paths GROUP BY node, depth),
children AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
owned AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node, depth)),
sums AS (
    SELECT p.node, p.depth, sum((o.n_convs - 1) * o.words) AS saved_tokens, count(*) FILTER (o.n_children = 0) AS n_leaves
    FROM owned o JOIN paths p ON p.conv_id = o.conv_id AND p.depth <= o.depth GROUP BY p.node, p.depth),
ends AS (
    SELECT node, depth, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
    FROM paths p WHERE depth = (SELECT max(depth) FROM paths q WHERE q.conv_id = p.conv_id) GROUP BY node, depth)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, t.conv_id AS parent_conv_id, o.n_convs, o.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
    CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM owned o JOIN sums s USING (node, depth) LEFT JOIN ends e USING (node, depth)
LEFT JOIN nodes t ON o.depth > 0 AND t.depth = o.depth - 1 AND t.node = o.node[1:o.depth - 1]
"""


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(_table(spark, sf_dir, "documents"), end=2)
    return token_files.digests(token_files.read(files))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_secrets": op5_secrets,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_bpe": op7_bpe,
    "op8_sharding": op8_sharding,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_files": op13_token_files,
}
ORACLES = {"op1_mixing": OP1_SQL, "op4_chat_formatting": OP4_SQL, "op12_prefix_trie": OP12_SQL}
