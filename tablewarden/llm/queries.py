"""The registered query of each operator, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import (
    embedding_dedup,
    factor_quality,
    hard_negatives,
    line_dedup,
    mixing,
    packing,
    personal_data,
    quality_trees,
    sharding,
    simhash,
    suffix_dedup,
    target_resampling,
    token_matrix,
)
from tablewarden.llm.common import table

MIX_WEIGHTS = [5, 2, 1]
CAPACITY = 2048
SHARDS = [f"shard-{k:02d}" for k in range(16)]
SLOTS = 5003


def vocabulary() -> tuple[str, str]:
    """Files of the byte-level vocabulary for tokenizers and for tiktoken."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op2_factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = factor_quality.learn(docs, table(spark, sf_dir, "labels"))
    return factor_quality.score_quality(docs, machine)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.document_pieces(table(spark, sf_dir, "documents"), CAPACITY, *vocabulary())
    return packing.pack(pieces, CAPACITY)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixing.mixed_documents(mix)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS, SLOTS)
    return placed.select("doc_id", "slot", "shard")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), least_chars=1)
    return done.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op8_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_matrix.digest(token_matrix.token_matrix(docs, CAPACITY, *vocabulary()))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality_trees.learn(docs, table(spark, sf_dir, "labels"))
    judged = quality_trees.judge(docs.select("doc_id", "text"), trees)
    return judged.select("doc_id", "quality.*")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal(table(spark, sf_dir, "documents"))
    counts = [personal_data.counted(F.col("base"), kind).alias(f"n_{kind}") for kind in personal_data.KINDS]
    written = personal_data.written
    return found.select(
        "doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return target_resampling.resample(docs, target, percent=10, most=1, buckets=10_000, least_words=20, seed=2024)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, label = F.col("vec_id"), F.col("label")
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine_negatives(vectors, id_ % 100 == 0, positives=5, negatives=5, least=80, scale=256)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
good AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND list_dot_product(e, e) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id < b.vec_id AND len(a.u) = len(b.u)
  WHERE list_dot_product(a.u, b.u) >= 0.95
),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, s.b FROM r JOIN sides s ON r.b = s.a)
  SELECT a, min(b) AS least FROM r GROUP BY a
),
n AS (SELECT a, count(*) AS n_links FROM sides GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN reached ON reached.a = vec_id
"""

# Words of each document before it in its source, and what a target takes of a stream read again.
OP5_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS k
  FROM d GROUP BY source
),
w AS (SELECT *, [5.0, 2.0, 1.0][((k - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT a.source, (1.5 * (SELECT sum(source_size) FROM w) - sum(CASE WHEN b.cap / b.w < a.cap / a.w THEN b.cap ELSE 0 END))
    / sum(CASE WHEN b.cap / b.w >= a.cap / a.w THEN b.w END) AS level
  FROM w a, w b GROUP BY a.source
),
t AS (
  SELECT w.source, source_size, CASE WHEN cap / w <= level THEN cap END AS at_cap, cap, w FROM w JOIN l ON w.source IS NOT DISTINCT FROM l.source
),
r AS (
  SELECT source, source_size, coalesce(at_cap, (1.5 * (SELECT sum(source_size) FROM t) - coalesce((SELECT sum(at_cap) FROM t), 0))
    / (SELECT sum(w) FROM t WHERE at_cap IS NULL) * w)::DOUBLE AS target FROM t
),
p AS (
  SELECT d.doc_id, d.source, size, source_size, target, round(target)::BIGINT AS words,
    (sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS first
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
  (words // greatest(source_size, 1) * size + greatest(0, least(first + size, words % greatest(source_size, 1)) - first))::BIGINT AS taken
FROM p
"""

# Turns of the shards one after another: each claims the first slot of its order that is free.
OP6_SQL = """
WITH RECURSIVE shard AS (
  SELECT k, list_transform(range(5003), lambda j:
    (('0x' || substr(h, 1, 8))::BIGINT + j * (('0x' || substr(h, 9, 8))::BIGINT % 5002 + 1)) % 5003) AS wish
  FROM (SELECT k, md5('shard-' || lpad(k::VARCHAR, 2, '0')) AS h FROM range(16) r(k))
),
fill AS (
  SELECT 0 AS turn, list_transform(range(5003), lambda j: false) AS taken, -1::BIGINT AS slot
  UNION ALL
  SELECT turn + 1, taken[:free] || [true] || taken[free + 2:], free FROM (
    SELECT turn, taken, list_filter(wish, lambda x: NOT taken[x + 1])[1] AS free
    FROM fill JOIN shard ON k = turn % 16 WHERE turn < 5003
  )
)
SELECT doc_id, d.slot::INT AS slot, ((turn - 1) % 16)::INT AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 5003 AS slot FROM documents) d
JOIN fill ON fill.slot = d.slot
"""

# CRC-32 from its polynomial: eight steps for each of the 256 bytes, then byte by byte over each distinct word.
OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
),
steps AS MATERIALIZED (SELECT list(v ORDER BY i) AS step FROM bits WHERE k = 8),
docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
found AS (
  SELECT row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM (
    SELECT row, text FROM docs UNION ALL SELECT NULL, text FROM benchmark)
),
words AS MATERIALIZED (SELECT row, word, count(*) AS n FROM found GROUP BY ALL),
kinds AS MATERIALIZED (SELECT DISTINCT word, hex(encode(word)) AS h FROM words),
hashed AS MATERIALIZED (
  SELECT word, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda j: ('0x' || substr(h, (2 * j + 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM kinds, steps
),
counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (row IS NOT NULL), 0) AS s, coalesce(sum(n) FILTER (row IS NULL), 0) AS t
  FROM words JOIN hashed USING (word) GROUP BY bucket
),
totals AS (SELECT coalesce(sum(s), 0) AS big_s, coalesce(sum(t), 0) AS big_t FROM counts),
gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (big_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (big_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts, totals
),
weighed AS (
  SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE row IS NOT NULL GROUP BY row
),
scored AS (
  SELECT row, doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (row)
),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (row)
"""

OP13_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


def op_queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    sql = {
        "op1_embedding_dedup": OP1_SQL, "op5_mixing": OP5_SQL, "op6_sharding": OP6_SQL,
        "op12_target_resampling": OP12_SQL, "op13_hard_negatives": OP13_SQL,
    }
    runs = [
        op1_embedding_dedup, op2_factor_quality, op3_simhash, op4_best_fit, op5_mixing, op6_sharding,
        op7_line_dedup, op8_token_matrix, op9_suffix_dedup, op10_quality_trees,
        op11_personal_data, op12_target_resampling, op13_hard_negatives,
    ]
    return {run.__name__: (run, sql.get(run.__name__)) for run in runs}
