"""Queries over the training-data tables: one for each operator, with its production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ann import nearest_neighbours
from tidemark.llm.bpe import default_vocabulary, encode_and_digest
from tidemark.llm.common import bound_arrow_batches, table
from tidemark.llm.exact_dedup import exact_groups
from tidemark.llm.hard_negatives import hard_negatives
from tidemark.llm.mixing import mix_counts
from tidemark.llm.resampling import resample
from tidemark.llm.secrets import scan_secrets
from tidemark.llm.sharding import shard_documents
from tidemark.llm.simhash import fingerprint_components
from tidemark.llm.substring_dedup import removal_digest
from tidemark.llm.topk import top_k
from tidemark.llm.toxicity import judge_toxicity
from tidemark.llm.url_filter import judge_urls


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole text's ids and of their decoding."""
    return encode_and_digest(table(spark, sf_dir, "documents"), *default_vocabulary())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents stay of each group of equal texts."""
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents: the fixed rules' and those that the inferred formats add."""
    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every URL."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components of those within two bits."""
    return fingerprint_components(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of each query vector."""
    return top_k(table(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of near equal bytes; equal texts share a shard."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a window of 50 words repeats from a smaller document."""
    return removal_digest(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mix_counts(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score between 30 and 90 percent of an anchor's positives. Every seventh id's label is
    moved on by one first."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


def op12_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found of each query vector, by cosine."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight towards the benchmark's texts, and the ranks of a tenth drawn by it."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_exact_dedup, op3_secrets, op4_url_filter, op5_simhash, op6_toxicity, op7_topk, op8_sharding,
    op9_substring_dedup, op10_mixing, op11_hard_negatives, op12_ann, op13_resampling)}

ORACLE_SQL = {
    "op2_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op7_topk": """
        WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
             s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
                   FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
               s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT s.alike AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
        QUALIFY rank <= 10""",
    "op13_resampling": """
        WITH codes AS (SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                               FOR i IN range(256)] AS codes),
             words AS (SELECT src, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
                       FROM (SELECT 's' AS src, doc_id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)),
             bytes AS (SELECT w, [(strpos('0123456789ABCDEF', hex(encode(w))[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', hex(encode(w))[2 * i + 2]) - 1
                                  FOR i IN range(octet_length(encode(w)))] AS b
                       FROM (SELECT DISTINCT w FROM words)),
             bucketed AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, codes[xor(c, x) % 256 + 1]))) % 10000 AS bucket
                          FROM bytes, codes),
             counts AS (SELECT bucket, count(*) FILTER (src = 's') AS s, count(*) FILTER (src = 't') AS t FROM words JOIN bucketed USING (w) GROUP BY bucket),
             gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * ((SELECT sum(s) FROM counts) + 10000)
                                                          / (CAST(s + 1 AS DOUBLE) * ((SELECT sum(t) FROM counts) + 10000)))) AS BIGINT) AS gain FROM counts),
             weights AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM words JOIN bucketed USING (w) JOIN gains USING (bucket)
                         WHERE src = 's' GROUP BY doc_id),
             scores AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                               CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
                        FROM documents LEFT JOIN weights USING (doc_id)),
             places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scores LEFT JOIN places USING (doc_id)""",
}
