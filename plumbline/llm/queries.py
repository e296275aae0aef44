"""One query for each corpus operator, over whole tables of the driver's folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, bpe, hamming, langid, ngram_join, packing, pii, sharding, suffix_dedup, warc


def vocabulary() -> str:
    """Place of the public byte-level vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=16)


def op2_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"), least=50)


def op4_warc_in_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"), least=100)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op6_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary())


def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, bits = hamming.sign_codes(_table(spark, sf_dir, "embeddings"))
    return hamming.search(codes, codes.where(F.col("vec_id") % 50 == 0), k=10, bits=bits)


def op8_blocked_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), words=5, percent=80)


def op9_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary(), window=1024, end_id=0)


def op10_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_feistel_shards, op2_balanced_posting_lists, op3_suffix_intervals, op4_warc_in_zip, op5_personal_data,
        op6_speculative_bpe, op7_multi_index_hashing, op8_blocked_ngram_join, op9_concatenate_and_cut, op10_output_codes,
    )
}

#: Sign bits compared one by one: the Hamming distance of the 64-bit codes, against all rows.
OP7_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.b, c.b), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

#: What the archives must say of each page: the least page_id of equal payloads of 100 bytes or more is the response.
OP4_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

#: Sets of shingles, overlaps counted over the shingles that two different sets share, and what links reach.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS s FROM w),
docs AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS sig, s FROM sets),
classes AS MATERIALIZED (SELECT sig, min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM docs WHERE n > 0 GROUP BY sig),
grams AS MATERIALIZED (SELECT rep, n, unnest(s) AS g FROM classes),
links AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS node, rep AS other FROM classes UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, d.n AS n_shingles, CASE WHEN d.n > 0 THEN l.component_id ELSE d.doc_id END AS component_id
FROM docs d LEFT JOIN classes c ON c.sig = d.sig LEFT JOIN least l ON l.node = c.rep
"""

ORACLES: dict[str, str] = {"op4_warc_in_zip": OP4_SQL, "op7_multi_index_hashing": OP7_SQL, "op8_blocked_ngram_join": OP8_SQL}
