"""Registered queries of the corpus operators: each reads its whole table and returns every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_shards import token_digest

    return token_digest(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secrets_digest

    return secrets_digest(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data_digest

    return personal_data_digest(table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import encode_media, media_digest
    from .textkit import materialize

    return media_digest(materialize(encode_media(table(spark, sf_dir, "documents")), "media", "zstd"))


QUERIES = {f.__name__: f for f in (op1_token_shards, op2_secrets, op3_near_duplicates, op4_decontaminate, op5_personal_data, op6_repeats, op7_toxicity, op8_packing, op9_quality, op10_media_flac)}

_NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * i >= 75 * (x.n + y.n - i)
), both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reached(node, component) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.component FROM reached r JOIN both_ways e ON e.u = r.node
)
SELECT r.node AS doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(r.component) AS component_id, r.node = min(r.component) AS kept
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.node GROUP BY r.node
"""

_REPEATS = """
WITH bytes AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (
  SELECT doc_id, s, b[s + 1:s + 200] AS string FROM (SELECT doc_id, b, unnest(range(0, n - 199)) AS s FROM bytes)
), starts AS (
  SELECT doc_id, s FROM windows WHERE string IN (SELECT string FROM windows GROUP BY string HAVING count(*) > 1)
), marked AS (
  SELECT doc_id, s, CASE WHEN s > lag(s, 1, -1000) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 1 ELSE 0 END AS opens FROM starts
), numbered AS (
  SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM marked
), spans AS (
  SELECT doc_id, span, min(s) AS a, max(s) + 200 AS e FROM numbered GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS e FROM spans
  UNION ALL SELECT t.doc_id, coalesce(max(x.e), 0), any_value(t.n) FROM bytes t LEFT JOIN spans x ON x.doc_id = t.doc_id GROUP BY t.doc_id
), kept AS (
  SELECT g.doc_id, sha256(unhex(string_agg(hex(t.b[g.a + 1:g.e]), '' ORDER BY g.a, g.e))) AS kept_sha256 FROM gaps g JOIN bytes t ON t.doc_id = g.doc_id GROUP BY g.doc_id
), counts AS (
  SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT t.doc_id, t.n AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, k.kept_sha256
FROM bytes t JOIN kept k ON k.doc_id = t.doc_id LEFT JOIN counts c ON c.doc_id = t.doc_id
"""

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op3_near_duplicates": _NEAR_DUPLICATES, "op6_repeats": _REPEATS}
