"""The registered queries of this subpackage: thin digests of the operators' outputs, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .decontamination import decontaminate
from .html_extraction import extract
from .language_id import language_id
from .language_model import score_documents
from .mixing import mix_sources
from .near_duplicates import near_duplicates
from .permutation_index import nearest
from .quality import quality_scores
from .session import table
from .token_counts import token_counts
from .token_output import token_output

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors["vec_id"] % 100 == 0, k=10)


OP4_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), queries AS (SELECT vec_id, min(v) AS v FROM usable WHERE vec_id % 100 = 0 GROUP BY vec_id, len(v)
), scored AS (
  SELECT q.vec_id AS query_id, u.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (u.v[i] - q.v[i]) * (u.v[i] - q.v[i])), lambda a, b: a + b)) AS score
  FROM queries q JOIN usable u ON u.vec_id <> q.vec_id AND len(u.v) = len(q.v)
), ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), sizes AS (SELECT DISTINCT least(13, len(w)) AS k FROM items WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE len(w) >= k)
), found AS (SELECT doc_id, i, d.k, item FROM doc_windows d JOIN item_windows USING (k, g)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id
), named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""".replace("\\\\", "\\")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), linked AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)
), both_ways AS (SELECT u, v FROM linked UNION ALL SELECT v, u FROM linked
), reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, v FROM reach JOIN both_ways ON u = r
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT d AS doc_id, min(r) AS component_id FROM reach GROUP BY d) LEFT JOIN sizes USING (doc_id)
""".replace("\\\\", "\\")


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_html_extraction": op2_html_extraction,
        "op3_token_counts": op3_token_counts,
        "op4_permutation_index": op4_permutation_index,
        "op5_quality": op5_quality,
        "op6_decontamination": op6_decontamination,
        "op7_language_model": op7_language_model,
        "op8_language_id": op8_language_id,
        "op9_token_output": op9_token_output,
        "op10_near_duplicates": op10_near_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_permutation_index": OP4_SQL, "op6_decontamination": OP6_SQL, "op10_near_duplicates": OP10_SQL}
