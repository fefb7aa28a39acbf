"""One query for each operator of this subpackage, over its whole tables; SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import shared
from .exact_dedup import exact_groups
from .jaccard_join import jaccard_components
from .license_scan import license_scan
from .packing import pack
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .sentence_pieces import encode_pieces
from .substring_dedup import digest, remove_repeats
from .token_files import read_token_files, write_token_files
from .toxicity import toxicity_scores


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(documents(spark, sf_dir)))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.Workspace(spark, "token-files").path
    return read_token_files(write_token_files(documents(spark, sf_dir), folder), folder)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_packing": op3_packing,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_quality_rules": op5_quality_rules,
        "op6_token_files": op6_token_files,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_sentence_pieces": op8_sentence_pieces,
        "op9_quality": op9_quality,
        "op10_license_scan": op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": r"""
            WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
            windows AS (SELECT doc_id, w, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
                        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
            repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM windows) WHERE least < doc_id),
            cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM repeats),
            gone AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM cut GROUP BY doc_id)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
                   sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string([w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(ks, k)], ' ') END) AS kept_sha256
            FROM words LEFT JOIN gone USING (doc_id)""",
        "op4_jaccard_join": r"""
            WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
            links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
                      GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
            both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
            reach AS (SELECT doc_id AS node, doc_id AS other FROM n UNION SELECT r.node, e.y FROM reach r JOIN both_ways e ON e.x = r.other),
            least AS (SELECT node, min(other) AS c FROM reach GROUP BY 1)
            SELECT words.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, words.doc_id) AS component_id FROM words LEFT JOIN n ON n.doc_id = words.doc_id LEFT JOIN least ON least.node = words.doc_id""",
        "op7_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM n WINDOW w AS (PARTITION BY t)""",
    }
