"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgprep.llm.common import table
from kgprep.llm.decontamination import contamination_digest
from kgprep.llm.fingerprints import fingerprint_digest
from kgprep.llm.hard_negatives import mine_hard_negatives
from kgprep.llm.jaccard_join import jaccard_components
from kgprep.llm.line_dedup import line_dedup_digest
from kgprep.llm.packing import pack_documents
from kgprep.llm.scoring import score_texts
from kgprep.llm.secrets import secrets_digest
from kgprep.llm.sharding import shard_documents
from kgprep.llm.simhash_dedup import near_duplicate_digest
from kgprep.llm.substring_dedup import repeats_digest
from kgprep.llm.token_alignment import align_tokenizers
from kgprep.llm.toxicity import toxicity_digest

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination_digest(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return shard_documents(table(spark, sf, "documents"), n_shards=24)


def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets_digest(table(spark, sf, "documents"))


def op4_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint_digest(table(spark, sf, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_digest(table(spark, sf, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repeats_digest(table(spark, sf, "documents"))


def op7_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return score_texts(table(spark, sf, "documents"))


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup_digest(table(spark, sf, "documents"))


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity_digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return mine_hard_negatives(table(spark, sf, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align_tokenizers(table(spark, sf, "documents").select("doc_id", "text"), digest=True)


def op13_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_secret_scan": op3_secret_scan,
    "op4_fingerprints": op4_fingerprints,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_alignment": op12_token_alignment,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": r"""
        WITH doc AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), item AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), grams AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS n,
                   array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' ') AS phrase
            FROM item, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS u(s) WHERE len(w) > 0
        ), places AS (
            SELECT d.doc_id, p.pos, l.n, array_to_string(list_slice(d.w, p.pos, p.pos + l.n - 1), ' ') AS phrase
            FROM doc d, unnest(range(1, len(d.w) + 1)) AS p(pos), (SELECT DISTINCT n FROM grams) l
            WHERE p.pos + l.n - 1 <= len(d.w)
        ), found AS (
            SELECT p.doc_id, p.pos, p.n, g.item_id FROM places p JOIN grams g ON p.phrase = g.phrase AND p.n = g.n
        ), hits AS (
            SELECT doc_id, count(DISTINCT word_pos) AS n_hit
            FROM (SELECT DISTINCT doc_id, pos, n FROM found) f, unnest(range(f.pos, f.pos + f.n)) AS u(word_pos)
            GROUP BY doc_id
        ), ids AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
            FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
        )
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
               coalesce(i.n_items, 0)::BIGINT AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
               coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
        FROM doc d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN ids i ON d.doc_id = i.doc_id""",
    "op8_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, pos, parts[pos] AS line,
                   translate(regexp_replace(parts[pos], '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
                 unnest(range(1, len(parts) + 1)) AS u(pos)
        ), repeated AS (
            SELECT key, min(doc_id) AS keep FROM lines WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) >= 2
        ), marked AS (
            SELECT l.*, (r.key IS NOT NULL AND l.doc_id <> r.keep) AS lost
            FROM lines l LEFT JOIN repeated r ON l.key = r.key
        )
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE lost))::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op11_hard_negatives": r"""
        WITH r AS (
            SELECT row_number() OVER () AS k, vec_id,
                   CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT a.k, a.vec_id AS anchor_id, a.label = c.label AS same, c.k AS other, c.vec_id,
                   CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
            FROM r a JOIN r c ON a.k <> c.k WHERE a.vec_id % 100 = 0
        ), positive AS (
            SELECT k, anchor_id, vec_id AS positive_id, score AS positive_score, other,
                   row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS place
            FROM scored WHERE same
        ), ranked AS (
            SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.k, p.place ORDER BY n.score DESC, n.vec_id) AS rank
            FROM positive p JOIN scored n ON p.k = n.k
            WHERE p.place <= 5 AND NOT n.same
              AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM ranked WHERE rank <= 5""",
}
