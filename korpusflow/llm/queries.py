"""The queries of this package for __spark_entry__: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from korpusflow.llm.bpe import bpe_encode
from korpusflow.llm.chat import chat_format
from korpusflow.llm.embedding_dedup import embedding_dedup
from korpusflow.llm.exact_dedup import exact_dedup
from korpusflow.llm.filter_audit import filter_audit
from korpusflow.llm.hard_negatives import hard_negatives
from korpusflow.llm.licenses import license_scan
from korpusflow.llm.lm import score_texts
from korpusflow.llm.packing import pack
from korpusflow.llm.quality_model import quality_classifier
from korpusflow.llm.quality_rules import quality_rules
from korpusflow.llm.simhash import simhash_groups
from korpusflow.llm.token_counts import token_counts
from korpusflow.sources.corpus import spread

TOKENIZER = "byte_bpe_50k.json"
#: DuckDB: whether a list v of doubles is there and has finite numbers only.
_FINITE = "v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"), digest_col="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spread(documents(spark, sf_dir)))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(spread(documents(spark, sf_dir)), public_tokenizers.path(TOKENIZER), ids=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spread(documents(spark, sf_dir)))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spread(documents(spark, sf_dir)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spread(documents(spark, sf_dir)), public_tokenizers.path(TOKENIZER))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(spread(documents(spark, sf_dir)), keep=["doc_id"]).select("doc_id", "weak_label", "score", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spread(documents(spark, sf_dir)), keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(documents(spark, sf_dir)), public_tokenizers.path(TOKENIZER), ids=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spread(documents(spark, sf_dir).select("doc_id", "text", "lang")), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_exact_dedup, op2_ctw, op3_bpe, op4_simhash, op5_license_scan, op6_token_counts, op7_quality_classifier, op8_quality_rules, op9_chat_format, op10_packing,
        op11_filter_audit, op12_embedding_dedup, op13_hard_negatives,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
            s AS (SELECT doc_id, sha256(t) AS text_sha256 FROM d)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, text_sha256
            FROM s WINDOW w AS (PARTITION BY text_sha256)""",
        "op11_filter_audit": r"""
            WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
            w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
            f AS (SELECT doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
                  regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails FROM w),
            l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
            h AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
            x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c), o AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM x a, x b, x d, x e, x g
                  WHERE b.c <> a.c AND d.c NOT IN (a.c, b.c) AND e.c NOT IN (a.c, b.c, d.c) AND g.c NOT IN (a.c, b.c, d.c, e.c)),
            s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, ord(filter_order[step]) - 64 AS k, list_transform(string_split(left(filter_order, step - 1), ''), lambda z: ord(z) - 64) AS before FROM o, range(1, 6) r(step)),
            g AS (SELECT part, filter_order, step, k, n, good, toxic, fails[k] AS failing, len(list_filter(before, lambda z: fails[z])) > 0 AS gone, len(list_filter(fails, lambda z: z)) AS n_fails FROM h, s),
            c AS (SELECT part, filter_order, step, k, sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (failing AND NOT gone) AS removed, sum(n) FILTER (failing AND gone) AS redundant,
                  sum(n) FILTER (failing AND n_fails = 1) AS unique_fails, sum(n) FILTER (failing AND NOT gone AND good) AS good_lost, sum(n) FILTER (failing AND NOT gone AND toxic) AS toxic_lost FROM g GROUP BY part, filter_order, step, k)
            SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
                   CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, k), 0) AS BIGINT) AS shapley FROM c""",
        "op12_embedding_dedup": f"""
            WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
            ok AS (SELECT *, sqrt(list_dot_product(v, v)) AS size FROM e WHERE label IS NOT NULL AND {_FINITE} AND len(list_filter(v, lambda x: x <> 0)) > 0),
            pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98),
            reach AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a),
            least AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM pair GROUP BY a)
            SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept FROM e LEFT JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)""",
        "op13_hard_negatives": f"""
            WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(v, lambda x: floor(256 * x)) AS x
                       FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL) WHERE {_FINITE}),
            s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
            p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
            SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS "rank", s.id AS negative_id, positive_score, s.score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
            WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY "rank" <= 3""",
    }
