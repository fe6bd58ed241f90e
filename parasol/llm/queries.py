"""The registered queries of this subpackage, with the parameters of production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parasol.llm.common import documents
from parasol.llm.conversation_repair import repair_conversations
from parasol.llm.embedding_dedup import embedding_dedup
from parasol.llm.exact_dedup import exact_dedup
from parasol.llm.jaccard import jaccard_join
from parasol.llm.mixing import mix
from parasol.llm.ngram_lm import ngram_scores
from parasol.llm.packing import pack
from parasol.llm.pattern_packing import pack_patterns
from parasol.llm.quality import quality
from parasol.llm.spelling import spelling_variants
from parasol.llm.token_counts import token_counts
from parasol.llm.token_output import read_shards, write_shards
from parasol.llm.toxicity import toxicity

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"
#: Limits of a training sequence: tokens, segments, loss-bearing tokens.
SEQUENCE_LIMITS = {"max_tokens": 2048, "max_segments": 256, "max_loss": 2048}


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_scores(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), end_id=1, **SEQUENCE_LIMITS)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), end_id=0))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir)).drop("group")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), limit=1024)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_patterns(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER), end_id=0, max_tokens=2048)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


_ALL = (
    op1_embedding_dedup,
    op2_ngram_lm,
    op3_packing,
    op4_token_output,
    op5_mixing,
    op6_exact_dedup,
    op7_quality,
    op8_toxicity,
    op9_jaccard,
    op10_token_counts,
    op11_conversation_repair,
    op12_pattern_packing,
    op13_spelling_variants,
)
QUERIES = {f.__name__: f for f in _ALL}

#: DuckDB's form of the queries that SQL can express.
ORACLE_SQL = {
    "op1_embedding_dedup": r"""
        WITH RECURSIVE v AS (
            SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
        good AS (
            SELECT * FROM v
            WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x <> 0)) > 0
              AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        pairs AS (
            SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
            WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.93),
        reach(a, b, id) AS (
            SELECT a, b, id FROM pairs UNION SELECT reach.a, pairs.b, pairs.id FROM reach JOIN pairs ON pairs.a = reach.b),
        least_id AS (SELECT a, min(id) AS id FROM reach GROUP BY a),
        links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
        named AS (
            SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, id) AS component_id
            FROM v LEFT JOIN links ON links.a = v.r LEFT JOIN least_id ON least_id.a = v.r)
        SELECT *, coalesce(vec_id = component_id, false) AS kept FROM named
    """,
    "op9_jaccard": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        starts AS (SELECT r, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d),
        shingles AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM starts),
        sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
        shared AS (
            SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
        pairs AS (
            SELECT a, b, doc_id AS id FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b JOIN d ON d.r = b
            WHERE 100 * c >= 75 * (x.n + y.n - c)),
        reach(a, b, id) AS (
            SELECT a, b, id FROM pairs UNION SELECT reach.a, pairs.b, pairs.id FROM reach JOIN pairs ON pairs.a = reach.b),
        least_id AS (SELECT a, min(id) AS id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, id) AS component_id
        FROM d LEFT JOIN sizes ON sizes.r = d.r LEFT JOIN least_id ON least_id.a = d.r
    """,
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(length(text), 0) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM d
        WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
    """,
}
