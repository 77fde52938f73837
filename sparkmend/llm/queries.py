"""The queries of this subpackage over the driver tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sparkmend.llm import chat_transcripts, context_mixing, hash_forest, language_ppm, lexicon_bpe, near_duplicates, negative_mining, piece_sampling, quality_neighbours, quality_rules, source_mix, spelling_variants, token_counts
from sparkmend.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: add a query, and its SQL if SQL can express it."""
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


@register("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                     _tokenizer("byte_bpe_50k.json")).drop("text")


def _op2_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, list_slice(ws, i, i + 7) AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM base)),
dup AS (
  SELECT doc_id, i FROM win
  QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
cov AS (
  SELECT doc_id, sum(g) AS n FROM (
    SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS g FROM dup)
  GROUP BY doc_id),
counted AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
         CAST(len(ls) AS BIGINT) AS n_lines,
         len(list_filter(ls, lambda x: left(ltrim(x, ' '), 1) IN ('-', '*', '•'))) AS n_bullet,
         len(list_filter(ls, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ell
  FROM base LEFT JOIN cov USING (doc_id)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         concat_ws(',',
           CASE WHEN n_words = 0 OR word_chars / n_words < 2 OR word_chars / n_words > 12 THEN 'word_length' END,
           CASE WHEN n_words > 0 AND n_symbols / n_words > 0.10 THEN 'symbols' END,
           CASE WHEN n_words = 0 OR n_stop_words / n_words < 0.05 THEN 'stop_words' END,
           CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.50 THEN 'repeated_lines' END,
           CASE WHEN n_lines > 0 AND n_bullet / n_lines > 0.90 THEN 'bullet_lines' END,
           CASE WHEN n_lines > 0 AND n_ell / n_lines > 0.30 THEN 'ellipsis_lines' END) AS failed_rules
  FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, n_stop_words, n_lines, failed_rules
FROM judged"""


@register("op2_quality_rules", _op2_sql())
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and rule verdicts of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_stop_words", "n_lines", "failed_rules")


@register("op3_hash_forest")
def op3_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product of every twentieth vector."""
    return hash_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@register("op4_piece_sampling")
def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece ids of every document, and whether decoding gave the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_sampling.encode(docs, _tokenizer("piece_bpe_32k.model")).drop("text")


@register("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: two-word shingles, similarity of 0.8 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates.near_duplicates(docs, shingle=2, percent=80).select(
        "doc_id", "n_shingles", "component_id", "kept")


@register("op6_chat_transcripts")
def op6_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a raw transcript (markers in several styles, some missing): recovered roles and canonical lines.

    The model is learned from three of four id folds; ``role`` is the role that the line really has.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = chat_transcripts.lines(chat_transcripts.raw_transcripts(turns)).withColumn(
        "held_out", fold(F.col("conv"), 4) == 2)
    model = chat_transcripts.learn(rows.where(~F.col("held_out")))
    got = chat_transcripts.render(chat_transcripts.decode(rows, model)).withColumnRenamed("role", "role_pred")
    known = rows.groupBy("conv", "turn", "same", "line").agg(F.first("role").alias("role"), F.first("held_out").alias("held_out"))
    return got.join(known, ["conv", "turn", "same", "line"]).select(
        "conv", "turn", "line", "held_out", "role", "role_pred", "turn_no", "rendered")


@register("op7_language_ppm")
def op7_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four id folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_ppm.learn(docs, allowed=fold(F.col("doc_id"), 4) != 2)
    return language_ppm.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@register("op8_context_mixing")
def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and context-mixing score of every document, learned from nine of ten id folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = fold(F.col("doc_id"), 10) != 0
    model, words = context_mixing.learn(docs, allowed=learned)
    return context_mixing.score(docs, model, words, learned=learned).select(
        "doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score", "bits_per_byte")


@register("op9_quality_neighbours")
def op9_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, labels learned from three of four id folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_neighbours.learn(docs, table(spark, sf_dir, "labels"), allowed=fold(F.col("doc_id"), 4) != 2)
    return quality_neighbours.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@register("op10_source_mix")
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix to target weights takes of every document."""
    return source_mix.mix_counts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@register("op11_lexicon_bpe")
def op11_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them; the lexicon holds the frequent words of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexicon_bpe.digests(docs, lexicon_bpe.learn(docs, _tokenizer("word_bpe_49k.json")))


@register("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of all documents with its number of near words, its form and root."""
    return spelling_variants.group_variants(spelling_variants.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


_OP13_SQL = """
WITH ready AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.id AS anchor_id, b.id, a.lab = b.lab AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM ready a JOIN ready b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


@register("op13_negative_mining", _OP13_SQL)
def op13_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every hundredth vector; some labels are shifted first."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negative_mining.mine(vectors.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
