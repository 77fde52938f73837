"""A corpus pipeline of the text operators: quality, language, near-duplicates, source mix, SentencePiece.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmend.llm import language_ppm, near_duplicates, piece_sampling, quality_neighbours, source_mix
from sparkmend.llm.common import fold, small_batches, table
from sparkmend.session import cut_lineage

LEAST_LANGUAGE_SCORE = 0.5
# an executor keeps its JVM and its Python processes through all stages, so each batch is a part of what an operator alone takes
BATCH_BYTES, PIECE_CHARS = 2_000_000, 150_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.7, by the labels of three of four id folds; the others go."""
    small_batches(spark, BATCH_BYTES)
    model = quality_neighbours.learn(docs, table(spark, sf_dir, "labels"), allowed=fold(F.col("doc_id"), 4) != 2)
    return quality_neighbours.score(docs, model).where("predicted = 1").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the model knows and is sure of; the others go. ``lang`` stays as it is.

    A text of a language that was not learned goes if its words cost far more than those of held-out texts usually do.
    """
    small_batches(spark, BATCH_BYTES)
    learned = fold(F.col("doc_id"), 4) != 2
    model = language_ppm.learn(docs, allowed=learned, rows_per_language=None)
    alien = language_ppm.foreign(language_ppm.usual_bits(docs.where(~learned), model, rows_per_language=None))
    return language_ppm.identify(docs, model).where(
        (F.col("lang_pred") != language_ppm.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE) & ~alien).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): the smallest id."""
    small_batches(spark, BATCH_BYTES)
    return near_duplicates.drop_near_duplicates(docs, shingle=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a row for each document and pass with the words taken."""
    small_batches(spark, BATCH_BYTES)
    return source_mix.mix_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece ids of the mixed documents, the text decoded from them."""
    small_batches(spark, BATCH_BYTES)
    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    # written, so that a task holds one Python process at a time
    encoded = cut_lineage(piece_sampling.encode(docs, model, batch_chars=PIECE_CHARS).drop("text"), "pieces")
    return piece_sampling.decode_rows(encoded, model).select(*docs.columns, "piece_ids", "n_pieces", "lossless")


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("mix", mix), ("pieces", pieces)]

# Learned models and signatures can't be written as SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
