"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The code points that separate words, U+0020 and U+0009 to U+000D.
WORD_BREAKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by its Parquet path (any path that Spark's readers can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; NULL or empty text gives an empty array."""
    flat = F.translate(F.coalesce(text, F.lit("")), WORD_BREAKS[1:], " " * 5)
    return F.filter(F.split(flat, " ", -1), lambda w: w != "")


def fold(key: Column, folds: int) -> Column:
    """``crc32(key as text) mod folds``; a NULL key falls into fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8_000_000


def _as_bytes(value: str) -> int:
    unit = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(value[-1:].lower())
    return int(value[:-1]) * unit if unit else int(value)


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Have Spark send rows to Python in batches of at most ``most`` bytes in this session.

    Whole texts and packed blocks are large rows: with the default a batch takes several times 64 MB in each of
    a task's JVM and Python process. A smaller value that is set already stays.
    """
    if _as_bytes(str(spark.conf.get(BATCH_CONF, "67108864b"))) > most:
        spark.conf.set(BATCH_CONF, str(most))


def compact(df: DataFrame) -> DataFrame:
    """Rows of a small result in a sixteenth of the shuffle partitions, so that it is written as few files.

    The work before it keeps its partitions; only the result moves once more.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, parts // 16))
