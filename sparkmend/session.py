"""Session helpers: a local session for tests and benches, and lineage cuts.

On a cluster the session comes from the caller; nothing here changes its
configuration except a checkpoint directory when none is configured and the
master is local (tests, benches).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "sparkmend",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A local session tuned for small test data (AQE on, UTC, no UI)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory of this session.

    The cluster names it in ``spark.checkpoint.dir``; that value is used as is.
    Only a local-mode session without one gets a fresh directory under the
    system temp folder. A cluster session without one is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext here; the server's setting is used
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            return configured
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder (HDFS, S3, ...) for it") from None
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder (HDFS, S3, ...) for it")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkmend-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that begin inside remove their shuffle files when they end.

    Otherwise the files stay until the driver happens to collect its garbage, and an operator of many steps holds those of
    all its steps. The session's own value is put back; Spark before 4.1 does not know the setting and ignores it.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


ADAPTIVE = "spark.sql.adaptive.enabled"


@contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """Plans made inside are not adaptive.

    An adaptive plan runs its shuffles whenever its RDD is asked for, even only for the number of its partitions, as ``fit`` does. The
    session's own value is put back.
    """
    before = spark.conf.get(ADAPTIVE, "true")
    spark.conf.set(ADAPTIVE, "false")
    try:
        yield
    finally:
        spark.conf.set(ADAPTIVE, before)


# for tables of many numeric columns: few values repeat, so dictionaries cost time and are given up; zstd makes the files no larger
NUMERIC_FILES = {"parquet.enable.dictionary": "false", "compression": "zstd"}


def cut_lineage(df: DataFrame, name: str = "cut", options: dict[str, str] | None = None) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    The plan runs once (``Dataset.checkpoint`` would run it a second time to write
    the checkpoint), later reads are columnar and pruned, and a lost executor
    re-reads the files instead of recomputing the lineage. Never machine-local.
    The write's shuffle files go with it. ``options``: of the Parquet writer.
    """
    path = scratch_path(df.sparkSession, name)
    with short_shuffles(df.sparkSession):
        df.write.mode("overwrite").options(**options or {}).parquet(path)
    return df.sparkSession.read.parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files of ``cut_lineage`` tables that no later step reads. Files outside the checkpoint folder stay.

    A Spark Connect session has no file system access here: its files stay for the retention of that folder.
    """
    for df in tables:
        spark = df.sparkSession
        if getattr(spark, "_jvm", None) is None:
            continue
        base = local_path(ensure_checkpoint_dir(spark)).rstrip("/") + "/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            if base in folder:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so Python can look at a local checkpoint path."""
    return path[5:] if path.startswith("file:") else path


__all__ = ["local_session", "ensure_checkpoint_dir", "scratch_path", "cut_lineage", "release", "local_path"]
