"""Document collections: a full scan of each collection into a DataFrame, and appends.

A collection is a folder of JSON-lines files (one document per line), as a
document-store export writes it. The scan reads every document with no filter
or projection, drops the store's generated ``_id``, and yields one lazy
DataFrame per collection. Where a document-store connector is installed,
``spark.read.format(<connector>)`` can replace ``read_collection`` unchanged.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmend import contracts as C
from sparkmend.sources.csv import TIMESTAMP_FORMAT, write_csv


def read_collection(spark: SparkSession, path: str, schema: T.StructType | None = None
                    ) -> DataFrame:
    """All documents of one collection; ``_id`` dropped if present.

    With ``schema=None`` the field set is inferred from the documents (the union
    of fields seen, one extra pass); with a schema the scan reads only its fields.
    """
    reader = spark.read.option("timestampNTZFormat", TIMESTAMP_FORMAT)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    return df.drop("_id")


def load_collections(spark: SparkSession, root: str, names: list[str] | None = None,
                     schemas: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """One lazy DataFrame per configured collection name (default: the five raw tables)."""
    names = C.RAW_TABLE_ORDER if names is None else names
    schemas = schemas or {}
    return {n: read_collection(spark, f"{root.rstrip('/')}/{n}", schemas.get(n)) for n in names}


def append_documents(df: DataFrame, path: str) -> None:
    """Bulk load: append every row as a document. Re-running appends the rows again."""
    (df.write.mode("append").option("timestampNTZFormat", TIMESTAMP_FORMAT)
     .option("ignoreNullFields", False).json(path))


@dataclass(frozen=True)
class IngestionArtifact:
    raw_data_dir: str
    tables: tuple[str, ...]


def read_collection_as_text(spark: SparkSession, path: str, order: list[str] | None = None
                            ) -> DataFrame:
    """Every field seen in any document, values as text; ``_id`` dropped.

    Fields stand in the order of the first document (or of ``order``, if given); fields that it
    lacks follow, sorted. So the column check sees the order and the fields that are stored.
    Nested values are kept as JSON text.
    """
    df = spark.read.option("primitivesAsString", True).json(path).drop("_id")
    if order is None:
        head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
        order = list(json.loads(head[0].value)) if head else []
    cols = [c for c in order if c in df.columns] + sorted(c for c in df.columns if c not in order)
    out = []
    for c in cols:
        t = df.schema[c].dataType
        col = F.col(f"`{c}`")
        out.append((F.to_json(col) if isinstance(t, (T.StructType, T.ArrayType, T.MapType)) else col)
                   .alias(c))
    return df.select(*out)


def ingest(spark: SparkSession, collections_root: str, raw_data_dir: str,
           names: list[str] | None = None, infer_fields: bool = True) -> IngestionArtifact:
    """Stage 1: every collection -> one headered CSV table under ``raw_data_dir`` (overwrite).

    With ``infer_fields`` (default) the table holds every field seen in the
    documents, as the raw data arrived (one extra pass to find the fields); without
    it, only the contract's fields are read. Each table is one write job; nothing
    is held in driver memory between them.
    """
    names = C.RAW_TABLE_ORDER if names is None else names
    root = collections_root.rstrip("/")
    for name in names:
        contract = C.RAW_CONTRACTS.get(name)
        if infer_fields or contract is None:
            df = read_collection_as_text(spark, f"{root}/{name}")
        else:
            df = read_collection(spark, f"{root}/{name}", contract.text_schema())
        write_csv(df, f"{raw_data_dir.rstrip('/')}/{name}.csv")
    return IngestionArtifact(raw_data_dir, tuple(names))
