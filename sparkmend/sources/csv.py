"""Raw CSV tables: read as text, normalise missing-value tokens, then cast by contract.

Reading every column as a string keeps the header as written (for the column
contract) and keeps bad values visible: a typed CSV read would turn ``abc`` in
a numeric column into NULL silently (PERMISSIVE) or fail on ``NA`` (FAILFAST).
Casting is ``try_cast`` so the gate can count cells that do not parse.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmend import contracts as C
from sparkmend.functions.columns import parse_datetime, parse_datetime_as, try_parse_datetime, try_parse_integer
from sparkmend.session import cut_lineage

# Text read as a missing value (the pandas read_csv default set).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Timestamps are written with full microseconds so a round trip is exact.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


# One dialect for reading and writing: quotes are doubled inside quotes, blanks belong to the value.
DIALECT = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# Added by ``read_text_csv(mark_malformed=True)``: true where a row has more cells than the header.
MALFORMED = "__malformed"


MAX_HEADERS = 64  # different headers among the files of one table, beyond which the table is refused


def without_quoted(line: Column) -> Column:
    """A line with its quoted cells blanked: what is left of a plain line holds no quote, and a comma only between cells."""
    return F.regexp_replace(F.replace(line, F.lit('""'), F.lit("")), r'(^|,)"[^"]*"(?=,|$)', "$1")


def cell_count(record: Column) -> Column:
    """Number of cells of a record's text."""
    bare = without_quoted(F.regexp_replace(record, r"[\r\n]+$", ""))
    return F.char_length(bare) - F.char_length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def audit_csv(spark: SparkSession, path: str) -> DataFrame:
    """``file, header, ragged``: each file's first line with text, and the number of lines that are not whole records.

    A line is whole if its quotes only surround cells and are closed on the line. If all lines of a file are whole, no value holds a
    line break, so the file may be split between tasks. One scan of the lines, aggregated before the shuffle to a row a file.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
    value = F.col("value")
    ragged = (F.instr(value, '"') > 0) & (F.instr(without_quoted(value), '"') > 0)
    return lines.where(F.trim(value) != "").groupBy("file").agg(F.min_by("value", "at").alias("header"), F.count_if(ragged).alias("ragged"))


@dataclass(frozen=True)
class CsvTable:
    """A CSV table as read, and the headers of its files: (columns, number of files), the most frequent first."""

    df: DataFrame
    headers: tuple[tuple[tuple[str, ...], int], ...] = ()


def _read(spark: SparkSession, paths: str | list[str], multiline: bool, mark_malformed: bool) -> DataFrame:
    reader = spark.read.options(**DIALECT, mode="PERMISSIVE", multiLine=str(multiline).lower())
    raw = reader.csv(paths)
    if not mark_malformed or not raw.columns:
        return normalise_na(raw)
    corrupt = "__corrupt"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*raw.columns, corrupt)])
    marked = reader.schema(schema).option("columnNameOfCorruptRecord", corrupt).csv(paths)
    # the text of a record is kept where it has another number of cells than the header
    surplus = F.coalesce(cell_count(F.col(corrupt)) > len(raw.columns), F.lit(False))
    return normalise_na(marked.select(*[F.col(f"`{c}`") for c in raw.columns], surplus.alias(MALFORMED)))


def _literal_path(uri: str) -> str:
    """A file's path from its metadata, with the characters that Spark would expand in a path escaped."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(uri))


def read_csv_table(spark: SparkSession, path: str, multiline: bool | None = None, mark_malformed: bool = False) -> CsvTable:
    """``read_text_csv`` with what its audit found about the headers (nothing when ``multiline`` is given)."""
    if multiline is not None:
        return CsvTable(_read(spark, path, multiline, mark_malformed))
    audit = audit_csv(spark, path)
    kinds = audit.groupBy("header").agg(F.count("*").alias("files"), F.count_if(F.col("ragged") > 0).alias("whole"),
                                        F.min("file").alias("first")).limit(MAX_HEADERS + 1).collect()
    if len(kinds) > MAX_HEADERS:
        raise ValueError(f"the files under {path} have more than {MAX_HEADERS} different headers")
    kinds.sort(key=lambda r: (-r.files, r.first))
    if len(kinds) <= 1:
        many = bool(kinds and kinds[0].whole)
        if not many:
            df = _read(spark, path, False, mark_malformed)
            return CsvTable(df, _headers([(df, kinds[0].files)]) if kinds else ())
    # files that must be read whole, or with another header, are named one by one
    audit = cut_lineage(audit, "csv-audit")
    parts, columns = [], []
    for kind in kinds:
        files = audit.where(F.col("header") == F.lit(kind.header)).select("file", (F.col("ragged") > 0).alias("whole")).collect()
        both = [(whole, [_literal_path(r.file) for r in files if r.whole is whole]) for whole in (False, True)]
        read = [_read(spark, sorted(names), whole, mark_malformed) for whole, names in both if names]
        columns.append((read[0], kind.files))
        parts += read
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part, allowMissingColumns=True)
    if mark_malformed:
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != MALFORMED], MALFORMED)
    return CsvTable(df, _headers(columns))


def _headers(read: list[tuple[DataFrame, int]]) -> tuple[tuple[tuple[str, ...], int], ...]:
    return tuple((tuple(c for c in df.columns if c != MALFORMED), files) for df, files in read)


def read_text_csv(spark: SparkSession, path: str, multiline: bool | None = None, mark_malformed: bool = False) -> DataFrame:
    """Headered CSV with every column as a string; missing-value tokens become NULL.

    By default an audit of the lines (one more scan, see ``audit_csv``) finds the files in which a value holds a line break: only they are
    read by one task each, all others are split. Files whose header differs are read by their own header and joined by column name; a
    column that a file lacks is NULL there. ``multiline`` given as True or False skips the audit and reads all files whole, or split.
    ``mark_malformed`` adds the column ``MALFORMED``: true where a row has more cells than the header; a short row is no
    error (its missing cells are NULL).
    """
    return read_csv_table(spark, path, multiline, mark_malformed).df


def try_read_csv_table(spark: SparkSession, path: str, mark_malformed: bool = False) -> CsvTable | None:
    """``read_csv_table``, or None when the path does not exist."""
    try:
        return read_csv_table(spark, path, mark_malformed=mark_malformed)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


def normalise_na(df: DataFrame) -> DataFrame:
    """Cells equal to one of ``NA_TOKENS`` become NULL (string columns only)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def cast_to_contract(df: DataFrame, contract: C.TableContract, strict_datetime: bool = True,
                     datetime_form: str | None = None) -> DataFrame:
    """Text columns -> declared types, in contract order.

    Numbers use ``try_cast`` (bad cells become NULL and are counted by the raw
    gate). ``datetime`` raises on unparseable text when ``strict_datetime``, as the
    merge step requires; otherwise it becomes NULL. ``datetime_form`` is the one form that the column's
    values have (see ``columns.datetime_votes``); without it each value is parsed by the first form that fits.
    """
    out = []
    for f in contract.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampNTZType):
            if datetime_form is not None and isinstance(df.schema[f.name].dataType, T.StringType):
                c = parse_datetime_as(c, datetime_form, f.name, strict_datetime)
            else:
                c = parse_datetime(c, name=f.name) if strict_datetime else try_parse_datetime(c)
        elif isinstance(f.dataType, (T.LongType, T.IntegerType)):
            c = try_parse_integer(c, f.dataType.simpleString())
        elif not isinstance(f.dataType, T.StringType):
            c = c.try_cast(f.dataType.simpleString())
        out.append(c.alias(f.name))
    return df.select(*out)


def read_typed_csv(spark: SparkSession, path: str, contract: C.TableContract,
                   strict_datetime: bool = True) -> DataFrame:
    return cast_to_contract(read_text_csv(spark, path), contract, strict_datetime)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headered CSV, no index column, timestamps with microseconds."""
    (df.write.mode(mode).options(**DIALECT)
     .option("timestampNTZFormat", TIMESTAMP_FORMAT)
     .option("timestampFormat", TIMESTAMP_FORMAT)
     .csv(path))
