"""Reading and writing the source files, result tables and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.schemas import BANK_COLUMNS, LABELS, LINE_COLUMNS, ORDER_COLUMNS
from tallyspark.sources.blocks import CsvCells, JsonObjects, read_records


def read_orders_csv(spark: SparkSession, path: str, ordinal: str | None = None) -> DataFrame:
    """All cells as text, by header name, missing ones empty. One large file is read by as many tasks as it has blocks; ``ordinal`` names a column with each record's place in the files."""
    return read_records(spark, path, CsvCells(ORDER_COLUMNS), ordinal)


def read_settlement_csv(spark: SparkSession, path: str, ordinal: str | None = None) -> DataFrame:
    return read_records(spark, path, CsvCells(LINE_COLUMNS), ordinal)


def read_bank_csv(spark: SparkSession, path: str, ordinal: str | None = None) -> DataFrame:
    return read_records(spark, path, CsvCells(BANK_COLUMNS), ordinal)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")


def read_labels_json(spark: SparkSession, path: str, ordinal: str | None = None) -> DataFrame:
    """A JSON array of labels, also in one large file; reading anything else fails."""
    return read_records(spark, path, JsonObjects(LABELS.names), ordinal)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType, key: str = "residue_id") -> tuple[DataFrame, DataFrame]:
    """(rows, torn lines): lines that aren't JSON objects with a text under ``key`` are torn; blank ones are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.col("value").alias("line"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row"))
    good = F.coalesce(F.col(f"row.{key}").isNotNull() & F.get_json_object("line", f"$.{key}").isNotNull(), F.lit(False))
    return parsed.where(good).select("row.*"), parsed.where(~good).select("line")


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds lines; none that is there is rewritten."""
    df.write.mode("append").json(path, ignoreNullFields=False)


def write_match_result(result: dict[str, DataFrame], path: str) -> None:
    """Each table of a reconciliation as Parquet below one path."""
    for name, df in result.items():
        df.write.parquet(f"{path}/{name}")


def write_normalize_log(log: dict[str, DataFrame], path: str) -> None:
    """corrections, samples and rows by source, as JSON lines below one path."""
    for name, df in log.items():
        df.write.json(f"{path}/{name}")
