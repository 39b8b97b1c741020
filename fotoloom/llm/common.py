"""Things that all text operators share: tables written between stages, and input shapes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, numbered, ordered, partitions_for, scan, shared_folder, written

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BATCH_ROWS = 2000

__all__ = ["as_bytes", "column_of", "discard", "id_crc32", "numbered", "ordered", "partitions_for", "scan", "shared_folder", "small_batches", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: str) -> Column:
    return F.col(column).cast("binary")


def id_crc32(column: str = "doc_id") -> Column:
    """crc32 of an integer id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as single texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def column_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
