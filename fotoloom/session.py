"""Session settings that the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # batches that go to Python: what is long makes batches of fewer rows
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def configured(spark: SparkSession) -> SparkSession:
    """Sets what merges of maps, dates and batches need, the same for all jobs, as plans run later than they are made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
