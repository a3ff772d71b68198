"""Helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at a time, so that a batch of long texts stays a few MB.
BATCH_ROWS = 500

#: A word is a run of characters other than space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def bytes_of(text: str = "text") -> Column:
    """A text column as UTF-8 bytes, which Arrow hands over without decoding; null stays null."""
    return F.col(text).cast("string").cast("binary")
