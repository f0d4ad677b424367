"""Incremental ingestion: new recognised documents are validated, extracted and appended, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import extraction
from ..sources import recognised


def stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (doc_id, json) for the files of a folder."""
    raw = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return raw.select(F.col("_metadata.file_path").alias("doc_id"), F.regexp_replace("value", "^﻿", "").alias("json"))


def run(spark: SparkSession, folder: str, target: str, checkpoint: str, tables: tuple[str, ...] = ("entities", "parties", "results", "quarantined")) -> None:
    """Process what is new and stop.  A batch that runs again writes to the same folder, so it counts once."""

    def batch(frame: DataFrame, number: int) -> None:
        found = extraction.from_documents(recognised.parse(frame))
        for name in tables:
            found[name].write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
