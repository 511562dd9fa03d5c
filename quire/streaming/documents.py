"""A directory of texts or documents as a stream: the same rows as the batch plans give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.plans import virtual
from quire.sources import relations


def stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = 16) -> DataFrame:
    """Rows of the files at a path, so many files at a time, or all of them at once."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def word_stream(docs: DataFrame) -> DataFrame:
    """Words of a stream of (doc_id, text); no state, as positions are arithmetic."""
    return virtual.words(docs, numbered=False)


def relation_stream(files: DataFrame, name: str) -> DataFrame:
    return relations.relation(files, name)


def event_counts(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Diagnostic events by window and kind; rows later than the watermark are left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a bounded stream gives, as a table in memory (for tests and small reports)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
