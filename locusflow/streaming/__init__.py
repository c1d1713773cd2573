"""Streaming forms of operators, on watermarked event time, and streams of text records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _marked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark, which needs a timestamp with time zone; a table as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of sessions; works on streams and on tables."""
    rows = _marked(events, time, late)
    return rows.groupBy(F.col(key), F.session_window(time, gap).alias("w")).count().select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("count").alias("n"))


def window_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    rows = _marked(events, time, late)
    return rows.groupBy(F.col(key), F.window(time, size).alias("w")).count().select(key, F.col("w.start").alias("start"), F.col("count").alias("n"))


def first_events(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One event for each value of keys; on a stream, within the watermark."""
    return _marked(events, time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def stream_bed(spark: SparkSession, folder: str, columns: int = 12) -> DataFrame:
    """BED rows of files as they come into a folder."""
    from ..sources.formats import bed_rows

    return bed_rows(spark.readStream.text(folder), columns)


def stream_gff(spark: SparkSession, folder: str) -> DataFrame:
    """GFF2 features of files as they come into a folder."""
    from ..sources.formats import gff_rows

    return gff_rows(spark.readStream.text(folder))


def stream_fastq(spark: SparkSession, folder: str, encoding: str = "sanger") -> DataFrame:
    """FASTQ records of files as they come into a folder."""
    from ..sources.formats import fastq_records

    return fastq_records(spark.readStream.option("wholetext", True).text(folder), encoding)
