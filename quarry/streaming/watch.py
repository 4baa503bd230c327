"""Streams: files that arrive are tagged, and change events are counted in windows.

The index itself is built in batches; this is the way to keep tags and history current between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import tags
from quarry.functions.paths import is_test, language


def tag_stream(files: DataFrame, content: str = "content") -> DataFrame:
    """Language, digest, effects and risks of a stream of relpath and content; stateless, so any sink and mode will do."""
    text = F.col(content).cast("string")
    tagged = files.select("relpath", tags.effects(text).alias("effects"), tags.risks(F.lit(""), F.lit(""), text).alias("risks"), F.col(content).alias("content"))
    metrics = [language(F.col("relpath")).alias("language"), is_test(F.col("relpath")).alias("is_test"), F.sha2(F.col("content").cast("binary"), 256).alias("digest")]
    return tagged.select("relpath", *metrics, "effects", "risks")


def churn_windows(log: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Churn and changes of a path in event-time windows of a stream of log rows (ts in seconds); late rows within bounds count."""
    timed = log.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    grouped = timed.groupBy(F.window("at", width), "path").agg(F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.count(F.lit(1)).alias("changes"))
    return grouped.select(F.col("window.start").alias("start"), "path", "churn", "changes")


def rescan_on_change(files: DataFrame, scan: Callable[[], object], checkpoint: str):
    """Starts a query that scans again for each batch of arrivals; the scan parses changed files only."""
    return files.writeStream.foreachBatch(lambda batch, _: scan() if batch.limit(1).count() else None).option("checkpointLocation", checkpoint).start()
