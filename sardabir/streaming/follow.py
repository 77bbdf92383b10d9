"""Findings over a growing folder of blocks, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import typography
from ..sources import store


def follow_blocks(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Blocks of Parquet files as they arrive."""
    return spark.readStream.schema(store.BLOCKS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def follow_issues(blocks: DataFrame) -> DataFrame:
    """The rules' findings in a stream of blocks; the same function serves a table."""
    return typography.messages(typography.find_issues(blocks))


def write_stream(issues: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, exactly once, until nothing is left to read."""
    return issues.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str, rule: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Findings per rule and window of time; rows later than ``late`` are let go, so the state stays bounded."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), rule).agg(F.count("*").alias("n"))
