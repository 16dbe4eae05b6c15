"""Incremental work: changed files by time then hash, and streaming forms of the same plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def changed(listing: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``listing(path, mtime, content)`` against ``snapshot(path, mtime, sha)``: re-index, touch, remove.

    A file with the recorded time is skipped before it is hashed; equal hashes only refresh the time; recorded
    files that are gone are stale.
    """
    late = listing.join(snapshot.select("path", "mtime"), ["path", "mtime"], "left_anti").withColumn("sha", F.sha2("content", 256))
    known = snapshot.select("path", F.col("sha").alias("old"))
    judged = late.join(known, "path", "left")
    same = F.coalesce(F.col("sha") == F.col("old"), F.lit(False))
    return judged.where(~same).drop("old"), judged.where(same).select("path", "mtime", "sha"), snapshot.join(listing.select("path"), "path", "left_anti")


def event_windows(events: DataFrame, length: str = "10 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Counts and sums by type and tumbling window; batch without ``late``, streaming with that watermark."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def on_new_files(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands each micro-batch of new or changed files to ``refresh``; state lies in ``checkpoint``."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(refresh)
