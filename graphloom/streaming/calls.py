"""Streaming counterparts: windowed usage counts, debounced file events, incremental re-indexing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.incremental import VersionedTarget, run_increment


def call_windows(calls: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(tool, start, calls, mean_ms) of tumbling or sliding windows; rows later than ``late`` are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return calls.withWatermark("ts", late).groupBy("tool", window.alias("w")).agg(F.count("*").alias("calls"), F.avg("ms").alias("mean_ms")).select("tool", F.col("w.start").alias("start"), "calls", "mean_ms")


def call_sessions(calls: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(agent, start, stop, calls) of sessions that end after a gap without calls."""
    return calls.withWatermark("ts", late).groupBy("agent", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("calls")).select("agent", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "calls")


def debounced(events: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(root, start, stop, files) of bursts of file events: a root is due once it has been quiet for a while.

    ``files`` counts different paths by sketch, with the usual error of some per cent, since a stream keeps no exact set.
    """
    bursts = events.withWatermark("ts", late).groupBy("root", F.session_window("ts", quiet).alias("w")).agg(F.approx_count_distinct("rel_path").alias("files"))
    return bursts.select("root", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "files")


def reindex(changes: DataFrame, target: VersionedTarget, key: Sequence[str], version: str, process: Callable[[DataFrame], DataFrame], snapshot: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Run an increment for each micro-batch of changes; ``snapshot`` gives the source's state after a batch.

    A batch that is repeated after a failure finds its records in the target and publishes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        run_increment(snapshot(batch), target, key, version, process)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
