"""Keeping an index fresh: differences between crawls, micro-batches, late and repeated items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differences(before: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """key and change: new, changed, removed or same, by (modified, size)."""
    a = before.select(key, F.struct("modified", "size").alias("a"))
    b = now.select(key, F.struct("modified", "size").alias("b"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def late_items(stream: DataFrame, id_col: str, ts: str, delay: str) -> DataFrame:
    """A stream with items that come again within ``delay`` left out: a sync that reads an overlap twice."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def bursts(stream: DataFrame, ts: str, gap: str, delay: str, *keys: Column | str) -> DataFrame:
    """Changes that follow each other within ``gap`` as one: the start and end of each burst and how many it has."""
    rows = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("changes"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "changes")


def newest(state: DataFrame, updates: DataFrame, key: str, updated: str) -> DataFrame:
    """One row for each key, the one updated last; where both are as new, the update."""
    rows = state.withColumn("_u", F.lit(0)).unionByName(updates.withColumn("_u", F.lit(1)), allowMissingColumns=True)
    best = F.max_by(F.struct(*state.columns), F.struct(F.col(updated), F.col("_u"))).alias("r")
    return rows.groupBy(F.col(key).alias("_k")).agg(best).select("r.*")


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything that has arrived, in micro-batches, then stop; a rerun goes on where the last one ended."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def marks(items: DataFrame, before: DataFrame, repo: str, updated: str, failed: str) -> DataFrame:
    """repo, mark, failures: how far each repository is read. A failure keeps its own mark where it was and no other one."""
    now = items.groupBy(repo).agg(F.max(updated).alias("_to"), F.count_if(failed).alias("failures"))
    rows = now.join(before.select(repo, F.col("mark").alias("_from")), repo, "full")
    mark = F.when(F.coalesce("failures", F.lit(0)) == 0, F.greatest("_to", "_from")).otherwise(F.col("_from"))
    return rows.select(repo, mark.alias("mark"), F.coalesce("failures", F.lit(0)).alias("failures"))
