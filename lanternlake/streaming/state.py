"""Stateful behaviour on streams and, with the same functions, on tables: capture once, counts in windows, account state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(rows: DataFrame, time: str, lateness: str) -> DataFrame:
    """rows with a watermark; a time without zone is taken as the session's."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)


def capture_once(rows: DataFrame, keys: list[str], time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Each key's first row.  On a stream, state is dropped as the watermark passes."""
    if rows.isStreaming:
        return timed(rows, time, lateness).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


def windowed_counts(events: DataFrame, width: str, time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Count and sum by tumbling window and type; late events within the watermark are taken in."""
    rows = timed(events, time, lateness) if events.isStreaming else events
    out = rows.groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def account_state(events: DataFrame, saved: Column, key: str = "user_id") -> DataFrame:
    """Seen and saved counts and the status of each account, of a table."""
    out = events.groupBy(key).agg(F.count(F.lit(1)).alias("seen"), F.sum(saved.cast("long")).alias("saved"))
    return out.withColumn("status", F.when(F.col("saved") > 0, "active").otherwise("scanned_no_relevant_posts"))


def account_stream(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The same on a stream of rows (key, saved): running counts in keyed state, an update for each batch of a key."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, saved = state.get if state.exists else (0, 0)
        for b in batches:
            seen, saved = seen + len(b), saved + int(b["saved"].sum())
        state.update((seen, saved))
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "saved": [saved], "status": ["active" if saved else "scanned_no_relevant_posts"]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, seen long, saved long, status string", "seen long, saved long", "update", GroupStateTimeout.NoTimeout)


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Append-only JSON log, exactly once."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def upsert_new(spark, path: str, key: str):
    """For foreachBatch: appends the rows whose key the table at path doesn't have yet."""

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            known = spark.read.parquet(path).select(key)
        except Exception as missing:  # the table isn't there before the first batch
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            fresh.write.parquet(path)
            return
        fresh.join(known, key, "left_anti").write.mode("append").parquet(path)

    return write
