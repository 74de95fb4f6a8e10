"""Incremental ledgers and windows with Structured Streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of tumbling windows; the same plan over a table or a stream (where late data is dropped)."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "n", "total")


def append_verdicts(stream: DataFrame, path: str, checkpoint: str, key: str, ts: str | None = None, late: str = "1 hour"):
    """Each key once; a restart goes on where the last run ended.

    A batch is written to a folder of its own number, so a batch that is tried again takes its own place and not another.
    Keys are remembered for ever, or, with a time column, as long as `late` says.
    """
    once = stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if ts else stream.dropDuplicates([key])
    return (
        once.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").json(f"{path}/batch={n}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def gate_stream(scores: DataFrame, path: str, checkpoint: str, key: str, order: str, score: str, min_delta: float = 0.0, patience: int = 3):
    """The early-stop gate over a stream of (key, order, score): after each batch a row per key with its state.

    State per key is four numbers; scores of a batch are taken in their order.
    """
    schema = f"{key} string, n int, best double, best_index int, stop boolean"

    def update(k, frames, state):
        n, best, at = state.get if state.exists else (0, float("-inf"), -1)
        for x in pd.concat(list(frames)).sort_values(order)[score]:
            if x > best + min_delta:
                best, at = float(x), n
            n += 1
        state.update((n, best, at))
        yield pd.DataFrame([(k[0], n, best, at, patience > 0 and n - 1 - at >= patience)], columns=[key, "n", "best", "best_index", "stop"])

    out = scores.groupBy(key).applyInPandasWithState(update, schema, "n int, best double, at int", "update", "NoTimeout")
    return (
        out.writeStream.outputMode("update")
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").json(f"{path}/batch={n}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def update_metrics(rollouts: DataFrame, update: str, reward: str, resolved: str) -> DataFrame:
    """Per update: rollouts, mean and best reward, share resolved; the same plan over a table or a stream."""
    return rollouts.groupBy(update).agg(
        F.count("*").alias("n"), F.round(F.avg(reward), 6).alias("mean_reward"), F.max(reward).alias("best_reward"),
        F.round(F.count_if(resolved) / F.greatest(F.lit(1), F.count("*")), 6).alias("rate"),
    )
