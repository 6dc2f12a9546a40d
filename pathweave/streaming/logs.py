"""Run logs as streams: windows, sessions, the latest record and the running best of each run."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: Any, time: str = "ts", files_per_trigger: int = 100) -> DataFrame:
    """A file stream with its event time as a timestamp."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """(start, end, keys, n, value): counts and sums per window; events later than ``late`` are left out when the
    input is a stream."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    g = e.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "value")


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """(start, end, key, n): runs of events of a key with less than ``gap`` between neighbours."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    g = e.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def once_per_id(events: DataFrame, time: str, late: str, key: str) -> DataFrame:
    """Events without those delivered again within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def latest(events: DataFrame, run: str, order: str) -> DataFrame:
    """The latest record of each run, for update mode."""
    return events.groupBy(run).agg(F.max_by(F.struct(*[c for c in events.columns if c != run]), order).alias("r")).select(run, "r.*")


def early_stopping(events: DataFrame, run: str, step: str, metric: str, patience: int, delta: float = 0.0) -> DataFrame:
    """(run, step, best, waited, stopped): the state of each run after each micro-batch."""

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, waited, last, stopped = state.get if state.exists else (float("-inf"), 0, -1, False)
        rows = pd.concat(list(batches)).sort_values(step)
        for s, m in zip(rows[step], rows[metric]):
            if m > best + delta:
                best, waited = float(m), 0
            else:
                waited += 1
            last, stopped = int(s), stopped or waited >= patience
        state.update((best, waited, last, stopped))
        yield pd.DataFrame({run: [key[0]], step: [last], "best": [best], "waited": [waited], "stopped": [stopped]})

    kind = dict(events.dtypes)
    return events.select(run, step, metric).groupBy(run).applyInPandasWithState(
        fold, f"{run} {kind[run]}, {step} long, best double, waited int, stopped boolean", "best double, waited int, last long, stopped boolean", "update", GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All of a stream that is there now, as a table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
