"""Structured Streaming forms of the detectors, deduplication and the commit tail."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import detectors as D


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Events of a folder as they arrive; ts becomes a timestamp, as event time needs."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def rates(events: DataFrame, width: str = "1 minute", late: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """start, keys, n of tumbling windows; later events than the watermark allows are dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), *(keys or [])).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.unix_seconds("window.start").alias("start"), *(keys or []), "n")


def storms(events: DataFrame, width: str = "60 seconds", slide: str = "10 seconds", late: str = "1 hour") -> DataFrame:
    """start, n_events, n_actions and level of sliding windows (ts, is_action)."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n_events"), F.count_if("is_action").alias("n_actions"))
    return rows.select(F.unix_seconds("window.start").alias("start"), "n_events", "n_actions", D.storm_level(F.col("n_events"), F.col("n_actions"), F.lit(0)).alias("level"))


def user_sessions(events: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.unix_micros("session_window.start").alias("start"), "n")


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, with bounded state."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def _judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    k, mean, var = state.get if state.exists else (0, 0.0, 0.0)
    rows: list[tuple[Any, ...]] = []
    for start, rate in pd.concat(frames).sort_values("start")[["start", "rate"]].itertuples(index=False):
        delta = rate - mean
        z = 0.0 if k < D.WARM_UP else delta / max(var, D.VARIANCE_FLOOR) ** 0.5
        quiet = k < D.WARM_UP or mean <= D.NORMAL_RATE
        level = "normal" if quiet or abs(z) < D.WARN_SIGMA else "critical" if abs(z) >= D.CRITICAL_SIGMA else "warning"
        rows.append((key[0], int(start), float(rate), float(mean), float(z), level))
        mean, var = (rate, 0.0) if k == 0 else (mean + D.ALPHA * delta, (1 - D.ALPHA) * (var + D.ALPHA * delta * delta))
        k += 1
    state.update((k, float(mean), float(var)))
    yield pd.DataFrame(rows, columns=["key", "start", "rate", "expected", "z", "level"])


def rate_verdicts(counts: DataFrame, seconds: int, key: str) -> DataFrame:
    """Verdicts of each key's rate against its running mean and variance, which are the state (key, start, n)."""
    rows = counts.select(F.col(key).cast("string").alias("key"), "start", (F.col("n") * 60.0 / seconds).alias("rate"))
    return rows.groupBy("key").applyInPandasWithState(_judge, "key string, start long, rate double, expected double, z double, level string", "k long, mean double, var double", "append", GroupStateTimeout.NoTimeout)


def commit_tail(spark: SparkSession, path: str, schema: str, after: int = 0) -> DataFrame:
    """Commits of a folder after a sequence, as they are appended."""
    return spark.readStream.schema(schema).json(path).filter(F.col("sequence") > after)


def drain(df: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and gives its rows; ``path`` takes them batch by batch."""
    spark = df.sparkSession
    sink = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{path}-state")
    query = sink.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)).start()
    query.awaitTermination()
    rows = spark.read.parquet(path)
    if mode == "append":
        return rows.drop("batch")
    return rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch") if mode == "complete" else rows
