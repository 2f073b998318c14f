"""Rate and threshold detectors over event streams, in their batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rate detector's smoothing, limits and warm-up, and the limits of the others.
ALPHA, WARM_UP, WARN_SIGMA, CRITICAL_SIGMA, NORMAL_RATE, VARIANCE_FLOOR = 0.2, 5, 3.0, 5.0, 5.0, 1.0
LAG_CRITICAL, LAG_WARNING, STALE_SECONDS = 100, 10, 60
STORM = {"events": (50, 200), "actions": (10, 50), "actor": (30, 100)}
FAILURES, FAILURE_RATIO, FAILURE_SAMPLE = (3, 10), (0.25, 0.50), 5


def window_counts(events: DataFrame, seconds: int, keys: list[str] | None = None) -> DataFrame:
    """keys, start, n for each tumbling window, empty ones between the first and the last included."""
    keys = keys or []
    start = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("long")
    counts = events.groupBy(*keys, start.alias("start")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.groupBy(*keys).agg(F.explode(F.sequence(F.min("start"), F.max("start"), F.lit(seconds).cast("long"))).alias("start")) if keys else counts.agg(F.sequence(F.min("start"), F.max("start"), F.lit(seconds).cast("long")).alias("s")).select(F.explode("s").alias("start"))
    return grid.join(counts, [*keys, "start"], "left").fillna(0, ["n"])


def commit_rate(counts: DataFrame, seconds: int, key: str | None = None) -> DataFrame:
    """nth, rate, expected, z, level of each window of a series, in order: an exponentially weighted mean and variance
    judge a rate before they take it in. One series is one ordered fold; series are spread by ``key``."""
    rate = F.col("n") * 60.0 / seconds
    series = counts.groupBy(*([key] if key else [])).agg(F.sort_array(F.collect_list(F.struct("start", rate.alias("rate")))).alias("s"))
    zero = F.struct(F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"), F.array().cast("array<struct<start:bigint,rate:double,expected:double,z:double,level:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        first, r = a["k"] == 0, x["rate"]
        delta = r - a["mean"]
        z = F.when(a["k"] < WARM_UP, 0.0).otherwise(delta / F.sqrt(F.greatest(a["var"], F.lit(VARIANCE_FLOOR))))
        level = F.when((a["k"] < WARM_UP) | (a["mean"] <= NORMAL_RATE), "normal").when(F.abs(z) >= CRITICAL_SIGMA, "critical").when(F.abs(z) >= WARN_SIGMA, "warning").otherwise("normal")
        mean = F.when(first, r).otherwise(a["mean"] + ALPHA * delta)
        var = F.when(first, 0.0).otherwise((1 - ALPHA) * (a["var"] + ALPHA * delta * delta))
        row = F.struct(x["start"].alias("start"), r.alias("rate"), a["mean"].alias("expected"), z.alias("z"), level.alias("level"))
        return F.struct((a["k"] + 1).alias("k"), mean.alias("mean"), var.alias("var"), F.concat(a["out"], F.array(row)).alias("out"))

    folded = series.select(*([key] if key else []), F.aggregate("s", zero, step)["out"].alias("out"))
    return folded.select(*([key] if key else []), F.inline("out"))


def replication_lag(latest: DataFrame, now: Column) -> DataFrame:
    """peer_id, lag, level from each replica's latest lag and heartbeat (peer_id, lag, ts)."""
    stale = F.col("ts").isNull() | (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")) > STALE_SECONDS)
    level = F.when(stale | (F.col("lag") >= LAG_CRITICAL), "critical").when(F.col("lag") >= LAG_WARNING, "warning").otherwise("normal")
    return latest.select("peer_id", "lag", level.alias("level"))


def storm_level(events: Column, actions: Column, actor: Column) -> Column:
    at = lambda i: (events >= STORM["events"][i]) | (actions >= STORM["actions"][i]) | (actor >= STORM["actor"][i])
    return F.when(at(1), "critical").when(at(0), "warning").otherwise("normal")


def agent_storm(events: DataFrame, seconds: int = 60, system: list[str] | None = None) -> DataFrame:
    """start, n_events, n_actions, top_actor, top_n, level of each window with events (ts, actor, is_action)."""
    start = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("long")
    rows = events.filter(~F.col("actor").isin(system)) if system else events
    per = rows.groupBy(start.alias("start"), "actor").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_action").alias("m"))
    top = F.max(F.struct(F.col("n"), F.col("actor")))
    out = per.groupBy("start").agg(F.sum("n").alias("n_events"), F.sum("m").alias("n_actions"), top.alias("top"))
    return out.select("start", "n_events", "n_actions", F.col("top.actor").alias("top_actor"), F.col("top.n").alias("top_n"), storm_level(F.col("n_events"), F.col("n_actions"), F.col("top.n")).alias("level"))


def action_failures(events: DataFrame, seconds: int = 300) -> DataFrame:
    """start, n, failed, level of each window (ts, failed)."""
    start = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("long")
    rows = events.groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failed"))
    at = lambda i: (F.col("failed") >= FAILURES[i]) | ((F.col("n") >= FAILURE_SAMPLE) & (F.col("failed") / F.col("n") >= FAILURE_RATIO[i]))
    return rows.withColumn("level", F.when(at(1), "critical").when(at(0), "warning").otherwise("normal"))


def sessions(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """key, start, n, seconds of each session: events with no pause longer than the gap."""
    w = Window.partitionBy(key).orderBy("seq")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.coalesce((micros - F.lag(micros).over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    rows = events.withColumn("micros", micros).withColumn("new", new).withColumn("nth", F.sum("new").over(w))
    return rows.groupBy(key, "nth").agg(F.min("micros").alias("start"), F.count(F.lit(1)).alias("n"), (F.max("micros") - F.min("micros")).alias("micros")).drop("nth")
