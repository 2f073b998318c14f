"""Versions of properties and lifecycles, as-of states and their differences.

A version holds from its event's time up to the next one's; at equal times the later append wins, so the version in
force at t is the last in append order among those with ts <= t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record_history(updates: DataFrame, keys: list[str], order: str = "seq", ts: str = "ts") -> DataFrame:
    """``updates`` with until_ts and until_seq, when the next version of the same keys starts (null: still open)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return updates.withColumns({"until_ts": F.lead(ts).over(w), "until_seq": F.lead(order).over(w)})


def in_force(at: Column) -> Column:
    """Whether a version is the one in force at a time; a version that the same instant ends never is."""
    return (F.col("ts") <= at) & (F.col("until_ts").isNull() | (at < F.col("until_ts")))


def alive_at(at: Column, born: str = "born_ts", died: str = "died_ts") -> Column:
    """Liveness at a time, false before creation."""
    return (F.col(born) <= at) & (F.col(died).isNull() | (at < F.col(died)))


def state_at(versions: DataFrame, life: DataFrame, at: Column) -> DataFrame:
    """The version of each property in force at a time, of the nodes that are alive then."""
    return versions.filter(in_force(at)).join(life.filter(alive_at(at)).select("node_id"), "node_id", "left_semi")


def graph_at(life: DataFrame, edge_life: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges alive at a time; an edge needs both ends alive."""
    nodes = life.filter(alive_at(at)).select("node_id")
    edges = edge_life.filter(alive_at(at))
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    return nodes, edges


def diff(versions: DataFrame, life: DataFrame, edge_life: DataFrame, t1: Column, t2: Column) -> DataFrame:
    """kind (node_created, node_deleted, node_changed, edge_created, edge_deleted) and id of what differs from t1 to t2."""
    def change(df: DataFrame, key: str, what: str) -> DataFrame:
        was, now = alive_at(t1), alive_at(t2)
        kind = F.when(~was & now, f"{what}_created").when(was & ~now, f"{what}_deleted")
        return df.select(kind.alias("kind"), F.col(key).alias("id")).filter("kind is not null")

    value = F.struct("s", "d")
    a = state_at(versions, life, t1).select("node_id", "key", value.alias("a"))
    b = state_at(versions, life, t2).select("node_id", "key", value.alias("b"))
    both = a.join(b, ["node_id", "key"]).filter(~F.col("a").eqNullSafe(F.col("b")))
    changed = both.select(F.lit("node_changed").alias("kind"), F.col("node_id").alias("id")).distinct()
    return change(life, "node_id", "node").unionByName(change(edge_life, "edge_id", "edge")).unionByName(changed)


def samples(spark, t1, t2, n: int) -> DataFrame:
    """nth, at of n evenly spaced times from t1 to t2 (datetimes), in whole milliseconds; none if n < 2."""
    if n < 2:
        return spark.createDataFrame([], "nth long, at timestamp_ntz")
    step = int((t2 - t1).total_seconds() * 1000) // (n - 1)
    grid = spark.range(n).select(F.col("id").alias("nth"))
    return grid.select("nth", F.lit(t1).cast("timestamp_ntz").alias("t0")).select("nth", (F.col("t0") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("nth") * step / 1000).cast("decimal(18,6)"))).alias("at"))


def trend(versions: DataFrame, life: DataFrame, grid: DataFrame) -> DataFrame:
    """The versions in force at each time of ``grid`` (nth, at), all in one range join."""
    force = (F.col("ts") <= F.col("at")) & (F.col("until_ts").isNull() | (F.col("at") < F.col("until_ts")))
    rows = versions.join(F.broadcast(grid), force)  # the grid has as many rows as the caller asked for
    return rows.join(life, "node_id").filter(alive_at(F.col("at")))
