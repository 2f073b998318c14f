"""Counterfactuals: how the graph would differ if some events, and all that they caused, had not happened.

Both graphs are folds of the log, with all of it and without what each root takes away; they are compared both ways.
A replay follows the same rules: what a node lacks at that time (its creation, or its life) makes an event of it void.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import keep

NODE_WEIGHT, EDGE_WEIGHT, PROPERTY_WEIGHT = 10, 5, 1  # fixed values of the impact magnitude
CHANGES = ("NodeCreated", "NodeUpdated")


def lives(log: DataFrame) -> DataFrame:
    """node_id, born, died (seq) of each node that a log has events of."""
    when = lambda k: F.min(F.when(F.col("kind") == k, F.col("seq")))
    return log.filter("node_id is not null").groupBy("node_id").agg(when("NodeCreated").alias("born"), when("NodeDeleted").alias("died"))


def _alive(born, died, at):
    return (born < at) & (died.isNull() | (died > at))


def applied(log: DataFrame) -> DataFrame:
    """seq of the events that a replay of the log applies."""
    life = lives(log)
    made = log.filter("kind = 'EdgeCreated'").select("seq", "edge_id", "src", "dst")
    for end in ("src", "dst"):
        made = made.join(life.select(F.col("node_id").alias(end), F.col("born").alias(f"{end}_born"), F.col("died").alias(f"{end}_died")), end)
        made = made.filter(_alive(F.col(f"{end}_born"), F.col(f"{end}_died"), F.col("seq")))
    nodes = log.join(life.select("node_id", "born", "died"), "node_id").filter(f"born is not null and (kind = 'NodeDeleted' or kind in {CHANGES} and (died is null or died > seq))")
    deleted = log.filter("kind = 'EdgeDeleted'").join(made.select("edge_id"), "edge_id", "left_semi")
    return nodes.select("seq").unionByName(made.select("seq")).unionByName(deleted.select("seq"))


def removed_by(subtrees: DataFrame, log: DataFrame) -> DataFrame:
    """root and the log's columns of every event that goes with each root (``subtrees``: root, node)."""
    return subtrees.select("root", F.col("node").alias("seq")).join(log, "seq")


def _prefix(gone: DataFrame, place: str, *extra: str) -> DataFrame:
    """root, node_id, run: how many of a node's events of a kind, from the first place on, go with a root without a gap."""
    w = Window.partitionBy("root", "node_id", *extra).orderBy(place)
    return gone.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") == F.col(place)).groupBy("root", "node_id", *extra).agg(F.max("nth").alias("run"))


def node_states(gone: DataFrame, log: DataFrame) -> DataFrame:
    """root, node_id, born, died, s, d without each root, and the real a_born, a_died, a_s, a_d, of the nodes that lose
    an event with it. s and d: the last status and score.

    A node's deletions and changes are numbered; the first deletion left, and the last change before it that is left, are
    found from the unbroken runs of those that go, so the work is in proportion to what goes."""
    events = log.filter(F.col("kind").isin(*CHANGES, "NodeDeleted")).select("node_id", "seq", "kind", F.col("event_type").alias("s"), F.col("value").alias("d"))
    by_seq = Window.partitionBy("node_id").orderBy("seq")
    changes = events.filter("kind != 'NodeDeleted'").withColumn("i", F.row_number().over(by_seq))
    deletions = events.filter("kind = 'NodeDeleted'").withColumn("i", F.row_number().over(by_seq))
    real = lives(log).filter("born is not null").select("node_id", F.col("born").alias("a_born"), F.col("died").alias("a_died"))
    hit = gone.filter(F.col("kind").isin(*CHANGES, "NodeDeleted")).select("root", "node_id", "seq", "kind")
    each = hit.groupBy("root", "node_id").agg(F.bool_or(F.col("kind") == "NodeCreated").alias("unborn")).join(real, "node_id")
    cut = _prefix(hit.filter("kind = 'NodeDeleted'").join(deletions.select("node_id", "seq", "i"), ["node_id", "seq"]), "i")
    each = each.join(cut, ["root", "node_id"], "left").withColumn("i", F.coalesce("run", F.lit(0)) + 1).drop("run")
    each = each.join(deletions.select("node_id", "i", F.col("seq").alias("died")), ["node_id", "i"], "left").drop("i")

    def before(rows: DataFrame, end: str, as_: str) -> DataFrame:
        """Adds the number of the node's last change before its end."""
        ends = rows.select("node_id", end).distinct()
        last = ends.join(changes.select("node_id", "seq", "i"), "node_id").filter(F.col(end).isNull() | (F.col("seq") < F.col(end))).groupBy("node_id", end).agg(F.max("i").alias(as_))
        return rows.join(last, (rows["node_id"] == last["node_id"]) & rows[end].eqNullSafe(last[end]), "left").drop(last["node_id"]).drop(last[end])

    each = before(before(each, "died", "last"), "a_died", "a_last")
    back = hit.filter("kind != 'NodeDeleted'").join(changes.select("node_id", "seq", "i"), ["node_id", "seq"]).join(each.select("root", "node_id", "last"), ["root", "node_id"]).filter("i <= last").withColumn("from_last", F.col("last") - F.col("i") + 1)
    each = each.join(_prefix(back, "from_last"), ["root", "node_id"], "left").withColumn("i", F.col("last") - F.coalesce("run", F.lit(0)))
    each = each.join(changes.select("node_id", "i", "s", "d"), ["node_id", "i"], "left")
    each = each.join(changes.select("node_id", F.col("i").alias("a_last"), F.col("s").alias("a_s"), F.col("d").alias("a_d")), ["node_id", "a_last"], "left")
    born = F.when(~F.col("unborn"), F.col("a_born"))
    return each.select("root", "node_id", born.alias("born"), F.when(born.isNotNull(), F.col("died")).alias("died"), "s", "d", "a_born", "a_died", "a_s", "a_d")


def differences(subtrees: DataFrame, log: DataFrame) -> DataFrame:
    """root, side, kind (node, edge, property), id of how the graph without each root differs from the real one. side:
    actual (only there), counterfactual (only there) or changed."""
    # Written once each: all that follows reads them several times.
    log = keep(log.filter("kind != 'Signal'").select("seq", "kind", "node_id", "edge_id", "src", "dst", "event_type", "value"), "log")
    gone = keep(removed_by(subtrees, log).select("root", "seq", "kind", "node_id", "edge_id"), "gone")
    states = keep(node_states(gone, log), "states")
    real, other = F.col("a_died").isNull(), F.col("born").isNotNull() & F.col("died").isNull()
    side = F.when(real & ~other, "actual").when(~real & other, "counterfactual")
    nodes = states.select("root", side.alias("side"), F.lit("node").alias("kind"), F.col("node_id").alias("id")).filter("side is not null")
    both = states.filter("born is not null")
    keys = F.array_compact(F.array(F.when(~F.col("s").eqNullSafe(F.col("a_s")), F.lit("status")), F.when(~F.col("d").eqNullSafe(F.col("a_d")), F.lit("score"))))
    properties = both.select("root", "node_id", F.explode(keys).alias("key")).select("root", F.lit("changed").alias("side"), F.lit("property").alias("kind"), F.concat_ws("/", "node_id", "key").alias("id"))
    made = log.filter("kind = 'EdgeCreated'").select("edge_id", "src", "dst", F.col("seq").alias("made"))
    moved = states.filter("born is null or not died <=> a_died")
    touched = [moved.select("root", F.col("node_id").alias(end)).join(made.select("edge_id", end), end).select("root", "edge_id") for end in ("src", "dst")]
    named = gone.filter("kind in ('EdgeCreated', 'EdgeDeleted')").select("root", "edge_id")
    edges = named.unionByName(touched[0]).unionByName(touched[1]).distinct().join(made, "edge_id")
    unmade = gone.filter("kind = 'EdgeCreated'").select("root", "edge_id", F.lit(True).alias("unmade"))
    ends = log.filter("kind = 'EdgeDeleted'").select("edge_id", F.col("seq").alias("end"))
    ends = ends.join(made.select("edge_id", "made"), "edge_id").filter("end > made").select("edge_id", "end")
    n_ends = ends.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n_ends"))
    n_gone = gone.filter("kind = 'EdgeDeleted'").select("root", F.col("seq").alias("end")).join(ends, "end").groupBy("root", "edge_id").agg(F.count(F.lit(1)).alias("n_gone"))
    edges = edges.join(unmade, ["root", "edge_id"], "left").join(n_ends, "edge_id", "left").join(n_gone, ["root", "edge_id"], "left").fillna(0, ["n_ends", "n_gone"])
    life = lives(log)
    for end in ("src", "dst"):
        edges = edges.join(life.select(F.col("node_id").alias(end), F.col("born").alias(f"{end}_a_born"), F.col("died").alias(f"{end}_a_died")), end, "left")
        own = states.select("root", F.col("node_id").alias(end), F.struct("born", "died").alias(f"{end}_cf"))
        edges = edges.join(own, ["root", end], "left")
    there = lambda born, died: F.coalesce((born < F.col("made")) & died.isNull(), F.lit(False))
    real = (F.col("n_ends") == 0) & there(F.col("src_a_born"), F.col("src_a_died")) & there(F.col("dst_a_born"), F.col("dst_a_died"))
    other = F.col("unmade").isNull() & (F.col("n_ends") == F.col("n_gone"))
    for end in ("src", "dst"):
        known = F.col(f"{end}_cf").isNotNull()
        other &= there(*(F.when(known, F.col(f"{end}_cf.{x}")).otherwise(F.col(f"{end}_a_{x}")) for x in ("born", "died")))
    side = F.when(real & ~other, "actual").when(~real & other, "counterfactual")
    edges = edges.select("root", side.alias("side"), F.lit("edge").alias("kind"), F.col("edge_id").alias("id")).filter("side is not null")
    return nodes.unionByName(edges).unionByName(properties)


def impact(subtrees: DataFrame, changes: DataFrame) -> DataFrame:
    """root, n_events, nodes, edges, properties, magnitude of each root."""
    size = subtrees.groupBy("root").agg(F.count(F.lit(1)).alias("n_events"))
    counts = [F.count_if(F.col("kind") == k).alias(a) for k, a in (("node", "nodes"), ("edge", "edges"), ("property", "properties"))]
    out = size.join(changes.groupBy("root").agg(*counts), "root", "left").fillna(0, ["nodes", "edges", "properties"])
    return out.withColumn("magnitude", F.col("nodes") * NODE_WEIGHT + F.col("edges") * EDGE_WEIGHT + F.col("properties") * PROPERTY_WEIGHT)


def removal_fraction(removed: DataFrame, replayed: DataFrame) -> DataFrame:
    """One row: removed, skipped, replayed and the removed share. ``replayed``: the kept events with ``rejected``."""
    a = removed.agg(F.count(F.lit(1)).alias("removed"))
    b = replayed.agg(F.count_if("rejected").alias("skipped"), F.count_if(~F.col("rejected")).alias("replayed"))
    return a.join(b).withColumn("fraction", F.try_divide(F.col("removed").cast("double"), F.col("removed") + F.col("skipped") + F.col("replayed")))
