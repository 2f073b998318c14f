"""Versions, as-of states, differences and trends."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import temporal as T
from ..operators.rules import anomaly_change_rate, anomaly_drift, anomaly_time_window
from .registry import query

T1, T2 = datetime(2024, 1, 8), datetime(2024, 1, 20)
A1, A2 = "TIMESTAMP '2024-01-08 00:00:00'", "TIMESTAMP '2024-01-20 00:00:00'"

FORCE = "v.ts <= {at} AND (v.until_ts IS NULL OR {at} < v.until_ts)"
ALIVE = "{t}.born_ts <= {at} AND ({t}.died_ts IS NULL OR {at} < {t}.died_ts)"


def moment(when: datetime) -> Column:
    return F.lit(when).cast("timestamp_ntz")


@query("SELECT node_id, key, s, d, seq, until_seq FROM versions")
def record_history(m):
    changes = m.applied.filter("kind in ('NodeCreated', 'NodeUpdated')")
    long = changes.select("node_id", "seq", "ts", F.inline(F.array(F.struct(F.lit("status").alias("key"), F.col("event_type").alias("s"), F.lit(None).cast("double").alias("d")), F.struct(F.lit("score").alias("key"), F.lit(None).cast("string").alias("s"), F.col("value").alias("d")))))
    return T.record_history(long, ["node_id", "key"]).select("node_id", "key", "s", "d", "seq", "until_seq")


@query(f"SELECT v.node_id, v.key, v.s, v.d FROM versions v JOIN node_life n ON v.node_id = n.node_id WHERE {FORCE.format(at=A1)} AND {ALIVE.format(t='n', at=A1)}")
def node_state_at(m):
    return T.state_at(m.versions, m.node_life, moment(T1)).select("node_id", "key", "s", "d")


@query(f"SELECT v.node_id, v.key, max_by(v.d, v.seq) AS d FROM versions v WHERE v.ts <= {A2} AND v.key = 'score' GROUP BY v.node_id, v.key")
def as_of_property(m):
    """The last version of a property at a time, whether or not the node lives."""
    return m.versions.filter((F.col("ts") <= moment(T2)) & (F.col("key") == "score")).groupBy("node_id", "key").agg(F.max_by("d", "seq").alias("d"))


@query(f"SELECT node_id AS id, coalesce({ALIVE.format(t='n', at=A1)}, false) AS alive FROM node_life n")
def node_alive_at(m):
    return m.node_life.select(F.col("node_id").alias("id"), F.coalesce(T.alive_at(moment(T1)), F.lit(False)).alias("alive"))


@query(f"SELECT edge_id AS id, coalesce({ALIVE.format(t='n', at=A2)}, false) AS alive FROM edge_life n")
def edge_alive_at(m):
    return m.edge_life.select(F.col("edge_id").alias("id"), F.coalesce(T.alive_at(moment(T2)), F.lit(False)).alias("alive"))


@query("SELECT seq, ts, d FROM versions WHERE node_id = 'user:7' AND key = 'score'")
def node_trend(m):
    return m.versions.filter("node_id = 'user:7' and key = 'score'").select("seq", "ts", "d").orderBy("seq")


@query("SELECT key, s, d, ts, until_ts FROM versions WHERE node_id = 'user:9'")
def node_history(m):
    return m.versions.filter("node_id = 'user:9'").select("key", "s", "d", "ts", "until_ts")


@query("SELECT edge_id, born_ts, died_ts FROM edge_life WHERE src = 'user:9'")
def edge_history(m):
    return m.edge_life.filter("src = 'user:9'").select("edge_id", "born_ts", "died_ts")


@query("SELECT n.node_id, coalesce(v.c, 0) + 1 AS n FROM node_life n LEFT JOIN (SELECT node_id, count(*) AS c FROM versions GROUP BY node_id) v ON n.node_id = v.node_id")
def version_count(m):
    """Property versions of each node and its one lifecycle version."""
    n = m.versions.groupBy("node_id").agg(F.count(F.lit(1)).alias("c"))
    return m.node_life.join(n, "node_id", "left").select("node_id", (F.coalesce("c", F.lit(0)) + 1).alias("n"))


@query(f"SELECT 'node' AS kind, node_id AS id FROM node_life n WHERE {ALIVE.format(t='n', at=A2)} UNION ALL SELECT 'edge', e.edge_id FROM edge_life e JOIN node_life n ON e.src = n.node_id JOIN node_life o ON e.dst = o.node_id WHERE {ALIVE.format(t='e', at=A2)} AND {ALIVE.format(t='n', at=A2)} AND {ALIVE.format(t='o', at=A2)}")
def graph_at(m):
    nodes, edges = T.graph_at(m.node_life, m.edge_life, moment(T2))
    return nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))


def _was(t, at):
    return f"coalesce({ALIVE.format(t=t, at=at)}, false)"


DIFF = f"""st AS (SELECT w.nth, v.node_id, v.key, v.s, v.d FROM versions v JOIN node_life n ON v.node_id = n.node_id JOIN (SELECT 1 AS nth, {A1} AS at UNION ALL SELECT 2, {A2}) w ON v.ts <= w.at AND (v.until_ts IS NULL OR w.at < v.until_ts) AND n.born_ts <= w.at AND (n.died_ts IS NULL OR w.at < n.died_ts)),
    dif AS (SELECT CASE WHEN NOT {_was('n', A1)} AND {_was('n', A2)} THEN 'node_created' WHEN {_was('n', A1)} AND NOT {_was('n', A2)} THEN 'node_deleted' END AS kind, node_id AS id FROM node_life n
    UNION ALL SELECT CASE WHEN NOT {_was('n', A1)} AND {_was('n', A2)} THEN 'edge_created' WHEN {_was('n', A1)} AND NOT {_was('n', A2)} THEN 'edge_deleted' END, edge_id FROM edge_life n
    UNION ALL SELECT DISTINCT 'node_changed', a.node_id FROM st a JOIN st b ON a.node_id = b.node_id AND a.key = b.key AND a.nth = 1 AND b.nth = 2 WHERE a.s IS DISTINCT FROM b.s OR a.d IS DISTINCT FROM b.d)"""


@query(f"{DIFF} --- SELECT kind, id FROM dif WHERE kind IS NOT NULL")
def temporal_diff(m):
    return T.diff(m.versions, m.node_life, m.edge_life, moment(T1), moment(T2))


@query(f"{DIFF} --- SELECT count(*) AS changes, count(*) = 0 AS is_empty FROM dif WHERE kind IS NOT NULL")
def diff_total_changes(m):
    n = F.count(F.lit(1))
    return temporal_diff(m).agg(n.alias("changes"), (n == 0).alias("is_empty"))


STEP = int((T2 - T1).total_seconds() * 1000) // 6


@query(f"""grid AS (SELECT CAST(k AS BIGINT) AS nth, {A1} + to_microseconds(CAST(k * {STEP} * 1000 AS BIGINT)) AS at FROM range(7) r(k)) --- SELECT g.nth, count(*) AS n, round(avg(v.d), 6) AS mean FROM grid g JOIN versions v ON v.ts <= g.at AND (v.until_ts IS NULL OR g.at < v.until_ts) AND v.key = 'score'
    JOIN node_life n ON n.node_id = v.node_id AND n.born_ts <= g.at AND (n.died_ts IS NULL OR g.at < n.died_ts) GROUP BY g.nth""")
def confidence_trend(m):
    """The mean score at seven evenly spaced times, in one range join."""
    rows = T.trend(m.versions.filter("key = 'score'"), m.node_life, T.samples(m.spark, T1, T2, 7))
    return rows.groupBy("nth").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean"))


@query(f"""grid AS (SELECT CAST(k AS BIGINT) AS nth, {A1} + to_microseconds(CAST(k * {STEP} * 1000 AS BIGINT)) AS at FROM range(7) r(k)) --- SELECT g.nth, v.s AS status, count(*) AS n FROM grid g JOIN versions v ON v.ts <= g.at AND (v.until_ts IS NULL OR g.at < v.until_ts) AND v.key = 'status'
    JOIN node_life n ON n.node_id = v.node_id AND n.born_ts <= g.at AND (n.died_ts IS NULL OR g.at < n.died_ts) GROUP BY g.nth, v.s""")
def protection_trend(m):
    rows = T.trend(m.versions.filter("key = 'status'"), m.node_life, T.samples(m.spark, T1, T2, 7))
    return rows.groupBy("nth", F.col("s").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{DIFF} --- SELECT coalesce(a.s, b.s) AS status, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT s, count(*) AS n FROM st WHERE nth = 1 AND key = 'status' GROUP BY s) a FULL JOIN (SELECT s, count(*) AS n FROM st WHERE nth = 2 AND key = 'status' GROUP BY s) b ON a.s = b.s""")
def protection_diff(m):
    """How many nodes more or fewer have each status at the second time."""
    sides = [T.state_at(m.versions.filter("key = 'status'"), m.node_life, at).groupBy(F.col("s").alias("status")).agg(F.count(F.lit(1)).alias(n)) for at, n in ((moment(T1), "a"), (moment(T2), "b"))]
    return sides[0].join(sides[1], "status", "full").select("status", (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("delta"))


@query(f"""{DIFF} --- SELECT round(b.m - a.m, 6) AS delta, CASE WHEN b.m >= 90 THEN 'A' WHEN b.m >= 75 THEN 'B' WHEN b.m >= 60 THEN 'C' WHEN b.m >= 40 THEN 'D' ELSE 'F' END AS grade FROM (SELECT avg(d) AS m FROM st WHERE nth = 1 AND key = 'score') a, (SELECT avg(d) AS m FROM st WHERE nth = 2 AND key = 'score') b""")
def confidence_diff(m):
    from ..functions import grade

    sides = [T.state_at(m.versions.filter("key = 'score'"), m.node_life, at).agg(F.avg("d").alias(n)) for at, n in ((moment(T1), "a"), (moment(T2), "b"))]
    return sides[0].join(sides[1]).select(F.round(F.col("b") - F.col("a"), 6).alias("delta"), grade(F.col("b")).alias("grade"))


@query(f"""e1 AS (SELECT e.src, e.dst FROM edge_life e WHERE {_was('e', A1)}), e2 AS (SELECT e.src, e.dst FROM edge_life e WHERE {_was('e', A2)}),
    w1 AS (SELECT 'user:1' AS node, CAST(0 AS BIGINT) AS d UNION SELECT e.src, w.d + 1 FROM w1 w JOIN e1 e ON e.dst = w.node WHERE w.d < 5), w2 AS (SELECT 'user:1' AS node, CAST(0 AS BIGINT) AS d UNION SELECT e.src, w.d + 1 FROM w2 w JOIN e2 e ON e.dst = w.node WHERE w.d < 5)
    --- SELECT coalesce(a.node, b.node) AS node, CASE WHEN a.node IS NULL THEN 'added' WHEN b.node IS NULL THEN 'removed' ELSE 'kept' END AS change FROM (SELECT DISTINCT node FROM w1) a FULL JOIN (SELECT DISTINCT node FROM w2) b ON a.node = b.node""")
def blast_radius_diff(m):
    """What a node's failure reaches at two times, within five steps."""
    from ..operators.closure import reach

    start = m.spark.createDataFrame([("user:1", "user:1")], "root string, node string")
    sides = []
    for at, name in ((moment(T1), "a"), (moment(T2), "b")):
        edges = m.edge_life.filter(T.alive_at(at)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        sides.append(reach(edges, start, 5).select("node", F.lit(True).alias(name)))
    both = sides[0].join(sides[1], "node", "full")
    return both.select("node", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("kept").alias("change"))


@query("""mv AS (SELECT node_id, d, d - lag(d) OVER (PARTITION BY node_id ORDER BY seq) AS move, row_number() OVER (PARTITION BY node_id ORDER BY seq DESC) AS nth FROM versions WHERE key = 'score') --- SELECT node_id, CASE WHEN up = p THEN 'rising' WHEN down = p THEN 'falling' END AS direction
    FROM (SELECT node_id, least(count(*) - 1, 2) AS p, count(*) AS n, count(*) FILTER (WHERE nth <= 2 AND move > 0) AS up, count(*) FILTER (WHERE nth <= 2 AND move < 0) AS down FROM mv WHERE nth <= 3 GROUP BY node_id) x WHERE n >= 2 AND p > 0 AND (up = p OR down = p)""")
def anomaly_drift_scores(m):
    return anomaly_drift(m.versions, "score", 2)


@query("SELECT node_id, count(*) AS n FROM versions WHERE ts >= (SELECT max(ts) FROM log) - INTERVAL 2 DAY AND ts <= (SELECT max(ts) FROM log) GROUP BY node_id HAVING count(*) > 4")
def anomaly_change_rates(m):
    now = m.log.agg(F.max("ts")).first()[0]
    return anomaly_change_rate(m.versions, F.lit(now).cast("timestamp_ntz"), "2 days", 4)


@query("SELECT node_id, count(*) AS n FROM versions WHERE hour(ts) > 3 AND hour(ts) < 22 GROUP BY node_id HAVING count(*) > 50")
def anomaly_time_windows(m):
    """Changes outside the night from 22 to 3."""
    return anomaly_time_window(m.versions, 22, 3, 50)
