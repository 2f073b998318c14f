"""Rules as small tables joined to facts: anomalies, claim verification, policies and reactive handlers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hour_outside

# Lower wins among matching policies.
PRECEDENCE = {"Block": 0, "Reject": 1, "RequireApproval": 2, "Review": 3, "Escalate": 4, "AutoApprove": 5, "Allow": 6}
VERIFY_CONFIDENCE, VERIFY_RELIABILITY = 0.80, 0.75


def anomaly_cascade(log: DataFrame, depth: DataFrame, max_events: int = 50, max_depth: int = 10) -> DataFrame:
    """cascade_id, n_events, max_depth of oversize cascades. ``depth``: node, depth."""
    rows = log.select("cascade_id", F.col("seq").alias("node")).join(depth, "node", "left")
    sizes = rows.groupBy("cascade_id").agg(F.count(F.lit(1)).alias("n_events"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    return sizes.filter((F.col("n_events") > max_events) | (F.col("max_depth") > max_depth))


def anomaly_topology(nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, id, degree, kind of live nodes whose degree in one edge type is outside [low, high]."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"), F.col("type").alias("edge"))
    degree = ends.groupBy("id", "edge").agg(F.count(F.lit(1)).alias("degree"))
    rows = nodes.filter("alive").join(F.broadcast(rules), "type").join(degree, ["id", "edge"], "left").fillna(0, ["degree"])
    kind = F.when((F.col("degree") == 0) & (F.col("low") > 0), "orphan").otherwise("degree")
    return rows.filter("degree < low or degree > high").select("rule", "id", "degree", kind.alias("kind"))


def anomaly_drift(versions: DataFrame, key: str, steps: int) -> DataFrame:
    """node_id, direction of nodes whose last ``steps`` + 1 values rise, or fall, without a pause.

    With exactly ``steps`` values those are judged; any value that isn't a number rules the node out."""
    w = Window.partitionBy("node_id").orderBy("seq")
    back = Window.partitionBy("node_id").orderBy(F.desc("seq"))
    rows = versions.filter(F.col("key") == key).select("node_id", "seq", "d", (F.col("d") - F.lag("d").over(w)).alias("move"), F.row_number().over(back).alias("nth"))
    last = rows.filter(F.col("nth") <= steps + 1).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.count("d").alias("numbers"), F.count_if((F.col("nth") <= steps) & (F.col("move") > 0)).alias("up"), F.count_if((F.col("nth") <= steps) & (F.col("move") < 0)).alias("down"))
    pairs = F.least(F.col("n") - 1, F.lit(steps))
    last = last.filter((F.col("n") >= steps) & (F.col("n") == F.col("numbers")) & (pairs > 0))
    return last.select("node_id", F.when(F.col("up") == pairs, "rising").when(F.col("down") == pairs, "falling").alias("direction")).filter("direction is not null")


def anomaly_change_rate(versions: DataFrame, now: Column, window: str, most: int) -> DataFrame:
    """node_id, n of nodes with more than ``most`` versions in the time before ``now``."""
    rows = versions.filter((F.col("ts") >= now - F.expr(f"interval {window}")) & (F.col("ts") <= now))
    return rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)


def anomaly_time_window(versions: DataFrame, start: int, end: int, tolerance: int) -> DataFrame:
    """node_id, n of nodes changed outside the hours [start, end] more than ``tolerance`` times."""
    rows = versions.filter(hour_outside(F.hour("ts"), start, end))
    return rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tolerance)


def pattern_match(nodes: DataFrame, edges: DataFrame, anchor: Column, edge_type: str, target: Column, fan_out: int) -> DataFrame:
    """id, n of anchors with at least ``fan_out`` edges of a type to matching targets."""
    live = nodes.filter("alive")
    goal = live.filter(target).select(F.col("id").alias("dst"))
    rows = edges.filter(F.col("type") == edge_type).join(goal, "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return rows.filter(F.col("n") >= fan_out).join(live.filter(anchor).select("id"), "id", "left_semi")


def fold_status(events: DataFrame, key: str, guard: dict[str, str] | None = None) -> DataFrame:
    """key, status: the last status event of each record. ``guard``: a status that only follows another (from, at the
    first such event, when nothing else came between)."""
    w = Window.partitionBy(key).orderBy("seq")
    for to, after in (guard or {}).items():
        real = F.last(F.when(F.col("to_status") != to, F.col("to_status")), ignorenulls=True).over(w)
        events = events.filter(F.col("to_status").isNotNull()).withColumn("_real", real)
        events = events.withColumn("to_status", F.when((F.col("to_status") == to) & (F.col("_real") != after), F.col("_real")).otherwise(F.col("to_status"))).drop("_real")
    return events.groupBy(key).agg(F.max_by("to_status", "seq").alias("status"))


def verify_claims(claims: DataFrame, evidence: DataFrame, kinds: list[str]) -> DataFrame:
    """id, decision of each claim (id, kind, confidence, status) from its evidence (claim_id, reliability, side);
    evidence of null reliability is missing."""
    sums = evidence.groupBy(F.col("claim_id").alias("id")).agg(
        F.count_if((F.col("side") == "for") & (F.col("reliability") >= VERIFY_RELIABILITY)).alias("reliable"),
        F.count_if(F.col("side") == "against").alias("against"), F.count_if(F.col("reliability").isNull()).alias("missing"))
    rows = claims.join(sums, "id", "left").fillna(0, ["reliable", "against", "missing"])
    decision = (
        F.when(F.col("status").isin("Verified", "Operational"), "already_verified")
        .when(F.col("status").isin("Retracted", "Archived") | ~F.col("kind").isin(kinds), "human_review")
        .when(F.col("missing") > 0, "missing_evidence")
        .when(F.col("against") > 0, "dispute")
        .when((F.col("confidence") >= VERIFY_CONFIDENCE) & (F.col("reliable") >= 1), "verify")
        .when(F.col("reliable") >= 1, "support")
        .otherwise("keep")
    )
    return rows.select("id", decision.alias("decision"))


def verification_events(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, event, evidence_id: what each decision (id, decision) leads to; support names the first reliable
    evidence, a dispute the first contradicting one (by seq). Kept and verified claims lead to nothing."""
    reliable = (F.col("side") == "for") & (F.col("reliability") >= VERIFY_RELIABILITY)
    first = evidence.groupBy(F.col("claim_id").alias("id")).agg(F.min(F.when(reliable, F.struct("seq", "evidence_id"))).alias("f"), F.min(F.when(F.col("side") == "against", F.struct("seq", "evidence_id"))).alias("a"))
    d = F.col("decision")
    event = F.when(d == "verify", "ClaimVerified").when(d == "support", "ClaimSupported").when(d == "dispute", "ClaimDisputed").when(d == "human_review", "claim_needs_human_review").when(d == "missing_evidence", "claim_missing_evidence")
    named = F.when(d == "support", F.col("f.evidence_id")).when(d == "dispute", F.col("a.evidence_id"))
    return decisions.join(first, "id", "left").select(F.col("id").alias("claim_id"), event.alias("event"), named.alias("evidence_id")).filter("event is not null")


def match_policies(actions: DataFrame, policies: DataFrame) -> DataFrame:
    """id, policy_id, decision of each active policy that covers an action (id, kind, actor, tenant_id, claim_id)."""
    value = F.col("scope_value")
    covers = (
        F.when(F.col("scope") == "Any", True).when(F.col("scope") == "Kind", F.col("action_kind") == value).when(F.col("scope") == "Actor", F.col("actor") == value)
        .when(F.col("scope") == "Tenant", F.col("tenant_id") == value).when(F.col("scope") == "Claim", F.col("claim_id") == value).otherwise(False)
    )
    small = F.broadcast(policies.filter("active").select("policy_id", "scope", "scope_value", F.col("kind").alias("decision")))
    return actions.select("id", F.col("kind").alias("action_kind"), "actor", "tenant_id", "claim_id").join(small, covers).select("id", "policy_id", "decision")


def evaluate_policies(actions: DataFrame, policies: DataFrame) -> DataFrame:
    """id, decision, policy_id: the matching policy of least precedence (ties by id); Allow if none matches or the
    action is no longer proposed."""
    rank = F.create_map(*(F.lit(x) for pair in PRECEDENCE.items() for x in pair))
    best = match_policies(actions.filter("status = 'Proposed'"), policies).groupBy("id").agg(F.min(F.struct(rank[F.col("decision")].alias("rank"), "policy_id", "decision")).alias("b"))
    return actions.select("id").join(best, "id", "left").select("id", F.coalesce("b.decision", F.lit("Allow")).alias("decision"), F.col("b.policy_id").alias("policy_id"))


def protection_policy(resources: DataFrame) -> DataFrame:
    """id and the schedule that a resource's criticality and sensitivity ask for."""
    c = F.col("criticality")
    by = lambda a, b, d, e, z: F.when(c.between(9, 10), a).when(c.between(7, 8), b).when(c.between(5, 6), d).when(c.between(3, 4), e).otherwise(z)
    days = by(365, 90, 30, 14, 7)
    days = F.when(F.col("level") == "high", F.greatest(days, F.lit(365))).when(F.col("level") == "medium", F.greatest(days, F.lit(90))).otherwise(days)
    return resources.select("id", by(1, 4, 12, 24, 168).cast("long").alias("frequency_hours"), days.cast("long").alias("retention_days"), by("hot", "warm", "warm", "cold", "archive").alias("tier"), by(True, True, False, False, False).alias("replication"), F.col("level").isin("high", "medium").alias("encryption"))
