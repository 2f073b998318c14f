"""Reports, rules and detectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import freshness, row_count
from ..operators import detectors as D
from ..operators import reports as R
from ..operators import rules
from ..operators.closure import depths
from .graph import DIFFERENT, impact_score
from .lookups import ACTION_STATUS, CLAIM_STATUS, SUBSCRIPTIONS, actions, claims, subscription_matches
from .registry import query



@query("SELECT 'nodes' AS what, count(*) FILTER (WHERE alive) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'events', count(*) FROM log")
def stats(m):
    parts = [(m.nodes.filter("alive"), "nodes"), (m.edges, "edges"), (m.log, "events")]
    out = [df.agg(row_count().alias("n")).select(F.lit(name).alias("what"), "n") for df, name in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT type, count(*) AS n FROM nodes WHERE alive GROUP BY type")
def count_by_type(m):
    return m.nodes.filter("alive").groupBy("type").agg(row_count().alias("n"))


TIER = "CASE WHEN protection_status = 'unprotected' AND criticality >= 7 THEN 'critical' WHEN (protection_status = 'unprotected' AND criticality >= 4) OR (protection_status = 'partial' AND criticality >= 7) THEN 'high' WHEN protection_status = 'protected' THEN 'low' ELSE 'medium' END"


@query(f"SELECT r.id, type, provider, protection_status AS status, criticality, coalesce(n, 0) AS n_snapshots, {TIER} AS tier, cost_cents FROM resources r LEFT JOIN (SELECT resource, count(*) AS n FROM backups GROUP BY resource) b ON r.id = b.resource")
def protection_status(m):
    return R.protection(m.resources, m.backups)


@query("""SELECT type, provider, count(*) AS n, count(*) FILTER (WHERE protection_status = 'protected') AS protected, count(*) FILTER (WHERE protection_status = 'partial') AS partial, count(*) FILTER (WHERE protection_status = 'unprotected') AS unprotected,
    round(count(*) FILTER (WHERE protection_status = 'protected') / CAST(count(*) AS DOUBLE), 6) AS coverage, CAST(sum(CASE WHEN protection_status = 'unprotected' THEN cost_cents ELSE 0 END) AS BIGINT) AS unprotected_cost FROM resources GROUP BY GROUPING SETS ((type), (provider), ())""")
def protection_summary(m):
    return R.protection_summary(R.protection(m.resources, m.backups))


@query(f"SELECT {TIER} AS tier, count(*) AS n FROM resources GROUP BY 1")
def risk_tiers(m):
    return R.protection(m.resources, m.backups).groupBy("tier").agg(row_count().alias("n"))


RULES = [("protect", [], "ProtectionRequired", 0.0, "high"), ("backup", ["database"], "BackupRequired", 0.0, "critical"), ("verify", ["database", "server"], "VerificationRequired", 0.0, "medium"), ("often", [], "MinBackupFrequency", 24.0, "medium"), ("keep", ["bucket"], "MinRetention", 30.0, "low"), ("encrypt", [], "EncryptionRequired", 0.0, "critical"), ("trust", [], "MinTrustScore", 0.4, "high")]
MEAN = "(trust_1 + trust_2 + trust_3 + trust_4 + trust_5 + trust_6 + trust_7) / 7.0E0"
GAPS = f"""gaps AS (SELECT 'protect' AS rule, id, 'ProtectionRequired' AS requirement, 'high' AS severity FROM resources WHERE protection_status <> 'protected' UNION ALL SELECT 'backup', id, 'BackupRequired', 'critical' FROM resources WHERE type = 'database' AND id NOT IN (SELECT resource FROM backups)
    UNION ALL SELECT 'verify', id, 'VerificationRequired', 'medium' FROM resources WHERE type IN ('database', 'server') AND id NOT IN (SELECT resource FROM backups b JOIN verifications v ON b.snapshot = v.snapshot)
    UNION ALL SELECT 'often', id, 'MinBackupFrequency', 'medium' FROM resources WHERE coalesce(backup_hours, 0) = 0 OR backup_hours > 24 UNION ALL SELECT 'keep', id, 'MinRetention', 'low' FROM resources WHERE type = 'bucket' AND retention_days < 30
    UNION ALL SELECT 'encrypt', id, 'EncryptionRequired', 'critical' FROM resources WHERE NOT encrypted UNION ALL SELECT 'trust', id, 'MinTrustScore', 'high' FROM resources WHERE {MEAN} < 0.4)"""


def gaps(m):
    table = m.spark.createDataFrame(RULES, "rule string, types array<string>, requirement string, threshold double, severity string")
    return R.compliance_gaps(m.resources, table, m.backups, m.verifications)


@query(f"{GAPS} --- SELECT * FROM gaps")
def compliance_gaps(m):
    return gaps(m)


@query(f"{GAPS} --- SELECT requirement, severity, count(*) AS n, count(DISTINCT id) AS resources FROM gaps GROUP BY requirement, severity")
def compliance_summary(m):
    return gaps(m).groupBy("requirement", "severity").agg(row_count().alias("n"), F.countDistinct("id").alias("resources"))


@query(f"{GAPS} --- SELECT round(1 - (SELECT count(DISTINCT id) FROM gaps) / CAST((SELECT count(*) FROM resources) AS DOUBLE), 6) AS ratio")
def compliance_ratio(m):
    bad = gaps(m).agg(F.countDistinct("id").alias("bad"))
    return m.resources.agg(row_count().alias("n")).join(bad).select(F.round(1 - F.col("bad") / F.col("n"), 6).alias("ratio"))


W = "CAST(greatest(coalesce(criticality, 1), 1) AS DOUBLE)"
DIMS = ", ".join(f"sum({t} * {W}) / sum({W}) AS {d}" for t, d in zip(R.TRUST, R.DIMENSIONS, strict=True))


@query(f"SELECT {', '.join(f'round({d}, 6) AS {d}' for d in R.DIMENSIONS)}, round(({' + '.join(R.DIMENSIONS)}) * 100 / 7, 6) AS overall, CASE WHEN ({' + '.join(R.DIMENSIONS)}) * 100 / 7 >= 90 THEN 'A' WHEN ({' + '.join(R.DIMENSIONS)}) * 100 / 7 >= 75 THEN 'B' WHEN ({' + '.join(R.DIMENSIONS)}) * 100 / 7 >= 60 THEN 'C' WHEN ({' + '.join(R.DIMENSIONS)}) * 100 / 7 >= 40 THEN 'D' ELSE 'F' END AS grade FROM (SELECT {DIMS} FROM resources) x")
def confidence_report(m):
    rows = R.confidence(m.resources)
    return rows.select(*(F.round(c, 6).alias(c) for c in [*R.DIMENSIONS, "overall"]), "grade")


LINKS = "least(" + ", ".join(R.TRUST) + ")"
WEAKEST = "CASE " + " ".join(f"WHEN {t} = {LINKS} THEN '{d}'" for t, d in zip(R.TRUST, R.DIMENSIONS, strict=True)) + " END"


@query(f"SELECT id, type, criticality, round({MEAN}, 6) AS composite, {WEAKEST} AS weakest, {LINKS} AS weakest_score FROM resources ORDER BY composite, criticality DESC, id LIMIT 20")
def weak_links(m):
    return R.weak_links(m.resources, 20)


def _weighted(preset):
    w = R.WEIGHTS[preset]
    return f"({' + '.join(f'{t} * {x}E0' for t, x in zip(R.TRUST, w, strict=True))}) / {sum(w)}E0"


@query(f"SELECT id, round({_weighted('default')}, 6) AS plain, round({_weighted('high_sensitivity')}, 6) AS sensitive, round({_weighted('critical_infra')}, 6) AS infra FROM resources")
def trust_composite(m):
    return m.resources.select("id", *(F.round(R.trust_composite(p), 6).alias(a) for p, a in (("default", "plain"), ("high_sensitivity", "sensitive"), ("critical_infra", "infra"))))


EXPECT = [("backup", 0, "EdgeCoverage", "database", "protected_by", "", 1), ("backup", 1, "EdgeCoverage", "server", "protected_by", "", 1), ("network", 0, "EdgeCoverage", "server", "in_network", "", 1), ("network", 1, "MinNodeCount", "server", "", "", 50), ("size", 0, "TypeRatio", "server", "", "database", 1), ("size", 1, "MinNodeCount", "function", "", "", 3), ("size", 2, "EdgeCoverage", "function", "in_network", "", 1)]
COVER = """cov AS (SELECT 'backup' AS model, CAST(0 AS BIGINT) AS expectation, (SELECT count(DISTINCT b.resource) / CAST((SELECT count(*) FROM resources WHERE type = 'database') AS DOUBLE) FROM backups b JOIN resources r ON r.id = b.resource AND r.type = 'database') AS f
    UNION ALL SELECT 'backup', 1, (SELECT count(DISTINCT b.resource) / CAST((SELECT count(*) FROM resources WHERE type = 'server') AS DOUBLE) FROM backups b JOIN resources r ON r.id = b.resource AND r.type = 'server')
    UNION ALL SELECT 'network', 0, (SELECT count(DISTINCT n.src) / CAST((SELECT count(*) FROM resources WHERE type = 'server') AS DOUBLE) FROM in_network n JOIN resources r ON r.id = n.src AND r.type = 'server')
    UNION ALL SELECT 'network', 1, least(1.0, (SELECT count(*) FROM resources WHERE type = 'server') / 50.0E0) UNION ALL SELECT 'size', 0, least(1.0, (SELECT count(*) FROM resources WHERE type = 'server') / CAST((SELECT count(*) FROM resources WHERE type = 'database') AS DOUBLE))
    UNION ALL SELECT 'size', 1, 0.0E0 UNION ALL SELECT 'size', 2, 1.0E0)"""


def coverage_rows(m):
    edges = m.backups.select(F.col("resource").alias("src"), F.lit("protected_by").alias("type"), F.lit("snapshot").alias("dst_type")).unionByName(m.in_network.select("src", F.lit("in_network").alias("type"), F.lit("network").alias("dst_type")))
    table = m.spark.createDataFrame(EXPECT, "model string, expectation long, kind string, a string, edge string, b string, minimum long")
    return R.coverage(m.resources, edges, table)


@query(f"{COVER} --- SELECT model, expectation, round(f, 6) AS fulfillment, f >= 1 AS met FROM cov")
def coverage_eval(m):
    return coverage_rows(m)


@query(f"{COVER} --- SELECT model, count(*) AS expectations, count(*) FILTER (WHERE f >= 1) AS n_met, round(avg(round(f, 6)), 6) AS score, count(*) FILTER (WHERE round(f, 6) < 0.5) AS critical_gaps FROM cov GROUP BY model")
def coverage_scores(m):
    return R.coverage_scores(coverage_rows(m))


@query(f"{COVER} --- SELECT model, count(*) FILTER (WHERE round(f, 6) < 0.5) + (SELECT count(*) FROM resources WHERE protection_status = 'unprotected' AND criticality >= 7) AS critical_gaps, (SELECT CAST(sum(cost_cents) AS BIGINT) FROM resources WHERE protection_status = 'unprotected') AS cost_exposure FROM cov GROUP BY model")
def sentinel_coverage(m):
    """Coverage with what unprotected resources put at risk."""
    bare = m.resources.filter("protection_status = 'unprotected'").agg(F.count_if(F.col("criticality") >= 7).alias("critical"), F.sum("cost_cents").alias("cost_exposure"))
    return R.coverage_scores(coverage_rows(m)).join(bare).select("model", (F.col("critical_gaps") + F.col("critical")).alias("critical_gaps"), "cost_exposure")


@query("""SELECT CASE WHEN c > 1000000 THEN 'over_budget' ELSE 'within_budget' END AS kind, 'total' AS id, c AS cents FROM (SELECT CAST(sum(cost_cents) AS BIGINT) AS c FROM resources) x UNION ALL SELECT 'over_retention', r.id, cost_cents FROM resources r JOIN (SELECT resource, count(*) AS n FROM backups GROUP BY resource) b ON r.id = b.resource WHERE criticality <= 3 AND protection_status = 'protected' AND n > 1
    UNION ALL SELECT 'cold_storage', id, cost_cents FROM resources WHERE protection_status = 'unprotected' AND criticality <= 2 AND cost_cents > 0""")
def cost_report(m):
    return R.cost_report(m.resources, m.backups)


@query("""SELECT id, CASE WHEN k % 90 < 0 THEN 0 WHEN need <= 0 THEN 100.0E0 WHEN age IS NULL THEN 0.0E0 WHEN age <= need THEN 100.0E0 ELSE greatest(0.0E0, 100.0E0 * (2 - age / CAST(need AS DOUBLE))) END AS score FROM (SELECT id, k, coalesce(backup_hours, 0) AS need, CASE WHEN k % 11 = 0 THEN NULL ELSE k % 60 END AS age FROM resources) x""")
def freshness_score(m):
    age = F.when(F.col("k") % 11 != 0, F.col("k") % 60)
    return m.resources.select("id", freshness(age, F.coalesce("backup_hours", F.lit(0))).alias("score"))


# --- rules ---------------------------------------------------------------------------------------------------------


@query("deep AS (SELECT c.child, CAST(1 AS BIGINT) AS depth FROM causal c WHERE c.parent NOT IN (SELECT child FROM causal) UNION SELECT c.child, d.depth + 1 FROM deep d JOIN causal c ON c.parent = d.child) --- SELECT cascade_id, n_events, max_depth FROM (SELECT cascade_id, count(DISTINCT seq) AS n_events, max(coalesce(depth, 0)) AS max_depth FROM log LEFT JOIN deep ON seq = child GROUP BY cascade_id) x WHERE n_events > 60 OR max_depth > 8")
def anomaly_cascade(m):
    return rules.anomaly_cascade(m.log, depths(m.causal), 60, 8)


TOPOLOGY = [("few suppliers", "part", "supplied_by", 1, 6), ("busy", "customer", "placed_by", 1, 14)]


@query("""SELECT rule, id, degree, CASE WHEN degree = 0 AND low > 0 THEN 'orphan' ELSE 'degree' END AS kind FROM (SELECT t.rule, n.id, t.low, t.high, count(e.id) AS degree FROM nodes n JOIN (VALUES ('few suppliers', 'part', 'supplied_by', 1, 6), ('busy', 'customer', 'placed_by', 1, 14)) t(rule, type, edge, low, high) ON n.type = t.type
    LEFT JOIN edges e ON e.type = t.edge AND (e.src = n.id OR e.dst = n.id) WHERE n.alive GROUP BY t.rule, n.id, t.low, t.high) x WHERE degree < low OR degree > high""")
def anomaly_topology(m):
    table = m.spark.createDataFrame(TOPOLOGY, "rule string, type string, edge string, low long, high long")
    return rules.anomaly_topology(m.nodes, m.edges.filter(F.col("type").isin([r[2] for r in TOPOLOGY])), table)


@query(f"{DIFFERENT} --- SELECT root, magnitude FROM (SELECT root, nodes * 10 + edges * 5 + properties AS magnitude FROM impact) x WHERE magnitude >= 12")
def anomaly_counterfactual(m):
    """Events without which much would be missing."""
    return impact_score(m).filter("magnitude >= 12").select("root", "magnitude")


@query(f"{CLAIM_STATUS} --- SELECT id, CASE WHEN status IN ('Verified', 'Operational') THEN 'already_verified' WHEN status IN ('Retracted', 'Archived') OR kind NOT IN ('AnomalyFinding', 'Property', 'Relationship') THEN 'human_review' WHEN against > 0 THEN 'dispute' WHEN confidence >= 0.8 AND reliable >= 1 THEN 'verify' WHEN reliable >= 1 THEN 'support' ELSE 'keep' END AS decision FROM (SELECT k.id, k.kind, k.confidence, s.status, count(e.side) FILTER (WHERE e.side = 'for' AND e.reliability >= 0.75) AS reliable, count(e.side) FILTER (WHERE e.side = 'against') AS against FROM claim_kinds k LEFT JOIN claim_status s ON k.id = s.claim_id LEFT JOIN claim_evidence e ON e.claim_id = k.id GROUP BY k.id, k.kind, k.confidence, s.status) x")
def verify_claim(m):
    return rules.verify_claims(claims(m), m.claim_evidence, ["AnomalyFinding", "Property", "Relationship"])


MATCH = """pm AS (SELECT a.id, p.policy_id, p.kind AS decision FROM actions a JOIN policies p ON p.active AND (p.scope = 'Any' OR (p.scope = 'Kind' AND a.kind = p.scope_value) OR (p.scope = 'Actor' AND a.actor = p.scope_value) OR (p.scope = 'Tenant' AND a.tenant_id = p.scope_value) OR (p.scope = 'Claim' AND a.claim_id = p.scope_value)))"""
DECIDE = f"""{ACTION_STATUS}, {MATCH}, best AS (SELECT id, policy_id, decision, row_number() OVER (PARTITION BY id ORDER BY CASE decision WHEN 'Block' THEN 0 WHEN 'Reject' THEN 1 WHEN 'RequireApproval' THEN 2 WHEN 'Review' THEN 3 WHEN 'Escalate' THEN 4 ELSE 5 END, policy_id) AS nth FROM pm),
    decided AS (SELECT a.id, coalesce(b.decision, 'Allow') AS decision, b.policy_id FROM actions a JOIN action_status s ON s.action_id = a.id LEFT JOIN best b ON b.id = a.id AND b.nth = 1 AND s.status = 'Proposed')"""


@query(f"{MATCH} --- SELECT id, policy_id, decision FROM pm")
def policy_match(m):
    return rules.match_policies(m.actions, m.policies)


@query(f"{DECIDE} --- SELECT id, decision, policy_id FROM decided")
def policy_evaluate(m):
    return rules.evaluate_policies(actions(m), m.policies)


@query(f"{DECIDE} --- SELECT id, CASE decision WHEN 'AutoApprove' THEN 'ActionApproved' WHEN 'RequireApproval' THEN 'ApprovalRequested' WHEN 'Block' THEN 'ActionRejected' WHEN 'Reject' THEN 'ActionRejected' ELSE 'Signal' END AS event FROM decided WHERE decision <> 'Allow'")
def policy_react(m):
    """The event that each decision leads to."""
    d = F.col("decision")
    event = F.when(d == "AutoApprove", "ActionApproved").when(d == "RequireApproval", "ApprovalRequested").when(d.isin("Block", "Reject"), "ActionRejected").otherwise("Signal")
    return policy_evaluate(m).filter("decision != 'Allow'").select("id", event.alias("event"))


@query(f"{CLAIM_STATUS} --- SELECT k.id AS claim_id, 'Backfill' AS action FROM claim_kinds k JOIN claim_status s ON k.id = s.claim_id WHERE k.kind = 'AnomalyFinding' AND k.predicate = 'is_stale' AND s.status IN ('Verified', 'Stale')")
def remediation_react(m):
    """Stale data found by a settled claim is to be filled again."""
    return claims(m).filter("kind = 'AnomalyFinding' and predicate = 'is_stale' and status in ('Verified', 'Stale')").select(F.col("id").alias("claim_id"), F.lit("Backfill").alias("action"))


@query(f"{ACTION_STATUS} --- SELECT a.id AS action_id, 'Unknown' AS outcome FROM actions a JOIN action_status s ON a.id = s.action_id WHERE a.kind = 'Backfill' AND s.status = 'Executed'")
def outcome_react(m):
    return actions(m).filter("kind = 'Backfill' and status = 'Executed'").select(F.col("id").alias("action_id"), F.lit("Unknown").alias("outcome"))


@query("""SELECT id, CAST(CASE WHEN criticality BETWEEN 9 AND 10 THEN 1 WHEN criticality BETWEEN 7 AND 8 THEN 4 WHEN criticality BETWEEN 5 AND 6 THEN 12 WHEN criticality BETWEEN 3 AND 4 THEN 24 ELSE 168 END AS BIGINT) AS frequency_hours,
    CAST(greatest(CASE WHEN criticality BETWEEN 9 AND 10 THEN 365 WHEN criticality BETWEEN 7 AND 8 THEN 90 WHEN criticality BETWEEN 5 AND 6 THEN 30 WHEN criticality BETWEEN 3 AND 4 THEN 14 ELSE 7 END, CASE sensitivity WHEN 'restricted' THEN 365 WHEN 'confidential' THEN 90 ELSE 0 END) AS BIGINT) AS retention_days,
    CASE WHEN criticality BETWEEN 9 AND 10 THEN 'hot' WHEN criticality BETWEEN 5 AND 8 THEN 'warm' WHEN criticality BETWEEN 3 AND 4 THEN 'cold' ELSE 'archive' END AS tier, criticality BETWEEN 7 AND 10 AS replication, sensitivity <> 'internal' AS encryption FROM resources""")
def protection_policy(m):
    level = F.when(F.col("sensitivity") == "restricted", "high").when(F.col("sensitivity") == "confidential", "medium").otherwise("low")
    return rules.protection_policy(m.resources.withColumn("level", level))


# --- subscriptions and their evolution -------------------------------------------------------------------------------

FIRES = """fires AS (SELECT 's1' AS subscription, seq, node_id FROM log WHERE kind = 'NodeCreated' UNION ALL SELECT 's2', seq, node_id FROM log WHERE kind = 'Signal' AND event_type = 'click' AND tenant_id = 't1' UNION ALL SELECT 's4', seq, node_id FROM log WHERE kind = 'EdgeCreated'),
    judged AS (SELECT subscription, seq, CASE seq % 4 WHEN 0 THEN 'tp' WHEN 1 THEN 'fp' WHEN 2 THEN 'accepted' ELSE 'pending' END AS verdict FROM fires)"""


def judged(m):
    """Fires with a verdict; here the verdict follows from the event's number."""
    verdict = F.element_at(F.array(*map(F.lit, ["tp", "fp", "accepted", "pending"])), (F.col("seq") % 4 + 1).cast("int"))
    return subscription_matches(m.log, SUBSCRIPTIONS).withColumn("verdict", verdict)


@query(f"{FIRES} --- SELECT subscription, count(*) AS fires, count(*) FILTER (WHERE verdict = 'tp') AS tp, count(*) FILTER (WHERE verdict = 'fp') AS fp, count(*) FILTER (WHERE verdict = 'accepted') AS accepted, count(*) FILTER (WHERE verdict = 'pending') AS pending, round(count(*) FILTER (WHERE verdict = 'tp') / CAST(nullif(count(*) FILTER (WHERE verdict IN ('tp', 'fp')), 0) AS DOUBLE), 6) AS precision FROM judged GROUP BY subscription")
def subscription_metrics(m):
    of = lambda v: F.count_if(F.col("verdict") == v)
    return judged(m).groupBy("subscription").agg(row_count().alias("fires"), of("tp").alias("tp"), of("fp").alias("fp"), of("accepted").alias("accepted"), of("pending").alias("pending"), F.round(F.try_divide(of("tp").cast("double"), of("tp") + of("fp")), 6).alias("precision"))


@query(f"{FIRES} --- SELECT subscription, round(fp / CAST(fp + tp AS DOUBLE), 6) AS fpr FROM (SELECT subscription, count(*) FILTER (WHERE verdict = 'fp') AS fp, count(*) FILTER (WHERE verdict = 'tp') AS tp FROM judged GROUP BY subscription) x WHERE fp + tp > 0")
def worst_performers(m):
    of = lambda v: F.count_if(F.col("verdict") == v)
    rows = judged(m).groupBy("subscription").agg(of("fp").alias("fp"), of("tp").alias("tp")).filter("fp + tp > 0")
    return rows.select("subscription", F.round(F.col("fp") / (F.col("fp") + F.col("tp")), 6).alias("fpr")).orderBy(F.desc("fpr"))


@query(f"{FIRES} --- SELECT subscription FROM (SELECT subscription, count(*) AS n, count(*) FILTER (WHERE verdict = 'fp') AS fp, count(*) FILTER (WHERE verdict = 'tp') AS tp FROM judged GROUP BY subscription) x WHERE n >= 10 AND fp + tp > 0 AND fp / CAST(fp + tp AS DOUBLE) >= 0.5")
def mutation_proposals(m):
    """Subscriptions that fire often and mostly wrongly."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    rows = judged(m).groupBy("subscription").agg(row_count().alias("n"), of("fp").alias("fp"), of("tp").alias("tp"))
    return rows.filter("n >= 10 and fp + tp > 0 and fp / (fp + tp) >= 0.5").select("subscription")


@query(f"{FIRES} --- SELECT count(*) FILTER (WHERE verdict = 'tp' AND user_id % 2 = 0) AS kept_tp, count(*) FILTER (WHERE verdict = 'fp' AND user_id % 2 = 1) AS removed_fp FROM judged j JOIN log l ON j.seq = l.seq WHERE subscription = 's4'")
def simulate_filter(m):
    """What a narrower filter would have kept and removed of a subscription's fires."""
    rows = judged(m).filter("subscription = 's4'").select("seq", "verdict").join(m.log.select("seq", (F.col("user_id") % 2 == 0).alias("passes")), "seq")
    return rows.agg(F.count_if((F.col("verdict") == "tp") & F.col("passes")).alias("kept_tp"), F.count_if((F.col("verdict") == "fp") & ~F.col("passes")).alias("removed_fp"))


@query(f"{FIRES} --- SELECT l.seq FROM log l WHERE kind IN ('NodeCreated', 'EdgeCreated') AND cascade_id IN (SELECT cascade_id FROM log GROUP BY cascade_id HAVING count(*) > 60) AND seq NOT IN (SELECT seq FROM judged WHERE verdict <> 'pending')")
def correlate_anomalies(m):
    """Matching events of oversize cascades that no judged fire covers: misses."""
    big = m.log.groupBy("cascade_id").agg(row_count().alias("n")).filter("n > 60").select("cascade_id")
    rows = m.log.filter("kind in ('NodeCreated', 'EdgeCreated')").join(big, "cascade_id", "left_semi").select("seq")
    return rows.join(judged(m).filter("verdict != 'pending'").select("seq"), "seq", "left_anti")


@query(f"{GAPS} --- SELECT severity, count(*) AS n, mode(requirement ORDER BY requirement) AS any_top FROM gaps WHERE requirement = 'EncryptionRequired' GROUP BY severity")
def diagnostics_rollup(m):
    return gaps(m).filter("requirement = 'EncryptionRequired'").groupBy("severity").agg(row_count().alias("n"), F.mode("requirement").alias("any_top"))


# --- detectors -----------------------------------------------------------------------------------------------------


@query("SELECT b.start, coalesce(c.n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600) FROM log), (SELECT max(CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600) FROM log), 3600)) AS start) b LEFT JOIN (SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600 AS start, count(*) AS n FROM log GROUP BY 1) c ON b.start = c.start")
def window_counts(m):
    return D.window_counts(m.log, 3600)


@query("""cnt AS (SELECT b.start, coalesce(c.n, 0) * 60.0E0 / 3600 AS r FROM (SELECT unnest(generate_series((SELECT min(CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600) FROM log), (SELECT max(CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600) FROM log), 3600)) AS start) b LEFT JOIN (SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600 AS start, count(*) AS n FROM log GROUP BY 1) c ON b.start = c.start),
    num AS (SELECT start, r, row_number() OVER (ORDER BY start) AS k FROM cnt), st AS (SELECT start, r, k, 0.0E0 AS expected, 0.0E0 AS z, r AS mean, 0.0E0 AS var FROM num WHERE k = 1 UNION ALL SELECT n.start, n.r, n.k, s.mean, CASE WHEN n.k <= 5 THEN 0.0E0 ELSE (n.r - s.mean) / sqrt(greatest(s.var, 1.0E0)) END, s.mean + 0.2E0 * (n.r - s.mean), 0.8E0 * (s.var + 0.2E0 * (n.r - s.mean) * (n.r - s.mean)) FROM st s JOIN num n ON n.k = s.k + 1)
    --- SELECT start, round(r, 6) AS rate, round(expected, 6) AS expected, round(z, 6) AS z, CASE WHEN k <= 5 OR expected <= 5 THEN 'normal' WHEN abs(z) >= 5 THEN 'critical' WHEN abs(z) >= 3 THEN 'warning' ELSE 'normal' END AS level FROM st""")
def commit_rate(m):
    rows = D.commit_rate(D.window_counts(m.log, 3600), 3600)
    return rows.select("start", *(F.round(c, 6).alias(c) for c in ("rate", "expected", "z")), "level")


@query("SELECT peer_id, lag, CASE WHEN (SELECT max(ts) FROM log) - ts > INTERVAL 60 SECOND OR lag >= 100 THEN 'critical' WHEN lag >= 10 THEN 'warning' ELSE 'normal' END AS level FROM (SELECT peer_id, max_by(lag, seq) FILTER (WHERE lag IS NOT NULL) AS lag, date_trunc('second', max(ts)) AS ts FROM heartbeats GROUP BY peer_id) x")
def replication_lag(m):
    latest = m.heartbeats.groupBy("peer_id").agg(F.max_by("lag", F.when(F.col("lag").isNotNull(), F.col("seq"))).alias("lag"), F.max("ts").alias("ts"))
    now = m.log.agg(F.max("ts")).first()[0]
    return D.replication_lag(latest, F.lit(now).cast("timestamp_ntz"))


@query("""per AS (SELECT CAST(floor(epoch_us(ts) / 21600000000) AS BIGINT) * 21600 AS start, 'actor:' || CAST(user_id % 5 AS STRING) AS actor, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS m FROM log WHERE user_id % 5 <> 4 GROUP BY 1, 2), t AS (SELECT start, CAST(sum(n) AS BIGINT) AS n_events, CAST(sum(m) AS BIGINT) AS n_actions FROM per GROUP BY start),
    top AS (SELECT start, actor, n, row_number() OVER (PARTITION BY start ORDER BY n DESC, actor DESC) AS nth FROM per) --- SELECT t.start, n_events, n_actions, actor AS top_actor, n AS top_n, CASE WHEN n_events >= 200 OR n_actions >= 50 OR n >= 100 THEN 'critical' WHEN n_events >= 50 OR n_actions >= 10 OR n >= 30 THEN 'warning' ELSE 'normal' END AS level FROM t JOIN top ON t.start = top.start AND nth = 1""")
def agent_storm(m):
    rows = m.log.select("ts", F.concat(F.lit("actor:"), (F.col("user_id") % 5).cast("string")).alias("actor"), (F.col("event_type") == "purchase").alias("is_action"))
    return D.agent_storm(rows, 21600, ["actor:4"])


@query("SELECT start, n, failed, CASE WHEN failed >= 10 OR (n >= 5 AND failed / CAST(n AS DOUBLE) >= 0.5) THEN 'critical' WHEN failed >= 3 OR (n >= 5 AND failed / CAST(n AS DOUBLE) >= 0.25) THEN 'warning' ELSE 'normal' END AS level FROM (SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600 AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed FROM log GROUP BY 1) x")
def action_failures(m):
    return D.action_failures(m.log.select("ts", (F.col("event_type") == "error").alias("failed")), 3600)


@query("""b AS (SELECT user_id, seq, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY seq) > 86400000000 OR lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY seq) IS NULL THEN 1 ELSE 0 END AS new FROM log), s AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY seq) AS nth FROM b)
    --- SELECT user_id, min(us) AS start, count(*) AS n, max(us) - min(us) AS micros FROM s GROUP BY user_id, nth""")
def sessions(m):
    return D.sessions(m.log, "user_id", 86400)


@query("SELECT l.seq AS prediction, 'ev:model:' || CAST(l.seq AS STRING) AS evidence, 'cl:model:' || CAST(l.seq AS STRING) AS claim, CASE WHEN l.value >= 100 THEN 'act:model:' || CAST(l.seq AS STRING) END AS action FROM log l WHERE l.event_type = 'error' AND l.value >= 50")
def reflex_bridge(m):
    """Predictions to evidence and claims, and to an action where one is called for."""
    made = lambda p: F.concat(F.lit(p), F.col("seq").cast("string"))
    return m.log.filter("event_type = 'error' and value >= 50").select(F.col("seq").alias("prediction"), made("ev:model:").alias("evidence"), made("cl:model:").alias("claim"), F.when(F.col("value") >= 100, made("act:model:")).alias("action"))


@query(f"{ACTION_STATUS} --- SELECT a.id AS action_id, k.id AS claim_id, k.born AS prediction, CASE WHEN s.status = 'Executed' THEN 'confirmed' ELSE 'refuted' END AS observation FROM actions a JOIN action_status s ON s.action_id = a.id JOIN claim_kinds k ON k.id = a.claim_id WHERE s.status IN ('Executed', 'Rejected')")
def observation_from_outcome(m):
    """From an action's end back to its claim and the prediction behind it."""
    rows = actions(m).filter("status in ('Executed', 'Rejected')").select(F.col("id").alias("action_id"), "claim_id", "status")
    born = m.claim_kinds.select(F.col("id").alias("claim_id"), F.col("born").alias("prediction"))
    return rows.join(born, "claim_id").select("action_id", "claim_id", "prediction", F.when(F.col("status") == "Executed", "confirmed").otherwise("refuted").alias("observation"))
