"""The reactive handlers of the estate, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arms as R
from ..operators.reports import recovery_plan
from .registry import query


def _values(rows: list, names: str) -> str:
    def one(x) -> str:
        return f"'{x}'" if isinstance(x, str) else f"{x}E0" if isinstance(x, float) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


_TYPES = ", ".join(f"'{t}'" for t in R.DISCOVERABLE)


@query(f"""SELECT f.seq, 'NodeCreated' AS event, f.id, f.type_id, CAST(NULL AS STRING) AS src, CAST(NULL AS STRING) AS dst, CAST(NULL AS DOUBLE) AS confidence FROM (SELECT resource_id AS id, seq, resource_type AS type_id, row_number() OVER (PARTITION BY resource_id ORDER BY seq) AS nth FROM arm_signals WHERE name = 'resource_discovered' AND length(resource_id) BETWEEN 1 AND 256 AND resource_type IN ({_TYPES})) f
    WHERE nth = 1 AND f.id NOT IN (SELECT id FROM estate_nodes) UNION ALL SELECT seq, 'NodeDeleted', resource_id, NULL, NULL, NULL, NULL FROM arm_signals WHERE name = 'resource_deleted' AND resource_id IN (SELECT id FROM estate_nodes)
    UNION ALL SELECT seq, 'EdgeCreated', 'dep:' || CAST(seq AS STRING), 'depends_on', source, target, coalesce(confidence, 0.8E0) FROM arm_signals WHERE name = 'dependency_discovered' AND source IN (SELECT id FROM estate_nodes) AND target IN (SELECT id FROM estate_nodes)""")
def arm_discovery(m):
    return R.discover(m.arm_signals, m.estate_nodes)


@query(f"""SELECT n.id, c.class AS classification, CAST(least(10, c.base + least(3, coalesce(d.n, 0))) AS BIGINT) AS criticality, c.sensitivity FROM estate_nodes n JOIN (SELECT * FROM {_values(R.CLASSES, "type_id, base, sensitivity, class")}) c ON c.type_id = n.type_id
    LEFT JOIN (SELECT dst, count(*) AS n FROM depends GROUP BY dst) d ON d.dst = n.id WHERE n.alive AND n.classification IS NULL""")
def arm_classification(m):
    return R.classify(m.estate_nodes, m.depends)


BACKED = """backed AS (SELECT s.seq, s.resource_id AS resource, 'snap_' || s.resource_id || '_' || substr(CAST(s.seq AS STRING), 1, 8) AS snap, CASE WHEN coalesce(s.frequency_hours, 24) <= 4 THEN 'incremental' ELSE 'full' END AS kind
    FROM arm_signals s JOIN estate_nodes n ON n.id = s.resource_id AND n.alive WHERE s.name IN ('policy_computed', 'scheduled_backup'))"""


@query(f"""{BACKED} --- SELECT seq, resource, 'NodeCreated' AS event, snap AS id, kind AS value FROM backed UNION ALL SELECT seq, resource, 'EdgeCreated', snap, 'protected_by' FROM backed
    UNION ALL SELECT seq, resource, 'NodeUpdated', resource, 'protected' FROM backed UNION ALL SELECT seq, resource, 'Signal', snap, 'backup_completed' FROM backed""")
def arm_execution(m):
    return R.back_up(m.arm_signals, m.estate_nodes)


@query(f"""{BACKED}, done AS (SELECT *, seq % 9 <> 3 AS ok FROM backed) --- SELECT seq, resource, 'verify_' || snap AS verification, CASE WHEN ok THEN 'passed' ELSE 'failed' END AS status, CASE WHEN ok THEN 1.0E0 ELSE 0.5E0 END AS backup_freshness,
    CASE WHEN ok THEN 1.0E0 ELSE 0.0E0 END AS backup_verified, CASE WHEN ok THEN 1.0E0 ELSE 0.0E0 END AS recovery_tested, CASE WHEN ok THEN 'verification_completed' ELSE 'verification_failed' END AS signal FROM done""")
def arm_verification(m):
    """Every ninth or so of the backups is one that didn't finish."""
    made = R.back_up(m.arm_signals, m.estate_nodes).filter("event = 'NodeCreated'")
    return R.verify_backups(made.select("seq", "resource", F.col("id").alias("snapshot"), F.when(F.col("seq") % 9 != 3, "completed").otherwise("failed").alias("status")), m.estate_nodes)


_SUM = lambda free, fresh: f"({fresh} + trust_2 + trust_3 + trust_4 + trust_5 + {free} + trust_7) / 7.0E0 * 100"


@query(f"""SELECT seq, resource, dimension, round(value, 6) AS value, round(least(100.0E0, greatest(0.0E0, CASE WHEN dimension = 'anomaly_free' THEN {_SUM("value", "trust_1")} ELSE {_SUM("trust_6", "value")} END)), 6) AS composite FROM (SELECT s.seq, s.resource_id AS resource, CASE WHEN s.name = 'trust_penalty' THEN 'anomaly_free' ELSE 'backup_freshness' END AS dimension,
    CASE WHEN s.name = 'trust_penalty' THEN greatest(n.trust_6 - s.penalty, 0.0E0) WHEN s.name = 'backed_up' OR s.status = 'protected' THEN 1.0E0 ELSE 0.0E0 END AS value, n.* FROM arm_signals s JOIN estate_nodes n ON n.id = s.resource_id AND n.alive WHERE s.name IN ('trust_penalty', 'status_changed', 'backed_up') AND NOT (s.name = 'trust_penalty' AND s.penalty IS NULL)) x""")
def arm_trust(m):
    return R.trust_changes(m.arm_signals, m.estate_nodes)


PLAN = """hit AS (SELECT 'database:0' AS node, CAST(0 AS BIGINT) AS depth UNION SELECT d.src, h.depth + 1 FROM hit h JOIN depends d ON d.dst = h.node WHERE h.depth < 20), steps AS (SELECT DISTINCT node, CASE WHEN node IN (SELECT resource FROM backups) THEN 'restore' ELSE 'manual' END AS action FROM hit)"""


@query(f"""{PLAN} --- SELECT 'incident_' || a.resource || '_' || substr(CAST(a.seq AS STRING), 1, 8) AS incident, a.resource, coalesce(a.severity, 'Low') AS severity, a.blast_scope, n.id IS NOT NULL AS linked, CASE WHEN p.total_steps > 0 THEN 'recovery_' || a.resource || '_' || substr(CAST(a.seq AS STRING), 1, 8) END AS plan, p.total_steps, p.restorable, p.manual
    FROM (SELECT seq, CASE WHEN seq % 2 = 0 THEN 'database:0' ELSE 'lost:' || CAST(user_id AS STRING) END AS resource, CASE WHEN value >= 90 THEN 'Critical' END AS severity, CAST(floor(value) AS BIGINT) AS blast_scope FROM log WHERE event_type = 'error' AND value >= 60) a
    LEFT JOIN estate_nodes n ON n.id = a.resource LEFT JOIN (SELECT 'database:0' AS resource, count(*) AS total_steps, count(*) FILTER (WHERE action = 'restore') AS restorable, count(*) FILTER (WHERE action = 'manual') AS manual FROM steps) p ON p.resource = a.resource""")
def arm_response(m):
    """An incident for each alert, and a plan where there is something to recover."""
    alerts = m.log.filter("event_type = 'error' and value >= 60").select("seq", F.when(F.col("seq") % 2 == 0, "database:0").otherwise(F.concat(F.lit("lost:"), F.col("user_id").cast("string"))).alias("resource"), F.when(F.col("value") >= 90, "Critical").alias("severity"), F.floor("value").alias("blast_scope"))
    steps = recovery_plan(m.depends, m.resources, m.backups, "database:0").select(F.lit("database:0").alias("origin"), "node", "action")
    return R.respond(alerts, m.estate_nodes, steps)


@query("""SELECT r.id, r.severity, 'compliance_violation' AS signal FROM (SELECT id, 'High' AS severity FROM resources WHERE type = 'database' AND NOT encrypted UNION ALL SELECT id, 'Medium' FROM resources WHERE protection_status <> 'protected' AND criticality >= 5) r""")
def arm_compliance(m):
    """Signals of the two rules that hold without any policy: data at rest is encrypted, critical resources are protected."""
    rules = F.array(F.when((F.col("type") == "database") & ~F.col("encrypted"), F.lit("High")), F.when((F.col("protection_status") != "protected") & (F.col("criticality") >= 5), F.lit("Medium")))
    return m.resources.select("id", F.explode(F.array_compact(rules)).alias("severity")).withColumn("signal", F.lit("compliance_violation"))


@query(f"""SELECT n.id, n.type_id, n.provider, coalesce(c.source_type, 'custom') AS source_type, n.region, 'unprotected' AS protection_status FROM estate_nodes n LEFT JOIN (SELECT * FROM {_values(R.SOURCE_TYPES, "provider, type_id, source_type")}) c ON c.provider = n.provider AND c.type_id = n.type_id""")
def node_builders(m):
    return R.build_nodes(m.estate_nodes)


@query("""SELECT src, dst, 'in_network' AS type, 'discovery_arm' AS discovered_by, 1.0E0 AS confidence FROM in_network UNION ALL SELECT src, dst, 'assumes_role', 'discovery_arm', 1.0E0 FROM has_role
    UNION ALL SELECT src, dst, 'depends_on', 'discovery_arm', least(1.0E0, confidence * 1.2E0) FROM depends UNION ALL SELECT resource, snapshot, 'protected_by', 'execution_arm', 1.0E0 FROM backups""")
def edge_builders(m):
    none, kind = F.lit(None).cast("double").alias("confidence"), lambda t: F.lit(t).alias("type")
    pairs = m.in_network.select("src", "dst", kind("in_network"), none).unionByName(m.has_role.select("src", "dst", kind("assumes_role"), none))
    pairs = pairs.unionByName(m.depends.select("src", "dst", kind("depends_on"), (F.col("confidence") * 1.2).alias("confidence")))
    return R.build_edges(pairs.unionByName(m.backups.select(F.col("resource").alias("src"), F.col("snapshot").alias("dst"), kind("protected_by"), none)))
