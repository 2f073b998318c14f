"""Schemas, models, cells, approvals and claims: lookups, validation, and the events that verification leads to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as S
from ..operators import rules
from .lookups import ACTION_STATUS, CLAIM_STATUS, actions, claims
from .registry import query

VALID = """errs AS (SELECT p.entity, p.mode, p.id, s.schema_id, f.field, CASE WHEN x.tag IS NULL AND f.required AND p.mode = 'create' THEN 'missing required field' WHEN x.tag <> f.type AND NOT (f.type = 'Float' AND x.tag = 'Int') THEN 'expected ' || f.type || ', is ' || x.tag END AS error
    FROM payloads p JOIN schemas s ON s.entity = p.entity AND s.label = p.label AND s.status = 'Active' JOIN schema_fields f ON f.schema_id = s.schema_id LEFT JOIN payload_fields x ON x.entity = p.entity AND x.id = p.id AND x.field = f.field)"""


@query("SELECT s.schema_id, s.entity, s.label, s.status, s.version, count(f.field) AS fields FROM schemas s LEFT JOIN schema_fields f ON f.schema_id = s.schema_id WHERE s.status = 'Active' OR s.label = 'bucket' GROUP BY s.schema_id, s.entity, s.label, s.status, s.version")
def schema_lookup(m):
    """Schemas by status, type or predicate, with the number of their fields."""
    n = m.schema_fields.groupBy("schema_id").agg(F.count(F.lit(1)).alias("fields"))
    return m.schemas.filter("status = 'Active' or label = 'bucket'").join(n, "schema_id", "left").fillna(0, ["fields"])


@query("SELECT schema_id, label FROM schemas WHERE entity = 'Action' OR (entity = 'Policy' AND label = 'Review') OR (entity = 'Claim' AND label = 'is_stale')")
def schemas_by_kind(m):
    return m.schemas.filter("entity = 'Action' or (entity = 'Policy' and label = 'Review') or (entity = 'Claim' and label = 'is_stale')").select("schema_id", "label")


@query(f"{VALID} --- SELECT entity, mode, id, schema_id, field, error FROM errs WHERE error IS NOT NULL")
def schema_errors(m):
    """Nodes and edges, made or changed, evidence, claims, actions and policies against the registry."""
    return S.validate(m.payloads, m.payload_fields, m.schemas, m.schema_fields)


@query(f"""{VALID}, bad AS (SELECT DISTINCT entity, id FROM errs WHERE error IS NOT NULL), st AS (SELECT p.entity, p.id, s.schema_id IS NULL AS unknown, b.id IS NOT NULL AS invalid FROM payloads p LEFT JOIN schemas s ON s.entity = p.entity AND s.label = p.label AND s.status = 'Active' LEFT JOIN bad b ON b.entity = p.entity AND b.id = p.id)
    --- SELECT 'strict_reject' AS gate, entity, CASE WHEN unknown THEN 'no schema' WHEN invalid THEN 'invalid' ELSE 'accepted' END AS verdict, count(*) AS n FROM st GROUP BY 2, 3 UNION ALL SELECT 'strict_allow', entity, CASE WHEN invalid THEN 'invalid' ELSE 'accepted' END, count(*) FROM st GROUP BY 2, 3
    UNION ALL SELECT 'permissive_reject', entity, CASE WHEN unknown THEN 'would reject: no schema' WHEN invalid THEN 'would reject: invalid' ELSE 'accepted' END, count(*) FROM st GROUP BY 2, 3 UNION ALL SELECT 'off', entity, 'accepted', count(*) FROM st GROUP BY 2""")
def schema_gates(m):
    """How many records each mode of the gate admits."""
    errors = schema_errors(m)
    out = None
    for name, mode, unknown in (("strict_reject", "Strict", "Reject"), ("strict_allow", "Strict", "Allow"), ("permissive_reject", "Permissive", "Reject"), ("off", "Off", "Allow")):
        part = S.gate(m.payloads, errors, m.schemas, mode, unknown).groupBy("entity", "verdict").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("gate"), "entity", "verdict", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT id, kind, tenant_id FROM cells WHERE kind = 'Incident' AND tenant_id = 't0' UNION ALL SELECT id, kind, tenant_id FROM cells WHERE id = 'cell:u4'")
def cells_by_kind(m):
    return m.cells.filter("(kind = 'Incident' and tenant_id = 't0') or id = 'cell:u4'").select("id", "kind", "tenant_id")


@query("SELECT id, kind, status FROM micromodels WHERE status = 'Enabled' OR kind = 'ReplicationLag'")
def models_by_status(m):
    return m.micromodels.filter("status = 'Enabled' or kind = 'ReplicationLag'").select("id", "kind", "status")


@query("SELECT run_id, model_id, count(*) AS n, max_by(id, seq) AS last_id FROM predictions GROUP BY run_id, model_id")
def predictions_by_run(m):
    return m.predictions.groupBy("run_id", "model_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", "seq").alias("last_id"))


# How sure a model is of each of its levels.
CONFIDENCE = {"CommitRate": {"warming_up": 0.50, "normal": 0.80, "warning": 0.75, "critical": 0.90}, "ReplicationLag": {"normal": 0.85, "warning": 0.85, "critical": 0.95}, "AgentLoopStorm": {"normal": 0.85, "warning": 0.85, "critical": 0.95}, "ActionFailureRate": {"normal": 0.85, "warning": 0.85, "critical": 0.95}}
_SURE = " ".join(f"WHEN m.kind = '{k}' AND p.level = '{lv}' THEN {x}E0" for k, levels in CONFIDENCE.items() for lv, x in levels.items())


@query(f"SELECT p.id, m.kind, p.level, CASE {_SURE} END AS confidence FROM predictions p JOIN micromodels m ON m.id = p.model_id")
def model_confidence(m):
    """The confidence of each prediction: a table of model kind and level; null for a level that a model doesn't have."""
    rows = m.predictions.join(F.broadcast(m.micromodels.select(F.col("id").alias("model_id"), "kind")), "model_id")
    sure = F.coalesce(*(F.when((F.col("kind") == k) & (F.col("level") == lv), F.lit(x)) for k, levels in CONFIDENCE.items() for lv, x in levels.items()))
    return rows.select("id", "kind", "level", sure.alias("confidence"))


@query("""WITH w AS (SELECT CAST(floor(epoch_us(e.ts) / 300000000) AS BIGINT) * 300 AS start, e.event_type AS kind, e.value < 20 AS failed FROM log e), k AS (SELECT start, kind, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM w GROUP BY start, kind)
    SELECT start, kind, f AS failures FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY f DESC, kind) AS nth FROM k WHERE f > 0) x WHERE nth = 1""".replace("WITH w AS", "w AS", 1).replace("FROM w GROUP BY start, kind)\n    SELECT", "FROM w GROUP BY start, kind) --- SELECT"))
def top_failed_kind(m):
    """The kind of action that fails most in each window, ties by name."""
    start = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 300_000_000) * 300).cast("long")
    per = m.log.filter("value < 20").groupBy(start.alias("start"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("failures"))
    best = per.groupBy("start").agg(F.min(F.struct((-F.col("failures")).alias("f"), "kind")).alias("b"))
    return best.select("start", "b.kind", (-F.col("b.f")).alias("failures"))


REACT = f"""{CLAIM_STATUS}, evs AS (SELECT claim_id, count(*) FILTER (WHERE side = 'for' AND reliability >= 0.75) AS reliable, count(*) FILTER (WHERE side = 'against') AS against, min(CASE WHEN side = 'for' AND reliability >= 0.75 THEN seq END) AS first_for, min(CASE WHEN side = 'against' THEN seq END) AS first_against FROM claim_evidence GROUP BY claim_id),
    dec AS (SELECT k.id, e.first_for, e.first_against, CASE WHEN s.status IN ('Verified', 'Operational') THEN 'already_verified' WHEN s.status IN ('Retracted', 'Archived') OR k.kind NOT IN ('AnomalyFinding', 'Property', 'Relationship') THEN 'human_review' WHEN coalesce(e.against, 0) > 0 THEN 'dispute'
    WHEN k.confidence >= 0.8 AND coalesce(e.reliable, 0) >= 1 THEN 'verify' WHEN coalesce(e.reliable, 0) >= 1 THEN 'support' ELSE 'keep' END AS decision FROM claim_kinds k LEFT JOIN claim_status s ON k.id = s.claim_id LEFT JOIN evs e ON e.claim_id = k.id)"""


@query(f"""{REACT} --- SELECT id AS claim_id, CASE decision WHEN 'verify' THEN 'ClaimVerified' WHEN 'support' THEN 'ClaimSupported' WHEN 'dispute' THEN 'ClaimDisputed' ELSE 'claim_needs_human_review' END AS event, CASE decision WHEN 'support' THEN 'ev:' || CAST(first_for AS STRING) WHEN 'dispute' THEN 'ev:' || CAST(first_against AS STRING) END AS evidence_id
    FROM dec WHERE decision IN ('verify', 'support', 'dispute', 'human_review')""")
def verification_react(m):
    """The event that each verification leads to, with the first evidence that it names."""
    return rules.verification_events(rules.verify_claims(claims(m), m.claim_evidence, ["AnomalyFinding", "Property", "Relationship"]), m.claim_evidence)


@query(f"{CLAIM_STATUS} --- SELECT k.id, k.kind, s.status FROM claim_kinds k JOIN claim_status s ON s.claim_id = k.id WHERE (k.kind = 'Relationship' AND k.predicate = 'owns') OR k.user_id = 3")
def claims_by_kind(m):
    """Claims by kind and predicate, or by their subject."""
    return claims(m).filter("(kind = 'Relationship' and predicate = 'owns') or user_id = 3").select("id", "kind", "status")


@query(f"{ACTION_STATUS} --- SELECT a.id, a.claim_id, s.status FROM actions a JOIN action_status s ON s.action_id = a.id WHERE a.claim_id IN (SELECT id FROM claim_kinds WHERE kind = 'AnomalyFinding')")
def actions_by_claim(m):
    wanted = m.claim_kinds.filter("kind = 'AnomalyFinding'").select(F.col("id").alias("claim_id"))
    return actions(m).join(wanted, "claim_id", "left_semi").select("id", "claim_id", "status")


@query("SELECT status, approver, count(*) AS n, min(decided_at) AS first_at FROM approvals GROUP BY status, approver")
def approvals_by_status(m):
    return m.approvals.groupBy("status", "approver").agg(F.count(F.lit(1)).alias("n"), F.min("decided_at").alias("first_at"))


@query("SELECT scope, kind, count(*) AS n, count(*) FILTER (WHERE active) AS active FROM policies GROUP BY scope, kind")
def policies_by_kind(m):
    return m.policies.groupBy("scope", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("active").alias("active"))


@query("SELECT sensor_id, CAST(floor(seq / 100) AS BIGINT) AS run, count(*) AS observations, count(DISTINCT cursor_key) AS fresh, min(seq) AS first_seq, max(seq) AS last_seq FROM checkpoints GROUP BY sensor_id, CAST(floor(seq / 100) AS BIGINT)")
def sensor_runs(m):
    """Runs of each sensor: what it saw, and how much of it was new."""
    run = F.floor(F.col("seq") / 100).cast("long").alias("run")
    return m.checkpoints.groupBy("sensor_id", run).agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("cursor_key").alias("fresh"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("SELECT peer_id, CAST(floor(seq / 200) AS BIGINT) AS run, min(follower_offset) AS from_offset, max(follower_offset) AS to_offset, max(lag) AS worst_lag, CASE WHEN max(lag) IS NULL THEN 'unknown' WHEN max(lag) > 100 THEN 'behind' ELSE 'caught_up' END AS status FROM heartbeats GROUP BY peer_id, CAST(floor(seq / 200) AS BIGINT)")
def replication_runs(m):
    run = F.floor(F.col("seq") / 200).cast("long").alias("run")
    rows = m.heartbeats.groupBy("peer_id", run).agg(F.min("follower_offset").alias("from_offset"), F.max("follower_offset").alias("to_offset"), F.max("lag").alias("worst_lag"))
    return rows.withColumn("status", F.when(F.col("worst_lag").isNull(), "unknown").when(F.col("worst_lag") > 100, "behind").otherwise("caught_up"))
