"""Scans, filters and lookups of the log, the graph and the workflow records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import event_filter, property_predicate, same_typed, valid_id
from ..operators.rules import fold_status
from .registry import query

CLAIM_STATUS = """claim_status AS (SELECT claim_id, max_by(to_status, seq) AS status FROM (SELECT claim_id, seq, CASE WHEN to_status = 'Supported' AND real <> 'Proposed' THEN real ELSE to_status END AS to_status
    FROM (SELECT *, last_value(CASE WHEN to_status <> 'Supported' THEN to_status END IGNORE NULLS) OVER (PARTITION BY claim_id ORDER BY seq) AS real FROM claim_events) x) y GROUP BY claim_id)"""
ACTION_STATUS = "action_status AS (SELECT action_id, max_by(to_status, seq) AS status FROM action_events GROUP BY action_id)"


def claims(m) -> DataFrame:
    """Claims with their folded status: support counts only for a proposed claim."""
    status = fold_status(m.claim_events, "claim_id", {"Supported": "Proposed"})
    return m.claim_kinds.join(status.withColumnRenamed("claim_id", "id"), "id", "left")


def actions(m) -> DataFrame:
    return m.actions.join(fold_status(m.action_events, "action_id").withColumnRenamed("action_id", "id"), "id", "left")


@query("SELECT id, type, alive, tenant_id FROM nodes WHERE id = 'customer:17'")
def node_get(m):
    return m.nodes.filter("id = 'customer:17'")


@query("SELECT id, src, dst, type FROM all_edges WHERE id = 'in_region:3'")
def edge_get(m):
    return m.all_edges.filter("id = 'in_region:3'")


@query("SELECT seq, kind, node_id, edge_id FROM log WHERE seq = 42")
def event_get(m):
    return m.log.filter("seq = 42").select("seq", "kind", "node_id", "edge_id")


@query("SELECT id, coalesce(bool_or(alive), false) AS has FROM (SELECT 'customer:17' AS id UNION ALL SELECT 'customer:18' UNION ALL SELECT 'customer:none') q LEFT JOIN (SELECT id AS nid, alive FROM nodes) n ON id = nid GROUP BY id")
def has_node(m):
    wanted = m.spark.createDataFrame([("customer:17",), ("customer:18",), ("customer:none",)], "id string")
    return wanted.join(m.nodes.filter("alive").select("id").distinct().withColumn("has", F.lit(True)), "id", "left").fillna(False, ["has"])


@query("SELECT id, coalesce(bool_or(e IS NOT NULL), false) AS has FROM (SELECT 'in_region:3' AS id UNION ALL SELECT 'c_nation:17' UNION ALL SELECT 'none') q LEFT JOIN (SELECT id AS e FROM edges) x ON id = e GROUP BY id")
def has_edge(m):
    ids = ["in_region:3", "c_nation:17", "none"]
    wanted = m.spark.createDataFrame([(x,) for x in ids], "id string")
    return wanted.join(m.edges.filter(F.col("id").isin(ids)).select("id").distinct().withColumn("has", F.lit(True)), "id", "left").fillna(False, ["has"])


@query("SELECT id FROM nodes WHERE type = 'customer' AND alive")
def nodes_by_type(m):
    return m.nodes.filter("type = 'customer' and alive").select("id")


@query("SELECT id, src, dst FROM edges WHERE type = 'supplied_by'")
def edges_by_type(m):
    return m.edges.filter("type = 'supplied_by'").select("id", "src", "dst")


@query("SELECT type, alive, count(*) AS n FROM nodes GROUP BY type, alive")
def all_nodes(m):
    return m.nodes.groupBy("type", "alive").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT type, count(*) AS n FROM all_edges GROUP BY type")
def all_edges(m):
    return m.all_edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, type FROM nodes WHERE tenant_id = 't1' AND alive")
def tenant_nodes(m):
    return m.nodes.filter("tenant_id = 't1' and alive").select("id", "type")


@query("SELECT seq, kind FROM log WHERE tenant_id = 't2'")
def tenant_events(m):
    return m.log.filter("tenant_id = 't2'").select("seq", "kind")


FILTER = {"or": [{"and": [{"kind": "NodeUpdated"}, {"node": "user:7"}]}, {"and": [{"signal": "error"}, {"not": {"node": "user:3"}}]}, {"node_type": "user"}]}


@query("SELECT seq, kind FROM log WHERE (kind = 'NodeUpdated' AND node_id = 'user:7') OR (kind = 'Signal' AND event_type = 'error' AND NOT coalesce(node_id = 'user:3', false)) OR (kind = 'NodeCreated' AND node_id LIKE 'user:%')")
def event_filter_tree(m):
    return m.log.filter(event_filter(FILTER)).select("seq", "kind")


PREDICATE = {"all": [{"exists": "backup_hours"}, {"greater": ["criticality", 4]}, {"any": [{"equals": ["provider", "aws"]}, {"less": ["retention_days", 10]}]}]}


@query("SELECT id FROM resources WHERE backup_hours IS NOT NULL AND criticality > 4 AND (provider = 'aws' OR retention_days < 10)")
def property_predicate_tree(m):
    return m.resources.filter(property_predicate(PREDICATE)).select("id")


SUBSCRIPTIONS = [("s1", 5, True, None, {"kind": "NodeCreated"}), ("s2", 9, True, "t1", {"signal": "click"}), ("s3", 1, False, None, {"any": True}), ("s4", 3, True, None, {"and": [{"kind": "EdgeCreated"}, {"not": {"kind": "Signal"}}]})]


def subscription_matches(log: DataFrame, subscriptions: list) -> DataFrame:
    """subscription, priority, seq: filters are compiled to one array expression, so the log is read once."""
    hits = [F.when(event_filter(tree) & (F.lit(True) if tenant is None else F.coalesce(F.col("tenant_id") == tenant, F.lit(False))), F.struct(F.lit(name).alias("subscription"), F.lit(priority).cast("long").alias("priority"))) for name, priority, enabled, tenant, tree in subscriptions if enabled]
    return log.select("seq", "node_id", F.inline(F.array_compact(F.array(*hits))))


@query("""SELECT 's1' AS subscription, CAST(5 AS BIGINT) AS priority, seq FROM log WHERE kind = 'NodeCreated' UNION ALL SELECT 's2', CAST(9 AS BIGINT), seq FROM log WHERE kind = 'Signal' AND event_type = 'click' AND tenant_id = 't1'
    UNION ALL SELECT 's4', CAST(3 AS BIGINT), seq FROM log WHERE kind = 'EdgeCreated'""")
def subscription_match(m):
    return subscription_matches(m.log, SUBSCRIPTIONS).select("subscription", "priority", "seq")


@query(f"{CLAIM_STATUS} --- SELECT id, kind, status FROM claim_kinds JOIN claim_status ON id = claim_id")
def claims_by_status(m):
    return claims(m).select("id", "kind", "status")


@query(f"{CLAIM_STATUS} --- SELECT status, count(*) AS n FROM claim_status GROUP BY status")
def claim_status_counts(m):
    """How many claims are verified, disputed, stale, retracted and so on."""
    return claims(m).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT claim_id FROM claim_evidence WHERE evidence_id IN (SELECT id FROM evidence WHERE reliability >= 0.9E0)")
def claims_by_evidence(m):
    good = m.evidence.filter("reliability >= 0.9").select(F.col("id").alias("evidence_id"))
    return m.claim_evidence.join(good, "evidence_id", "left_semi").select("claim_id").distinct()


@query(f"{ACTION_STATUS} --- SELECT kind, status, count(*) AS n FROM actions JOIN action_status ON id = action_id GROUP BY kind, status")
def actions_by_status(m):
    return actions(m).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id FROM actions WHERE target = 'customer:7' OR claim_id = 'cl:3'")
def actions_by_target(m):
    return m.actions.filter("target = 'customer:7' or claim_id = 'cl:3'").select("id")


@query("SELECT action_id, to_status AS result FROM action_events WHERE to_status IN ('Executed', 'Failed')")
def outcomes_for_action(m):
    return m.action_events.filter("to_status in ('Executed', 'Failed')").select("action_id", F.col("to_status").alias("result"))


@query("SELECT policy_id, scope, kind FROM policies WHERE active")
def policies_by_status(m):
    return m.policies.filter("active").select("policy_id", "scope", "kind")


@query("SELECT sensor_id, source, count(*) AS n, count(DISTINCT cursor_key) AS cursors FROM checkpoints GROUP BY sensor_id, source")
def checkpoint_lookups(m):
    return m.checkpoints.groupBy("sensor_id", "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cursor_key").alias("cursors"))


@query("SELECT sensor_id, source, max_by(id, seq) AS id, max(seq) AS seq FROM checkpoints GROUP BY sensor_id, source")
def latest_checkpoint(m):
    w = Window.partitionBy("sensor_id", "source").orderBy(F.desc("seq"))
    return m.checkpoints.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("sensor_id", "source", "id", "seq")


@query("SELECT sensor_id, cursor_key, min(seq) AS seq FROM checkpoints GROUP BY sensor_id, cursor_key")
def sensor_observation(m):
    """Observations by their cursor's key: the first of each counts, repeats are the same observation."""
    return m.checkpoints.groupBy("sensor_id", "cursor_key").agg(F.min("seq").alias("seq"))


@query("SELECT h.peer_id, h.follower_offset, h.lag, coalesce(r.role, 'Follower') AS role FROM (SELECT peer_id, max_by(follower_offset, seq) AS follower_offset, max_by(lag, seq) FILTER (WHERE lag IS NOT NULL) AS lag FROM heartbeats GROUP BY peer_id) h LEFT JOIN (SELECT peer_id, max_by(role, seq) AS role FROM role_events GROUP BY peer_id) r ON h.peer_id = r.peer_id")
def replica_state(m):
    beats = m.heartbeats.groupBy("peer_id").agg(F.max_by("follower_offset", "seq").alias("follower_offset"), F.max_by("lag", F.when(F.col("lag").isNotNull(), F.col("seq"))).alias("lag"))
    roles = m.role_events.groupBy("peer_id").agg(F.max_by("role", "seq").alias("role"))
    return beats.join(roles, "peer_id", "left").fillna("Follower", ["role"])


@query("SELECT id, kind, canonical_key FROM identities WHERE kind = 'supplier' OR tenant_id = 't1'")
def identities_by_kind(m):
    return m.identities.filter("kind = 'supplier' or tenant_id = 't1'").select("id", "kind", "canonical_key")


@query("SELECT entity_id FROM aliases WHERE source = 'crm' AND namespace = 'main' AND normalized = 'customer#000000007'")
def identity_by_alias(m):
    return m.aliases.filter("source = 'crm' and namespace = 'main' and normalized = 'customer#000000007'").select("entity_id")


@query("SELECT id, from_id, to_id FROM links WHERE kind = 'SameAs' AND (from_id = 'ent:s3' OR to_id = 'ent:c9' OR n_refs > 1)")
def identity_links(m):
    return m.links.filter("kind = 'SameAs' and (from_id = 'ent:s3' or to_id = 'ent:c9' or n_refs > 1)").select("id", "from_id", "to_id")


@query("SELECT kind, canonical_key, tenant_id, count(*) AS n FROM identities GROUP BY kind, canonical_key, tenant_id HAVING count(*) > 1 UNION ALL SELECT source, normalized, namespace, count(*) FROM aliases GROUP BY source, normalized, namespace HAVING count(*) > 1")
def identity_uniqueness(m):
    a = m.identities.groupBy("kind", "canonical_key", "tenant_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    b = m.aliases.groupBy(F.col("source").alias("kind"), F.col("normalized").alias("canonical_key"), F.col("namespace").alias("tenant_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return a.unionByName(b)


@query("SELECT l.id, CASE WHEN from_id = to_id THEN 'self' WHEN f.id IS NULL OR t.id IS NULL THEN 'missing endpoint' WHEN f.tenant_id <> t.tenant_id THEN 'tenants differ' END AS error FROM links l LEFT JOIN identities f ON from_id = f.id LEFT JOIN identities t ON to_id = t.id")
def identity_link_checks(m):
    ends = [m.identities.select(F.col("id").alias(f"{e}_id"), F.col("tenant_id").alias(f"{e}_tenant")) for e in ("from", "to")]
    rows = m.links.join(ends[0], "from_id", "left").join(ends[1], "to_id", "left")
    error = F.when(F.col("from_id") == F.col("to_id"), "self").when(F.col("from_tenant").isNull() | F.col("to_tenant").isNull(), "missing endpoint").when(F.col("from_tenant") != F.col("to_tenant"), "tenants differ")
    return rows.select("id", error.alias("error"))


@query("SELECT seq, kind, coalesce(node_id, src) AS target, cascade_id FROM log")
def event_summary(m):
    """The node that each event is about: an edge's creation is its source's."""
    return m.log.select("seq", "kind", F.coalesce("node_id", "src").alias("target"), "cascade_id")


@query("SELECT sequence, n_events, idempotency_key FROM batches")
def commit_summary(m):
    return m.batches.select("sequence", "n_events", "idempotency_key")


@query("SELECT s AS id, length(s) > 0 AND length(s) <= 256 AND strpos(s, '/') = 0 AND strpos(s, '\\') = 0 AND strpos(s, '..') = 0 AS valid FROM (SELECT DISTINCT p_type || CASE p_partkey % 4 WHEN 0 THEN '/' || p_brand WHEN 1 THEN '..' WHEN 2 THEN '' ELSE '-' || p_brand END AS s FROM part) x")
def id_validation(m):
    tail = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("/"), F.col("p_brand"))).when(F.col("p_partkey") % 4 == 1, "..").when(F.col("p_partkey") % 4 == 2, "").otherwise(F.concat(F.lit("-"), F.col("p_brand")))
    ids = m.part.select(F.concat("p_type", tail).alias("id")).distinct()
    return ids.select("id", valid_id(F.col("id")).alias("valid"))


SCHEMA = [("backup_hours", "Int", True), ("sensitivity", "String", True), ("region", "Float", False)]


@query("""SELECT id, 'backup_hours' AS field, 'missing' AS error FROM resources WHERE backup_hours IS NULL UNION ALL SELECT id, 'region', 'expected Float, is String' FROM resources""")
def schema_validate(m):
    """Errors of each resource against a schema: all of them, not the first; a float field takes an int too."""
    kinds = {"bigint": "Int", "int": "Int", "double": "Float", "string": "String", "boolean": "Bool", "timestamp_ntz": "Timestamp"}
    have = {c: kinds.get(k, k) for c, k in m.resources.dtypes}
    checks = []
    for field, kind, required in SCHEMA:
        if required:
            checks.append(F.when(F.col(field).isNull(), F.struct(F.lit(field).alias("field"), F.lit("missing").alias("error"))))
        if have[field] != kind and (kind, have[field]) != ("Float", "Int"):
            checks.append(F.when(F.col(field).isNotNull(), F.struct(F.lit(field).alias("field"), F.lit(f"expected {kind}, is {have[field]}").alias("error"))))
    return m.resources.select("id", F.inline(F.array_compact(F.array(*checks))))


@query("SELECT seq, CASE WHEN kind IN ('NodeCreated', 'NodeUpdated') THEN (CASE WHEN value IS NOT NULL AND value < 100 THEN 'accepted' ELSE 'rejected' END) WHEN kind = 'Signal' THEN 'accepted' ELSE 'unknown' END AS verdict FROM log")
def schema_gate(m):
    """Admission by kind: known kinds are validated, others follow the policy for unknown ones."""
    ok = F.coalesce(F.col("value") < 100, F.lit(False))
    verdict = F.when(F.col("kind").isin("NodeCreated", "NodeUpdated"), F.when(ok, "accepted").otherwise("rejected")).when(F.col("kind") == "Signal", "accepted").otherwise("unknown")
    return m.log.select("seq", verdict.alias("verdict"))


@query("""SELECT count(*) FILTER (WHERE i = j) AS same_int, CAST(0 AS BIGINT) AS int_float, count(*) FILTER (WHERE i > 10) AS above FROM (SELECT criticality AS i, CASE WHEN retention_days > 10 THEN 10 ELSE retention_days END AS j FROM resources) x""")
def typed_equality(m):
    """Tagged values: an int equals an int, never a float of the same size; comparisons widen."""
    i, j = F.col("criticality"), F.least(F.col("retention_days"), F.lit(10))
    same = same_typed(F.lit("Int"), i, F.lit("Int"), j)
    mixed = same_typed(F.lit("Int"), i.cast("double"), F.lit("Float"), i.cast("double"))
    return m.resources.agg(F.count_if(same).alias("same_int"), F.count_if(mixed).alias("int_float"), F.count_if(i > 10).alias("above"))
