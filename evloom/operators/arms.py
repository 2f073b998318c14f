"""Reactive handlers of a protection estate as derivations of rows: each turns signals, joined with the graph as it
stands, into the events that follow from them. One pass over the signals each; what a handler says of one resource
never depends on another signal of the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import DIMENSIONS, TRUST, WEIGHTS

# Types of resources that may be discovered.
DISCOVERABLE = ["compute_instance", "managed_database", "object_store", "block_volume", "virtual_network", "network_segment", "firewall_rule", "identity_role", "identity_user", "serverless_function", "saas_application", "endpoint", "on_prem_server", "container_cluster", "container_service", "cache_cluster", "data_warehouse", "stream", "ml_endpoint", "message_queue", "notification_topic", "load_balancer", "cdn_distribution", "dns_zone", "file_system"]
# Criticality, sensitivity and class of a type of resource.
CLASSES = [
    ("managed_database", 9, "high", "tier_1_critical_data"), ("object_store", 7, "medium", "tier_2_important_data"), ("compute_instance", 5, "low", "tier_3_compute"),
    ("serverless_function", 3, "low", "tier_4_ephemeral"), ("saas_application", 6, "medium", "tier_2_important_data"), ("endpoint", 4, "low", "tier_3_compute"),
    ("on_prem_server", 7, "high", "tier_1_critical_data"), ("container_cluster", 7, "medium", "tier_2_important_data"), ("container_service", 6, "medium", "tier_2_important_data"),
    ("cache_cluster", 6, "medium", "tier_2_important_data"), ("data_warehouse", 9, "high", "tier_1_critical_data"), ("stream", 5, "medium", "tier_3_compute"),
    ("ml_endpoint", 5, "medium", "tier_3_compute"), ("message_queue", 5, "low", "tier_3_compute"), ("notification_topic", 3, "low", "tier_4_ephemeral"),
    ("load_balancer", 6, "low", "tier_2_important_data"), ("cdn_distribution", 4, "low", "tier_3_compute"), ("dns_zone", 8, "low", "tier_1_critical_data"), ("file_system", 7, "high", "tier_1_critical_data"),
]
# Edge types with the property and the confidence that their builders give.
EDGE_BUILDERS = [
    ("in_network", "discovery_arm", 1.0), ("in_segment", "discovery_arm", 1.0), ("has_firewall_rule", "discovery_arm", 1.0), ("attached_to", "discovery_arm", 1.0), ("assumes_role", "discovery_arm", 1.0),
    ("protected_by", "execution_arm", 1.0), ("verified_by", "verification_arm", 1.0),
]
# What a resource of a provider is called there, by its general type.
SOURCE_TYPES = [("aws", "managed_database", "rds"), ("aws", "compute_instance", "ec2"), ("aws", "object_store", "s3"), ("azure", "managed_database", "sql_database"), ("azure", "compute_instance", "virtual_machine"), ("azure", "object_store", "blob_storage"), ("gcp", "managed_database", "cloud_sql"), ("gcp", "compute_instance", "compute_engine"), ("gcp", "object_store", "cloud_storage")]
INCREMENTAL_HOURS, DEFAULT_HOURS, DEFAULT_CONFIDENCE = 4, 24, 0.8
MOST_DEPENDENTS, MOST_CRITICAL = 3, 10


def discover(signals: DataFrame, nodes: DataFrame) -> DataFrame:
    """seq, event, id, type_id, src, dst, confidence. ``signals``: seq, name, resource_id, resource_type, source,
    target, confidence; ``nodes``: id.

    A discovered resource becomes a node once, if its type is known and its names aren't too long; a deleted one goes
    if it is there; a dependency is an edge if both ends are there."""
    # Few resources may have most of the signals: those pass by a table of the ids, so none of them is sorted.
    here = nodes.select("id").distinct().hint("shuffle_hash")
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    found = signals.filter((F.col("name") == "resource_discovered") & F.length("resource_id").between(1, 256) & F.col("resource_type").isin(DISCOVERABLE))
    found = found.groupBy(F.col("resource_id").alias("id")).agg(F.min(F.struct("seq", "resource_type")).alias("f")).join(here, "id", "left_anti")
    found = found.select("f.seq", F.lit("NodeCreated").alias("event"), "id", F.col("f.resource_type").alias("type_id"), *none("src", "dst"), F.lit(None).cast("double").alias("confidence"))
    gone = signals.filter("name = 'resource_deleted'").select("seq", F.lit("NodeDeleted").alias("event"), F.col("resource_id").alias("id"), *none("type_id", "src", "dst"), F.lit(None).cast("double").alias("confidence")).join(here, "id", "left_semi")
    edges = signals.filter("name = 'dependency_discovered'").select("seq", F.col("source").alias("src"), F.col("target").alias("dst"), F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"))
    for end in ("src", "dst"):
        edges = edges.join(here.withColumnRenamed("id", end), end, "left_semi")
    edges = edges.select("seq", F.lit("EdgeCreated").alias("event"), F.concat(F.lit("dep:"), F.col("seq").cast("string")).alias("id"), F.lit("depends_on").alias("type_id"), "src", "dst", "confidence")
    return found.unionByName(gone).unionByName(edges)


def classify(nodes: DataFrame, depends: DataFrame) -> DataFrame:
    """id, classification, criticality, sensitivity of live nodes (id, type_id, alive, classification) that have none:
    the type's criticality and one for each of up to three dependents, ten at most."""
    rules = nodes.sparkSession.createDataFrame(CLASSES, "type_id string, base int, sensitivity string, class string")
    degree = depends.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rows = nodes.filter("alive and classification is null").join(F.broadcast(rules), "type_id").join(degree, "id", "left").fillna(0, ["n"])
    critical = F.least(F.col("base") + F.least(F.col("n"), F.lit(MOST_DEPENDENTS)), F.lit(MOST_CRITICAL)).cast("long")
    return rows.select("id", F.col("class").alias("classification"), critical.alias("criticality"), "sensitivity")


def suffix(seq: str = "seq") -> Column:
    return F.substring(F.col(seq).cast("string"), 1, 8)


def back_up(signals: DataFrame, nodes: DataFrame) -> DataFrame:
    """seq, resource, event, id, value: a snapshot, its edge, the resource's new status and a signal, for each
    ``policy_computed`` or ``scheduled_backup`` of a live resource."""
    rows = signals.filter(F.col("name").isin("policy_computed", "scheduled_backup")).select("seq", F.col("resource_id").alias("resource"), "frequency_hours")
    rows = rows.join(nodes.filter("alive").select(F.col("id").alias("resource")), "resource", "left_semi")
    snap = F.concat(F.lit("snap_"), F.col("resource"), F.lit("_"), suffix())
    kind = F.when(F.coalesce("frequency_hours", F.lit(DEFAULT_HOURS)) <= INCREMENTAL_HOURS, "incremental").otherwise("full")
    made = F.array(*(F.struct(F.lit(e).alias("event"), i.alias("id"), v.alias("value")) for e, i, v in (("NodeCreated", snap, kind), ("EdgeCreated", snap, F.lit("protected_by")), ("NodeUpdated", F.col("resource"), F.lit("protected")), ("Signal", snap, F.lit("backup_completed")))))
    return rows.select("seq", "resource", F.inline(made))


def verify_backups(snapshots: DataFrame, nodes: DataFrame) -> DataFrame:
    """seq, resource, verification, status, backup_freshness, backup_verified, recovery_tested, signal of each finished
    backup (``snapshots``: seq, resource, snapshot, status) whose resource and snapshot are there."""
    rows = snapshots.join(nodes.select(F.col("id").alias("resource")).distinct(), "resource", "left_semi")
    ok = F.coalesce(F.col("status") == "completed", F.lit(False))
    pick = lambda a, b: F.when(ok, F.lit(a)).otherwise(F.lit(b))
    return rows.select("seq", "resource", F.concat(F.lit("verify_"), "snapshot").alias("verification"), pick("passed", "failed").alias("status"), pick(1.0, 0.5).alias("backup_freshness"), pick(1.0, 0.0).alias("backup_verified"), pick(1.0, 0.0).alias("recovery_tested"), pick("verification_completed", "verification_failed").alias("signal"))


def trust_changes(signals: DataFrame, nodes: DataFrame, preset: str = "default") -> DataFrame:
    """seq, resource, dimension, value, composite: what a penalty, a new protection status or a new backup changes in a
    live resource's trust. ``signals``: seq, name (trust_penalty, status_changed, backed_up), resource_id, penalty,
    status; ``nodes``: id, alive and the seven dimensions."""
    rows = signals.filter(F.col("name").isin("trust_penalty", "status_changed", "backed_up") & ~((F.col("name") == "trust_penalty") & F.col("penalty").isNull()))
    rows = rows.join(nodes.filter("alive").withColumnRenamed("id", "resource_id"), "resource_id")
    free, fresh = (TRUST[DIMENSIONS.index(d)] for d in ("anomaly_free", "backup_freshness"))
    penalty = F.col("name") == "trust_penalty"
    value = F.when(penalty, F.greatest(F.coalesce(free, F.lit(1.0)) - F.col("penalty"), F.lit(0.0))).when((F.col("name") == "backed_up") | (F.col("status") == "protected"), 1.0).otherwise(0.0)
    rows = rows.withColumn("value", value)
    each = {t: F.coalesce(t, F.lit(0.0)) for t in TRUST}
    each[free] = F.when(penalty, F.col("value")).otherwise(each[free])
    each[fresh] = F.when(penalty, each[fresh]).otherwise(F.col("value"))
    weights = WEIGHTS[preset]
    composite = sum((each[t] * w for t, w in zip(TRUST, weights, strict=True)), F.lit(0.0)) / sum(weights) * 100
    return rows.select("seq", F.col("resource_id").alias("resource"), F.when(penalty, "anomaly_free").otherwise("backup_freshness").alias("dimension"), F.round("value", 6).alias("value"), F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), composite)), 6).alias("composite"))


def respond(alerts: DataFrame, nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """incident, resource, severity, blast_scope, linked, plan, total_steps, restorable, manual of each alert (seq,
    resource, severity, blast_scope). ``steps``: origin, node, action of recovery plans; no steps, no plan."""
    there = nodes.select(F.col("id").alias("resource"), F.lit(True).alias("linked")).distinct()
    plans = steps.groupBy(F.col("origin").alias("resource")).agg(F.count(F.lit(1)).alias("total_steps"), F.count_if(F.col("action") == "restore").alias("restorable"), F.count_if(F.col("action") == "manual").alias("manual"))
    rows = alerts.join(there, "resource", "left").fillna(False, ["linked"]).join(plans, "resource", "left")
    name = lambda p: F.concat(F.lit(p), F.col("resource"), F.lit("_"), suffix())
    return rows.select(name("incident_").alias("incident"), "resource", F.coalesce("severity", F.lit("Low")).alias("severity"), F.coalesce("blast_scope", F.lit(0)).cast("long").alias("blast_scope"), "linked", F.when(F.col("total_steps") > 0, name("recovery_")).alias("plan"), "total_steps", "restorable", "manual")


def build_nodes(resources: DataFrame) -> DataFrame:
    """id, type_id, provider, source_type, region, protection_status of resources (id, type_id, provider, region):
    what a provider's own kind of resource is, or 'custom' where it has none of that type."""
    kinds = resources.sparkSession.createDataFrame(SOURCE_TYPES, "provider string, type_id string, source_type string")
    return resources.join(F.broadcast(kinds), ["provider", "type_id"], "left").select("id", "type_id", "provider", F.coalesce("source_type", F.lit("custom")).alias("source_type"), "region", F.lit("unprotected").alias("protection_status"))


def build_edges(pairs: DataFrame) -> DataFrame:
    """src, dst, type, discovered_by, confidence of pairs (src, dst, type, confidence or null): with provenance, and the
    confidence clamped to 0..1."""
    kinds = pairs.sparkSession.createDataFrame(EDGE_BUILDERS, "type string, by string, sure double")
    rows = pairs.join(F.broadcast(kinds), "type", "left")
    given = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", "sure", F.lit(DEFAULT_CONFIDENCE))))
    return rows.select("src", "dst", "type", F.coalesce("by", F.lit("discovery_arm")).alias("discovered_by"), given.alias("confidence"))
