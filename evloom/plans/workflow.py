"""Ledger, sources, pages, identities, trust and correlation; and the streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import streaming as S
from ..functions import row_count
from ..operators import ledger as L
from ..operators import trust as T
from ..sources import commits as C
from ..sources import trail
from .lookups import ACTION_STATUS, CLAIM_STATUS, actions, claims
from .registry import query
from .scratch import keep, shared_dir



def folder(m, name: str) -> str:
    return f"{shared_dir(m.spark)}/{name}-{uuid.uuid4().hex}"


# --- ledger --------------------------------------------------------------------------------------------------------

CHAIN = f"""con AS (SELECT *, sha256(concat_ws('|', sequence, first_seq, last_seq, n_events, idempotency_key, material)) AS content_hash, CAST(floor((sequence - 1) / {L.BLOCK}) AS BIGINT) AS block FROM batches),
    dig AS (SELECT block, sha256(string_agg(content_hash, '' ORDER BY sequence)) AS digest FROM con GROUP BY block), anc AS (SELECT CAST(0 AS BIGINT) AS block, '' AS anchor UNION ALL SELECT a.block + 1, sha256(a.anchor || d.digest) FROM anc a JOIN dig d ON d.block = a.block),
    chain AS (SELECT c.sequence, a.anchor AS previous_hash, sha256(a.anchor || c.content_hash) AS commit_hash FROM con c JOIN anc a ON a.block = c.block WHERE (c.sequence - 1) % {L.BLOCK} = 0 UNION ALL SELECT n.sequence, c.commit_hash, sha256(c.commit_hash || n.content_hash) FROM chain c JOIN con n ON n.sequence = c.sequence + 1 AND (n.sequence - 1) % {L.BLOCK} <> 0)"""


def committed(m):
    return m.batches.join(L.commit(m.batches), "sequence")


@query(f"{CHAIN} --- SELECT sequence, previous_hash, commit_hash FROM chain")
def commit_events(m):
    return L.commit(m.batches)


@query(f"{CHAIN} --- SELECT count(*) AS commits, count(*) FILTER (WHERE x.commit_hash <> sha256(x.previous_hash || c.content_hash)) AS errors FROM chain x JOIN con c ON c.sequence = x.sequence")
def commit_verify(m):
    """Commits, and how many break the chain: none of a sound one."""
    rows = committed(m)
    return rows.select("sequence").join(L.verify(rows), "sequence", "left").agg(row_count().alias("commits"), F.count("error").alias("errors"))


@query(f"""{CHAIN}, bad AS (SELECT x.sequence, x.previous_hash, x.commit_hash, sha256(concat_ws('|', c.sequence, c.first_seq, c.last_seq, CASE WHEN c.sequence % 4 = 3 THEN c.n_events + 1 ELSE c.n_events END, c.idempotency_key, c.material)) AS content_hash FROM chain x JOIN con c ON c.sequence = x.sequence)
    --- SELECT sequence, 'commit_hash' AS error FROM bad WHERE commit_hash <> sha256(previous_hash || content_hash)""")
def commit_verify_tampered(m):
    """Batches that were changed after they were committed show in their own hashes."""
    changed = F.when(F.col("sequence") % 4 == 3, F.col("n_events") + 1).otherwise(F.col("n_events"))
    return L.verify(committed(m).withColumn("n_events", changed))


@query("""SELECT before AS "after", sequence - before - 1 AS missing FROM (SELECT sequence, lag(sequence) OVER (ORDER BY sequence) AS before FROM batches WHERE sequence % 5 NOT IN (2, 3)) x WHERE sequence > before + 1""")
def commit_gaps(m):
    """Where a stream of commits skips sequences; repeats don't count."""
    sent = m.batches.filter("sequence % 5 not in (2, 3)")
    return L.gaps(sent.unionByName(sent))


@query("""WITH_S --- SELECT "column", value, count(*) AS n FROM (SELECT 'sequence' AS "column", CAST(sequence AS STRING) AS value FROM sent UNION ALL SELECT 'idempotency_key', idempotency_key FROM sent) x GROUP BY "column", value HAVING count(*) > 1""".replace("WITH_S", "sent AS (SELECT sequence, idempotency_key FROM batches UNION ALL SELECT sequence, idempotency_key FROM batches WHERE sequence % 6 = 1 UNION ALL SELECT sequence + 1000000, idempotency_key FROM batches WHERE sequence % 9 = 2)"))
def commit_load(m):
    """Duplicate sequences and keys of a log that is to be loaded: some batches are there twice, some under another number."""
    again = m.batches.filter("sequence % 6 = 1").unionByName(m.batches.filter("sequence % 9 = 2").withColumn("sequence", F.col("sequence") + 1_000_000))
    return L.duplicates(m.batches.unionByName(again), ["sequence", "idempotency_key"])


@query(f"""{CHAIN} --- SELECT sequence, CASE WHEN sequence <= 3 OR sequence - 1 IN (6) THEN 'sequence' WHEN sequence % 8 = 4 THEN 'status' WHEN sequence % 7 = 5 THEN 'idempotency_key' END AS error FROM chain WHERE sequence >= 2 AND sequence <> 6 AND sequence <= {L.BLOCK}""")
def replication_apply(m):
    """What a replica that has three commits says to those that it is sent: from the second on, without the sixth, some not
    committed, some with keys that it knows."""
    rows = committed(m).filter(f"sequence <= {L.BLOCK}")  # one block: a replica's page
    head = rows.filter("sequence = 3").select("sequence", "commit_hash").first()
    sent = rows.filter("sequence >= 2 and sequence != 6").withColumn("status", F.when(F.col("sequence") % 8 == 4, "Pending").otherwise("Committed"))
    return L.acceptable(sent, (head["sequence"], head["commit_hash"]), sent.filter("sequence % 7 = 5 and sequence > 3"))


@query("SELECT sequence, idempotency_key FROM batches")
def ingest_idempotent(m):
    """Batches sent twice: the first of each key stays."""
    again = m.batches.withColumn("sequence", F.col("sequence") + 1_000_000)
    return L.idempotent(m.batches.unionByName(again)).select("sequence", "idempotency_key")


@query("SELECT count(*) FILTER (WHERE sequence <= 5) AS removed, count(*) FILTER (WHERE sequence > 5) AS retained, min(sequence) FILTER (WHERE sequence > 5) AS first FROM batches")
def sink_commit_compact(m):
    a, b = folder(m, "log"), folder(m, "log")
    m.batches.write.parquet(a)
    removed, retained = L.compact(m.spark, a, b, 5)
    return m.spark.read.parquet(b).agg(F.min("sequence").alias("first")).select(F.lit(removed).cast("long").alias("removed"), F.lit(retained).cast("long").alias("retained"), "first")


@query("SELECT sequence, n_events, idempotency_key FROM batches")
def src_commit_log(m):
    """A log written as JSON lines in two appends, and read again."""
    path = folder(m, "commits")
    rows = m.batches.select("sequence", F.lit("").alias("previous_hash"), F.lit("").alias("commit_hash"), "idempotency_key", "n_events", "committed_at")
    C.append_commits(rows.filter("sequence <= 3"), path)
    C.append_commits(rows.filter("sequence > 3"), path)
    return C.read_commits(m.spark, path).select("sequence", "n_events", "idempotency_key")


@query("SELECT seq, kind FROM log WHERE tenant_id = 't1' AND seq > 500")
def src_event_file(m):
    """A tenant's events after a cursor, from files by tenant."""
    path = folder(m, "events")
    C.write_events(m.log.select("seq", "kind", "cascade_id", "tenant_id"), path)
    return C.read_events(m.spark, path, "seq long, kind string, cascade_id long", "t1", 500).select("seq", "kind")


@query("SELECT 'nodes' AS collection, CAST(7 AS BIGINT) AS sequence, count(*) AS n FROM nodes UNION ALL SELECT 'edges', 7, count(*) FROM edges")
def snap_latest(m):
    """Two snapshots are taken; the manifest of the later one. That is written first, so that a few of its rows can be the
    other's and edges are derived once; the sequence decides, not the order of writing."""
    path = folder(m, "snapshots")
    L.snapshot({"nodes": m.nodes, "edges": m.edges}, path, "two", 7)
    L.snapshot({name: m.spark.read.parquet(f"{path}/two/{name}").limit(5) for name in ("nodes", "edges")}, path, "one", 3)
    return L.latest(m.spark, path).select("collection", "sequence", "n")


@query("SELECT sequence, n_events FROM batches")
def recover(m):
    """A snapshot of the first batches and the log after it give all batches."""
    return L.recover(m.batches, m.batches.filter("sequence <= 4"), 4).select("sequence", "n_events")


@query("SELECT count(*) AS kept, min(seq) AS first FROM log WHERE seq > (SELECT max(seq) * 0.2 FROM log)")
def event_log_compact(m):
    """The log without its first fifth."""
    cut = m.log.agg((F.max("seq") * 0.2).alias("cut"))
    return m.log.join(F.broadcast(cut)).filter("seq > cut").agg(row_count().alias("kept"), F.min("seq").alias("first"))


@query("SELECT sequence, n_events, (SELECT max(sequence) FROM batches) > 7 AS more FROM batches WHERE sequence > 2 ORDER BY sequence LIMIT 5")
def replication_commits_page(m):
    return L.page(m.batches, "sequence", 2, 5).select("sequence", "n_events", "more")


@query("SELECT id, type FROM nodes WHERE id > 'customer:1' ORDER BY id LIMIT 100")
def paginate_by_cursor(m):
    return L.page(m.nodes.select("id", "type"), "id", "customer:1", 100).select("id", "type")


@query("SELECT peer_id, greatest(max_by(leader_offset, seq) - max_by(follower_offset, seq), 0) AS lag FROM heartbeats GROUP BY peer_id")
def replication_offsets(m):
    lag = F.max_by("leader_offset", "seq") - F.max_by("follower_offset", "seq")
    return m.heartbeats.groupBy("peer_id").agg(F.greatest(lag, F.lit(0)).alias("lag"))


@query("SELECT peer_id, coalesce(max_by(lag, seq) FILTER (WHERE lag IS NOT NULL), 0) = 0 AS allowed FROM heartbeats GROUP BY peer_id")
def promotion_gate(m):
    """A replica may lead if its last known lag is nothing; an unknown lag counts as nothing."""
    lag = F.coalesce(F.max_by("lag", F.when(F.col("lag").isNotNull(), F.col("seq"))), F.lit(0))
    return m.heartbeats.groupBy("peer_id").agg((lag == 0).alias("allowed"))


@query("SELECT peer_id, max_by(role, seq) AS role, max(seq) AS seq FROM role_events GROUP BY peer_id")
def promotion_status(m):
    return m.role_events.groupBy("peer_id").agg(F.max_by("role", "seq").alias("role"), F.max("seq").alias("seq"))


@query("SELECT 'log' AS collection, count(*) AS n FROM log UNION ALL SELECT 'evidence', count(*) FROM evidence UNION ALL SELECT 'actions', count(*) FROM actions UNION ALL SELECT 'identities', count(*) FROM identities")
def snapshot_counts(m):
    out = None
    for name in ("log", "evidence", "actions", "identities"):
        part = m.table(name).agg(row_count().alias("n")).select(F.lit(name).alias("collection"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT kind, id FROM (SELECT 'cascade' AS kind, CAST(cascade_id AS STRING) AS id FROM log GROUP BY cascade_id HAVING count(*) > 70 UNION ALL SELECT 'lag', peer_id FROM heartbeats GROUP BY peer_id HAVING max(lag) >= 100) x")
def analyze_batch(m):
    """The union of several rules' findings."""
    a = m.log.groupBy("cascade_id").agg(row_count().alias("n")).filter("n > 70").select(F.lit("cascade").alias("kind"), F.col("cascade_id").cast("string").alias("id"))
    return a.unionByName(m.heartbeats.groupBy("peer_id").agg(F.max("lag").alias("lag")).filter("lag >= 100").select(F.lit("lag").alias("kind"), F.col("peer_id").alias("id")))


@query("SELECT sha256('cascade|' || CAST(cascade_id AS STRING)) AS anomaly_id, cascade_id FROM log GROUP BY cascade_id HAVING count(*) > 60")
def anomaly_stable_id(m):
    rows = m.log.groupBy("cascade_id").agg(row_count().alias("n")).filter("n > 60")
    return rows.select(F.sha2(F.concat_ws("|", F.lit("cascade"), "cascade_id"), 256).alias("anomaly_id"), "cascade_id")


# --- audit trail -----------------------------------------------------------------------------------------------------


def trail_records(m):
    """Audit records made of the log: creations, deletions, reads, errors, unknown calls and, of events that are there,
    repeats: a later record with the id of an earlier one."""
    log, event = m.log.select("seq", "user_id"), F.col("seq")
    again = log.filter(event % 30 == 6).join(log.filter(event % 30 == 0).select((event + 6).alias("seq")), "seq", "left_semi")
    k = F.col("seq") % 6
    source = F.when(k == 4, "unknown.amazonaws.com").when(k == 5, "ec2.amazonaws.com").otherwise("s3.amazonaws.com")
    name = F.when(k == 0, "CreateBucket").when(k == 1, "DeleteBucket").when(k == 2, "ListBuckets").when(k == 3, "CreateBucket").when(k == 4, "CreateThing").otherwise("RunInstances")
    bucket = F.to_json(F.struct(F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("bucketName")))
    items = F.transform(F.sequence(F.lit(1), (F.col("user_id") % 3 + 1).cast("int")), lambda i: F.struct(F.concat(F.lit("i-"), F.col("seq").cast("string"), F.lit("-"), i.cast("string")).alias("instanceId")))
    answer = F.to_json(F.struct(F.struct(items.alias("items")).alias("instancesSet")))
    record = F.struct((F.col("seq") - F.when(F.col("seq") % 30 == 6, 6).otherwise(0)).cast("string").alias("eventID"), source.alias("eventSource"), name.alias("eventName"), F.lit("eu-1").alias("awsRegion"), F.when(k == 3, "AccessDenied").alias("errorCode"), F.when(k != 5, bucket).alias("requestParameters"), F.when(k == 5, answer).alias("responseElements"))
    nested = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.to_json(record), '\\\\"', '"'), '"\\{', "{"), '\\}"', "}")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("seq", nested.alias("record")))), lambda r: r["record"])
    return log.filter(event % 30 != 6).unionByName(again).groupBy((event / 50).cast("long").alias("document")).agg(F.concat(F.lit('{"Records":['), F.array_join(in_order, ","), F.lit("]}")).alias("json"))


@query("""rec AS (SELECT DISTINCT seq - CASE WHEN seq % 30 = 6 THEN 6 ELSE 0 END AS id FROM log), one AS (SELECT r.id, r.id % 6 AS k, l.user_id FROM rec r JOIN log l ON l.seq = r.id)
    --- SELECT CAST(id AS STRING) AS eventID, CASE k WHEN 2 THEN 'read_only' WHEN 3 THEN 'error' WHEN 4 THEN 'unrecognised' ELSE 'signal' END AS outcome, CASE k WHEN 0 THEN 'discovered' WHEN 1 THEN 'deleted' WHEN 5 THEN 'discovered' END AS signal,
    CASE WHEN k IN (0, 1) THEN 'object_store' WHEN k = 5 THEN 'compute_instance' END AS resource_type, CASE WHEN k = 5 THEN 'i-' || CAST(id AS STRING) || '-' || CAST(i AS STRING) END AS resource_id FROM one, range(1, 4) r(i) WHERE k = 5 AND i <= user_id % 3 + 1
    UNION ALL SELECT CAST(id AS STRING), CASE k WHEN 2 THEN 'read_only' WHEN 3 THEN 'error' WHEN 4 THEN 'unrecognised' ELSE 'signal' END, CASE k WHEN 0 THEN 'discovered' WHEN 1 THEN 'deleted' END, CASE WHEN k IN (0, 1) THEN 'object_store' END, NULL FROM one WHERE k <> 5 AND k > 1
    UNION ALL SELECT CAST(id AS STRING), 'signal', CASE k WHEN 0 THEN 'discovered' ELSE 'deleted' END, 'object_store', 'b' || CAST(user_id AS STRING) FROM one WHERE k <= 1""")
def src_cloudtrail(m):
    rows = trail.records(trail_records(m), order="document")
    return trail.parse(rows).drop("target", "confidence")


# --- identities, trust, correlation ----------------------------------------------------------------------------------

ENTITY = """bad_alias AS (SELECT source, namespace, normalized FROM aliases GROUP BY source, namespace, normalized HAVING count(DISTINCT entity_id) > 1),
    al AS (SELECT a.entity_id, count(*) AS n, count(DISTINCT a.source) AS n_sources, bool_or(a.normalized = i.canonical_key) AS matches, bool_or(b.source IS NOT NULL) AS bad FROM aliases a JOIN identities i ON i.id = a.entity_id LEFT JOIN bad_alias b ON b.source = a.source AND b.namespace = a.namespace AND b.normalized = a.normalized GROUP BY a.entity_id),
    ends AS (SELECT from_id AS id FROM links UNION SELECT to_id FROM links),
    ent AS (SELECT i.id, i.kind, i.tenant_id, i.canonical_key, least(0.85E0, greatest(0.0E0, CASE WHEN i.confidence >= 0.8 THEN 0.30E0 WHEN i.confidence < 0.2 THEN -0.30E0 ELSE 0 END + CASE WHEN a.n > 1 THEN 0.10E0 WHEN a.n = 1 THEN -0.10E0 ELSE -0.20E0 END + 0.20E0 + 0.10E0 + CASE WHEN a.n_sources > 1 THEN 0.10E0 ELSE 0 END
    + CASE WHEN a.matches THEN 0.10E0 ELSE 0 END + 0.05E0 + CASE WHEN e.id IS NOT NULL THEN 0.10E0 ELSE 0 END - CASE WHEN a.bad THEN 0.25E0 ELSE 0 END)) AS trust FROM identities i LEFT JOIN al a ON a.entity_id = i.id LEFT JOIN ends e ON e.id = i.id)"""
LEVEL = "CASE WHEN {s} >= 0.8 THEN 'High' WHEN {s} >= 0.5 THEN 'Medium' WHEN {s} >= 0.2 THEN 'Low' ELSE 'Unknown' END"


def entity_scores(m):
    return T.entity_trust(m.identities, m.aliases, m.links)


@query(f"{ENTITY} --- SELECT id, round(trust, 6) AS score, {LEVEL.format(s='round(trust, 6)')} AS level FROM ent")
def trust_entity(m):
    return entity_scores(m).select("id", "score", "level")


@query(f"""{ENTITY} --- SELECT id, round(least(1.0E0, greatest(0.0E0, s)), 6) AS score FROM (SELECT l.id, CASE WHEN l.confidence >= 0.8 THEN 0.25E0 WHEN l.confidence >= 0.5 THEN 0.10E0 ELSE -0.20E0 END + CASE WHEN f.trust >= 0.8 THEN 0.15E0 WHEN f.trust <= 0.4 THEN -0.15E0 ELSE 0 END
    + CASE WHEN t.trust >= 0.8 THEN 0.15E0 WHEN t.trust <= 0.4 THEN -0.15E0 ELSE 0 END + CASE WHEN n_refs > 0 THEN 0.15E0 ELSE -0.05E0 END + CASE WHEN l.kind = 'Custom' THEN -0.05E0 ELSE 0.10E0 END AS s FROM links l LEFT JOIN (SELECT id, round(trust, 6) AS trust FROM ent) f ON f.id = l.from_id LEFT JOIN (SELECT id, round(trust, 6) AS trust FROM ent) t ON t.id = l.to_id) x""")
def trust_link(m):
    return T.link_trust(m.links, entity_scores(m).select("id", F.col("score").alias("trust"))).select("id", "score")


@query(f"""{ENTITY} --- SELECT x.source, round(least(0.8E0, greatest(0.0E0, 0.2E0 + CASE WHEN mean >= 0.7 THEN 0.2E0 ELSE 0 END - CASE WHEN mean <= 0.4 THEN 0.2E0 ELSE 0 END + CASE WHEN n >= 10 THEN 0.2E0 WHEN n = 1 THEN -0.1E0 ELSE 0 END + CASE WHEN keyed > 0 THEN 0.1E0 ELSE 0 END + CASE WHEN spaces > 1 THEN 0.1E0 ELSE 0 END
    - CASE WHEN x.source IN (SELECT source FROM bad_alias) THEN 0.2E0 ELSE 0 END)), 6) AS score FROM (SELECT a.source, avg(round(e.trust, 6)) AS mean, count(DISTINCT e.id) AS n, count(DISTINCT a.namespace) AS spaces, count(*) FILTER (WHERE a.normalized = e.canonical_key) AS keyed FROM aliases a JOIN ent e ON e.id = a.entity_id GROUP BY a.source) x""")
def trust_source(m):
    rows = entity_scores(m).select("id", F.col("score").alias("trust")).join(m.identities.select("id", "canonical_key"), "id")
    return T.source_trust(rows, m.aliases).select("source", "score")


SETTLED = f"""{CLAIM_STATUS}, {ACTION_STATUS}, act AS (SELECT a.claim_id, bool_or(s.status = 'Executed') AS executed, bool_or(s.status IN ('Executed', 'Failed')) AS outcome, bool_or(p.status = 'Granted') AS approved, bool_or(p.status = 'Granted' AND p.approver <> 'actor:0') AS human FROM actions a JOIN action_status s ON s.action_id = a.id LEFT JOIN approvals p ON p.action_id = a.id GROUP BY a.claim_id),
    seen AS (SELECT 'cl:' || CAST(l.user_id AS STRING) AS claim_id, count(*) AS n FROM predictions p JOIN log l ON l.seq = p.seq WHERE p.level = 'critical' GROUP BY l.user_id),
    base AS (SELECT k.id, k.confidence, s.status, count(e.side) FILTER (WHERE e.side = 'for') AS n_for, count(e.side) FILTER (WHERE e.side = 'for' AND reliability >= 0.75) AS n_rel, count(e.side) FILTER (WHERE e.side = 'against') AS n_against FROM claim_kinds k LEFT JOIN claim_status s ON s.claim_id = k.id LEFT JOIN claim_evidence e ON e.claim_id = k.id GROUP BY k.id, k.confidence, s.status)"""


@query(f"""{SETTLED} --- SELECT b.id, round(least(1.0E0, greatest(0.0E0, CASE b.status WHEN 'Verified' THEN 0.2E0 WHEN 'Supported' THEN 0.1E0 WHEN 'Disputed' THEN -0.3E0 WHEN 'Retracted' THEN -1.0E0 ELSE 0 END + CASE WHEN confidence >= 0.8 THEN 0.1E0 ELSE 0 END + CASE WHEN n_for > 0 THEN 0.1E0 ELSE 0 END + CASE WHEN n_rel > 0 THEN 0.1E0 ELSE 0 END
    + CASE WHEN a.approved THEN 0.15E0 ELSE 0 END + CASE WHEN a.executed THEN 0.15E0 ELSE 0 END + CASE WHEN a.outcome THEN 0.1E0 ELSE 0 END + CASE WHEN s.n > 0 THEN 0.1E0 ELSE 0 END + CASE WHEN s.n > 1 THEN 0.1E0 ELSE 0 END + CASE WHEN s.n >= 3 THEN 0.15E0 ELSE 0 END + CASE WHEN a.human THEN 0.1E0 ELSE 0 END - CASE WHEN n_against > 0 THEN 0.2E0 ELSE 0 END)), 6) AS score
    FROM base b LEFT JOIN act a ON a.claim_id = b.id LEFT JOIN seen s ON s.claim_id = b.id""")
def trust_claim(m):
    side = lambda s: F.col("side") == s
    e = m.claim_evidence.groupBy(F.col("claim_id").alias("id")).agg(F.count_if(side("for")).alias("n_for"), F.count_if(side("for") & (F.col("reliability") >= 0.75)).alias("n_reliable"), F.count_if(side("against")).alias("n_against"))
    granted = m.approvals.filter("status = 'Granted'").select(F.col("action_id").alias("id"), "approver")
    s = F.col("status")
    done = actions(m).join(granted, "id", "left").groupBy("claim_id").agg(F.bool_or(s == "Executed").alias("executed"), F.bool_or(s.isin("Executed", "Failed")).alias("outcome"), F.bool_or(F.col("approver").isNotNull()).alias("approved"), F.bool_or(F.col("approver") != "actor:0").alias("human_approved"))
    seen = m.predictions.filter("level = 'critical'").join(m.log.select("seq", "user_id"), "seq").groupBy(F.concat(F.lit("cl:"), F.col("user_id").cast("string")).alias("id")).agg(F.count(F.lit(1)).alias("n_observed"))
    rows = claims(m).join(e, "id", "left").join(done.withColumnRenamed("claim_id", "id"), "id", "left").join(seen, "id", "left").fillna(0, ["n_for", "n_reliable", "n_against"])
    return T.claim_trust(rows).select("id", "score")


@query(f"""{ENTITY}, {ACTION_STATUS}, fact AS (SELECT a.tenant_id, bool_or(s.status IN ('Executed', 'Failed')) AS outcomes, bool_or(s.status = 'Executed') AS executed, bool_or(s.status = 'Failed' AND a.kind = 'Restore') AS failed, bool_or(s.status = 'Rejected' AND a.kind = 'Custom') AS rejected FROM actions a JOIN action_status s ON s.action_id = a.id GROUP BY a.tenant_id),
    obs AS (SELECT l.tenant_id, bool_or(p.level = 'critical') AS observations FROM predictions p JOIN log l ON l.seq = p.seq GROUP BY l.tenant_id), con AS (SELECT k.tenant_id, bool_or(e.side = 'against' AND e.reliability >= 0.9) AS contradicted FROM claim_evidence e JOIN claim_kinds k ON k.id = e.claim_id GROUP BY k.tenant_id),
    ch AS (SELECT e.kind || '/' || e.tenant_id AS cell, e.tenant_id, CASE WHEN i.confidence > 0 OR e.tenant_id = 't2' THEN round(e.trust, 6) END AS t FROM ent e JOIN identities i ON i.id = e.id)
    --- SELECT x.cell, round(least(1.0E0, greatest(0.0E0, mean + 0.2E0 + CASE WHEN mean >= 0.8 THEN 0.2E0 ELSE 0 END + CASE WHEN lo >= 0.8 AND known = n THEN 0.15E0 ELSE 0 END - CASE WHEN lo < 0.5 THEN 0.2E0 ELSE 0 END - CASE WHEN known < n THEN 0.1E0 ELSE 0 END + CASE WHEN f.outcomes THEN 0.1E0 ELSE 0 END + CASE WHEN o.observations THEN 0.1E0 ELSE 0 END + CASE WHEN f.executed THEN 0.1E0 ELSE 0 END
    - CASE WHEN f.failed THEN 0.2E0 ELSE 0 END - CASE WHEN f.rejected THEN 0.15E0 ELSE 0 END - CASE WHEN c.contradicted THEN 0.2E0 ELSE 0 END)), 6) AS score FROM (SELECT cell, tenant_id, avg(t) AS mean, min(t) AS lo, count(*) AS n, count(t) AS known FROM ch GROUP BY cell, tenant_id) x LEFT JOIN fact f ON f.tenant_id = x.tenant_id LEFT JOIN obs o ON o.tenant_id = x.tenant_id LEFT JOIN con c ON c.tenant_id = x.tenant_id""")
def trust_cell(m):
    """Cells of the identities of a kind and tenant, with what their tenant's actions, models and claims say."""
    known = F.when((F.col("confidence") > 0) | (F.col("tenant_id") == "t2"), F.col("score"))
    rows = m.identities.join(entity_scores(m).select("id", "score"), "id").select(F.concat_ws("/", "kind", "tenant_id").alias("cell"), "tenant_id", known.alias("trust"))
    s = F.col("status")
    done = actions(m).groupBy("tenant_id").agg(F.bool_or(s.isin("Executed", "Failed")).alias("outcomes"), F.bool_or(s == "Executed").alias("executed"), F.bool_or((s == "Failed") & (F.col("kind") == "Restore")).alias("failed"), F.bool_or((s == "Rejected") & (F.col("kind") == "Custom")).alias("rejected"))
    seen = m.predictions.join(m.log.select("seq", "tenant_id"), "seq").groupBy("tenant_id").agg(F.bool_or(F.col("level") == "critical").alias("observations"))
    against = m.claim_evidence.join(m.claim_kinds.select(F.col("id").alias("claim_id"), "tenant_id"), "claim_id").groupBy("tenant_id").agg(F.bool_or((F.col("side") == "against") & (F.col("reliability") >= 0.9)).alias("contradicted"))
    facts = rows.select("cell", "tenant_id").distinct().join(done, "tenant_id", "left").join(seen, "tenant_id", "left").join(against, "tenant_id", "left").drop("tenant_id")
    return T.cell_trust(rows.select("cell", "trust"), facts).select("cell", "score")


@query(f"""{ENTITY} --- SELECT tenant_id, count(DISTINCT kind) AS parts, round(avg(t), 6) AS score FROM (SELECT tenant_id, kind, round(max_by(trust, id), 6) AS t FROM ent GROUP BY tenant_id, kind) x GROUP BY tenant_id""")
def health_cell_compose(m):
    """A cell from the latest member of each kind: the mean of the trust that is there."""
    rows = m.identities.join(entity_scores(m).select("id", "score"), "id").groupBy("tenant_id", "kind").agg(F.max_by("score", "id").alias("t"))
    return rows.groupBy("tenant_id").agg(F.countDistinct("kind").alias("parts"), F.round(F.avg("t"), 6).alias("score"))


def alias_queries(m):
    return m.supplier.select(F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("query_id"), F.lit("erp").alias("source"), F.lit("main").alias("namespace"), F.lower(F.regexp_replace("s_name", "#", "")).alias("normalized"), F.lit("supplier").alias("kind"))


@query("""q AS (SELECT 'q' || CAST(s_suppkey AS STRING) AS query_id, lower(replace(s_name, '#', '')) AS normalized FROM supplier), hit AS (SELECT q.query_id, a.entity_id, bool_or(a.source = 'erp') AS exact FROM q JOIN aliases a ON a.normalized = q.normalized AND a.namespace = 'main' GROUP BY q.query_id, a.entity_id)
    --- SELECT query_id, entity_id, round(CASE WHEN exact THEN 0.85E0 ELSE 0.25E0 END + CASE WHEN i.kind = 'supplier' THEN 0.1E0 ELSE 0 END, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, entity_id) AS rank FROM hit JOIN identities i ON i.id = entity_id""")
def identity_match(m):
    return T.match_identities(alias_queries(m), m.identities, m.aliases)


@query(f"{ENTITY} --- SELECT id, trust >= 0.8 AND id LIKE 'ent:s%' AS accepted FROM (SELECT id, round(trust, 6) AS trust FROM ent) x")
def identity_accept(m):
    """Whether an alias may go to an entity: match, entity and source are all trusted (here suppliers match well)."""
    match = F.when(F.startswith("id", F.lit("ent:s")), 0.9).otherwise(0.0)
    return entity_scores(m).select("id", T.may_accept(match, F.col("score"), F.lit(0.8)).alias("accepted"))


@query("""q AS (SELECT 'q' || CAST(s_suppkey AS STRING) AS query_id, lower(replace(s_name, '#', '')) AS normalized FROM supplier), hit AS (SELECT q.query_id, a.entity_id, bool_or(a.source = 'erp') AS exact FROM q JOIN aliases a ON a.normalized = q.normalized AND a.namespace = 'main' GROUP BY q.query_id, a.entity_id)
    --- SELECT h.query_id, h.entity_id, round(greatest(0.0E0, CASE WHEN h.exact THEN 0.4E0 ELSE 0 END + CASE WHEN CASE WHEN h.exact THEN 0.85E0 ELSE 0.25E0 END + CASE WHEN i.kind = 'supplier' THEN 0.1E0 ELSE 0 END >= 0.8 THEN 0.25E0 ELSE 0 END - CASE WHEN i.id LIKE '%7' THEN 0.35E0 ELSE 0 END), 6) AS score FROM hit h JOIN identities i ON i.id = h.entity_id""")
def trust_match(m):
    """Whether to trust each match, besides how well it matches; here the entities whose id ends in 7 have a conflict."""
    exact = alias_queries(m).join(m.aliases, ["source", "namespace", "normalized"]).select("query_id", "entity_id", F.lit(True).alias("exact"))
    rows = identity_match(m).join(exact, ["query_id", "entity_id"], "left").select("query_id", "entity_id", "exact", F.col("score").alias("match_score"), F.endswith("entity_id", F.lit("7")).alias("conflict"))
    return T.match_trust(rows).select("query_id", "entity_id", "score")


ASSESSED = """sg AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY story ORDER BY epoch_us(ts)) AS gap FROM story_signals),
    cor AS (SELECT story, n_signals, round(least(1.0E0, greatest(0.0E0, CASE WHEN n_signals > n_entities THEN 0.25E0 ELSE 0 END + CASE WHEN linked THEN 0.2E0 ELSE 0 END + CASE WHEN n_signals > n_sources THEN 0.1E0 ELSE 0 END + CASE WHEN reliability >= 0.5 THEN 0.1E0 ELSE 0 END + CASE WHEN trust >= 0.5 THEN 0.15E0 ELSE 0 END + CASE WHEN cell_trust >= 0.8 THEN 0.15E0 ELSE 0 END
    + CASE WHEN gap <= 900000000 THEN 0.1E0 ELSE 0 END + CASE WHEN n_signals > n_predicates THEN 0.1E0 ELSE 0 END - CASE WHEN n_sides > 1 THEN 0.3E0 ELSE 0 END)), 6) AS score FROM (SELECT story, count(*) AS n_signals, count(DISTINCT entity) AS n_entities, count(DISTINCT source) AS n_sources, count(DISTINCT predicate) AS n_predicates, count(DISTINCT side) AS n_sides, bool_or(linked) AS linked,
    avg(reliability) AS reliability, avg(trust) AS trust, avg(cell_trust) AS cell_trust, min(gap) AS gap FROM sg GROUP BY story HAVING count(*) >= 2) x)"""
STRENGTH = "CASE WHEN score >= 0.8 THEN 'Strong' WHEN score >= 0.5 THEN 'Moderate' WHEN score >= 0.2 THEN 'Weak' ELSE 'None' END"


def signals(m):
    return m.story_signals.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def assessed(m):
    return T.correlate(T.together(signals(m), "story"), "story")


@query(f"{ASSESSED} --- SELECT story, score, {LEVEL.format(s='score')} AS level, {STRENGTH} AS strength, n_signals FROM cor")
def correlate_assess(m):
    """Whether the signals of each story belong together."""
    return assessed(m)


@query(f"""sd AS (SELECT *, epoch_us(ts) AS us FROM story_signals WHERE seq = (SELECT min(seq) FROM story_signals)), rel AS (SELECT DISTINCT s.id, s.entity = d.entity AS e, s.source = d.source AS o, s.predicate = d.predicate AS p, abs(epoch_us(s.ts) - d.us) <= 900000000 AS t, (s.reliability + d.reliability) / 2 >= 0.5 AS r, (s.trust + d.trust) / 2 >= 0.5 AS i, s.side <> d.side AS c
    FROM story_signals s JOIN sd d ON s.id <> d.id AND (s.entity = d.entity OR s.story = d.story OR (s.source = d.source AND abs(epoch_us(s.ts) - d.us) <= 900000000))),
    sc AS (SELECT id, round(least(1.0E0, greatest(0.0E0, CASE WHEN e THEN 0.25E0 ELSE 0 END + CASE WHEN o THEN 0.1E0 ELSE 0 END + CASE WHEN p THEN 0.1E0 ELSE 0 END + CASE WHEN t THEN 0.1E0 ELSE 0 END + CASE WHEN r THEN 0.1E0 ELSE 0 END + CASE WHEN i THEN 0.15E0 ELSE 0 END - CASE WHEN c THEN 0.3E0 ELSE 0 END)), 6) AS score FROM rel)
    --- SELECT id, score, {STRENGTH} AS strength, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc WHERE score >= 0.2 QUALIFY rank <= 200""")
def correlate_discover(m):
    """What relates to the first signal of all."""
    every = signals(m)
    return T.discover(every, every.join(every.agg(F.min("seq").alias("seq")), "seq", "left_semi").select("id", "entity", "story", "source", "us", "reliability", "trust", "predicate", "side"))


@query(f"{ASSESSED} --- SELECT 'cell:' || story AS cell, score FROM cor WHERE score >= 0.8")
def correlate_anchor(m):
    """Stories of high trust and strong correlation become incident cells with the same score."""
    return assessed(m).filter("level = 'High' and strength = 'Strong' and n_signals >= 2").select(F.concat(F.lit("cell:"), "story").alias("cell"), "score")


@query(f"{ACTION_STATUS} --- SELECT a.id, s.status = 'Approved' AND a.kind = 'Notify' AND k.confidence >= 0.8 AS execute, s.status = 'Proposed' AND a.kind = 'Notify' AND k.confidence >= 0.9 AS approve FROM actions a JOIN action_status s ON s.action_id = a.id JOIN claim_kinds k ON k.id = a.claim_id")
def auto_gates(m):
    """Whether an action may run, or be approved, by itself."""
    rows = actions(m).join(m.claim_kinds.select(F.col("id").alias("claim_id"), "confidence"), "claim_id")
    notify = F.col("kind") == "Notify"
    return rows.select("id", ((F.col("status") == "Approved") & notify & (F.col("confidence") >= 0.8)).alias("execute"), ((F.col("status") == "Proposed") & notify & (F.col("confidence") >= 0.9)).alias("approve"))


# --- streaming -------------------------------------------------------------------------------------------------------


def arriving(m):
    rows = keep(m.table("events"), "arriving")
    return S.event_stream(m.spark, rows.inputFiles()[0].rsplit("/", 1)[0], rows.schema)


@query("SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_rates(m):
    """Hourly counts by kind, from a stream."""
    return S.drain(S.rates(arriving(m), "1 hour", "365 days", ["event_type"]), folder(m, "rates"), "complete")


@query("SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600 AS start, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'purchase') AS n_actions, CASE WHEN count(*) >= 200 OR count(*) FILTER (WHERE event_type = 'purchase') >= 50 THEN 'critical' WHEN count(*) >= 50 OR count(*) FILTER (WHERE event_type = 'purchase') >= 10 THEN 'warning' ELSE 'normal' END AS level FROM events GROUP BY 1")
def stream_storms(m):
    rows = arriving(m).withColumn("is_action", F.col("event_type") == "purchase")
    return S.drain(S.storms(rows, "1 hour", "1 hour", "365 days"), folder(m, "storms"), "complete")


@query("""b AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) >= 86400000000 OR lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM b)
    --- SELECT user_id, min(us) AS start, count(*) AS n FROM s GROUP BY user_id, nth""")
def stream_sessions(m):
    return S.drain(S.user_sessions(arriving(m), "user_id", "1 day", "365 days"), folder(m, "sessions"), "complete")


@query("SELECT event_id FROM events")
def stream_dedup(m):
    """Events that arrive twice are taken once."""
    rows = keep(m.table("events"), "twice")
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    rows.write.mode("append").parquet(path)
    return S.drain(S.once(S.event_stream(m.spark, path, rows.schema), "event_id", "365 days"), folder(m, "once")).select("event_id")


@query("""cnt AS (SELECT event_type AS key, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) * 86400 AS start, count(*) * 60.0E0 / 86400 AS r FROM events GROUP BY 1, 2), num AS (SELECT key, start, r, row_number() OVER (PARTITION BY key ORDER BY start) AS k FROM cnt),
    st AS (SELECT key, start, r, k, 0.0E0 AS expected, 0.0E0 AS z, r AS mean, 0.0E0 AS var FROM num WHERE k = 1 UNION ALL SELECT n.key, n.start, n.r, n.k, s.mean, CASE WHEN n.k <= 5 THEN 0.0E0 ELSE (n.r - s.mean) / sqrt(greatest(s.var, 1.0E0)) END, s.mean + 0.2E0 * (n.r - s.mean), 0.8E0 * (s.var + 0.2E0 * (n.r - s.mean) * (n.r - s.mean)) FROM st s JOIN num n ON n.k = s.k + 1 AND n.key = s.key)
    --- SELECT key, start, round(expected, 6) AS expected, round(z, 6) AS z, CASE WHEN k <= 5 OR expected <= 5 THEN 'normal' WHEN abs(z) >= 5 THEN 'critical' WHEN abs(z) >= 3 THEN 'warning' ELSE 'normal' END AS level FROM st""")
def stream_rate_verdicts(m):
    """Running verdicts on daily rates by kind, the mean and variance kept as state."""
    day = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000) * 86_400).cast("long")
    counts = keep(m.table("events").groupBy("event_type", day.alias("start")).agg(row_count().alias("n")), "daily")
    stream = m.spark.readStream.schema(counts.schema).parquet(counts.inputFiles()[0].rsplit("/", 1)[0])
    rows = S.drain(S.rate_verdicts(stream, 86400, "event_type"), folder(m, "verdicts"))
    return rows.select("key", "start", F.round("expected", 6).alias("expected"), F.round("z", 6).alias("z"), "level")


@query("SELECT sequence FROM batches WHERE sequence > 3")
def src_commit_stream(m):
    """The commits after a sequence, from a stream over the log's folder."""
    path = folder(m, "tail")
    rows = m.batches.select("sequence", F.lit("").alias("previous_hash"), F.lit("").alias("commit_hash"), "idempotency_key", "n_events", "committed_at")
    C.append_commits(rows, path)
    return S.drain(S.commit_tail(m.spark, path, C.COMMIT, 3).select("sequence"), folder(m, "tailed"))


@query("SELECT CAST(floor(value) AS BIGINT) % 101 / 100.0E0 AS reliability, CASE WHEN CAST(floor(value) AS BIGINT) % 101 / 100.0E0 >= 0.8 THEN 'High' WHEN CAST(floor(value) AS BIGINT) % 101 / 100.0E0 >= 0.5 THEN 'Medium' WHEN CAST(floor(value) AS BIGINT) % 101 / 100.0E0 >= 0.2 THEN 'Low' ELSE 'Unknown' END AS level FROM events WHERE event_type = 'error'")
def level_ladder(m):
    from ..functions import level_for_score

    return m.evidence.select("reliability", level_for_score(F.col("reliability")).alias("level"))
