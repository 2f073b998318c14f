"""Explainable additive scores: each factor is a condition with a weight; what applies adds up, clamped to 0..1.

All factors are in the result, applied or not. The weights are a policy table and may be replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clamp, level_for_score

# Factor weights. Where only some of a question's weights are known publicly, the others are this
# library's own choice: source.* but its first two, entity.* but its first three, and candidate.*.
WEIGHTS = {
    "claim": {"verified": 0.20, "supported": 0.10, "confident": 0.10, "has_evidence": 0.10, "reliable_evidence": 0.10, "operator_approved": 0.15, "action_executed": 0.15, "outcome": 0.10, "model_observation": 0.10, "reflex_history": 0.10, "proven": 0.15, "human_approved": 0.10, "contradicted": -0.20, "disputed": -0.30, "retracted": -1.0},
    "link": {"confident": 0.25, "fairly_confident": 0.10, "doubtful": -0.20, "from_high": 0.15, "from_low": -0.15, "to_high": 0.15, "to_low": -0.15, "referenced": 0.15, "unreferenced": -0.05, "built_in": 0.10, "custom": -0.05},
    "cell": {"children": 0.10, "known_scores": 0.10, "avg_high": 0.20, "all_high": 0.15, "outcomes": 0.10, "observations": 0.10, "executed": 0.10, "any_low": -0.20, "failed": -0.20, "rejected": -0.15, "contradicted": -0.20, "missing": -0.10},
    "entity": {"confident": 0.30, "many_aliases": 0.10, "one_alias": -0.10, "keyed": 0.20, "named": 0.10, "confidence_low": -0.30, "no_alias": -0.20, "many_sources": 0.10, "alias_matches_key": 0.10, "in_tenant": 0.05, "linked": 0.10, "conflict": -0.25},
    "source": {"has_entities": 0.20, "doubtful_entities": -0.20, "trusted_entities": 0.20, "many_entities": 0.20, "one_entity": -0.10, "keyed_entities": 0.10, "many_namespaces": 0.10, "unknown_entities": -0.10, "conflicts": -0.20},
    "candidate": {"exact_alias": 0.85, "same_kind": 0.10, "token_overlap": 0.25},
    "match": {"exact_alias": 0.40, "strong_match": 0.25, "conflict": -0.35},
    "correlation": {"same_entity": 0.25, "trusted_link": 0.20, "same_source": 0.10, "source_trust": 0.10, "entity_trust": 0.15, "cell_trust": 0.15, "close_in_time": 0.10, "semantic": 0.0, "predicate": 0.10, "contradiction": -0.30, "operator": 0.0},
}
CLOSE_SECONDS = 900


def factors(question: str, conditions: dict[str, Column], detail: Column | None = None) -> Column:
    """ARRAY<STRUCT<kind, weight, applied, detail>> of a question's factors."""
    weights = WEIGHTS[question]
    missing = F.lit("") if detail is None else detail
    return F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(weights[k]).alias("weight"), F.coalesce(c, F.lit(False)).alias("applied"), missing.alias("detail")) for k, c in conditions.items()))


def total(applied: Column, base: Column | None = None, ceiling: float = 1.0) -> Column:
    start = F.lit(0.0) if base is None else base
    return F.round(clamp(F.aggregate(F.filter(applied, lambda f: f["applied"]), start, lambda a, f: a + f["weight"]), 0.0, ceiling), 6)


def scored(rows: DataFrame, key: str, question: str, conditions: dict[str, Column], base: Column | None = None, ceiling: float = 1.0) -> DataFrame:
    """key, score, level, n_factors (those that apply) and factors."""
    rows = rows.withColumn("factors", factors(question, conditions)).withColumn("score", total(F.col("factors"), base, ceiling))
    return rows.select(key, "score", level_for_score(F.col("score")).alias("level"), F.size(F.filter("factors", lambda f: f["applied"])).cast("long").alias("n_factors"), "factors")


PROVEN = 3  # observations that make a model proven


def claim_trust(claims: DataFrame) -> DataFrame:
    """claims: id, status, confidence, n_for, n_reliable, n_against, executed, approved, outcome, n_observed (of the
    model behind it), human_approved."""
    s = F.col("status")
    conditions = {"verified": s == "Verified", "supported": s == "Supported", "confident": F.col("confidence") >= 0.8, "has_evidence": F.col("n_for") > 0, "reliable_evidence": F.col("n_reliable") > 0}
    conditions |= {"operator_approved": F.col("approved"), "action_executed": F.col("executed"), "outcome": F.col("outcome"), "model_observation": F.col("n_observed") > 0, "reflex_history": F.col("n_observed") > 1, "proven": F.col("n_observed") >= PROVEN, "human_approved": F.col("human_approved")}
    return scored(claims, "id", "claim", conditions | {"contradicted": F.col("n_against") > 0, "disputed": s == "Disputed", "retracted": s == "Retracted"})


def link_trust(links: DataFrame, entities: DataFrame) -> DataFrame:
    """links: id, kind, from_id, to_id, confidence, n_refs; entities: id, trust."""
    ends = links
    for end in ("from", "to"):
        ends = ends.join(entities.select(F.col("id").alias(f"{end}_id"), F.col("trust").alias(f"{end}_trust")), f"{end}_id", "left")
    c = F.col("confidence")
    conditions = {"confident": c >= 0.8, "fairly_confident": (c >= 0.5) & (c < 0.8), "doubtful": c < 0.5}
    for end in ("from", "to"):
        conditions |= {f"{end}_high": F.col(f"{end}_trust") >= 0.8, f"{end}_low": F.col(f"{end}_trust") <= 0.4}
    conditions |= {"referenced": F.col("n_refs") > 0, "unreferenced": F.col("n_refs") == 0, "built_in": F.col("kind") != "Custom", "custom": F.col("kind") == "Custom"}
    return scored(ends, "id", "link", conditions)


def cell_trust(children: DataFrame, facts: DataFrame) -> DataFrame:
    """children: cell, trust (null: unknown) of each child; facts: cell and whether it has outcomes, observations,
    executed, failed, rejected, contradicted."""
    rows = children.groupBy("cell").agg(F.avg("trust").alias("mean"), F.min("trust").alias("least"), F.count(F.lit(1)).alias("n"), F.count("trust").alias("known")).join(facts, "cell", "left")
    own = {k: F.col(k) for k in ("outcomes", "observations", "executed", "failed", "rejected", "contradicted")}
    conditions = {"children": F.col("n") > 0, "known_scores": F.col("known") > 0, "avg_high": F.col("mean") >= 0.8, "all_high": (F.col("least") >= 0.8) & (F.col("known") == F.col("n")), "any_low": F.col("least") < 0.5, "missing": F.col("known") < F.col("n")}
    return scored(rows, "cell", "cell", conditions | own, F.coalesce("mean", F.lit(0.0)))


def conflicting(aliases: DataFrame) -> DataFrame:
    """source, namespace, normalized of aliases that more than one entity has."""
    return aliases.groupBy("source", "namespace", "normalized").agg(F.countDistinct("entity_id").alias("n")).filter("n > 1").drop("n")


def entity_trust(entities: DataFrame, aliases: DataFrame, links: DataFrame) -> DataFrame:
    """entities: id, canonical_key, confidence, tenant_id; aliases: entity_id, source, namespace, normalized; links:
    from_id, to_id. At most 0.85."""
    keys = ["source", "namespace", "normalized"]
    marked = aliases.join(conflicting(aliases).withColumn("bad", F.lit(True)), keys, "left").withColumnRenamed("entity_id", "id").join(entities.select("id", "canonical_key"), "id")
    n = marked.groupBy("id").agg(F.count(F.lit(1)).alias("n_aliases"), F.countDistinct("source").alias("n_sources"), F.bool_or(F.col("normalized") == F.col("canonical_key")).alias("matches"), F.bool_or(F.coalesce("bad", F.lit(False))).alias("bad"))
    ends = links.select(F.col("from_id").alias("id")).unionByName(links.select(F.col("to_id").alias("id"))).distinct().withColumn("linked", F.lit(True))
    rows = entities.join(n, "id", "left").join(ends, "id", "left").fillna(0, ["n_aliases", "n_sources"])
    c = F.col("confidence")
    conditions = {"confident": c >= 0.8, "many_aliases": F.col("n_aliases") > 1, "one_alias": F.col("n_aliases") == 1, "keyed": F.length("canonical_key") > 0, "named": F.col("canonical_key").rlike("[a-z]"), "confidence_low": c < 0.2, "no_alias": F.col("n_aliases") == 0}
    conditions |= {"many_sources": F.col("n_sources") > 1, "alias_matches_key": F.col("matches"), "in_tenant": F.col("tenant_id").isNotNull(), "linked": F.col("linked"), "conflict": F.col("bad")}
    return scored(rows, "id", "entity", conditions, ceiling=0.85)


def source_trust(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """source and the score of the identities it gives (entities: id, trust or null, canonical_key). At most 0.80."""
    conflicts = conflicting(aliases).select("source").distinct().withColumn("bad", F.lit(True))
    rows = aliases.withColumnRenamed("entity_id", "id").join(entities.select("id", "trust", "canonical_key"), "id", "left").groupBy("source").agg(F.avg("trust").alias("mean"), F.countDistinct("id").alias("n"), F.countDistinct("namespace").alias("spaces"), F.count_if(F.col("canonical_key").isNull()).alias("unknown"), F.count_if(F.col("normalized") == F.col("canonical_key")).alias("keyed"))
    rows = rows.join(conflicts, "source", "left")
    n = F.col("n")
    return scored(rows, "source", "source", {"has_entities": n > 0, "doubtful_entities": F.col("mean") <= 0.4, "trusted_entities": F.col("mean") >= 0.7, "many_entities": n >= 10, "one_entity": n == 1, "keyed_entities": F.col("keyed") > 0, "many_namespaces": F.col("spaces") > 1, "unknown_entities": F.col("unknown") > 0, "conflicts": F.col("bad")}, ceiling=0.8)


def match_trust(matches: DataFrame) -> DataFrame:
    """query_id, entity_id, score, level: whether to trust a match (query_id, entity_id, exact, match_score, conflict),
    besides how well it matches."""
    rows = matches.withColumn("pair", F.struct("query_id", "entity_id"))
    out = scored(rows, "pair", "match", {"exact_alias": F.col("exact"), "strong_match": F.col("match_score") >= 0.8, "conflict": F.col("conflict")})
    return out.select("pair.query_id", "pair.entity_id", "score", "level")


def match_identities(queries: DataFrame, entities: DataFrame, aliases: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, entity_id, score, rank: entities for an alias (query_id, source, namespace, normalized, kind).

    Candidates come from equi-joins on the exact alias and on its tokens, never from all pairs. Of the entities that share
    a token and a kind, only the ``limit`` least ids can be among a query's first ``limit``: each of them scores as much as
    a later one, or more, and comes before it. So a common token costs no more than a rare one, and nothing is lost."""
    from pyspark.sql import Window

    exact = queries.join(aliases, ["source", "namespace", "normalized"]).select("query_id", "entity_id", F.lit(True).alias("exact"), F.lit(False).alias("token"))
    tokens = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(F.filter(F.split("normalized", "[^a-z0-9]+"), lambda t: F.length(t) > 0))).alias("token"))
    kinds = entities.select(F.col("id").alias("entity_id"), "kind")
    nth = F.row_number().over(Window.partitionBy("token", "kind").orderBy("entity_id"))
    least = tokens(aliases, "entity_id").distinct().join(kinds, "entity_id").withColumn("nth", nth).filter(F.col("nth") <= limit)
    shared = tokens(queries, "query_id").join(least, "token").select("query_id", "entity_id", F.lit(False).alias("exact"), F.lit(True).alias("token"))
    found = exact.unionByName(shared).groupBy("query_id", "entity_id").agg(F.bool_or("exact").alias("exact"), F.bool_or("token").alias("token"))
    found = found.join(queries.select("query_id", F.col("kind").alias("q_kind")), "query_id").join(kinds, "entity_id")
    found = found.withColumn("factors", factors("candidate", {"exact_alias": F.col("exact"), "same_kind": F.col("q_kind") == F.col("kind"), "token_overlap": F.col("token") & ~F.col("exact")})).withColumn("score", total(F.col("factors"))).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= limit).select("query_id", "entity_id", "score", "rank")


# The floors of a correlation's strengths.
STRENGTHS = {"Strong": 0.80, "Moderate": 0.50, "Weak": 0.20}


def correlate(stories: DataFrame, key: str) -> DataFrame:
    """key, score, level, strength, n_signals of sets of signals, or pairs, with the conditions of
    WEIGHTS['correlation'] as boolean columns (those that a table lacks don't apply); a single signal is no story."""
    have = {k: F.col(k) if k in stories.columns else F.lit(False) for k in WEIGHTS["correlation"]}
    rows = stories.filter("n_signals >= 2").withColumn("story", F.struct(key, "n_signals"))
    out = scored(rows, "story", "correlation", have)
    strength = F.coalesce(*(F.when(F.col("score") >= x, s) for s, x in STRENGTHS.items()), F.lit("None"))
    return out.select(F.col("story").getField(key).alias(key), "score", "level", strength.alias("strength"), "story.n_signals")


def together(signals: DataFrame, by: str) -> DataFrame:
    """The conditions of ``correlate`` for the signals of each set (by, entity, source, us, reliability, trust, cell_trust,
    predicate, side): whether any two of them agree. Two signals are close in time if two neighbours in time are, so no
    pair is made."""
    from pyspark.sql import Window

    gap = F.col("us") - F.lag("us").over(Window.partitionBy(by).orderBy("us"))
    n, several = F.count(F.lit(1)), lambda c: F.count(c) > F.countDistinct(c)
    return signals.withColumn("gap", gap).groupBy(by).agg(
        n.alias("n_signals"), several("entity").alias("same_entity"), several("source").alias("same_source"), several("predicate").alias("predicate"), (F.avg("reliability") >= 0.5).alias("source_trust"), (F.avg("trust") >= 0.5).alias("entity_trust"), (F.avg("cell_trust") >= 0.8).alias("cell_trust"),
        F.coalesce(F.min("gap") <= CLOSE_SECONDS * 1_000_000, F.lit(False)).alias("close_in_time"), (F.countDistinct("side") > 1).alias("contradiction"), F.bool_or("linked").alias("trusted_link"))


def discover(signals: DataFrame, seed: DataFrame, limit: int = 200) -> DataFrame:
    """pair, score, rank of what relates to a seed signal (one row): signals of its entity, its set or, close in time, its
    source; each is paired with the seed, and pairs of 0.20 or more are kept, best first, ties by id."""
    from pyspark.sql import Window

    s = seed.select(*(F.col(c).alias(f"seed_{c}") for c in seed.columns))
    reach = lambda *keys: signals.join(F.broadcast(s), [F.col(k) == F.col(f"seed_{k}") for k in keys])
    near = F.abs(F.col("us") - F.col("seed_us")) <= CLOSE_SECONDS * 1_000_000
    rows = reach("entity").unionByName(reach("story")).unionByName(reach("source").filter(near)).filter("id != seed_id").dropDuplicates(["id"])
    same = lambda c: F.col(c) == F.col(f"seed_{c}")
    rows = rows.select("id", F.lit(2).alias("n_signals"), same("entity").alias("same_entity"), same("source").alias("same_source"), same("predicate").alias("predicate"), near.alias("close_in_time"), ((F.col("reliability") + F.col("seed_reliability")) / 2 >= 0.5).alias("source_trust"), ((F.col("trust") + F.col("seed_trust")) / 2 >= 0.5).alias("entity_trust"), (~same("side")).alias("contradiction"))
    out = correlate(rows, "id").filter("score >= 0.2")
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # over the best ``limit`` rows only
    return out.orderBy(F.desc("score"), "id").limit(limit).withColumn("rank", rank.cast("long")).select("id", "score", "strength", "rank")


def may_accept(match: Column, entity: Column, source: Column) -> Column:
    """Whether an alias may be attached: all three scores are High."""
    return reduce(lambda a, b: a & b, [x >= 0.8 for x in (match, entity, source)])
