"""Which pages a change concerns: rules as keys of an inverted index, routing of a change by them, and staleness by hash.

Routing is coarse on purpose: it names pages that may be concerned, by any key that a rule shares with the change. What
is stale is decided by the hash of a page's inputs against the one that was recorded when it was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.checkpoint import cut

#: Rules: (rule_id, artifact_id, kind, entity_id, object_entity_id, predicates, community_id, source_kind, evidence_ids).
RULE = "rule_id string, artifact_id string, kind string, entity_id string, object_entity_id string, predicates array<string>, community_id string, source_kind string, evidence_ids array<string>"


def subtree(roots: DataFrame, relations: DataFrame) -> DataFrame:
    """(root, entity_id): each root of roots (root) and what is part of it, at any depth, by open believed relations."""
    parts = relations.where("predicate = 'part_of' AND invalidated_at IS NULL AND valid_until IS NULL").select(F.col("subject_entity_id").alias("part"), F.col("object_entity_id").alias("entity_id"))
    frontier = cut(roots.select("root", F.col("root").alias("entity_id")).distinct())
    found = frontier
    while frontier.limit(1).count():  # a round for each level
        frontier = cut(frontier.join(parts, "entity_id").select("root", F.col("part").alias("entity_id")).distinct().join(found, ["root", "entity_id"], "left_anti"))
        found = found.unionByName(frontier)
    return found


def rule_keys(rules: DataFrame, relations: DataFrame, communities: DataFrame) -> DataFrame:
    """(rule_id, artifact_id, key_kind, key_value): entity, predicate, community and doc_source keys of each rule.
    communities: (community_id, entity_id). Rules of kind scope_interests and manual have no keys."""
    own = ["rule_id", "artifact_id"]
    one = lambda kind, column, value: rules.where(F.col("kind").isin(*kind)).select(*own, F.lit(column).alias("key_kind"), value.alias("key_value"))
    below = rules.where("kind = 'entity_subtree'")
    members = below.join(subtree(below.select(F.col("entity_id").alias("root")), relations).withColumnRenamed("entity_id", "member"), F.col("entity_id") == F.col("root"))
    grouped = rules.where("kind = 'community'").join(communities.select(F.col("community_id").alias("c"), F.col("entity_id").alias("member")), F.col("community_id") == F.col("c"))
    parts = [
        one(("entity", "predicate_beat"), "entity", F.col("entity_id")), one(("predicate_beat",), "entity", F.col("object_entity_id")), one(("entity", "entity_subtree", "predicate_beat"), "predicate", F.explode("predicates")),
        one(("community",), "community", F.col("community_id")), one(("doc_set",), "doc_source", F.col("source_kind")),
        *(t.select(*own, F.lit("entity").alias("key_kind"), F.col("member").alias("key_value")) for t in (members, grouped)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("key_value IS NOT NULL").distinct()


def change_keys(change: DataFrame, relations: DataFrame, observations: DataFrame, claims: DataFrame, mentions: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(key_kind, key_value) that a change (kind, id) carries; kinds are relation, observation, claim, doc and community.
    evidence: (kind, id, doc_id); mentions: (claim_id, entity_id)."""
    ids = lambda kind, name: change.where(F.col("kind") == kind).select(F.col("id").alias(name))
    moved = relations.join(ids("relation", "relation_id"), "relation_id")
    docs = change.join(evidence, ["kind", "id"]).select("doc_id").union(claims.join(ids("claim", "claim_id"), "claim_id").select("doc_id")).union(ids("doc", "doc_id"))
    key = lambda kind, rows, value: rows.select(F.lit(kind).alias("key_kind"), value.alias("key_value"))
    parts = [
        key("entity", moved, F.explode(F.array("subject_entity_id", "object_entity_id"))), key("predicate", moved, F.col("predicate")), key("entity", observations.join(ids("observation", "observation_id"), "observation_id"), F.col("subject_entity_id")),
        key("entity", mentions.join(ids("claim", "claim_id"), "claim_id"), F.col("entity_id")), key("doc_source", documents.join(docs.distinct(), "doc_id"), F.col("source_kind")), key("community", ids("community", "c"), F.col("c")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("key_value IS NOT NULL").distinct()


def route(keys: DataFrame, rules: DataFrame, citations: DataFrame, change: DataFrame, carried: DataFrame) -> DataFrame:
    """(artifact_id, reason) of pages that a change may concern: key, citation, scope or manual.
    citations: (artifact_id, kind, id); carried: the change's keys."""
    by = lambda rows, reason: rows.select("artifact_id", F.lit(reason).alias("reason"))
    manual = rules.where("kind = 'manual'").select("artifact_id", F.explode("evidence_ids").alias("id")).join(change.select("id"), "id", "left_semi")
    parts = by(keys.join(carried, ["key_kind", "key_value"], "left_semi"), "key").unionByName(by(citations.join(change, ["kind", "id"], "left_semi"), "citation"))
    return parts.unionByName(by(rules.where("kind = 'scope_interests'"), "scope")).unionByName(by(manual, "manual")).distinct()


def page_facts(rules: DataFrame, keys: DataFrame, relations: DataFrame) -> DataFrame:
    """(artifact_id, relation_id) of the relations that a page's rules select: an entity's or a subtree's, of its predicates
    where there are any, and those of a beat. A relation reaches a rule by its subject or its object."""
    named = F.col("kind").isin("entity", "entity_subtree")
    asked = keys.where("key_kind = 'entity'").select("rule_id", F.col("key_value").alias("e")).join(rules.where(named).select("rule_id", "artifact_id", "predicates"), "rule_id")
    ends = relations.select("relation_id", "predicate", F.explode(F.array_distinct(F.array("subject_entity_id", "object_entity_id"))).alias("e"))
    free = F.coalesce(F.size("predicates"), F.lit(0)) <= 0
    mine = ends.join(asked, "e").where(free | F.array_contains("predicates", F.col("predicate"))).select("artifact_id", "relation_id")
    beats = rules.where("kind = 'predicate_beat'").select("artifact_id", F.explode("predicates").alias("predicate"), F.col("entity_id").alias("s"), F.col("object_entity_id").alias("o"))
    followed = relations.join(beats, "predicate").where("(s IS NULL OR s = subject_entity_id) AND (o IS NULL OR o = object_entity_id)").select("artifact_id", "relation_id")
    return mine.union(followed).distinct()


def fingerprint(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def inputs_hash(selected: DataFrame, relations: DataFrame, rules: DataFrame) -> DataFrame:
    """(artifact_id, inputs_hash) of each page with a rule: its rules and the states of its relations, whatever their order.

    Fingerprints are summed as a set, in parts, so that no page's facts are gathered in a row.
    """
    state = relations.select("relation_id", fingerprint("relation_id", "valid_from", "valid_until", "invalidated_at", "evidence_count", "contradict_count", "contradiction_group").alias("f"))
    told = selected.join(state, "relation_id").select("artifact_id", "f")
    ruled = rules.select("artifact_id", fingerprint("kind", "entity_id", "object_entity_id", "predicates", "community_id", "source_kind", "evidence_ids").alias("f"))
    each = told.union(ruled).distinct()
    sums = [F.sum(F.xxhash64(F.lit(k), "f").cast("decimal(38,0)")).cast("string") for k in range(4)]
    return each.groupBy("artifact_id").agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256).alias("inputs_hash"))


def stale(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(artifact_id): pages whose recorded hash differs from the current one, or that have only one of them."""
    both = recorded.select("artifact_id", F.col("inputs_hash").alias("was")).join(current.select("artifact_id", F.col("inputs_hash").alias("now")), "artifact_id", "full")
    return both.where("NOT (was <=> now)").select("artifact_id")
