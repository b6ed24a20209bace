"""Forgetting, and pages that a change concerns, on the smallest tables and by hand."""

import pytest
from pyspark.sql import functions as F

from factloom.functions.checkpoint import cut
from factloom.operators import forget, knowledge
from factloom.plans import registry
from factloom.plans.views import Views

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return registry.views(spark, SMALL)


def test_no_table_and_no_view_holds_a_forgotten_document(spark, views):
    asked = spark.createDataFrame([("H1",), ("O3",)], "doc_id string")
    owned = cut(forget.manifest(views.spine, asked))
    kinds = {r["kind"]: r["count"] for r in owned.groupBy("kind").count().collect()}
    assert kinds["document"] == 2 and kinds["observation"] > 0 and kinds["entity"] == 1  # the user of H1 is in no other text
    after = forget.Scrubbed(views.spine, owned)
    left = {r["table_name"]: r for r in forget.remains(after, owned).collect()}
    assert set(left) == set(forget.OWNED) and all(r["remaining"] == 0 for r in left.values())
    before = {r["table_name"]: r for r in forget.remains(views.spine, owned).collect()}
    assert all(left[t]["kept"] + before[t]["remaining"] == before[t]["kept"] for t in left)
    shown = Views(after)
    ids = [r["id"] for r in owned.collect()]
    for name in ("documents_live", "chunks_live", "claims_live", "mentions_live", "entities_current", "facts_current", "fact_claim_evidence_live", "page_evidence_visible"):
        rows = getattr(shown, name)
        texts = [c for c, t in rows.dtypes if t == "string"]
        hit = F.coalesce(*(F.when(F.col(c).isin(ids), F.lit(True)) for c in texts)).isNotNull()
        assert rows.where(hit).count() == 0, name
    whole = views.documents_live.where(~F.col("doc_id").isin("H1", "O3"))
    assert shown.documents_live.exceptAll(whole).count() == 0 and whole.exceptAll(shown.documents_live).count() == 0


def test_facts_with_other_evidence_stay(spark):
    tables = {
        "documents": [("a",), ("b",)], "document_versions": [], "chunks": [], "claims": [], "mentions": [("m1", "a"), ("m2", "b"), ("m3", "a")],
        "relations": [("r1", "x", "y"), ("r2", "y", "z")], "relation_evidence": [("r1", "a"), ("r1", "b"), ("r2", "a")], "observations": [("o1", "w")], "observation_evidence": [("o1", "b")], "resolution_decisions": [("m1", "x"), ("m2", "x"), ("m3", "w"), ("m3", "z")],
    }
    schemas = {
        "documents": "doc_id string", "document_versions": "version_id string, doc_id string", "chunks": "chunk_id string, doc_id string", "claims": "claim_id string, doc_id string", "mentions": "mention_id string, doc_id string", "relations": "relation_id string, subject_entity_id string, object_entity_id string",
        "relation_evidence": "relation_id string, doc_id string", "observations": "observation_id string, subject_entity_id string", "observation_evidence": "observation_id string, doc_id string", "resolution_decisions": "mention_id string, entity_id string",
    }
    frames = {k: spark.createDataFrame(tables[k], schemas[k]) for k in schemas}
    got = sorted(map(tuple, forget.manifest(frames, spark.createDataFrame([("a",)], "doc_id string")).collect()))
    # r2 goes, and z with it; x is mentioned elsewhere, w has an observation that stays
    assert got == [("document", "a"), ("entity", "z"), ("mention", "m1"), ("mention", "m3"), ("relation", "r2")]


def rules(spark):
    row = lambda i, page, kind, e=None, o=None, p=(), c=None, s=None, ids=(): (f"r{i}", page, kind, e, o, list(p), c, s, list(ids))
    return spark.createDataFrame(
        [row(1, "one", "entity", "a", p=["likes"]), row(2, "two", "entity_subtree", "top"), row(3, "three", "predicate_beat", "a", "b", ["owns"]), row(4, "four", "community", c="c1"), row(5, "five", "doc_set", s="mail"), row(6, "six", "manual", ids=["q7"]), row(7, "seven", "scope_interests")],
        knowledge.RULE,
    )


RELATION = "relation_id string, subject_entity_id string, predicate string, object_entity_id string, valid_from string, valid_until string, invalidated_at string, evidence_count int, contradict_count int, contradiction_group string"


def relation(i, s, p, o, until=None, gone=None, n=1):
    return (i, s, p, o, None, until, gone, n, 0, None)


RELATIONS = [relation("p1", "mid", "part_of", "top"), relation("p2", "leaf", "part_of", "mid"), relation("p3", "old", "part_of", "top", until="2000"), relation("p4", "top", "part_of", "leaf"), relation("l1", "a", "likes", "x"), relation("l2", "a", "owns", "b"), relation("l3", "x", "likes", "leaf"), relation("l4", "a", "owns", "x")]


def test_keys_of_rules_reach_down_a_tree_with_a_cycle(spark):
    communities = spark.createDataFrame([("c1", "m"), ("c2", "n")], "community_id string, entity_id string")
    got = {(r["artifact_id"], r["key_kind"], r["key_value"]) for r in knowledge.rule_keys(rules(spark), spark.createDataFrame(RELATIONS, RELATION), communities).collect()}
    assert got == {
        ("one", "entity", "a"), ("one", "predicate", "likes"), ("two", "entity", "top"), ("two", "entity", "mid"), ("two", "entity", "leaf"), ("three", "entity", "a"), ("three", "entity", "b"), ("three", "predicate", "owns"),
        ("four", "community", "c1"), ("four", "entity", "m"), ("five", "doc_source", "mail"),
    }


@pytest.mark.parametrize("changed, pages", [("l1", {"one"}), ("l2", {"three"}), ("l3", {"two"}), ("l4", set()), ("p2", {"two"})])
def test_a_changed_relation_makes_its_pages_stale(spark, changed, pages):
    relations = spark.createDataFrame(RELATIONS, RELATION)
    later = spark.createDataFrame([(*r[:7], 5, *r[8:]) if r[0] == changed else r for r in reversed(RELATIONS)], RELATION)
    keys = cut(knowledge.rule_keys(rules(spark), relations, spark.createDataFrame([], "community_id string, entity_id string")))
    selected = cut(knowledge.page_facts(rules(spark), keys, relations))
    was, now = (knowledge.inputs_hash(selected, r, rules(spark)) for r in (relations, later))
    assert {r["artifact_id"] for r in knowledge.stale(was, now).collect()} == pages


def test_routes(spark):
    change = spark.createDataFrame([("relation", "l3"), ("observation", "q7"), ("doc", "d1")], "kind string, id string")
    keys = knowledge.rule_keys(rules(spark), spark.createDataFrame(RELATIONS, RELATION), spark.createDataFrame([], "community_id string, entity_id string"))
    carried = spark.createDataFrame([("entity", "leaf"), ("doc_source", "mail")], "key_kind string, key_value string")
    cited = spark.createDataFrame([("nine", "doc", "d1"), ("ten", "doc", "d2")], "artifact_id string, kind string, id string")
    got = {tuple(r) for r in knowledge.route(keys, rules(spark), cited, change, carried).collect()}
    assert got == {("two", "key"), ("five", "key"), ("nine", "citation"), ("seven", "scope"), ("six", "manual")}
