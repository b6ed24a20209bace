"""Merges and merges taken back, on small registries."""

import datetime as dt
import random

from pyspark.sql import functions as F

from factloom.functions.checkpoint import cut
from factloom.operators import merges

AT, LATER = dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 1)
ENTITY = "entity_id string, status string, merged_into string, updated_at timestamp_ntz"
DECISION = "decision_id string, mention_id string, entity_id string, method string, confidence double, is_new_entity boolean, decided_by string, decided_at timestamp_ntz, superseded_by string"
EVENT = "merge_id string, survivor_id string, absorbed_id string, blast_radius long, decided_by string, decided_at timestamp_ntz, reversed_by string, unmerge_of string"


def registry(spark):
    entities = spark.createDataFrame([(e, "active", None, AT) for e in "abcd"] + [("z", "merged", "a", AT)], ENTITY)
    decided = [(f"d{m}", f"m{m}", e, "T0", 1.0, False, "resolver", AT, None) for m, e in enumerate("aabbcdd")]
    decided += [("old", "m0", "c", "T0", 1.0, False, "resolver", AT, "d0")]
    return entities, spark.createDataFrame(decided, DECISION)


def live(decisions):
    return {r["mention_id"]: r["entity_id"] for r in merges.live_decisions(decisions).collect()}


def test_proposals_and_their_route(spark):
    rows = [("p", "b", 2, 40), ("p", "a", 2, 30), ("p", "c", 3, 31), ("q", "d", 1, 5), ("q", "e", 1, 4), ("r", "f", 1, 900)]
    got = sorted(map(tuple, merges.proposals(spark.createDataFrame(rows, "piece string, entity_id string, first_seen int, weight int")).collect()))
    assert got == [("a", "b", 101, "review"), ("a", "c", 101, "review"), ("d", "e", 9, "merge")]


def test_unmerge_restores_decisions(spark):
    entities, decisions = registry(spark)
    proposed = spark.createDataFrame([("a", "b", 4), ("a", "z", 1), ("d", "d", 1), ("c", "b", 9)], "survivor_id string, absorbed_id string, blast_radius long")
    merged, events, snapshot = (cut(t) for t in merges.merge(entities, decisions, proposed, F.lit(AT)))
    assert sorted(map(tuple, events.select("survivor_id", "absorbed_id").collect())) == [("a", "b")]  # z is merged already, d is itself, b goes once
    assert {r["entity_id"]: (r["status"], r["merged_into"]) for r in merged.collect()}["b"] == ("merged", "a")
    assert sorted((r["entity_id"], r["mention_id"]) for r in snapshot.collect()) == [("a", "m0"), ("a", "m1"), ("b", "m2"), ("b", "m3")]
    # meanwhile a mention of b is decided anew for a, and one of a for c
    moved = spark.createDataFrame([("n2", "m2", "a", "T3", 0.9, False, "resolver", AT, None), ("n1", "m1", "c", "T3", 0.9, False, "resolver", AT, None)], DECISION)
    after = cut(decisions.withColumn("superseded_by", F.when(F.col("decision_id") == "d2", "n2").when(F.col("decision_id") == "d1", "n1").otherwise(F.col("superseded_by"))).unionByName(moved))
    ids = events.select("merge_id").union(spark.createDataFrame([("unknown",)], "merge_id string"))
    back, log, decided = (cut(t) for t in merges.unmerge(merged, events, snapshot, after, ids, F.lit(LATER)))
    assert {r["entity_id"]: (r["status"], r["merged_into"]) for r in back.collect()} == {**{e: ("active", None) for e in "abcd"}, "z": ("merged", "a")}
    assert live(decided) == {**live(decisions), "m1": "c"}  # what b had is b's again, what a lost meanwhile isn't touched
    rows = {r["merge_id"]: r for r in log.collect()}
    first = next(r for r in rows.values() if r["unmerge_of"] is None)
    assert len(rows) == 2 and rows[first["reversed_by"]]["unmerge_of"] == first["merge_id"] and rows[first["reversed_by"]]["survivor_id"] == "b"
    again = merges.unmerge(back, log, snapshot, decided, ids, F.lit(LATER))
    assert again[1].count() == 2 and again[2].count() == decided.count()


def test_any_merges_taken_back_leave_the_decisions_before(spark):
    rng = random.Random(2)
    names = [f"e{i}" for i in range(40)]
    entities = spark.createDataFrame([(e, "active", None, AT) for e in names], ENTITY)
    decisions = spark.createDataFrame([(f"d{m}", f"m{m}", rng.choice(names), "T0", 1.0, False, "resolver", AT, None) for m in range(200)], DECISION)
    rng.shuffle(names)
    pairs = [(names[i], names[i + 1], 1) for i in range(0, 30, 2)]
    merged, events, snapshot = (cut(t) for t in merges.merge(entities, decisions, spark.createDataFrame(pairs, "survivor_id string, absorbed_id string, blast_radius long"), F.lit(AT)))
    # all mentions of the absorbed are decided for the survivor
    to = {b: a for a, b, _ in pairs}
    rows = [r.asDict() for r in decisions.collect()]
    stray = [{**r, "decision_id": "n" + r["decision_id"], "entity_id": to[r["entity_id"]]} for r in rows if r["entity_id"] in to]
    now = [{**r, "superseded_by": "n" + r["decision_id"]} if r["entity_id"] in to else r for r in rows] + stray
    back, log, decided = merges.unmerge(merged, events, snapshot, spark.createDataFrame(now, DECISION), events.select("merge_id"), F.lit(LATER))
    assert live(decided) == live(decisions)
    assert back.where("status <> 'active' OR merged_into IS NOT NULL").count() == 0 and log.count() == 30


def test_members_that_a_joint_decision_moves(spark):
    pieces = spark.createDataFrame([("p", "a", None), ("p", "b", "a"), ("q", "c", "a"), ("r", "d", "x"), ("q", "e", "e")], "piece string, entity_id string, current_root string")
    events = spark.createDataFrame([(f"m{e}", "a", e, 1, "auto", AT, None, None) for e in "bcd"] + [("old", "a", "c", 1, "auto", AT, "undo", None), ("undo", "c", "a", 1, "human", LATER, None, "old")], EVENT)
    assert sorted(map(tuple, merges.disagreeing(pieces, events).collect())) == [("mc", "c"), ("md", "d")]


def test_ripples_of_an_unmerge(spark):
    entities, _ = registry(spark)
    events = spark.createDataFrame([("m", "a", "b", 1, "auto", AT, "u", None), ("u", "b", "a", 1, "human", LATER, None, "m")], EVENT)
    relations = spark.createDataFrame([("ra", "a"), ("rz", "z"), ("rb", "b"), ("rc", "c")], "relation_id string, subject_entity_id string")
    closed = spark.createDataFrame([("ra", "rb", "supersede"), ("rb", "rz", "supersede"), ("ra", "rz", "supersede"), ("rc", "rb", "supersede"), ("rb", "ra", "noop")], "relation_id string, related_relation_id string, outcome string")
    survivors = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c"), ("z", "a")], "entity_id string, survivor_id string")
    assert sorted(map(tuple, merges.ripples(entities, events, closed, relations, survivors).collect())) == [("u", "ra", "rb"), ("u", "rb", "rz")]
