"""Joint decisions about entities: proposals from pieces, merges that keep what was before, and merges taken back.

A merge redirects one entity to another and keeps which mentions each had by then, a row for each mention. Taking it back
adds a reversal and new decisions that supersede those that differ from what was kept: nothing is overwritten, and what
was closed across the two identities goes to review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.checkpoint import cut

BLAST_CAP = 100


def live_decisions(decisions: DataFrame) -> DataFrame:
    """The decision of each mention that nothing supersedes; the latest, then the one of the greatest id, if several are left."""
    order = F.struct("decided_at", "decision_id")
    last = decisions.where("superseded_by IS NULL").groupBy("mention_id").agg(F.max_by(F.struct("decision_id", "entity_id"), order).alias("d"))
    return last.select("mention_id", "d.decision_id", "d.entity_id")


def proposals(pieces: DataFrame, cap: int = BLAST_CAP) -> DataFrame:
    """(survivor_id, absorbed_id, blast_radius, route) from pieces (piece, entity_id, first_seen, weight): all of a piece go
    to its first seen, ties to the smaller id. weight: what an entity's merge touches, mentions and edges. Over the cap
    the route is review, else merge; a piece of one proposes nothing."""
    # the piece's first by a grouped minimum, so that a large piece is not sorted in one task
    heads = pieces.groupBy("piece").agg(F.min(F.struct("first_seen", "entity_id")).alias("first"), F.sum("weight").alias("blast_radius"), F.count("*").alias("n")).where("n > 1")
    rows = pieces.join(heads, "piece").where("entity_id <> first.entity_id")
    return rows.select(F.col("first.entity_id").alias("survivor_id"), F.col("entity_id").alias("absorbed_id"), F.col("blast_radius").cast("long").alias("blast_radius"), F.when(F.col("blast_radius") > cap, "review").otherwise("merge").alias("route"))


def disagreeing(pieces: DataFrame, merge_events: DataFrame) -> DataFrame:
    """(merge_id, absorbed_id): the live merges that a joint decision takes back, those of members whose survivor is not
    in their piece. pieces: (piece, entity_id, current_root)."""
    moved = pieces.where("current_root IS NOT NULL AND current_root <> entity_id")
    together = pieces.select(F.col("piece").alias("p"), F.col("entity_id").alias("root"))
    apart = moved.join(together, (F.col("piece") == F.col("p")) & (F.col("current_root") == F.col("root")), "left_anti")
    return live_merges(merge_events).join(apart.select(F.col("entity_id").alias("absorbed_id")), "absorbed_id", "left_semi").select("merge_id", "absorbed_id")


def live_merges(merge_events: DataFrame) -> DataFrame:
    """The last merge of each absorbed entity that was not taken back and is no reversal itself."""
    order = Window.partitionBy("absorbed_id").orderBy(F.desc("decided_at"), F.desc("merge_id"))
    rows = merge_events.where("reversed_by IS NULL AND coalesce(unmerge_of, '') = ''")
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def merge(entities: DataFrame, decisions: DataFrame, proposed: DataFrame, at: Column, decided_by: str = "auto") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, events, snapshot) of proposed (survivor_id, absorbed_id, blast_radius) pairs of route merge.

    Only an active entity is redirected, once. events: (merge_id, survivor_id, absorbed_id, blast_radius, decided_by,
    decided_at, reversed_by, unmerge_of); snapshot: (merge_id, entity_id, mention_id), the mentions of both sides by live
    decisions. A merge's id is made of its pair and time, so that a repeated run makes the same.
    """
    active = entities.where("status = 'active'").select(F.col("entity_id").alias("absorbed_id"))
    once = proposed.groupBy("absorbed_id").agg(F.min(F.struct("survivor_id", "blast_radius")).alias("to"))
    made = once.join(active, "absorbed_id", "left_semi").where("absorbed_id <> to.survivor_id")
    merge_id = F.sha2(F.concat_ws("|", "to.survivor_id", "absorbed_id", at.cast("string")), 256)
    none = F.lit(None).cast("string")
    events = cut(made.select(merge_id.alias("merge_id"), F.col("to.survivor_id").alias("survivor_id"), "absorbed_id", F.col("to.blast_radius").alias("blast_radius"), F.lit(decided_by).alias("decided_by"), at.alias("decided_at"), none.alias("reversed_by"), none.alias("unmerge_of")))
    sides = events.select("merge_id", F.explode(F.array("survivor_id", "absorbed_id")).alias("entity_id"))
    snapshot = sides.join(live_decisions(decisions).select("entity_id", "mention_id"), "entity_id").select("merge_id", "entity_id", "mention_id")
    redirect = events.select(F.col("absorbed_id").alias("entity_id"), F.col("survivor_id").alias("to"))
    after = entities.join(redirect, "entity_id", "left")
    gone = F.col("to").isNotNull()
    after = after.withColumns({"status": F.when(gone, "merged").otherwise(F.col("status")), "merged_into": F.coalesce("to", "merged_into"), "updated_at": F.when(gone, at).otherwise(F.col("updated_at"))})
    return after.select(*entities.columns), events, snapshot


def unmerge(entities: DataFrame, events: DataFrame, snapshot: DataFrame, decisions: DataFrame, merge_ids: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, events, decisions) after the merges of merge_ids (merge_id) are taken back.

    An id that is unknown, reversed or a reversal is left alone. The absorbed entity is active again; each of its kept
    mentions whose live decision points elsewhere gets a new decision, which supersedes that one. The event names its
    reversal, a new event with the sides changed.
    """
    asked = merge_ids.select("merge_id").distinct()
    back = cut(events.where("reversed_by IS NULL AND unmerge_of IS NULL").join(asked, "merge_id", "left_semi"))
    reversal = F.sha2(F.concat_ws("|", F.lit("undo"), "merge_id", at.cast("string")), 256)
    undone = back.select(F.col("merge_id").alias("undone"), reversal.alias("by"))
    marked = events.join(undone, events["merge_id"] == undone["undone"], "left").withColumn("reversed_by", F.coalesce("reversed_by", "by")).select(*events.columns)
    added = back.select(reversal.alias("merge_id"), F.col("absorbed_id").alias("survivor_id"), F.col("survivor_id").alias("absorbed_id"), "blast_radius", F.lit("human").alias("decided_by"), at.alias("decided_at"), F.lit(None).cast("string").alias("reversed_by"), F.col("merge_id").alias("unmerge_of"))
    restored = back.select(F.col("absorbed_id").alias("entity_id"), F.lit(True).alias("back")).distinct()
    after = entities.join(restored, "entity_id", "left")
    active = F.coalesce("back", F.lit(False)) & (F.col("status") == "merged")
    after = after.withColumns({"status": F.when(active, "active").otherwise(F.col("status")), "merged_into": F.when(~active, F.col("merged_into")), "updated_at": F.when(active, at).otherwise(F.col("updated_at"))}).select(*entities.columns)
    kept = snapshot.join(back.select("merge_id", F.col("absorbed_id").alias("entity_id")), ["merge_id", "entity_id"]).select("mention_id", "entity_id").groupBy("mention_id").agg(F.min("entity_id").alias("own"))
    strayed = cut(live_decisions(decisions).join(kept, "mention_id").where("entity_id <> own"))
    new_id = F.sha2(F.concat_ws("|", F.lit("restore"), "mention_id", "own", at.cast("string")), 256)
    fresh = strayed.select("mention_id", F.col("decision_id").alias("old"), new_id.alias("new"), F.col("own"))
    superseded = decisions.join(fresh.select("old", "new"), decisions["decision_id"] == F.col("old"), "left").withColumn("superseded_by", F.coalesce("superseded_by", "new")).select(*decisions.columns)
    constant = {"method": F.lit("human"), "confidence": F.lit(1.0), "is_new_entity": F.lit(False), "decided_by": F.lit("human"), "decided_at": at, "superseded_by": F.lit(None).cast("string")}
    values = {"decision_id": F.col("new"), "mention_id": F.col("mention_id"), "entity_id": F.col("own")} | constant
    deployment = decisions.select("mention_id", "deployment_id").groupBy("mention_id").agg(F.min("deployment_id").alias("deployment_id")) if "deployment_id" in decisions.columns else None
    rows = fresh.join(deployment, "mention_id") if deployment is not None else fresh
    values |= {"deployment_id": F.col("deployment_id")} if deployment is not None else {}
    added_decisions = rows.select(*(values[c].cast(dict(decisions.dtypes)[c]).alias(c) for c in decisions.columns))
    return after, marked.unionByName(added), superseded.unionByName(added_decisions)


def ripples(entities: DataFrame, events: DataFrame, adjudications: DataFrame, relations: DataFrame, survivors: DataFrame) -> DataFrame:
    """(reversal_id, closed_relation_id, superseding_relation_id): windows that were closed across the two sides of a merge
    that was taken back. survivors: (entity_id, survivor_id) after it, so that a side is all that is merged into it;
    adjudications: (relation_id, related_relation_id, outcome)."""
    undone = events.where("unmerge_of IS NOT NULL").select(F.col("merge_id").alias("reversal_id"), F.col("survivor_id").alias("one"), F.col("absorbed_id").alias("other"))
    root = survivors.select(F.col("entity_id").alias("e"), F.col("survivor_id").alias("r"))
    subject = relations.select("relation_id", "subject_entity_id").join(root, F.col("subject_entity_id") == F.col("e"), "left").select("relation_id", F.coalesce("r", "subject_entity_id").alias("root"))
    closed = adjudications.where("outcome = 'supersede' AND related_relation_id IS NOT NULL").select("relation_id", "related_relation_id")
    ends = closed.join(subject.withColumnRenamed("root", "a"), "relation_id").join(subject.select(F.col("relation_id").alias("related_relation_id"), F.col("root").alias("b")), "related_relation_id")
    both = undone.unionByName(undone.select("reversal_id", F.col("other").alias("one"), F.col("one").alias("other")))
    rooted = both.join(root.select(F.col("e").alias("one"), F.col("r").alias("x")), "one", "left").join(root.select(F.col("e").alias("other"), F.col("r").alias("y")), "other", "left")
    rooted = rooted.select("reversal_id", F.coalesce("x", "one").alias("a"), F.coalesce("y", "other").alias("b"))
    return ends.join(rooted, ["a", "b"]).select("reversal_id", F.col("relation_id").alias("closed_relation_id"), F.col("related_relation_id").alias("superseding_relation_id")).distinct()
