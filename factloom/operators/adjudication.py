"""Facts from testimony: relation spells, and the fold of observations in source-time order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import temporal
from factloom.plans.views import D, Views

NOVELTY_FLOOR = 0.3
TRIPLE = ["subject_entity_id", "predicate", "object_entity_id"]


def upsert_relations(views: Views, incoming: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Relations to add and evidence to add for triples (subject, predicate, object, claim_id, doc_id).

    A believed spell that is open at now takes the evidence. Where there is none a new spell begins when the last one
    closed; its id is made of the triple and that instant. Evidence is taken once for a relation and claim.
    """
    at = temporal.instant(now)
    known = views.spine["relations"].where("invalidated_at IS NULL")
    still_open = F.col("valid_until").isNull() | (F.col("valid_until") > at)
    spells = known.groupBy(*TRIPLE).agg(F.min(F.when(still_open, F.col("relation_id"))).alias("open_id"), F.max("valid_until").alias("closed_at"))
    placed = incoming.join(spells, TRIPLE, "left")
    fresh = F.sha2(F.concat_ws("|", *TRIPLE, F.coalesce(F.col("closed_at").cast("string"), F.lit("first"))), 256)
    placed = placed.withColumn("relation_id", F.coalesce("open_id", fresh))
    relations = placed.where("open_id IS NULL").select("relation_id", *TRIPLE, F.col("closed_at").alias("valid_from")).distinct()
    evidence = placed.select("relation_id", "claim_id", "doc_id", F.lit("supports").alias("stance")).dropDuplicates(["relation_id", "claim_id"])
    return relations, evidence.join(views.spine["relation_evidence"].select("relation_id", "claim_id"), ["relation_id", "claim_id"], "left_anti")


def word_overlap(a: str, b: str) -> float:
    """Shared words of two statements over all their words: a stand-in where no vectors are at hand."""
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x | y else 1.0


def fold_observations(assertions: DataFrame, similarity: Callable[[str, str], float] = word_overlap, verdict: Callable[[str, str], str] | None = None, floor: float = NOVELTY_FLOOR) -> DataFrame:
    """(entity_id, observation_id, statement, valid_from, valid_until, evidence_count) from (entity_id, statement,
    asserted_at, claim_id).

    Assertions of an entity are taken by (asserted_at, claim_id), undated last. The same open statement takes the
    evidence. A statement unlike all open ones is added; one that is like some is judged against the likest: evidence
    (joins it), supersede (closes it) or coexist, which is the rule without a verdict. A task streams through sorted
    rows and holds one entity's open statements, so that a busy entity is not gathered.
    """
    schema = pa.schema([("entity_id", pa.string()), ("observation_id", pa.string()), ("statement", pa.string()), ("valid_from", pa.timestamp("us")), ("valid_until", pa.timestamp("us")), ("evidence_count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, opened, out = None, {}, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["entity_id"] != entity:
                    out += opened.values()
                    entity, opened = row["entity_id"], {}
                text, at = row["statement"], row["asserted_at"]
                if text not in opened:
                    likest = max(opened, key=lambda s: (similarity(s, text), s), default=None)
                    judged = "add" if likest is None or similarity(likest, text) < floor or verdict is None else verdict(likest, text)
                    if judged == "evidence":
                        text = likest
                    elif judged == "supersede":
                        closed = opened.pop(likest)
                        out.append({**closed, "valid_until": at})
                held = opened.setdefault(text, {"entity_id": entity, "observation_id": row["claim_id"], "statement": text, "valid_from": at, "valid_until": None, "evidence_count": 0})
                held["evidence_count"] += 1
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist([*out, *opened.values()], schema=schema)

    rows = assertions.select(F.col("entity_id").cast("string"), "statement", F.col("asserted_at").cast("timestamp_ntz").alias("asserted_at"), F.col("claim_id").cast("string"))
    rows = rows.repartition("entity_id").sortWithinPartitions(F.asc_nulls_last("entity_id"), F.asc_nulls_last("asserted_at"), "claim_id")
    return rows.mapInArrow(run, "entity_id string, observation_id string, statement string, valid_from timestamp_ntz, valid_until timestamp_ntz, evidence_count long")


def pull_back(observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Observations whose valid_from moves to an earlier assertion, unless another slice of the statement was closed
    after that assertion: (observation_id, valid_from). evidence: (observation_id, asserted_at)."""
    first = evidence.groupBy("observation_id").agg(F.min("asserted_at").alias("first"))
    caps = observations.where("valid_until IS NOT NULL").select(F.col("subject_entity_id").alias("s"), F.col("statement").alias("t"), F.col("observation_id").alias("other"), F.col("valid_until").alias("cap"))
    moved = observations.join(first, "observation_id").where("first < valid_from")
    blocked = moved.join(caps, (F.col("subject_entity_id") == F.col("s")) & (F.col("statement") == F.col("t")) & (F.col("observation_id") != F.col("other")) & (F.col("cap") > F.col("first")), "left_semi").select("observation_id")
    return moved.join(blocked, "observation_id", "left_anti").select("observation_id", F.col("first").alias("valid_from"))
