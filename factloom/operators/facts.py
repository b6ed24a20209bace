"""Lookups, enumerated aggregates, the change feed, and the bookkeeping of testimony and facts."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import temporal
from factloom.plans.views import D, Views, first_of


def none() -> Column:
    return F.lit(None).cast("string")



def lookup_relations(views: Views, as_of: str, subject: str | None = None, predicate: str | None = None, obj: str | None = None) -> DataFrame:
    """Believed relations of a pattern that hold at an instant, best evidenced first."""
    rows = views.spine["relations"].where(F.col("invalidated_at").isNull() & temporal.holds(temporal.instant(as_of)))
    for column, value in (("subject_entity_id", subject), ("predicate", predicate), ("object_entity_id", obj)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("evidence_count"), "ingested_at", "relation_id").select("relation_id", "subject_entity_id", "predicate", "object_entity_id", "fact_label", "valid_from", "valid_until", "evidence_count")


def lookup_observations(views: Views, entity: str, as_of: str) -> DataFrame:
    held = F.col("invalidated_at").isNull() & temporal.holds(temporal.instant(as_of))
    return views.spine["observations"].where((F.col("subject_entity_id") == entity) & held).orderBy("ingested_at", "observation_id").select("observation_id", "statement", "valid_from", "valid_until", "confidence")


def aggregate(views: Views, form: str, subject: str | None = None, predicate: str | None = None, entity_type: str | None = None, since: str | None = None, limit: int = 50) -> DataFrame:
    """(key, count, entity_id) of one of six forms over the base facts; a row over limit tells that there are more."""
    believed = lambda table: views.spine[table].where("invalidated_at IS NULL")
    needs = {"group_by_predicate": [subject], "group_by_object": [subject], "timeline": [subject], "delta_top_entities": [since], "typed_absence": [entity_type, predicate], "count": []}
    if form not in needs or None in needs[form]:
        raise ValueError(f"aggregate form {form!r} is unknown or lacks an argument")
    relations = believed("relations")
    names = views.spine["entities"].select(F.col("entity_id"), F.col("canonical_name").alias("key"), "status", "type")
    if form == "count":
        for column, value in (("subject_entity_id", subject), ("predicate", predicate)):
            relations = relations if value is None else relations.where(F.col(column) == value)
        return relations.agg(F.count("*").alias("count")).select(none().alias("key"), "count", none().alias("entity_id"))
    if form == "group_by_predicate":
        grouped = relations.where(F.col("subject_entity_id") == subject).groupBy(F.col("predicate").alias("key")).agg(F.count("*").alias("count"))
        return grouped.withColumn("entity_id", none()).orderBy(F.desc("count"), "key").limit(limit + 1)
    if form == "group_by_object":
        own = relations.where(F.col("subject_entity_id") == subject)
        own = own if predicate is None else own.where(F.col("predicate") == predicate)
        grouped = own.groupBy(F.col("object_entity_id").alias("entity_id")).agg(F.count("*").alias("count")).join(names, "entity_id")
        return grouped.select("key", "count", "entity_id").orderBy(F.desc("count"), "key", "entity_id").limit(limit + 1)
    if form == "timeline":
        own = relations.where((F.col("subject_entity_id") == subject) | (F.col("object_entity_id") == subject)).select("valid_from", "ingested_at")
        own = own.unionByName(believed("observations").where(F.col("subject_entity_id") == subject).select("valid_from", "ingested_at"))
        return own.groupBy(F.date_format(F.coalesce("valid_from", "ingested_at"), "yyyy").alias("key")).agg(F.count("*").alias("count")).withColumn("entity_id", none()).orderBy("key")
    if form == "delta_top_entities":
        gained = [views.spine[t].where(F.col("ingested_at") > temporal.instant(since)).groupBy(F.col("subject_entity_id").alias("entity_id")).agg(F.count("*").alias("n")) for t in ("relations", "observations")]
        summed = gained[0].unionByName(gained[1]).groupBy("entity_id").agg(F.sum("n").alias("count"))
        return summed.join(names, "entity_id").select("key", "count", "entity_id").orderBy(F.desc("count"), "key", "entity_id").limit(limit + 1)
    having = relations.where(F.col("predicate") == predicate).select(F.col("subject_entity_id").alias("entity_id"))
    absent = names.where((F.col("status") == "active") & (F.col("type") == entity_type)).join(having, "entity_id", "left_anti")
    return absent.select("key", F.lit(1).cast("long").alias("count"), "entity_id").orderBy("key", "entity_id").limit(limit + 1)


def encode_cursor(at: object, item: str) -> str:
    return base64.urlsafe_b64encode(f"{at}|{item}".encode()).decode()


def decode_cursor(cursor: str) -> tuple[str, str]:
    at, _, item = base64.urlsafe_b64decode(cursor.encode()).decode().partition("|")
    return at, item


def delta_feed(views: Views, since: str, kinds: list[str] | None = None, limit: int = 500, cursor: str | None = None) -> DataFrame:
    """Changes after an instant, newest first: (kind, change, id, label, at). A cursor resumes after its row."""
    spine, arms = views.spine, []

    def arm(rows: DataFrame, kind: str, change: str, key: str, label: Column, at: str) -> None:
        arms.append(rows.select(F.lit(kind).alias("kind"), F.lit(change).alias("change"), F.col(key).alias("id"), label.alias("label"), F.col(at).alias("at")))

    for kind, label in (("relation", F.coalesce("fact_label", "predicate")), ("observation", F.col("statement"))):
        facts, key = spine[f"{kind}s"], f"{kind}_id"
        arm(facts, kind, "new", key, label, "ingested_at")
        arm(facts, kind, "invalidated", key, label, "invalidated_at")
        capped = spine[f"{kind}_adjudications"].where("outcome = 'supersede'").select(D, key, "decided_at")
        arm(facts.join(capped, [D, key]), kind, "capped", key, label, "decided_at")
    arm(spine["claims"], "claim", "new", "claim_id", F.substring("claim_text", 1, 80), "ingested_at")
    arm(spine["knowledge_compilations"], "page", "recompiled", "artifact_id", none(), "compiled_at")
    feed = arms[0]
    for more in arms[1:]:
        feed = feed.unionByName(more)
    feed = feed.where(F.col("at") > temporal.instant(since))
    if kinds is not None:
        feed = feed.where(F.col("kind").isin(kinds))
    if cursor:
        at, item = decode_cursor(cursor)
        feed = feed.where((F.col("at") < temporal.instant(at)) | ((F.col("at") == temporal.instant(at)) & (F.col("id") < item)))
    return feed.orderBy(F.desc("at"), F.desc("id")).limit(limit + 1)


def scan(views: Views, kind: str) -> DataFrame:
    """(id, label, at) of every relation, observation or claim, in order of (at, id)."""
    sources = {"relation": ("relations", F.coalesce("fact_label", "predicate")), "observation": ("observations", F.col("statement")), "claim": ("claims", F.substring("claim_text", 1, 120))}
    if kind not in sources:
        raise ValueError(f"unknown scan kind {kind!r}")
    table, label = sources[kind]
    return views.spine[table].select(F.col(f"{kind}_id").alias("id"), label.alias("label"), F.col("ingested_at").alias("at")).orderBy("at", "id")


def documents_about(views: Views, entity: str, k: int = 20) -> DataFrame:
    """Live documents whose mentions were resolved to an entity, with their total number."""
    decided = views.spine["resolution_decisions"].where((F.col("entity_id") == entity) & F.col("superseded_by").isNull()).select(D, "mention_id")
    mentioned = views.spine["mentions"].join(decided, [D, "mention_id"])
    docs = views.spine["documents"].where("deleted_at IS NULL").select(D, "doc_id", "title", "source_kind")
    grouped = mentioned.groupBy(D, "doc_id").agg(F.countDistinct("mention_id").alias("mention_count"), F.min("created_at").alias("first_mentioned_at"), F.max("created_at").alias("last_mentioned_at")).join(docs, [D, "doc_id"]).drop(D)
    total = grouped.agg(F.count("*").alias("total_count"))
    return grouped.orderBy(F.desc("mention_count"), F.desc("last_mentioned_at"), "doc_id").limit(k).crossJoin(total)  # one row


def claims_about(views: Views, entity: str, k: int = 20) -> DataFrame:
    """Current claims on chunks that mention an entity, latest first, with their total number."""
    decided = views.spine["resolution_decisions"].where((F.col("entity_id") == entity) & F.col("superseded_by").isNull()).select(D, "mention_id")
    chunks = views.spine["mentions"].join(decided, [D, "mention_id"], "left_semi").select(D, "chunk_id").distinct()
    claims = views.spine["chunk_claims"].join(chunks, [D, "chunk_id"], "left_semi").select(D, "claim_id").distinct()
    gone = views.spine["documents"].where("deleted_at IS NOT NULL").select(D, "doc_id")
    matched = views.spine["claims"].where("is_current_testimony").join(claims, [D, "claim_id"], "left_semi").join(gone, [D, "doc_id"], "left_anti").select("claim_id", "asserted_at", "ingested_at")
    total = matched.agg(F.count("*").alias("total_count"))
    return matched.orderBy(F.desc_nulls_last("asserted_at"), F.desc("ingested_at"), "claim_id").limit(k).select("claim_id").crossJoin(total)  # one row


def claims_as_of(views: Views, start: str, end: str, k: int = 20) -> DataFrame:
    """Claims whose validity meets an interval; those of unknown precision are only counted."""
    gone = views.spine["documents"].where("deleted_at IS NOT NULL").select(D, "doc_id")
    hit = views.spine["claims"].where(temporal.claim_touches(temporal.instant(start), temporal.instant(end))).join(gone, [D, "doc_id"], "left_anti").select("claim_id", "claim_valid_from")
    counts = hit.agg(F.count("*").alias("total_count")).crossJoin(views.spine["claims"].agg(F.count_if(F.col("claim_valid_precision") == "unknown").alias("unstamped_count")))
    return hit.orderBy(F.desc("claim_valid_from"), "claim_id").limit(k).crossJoin(counts)  # one row


def chunk_neighbors(views: Views, chunk: str, radius: int = 1) -> DataFrame:
    """Chunks whose ordinal is within radius of a live chunk's, in its representation."""
    keys = [D, "doc_id", "version_id", "representation_id"]
    focal = views.chunks_live.where(F.col("chunk_id") == chunk).select(*keys, F.col("ordinal").alias("focal"))
    return views.spine["chunks"].join(focal, keys).where(F.abs(F.col("ordinal") - F.col("focal")) <= radius).select("chunk_id", "ordinal").orderBy("ordinal", "chunk_id")


# bookkeeping


def recount(views: Views, kind: str) -> DataFrame:
    """Facts whose stored counts differ from the distinct documents of their current claims, by stance."""
    key = f"{kind}_id"
    current = views.spine["claims"].select(D, "claim_id", "is_current_testimony")
    evidence = views.spine[f"{kind}_evidence"].join(current, [D, "claim_id"], "left")
    of = lambda stance: F.countDistinct(F.when((F.col("stance") == stance) & F.col("is_current_testimony"), F.col("doc_id")))
    fresh = evidence.groupBy(D, key).agg(of("supports").alias("supports"), of("contradicts").alias("contradicts"))
    stored = views.spine[f"{kind}s"]
    stored = stored if kind == "relation" else stored.withColumns({"evidence_count": F.lit(1), "contradict_count": F.lit(0)})
    joined = stored.select(D, key, "evidence_count", "contradict_count").join(fresh, [D, key], "left").fillna(0, ["supports", "contradicts"])
    differs = ~F.col("evidence_count").eqNullSafe(F.col("supports")) | ~F.col("contradict_count").eqNullSafe(F.col("contradicts"))
    return joined.where(differs).select(key, "supports", "contradicts")


def _carried(views: Views) -> DataFrame:
    """Claims that a chunk of their document's current version carries."""
    current = views.spine["documents"].select(D, "doc_id", F.col("current_version_id").alias("version_id"))
    chunks = views.spine["chunks"].join(current, [D, "doc_id", "version_id"]).select(D, "chunk_id")
    return views.spine["chunk_claims"].join(chunks, [D, "chunk_id"], "left_semi").select(D, "claim_id").distinct()


def _origin(views: Views) -> DataFrame:
    """Claims with the version that they were extracted from, and their document's current one."""
    chunks = views.spine["chunks"].select(D, "chunk_id", F.col("version_id").alias("from_version_id"))
    docs = views.spine["documents"].select(D, "doc_id", "current_version_id")
    return views.spine["claims"].join(chunks, [D, "chunk_id"]).join(docs, [D, "doc_id"])


def stale_superseded(views: Views) -> DataFrame:
    """Current claims of an older version that the current one does not carry."""
    old = _origin(views).where("is_current_testimony AND from_version_id <> current_version_id")
    return old.join(_carried(views), [D, "claim_id"], "left_anti").select("claim_id", "doc_id", "from_version_id")


def regained(views: Views) -> DataFrame:
    """Claims that are not current though the current version is their origin or carries them."""
    lost = _origin(views).where("NOT is_current_testimony")
    carried = _carried(views).withColumn("carried", F.lit(True))
    return lost.join(carried, [D, "claim_id"], "left").where("carried OR from_version_id = current_version_id").select("claim_id", "doc_id", "from_version_id")


def apply_transitions(views: Views, transitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New events of the ledger and the claims' flags after them; an event that the ledger has is not taken again."""
    keys = [D, "claim_id", "reconciliation_id", "reason", "became_current"]
    events = transitions.dropDuplicates(keys).join(views.spine["testimony_currency_events"].select(*keys), keys, "left_anti")
    last = first_of(events, [D, "claim_id"], [F.desc("occurred_at"), F.desc("event_id")]).select(D, "claim_id", "became_current")
    claims = views.spine["claims"].join(last, [D, "claim_id"], "left").withColumn("is_current_testimony", F.coalesce("became_current", "is_current_testimony")).drop("became_current")
    return events, claims


def zero_support(views: Views, boundary: str) -> DataFrame:
    """Open relations that no current claim supports, closed at a boundary; those under an open review are left."""
    waiting = views.spine["review_queue"].where("item_kind = 'support_withdrawn' AND status IN ('pending', 'deferred')").select(D, F.get_json_object("candidate", "$.fact_id").alias("relation_id"))
    current = views.spine["claims"].where("is_current_testimony").select(D, "claim_id")
    backed = views.spine["relation_evidence"].where("stance = 'supports'").join(current, [D, "claim_id"], "left_semi").select(D, "relation_id")
    at = temporal.instant(boundary)
    loose = views.spine["relations"].where(F.col("invalidated_at").isNull() & (F.col("valid_until").isNull() | (F.col("valid_until") > at))).join(backed, [D, "relation_id"], "left_anti").join(waiting, [D, "relation_id"], "left_anti")
    return loose.select("relation_id", at.alias("valid_until"))


def supersede_windows(views: Views, predicate: str) -> DataFrame:
    """Windows that a later fact of the same identity and predicate with another object closes, and when.

    Facts are ordered by the earliest instant that their claims assert, undated last; a boundary only ever shortens.
    """
    asserted = views.spine["relation_evidence"].where("stance = 'supports'").join(views.spine["claims"].select(D, "claim_id", "asserted_at"), [D, "claim_id"]).groupBy(D, "relation_id").agg(F.min("asserted_at").alias("asserted_at"))
    survivor = lambda column: views.survivors.select(D, F.col("entity_id").alias(column), F.col("survivor_entity_id").alias(f"{column}_now"))
    facts = views.spine["relations"].where((F.col("predicate") == predicate) & F.col("invalidated_at").isNull())
    facts = facts.join(survivor("subject_entity_id"), [D, "subject_entity_id"]).join(survivor("object_entity_id"), [D, "object_entity_id"]).join(asserted, [D, "relation_id"], "left")
    order = Window.partitionBy(D, "subject_entity_id_now").orderBy(F.asc_nulls_last("asserted_at"), "relation_id")
    facts = facts.withColumns({"next_object": F.lead("object_entity_id_now").over(order), "boundary": F.lead("asserted_at").over(order), "by": F.lead("relation_id").over(order)})
    shortens = F.col("boundary").isNotNull() & (F.col("next_object") != F.col("object_entity_id_now")) & (F.col("valid_until").isNull() | (F.col("boundary") < F.col("valid_until")))
    return facts.where(shortens).select("relation_id", F.col("by").alias("superseded_by"), F.col("boundary").alias("valid_until"))


def fact_evidence(views: Views, facts: list[str], per_stance: int = 3, budget: int = 60) -> DataFrame:
    """Lineages of facts, shared out fairly: by rank, then fact in the order given, then stance, until the budget ends."""
    latest = Window.partitionBy("fact_id", "stance").orderBy(F.desc_nulls_last("asserted_to"), "doc_id", "representative_claim_id")
    totals = Window.partitionBy("fact_id", "stance")
    place = F.array_position(F.array(*map(F.lit, facts)), F.col("fact_id"))
    ranked = views.evidence_lineage.where(F.col("fact_id").isin(facts)).withColumns({"rank": F.row_number().over(latest), "stance_total": F.count("*").over(totals), "place": place})
    order = ["rank", "place", F.when(F.col("stance") == "supports", 0).otherwise(1)]
    return ranked.where(F.col("rank") <= per_stance).orderBy(*order).limit(budget).select("fact_id", "stance", "doc_id", "representative_claim_id", "rank", "stance_total")


def contradiction_members(views: Views, inline: int = 25) -> DataFrame:
    """Current members of each contradiction group, the first ones by id, with the group's size."""
    group = Window.partitionBy(D, "contradiction_group")
    ranked = views.contradiction_members_current.withColumns({"place": F.row_number().over(group.orderBy("fact_kind", "fact_id")), "members": F.count("*").over(group)})
    return ranked.where(F.col("place") <= inline).select("contradiction_group", "fact_kind", "fact_id", "place", "members")


def budget_window(views: Views, seconds: int, by_tier: bool = False) -> DataFrame:
    """Spend of each epoch-aligned window, by stage and lane, and by tier if asked."""
    epoch = F.unix_micros(F.col("occurred_at").cast("timestamp"))
    start = F.timestamp_micros((F.floor(epoch / (seconds * 1_000_000)) * seconds * 1_000_000).cast("long")).cast("timestamp_ntz")
    keys = ["stage", "lane", *(["tier"] if by_tier else [])]
    return views.spine["cost_ledger"].groupBy(start.alias("window_start"), *keys).agg(F.sum("cost_usd").cast("double").alias("cost_usd"), F.count("*").alias("receipts"))


def cost_receipts(views: Views, horizon: str, after: tuple[str, str, str] | None = None, limit: int = 100) -> DataFrame:
    """A page of receipts of both ledgers up to a horizon, by (occurred_at, source, cost_id)."""
    both = views.spine["cost_ledger"].select("occurred_at", F.lit("worker").alias("source"), "cost_id", F.col("cost_usd").cast("double").alias("cost_usd")).unionByName(
        views.spine["surface_cost_ledger"].select("occurred_at", F.lit("surface").alias("source"), "cost_id", F.col("cost_usd").cast("double").alias("cost_usd"))
    )
    page = both.where(F.col("occurred_at") <= temporal.instant(horizon))
    if after:
        page = page.where(F.struct("occurred_at", "source", "cost_id") > F.struct(temporal.instant(after[0]), F.lit(after[1]), F.lit(after[2])))
    return page.orderBy("occurred_at", "source", "cost_id").limit(min(limit, 500))


def review_pending(views: Views, limit: int = 20) -> DataFrame:
    return views.spine["review_queue"].where("status IN ('pending', 'deferred')").orderBy(F.desc("expected_impact"), "created_at", "review_id").limit(limit).select("review_id", "status", "expected_impact", "created_at")


def dead_letters(views: Views) -> DataFrame:
    """Failed work by stage and error class, the word that begins the last line of the traceback."""
    last = F.element_at(F.filter(F.split("last_error", "\n"), lambda x: F.trim(x) != ""), -1)
    return views.spine["processing_state"].where("status = 'dead'").groupBy("stage", F.regexp_extract(last, r"^([A-Za-z_.]+)", 1).alias("error_class")).agg(F.count("*").alias("units"), F.max("enqueued_at").alias("last_enqueued_at"))


def quarantine(views: Views) -> DataFrame:
    """How many rows of each kind can never be visible."""
    spine = views.spine
    probes = {
        "claims_without_chunk": spine["claims"].join(spine["chunks"].select(D, "chunk_id"), [D, "chunk_id"], "left_anti"),
        "chunks_without_version": spine["chunks"].join(spine["document_versions"].select(D, "version_id"), [D, "version_id"], "left_anti"),
        "mentions_without_decision": spine["mentions"].join(spine["resolution_decisions"].select(D, "mention_id"), [D, "mention_id"], "left_anti"),
        "entities_without_survivor": spine["entities"].join(views.survivors.select(D, "entity_id"), [D, "entity_id"], "left_anti"),
        "relations_without_evidence": spine["relations"].join(spine["relation_evidence"].select(D, "relation_id"), [D, "relation_id"], "left_anti"),
    }
    counted = [rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("probe"), "rows") for name, rows in probes.items()]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


def transcript(views: Views, kind: str, subject: str, limit: int = 40) -> DataFrame:
    """Decisions about a relation, an observation or an entity, latest first."""
    spine = views.spine
    if kind in ("relation", "observation"):
        rows = spine[f"{kind}_adjudications"].where(F.col(f"{kind}_id") == subject).select(F.col("adjudication_id").alias("event_id"), F.lit("adjudication").alias("event"), "outcome", "decided_at")
    elif kind == "entity":
        rows = spine["resolution_decisions"].where(F.col("entity_id") == subject).select(F.col("decision_id").alias("event_id"), F.lit("resolution").alias("event"), F.col("method").alias("outcome"), "decided_at")
        merges = spine["merge_events"].where((F.col("survivor_id") == subject) | (F.col("absorbed_id") == subject))
        rows = rows.unionByName(merges.select(F.col("merge_id").alias("event_id"), F.lit("merge").alias("event"), F.when(F.col("reversed_by").isNull(), "merge").otherwise("unmerge").alias("outcome"), "decided_at"))
    else:
        raise ValueError(f"unknown transcript subject {kind!r}")
    return rows.orderBy(F.desc("decided_at"), "event_id").limit(limit)
