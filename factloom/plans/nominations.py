"""Table functions of search: nominations among live rows, filters of a fixed vocabulary, and the columns they publish."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import retrieval, search
from factloom.operators.sections import ROLES
from factloom.plans.views import Views

K_DEFAULT, K_MOST, BODIES_MOST = 20, 100, 50
#: Filters of each target, and the columns that it publishes after rank, score and channel.
FILTERS = {
    "claims": ("doc_id", "source_kind", "entity_id", "asserted_from", "asserted_to"), "chunks": ("doc_id", "source_kind", "section_role", "language"),
    "facts": ("fact_kind", "predicate", "subject_entity_id", "object_entity_id", "support_state"), "entities": ("entity_type",),
}
COLUMNS = {
    "claims": ("claim_id", "doc_id", "claim_text", "source_handle", "source_kind", "asserted_at", "claim_valid_from", "claim_valid_until"),
    "chunks": ("chunk_id", "doc_id", "version_id", "representation_id", "section_id", "chunk_content_hash", "embedding_text_hash", "source_text", "embedding_input_policy_version", "created_at"),
    "facts": ("fact_id", "fact_kind", "fact_label", "predicate", "subject_entity_id", "object_entity_id", "evidence_count", "contradict_count", "support_state", "evaluated_at"),
    "entities": ("entity_id", "entity_type", "canonical_name", "profile_summary", "live_mention_count", "live_document_count"),
}
VALUES = {"fact_kind": ("relation", "observation"), "support_state": ("current", "withdrawn"), "section_role": ROLES}


class Refused(ValueError):
    """A statement that may not run; code is stable."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


def checked_filters(target: str, text: str | None) -> dict[str, str]:
    """The filters of a JSON object; Refused for a key, shape or value that the target doesn't have."""
    try:
        found = json.loads(text) if text else {}
    except ValueError:
        raise Refused("INVALID_PARAMETER", "filters are a JSON object") from None
    if not isinstance(found, dict):
        raise Refused("INVALID_PARAMETER", "filters are a JSON object")
    for key, value in found.items():
        if key not in FILTERS[target]:
            raise Refused("INVALID_PARAMETER", f"{key} is no filter of {target}")
        if not isinstance(value, str) or not value or value not in VALUES.get(key, (value,)):
            raise Refused("INVALID_PARAMETER", f"{key} can't be {value!r}")
        if key.startswith("asserted_"):
            try:
                dt.datetime.fromisoformat(value)
            except ValueError:
                raise Refused("INVALID_PARAMETER", f"{key} is an ISO 8601 instant") from None
    return found


def bounded_k(asked: object) -> int:
    if asked is None:
        return K_DEFAULT
    if isinstance(asked, bool) or not isinstance(asked, int) or asked < 1:
        raise Refused("INVALID_PARAMETER", "k is a whole number from 1")
    return min(asked, K_MOST)


def chunk_bodies(views: Views) -> DataFrame:
    """Live chunks with the text that the search store has for them, where both tell the same text's hash."""
    stored = views.spine["chunk_search"].select("chunk_id", F.col("search_text").alias("source_text"), "embedding_input_policy_version", F.col("embedding_text_hash").alias("_hash"))
    return views.chunks_live.join(stored, "chunk_id").where("embedding_text_hash = _hash").drop("_hash")


def live(views: Views, target: str, filters: dict[str, str]) -> DataFrame:
    """The target's live rows that the filters let through."""
    if target == "claims":
        rows = views.claims_live
        if "entity_id" in filters:
            rows = rows.join(views.mentions_live.where(F.col("resolved_entity_id") == filters["entity_id"]).select("claim_id").distinct(), "claim_id", "left_semi")
    elif target == "chunks":
        rows = chunk_bodies(views)
        if {"source_kind", "language"} & set(filters):
            rows = rows.join(views.documents_live.select("doc_id", "source_kind", "language"), "doc_id")
        if "section_role" in filters:
            rows = rows.join(views.sections_live.select("section_id", F.col("role").alias("section_role")).distinct(), "section_id")
    else:
        rows = views.facts_current if target == "facts" else views.entities_current
    for key, value in filters.items():
        if key == "asserted_from":
            rows = rows.where(F.col("asserted_at") >= F.lit(value).cast("timestamp_ntz"))
        elif key == "asserted_to":
            rows = rows.where(F.col("asserted_at") <= F.lit(value).cast("timestamp_ntz"))
        elif key != "entity_id":
            rows = rows.where(F.col(key) == value)
    return rows


def nominated(views: Views, name: str, args: list, embed) -> DataFrame:
    """Rows of a search function (question, k, filters): rank, score, channel and the target's published columns."""
    channel, target = name.split("_")
    if not args or not isinstance(args[0], str):
        raise Refused("INVALID_PARAMETER", f"{name} takes a question")
    k, filters = bounded_k(args[1] if len(args) > 1 else None), checked_filters(target, args[2] if len(args) > 2 else None)
    if channel == "semantic" and embed is None:
        raise Refused("NO_EMBEDDER", "semantic functions need an embedding function")
    rows = live(views, target, filters)
    if target == "claims":
        found = retrieval.bm25_topk(views.claim_postings, args[0], k, rows if filters else None) if channel == "lexical" else search.nominate(views, "claim", embed(args[0]), k, rows)
    elif target == "chunks":
        store = views.spine["chunk_search"].join(rows.select("chunk_id"), "chunk_id", "left_semi")
        found = retrieval.bm25_topk(views.chunk_postings, args[0], k, rows) if channel == "lexical" else retrieval.semantic_topk(store, embed(args[0]), k)
    elif target == "facts":
        found = search.search_facts(views, embed(args[0]), k, rows, filters.get("fact_kind"))
    else:
        found = search.nominate(views, "entity", embed(args[0]), k, rows)
    keys = {"claims": ["claim_id"], "chunks": ["chunk_id"], "facts": ["fact_kind", "fact_id"], "entities": ["entity_id"]}[target]
    out = found.join(rows.select(*COLUMNS[target]), keys)  # k ids meet the live rows
    return out.select("rank", "score", F.lit(channel).alias("channel"), *COLUMNS[target])


def bodies(views: Views, ids: list) -> DataFrame:
    """(ordinal, chunk_id, doc_id, version_id, section_id, char_start, char_end, source_text) of the asked chunks that are
    live and whose stored text is that of the live chunk, in the order asked for."""
    if not isinstance(ids, (list, tuple)) or not all(isinstance(i, str) for i in ids) or len(ids) > BODIES_MOST:
        raise Refused("INVALID_PARAMETER", f"fetch_chunk_bodies takes an array of {BODIES_MOST} ids at most")
    asked = views.spine.spark.createDataFrame([(i, c) for i, c in enumerate(dict.fromkeys(ids))], "ordinal int, chunk_id string")
    rows = chunk_bodies(views).select("chunk_id", "doc_id", "version_id", "section_id", "char_start", "char_end", "source_text")
    return rows.join(F.broadcast(asked), "chunk_id").select("ordinal", *rows.columns)  # 50 ids
