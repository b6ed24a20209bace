"""Search over claims, facts and entities, their vectors, and facts for a question.

Items name their vector; equal texts share one. A question is compared with each vector once, and only ids, scores and
ranks go through the joins with the published views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.postings import Postings
from factloom.operators.retrieval import bm25_topk, cosine, ranked
from factloom.plans.views import Views


def scored_vectors(views: Views, vector: list[float]) -> DataFrame:
    """(vec_id, score) of every stored vector against the question's."""
    asked = F.array(*(F.lit(float(x)) for x in vector))
    return views.spark_vectors.where("embedding IS NOT NULL").select("vec_id", cosine(F.col("embedding"), asked).alias("score"))


def coverage(views: Views, entities: tuple[str, ...]) -> DataFrame:
    """(claim_id, coverage): how many of the entities a claim mentions, where it does any."""
    hit = views.mentions_live.where(F.col("resolved_entity_id").isin(list(entities)) & F.col("claim_id").isNotNull())
    return hit.groupBy("claim_id").agg(F.countDistinct("resolved_entity_id").alias("coverage"))


def nominate(views: Views, grain: str, vector: list[float], k: int, live: DataFrame, entities: tuple[str, ...] = ()) -> DataFrame:
    """(key, score, rank) of the k nearest items of live, a table of keys; with entities only claims that mention some,
    those that mention more first. Ties go to the smaller key."""
    key = f"{grain}_id"
    items = views.spine[f"{grain}_search"].select(key, "vec_id").join(live.select(key), key, "left_semi")
    found = items.join(scored_vectors(views, vector), "vec_id").drop("vec_id")
    if not entities:
        return ranked(found.select(key, "score"), [F.desc("score"), F.asc(key)], k)
    found = found.join(coverage(views, entities), key)
    return ranked(found.select(key, "coverage", "score"), [F.desc("coverage"), F.desc("score"), F.asc(key)], k)


def nominate_lexical(views: Views, query: str, k: int, entities: tuple[str, ...] = ()) -> DataFrame:
    """(claim_id, score, rank): current claims by BM25; with entities only those that mention some."""
    if not entities:
        return bm25_topk(views.claim_postings, query, k)
    rows = views.spine["claim_search"].join(views.claims_live.select("claim_id"), "claim_id", "left_semi")
    rows = rows.join(coverage(views, entities).select("claim_id"), "claim_id", "left_semi")
    return bm25_topk(Postings(rows, "claim_id", "search_text"), query, k)


def search_claims(views: Views, k: int, vector: list[float] | None = None, query: str | None = None) -> DataFrame:
    """Live claims in rank order, by vector or by words."""
    found = nominate(views, "claim", vector, k, views.claims_live) if vector is not None else nominate_lexical(views, query, k)
    return found.join(views.claims_live.select("claim_id", "claim_text", "doc_id", "source_handle"), "claim_id").orderBy("rank")


def search_facts(views: Views, vector: list[float], k: int, facts: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """(fact_kind, fact_id, score, rank): the k best of each kind, and of them the k best."""
    facts = views.facts_current if facts is None else facts
    items = views.spine["fact_search"].join(facts.select("fact_kind", "fact_id"), ["fact_kind", "fact_id"], "left_semi").join(scored_vectors(views, vector), "vec_id")
    order = [F.desc("score"), F.asc("fact_kind"), F.asc("fact_id")]
    kinds = [kind] if kind else ["observation", "relation"]
    best = [items.where(F.col("fact_kind") == one).orderBy(*order).limit(k) for one in kinds]
    both = best[0] if len(best) == 1 else best[0].unionByName(best[1])
    return ranked(both.select("fact_kind", "fact_id", "score"), order, k)


def search_entities(views: Views, vector: list[float], k: int, entity_type: str | None = None) -> DataFrame:
    live = views.entities_current if entity_type is None else views.entities_current.where(F.col("entity_type") == entity_type)
    return nominate(views, "entity", vector, k, live)


def vectors_of(views: Views, grain: str, ids: list[str]) -> DataFrame:
    """(key, embedding) of a bounded list of claims or entities."""
    key = f"{grain}_id"
    return views.spine[f"{grain}_search"].where(F.col(key).isin(ids)).select(key, "vec_id").join(views.spark_vectors.select("vec_id", "embedding"), "vec_id").select(key, "embedding")


def reusable_embeddings(chunks: DataFrame, stored: DataFrame, model: str, policy: str) -> DataFrame:
    """(chunk_id, embedding): stored vectors of the same text hash under the same model and input policy."""
    same = stored.where((F.col("embedding_model") == model) & (F.col("embedding_input_policy_version") == policy) & F.col("embedding").isNotNull())
    return chunks.select("chunk_id", "embedding_text_hash").join(same.select("embedding_text_hash", "embedding"), "embedding_text_hash").select("chunk_id", "embedding")


def rerank_bounded(views: Views, ids: list[str], vector: list[float], k: int) -> DataFrame:
    """(claim_id, score, rank) of a bounded list of claims by cosine."""
    items = views.spine["claim_search"].where(F.col("claim_id").isin(ids)).join(scored_vectors(views, vector), "vec_id")
    return ranked(items.select("claim_id", "score"), [F.desc("score"), F.asc("claim_id")], k)


def hydrate_relation(views: Views, relation: str) -> DataFrame:
    """A visible relation with the claims behind it and their documents, supporting ones last told first."""
    fact = views.facts_visible_history.where((F.col("fact_kind") == "relation") & (F.col("fact_id") == relation)).select("fact_id", "predicate", "valid_from", "valid_until")
    told = views.fact_claim_evidence_live.where(F.col("fact_kind") == "relation").select("fact_id", "claim_id", "stance", "doc_id", "asserted_at")
    sources = views.documents_live.select("doc_id", "title", "source_kind")
    return fact.join(told, "fact_id", "left").join(sources, "doc_id", "left").orderBy("stance", F.desc_nulls_last("asserted_at"), "claim_id")


def fact_context(views: Views, vector: list[float], held: Column, k: int = 15, entities: tuple[str, ...] = (), nominated: int = 200) -> DataFrame:
    """Facts for a question: nominated by vector, confirmed against the visible facts that held allows, those that touch
    more of the entities first, then by rank."""
    visible = views.facts_visible_history.where(held)
    found = search_facts(views, vector, nominated, visible).select("fact_kind", "fact_id", "rank")
    anchors = F.array(*map(F.lit, entities)).cast("array<string>")
    touched = F.size(F.array_intersect(anchors, F.array("subject_entity_id", "object_entity_id")))
    rows = found.join(visible, ["fact_kind", "fact_id"]).withColumn("coverage", touched)
    return rows.orderBy(F.desc("coverage"), "rank", "fact_kind", "fact_id").limit(k)


def reextracted(views: Views, extractor: str) -> DataFrame:
    """Current claims of another extractor in a document's current version that this extractor does not carry there."""
    live = views.chunks_live.select("chunk_id")
    claims = views.spine["claims"].where("is_current_testimony")
    carried = views.spine["chunk_claims"].join(live, "chunk_id", "left_semi").join(claims.where(F.col("extractor_version") == extractor).select("claim_id"), "claim_id", "left_semi").select("claim_id")
    return claims.where(F.col("extractor_version") != extractor).join(live, "chunk_id", "left_semi").join(carried, "claim_id", "left_anti").select("claim_id", "doc_id", "extractor_version")


def removal_cascade(views: Views, doc: str) -> DataFrame:
    """What taking a document away does to relations: (relation_id, supports, closes), the distinct documents of current
    supporting claims that are left, and whether none is."""
    claims = views.spine["claims"].where("is_current_testimony").select("claim_id")
    told = views.spine["relation_evidence"].where("stance = 'supports'").join(claims, "claim_id", "left_semi")
    hit = told.where(F.col("doc_id") == doc).select("relation_id").distinct()
    left = told.where(F.col("doc_id") != doc).groupBy("relation_id").agg(F.countDistinct("doc_id").alias("supports"))
    counted = hit.join(left, "relation_id", "left").fillna(0, ["supports"])
    open_ones = views.spine["relations"].where("invalidated_at IS NULL AND valid_until IS NULL").select("relation_id", F.lit(True).alias("open"))
    return counted.join(open_ones, "relation_id", "left").select("relation_id", "supports", ((F.col("supports") == 0) & F.coalesce("open", F.lit(False))).alias("closes"))


def evaluate_resolution(decided: DataFrame, truth: DataFrame) -> DataFrame:
    """(entity_type, decided, right, precision, recall) of decisions (mention_id, entity_id) against truth (mention_id,
    true_entity, entity_type)."""
    rows = truth.join(decided, "mention_id", "left")
    out = rows.groupBy("entity_type").agg(F.count("entity_id").alias("decided"), F.count_if(F.col("entity_id") == F.col("true_entity")).alias("right"), F.count("*").alias("mentions"))
    share = lambda of: F.when(F.col(of) > 0, F.round(F.col("right") / F.col(of), 6))
    return out.select("entity_type", "decided", "right", share("decided").alias("precision"), share("mentions").alias("recall"))
