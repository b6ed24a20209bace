"""One object for callers: retrieval, facts, graph, change feed and gated SQL over a folder of tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import temporal
from factloom.operators import facts, graph, retrieval, search
from factloom.plans import gate
from factloom.plans.views import PUBLISHED, Views
from factloom.sources.spine import Spine


@dataclass
class Envelope:
    """An answer: named DataFrames at one instant, and what was left out."""

    parts: dict[str, DataFrame]
    evaluated_at: str
    notes: dict[str, object] = field(default_factory=dict)


class Engine:
    def __init__(self, spark: SparkSession, sf_dir: str, evaluated_at: str = "2024-01-15 00:00:00", embed=None):
        self.views, self.evaluated_at, self.embed = Views(Spine(spark, sf_dir), evaluated_at), evaluated_at, embed
        self.sandbox = gate.Sandbox(self.views, embed)

    def resolve(self, name: str, entity_type: str | None = None, context: tuple[str, ...] = ()) -> DataFrame:
        return retrieval.resolve(self.views, name, entity_type, context)

    def lookup_relations(self, **pattern) -> DataFrame:
        return facts.lookup_relations(self.views, pattern.pop("as_of", self.evaluated_at), **pattern)

    def lookup_observations(self, entity: str, as_of: str | None = None) -> DataFrame:
        return facts.lookup_observations(self.views, entity, as_of or self.evaluated_at)

    def aggregate(self, form: str, **arguments) -> DataFrame:
        return facts.aggregate(self.views, form, **arguments)

    def delta(self, since: str, **arguments) -> DataFrame:
        return facts.delta_feed(self.views, since, **arguments)

    def scan(self, kind: str) -> DataFrame:
        return facts.scan(self.views, kind)

    def transcript(self, kind: str, subject: str) -> DataFrame:
        return facts.transcript(self.views, kind, subject)

    def documents_about(self, entity: str, k: int = 20) -> DataFrame:
        return facts.documents_about(self.views, entity, k)

    def claims_about(self, entity: str, k: int = 20) -> DataFrame:
        return facts.claims_about(self.views, entity, k)

    def claims_as_of(self, start: str, end: str, k: int = 20) -> DataFrame:
        return facts.claims_as_of(self.views, start, end, k)

    def chunk_neighbors(self, chunk: str, radius: int = 1) -> DataFrame:
        return facts.chunk_neighbors(self.views, chunk, radius)

    def search_chunks(self, query: str, k: int = 10, channel: str = "semantic") -> DataFrame:
        source = self.views.spine["chunk_search"]
        nominated = retrieval.bm25_topk(self.views.chunk_postings, query, k) if channel == "lexical" else retrieval.semantic_topk(source, self.embed(query), k)
        return retrieval.hydrate(self.views, nominated, "chunk")

    def search_claims(self, query: str, k: int = 10, channel: str = "semantic") -> DataFrame:
        return search.search_claims(self.views, k, query=query) if channel == "lexical" else search.search_claims(self.views, k, self.embed(query))

    def nominate_claims(self, query: str, k: int = 10, channel: str = "semantic", entities: tuple[str, ...] = ()) -> DataFrame:
        if channel == "lexical":
            return search.nominate_lexical(self.views, query, k, entities)
        return search.nominate(self.views, "claim", self.embed(query), k, self.views.claims_live, entities)

    def search_facts(self, query: str, k: int = 10, kind: str | None = None) -> DataFrame:
        return search.search_facts(self.views, self.embed(query), k, kind=kind)

    def search_entities(self, query: str, k: int = 10, entity_type: str | None = None) -> DataFrame:
        return search.search_entities(self.views, self.embed(query), k, entity_type)

    def hydrate_relation(self, relation: str) -> DataFrame:
        return search.hydrate_relation(self.views, relation)

    def facts_for(self, query: str, entities: tuple[str, ...] = (), k: int = 15, evidence_per_fact: int = 3, mode: str = "current") -> Envelope:
        """Facts that answer a question, with their evidence."""
        rows = search.fact_context(self.views, self.embed(query), temporal.fact_time(mode, self.views.now), k + 1, entities)
        ids = [r["fact_id"] for r in rows.select("fact_id").collect()]  # k + 1 ids
        return Envelope({"facts": rows.limit(k), "evidence": facts.fact_evidence(self.views, ids[:k], evidence_per_fact)}, self.evaluated_at, {"truncated": len(ids) > k})

    def testimony_context(self, query: str, k: int = 50, candidate_k: int = 200) -> Envelope:
        return Envelope({"chunks": retrieval.testimony_chunks(self.views, self.embed(query), query, k, candidate_k)}, self.evaluated_at)

    def fact_context(self, entities: tuple[str, ...], k: int = 15, evidence_per_fact: int = 3, mode: str = "current") -> Envelope:
        """Facts that touch anchors, those that touch more of them first, with evidence shared out under one budget."""
        anchors = F.array(*map(F.lit, entities))
        touched = F.size(F.array_intersect(anchors, F.array("subject_entity_id", "object_entity_id")))
        rows = self.views.facts_visible_history.where(temporal.fact_time(mode, self.views.now)).withColumn("coverage", touched).where("coverage > 0")
        top = rows.orderBy(F.desc("coverage"), F.desc("evidence_count_current"), "fact_kind", "fact_id").limit(k + 1)
        ids = [r["fact_id"] for r in top.select("fact_id").collect()]  # k + 1 ids
        return Envelope({"facts": top.limit(k), "evidence": facts.fact_evidence(self.views, ids[:k], evidence_per_fact)}, self.evaluated_at, {"truncated": len(ids) > k})

    def answer_context(self, query: str, entities: tuple[str, ...]) -> Envelope:
        said, known = self.testimony_context(query), self.fact_context(entities)
        return Envelope(said.parts | known.parts, self.evaluated_at, known.notes)

    def multi_hop_context(self, start: str, end: str | None = None, hops: int = 2) -> Envelope:
        edges = graph.edges_of(self.views)
        if end is None:
            return Envelope({"neighborhood": graph.neighborhood(edges, start, hops)}, self.evaluated_at)
        route = graph.graph_path(edges, start, end, max(hops, 1))
        evidence = route.join(self.views.fact_claim_evidence_live.withColumnRenamed("fact_id", "relation_id"), "relation_id")
        return Envelope({"route": route, "evidence": evidence}, self.evaluated_at)

    def neighborhood(self, entity: str, hops: int = 2, valid_at: str | None = None, believed_at: str | None = None, limit: int = 500) -> DataFrame:
        return graph.neighborhood(graph.edges_of(self.views, valid_at, believed_at), entity, hops, limit)

    def path(self, start: str, end: str, max_hops: int = 4) -> DataFrame:
        return graph.shortest_path(graph.edges_of(self.views), start, end, max_hops)

    def citation_path(self, start: str, end: str, max_hops: int = 6) -> DataFrame:
        return graph.citation_path(self.views.document_crossrefs_live, start, end, max_hops)

    def fuse(self, rankings: list[DataFrame], key: str, **arguments) -> DataFrame:
        return retrieval.reciprocal_rank_fusion(rankings, key, **arguments)

    def rerank(self, items: DataFrame, key: str, signal: str) -> DataFrame:
        return retrieval.rerank_weighted(items, key) if signal == "weighted_relevance" else retrieval.rerank_by_signal(items, signal, key, ascending=signal == "graph_distance")

    def query_sql(self, sql: str, args: list | None = None, **limits) -> gate.Result:
        return self.sandbox.query(sql, args, **limits)

    def explain_sql(self, sql: str) -> str:
        return self.sandbox.explain(sql)

    def describe_query_space(self) -> dict[str, list[tuple[str, str]]]:
        return {name: getattr(self.views, name).dtypes for name in PUBLISHED}

    def search_query_space(self, query: str, k: int = 10) -> list[tuple[str, int]]:
        return gate.search_surface(query, k)
