"""Ranking: vector and lexical top-k, rank fusion, reranks, confirmation against the published views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.postings import Postings
from factloom.plans.views import D, Views

RRF_K = 60
K1, B = 1.2, 0.75


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def ranked(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their rank from 1: a top-k per task, then one sort of k rows a task."""
    top = rows.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def semantic_topk(rows: DataFrame, vector: list[float], k: int, key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """(key, score, rank): the k nearest by cosine, ties by key. Rows without a vector take no part."""
    scored = rows.where(F.col(embedding).isNotNull()).select(key, cosine(F.col(embedding), F.array(*(F.lit(float(x)) for x in vector))).alias("score"))
    return ranked(scored, [F.desc("score"), F.asc(key)], k)


def bm25_topk(postings: Postings, query: str, k: int, only: DataFrame | None = None) -> DataFrame:
    """(key, score, rank): the k best of the postings' rows by BM25, ties by key; of those whose key is in only, scored
    among all. Only the query's own terms are read."""
    asked, some = postings.frequencies(query)
    if only is not None:
        some = some.join(only.select(postings.key), postings.key, "left_semi")
    score = sum(
        (F.when(F.col(f"tf{i}") > 0, F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("length") / F.col("mean")))).otherwise(0.0) for i in range(len(asked))),
        F.lit(0.0),
    )
    return ranked(some.select(postings.key, score.alias("score")), [F.desc("score"), F.asc(postings.key)], k)


def reciprocal_rank_fusion(channels: list[DataFrame], key: str, k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """(key, score, signals): the sum over channels of 1 / (k + best rank), ties by key. channels: (key, rank)."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    parts = [c.groupBy(key).agg(F.min("rank").alias("rank")).select(key, F.lit(f"channel_{i}").alias("channel"), (1.0 / (k + F.col("rank"))).alias("part")) for i, c in enumerate(channels)]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    fused = both.groupBy(key).agg(F.sum("part").alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "part")))).alias("signals"))
    fused = fused.orderBy(F.desc("score"), key)
    return fused if limit is None else fused.limit(limit)


def rerank_by_signal(items: DataFrame, signal: str, key: str, ascending: bool = False) -> DataFrame:
    """Items (key, score, signal) by a signal; those without it come last and keep their score."""
    order = F.asc_nulls_last(signal) if ascending else F.desc_nulls_last(signal)
    return items.withColumn("score", F.coalesce(F.col(signal).cast("double"), F.col("score"))).orderBy(order, key)


def rerank_weighted(items: DataFrame, key: str, distance: str = "graph_distance", evidence: str = "evidence_count", weights: tuple[float, float] = (0.10, 0.10)) -> DataFrame:
    """score relative to the best, plus weighted closeness and evidence, each min-max scaled over the items that have it."""
    bounds = items.agg(*(f(c).alias(f"{n}_{c}") for c in ("score", distance, evidence) for n, f in (("lo", F.min), ("hi", F.max))))
    wide = items.crossJoin(F.broadcast(bounds))  # one row

    def scaled(column: str, up: bool) -> Column:
        lo, hi, v = F.col(f"lo_{column}"), F.col(f"hi_{column}"), F.col(column)
        return F.when(v.isNull(), 0.0).when(lo == hi, 1.0).otherwise((v - lo if up else hi - v) / (hi - lo))

    base = F.when(F.col("hi_score") > 0, F.greatest(F.col("score"), F.lit(0.0)) / F.col("hi_score")).otherwise(scaled("score", True))
    total = base + weights[0] * scaled(distance, False) + weights[1] * scaled(evidence, True)
    return wide.withColumn("score", total).select(*items.columns).orderBy(F.desc("score"), key)


def confirm(nominations: DataFrame, view: DataFrame, key: str, passes: Column | None = None) -> DataFrame:
    """nominations (key, rank, score) with outcome: kept, dropped_stale (not in the view), dropped_ambiguous (twice in it)
    or dropped_filtered. Ranks keep their gaps."""
    seen = view.groupBy(key).agg(F.count("*").alias("_n"), F.max(F.lit(True) if passes is None else F.coalesce(passes, F.lit(False))).alias("_pass"))
    state = F.when(F.col("_n").isNull(), "dropped_stale").when(F.col("_n") > 1, "dropped_ambiguous").when(~F.col("_pass"), "dropped_filtered").otherwise("kept")
    return nominations.join(seen, key, "left").withColumn("outcome", state).drop("_n", "_pass")


def resolve(views: Views, name: str, entity_type: str | None = None, context: tuple[str, ...] = ()) -> DataFrame:
    """Visible entities with an alias of this lemma, those that touch the context entities first; none is picked."""
    if len(context) > 8:
        raise ValueError("8 context entities at most")
    named = views.entity_aliases_current.where(F.col("normalized_lemma") == name.lower()).select(D, "entity_id").distinct()
    found = views.entities_current.join(named, [D, "entity_id"], "left_semi").select(D, "entity_id", "canonical_name", "entity_type")
    if entity_type:
        found = found.where(F.col("entity_type") == entity_type)
    edges = views.graph_edges_current.select("subject_entity_id", "object_entity_id")
    ends = edges.toDF("entity_id", "other").unionByName(edges.toDF("other", "entity_id").select("entity_id", "other"))
    hits = ends.where(F.col("other").isin(list(context))).groupBy("entity_id").agg(F.countDistinct("other").alias("context_hits"))
    return found.join(hits, "entity_id", "left").fillna(0, ["context_hits"]).orderBy(F.desc("context_hits"), "canonical_name", "entity_id").drop(D)


def hydrate(views: Views, items: DataFrame, grain: str) -> DataFrame:
    """Ranked ids (claim_id or chunk_id, rank) with the live rows behind them, in rank order."""
    view = {"claim": views.claims_live, "chunk": views.chunks_live}[grain]
    return items.join(view, f"{grain}_id").orderBy("rank")


def group_exact_text(claims: DataFrame) -> DataFrame:
    """Claims in rank order grouped by text with white space and case folded: the first stands for its group."""
    text = F.lower(F.trim(F.regexp_replace("claim_text", r"\s+", " ")))
    return claims.groupBy(text.alias("normalized_text")).agg(F.min_by("claim_id", "rank").alias("claim_id"), F.min("rank").alias("rank"), F.countDistinct("doc_id").alias("corroboration_count")).orderBy("rank")


def testimony_chunks(views: Views, vector: list[float], query: str, k: int = 50, candidate_k: int = 200) -> DataFrame:
    """Hybrid nomination of chunks, fused, confirmed against the live view, capped at k."""
    source = views.spine["chunk_search"]
    fused = reciprocal_rank_fusion([semantic_topk(source, vector, candidate_k), bm25_topk(views.chunk_postings, query, candidate_k)], "chunk_id")
    placed = ranked(fused.select("chunk_id", "score"), [F.desc("score"), F.asc("chunk_id")], 2 * candidate_k)
    live = views.chunks_live.select("chunk_id", "doc_id", "version_id")
    return placed.join(live, "chunk_id").orderBy("rank").limit(k)
