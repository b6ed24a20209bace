"""Forgetting documents: what their lineages own in every table, the tables without it, and a count of what is left.

A document owns its versions, sections, chunks, claims and mentions, facts that nothing else bears out, and entities that
nothing else mentions or states anything about. Tables are rewritten by anti-joins, one for each column that may name what
is owned.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.checkpoint import cut

#: Table: its columns that name what a lineage may own, and of which kind.
OWNED: dict[str, tuple[tuple[str, str], ...]] = {
    "documents": (("doc_id", "document"),), "document_versions": (("doc_id", "document"),), "document_representations": (("version_id", "version"),), "document_sections": (("doc_id", "document"),),
    "chunks": (("doc_id", "document"),), "chunk_search": (("chunk_id", "chunk"),), "claims": (("doc_id", "document"),), "claim_search": (("claim_id", "claim"),), "chunk_claims": (("chunk_id", "chunk"), ("claim_id", "claim")),
    "mentions": (("doc_id", "document"),), "resolution_decisions": (("mention_id", "mention"),), "entities": (("entity_id", "entity"),), "aliases": (("entity_id", "entity"),), "entity_search": (("entity_id", "entity"),), "merge_events": (("survivor_id", "entity"), ("absorbed_id", "entity")),
    "relations": (("relation_id", "relation"),), "relation_evidence": (("doc_id", "document"), ("relation_id", "relation")), "relation_adjudications": (("relation_id", "relation"), ("related_relation_id", "relation")),
    "observations": (("observation_id", "observation"),), "observation_evidence": (("doc_id", "document"), ("observation_id", "observation")), "observation_adjudications": (("observation_id", "observation"),), "fact_search": (("fact_id", "relation"), ("fact_id", "observation")),
    "testimony_currency_events": (("doc_id", "document"),), "document_crossrefs": (("from_doc_id", "document"), ("to_doc_id", "document")), "knowledge_artifact_evidence": (("claim_lineage_id", "document"), ("doc_id", "document"), ("relation_id", "relation")), "processing_state": (("target_id", "document"),),
}


def manifest(tables: Mapping[str, DataFrame], docs: DataFrame) -> DataFrame:
    """(kind, id) of all that the lineages of docs (doc_id) own."""
    asked = cut(docs.select("doc_id").distinct())
    mine = lambda table, column, kind: tables[table].join(asked, "doc_id", "left_semi").select(F.lit(kind).alias("kind"), F.col(column).alias("id"))
    out = mine("documents", "doc_id", "document")
    for table, column, kind in (("document_versions", "version_id", "version"), ("chunks", "chunk_id", "chunk"), ("claims", "claim_id", "claim"), ("mentions", "mention_id", "mention")):
        out = out.union(mine(table, column, kind))
    marked = asked.select(F.col("doc_id"), F.lit(True).alias("goes"))
    kept_ends, facts = None, None
    for kind in ("relation", "observation"):
        key = f"{kind}_id"
        told = tables[f"{kind}_evidence"].join(marked, "doc_id", "left").groupBy(key).agg(F.count("goes").alias("gone"), F.count("*").alias("all"))
        alone = cut(told.where("gone = all").select(key))
        ends = ["subject_entity_id", "object_entity_id"] if kind == "relation" else ["subject_entity_id"]
        left = tables[f"{kind}s"].join(alone, key, "left_anti").select(F.explode(F.array(*ends)).alias("entity_id"))
        named = alone.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
        kept_ends, facts = (left, named) if facts is None else (kept_ends.union(left), facts.union(named))
    told = tables["mentions"].select("mention_id", "doc_id").join(tables["resolution_decisions"].select("mention_id", "entity_id"), "mention_id").join(marked, "doc_id", "left")
    only = told.groupBy("entity_id").agg(F.count("goes").alias("gone"), F.count("*").alias("all")).where("gone = all").select("entity_id")
    lonely = only.join(kept_ends.distinct(), "entity_id", "left_anti").select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"))
    return out.union(facts).union(lonely).distinct()


def scrubbed(table: DataFrame, name: str, owned: DataFrame) -> DataFrame:
    """The rows of a table that name nothing owned."""
    for column, kind in OWNED.get(name, ()):
        table = table.join(owned.where(F.col("kind") == kind).select(F.col("id").alias(column)), column, "left_anti").select(*table.columns)
    return table


class Scrubbed(Mapping):
    """The base tables without what is owned, each rewritten when it is first asked for."""

    def __init__(self, tables: Mapping[str, DataFrame], owned: DataFrame):
        self.tables, self.owned, self.made = tables, cut(owned), {}
        self.spark = owned.sparkSession
        self.sf_dir = getattr(tables, "sf_dir", None)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            table = self.tables[name]
            self.made[name] = cut(scrubbed(table, name, self.owned)) if name in OWNED else table
        return self.made[name]

    def __iter__(self):
        return iter(OWNED)

    def __len__(self) -> int:
        return len(OWNED)


def remains(tables: Mapping[str, DataFrame], owned: DataFrame) -> DataFrame:
    """(table_name, kept, remaining): rows of each table, and how many of them still name something owned."""
    out = None
    for name, columns in OWNED.items():
        rows = tables[name].select(*dict.fromkeys(c for c, _ in columns))
        for k, (column, kind) in enumerate(columns):
            held = owned.where(F.col("kind") == kind).select(F.col("id").alias(f"own{k}"))
            rows = rows.join(held, F.col(column) == F.col(f"own{k}"), "left")
        named = F.coalesce(*(F.col(f"own{k}") for k in range(len(columns)))).isNotNull()
        one = rows.agg(F.count("*").alias("kept"), F.count_if(named).alias("remaining")).select(F.lit(name).alias("table_name"), "kept", "remaining")
        out = one if out is None else out.union(one)
    return out
