"""Snapshots of the graph and exports of facts: immutable versions behind a pointer to the latest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.views import D, Views


def graph_table(views: Views, name: str) -> DataFrame:
    """One table of the property graph; only what it needs is made."""
    return _TABLES[name](views)


def _survivor(views: Views, column: str, name: str) -> DataFrame:
    return views.survivors.select(D, F.col("entity_id").alias(column), F.col("survivor_entity_id").alias(name))


def _entity(views: Views) -> DataFrame:
    return views.spine["entities"].where("status = 'active'").select(F.col("entity_id").alias("id"), "type", F.col("canonical_name").alias("name"), "normalized_name", F.col("profile_summary").alias("summary"), "created_at")


def _document(views: Views) -> DataFrame:
    return views.documents_live.select(F.col("doc_id").alias("id"), "title", "source_uri", "published_at")


def _relates(views: Views) -> DataFrame:
    relates = views.spine["relations"].join(_survivor(views, "subject_entity_id", "from"), [D, "subject_entity_id"]).join(_survivor(views, "object_entity_id", "to"), [D, "object_entity_id"])
    return relates.select("from", "to", "relation_id", "predicate", F.col("fact_label").alias("fact"), "evidence_count", "contradict_count", "confidence", "contradiction_group", "valid_from", "valid_until", "ingested_at", "invalidated_at")


def _mentioned_in(views: Views) -> DataFrame:
    return views.mention_current_content.where("survivor_entity_id IS NOT NULL").groupBy(F.col("survivor_entity_id").alias("from"), F.col("doc_id").alias("to")).agg(F.count("*").alias("mention_count"), F.min("created_at").alias("first_seen"))


def _doc_crossref(views: Views) -> DataFrame:
    return views.spine["document_crossrefs"].where("resolved").select(F.col("from_doc_id").alias("from"), F.col("to_doc_id").alias("to"), "kind", "context")


def _is_document(views: Views) -> DataFrame:
    return views.spine["documents"].where("document_entity_id IS NOT NULL").join(_survivor(views, "document_entity_id", "from"), [D, "document_entity_id"]).select("from", F.col("doc_id").alias("to"))


_TABLES = {"entity": _entity, "document": _document, "relates": _relates, "mentioned_in": _mentioned_in, "doc_crossref": _doc_crossref, "is_document": _is_document}


def graph_tables(views: Views) -> dict[str, DataFrame]:
    """The property graph: nodes, documents, relations between survivors, mentions, references and entity documents."""
    return {name: graph_table(views, name) for name in _TABLES}


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    hadoop, fs = _filesystem(spark, path)
    out = fs.create(hadoop, True)
    out.write(bytearray(text.encode()))
    out.close()


def publish(views: Views, root: str, version: str) -> dict[str, int]:
    """Write a version of the graph and make it the latest once its tables count back as they were written."""
    spark, counts = views.spine.spark, {}
    for name, rows in graph_tables(views).items():
        rows.write.mode("errorifexists").parquet(f"{root}/{version}/{name}")
        counts[name] = spark.read.parquet(f"{root}/{version}/{name}").count()
    _write_text(spark, f"{root}/{version}/manifest.json", json.dumps({"version": version, "row_counts": counts}, sort_keys=True))
    point(spark, root, version)
    return counts


def pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the pointers to versions, in order."""
    folder, fs = _filesystem(spark, f"{root}/pointers")
    names = [str(f.getPath().getName()) for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def point(spark: SparkSession, root: str, version: str) -> None:
    """Make a version the latest: a new pointer under the next number, put there whole by a rename. Earlier ones stay, so
    that readers find one at any time; of two publishers with one number the second fails."""
    number = max(pointers(spark, root), default=0) + 1
    _write_text(spark, f"{root}/pointers/{version}.tmp", version)
    source, fs = _filesystem(spark, f"{root}/pointers/{version}.tmp")
    target, _ = _filesystem(spark, f"{root}/pointers/{number}")
    if fs.exists(target) or not fs.rename(source, target):
        raise OSError(f"cannot publish {version}")


def latest(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the version that the pointer of the greatest number names."""
    version = spark.read.text(f"{root}/pointers/{max(pointers(spark, root))}").first()[0]
    manifest = json.loads(spark.read.text(f"{root}/{version}/manifest.json", wholetext=True).first()[0])
    return {name: spark.read.parquet(f"{root}/{version}/{name}") for name in manifest["row_counts"]}
