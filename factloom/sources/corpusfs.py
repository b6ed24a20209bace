"""The corpus as a tree of Markdown files: a path and a text for every live document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.views import Views

SHARD_OVER, SHARD_DEPTH, SLUG_MOST = 150, 4, 60


def slug(value: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen, at most 60 characters; `untitled` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", "untitled").otherwise(F.substring(bare, 1, SLUG_MOST))


def sharded(members: DataFrame, over: int = SHARD_OVER, depth: int = SHARD_DEPTH) -> DataFrame:
    """members (directory, name, ...) with `shard`: the directory, and letters of the name while it holds too many.

    A directory of more than `over` members is split by the next letter of their names (`other` if it is no letter or
    digit), unless all of them share it. Sizes are counts by group that are joined back, so that a directory with most
    of the corpus is spread over tasks.
    """
    out = members.withColumns({"shard": F.col("directory"), "_split": F.lit(True)})
    for d in range(1, depth + 1):
        letter = F.lower(F.substring("name", d, 1))
        out = out.withColumn("_letter", F.when(letter.rlike("[a-z0-9]"), letter).otherwise("other"))
        sizes = out.where("_split").groupBy("shard").agg(F.count("*").alias("_n"), F.countDistinct("_letter").alias("_letters"))
        big = sizes.where((F.col("_n") > over) & (F.col("_letters") > 1)).select("shard", F.lit(True).alias("_big"))
        out = out.join(big, "shard", "left").withColumn("_split", F.col("_split") & F.coalesce("_big", F.lit(False)))
        out = out.withColumn("shard", F.when(F.col("_split"), F.concat("shard", F.lit("/"), "_letter")).otherwise(F.col("shard"))).drop("_big")
    return out.drop("_split", "_letter")


def document_paths(views: Views) -> DataFrame:
    """(doc_id, path) of every live document."""
    rows = views.documents_live.select("doc_id", F.concat(F.lit("documents/"), slug(F.col("source_kind"))).alias("directory"), slug(F.coalesce("title", "doc_id")).alias("name"))
    return sharded(rows).select("doc_id", F.concat("shard", F.lit("/"), "name", F.lit("-"), slug(F.col("doc_id")), F.lit(".md")).alias("path"))


def documents_tree(views: Views, texts: DataFrame) -> DataFrame:
    """(path, content) of documents with a text: texts (doc_id, text)."""
    header = F.concat(F.lit("# "), F.coalesce("title", "doc_id"), F.lit("\n\n"))
    return views.documents_live.select("doc_id", "title").join(texts, "doc_id").join(document_paths(views), "doc_id").select("path", F.concat(header, F.coalesce("text", F.lit(""))).alias("content"))
