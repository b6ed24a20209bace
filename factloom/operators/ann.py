"""Approximate nearest neighbours by a learned coarse quantiser: vectors stored by their centroid, so that a probe reads
the files of few centroids.

Centroids are k-means by cosine over a bounded sample; every row is indexed, as a unit vector, in the list of its
nearest centroid. How many lists a probe reads is measured when the index is built: as many as sampled queries need for
the recall that is asked for, against the exact search.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bounds: rows that centroids are fitted on, centroids, queries that recall is measured with.
FIT_ROWS, LISTS_MOST, TRIAL_QUERIES = 65_536, 4_096, 64
RECALL, K = 0.95, 10
#: Rows of a list that one task compares with its queries.
PART_ROWS = 8_192


def unit_rows(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): unit vectors of the rows that have a key and a finite vector with a length."""
    x = rows[vector].cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = rows.where(rows[key].isNotNull() & x.isNotNull() & finite).select(key, x.alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    return kept.withColumn("size", size).where("size > 0").select(key, F.transform("v", lambda c: c / F.col("size")).alias("v"))


@dataclass
class Index:
    path: str
    key: str
    key_type: str
    centroids: np.ndarray
    sizes: list[int]
    probes: int
    recall: float

    @property
    def schema(self) -> str:
        return f"{self.key} {self.key_type}, v array<double>, list int"

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/lists")

    def nearest_lists(self, vector: list[float], probes: int | None = None) -> list[int]:
        return [int(i) for i in np.argsort(-(self.centroids @ np.asarray(vector, float)), kind="stable")[: probes or self.probes]]


def fit_centroids(units: DataFrame, key: str, lists: int, seed: int = 3) -> np.ndarray:
    """Unit centroids of up to FIT_ROWS rows, those with the smallest hashes of their keys."""
    sample = units.orderBy(F.xxhash64(key), key).limit(FIT_ROWS).select(array_to_vector("v").alias("features"))
    model = KMeans(k=lists, maxIter=10, seed=seed, distanceMeasure="cosine").fit(sample)
    found = np.array(model.clusterCenters())
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def build(rows: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, recall: float = RECALL, k: int = K) -> Index | None:
    """Store the rows with a usable vector under path, by list; None where there is no such row."""
    spark, units = rows.sparkSession, unit_rows(rows, key, vector)
    n = units.count()
    if not n:
        return None
    lists = max(1, min(lists or round(n**0.5), LISTS_MOST, n))
    centroids = fit_centroids(units, key, lists) if n > 1 else np.array(units.first()["v"])[None]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("v").to_pylist()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((x @ centroids.T).argmax(1), pa.int32())], names=[*batch.schema.names, "list"])

    key_type = dict(units.dtypes)[key]
    placed = units.mapInArrow(place, f"{key} {key_type}, v array<double>, list int")
    # by ranges of list and key, so that a list that holds much of the table is many files of many tasks
    placed.repartitionByRange("list", key).write.partitionBy("list").mode("overwrite").parquet(f"{path}/lists")
    index = Index(path, key, key_type, centroids, [0] * len(centroids), len(centroids), 1.0)
    for r in index.vectors(spark).groupBy("list").count().collect():  # a row for each list
        index.sizes[r["list"]] = r["count"]
    index.probes, index.recall = fewest_probes(index, spark, recall, k)
    about = spark.createDataFrame([(json.dumps({"key": key, "key_type": key_type, "centroids": index.centroids.tolist(), "sizes": index.sizes, "probes": index.probes, "recall": index.recall}),)], "about string")
    about.write.mode("overwrite").text(f"{path}/about")
    return index


def load(spark: SparkSession, path: str) -> Index:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return Index(path, about["key"], about["key_type"], np.array(about["centroids"]), about["sizes"], about["probes"], about["recall"])


def fewest_probes(index: Index, spark: SparkSession, recall: float, k: int) -> tuple[int, float]:
    """(probes, recall): the fewest lists that hold so much of the exact k nearest of sampled queries, and how much."""
    queries = index.vectors(spark).orderBy(F.xxhash64(index.key), index.key).limit(TRIAL_QUERIES)
    asked = {str(r[index.key]): np.array(r["v"]) for r in queries.collect()}
    exact = search(index, queries.select(F.col(index.key).alias("query_id"), "v"), k, probes=len(index.centroids))
    where = exact.join(index.vectors(spark).select(F.col(index.key), "list"), index.key).select("query_id", "list").collect()  # TRIAL_QUERIES x k
    rank = {q: np.argsort(np.argsort(-(index.centroids @ v), kind="stable")) for q, v in asked.items()}
    needed = np.sort([rank[str(r["query_id"])][r["list"]] for r in where])
    if not len(needed):
        return len(index.centroids), 1.0
    at = min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)
    probes = int(needed[at]) + 1
    return probes, float((needed < probes).mean())


def nearest(index: Index, spark: SparkSession, vector: list[float], k: int = K, probes: int | None = None) -> DataFrame:
    """(key, score, rank): the k nearest by cosine in the lists nearest to the vector; only their files are read."""
    v = np.asarray(vector, float)
    size = float(np.linalg.norm(v))
    unit = (v / size if size else v).tolist()
    rows = index.vectors(spark).where(F.col("list").isin(index.nearest_lists(unit, probes)))
    dot = F.aggregate(F.zip_with("v", F.array(*map(F.lit, unit)), lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c)
    order = [F.desc("score"), F.asc(index.key)]
    top = rows.select(index.key, dot.alias("score")).orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def search(index: Index, queries: DataFrame, k: int = K, probes: int | None = None) -> DataFrame:
    """(query_id, rank, key, score): the k nearest of each query (query_id, v unit vector) by cosine, itself left out.

    Queries go to the lists nearest to them, a list that holds many rows being several parts, and each part is compared
    with its queries at once.
    """
    spark, centroids, taken = queries.sparkSession, index.centroids, probes or index.probes
    parts = np.array([max(1, -(-n // PART_ROWS)) for n in index.sizes])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("v").to_pylist()).reshape(batch.num_rows, centroids.shape[1])
            near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :taken]
            to = [(i, lst, p) for i, own in enumerate(near) for lst in own for p in range(parts[lst])]
            i, lst, p = (np.array(c, np.int64) for c in zip(*to, strict=True)) if to else (np.zeros(0, np.int64),) * 3
            picked = batch.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(lst, pa.int32()), pa.array(p, pa.int32())], names=["query_id", "v", "list", "part"])

    key_type = dict(queries.dtypes)["query_id"]
    sent = queries.select("query_id", "v").mapInArrow(send, f"query_id {key_type}, v array<double>, list int, part int")
    counts = spark.createDataFrame([(i, int(p)) for i, p in enumerate(parts)], "list int, parts int")  # a row for each list
    held = index.vectors(spark).join(F.broadcast(counts), "list").withColumn("part", F.pmod(F.xxhash64(index.key), F.col("parts")).cast("int")).drop("parts")
    names = ["query_id", index.key, "score"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (right["query_id"].type, left[index.key].type, pa.float64()), strict=True)})
        x, q = (np.array(t["v"].to_pylist()) for t in (left, right))
        ids, asked = left[index.key].to_numpy(), right["query_id"].to_numpy()
        found = []
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        for at in range(0, len(q), 256):
            scores = q[at : at + 256] @ x.T
            scores[asked[at : at + 256, None] == ids[None]] = -np.inf
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            found += [(asked[at + i], ids[j], scores[i, j]) for i, own in enumerate(best) for j in own if np.isfinite(scores[i, j])]
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, columns, (right["query_id"].type, left[index.key].type, pa.float64()), strict=True)})

    met = held.groupBy("list", "part").cogroup(sent.groupBy("list", "part")).applyInArrow(compare, f"query_id {key_type}, {index.key} {index.key_type}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), index.key)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", index.key, "score")
