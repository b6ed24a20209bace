"""The index against the exact search, on vectors in clusters and without any."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import ann


def vectors(spark, n, clusters, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    if clusters:
        x = x * 0.3 + rng.normal(size=(clusters, 16))[rng.integers(0, clusters, n)]
        x[: n // 3] = x[0] + rng.normal(size=(n // 3, 16)) * 0.05  # a list that holds a third of the rows
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (None, [1.0] * 16)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), x / np.linalg.norm(x, axis=1, keepdims=True)


def exact(x, q, k):
    scores = np.round(x @ x[q], 12)
    scores[q] = -9
    return [int(i) for i in np.lexsort((np.arange(len(x)), -scores))[:k]]


@pytest.mark.parametrize("clusters", [30, 0])
def test_recall_is_what_was_asked_for(spark, tmp_path, clusters, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 150)
    rows, x = vectors(spark, 900, clusters)
    index = ann.build(rows, str(tmp_path / "i"), recall=0.95)
    assert sum(index.sizes) == 900 and index.recall >= 0.95
    queries = ann.unit_rows(rows.where("vec_id % 9 = 0"), "vec_id", "embedding").select(F.col("vec_id").alias("query_id"), "v")
    got = {}
    for r in ann.search(ann.load(spark, index.path), queries, 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert len(got) == 100 and all(set(v) <= set(range(1, 11)) for v in got.values())  # a small list may hold fewer
    right = sum(len(set(v.values()) & set(exact(x, q, 10))) for q, v in got.items())
    assert right >= 0.9 * 1000
    if clusters:
        assert index.probes <= len(index.centroids) / 2
    every = ann.search(index, queries, 3, probes=len(index.centroids)).collect()
    for q in (0, 450, 891):
        assert [r["vec_id"] for r in sorted(every, key=lambda r: r["rank"]) if r["query_id"] == q] == exact(x, q, 3)


def test_a_probe_reads_few_files(spark, tmp_path):
    rows, x = vectors(spark, 600, 20)
    index = ann.build(rows, str(tmp_path / "i"))
    found = ann.nearest(index, spark, x[500].tolist(), 5, probes=2)
    assert found.orderBy("rank").first()["vec_id"] == 500
    scan = ann.nearest(index, spark, x[500].tolist(), 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in scan or "PartitionFilters: [list" in scan
    read = found.sparkSession.read.schema(index.schema).parquet(f"{index.path}/lists").where(F.col("list").isin(index.nearest_lists(x[500].tolist(), 2)))
    every = found.sparkSession.read.schema(index.schema).parquet(f"{index.path}/lists")
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(read) <= files(every) / 4


def test_no_vectors(spark, tmp_path):
    rows, _ = vectors(spark, 0, 0)
    assert ann.build(rows, str(tmp_path / "i")) is None
    one = spark.createDataFrame([(7, [1.0, 2.0])], "vec_id long, embedding array<float>")
    index = ann.build(one, str(tmp_path / "j"))
    assert [r["vec_id"] for r in ann.nearest(index, spark, [1.0, 2.0]).collect()] == [7]
