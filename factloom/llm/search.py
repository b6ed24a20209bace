"""Exact top-k by integer inner product: MaxScore over shards.

A vector's components, floored at 256ths, are its weights for as many terms. Rows are dealt to shards; a shard is built
once, and all queries then stream through it. It has a posting list for each term, with the least and most that it adds to a query's score. Counted from
the least, contributions are not negative, and the terms split as in MaxScore: the longest run of weak terms whose
bounds together cannot lift a row over the k-th best score so far is non-essential. Essential postings are traversed
for all rows; the others are probed for rows that still compete, a few terms at a time. The shards' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, table

SCALE = 256
SHARD_ROWS = 8_192
PROBE_TERMS = 8
SEED_TERMS = 8
SEED_ROWS = 16


class Shard:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        """rows: n x d whole numbers. Postings are kept in float64 where every score is exact in it, else in int64."""
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], rows[order]
        self.most_abs = [int(x) for x in np.abs(rows.astype(object)).max(0)] if len(rows) else []
        self.rows = rows
        self.postings = np.ascontiguousarray(rows.T)
        self.high, self.low = rows.max(0), rows.min(0)
        self.as_float = (rows.astype(np.float64), self.postings.astype(np.float64))

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, those of id `own` left out; ties go to smaller ids."""
        exact = sum(m * abs(int(q)) for m, q in zip(self.most_abs, query, strict=True)) < 2**53
        rows, postings = self.as_float if exact else (self.rows, self.postings)
        query = query.astype(rows.dtype)
        top, bottom = np.maximum(query * self.high, query * self.low), np.minimum(query * self.high, query * self.low)
        terms = np.argsort(bottom - top, kind="stable")  # strongest first
        bound = (top - bottom)[terms]
        allowed = self.ids != own
        base = bottom.sum()

        def best(at: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pick = np.lexsort((self.ids[at], -scores))[:k]
            return at[pick], scores[pick]

        seed = terms[:SEED_TERMS]
        first = query[seed] @ postings[seed]
        probe = np.argpartition(-first, min(SEED_ROWS + k, len(first)) - 1)[: SEED_ROWS + k]
        probe = probe[allowed[probe]]
        _, scores = best(probe, rows[probe] @ query)
        least = scores[k - 1] if len(scores) >= k else None
        if least is None:
            essential = len(terms)
        else:  # the longest run of weak terms that cannot lift a row over the least alone
            weak = np.cumsum(bound[::-1])
            essential = len(terms) - int((weak <= least - base).sum())
        strong = terms[:essential]
        partial = query[strong] @ postings[strong] + (bottom[terms[essential:]].sum() if essential < len(terms) else 0)
        rest = bound[essential:].sum()
        if least is not None and essential < len(terms):  # the best so far are probed first, for a higher least score
            probe = np.argpartition(-partial, min(SEED_ROWS + k, len(partial)) - 1)[: SEED_ROWS + k]
            probe = probe[allowed[probe]]
            _, scores = best(probe, rows[probe] @ query)
            least = max(least, scores[k - 1]) if len(scores) >= k else least
        alive = np.flatnonzero(allowed if least is None else allowed & (partial + rest >= least))
        partial = partial[alive]
        for a in range(essential, len(terms), PROBE_TERMS):
            more = terms[a : a + PROBE_TERMS]
            partial = partial + rows[np.ix_(alive, more)] @ query[more] - bottom[more].sum()
            rest = rest - bound[a : a + PROBE_TERMS].sum()
            keep = partial + rest >= least
            alive, partial = alive[keep], partial[keep]
        at, scores = best(alive, partial)
        return self.ids[at], scores


def whole(batch_column: pa.Array, width: int) -> np.ndarray:
    """n x width whole numbers; shorter rows are filled up with zeros."""
    out = np.zeros((len(batch_column), width), np.int64)
    for row, x in zip(out, batch_column.to_pylist(), strict=True):
        row[: len(x)] = x
    return out


def top_k(df: DataFrame, scratch: Scratch, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with the rows of other ids.

    is_query is a condition on column vec_id. Vectors that are null or hold null or non-finite components, and rows
    with a null id, take no part; a repeated row (same id and vector) counts once, and a query's own are all rows of its
    id. Ties go to the smaller vec_id. A shorter vector counts as filled up
    with zeros, a very long one makes as many terms. Products beyond 64 bits are not defined. Other columns are not read;
    without rows the result is empty.
    """
    vector = df[vector_col].cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(df[id_col].cast("long").alias("vec_id"), F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(x * scale))).alias("v"))
    rows = scratch.save(rows.where("vec_id IS NOT NULL AND v IS NOT NULL").distinct(), "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    shards = max(1, -(-n // SHARD_ROWS))
    # the query set against all rows, in blocks: a shard's rows come first, then every query
    candidates = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "vec_id", F.lit(0).cast("long").alias("mark"), "v")
    queries = rows.where(is_query).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), "vec_id", F.xxhash64("v").alias("mark"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack((batch.column("shard").to_numpy(), batch.column("kind").to_numpy().astype(np.int64)))
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if place[0, a] != now:
                    now, held, shard = place[0, a], [], None
                ids, marks, v = batch.column("vec_id").to_numpy()[a:b], batch.column("mark").to_numpy()[a:b], whole(batch.column("v").slice(a, b - a), width)
                if place[1, a] == 0:
                    held.append((ids, v))
                    continue
                if not held and shard is None:
                    continue
                if shard is None:
                    shard, held = Shard(*(np.concatenate(c) for c in zip(*held, strict=True))), []
                found = [(q, m, *shard.search(x, q, k)) for q, m, x in zip(ids.tolist(), marks.tolist(), v, strict=True)]
                sizes = [len(f[2]) for f in found]
                columns = [np.repeat([f[0] for f in found], sizes), np.repeat([f[1] for f in found], sizes), np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int64)) for c in columns], names=["query_id", "mark", "vec_id", "score"])

    pairs = candidates.unionByName(queries).repartition("shard").sortWithinPartitions("shard", "kind")
    found = pairs.mapInArrow(run, "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top_k over table embeddings: queries are the rows whose vec_id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), Scratch(spark, "op5"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5"""
