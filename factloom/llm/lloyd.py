"""Vector code compression: product codes from Lloyd rounds in whole numbers, with Hamerly's bounds.

A vector is cut into equal parts, and each part is coded by its nearest entry of that part position's codebook. Two
bounds go along with a part from round to round, written with its row: its distance to its entry is at most `upper`, to
every other entry at least `lower`. After an update they move by how far entries have gone. Only where upper isn't
strictly below lower, and isn't after it was measured anew, are all entries scanned: with equal bounds another entry
could be as near and have the lower index. Bounds are doubles, rounded outwards at every step; distances are whole
numbers, so codes are those of a full scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, small, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components are below this, so that squared distances and sums are exact in 64 bits.
MOST = 1 << 26
#: Rows coded at once in a task.
BLOCK = 4096

STATE = "codes binary, upper binary, lower binary, error long"


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


def squared(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """rows x entries squared distances, in whole numbers."""
    return (rows * rows).sum(1)[:, None] - 2 * (rows @ entries.T) + (entries * entries).sum(1)[None, :]


def scan(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row, the lower index on ties, and bounds on the distances to it and to all others."""
    d = squared(rows, entries)
    best = d.argmin(1)
    at = np.arange(len(rows))
    least = d[at, best]
    d[at, best] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(1).astype(np.float64)) if d.shape[1] > 1 else np.full(len(rows), np.inf)
    return best, up(np.sqrt(least.astype(np.float64))), down(second)


def moved(upper: np.ndarray, lower: np.ndarray, code: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after entries have gone by drift at most: each row's own entry, and the farthest gone of the others."""
    order = np.argsort(-drift, kind="stable")
    farthest = np.where(code == order[0], drift[order[1]] if len(order) > 1 else 0.0, drift[order[0]])
    return up(upper + drift[code]), down(lower - farthest)


def assign(rows: np.ndarray, entries: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, drift: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """code, upper, lower, squared distance of each row, and how many rows were scanned in full."""
    if state is None:
        code, upper, lower = scan(rows, entries)
        scanned = len(rows)
    else:
        code, (upper, lower) = state[0].copy(), moved(state[1], state[2], state[0], drift)
        near = np.flatnonzero(~(upper < lower))
        if len(near):  # one distance each, before all of them
            own = rows[near] - entries[code[near]]
            upper[near] = up(np.sqrt((own * own).sum(1).astype(np.float64)))
            near = near[~(upper[near] < lower[near])]
        if len(near):
            code[near], upper[near], lower[near] = scan(rows[near], entries)
        scanned = len(near)
    own = rows - entries[code]
    return code, upper, lower, (own * own).sum(1), scanned


def packed(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def coder(books: np.ndarray, before: np.ndarray | None):
    """A mapInArrow function: codes, bounds and errors of rows (v, and codes and bounds unless before is None)."""
    parts, _, width = books.shape
    # how far each entry has gone
    drift = None if before is None else up(np.sqrt(((books - before) ** 2).sum(2).astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, BLOCK):
                batch = whole_batch.slice(a, BLOCK)
                v = packed(batch.column("v"), "<i4", parts * width).astype(np.int64).reshape(-1, parts, width)
                codes, bounds, error = np.zeros((len(v), parts), np.uint8), np.zeros((2, len(v), parts)), np.zeros(len(v), np.int64)
                if before is not None:
                    old, upper, lower = packed(batch.column("codes"), "u1", parts), packed(batch.column("upper"), "<f8", parts), packed(batch.column("lower"), "<f8", parts)
                for p in range(parts):
                    state = None if before is None else (old[:, p].astype(np.int64), upper[:, p], lower[:, p])
                    codes[:, p], bounds[0, :, p], bounds[1, :, p], d, _ = assign(v[:, p], books[p], state, None if drift is None else drift[p])
                    error += d
                columns = [batch.column(c) for c in ("vec_id", "label", "v")]
                yield pa.RecordBatch.from_arrays([*columns, binary(codes), binary(bounds[0]), binary(bounds[1]), pa.array(error)], names=["vec_id", "label", "v", "codes", "upper", "lower", "error"])

    return run


def entry_sums(books: np.ndarray):
    """A mapInArrow function: (part, entry, n, sums) of the rows of a task, for each entry in use."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            v = packed(batch.column("v"), "<i4", parts * width).astype(np.int64).reshape(-1, parts, width)
            codes = packed(batch.column("codes"), "u1", parts)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(sums[p], codes[:, p], v[:, p])
        p, e = np.nonzero(counts)
        lists = pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), lists], names=["part", "entry", "n", "sums"])

    return run


def packer(width: int, scale: int):
    """A mapInArrow function: v, the floors of scale times the components, as whole numbers, filled up to width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("x").to_pylist():
                v = np.floor(np.asarray(x, np.float64) * scale)
                if len(v) and np.abs(v).max() >= MOST:
                    raise ValueError(f"a component is over {MOST // scale} in size: products of such vectors are not exact here")
                out.append(np.pad(v, (0, width - len(v))).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "v"])

    return run


def books_text(books: np.ndarray) -> str:
    """All entries' components by part, entry and place within the part."""
    return ",".join(map(str, books.ravel().tolist()))


def product_codes(df: DataFrame, scratch: Scratch, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every kept row; codebooks, parts x entries x width).

    Rows whose vector is null or holds null or non-finite components are left out; rows with a null id and repeated rows
    stay. Codebooks start as the parts of the vectors with the smallest ids, nulls last and equal ids by their
    components; with fewer rows they have fewer entries. Equal distances go to the lower index. Vectors of other lengths
    than the longest, or whose length the parts don't divide, count as filled up with zeros; a very long one is coded
    like any other. Components of 2^26 / scale or more in size raise an error. Other columns are not read; without rows
    the result is empty and the codebooks have no entries.
    """
    vector = df[vector_col].cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[label_col].cast("long").alias("label"), F.when(vector.isNotNull() & finite, vector).alias("x")).where("x IS NOT NULL")
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    now = scratch.save(rows.mapInArrow(packer(parts * width, scale), "vec_id long, label long, v binary"), "vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()  # as many as a codebook has
    start = np.zeros((len(first), parts * width), np.int64)
    for row, r in zip(start, first, strict=True):
        row[: len(r["x"])] = np.floor(np.asarray(r["x"], np.float64) * scale)
    books, before = np.ascontiguousarray(start.reshape(len(first), parts, width).swapaxes(0, 1)), None
    if not first:
        empty = now.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty, books
    for k in range(rounds + 1):
        coded = now.mapInArrow(coder(books, before), f"vec_id long, label long, v binary, {STATE}")
        if k == rounds:  # only codes and errors are asked for
            return scratch.save(coded.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error"), "codes"), books
        now = scratch.save(coded, f"round{k}")
        scratch.drop("vectors" if not k else f"round{k - 1}")
        summed = now.mapInArrow(entry_sums(books), "part int, entry int, n long, sums array<long>")
        totals = summed.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
        before, books = books, books.copy()
        for r in totals.collect():  # a row for each entry
            books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]


def op13_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_codes over table embeddings: 16 parts, 64 entries, two rounds; label_error is the error of all rows of a
    label, null labels together. Odd rows are as in product_codes."""
    codes, books = product_codes(table(spark, sf_dir, "embeddings"), scratch := Scratch(spark, "op13"))
    by_label = scratch.save(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    by_label = small(by_label.select(F.col("label").alias("of_label"), "label_error"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def round_sql(k: int) -> str:
    """Assignments a{k} to the codebooks b{k}, of table p, and the codebooks that come of them."""
    return f"""
a{k} AS (
  SELECT p.row, p.part, arg_min({{entry: b.entry, d: d}}, {{d: d, entry: b.entry}}) AS best
  FROM p JOIN b{k} b USING (part), LATERAL (SELECT CAST(list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d)
  GROUP BY p.row, p.part),
n{k} AS (
  SELECT part, entry, list(mean ORDER BY place) AS v FROM (
    SELECT p.part, a.best.entry AS entry, place, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS mean
    FROM a{k} a JOIN p USING (row, part), LATERAL (SELECT unnest(p.v) AS x, unnest(range(len(p.v))) AS place) GROUP BY ALL)
  GROUP BY part, entry),
b{k + 1} AS (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN n{k} n USING (part, entry))"""


ORACLE = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
    row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT row, CAST(part AS INTEGER) AS part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS v FROM k, range({PARTS}) r(part)),
b0 AS (SELECT part, row - 1 AS entry, v FROM p WHERE row <= {ENTRIES}),
{",".join(round_sql(k) for k in range(ROUNDS + 1))},
c AS (SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row),
h AS (SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN k USING (row), h"""
