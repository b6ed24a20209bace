"""Entity resolution: lemmas, trigram blocking, decision bands and agglomerative merging."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.retrieval import cosine
from factloom.plans.views import D, Views

TRIGRAM_FLOOR, BLOCK_LIMIT = 0.3, 10
ACCEPT, REJECT, ADJUDICATED_MOST = 0.88, 0.60, 3
DISTANCE_CUT, BLOB_CAP, BLAST_CAP = 0.15, 50, 100


def lemma(surface: str) -> str:
    """The key of exact matches: accents off, lower case, white space folded."""
    bare = "".join(c for c in unicodedata.normalize("NFD", surface) if unicodedata.category(c) != "Mn")
    return " ".join(bare.lower().split())


def with_lemma(df: DataFrame, column: str, name: str = "lemma") -> DataFrame:
    """df with the lemma of a column, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([None if x is None else lemma(x) for x in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{fields}, {name} string")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each word padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def blocked_candidates(views: Views, surfaces: list[str], floor: float = TRIGRAM_FLOOR, limit: int = BLOCK_LIMIT) -> DataFrame:
    """(surface, entity_id, similarity): for each surface the active entities whose best alias shares enough trigrams.

    The surfaces' trigrams meet the aliases' by equality, so that an alias without any in common is never compared. Only the
    surfaces are sent to all tasks: aliases and their trigrams are far larger than their files, by which Spark would judge
    them.
    """
    asked = views.spine.spark.createDataFrame([(s,) for s in surfaces], "surface string").withColumn("q", trigrams(F.col("surface")))
    active = views.spine["entities"].where("status = 'active'").select(D, "entity_id")
    aliases = views.spine["aliases"].join(active.hint("merge"), [D, "entity_id"], "left_semi").select("entity_id", "alias_id", trigrams(F.col("normalized_lemma")).alias("g"))
    grams = aliases.select("entity_id", "alias_id", F.size("g").alias("n"), F.explode("g").alias("t"))
    asked = F.broadcast(asked.select("surface", F.size("q").alias("m"), F.explode("q").alias("t")))
    shared = grams.join(asked, "t").groupBy("surface", "entity_id", "alias_id", "m", "n").agg(F.count("*").alias("both"))
    scored = shared.withColumn("similarity", F.col("both") / (F.col("m") + F.col("n") - F.col("both"))).where(F.col("similarity") >= floor)
    best = scored.groupBy("surface", "entity_id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("surface").orderBy(F.desc("similarity"), "entity_id")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("surface", "entity_id", F.round("similarity", 6).alias("similarity"), "place")


def decision_bands(pairs: DataFrame, a: str = "a", b: str = "b", keys: tuple[str, str] = ("mention_id", "entity_id")) -> DataFrame:
    """pairs with cosine and band: accept, reject, or adjudicate (three a mention at most; others defer).

    A mention's candidates are judged by cosine from the highest; a missing vector is adjudicated.
    """
    similar = cosine(F.col(a), F.col(b))
    missing = F.col(a).isNull() | F.col(b).isNull()
    judged = pairs.withColumn("cosine", F.when(missing, None).otherwise(similar))
    band = F.when(missing, "adjudicate").when(F.col("cosine") >= ACCEPT, "accept").when(F.col("cosine") <= REJECT, "reject").otherwise("adjudicate")
    order = Window.partitionBy(keys[0]).orderBy(F.desc(F.coalesce("cosine", F.lit(0.0))), keys[1])
    open_before = F.sum((F.col("band") == "adjudicate").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = judged.withColumn("band", band).withColumn("n", open_before)
    return placed.withColumn("band", F.when((F.col("band") == "adjudicate") & (F.col("n") > ADJUDICATED_MOST), "defer").otherwise(F.col("band"))).drop("n")


def merge_pieces(ids: list[str], vectors: list, cut: float) -> list[list[str]]:
    """Clusters by centroid linkage: the closest pair within the cut merges, the first found where several are.

    A merged centroid is the mean of the two; members without a vector stay alone. Each piece knows its closest one,
    so memory is that of the vectors, and time about the square of their number.
    """
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    out = [[ids[i]] for i in order if vectors[i] is None]
    pieces = [[ids[i]] for i in order if vectors[i] is not None]
    if not pieces:
        return sorted(out)
    # a merged piece takes the place of its second part, and its rank comes after all others
    x = np.stack([np.asarray(vectors[i], float) for i in order if vectors[i] is not None])
    size = np.linalg.norm(x, axis=1, keepdims=True)
    y = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    n = len(x)
    rank, live = np.arange(n), np.ones(n, bool)
    near, apart = np.full(n, -1), np.full(n, np.inf)  # of each piece, the closest of those ranked after it

    def search(i: int) -> None:
        """The closest piece ranked after piece i, the first of several."""
        later = np.flatnonzero(live & (rank > rank[i]))
        near[i], apart[i] = -1, np.inf
        if len(later):
            d = 1 - y[later] @ y[i]
            best = np.flatnonzero(d == d.min())
            j = later[best[rank[later[best]].argmin()]]
            near[i], apart[i] = j, 1 - y[j] @ y[i]

    for i in range(n):
        search(i)
    for k in range(n, 2 * n - 1):
        least = np.flatnonzero(apart == apart.min())
        i = int(least[rank[least].argmin()])
        if not apart[i] <= cut:
            break
        j = int(near[i])
        pieces[j], pieces[i] = sorted(pieces[i] + pieces[j]), []
        x[j] = (x[i] + x[j]) / 2
        size = np.linalg.norm(x[j])
        y[j] = x[j] / size if size > 0 else 0
        live[i], rank[j], apart[i], apart[j], near[j] = False, k, np.inf, np.inf, -1
        others = live.copy()
        others[j] = False
        stale = np.flatnonzero(others & ((near == i) | (near == j)))
        for o in stale:
            search(int(o))
        d = 1 - y @ y[j]
        closer = others & (d < apart)
        near[closer], apart[closer] = j, d[closer]
    return sorted(out + [p for p in pieces if p])


def merge_blocks(members: DataFrame, block: str, key: str, vector: str, cut: float = DISTANCE_CUT, cap: int = BLOB_CAP) -> DataFrame:
    """(block, id, piece, size): members of each block in their merged pieces, named by the least id.

    A block over the cap has half the cut. A block is merged in one task: a centroid may come within the cut of a member
    that neither of its parts is near, so that parts of a block can't be merged apart.
    """

    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_pylist()
        rows = [(table["block"][0].as_py(), i, piece[0], len(piece)) for piece in merge_pieces(ids, table["v"].to_pylist(), cut / 2 if len(ids) > cap else cut) for i in piece]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("block", "id", "piece", "size"), zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)})

    rows = members.select(F.col(block).cast("string").alias("block"), F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.groupBy("block").applyInArrow(run, "block string, id string, piece string, size int")
