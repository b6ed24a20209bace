"""Embedding near-duplicates: a forest of random-projection trees with spill overlap.

A tree splits the rows again and again by a random direction, at a wide gap, the nearer to the middle the better; rows close to a
split go down both sides. The trees are drawn from a bounded sample, and every row is then put in its leaves; a leaf
with too many rows is split on by a tree drawn from a sample of its own rows, level by level, so that leaves do not grow
with the table. Rows are compared within leaves, in double precision, and a pair counts in the first leaf that both are in. The links of a
leaf are passed on as one link per linked row, and components are found on the table of links.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, components, local_components, sorted_groups, table

COSINE = 0.9
TREES = 6
#: Rows, and numbers in them, that the trees are drawn from at most; rows, about, that a leaf's own tree is drawn from;
#: and sampled rows that a node must have to be split.
FIT_ROWS, FIT_NUMBERS = 32_768, 1 << 22
DEEPER_ROWS = 4_096
SPLIT_ROWS = 64
#: Rows expected in a leaf; a larger leaf than CELL is split on, or, if its rows are all alike, compared in cells of two
#: of its salts. Rows of a leaf that one task puts into the leaf's own tree, about.
LEAF_ROWS = 1_024
CELL = 4_096
SPREAD_ROWS = 200_000
DIRECTIONS = 8
SPILL = 0.04
BLOCK = 1_024


@dataclass
class Tree:
    direction: np.ndarray  # nodes x d
    low: np.ndarray  # a row over low goes right,
    high: np.ndarray  # and one up to high goes left; both, in between
    left: np.ndarray  # child node, or -1 - leaf
    right: np.ndarray
    leaves: int

    def leaves_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs: each row has one leaf at least."""
        rows, leaf = [], []
        todo = [(0 if len(self.left) else -1, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaf.append(np.full(len(at), -1 - node))
                continue
            p = x[at] @ self.direction[node]
            todo += [(self.left[node], at[p <= self.high[node]]), (self.right[node], at[p > self.low[node]])]
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *leaf])


def grow(sample: np.ndarray, rows: int, rng: np.random.Generator, cosine: float, leaf_rows: int = LEAF_ROWS, spill: float = SPILL) -> Tree:
    """Tree over unit vectors that stand for `rows` rows. A node whose sample is all alike is a leaf, however large."""
    direction, low, high, left, right = [], [], [], [], []
    leaves = 0

    def node(at: np.ndarray) -> int:
        nonlocal leaves
        x = sample[at]
        center = x.mean(0) if len(at) else None
        small = len(at) < SPLIT_ROWS or len(at) / max(1, len(sample)) * rows <= leaf_rows
        if small or (x @ center).min() >= cosine * np.linalg.norm(center):
            leaves += 1
            return -leaves
        best = None
        for d in rng.normal(size=(DIRECTIONS, sample.shape[1])):
            d /= np.linalg.norm(d)
            p = np.sort(x @ d)
            a, b = int(len(p) * 0.05), max(int(len(p) * 0.05) + 2, int(len(p) * 0.95))
            share = np.arange(a + 1, b) / len(p)
            gaps = np.diff(p[a:b]) * share * (1 - share)  # a crowd is not cut where there is a gap beside it
            k = int(gaps.argmax())
            if best is None or gaps[k] > best[0]:
                best = (gaps[k], d, (p[a + k] + p[a + k + 1]) / 2, p)
        _, d, cut, p = best
        at_cut = np.searchsorted(p, cut)
        wide = int(len(p) * spill)
        me = len(direction)
        direction.append(d)
        low.append(min(p[max(0, at_cut - wide)], cut))
        high.append(max(p[min(len(p) - 1, at_cut + wide)], cut))
        left.append(0)
        right.append(0)
        own = x @ d
        left[me], right[me] = node(at[own <= high[me]]), node(at[own > low[me]])
        return me

    node(np.arange(len(sample)))
    width = sample.shape[1]
    return Tree(np.array(direction).reshape(-1, width), np.array(low), np.array(high), np.array(left, int), np.array(right, int), leaves)


def unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        scaled = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def compare(x: np.ndarray, side: np.ndarray, earlier: np.ndarray, times: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links counted for each row (each as often as the other row stands), and links (i, j) with the same components.

    Pairs that have a bit of `earlier` in common were counted elsewhere; where side has both 0 and 1, only pairs across
    sides count. All pairs found are links, counted here or elsewhere.
    """
    n = np.zeros(len(x), np.int64)
    label = np.arange(len(x))
    across = len(np.unique(side)) > 1
    for a in range(0, len(x), BLOCK):
        for b in range(a, len(x), BLOCK):
            i, j = np.nonzero(x[a : a + BLOCK] @ x[b : b + BLOCK].T >= cosine)
            i, j = i + a, j + b
            keep = i < j
            if across:
                keep &= side[i] != side[j]
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            new = ~(earlier[i] & earlier[j]).any(1)
            np.add.at(n, i[new], times[j[new]])
            np.add.at(n, j[new], times[i[new]])
            li, lj = label[i], label[j]
            if (li != lj).any():
                label = local_components(len(x), np.concatenate((i, np.arange(len(x)))), np.concatenate((j, label)))
    linked = np.flatnonzero(label != np.arange(len(x)))
    return n, linked, label[linked]


def deeper(placed: DataFrame, scratch: Scratch, cosine: float, width: int) -> DataFrame:
    """placed (rep, times, x, leaves) with leaves of CELL rows at most, but for those whose rows are all alike.

    Each level takes all leaves that are too large: a tree for each, from about DEEPER_ROWS of its rows, into which all
    of its rows are put by as many tasks as they need. A level divides a leaf by up to DEEPER_ROWS / SPLIT_ROWS.
    """
    members, level = placed.select("rep", F.explode("leaves").alias("leaf"), F.lit(False).alias("alike")), 0
    vectors = placed.select("rep", "x")
    while True:
        sizes = members.where("NOT alike").groupBy("leaf").agg(F.count("*").alias("rows")).where(F.col("rows") > CELL)
        big = scratch.save(sizes, f"big{level}")
        if not big.count():
            break
        chance = F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(1 << 30)) / (1 << 30)
        drawn = members.where("NOT alike").join(big, "leaf").where(chance < DEEPER_ROWS / F.col("rows")).select("rep", "leaf", "rows").join(vectors, "rep")

        def draw(key: tuple, rows: pa.Table) -> pa.Table:
            x = np.frombuffer(b"".join(rows.sort_by("rep")["x"].to_pylist()), np.float64).reshape(-1, width)
            tree = grow(x, rows["rows"][0].as_py(), np.random.default_rng([abs(key[0].as_py()), level]), cosine, LEAF_ROWS)
            return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary()), "splits": pa.array([tree.leaves > 1])})

        trees = scratch.save(drawn.groupBy("leaf").applyInArrow(draw, "leaf long, tree binary, splits boolean"), f"trees{level}")
        dealt = big.join(trees.select("leaf", "splits"), "leaf", "left").select("leaf", "splits", F.ceil(F.col("rows") / SPREAD_ROWS).cast("int").alias("salts"))
        mine = members.where("NOT alike").join(dealt, "leaf").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
        rows = mine.where("splits").join(vectors, "rep").select("leaf", "salt", F.lit(1).alias("kind"), "rep", F.col("x").alias("data"))
        heads = trees.where("splits").join(dealt.select("leaf", "salts"), "leaf")
        heads = heads.select("leaf", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("rep"), F.col("tree").alias("data"))

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = None
            for batch in batches:
                kinds, leaf, rep = (batch.column(c).to_pylist() for c in ("kind", "leaf", "rep"))
                heads_at = [k for k, kind in enumerate(kinds) if kind == 0]
                for a, b in zip([0, *heads_at], [*heads_at, len(kinds)], strict=True):
                    if a < b and kinds[a] == 0:
                        tree, a = pickle.loads(batch.column("data")[a].as_py()), a + 1
                    if a < b:
                        x = np.frombuffer(b"".join(batch.column("data").slice(a, b - a).to_pylist()), np.float64).reshape(-1, width)
                        at, to = tree.leaves_of(x)
                        yield pa.RecordBatch.from_arrays([pa.array(np.array(rep[a:b], np.int64)[at]), pa.array(np.array(leaf[a:b], np.int64)[at]), pa.array(to.astype(np.int64))], names=["rep", "leaf", "part"])

        sorted_rows = rows.unionByName(heads).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "kind")
        split = sorted_rows.mapInArrow(put, "rep long, leaf long, part long").select("rep", F.xxhash64("leaf", "part", F.lit(level)).alias("leaf"), F.lit(False).alias("alike"))
        whole = mine.where("NOT coalesce(splits, false)").select("rep", "leaf", F.lit(True).alias("alike"))
        rest = members.join(big.select("leaf"), "leaf", "left_anti").select("rep", "leaf", "alike")
        members = scratch.save(rest.union(whole).union(split), f"members{level}")
        level += 1
    if not level:
        return placed
    leaves = members.groupBy("rep").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))  # a row's leaves: a few for each tree
    return scratch.save(placed.drop("leaves").join(leaves, "rep"), "deeper")


def forest_links(reps: DataFrame, scratch: Scratch, cosine: float = COSINE, trees: int = TREES, fit_rows: int = FIT_ROWS, seed: int = 3) -> DataFrame:
    """(a, b, n): a row (id, null, n) of links counted, or a link (id, id, null). reps: (rep, v, times), vectors of one width."""
    rows, width = reps.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 1
    picked = reps.orderBy(F.xxhash64("rep"), "rep").limit(max(SPLIT_ROWS, min(fit_rows, FIT_NUMBERS // width))).select("v").toArrow()["v"].combine_chunks() if rows else None
    rng = np.random.default_rng(seed)
    sample = unit(picked.flatten().to_numpy().astype(np.float64).reshape(-1, width)) if rows else np.zeros((0, width))
    forest = [grow(sample, rows, rng, cosine, LEAF_ROWS) for _ in range(trees)]
    first_leaf = np.concatenate(([0], np.cumsum([t.leaves for t in forest]))).tolist()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column("v").flatten().to_numpy().astype(np.float64).reshape(-1, width))
            pairs = [(r, leaf + first) for t, first in zip(forest, first_leaf, strict=False) for r, leaf in [t.leaves_of(x)]]
            at, leaf = (np.concatenate(c) for c in zip(*pairs, strict=True))
            order = np.lexsort((leaf, at))
            at, leaf = at[order], leaf[order]
            cuts = np.searchsorted(at, np.arange(len(x) + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(leaf, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("times"), pa.array([r.tobytes() for r in x], pa.binary()), lists], names=["rep", "times", "x", "leaves"])

    placed = scratch.save(reps.mapInArrow(place, "rep long, times long, x binary, leaves array<long>"), "placed")
    placed = deeper(placed, scratch, cosine, width)
    dealt = placed.withColumn("leaf", F.explode("leaves"))
    hot = scratch.save(dealt.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("leaf", F.ceil(F.col("n") / (CELL // 2)).cast("int").alias("salts")), "hot")
    own = F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")
    # a cell (s, t) compares across its two salts, and (s, s) within one
    cells = F.when(F.col("salts").isNull(), F.array(F.struct(F.lit(0).alias("cell"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct((F.least(own, s) * F.col("salts") + F.greatest(own, s)).alias("cell"), (own > s).cast("int").alias("side")))
    )
    spread = dealt.join(hot, "leaf", "left").select("rep", "times", "x", "leaves", "leaf", F.inline(cells)).withColumn("bucket", F.xxhash64("leaf", "cell"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in sorted_groups(batches, "bucket"):
            if group.num_rows < 2:
                continue
            rep, leaf = group["rep"].to_numpy(), group["leaf"][0].as_py()
            x = np.frombuffer(b"".join(group["x"].to_pylist()), np.float64).reshape(len(rep), -1)
            flat = group["leaves"].combine_chunks()
            owner = np.repeat(np.arange(len(rep)), np.diff(flat.offsets.to_numpy()))
            lists = flat.values.to_numpy()[flat.offsets[0].as_py() : flat.offsets[-1].as_py()]
            before = lists < leaf
            known, bit = np.unique(lists[before], return_inverse=True)
            earlier = np.zeros((len(rep), len(known) // 64 + 1), np.uint64)
            np.bitwise_or.at(earlier, (owner[before], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
            n, i, j = compare(x, group["side"].to_numpy(), earlier, group["times"].to_numpy(), cosine)
            some = np.flatnonzero(n)
            a, b = np.concatenate((rep[some], rep[i])), np.concatenate((np.zeros(len(some), np.int64), rep[j]))
            counted = np.arange(len(a)) < len(some)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=counted), pa.array(np.concatenate((n[some], np.zeros(len(i), np.int64))), mask=~counted)], names=["a", "b", "n"])

    return spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(link, "a long, b long, n long")


def near_embeddings(df: DataFrame, scratch: Scratch, cosine: float = COSINE, trees: int = TREES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of df.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are their own component;
    so have rows with a null id, whose component and kept are null. Vectors are compared with those of the same length,
    of any length; a cosine of exactly the threshold is a link. Repeated rows of an id all stay.
    Equal vectors are compared once and link each other. Other columns are not read; without rows the result is empty.
    """
    vector = df[vector_col].cast("array<double>")
    usable = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = scratch.save(df.select(df[id_col].cast("long").alias("vec_id"), F.when(usable & df[id_col].isNotNull(), vector).alias("v")), "rows")
    classes = scratch.save(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")), "classes")
    found = None
    for (width,) in classes.select(F.size("v")).distinct().orderBy(F.size("v")).collect():  # vectors of a table have one width, or few
        part = forest_links(classes.where(F.size("v") == width), scratch, cosine, trees)
        part = scratch.save(part, f"links{width}")
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.when(F.col("vec_id").isNotNull(), F.lit(True)).alias("kept"))
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = scratch.save(components(found.where("b IS NOT NULL").select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch), "components")
    named = classes.join(counts, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    named = scratch.save(named.select(F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    out = rows.join(named, F.col("v") == F.col("w"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op10_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_embeddings over table embeddings: links at a cosine of 0.9 or more."""
    return near_embeddings(table(spark, sf_dir, "embeddings"), Scratch(spark, "op10"))
