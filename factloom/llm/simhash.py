"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within MOST_BITS differing bits agree on all of some choice of blocks of bits, so each is dealt to one
bucket for each choice, and a bucket holds few that have nothing in common. In a bucket they are sorted by Gray rank,
where neighbours share bits; a node over FANOUT neighbours holds the bits that all of them share, and each level below
only what its parent does not say. Two nodes are compared by the differences of their shared bits, which add up on the
way down: over MOST_BITS the pair of groups is dropped as a whole, and where even the unshared bits cannot lead over it
the groups are linked as a whole. A bucket gives one link per linked fingerprint, and components are then found on the
table of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, components, local_components, shingle_hashes, small, sorted_groups, table, text_bytes
from factloom.llm.jaccard import near_copies, with_signature

MOST_BITS = 4
SHINGLE = 4
SEED = 42
FANOUT = 8
#: Fingerprints that a bucket may hold; larger ones are dealt again, to cells of two salts each.
CELL = 4_096
PAIRS = 1 << 15
ALL_BITS = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: one where more than half of the XXH64 hashes of the text's word shingles have a one."""
    words = text.lower().split()
    return majority(shingle_hashes(words, shingle, SEED)) if words else 0


def majority(hashes: np.ndarray) -> int:
    """64 bits: one where more than half of the hashes have a one."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.int64())], names=["doc_id", "fp"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected binary Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels of (pattern, mask) over fingerprints in Gray order; level 0 is the fingerprints themselves."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        pattern, mask = codes[self.order], np.full(len(codes), ALL_BITS)
        self.levels = [(pattern, mask)]
        while len(pattern) > FANOUT:
            starts = np.arange(0, len(pattern), FANOUT)
            shared = np.bitwise_and.reduceat(mask, starts)
            shared &= ~(np.bitwise_or.reduceat(pattern, starts) ^ np.bitwise_and.reduceat(pattern | ~mask, starts))
            pattern, mask = np.bitwise_and.reduceat(pattern, starts) & shared, shared
            self.levels.append((pattern, mask))

    def links(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Links (i, j), places in codes, whose components are those of all pairs within most bits."""
        sizes = [len(p) for p, _ in self.levels]
        offset = np.concatenate(([0], np.cumsum(sizes)))  # nodes of all levels have one numbering
        joined = [np.zeros(n, bool) for n in sizes]  # nodes all of whose fingerprints are linked
        out: list[tuple[np.ndarray, np.ndarray]] = []
        top = len(sizes) - 1
        a, b = np.triu_indices(sizes[top])
        todo = [(top, a, b)]
        while todo:
            level, a, b = todo.pop()
            if len(a) > PAIRS:  # in parts: memory stays bounded
                todo += [(level, a[PAIRS:], b[PAIRS:])]
                a, b = a[:PAIRS], b[:PAIRS]
            pattern, mask = self.levels[level]
            both = mask[a] & mask[b]
            apart = np.bitwise_count((pattern[a] ^ pattern[b]) & both).astype(np.int64)
            near = apart <= most
            a, b, apart, both = a[near], b[near], apart[near], both[near]
            if level == 0:
                out.append((a, b))
                continue
            whole = apart + np.bitwise_count(~both) <= most
            joined[level][a[whole]] = joined[level][b[whole]] = True
            out.append((offset[level] + a[whole], offset[level] + b[whole]))
            a, b = a[~whole], b[~whole]
            if not len(a):
                continue
            steps = np.arange(FANOUT)
            ca, cb = np.broadcast_arrays((a[:, None] * FANOUT + steps)[:, :, None], (b[:, None] * FANOUT + steps)[:, None, :])
            ca, cb = ca.ravel(), cb.ravel()
            real = (ca < sizes[level - 1]) & (cb < sizes[level - 1]) & (ca <= cb)
            todo.append((level - 1, ca[real], cb[real]))
        for level in range(top, 0, -1):  # a joined node links all below it
            below = np.arange(sizes[level - 1])
            down = joined[level][below // FANOUT]
            joined[level - 1] |= down
            out.append((offset[level] + below[down] // FANOUT, offset[level - 1] + below[down]))
        a, b = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
        label = local_components(int(offset[-1]), a, b)[: sizes[0]]
        first = np.full(int(offset[-1]), -1)
        first[label[::-1]] = np.arange(sizes[0])[::-1]  # the first fingerprint of each component
        root = first[label]
        linked = root != np.arange(sizes[0])
        return self.order[np.flatnonzero(linked)], self.order[root[linked]]


def bucket_keys(fp: str, blocks: int, most: int) -> F.Column:
    """Array of keys: one for each choice of blocks - most blocks of bits, with the bits there."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - most)):
        value = F.lit(n).cast("long")
        for i in chosen:
            width = edges[i + 1] - edges[i]
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        keys.append(value)
    return F.array(*keys)


def blocks_for(n: int, most: int = MOST_BITS) -> int:
    """Blocks so that a bucket of n scattered fingerprints holds a few hundred: more of them, more choices, smaller buckets."""
    blocks = most + 1
    while n >> (64 * (blocks - most) // blocks) > 512 and blocks < most + 4:
        blocks += 1
    return blocks


def near_links(fps: DataFrame, scratch: Scratch, most: int = MOST_BITS, cell: int = CELL) -> DataFrame:
    """(src, dst): links between ids whose components are those of all pairs of fingerprints within most bits.

    fps: (rep, fp), one row a fingerprint. A bucket of more than cell fingerprints is dealt to cells of two of its
    salts: any two of its fingerprints meet in a cell.
    """
    keyed = fps.select("rep", "fp", F.explode(bucket_keys("fp", blocks_for(fps.count(), most), most)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
    hot = scratch.save(sizes.where(F.col("n") > cell).select("key", F.ceil(F.col("n") / (cell // 2)).cast("int").alias("salts")), "hot")
    own = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
    cells = F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.least(own, s) * F.col("salts") + F.greatest(own, s)))
    dealt = keyed.join(hot, "key", "left").select("rep", "fp", F.explode(cells).alias("cell"), "key").select("rep", "fp", F.xxhash64("key", "cell").alias("bucket"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for _, rows in sorted_groups(batches, "bucket"):
            if rows.num_rows < 2:
                continue
            rep, codes = rows["rep"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
            i, j = GrayIndex(codes).links(most)
            a.append(rep[i])
            b.append(rep[j])
            held += len(i)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["src", "dst"])
                a, b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["src", "dst"])

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(link, "src long, dst long")


def simhash_groups(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of df.

    A null or empty text has fingerprint zero and is linked like any other. Rows with a null id have a fingerprint and
    a null component, and link nothing. Repeated ids and rows stay; equal texts have one fingerprint and so one component,
    which leaves ties no choice. A very long text is one fingerprint of all its shingles. Other columns are not read;
    without rows the result is empty.
    """
    docs = scratch.save(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    classes = scratch.save(docs.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = scratch.save(components(near_links(classes, scratch, most), scratch), "components")
    named = classes.join(found, classes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = scratch.save(named, "named")
    joined = docs.join(named.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f"), "left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of their group.

    Groups are those of texts whose sets of five-word shingles have a similarity of 0.8 or more. At that similarity
    fingerprints differ in about ten of 64 bits, too many for an index to search without loss. So the fingerprint groups
    come first and gather most copies, each checked by its shingles, and a prefix join finds what they leave.

    Each group keeps one row. A row without an id comes after all that have one; of a group's rows with its smallest id,
    the one with the smallest text and other columns stays. Ties have no choice left. Without rows the result is empty.
    """
    hints = lambda codes: near_links(codes, scratch)
    groups = scratch.save(near_copies(docs, scratch, majority, hints, id_col, text_col), "groups")
    kept = scratch.save(groups.groupBy("component").agg(F.min("doc_id").alias("kept_id")), "kept")
    ids = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"))
    least = kept.where("kept_id IS NOT NULL").select("kept_id").distinct()
    marked = scratch.save(ids.join(least, F.col("doc_id") == F.col("kept_id"), "left").select("doc_id", F.col("kept_id").isNotNull().alias("stays"), (F.col("rows") > 1).alias("again")), "marked")
    mine = docs[id_col].cast("long")
    # what goes, and ids that come again, are few beside the rows: the others' texts stay where they are
    gone = small(marked.where("again OR NOT stays").select(F.col("doc_id").alias("_gone")))
    single = docs.where(mine.isNotNull()).join(gone, mine == gone["_gone"], "left_anti")
    again = small(marked.where("again AND stays").select(F.col("doc_id").alias("_again")))
    several = docs.join(again, mine == again["_again"], "left_semi").unionByName(docs.where(mine.isNull()))
    # an id may stand for several groups, so its rows are told apart by their texts
    places = groups.select(F.col("sig").alias("_sig"), "component").distinct().join(kept, "component").select("_sig", F.col("component").alias("_group"), F.col("kept_id").alias("_kept"))
    placed = with_signature(several, text_col, "_sig").join(places, "_sig").where(F.col(id_col).cast("long").eqNullSafe(F.col("_kept")))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    first = placed.groupBy("_group").agg(F.min(F.struct(text_col, *others, id_col)).alias("_least"))
    return single.unionByName(first.select(*(F.col("_least")[c].alias(c) for c in docs.columns)))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_groups over table documents: four-word shingles, links at four differing bits or fewer."""
    return simhash_groups(table(spark, sf_dir, "documents"), Scratch(spark, "op6"))
