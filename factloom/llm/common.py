"""What the training-data operators share: tables, the shared folder, Arrow iteration and components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"


class Scratch:
    """Intermediate tables, written as Parquet in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/factloom/{tag}-{uuid.uuid4().hex}", {}
        if spark.conf.get(BATCH_CONF) == "10000":  # as Spark comes: whole texts go to Python in batches of fewer rows
            spark.conf.set(BATCH_CONF, BATCH_ROWS)

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        df.write.parquet(path, compression=compression)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
            self.paths[f"{name} (gone {len(self.paths)})"] = str(hadoop)


def give_back() -> None:
    """Return what a worker's earlier tasks left to the system: Spark uses workers again, and allocators keep memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def shingle_hashes(words: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of shingle words, repeated ones too; of all words if they are no more than that."""
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(words) - shingle + 1)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Rows of each key, from batches that come sorted by it; a group may span batches."""
    held: list[pa.RecordBatch] = []
    held_key: object = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if held and keys[a] != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, pa.Table.from_batches(held)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes under the links a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        if (la == lb).all():
            break
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not (label == (jump := label[label])).all():
            label = jump
    return label


#: Links that one task may hold: 16 MB of them.
LOCAL_LINKS = 1 << 20


def components(edges: DataFrame, scratch: Scratch, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, component): the smallest id reachable from each node that occurs in edges (src, dst), both long.

    Up to local_links different links are solved in one task. More of them take large-star and small-star rounds on
    written tables: a round's output is a table of links, so nothing is gathered in one task, and the joins have two
    plain exchanges each, which Spark can split where a node is hot.
    """
    both = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    now, before, k = scratch.save(both.distinct(), "edges0"), None, 0
    if now.count() <= local_links:

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
            if got:
                ends = [np.concatenate(c) for c in zip(*got, strict=True)]
                nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
                label = local_components(len(nodes), *np.split(place, 2))  # places are in the order of ids
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])

        return now.coalesce(1).mapInArrow(solve, "node long, component long")
    while True:
        k += 1
        around = now.union(now.select("v", "u"))
        least = scratch.save(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"large{k}")
        large = scratch.save(around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"links{k}")
        least2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"small{k}")
        small = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.save(small.union(least2.select("u", F.col("m").alias("v"))).distinct(), f"edges{k}")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"edges{k - 1}", f"large{k}", f"links{k}", f"small{k}")
        if mark == before:
            break
        before = mark
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def labelled_sample(labels: DataFrame, label: str, held_out: F.Column, most: int) -> DataFrame:
    """(doc_id, label, weight): at most `most` labelled rows that are not held out, half of them of each label.

    The rows with the smallest hashes of doc_id stand for all of their label; weight undoes the balance. Rows with a
    null id or label are left out, and a repeated id has its largest label.
    """
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out)
    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = []
    for value in (0, 1):
        part = rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        parts.append(part.withColumn("weight", F.lit(total.get(value, 0) / max(1, min(total.get(value, 0), most // 2)))))
    return parts[0].union(parts[1])


#: Rows of narrow columns that a join may send to all executors: tens of megabytes there.
BROADCAST_ROWS = 1_000_000


def small(stored: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The stored table, marked for broadcast if it has few rows; else the join moves both sides by key."""
    return F.broadcast(stored) if stored.count() <= most else stored


def sampled_texts(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label, weight): one row for each id of sample that rows (doc_id, text) has, so no more rows than
    sample has. A repeated id has its smallest text; copies of it are put together before they move."""
    picked = rows.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # a labelled_sample has a bounded number of rows
    return picked.groupBy("doc_id", "label", "weight").agg(F.min("text").alias("text")).select("doc_id", "text", "label", "weight")


def remainder_is(id_col: str, modulus: int, value: int) -> F.Column:
    """Whether crc32(id as text) mod modulus is value; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == value, F.lit(False))
