"""Quality: random-indexing word vectors, pooled per document, and a two-layer network.

Each term has a fixed sparse random index vector, and a term's word vector is the sum of the index vectors near it in
the whole corpus. Words share BUCKETS by hash, so that the table of vectors has one size for any corpus. A document is
the mean and spread of its words' vectors, and the network's log odds are divided by a temperature fitted on rows that
it was not trained on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, give_back, labelled_sample, remainder_is, sampled_texts, sorted_groups, table, text_bytes

BUCKETS = 1 << 14
DIMENSIONS = 32
NONZERO = 4
WINDOW = 2
#: Buckets in a row of the shuffle that sums the vectors.
STRIPE = 64
#: Labelled rows to learn from at most.
SAMPLE_ROWS = 40_000
HIDDEN = 32
THRESHOLD = 0.3
CACHE = 100_000
#: Bytes of a text, and tokens of a longer one, that are taken at a time.
LONG, RUN = 1 << 20, 1 << 18
TOKENS = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
FEATURES = 2 * DIMENSIONS + 4


class Buckets(dict):
    """Token: its buckets. A word is taken in lower case, besides a mark if it is in capitals only."""

    def __missing__(self, token: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        low = zlib.crc32(token.lower()) % BUCKETS
        got = (low, zlib.crc32(b"capitals\x00") % BUCKETS) if len(token) > 1 and token.isupper() else (low,)
        if len(token) < 100:
            self[token] = got
        return got


def index_vectors(seed: int = 11) -> np.ndarray:
    """Row for each bucket: NONZERO random places of +1 or -1; the last row, of no bucket, is zero."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS + 1, DIMENSIONS), np.int8)
    places = rng.random((BUCKETS, DIMENSIONS)).argsort(1)[:, :NONZERO]
    out[np.arange(BUCKETS)[:, None], places] = rng.choice(np.array([-1, 1], np.int8), (BUCKETS, NONZERO))
    return out


def runs_of(text: bytes, buckets: Buckets) -> Iterator[list[int]]:
    """Buckets of the text's tokens; a very long text's in runs, cut between tokens."""
    if len(text) <= LONG:
        yield [i for t in TOKENS.findall(text) for i in buckets[t]]
        return
    found = (m.group() for m in TOKENS.finditer(text))
    while some := list(islice(found, RUN)):
        yield list(chain.from_iterable(map(buckets.__getitem__, some)))


def word_vectors(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> np.ndarray:
    """Unit word vectors of the buckets, from all texts: a table of one size for any corpus."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        index, buckets = index_vectors(), Buckets()
        total = np.zeros((BUCKETS, DIMENSIONS))
        held: list[int] = []
        done = 0  # ids of held that have been added and are there for the ones after them

        def add(ended: bool) -> None:
            nonlocal done
            ids = np.array(held, np.int64)
            near = np.zeros((len(ids), DIMENSIONS), np.int8)
            vectors = index[ids]
            for k in range(1, WINDOW + 1):
                near[k:] += vectors[:-k]
                near[:-k] += vectors[k:]
            own = slice(done, len(ids) if ended else len(ids) - WINDOW)  # the last ones wait for what follows them
            ids, near = ids[own], near[own]
            real = ids < BUCKETS
            ids, near = ids[real], near[real]
            for d in range(DIMENSIONS):
                total[:, d] += np.bincount(ids, near[:, d], BUCKETS)
            if ended:
                held.clear()
                done = 0
            else:
                del held[: -2 * WINDOW]
                done = WINDOW

        for batch in batches:
            for text in text_bytes(batch.column("text")):
                for run in runs_of(text, buckets):
                    held.extend(run)
                    if len(held) >= 200_000:
                        add(False)
                held.extend([BUCKETS] * WINDOW)
                if len(held) >= 100_000:
                    add(True)
        add(True)
        stripes = total.astype("<f4").reshape(-1, STRIPE * DIMENSIONS)
        used = np.flatnonzero(stripes.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([stripes[i].tobytes() for i in used], pa.binary())], names=["stripe", "sums"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stripe, rows in sorted_groups(batches, "stripe"):
            total = np.zeros(STRIPE * DIMENSIONS)
            for sums in rows["sums"].to_pylist():
                total += np.frombuffer(sums, "<f4")
            yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["stripe", "sums"])

    schema = "stripe int, sums binary"
    own = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(gather, schema)
    summed = own.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(add_up, schema)
    out = np.zeros((BUCKETS // STRIPE, STRIPE * DIMENSIONS), np.float32)
    for row in summed.collect():  # BUCKETS x DIMENSIONS numbers
        out[row["stripe"]] = np.frombuffer(row["sums"], "<f4")
    out = out.reshape(BUCKETS, DIMENSIONS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    """Mean and spread of each text's word vectors, how far neighbours differ, distinct share and length."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts, strict=True):
        n, total, square, step, seen, last = 0, np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, set(), None
        for ids in runs_of(text, buckets):
            if not ids:
                continue
            v = vectors[ids]
            total += v.sum(0, dtype=np.float64)
            square += (v * v).sum(0, dtype=np.float64)
            step += float(((v[1:] - v[:-1]) ** 2).sum(dtype=np.float64)) + (0.0 if last is None else float(((v[0] - last) ** 2).sum()))
            last = v[-1]
            n += len(ids)
            seen.update(ids)
        if n:
            mean = total / n
            row[:DIMENSIONS], row[DIMENSIONS : 2 * DIMENSIONS] = mean, np.sqrt(np.maximum(square / n - mean * mean, 0))
            row[-4:-1] = step / n, len(seen) / n, len(seen) / np.sqrt(n)
        row[-1] = np.log1p(n)
    return out


@dataclass
class Network:
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(np.clip((x - self.center) / self.scale, -8, 8) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = 40, seed: int = 5) -> Network:
    """Fit by Adam in batches on four fifths of the rows; the temperature has the least loss on the others."""
    share = float((label * weight).sum() / weight.sum()) if len(x) else 0.5
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.default_rng(seed)
    net = Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), prior, 1.0)
    if not 0 < share < 1 or len(x) < 10:
        return net
    net.center, net.scale = x.mean(0), x.std(0) + 1e-4
    z = np.clip((x - net.center) / net.scale, -8, 8)
    order = rng.permutation(len(x))
    fit, rest = order[len(x) // 5 :], order[: len(x) // 5]
    params = [rng.normal(0, np.sqrt(2 / FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.array([prior])]
    moments, step = [(np.zeros_like(p), np.zeros_like(p)) for p in params], 0
    weight = weight / weight.mean()
    for epoch in range(epochs):
        rng.shuffle(fit)
        for a in range(0, len(fit), 256):
            b, step = fit[a : a + 256], step + 1
            w1, b1, w2, b2 = params
            hidden = np.maximum(z[b] @ w1 + b1, 0)
            slope = weight[b] * (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2[0], -30, 30))) - label[b]) / len(b)
            back = np.outer(slope, w2) * (hidden > 0)
            grads = [z[b].T @ back + 1e-4 * w1, back.sum(0), hidden.T @ slope + 1e-4 * w2, np.array([slope.sum()])]
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for p, g, (m, s) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    raw, y, w = net.raw(x[rest]), label[rest], weight[rest]
    loss = lambda t: float((w * np.logaddexp(0, np.where(y > 0, -raw, raw) / t)).sum())
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, modulus: int = 5, remainder: int = 0, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors from all texts of docs, and the network, from the labels of SAMPLE_ROWS rows at most.

    Rows whose crc32(id as text) mod modulus is remainder are held out of the labels.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    vectors = word_vectors(rows, scratch)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            x = pooled(text_bytes(batch.column("text")), vectors, buckets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("weight"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "weight", "x"])

    sample = labelled_sample(labels, label, remainder_is("doc_id", modulus, remainder), SAMPLE_ROWS)
    got = sampled_texts(rows, sample).mapInArrow(pool, "doc_id long, label int, weight double, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, FEATURES).astype(np.float64)
    net = train(x, got["label"].to_numpy().astype(float), got["weight"].to_numpy())
    del got, x
    give_back()
    return vectors, net


def quality(docs: DataFrame, labels: DataFrame, scratch: Scratch, modulus: int = 5, remainder: int = 0, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    A null or empty text is scored as a text without words, a row with a null id is scored and not held out, repeated
    rows are scored each time. A very long text is read whole, in runs of tokens that give what one run would; equal texts
    have equal scores. An id with several texts is learned from its smallest. Other columns are not read. Without labels of both kinds the score is constant; without
    rows the result is empty.
    """
    vectors, net = learn(docs, labels, scratch, modulus, remainder, id_col, text_col, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            p = net.probability(pooled(text_bytes(batch.column("text")), vectors, buckets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", remainder_is("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is threshold or more.

    A null or empty text is scored as a text without words, a very long one whole; each repeated row is judged by itself,
    and rows of equal text alike. A score of exactly threshold stays. Other columns, whatever their names, are passed on.
    Without rows the result is empty; without labels of both kinds all rows have one score.
    """
    vectors, net = learn(docs, labels, scratch, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        buckets = Buckets()
        for batch in batches:
            yield batch.filter(pa.array(net.probability(pooled(text_bytes(batch.column(at)), vectors, buckets)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality over table documents, learned from table labels."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op8"))
