"""Toxicity: a factorization machine over hashed terms.

Terms are a text's words and their beginnings, hashed to BINS; a text has a term or not. Besides a weight each term
has a vector, and two terms that occur together add the product of their vectors to the score, so that an insult
beside a group's name can weigh more than both.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import give_back, labelled_sample, remainder_is, sampled_texts, table

BINS = 1 << 20
#: Labelled rows to learn from at most.
SAMPLE_ROWS = 8_000
#: Least G statistic, halved, of a term that the model keeps: chance alone gives it to one term in two thousand.
EVIDENCE = 6.0
#: A pair of terms that says what the terms kept for themselves don't: its residuals add up to so many texts and standard
#: deviations at least, which chance gives to one pair in some hundred millions. A pair in fewer texts than SUPPORT can't.
PAIR_TEXTS, PAIR_SIGMAS, SUPPORT, PAIR_BLOCK = 3.0, 6.0, 36, 1024
FACTORS = 8
BLOCK_ROWS = 500
THRESHOLD = 0.3
CACHE = 100_000
_SPLIT = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    """Distinct lower-cased words: runs of letters."""
    return set((text or "").lower().encode().translate(_SPLIT).split())


def bins_of(word: bytes) -> tuple[int, ...]:
    """Bins of a word's terms: the word, and its first four and five bytes."""
    return tuple(zlib.crc32(x) % BINS for x in ((b"w" + word, b"4" + word[:4], b"5" + word[:5]) if len(word) > 5 else (b"w" + word, b"4" + word[:4])))


@dataclass
class FactorizationMachine:
    bins: np.ndarray  # sorted bins of the terms that it has
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds of texts, whose kept terms follow one another from starts on; each has one term at least (-1: none)."""
        w, v = np.append(self.weights, 0.0)[terms], np.vstack((self.vectors, np.zeros(self.vectors.shape[1])))[terms]
        together = np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v * v, starts)
        return self.bias + np.add.reduceat(w, starts) + together.sum(1) / 2


def choose_terms(bins: np.ndarray, owner: np.ndarray, label: np.ndarray) -> np.ndarray:
    """All bins whose presence by itself tells about the label, by G-test."""
    found, place = np.unique(bins, return_inverse=True)
    n, pos = np.bincount(place).astype(float), np.bincount(place, label[owner]).astype(float)
    p, total = max(label.mean(), 1e-9), len(label)
    gain = np.zeros(len(found))
    for seen, expected in ((pos, n * p), (n - pos, n * (1 - p)), (label.sum() - pos, (total - n) * p), (total - n - label.sum() + pos, (total - n) * (1 - p))):
        gain += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)
    return found[gain > EVIDENCE]


def interacting_terms(bins: np.ndarray, owner: np.ndarray, residual: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """Bins of pairs that occur together where the residuals of a model lean to one side: a score test of each pair of
    terms that could pass it, whatever the terms say alone, in blocks of terms."""
    found, place, times = np.unique(bins, return_inverse=True, return_counts=True)
    able = np.flatnonzero((times >= SUPPORT) & (np.bincount(place, np.abs(residual)[owner], len(found)) >= PAIR_TEXTS))
    slot = np.full(len(found), -1)
    slot[able] = np.arange(len(able))
    at = slot[place]
    order = np.argsort(at, kind="stable")[np.count_nonzero(at < 0) :]
    at, row = at[order], owner[order]
    edges = np.searchsorted(at, np.arange(0, len(able) + PAIR_BLOCK, PAIR_BLOCK))

    def dense(k: int) -> np.ndarray:
        out = np.zeros((len(residual), min(PAIR_BLOCK, len(able) - k * PAIR_BLOCK)), np.float32)
        out[row[edges[k] : edges[k + 1]], at[edges[k] : edges[k + 1]] - k * PAIR_BLOCK] = 1
        return out

    chosen = np.zeros(len(able), bool)
    r, v = residual.astype(np.float32)[:, None], variance.astype(np.float32)[:, None]
    for i in range(len(edges) - 1):
        left = dense(i)
        leaning, spread = np.ascontiguousarray((left * r).T), np.ascontiguousarray((left * v).T)
        for j in range(i, len(edges) - 1):
            right = left if i == j else dense(j)
            lean = leaning @ right
            hit = (np.abs(lean) >= PAIR_TEXTS) & (lean * lean > PAIR_SIGMAS**2 * (spread @ right))
            if i == j:
                np.fill_diagonal(hit, False)
            a, b = np.nonzero(hit)
            chosen[i * PAIR_BLOCK + a] = chosen[j * PAIR_BLOCK + b] = True
    return found[able[chosen]]


def train(rows: list[tuple[int, float, np.ndarray]], factors: int = FACTORS, steps: int = 120, seed: int = 7) -> FactorizationMachine:
    """Fit (label, weight, bins) rows. One label only: a constant score.

    A first model has the terms that tell about the label alone. What it leaves unexplained shows which pairs of all
    terms tell more together than alone; if there are any, the model is fitted again with their terms too.
    """
    label, weight = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    share = float((label * weight).sum() / weight.sum()) if len(rows) else 0.0
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not 0 < share < 1:
        return FactorizationMachine(np.zeros(0, np.int64), prior, np.zeros(0), np.zeros((0, factors)))
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) for r in rows])
    bins = np.concatenate([r[2] for r in rows]).astype(np.int32)
    kept = choose_terms(bins, owner, label)
    # an unweighted model of the sample: its residuals are those of the rows as they are
    first, expected = fit(kept, bins, owner, label, np.ones(len(rows)), prior, factors, steps, seed)
    more = interacting_terms(bins, owner, label - expected, expected * (1 - expected))
    kept = np.union1d(kept, more)
    return fit(kept, bins, owner, label, weight, prior, factors, steps, seed)[0]


def fit(kept: np.ndarray, bins: np.ndarray, owner: np.ndarray, label: np.ndarray, weight: np.ndarray, prior: float, factors: int, steps: int, seed: int) -> tuple[FactorizationMachine, np.ndarray]:
    """The machine of the kept terms by Adam on the weighted logistic loss, and its chances of label 1 for the rows."""
    n = len(label)
    hit = np.isin(bins, kept)
    owner, at = owner[hit], np.searchsorted(kept, bins[hit])
    del bins, hit
    filler = np.full(n, len(kept))  # a term that weighs nothing, so that no text is without terms
    order = np.argsort(np.concatenate((owner, np.arange(n))), kind="stable")
    idx = np.concatenate((at, filler))[order]
    owner = np.concatenate((owner, np.arange(n)))[order]
    starts = np.searchsorted(owner, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    params = [np.array([prior]), np.zeros(len(kept) + 1), rng.normal(0, 0.02, (len(kept) + 1, factors))]
    params[2][-1] = 0
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        bias, w, v = params
        grads = [np.zeros(1), 1e-6 * w, 1e-5 * v]
        for a in range(0, n, BLOCK_ROWS):  # a block of texts at a time: memory stays bounded
            b = min(n, a + BLOCK_ROWS)
            own, first = idx[starts[a] : starts[b]], starts[a:b] - starts[a]
            of = owner[starts[a] : starts[b]] - a
            each = v[own]
            total = np.add.reduceat(each, first)
            raw = bias[0] + np.add.reduceat(w[own], first) + ((total**2).sum(1) - np.add.reduceat((each**2).sum(1), first)) / 2
            slope = weight[a:b] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[a:b])
            near = slope[of][:, None] * (total[of] - each)
            grads[0] += slope.sum()
            grads[1] += np.bincount(own, slope[of], len(kept) + 1)
            for f in range(factors):
                grads[2][:, f] += np.bincount(own, near[:, f], len(kept) + 1)
        grads[1][-1] = grads[2][-1] = 0
        for p, g, (m, s) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    model = FactorizationMachine(kept, float(params[0][0]), params[1][:-1], params[2][:-1])
    raw = np.concatenate([model.raw(idx[starts[a] : starts[min(n, a + BLOCK_ROWS)]], starts[a : min(n, a + BLOCK_ROWS)] - starts[a]) for a in range(0, n, BLOCK_ROWS)])
    return model, 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def sample_rows(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> list[tuple[int, float, np.ndarray]]:
    """(label, weight, bins) of the sampled rows: SAMPLE_ROWS at most reach the driver, however often an id is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [np.array(sorted({b for w in words_of(t) for b in bins_of(w)}), "<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("weight"), pa.array(bins, pa.binary())], names=["label", "weight", "bins"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    got = sampled_texts(rows, sample).select("text", "label", "weight").mapInArrow(run, "label int, weight double, bins binary").toArrow()
    found = [(label, weight, bins) for label, weight, bins in zip(got["label"].to_pylist(), got["weight"].to_pylist(), got["bins"].to_pylist(), strict=True)]
    return [(label, weight, np.frombuffer(bins, "<i4")) for label, weight, bins in sorted(found, key=lambda r: (r[0], len(r[2]), r[2]))]


class Scorer:
    """Scores texts by a model; a worker's own cache keeps which of the kept terms a word has."""

    def __init__(self, model: FactorizationMachine):
        self.model, self.place = model, {int(b): i for i, b in enumerate(model.bins)}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        terms, starts = [], []
        for text in texts:
            starts.append(len(terms))
            own = {-1}
            for w in words_of(text):
                if (got := self.known.get(w)) is None:
                    if len(self.known) >= CACHE:
                        self.known.clear()
                    got = self.known[w] = tuple(self.place[b] for b in bins_of(w) if b in self.place)
                if got:
                    own.update(got)
            terms.extend(own)
        raw = self.model.raw(np.array(terms, np.int64), np.array(starts, np.int64)) if starts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: the probability of label 1, of a null or empty text too. Ids are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> FactorizationMachine:
    """Model from labels of rows whose crc32(id as text) mod modulus is not remainder, SAMPLE_ROWS of them at most."""
    sample = labelled_sample(labels, label, remainder_is("doc_id", modulus, remainder), SAMPLE_ROWS)
    model = train(sample_rows(docs, sample, id_col, text_col))
    give_back()
    return model


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is under threshold.

    A null or empty text is scored as a text without terms, a very long one whole; each repeated row is judged by itself,
    and rows of equal text alike. A score of exactly threshold goes. Other columns, whatever their names, are passed on.
    Without rows the result is empty; without labels of both kinds all rows have one score.
    """
    model, at = learn(docs, labels, text_col=text_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Only texts are scored; other columns are not read. A null or empty text has the score of a text without terms, a row
    with a null id is scored and not held out, a repeated row is scored each time. A very long text is scored whole, as a
    set of terms; equal texts have equal scores. An id with several texts is learned from its smallest. Without labels of both kinds the
    score is constant; without rows the result is empty.
    """
    model = learn(docs, labels, modulus, remainder, id_col, text_col, label)
    return score(docs, model, id_col, text_col).select("doc_id", remainder_is("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toxicity over table documents, learned from table labels."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
