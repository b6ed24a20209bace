"""LM scoring by Brown classes.

Exchange clustering puts each word in a class. The CORE most frequent words are clustered by exchange on their bigram
counts, which is a table of bounded size. Every other word is then exchanged in rounds over the whole corpus: a round
adds up, for each word, the classes that it stands between, and moves it to the class where that gains most, all words
at once against the class bigrams of the round before. Rounds end when the classes' mutual information gains no more.
A text's probability is the product over its words, and one end, of the chance of the word's class after the class
before, and of the word in its class; both are smoothed.

Words come without bound, so no task and no driver holds them all: texts that follow one another make a block, which is
tokenised once; a block's words meet those of the other blocks in buckets of words, where each gets its count and its
class. What moves is packed: a row for each block and bucket, with counts and never places, so that a frequent word is
no heavier than others. All counts are exact: scores do not depend on how the table is cut into partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, remainder_is, table, text_bytes

CORE = 1_024
CLASSES = 48
SWEEPS = 8
#: Rounds of the exchange of all other words at most, and the share of mutual information that one must gain to go on.
ROUNDS, GAIN = 3, 0.002
#: Text bytes of a block.
BLOCK_BYTES = 8 << 20
END = b"\n"  # no word has white space
#: Classes beyond the exchanged ones: the end, words that have no class yet or were never seen.
END_CLASS, NEW_CLASS = CLASSES, CLASSES + 1
ALL_CLASSES = CLASSES + 2


class Places(dict):
    """Word: its place in the order of first meetings."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def tokens_of(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then the end."""
    words = text.lower().split()
    words.append(END)
    return words


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(3).compress(a.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def blocks_of(rows: DataFrame) -> DataFrame:
    """(block, words, ids, info): texts that follow one another in a task, BLOCK_BYTES of them or one that is longer.

    words: their words, sorted, a line each; ids: a place in words for each token, the end's after the last; info: an
    Arrow stream of doc_id, held_out and the texts' numbers of tokens. block is unique.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, places, ids = [], 0, Places(), []
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc, held_out, text in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), text_bytes(part.column("text")), strict=True):
                    tokens = tokens_of(text)
                    ids.append(np.fromiter(map(places.__getitem__, tokens), np.int32, len(tokens)))
                    kept.append((doc, held_out, len(tokens)))
                    size += len(text) + 1
                    if size >= BLOCK_BYTES:
                        yield out(kept, places, ids)
                        kept, size, places, ids = [], 0, Places(), []
        if kept:
            yield out(kept, places, ids)

    def out(kept: list[tuple], places: Places, ids: list[np.ndarray]) -> pa.RecordBatch:
        end = places.pop(END)
        words = sorted(places)
        sorted_place = np.full(len(words) + 1, len(words), np.int32)
        sorted_place[np.fromiter(map(places.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
        sorted_place[end] = len(words)
        docs, held_out, sizes = zip(*kept, strict=True)
        info = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(held_out, pa.bool_()), pa.array(sizes, pa.int64())], names=["doc_id", "held_out", "size"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, info.schema) as writer:
            writer.write_batch(info)
        listed = zstandard.ZstdCompressor(3).compress(b"\n".join(words))
        data = packed(sorted_place[np.concatenate(ids)])
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (listed, data, sink.getvalue().to_pybytes())], names=["words", "ids", "info"])

    made = rows.select("doc_id", "held_out", "text").mapInArrow(run, "words binary, ids binary, info binary")
    return made.select(F.monotonically_increasing_id().alias("block"), "words", "ids", "info")


class Block:
    """A block's words, its tokens as places in them, and its texts' ids, sizes and whether they are held out."""

    def __init__(self, words: bytes, ids: bytes, info: bytes, buckets: int):
        listed = zstandard.ZstdDecompressor().decompress(words)
        self.words = listed.split(b"\n") if listed else []
        self.ids = unpacked(ids, "<i4")
        self.info = pa.ipc.open_stream(info).read_next_batch()
        self.sizes = self.info.column("size").to_numpy()
        self.learned = np.repeat(~self.info.column("held_out").to_numpy(zero_copy_only=False), self.sizes)
        bucket = np.fromiter(map(zlib.crc32, self.words), np.int64, len(self.words)) % buckets
        self.order = np.argsort(bucket, kind="stable")  # words by bucket: the same wherever it is asked
        self.buckets, starts = np.unique(bucket[self.order], return_index=True)
        self.cuts = [*starts.tolist(), len(self.words)]

    def classes(self, core: dict[bytes, int], of: np.ndarray | None) -> np.ndarray:
        """A class for each place in words, and the end's; of: those of words outside the core, by bucket."""
        out = np.full(len(self.words) + 1, NEW_CLASS, np.uint8)
        if of is not None:
            out[self.order] = of
        out[:-1] = [core.get(w, c) for w, c in zip(self.words, out[:-1].tolist(), strict=True)]
        out[-1] = END_CLASS
        return out


def blocks_in(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in ("block", "words", "ids", "info")}
            yield row["block"], Block(row["words"], row["ids"], row["info"], buckets)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows, one at a time, of each bucket, from batches that come sorted by it."""
    rows = ({c: batch.column(c)[k].as_py() for c in batch.schema.names} for batch in batches for k in range(batch.num_rows))
    row = next(rows, None)
    while row is not None:
        bucket = row["bucket"]

        def own(row: dict = row) -> Iterator[dict]:
            nonlocal ahead
            yield row
            for other in rows:
                if other["bucket"] != bucket:
                    ahead = other
                    return
                yield other

        ahead = None
        yield bucket, own()
        row = ahead


def lexicon_of(blocks: DataFrame, buckets: int, most: int) -> DataFrame:
    """(block, bucket, place, n, size, types, once, top_words, top_n): for a block's words of a bucket, in order, their
    places among the bucket's words and their counts in the texts that are not held out.

    size: words of the bucket. On one row of each bucket: types, once: words with a place, and with one; top: its words
    of most places.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, got in blocks_in(batches, buckets):
            n = np.bincount(got.ids[got.learned], minlength=len(got.words) + 1)[got.order]
            words = [got.words[i] for i in got.order.tolist()]
            spans = list(zip(got.cuts[:-1], got.cuts[1:], strict=True))
            parts = [pa.array(got.buckets, pa.int32()), pa.array([block] * len(spans), pa.int64()), pa.array([b"\n".join(words[a:b]) for a, b in spans], pa.binary()), pa.array([n[a:b].astype("<i4").tobytes() for a, b in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(parts, names=["bucket", "block", "words", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches):
            places, total, blocks_of_rows, mine = Places(), np.zeros(1024, np.int64), [], []
            for row in rows:
                listed = row["words"].split(b"\n")
                at = np.fromiter(map(places.__getitem__, listed), np.int32, len(listed))
                if len(places) > len(total):
                    total = np.concatenate((total, np.zeros(len(places), np.int64)))
                total[at] += np.frombuffer(row["n"], "<i4")
                blocks_of_rows.append(row["block"])
                mine.append(at)
            total = total[: len(places)]
            words = list(places)
            first = sorted(np.argsort(-total, kind="stable")[: 2 * most].tolist(), key=lambda i: (-total[i], words[i]))
            if len(total) > 2 * most:  # ties at the cut: all words of that count
                least = total[first[-1]]
                first = sorted(np.flatnonzero(total >= max(least, 1)).tolist(), key=lambda i: (-total[i], words[i]))
            first = [i for i in first if total[i]][:most]
            rest = [None] * (len(mine) - 1)
            columns = [
                pa.array(blocks_of_rows, pa.int64()), pa.array([bucket] * len(mine), pa.int32()), pa.array([a.astype("<i4").tobytes() for a in mine], pa.binary()), pa.array([total[a].tobytes() for a in mine], pa.binary()), pa.array([len(total)] * len(mine), pa.int64()),
                pa.array([int((total > 0).sum()), *rest], pa.int64()), pa.array([int((total == 1).sum()), *rest], pa.int64()), pa.array([b"\n".join(words[i] for i in first), *rest], pa.binary()), pa.array([total[first].tobytes(), *rest], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "place", "n", "size", "types", "once", "top_words", "top_n"])

    counted = blocks.mapInArrow(count, "bucket int, block long, words binary, n binary").repartition("bucket").sortWithinPartitions("bucket", "block")
    return counted.mapInArrow(merge, "block long, bucket int, place binary, n binary, size long, types long, once long, top_words binary, top_n binary")


def frequent_words(lexicon: DataFrame, most: int) -> list[bytes]:
    """The most frequent words of the texts that are not held out, by their exact counts; of equal ones the first."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n in zip(batch.column("top_words").to_pylist(), batch.column("top_n").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(words.split(b"\n") if words else [], pa.binary()), pa.array(np.frombuffer(n, "<i8"))], names=["word", "n"])

    top = lexicon.where("types IS NOT NULL").select("top_words", "top_n").mapInArrow(spread, "word binary, n long")
    return [bytes(r["word"]) for r in top.orderBy(F.desc("n"), "word").limit(most).collect()]


def pair_counts(found: DataFrame, size: int) -> np.ndarray:
    """The table of found (pair, n): size squared numbers at most."""
    got = found.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size, size)


def pair_rows(total: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["pair", "n"])


def core_bigrams(blocks: DataFrame, core: list[bytes]) -> np.ndarray:
    """Counts of (word, next word) over core places; place len(core) is any other word. A text starts after an end."""
    size = len(core) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(core)}
        total = np.zeros(size * size, np.int64)
        for _, got in blocks_in(batches, 1):
            of = np.array([*(place.get(w, len(core)) for w in got.words), place[END]])
            seen = np.concatenate(([place[END]], of[got.ids[got.learned]]))
            total += np.bincount(seen[:-1] * size + seen[1:], minlength=size * size)
        yield pair_rows(total)

    return pair_counts(blocks.mapInArrow(count, "pair long, n long"), size)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each core word (the last row and column are other words, which keep a class of their own).

    Words are taken by frequency. Each is moved to the class where the sum of n log n over class bigrams, less that over
    class counts on both sides, is highest; sweeps go on until none moves.
    """
    size = len(bigrams) - 1
    classes = max(1, min(classes, size))
    of = np.append(np.arange(size) % classes, classes)
    table = np.zeros((classes + 1, classes + 1))
    np.add.at(table, (of[:, None], of[None, :]), bigrams)
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-12)), 0.0)
    for _ in range(sweeps):
        moved = 0
        for w in range(size):
            old, own = of[w], bigrams[w, w]
            out_row, in_row = bigrams[w].copy(), bigrams[:, w].copy()
            out_row[w] = in_row[w] = 0
            after, before = np.bincount(of, out_row, classes + 1), np.bincount(of, in_row, classes + 1)
            table[old] -= after
            table[:, old] -= before
            table[old, old] -= own
            row, column, diagonal = table.sum(1), table.sum(0), np.diag(table)
            # gain of adding the word to each class: its row, its column, and the corner where both meet
            new_rows, new_columns = table + after[None, :], table + before[:, None]
            gain = (xlogx(new_rows) - xlogx(table)).sum(1) + (xlogx(new_columns) - xlogx(table)).sum(0)
            corner = diagonal + after + before + own
            gain += xlogx(corner) - xlogx(diagonal + after) - xlogx(diagonal + before) + xlogx(diagonal)
            gain -= xlogx(row + after.sum() + own) - xlogx(row) + xlogx(column + before.sum() + own) - xlogx(column)
            new = int(gain[:classes].argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            of[w] = new
            table[new] += after
            table[:, new] += before
            table[new, new] += own
        if not moved:
            break
    return of[:size]


def contexts(blocks: DataFrame, words: DataFrame | None, core: dict[bytes, int], buckets: int) -> DataFrame:
    """(bucket, block, around, pairs): for a block's words of a bucket, what they stand between, packed.

    words: (block, bucket, class), or None before the first round. around: steps between the keys (word, side, class)
    that occur, and how often each does; side 0 is the class before. Row -1 of a block has its class bigrams as pairs.
    """

    def rows_of(block: int, got: Block, of: np.ndarray | None) -> list[tuple]:
        classes = got.classes(core, of)
        ids = got.ids[got.learned]
        seen = np.concatenate(([END_CLASS], classes[ids], [END_CLASS])).astype(np.int64)
        pairs = np.bincount(seen[:-2] * ALL_CLASSES + seen[1:-1], minlength=ALL_CLASSES**2)
        rank = np.empty(len(got.words) + 1, np.int64)
        rank[got.order] = np.arange(len(got.words))
        free = np.array([*(w not in core for w in got.words), False])
        at = np.flatnonzero(free[ids])
        key = rank[ids[at]] * (2 * ALL_CLASSES)
        times = np.bincount(np.concatenate((key + seen[at], key + ALL_CLASSES + seen[at + 2])), minlength=len(got.words) * 2 * ALL_CLASSES)
        keys = np.flatnonzero(times)
        times = times[keys].astype("<i4")
        out = [(-1, block, b"", packed(pairs.astype("<i8")))]
        spans = np.searchsorted(keys, np.array(got.cuts) * (2 * ALL_CLASSES)).tolist()
        for bucket, first, a, b in zip(got.buckets.tolist(), got.cuts[:-1], spans[:-1], spans[1:], strict=True):
            steps = np.diff(keys[a:b], prepend=first * 2 * ALL_CLASSES).astype("<i4")
            out.append((bucket, block, packed(np.concatenate((steps, times[a:b]))), b""))
        return out

    names, schema = ("bucket", "block", "around", "pairs"), "bucket int, block long, around binary, pairs binary"

    def as_columns(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)]

    if words is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, got in blocks_in(batches, buckets):
                yield pa.RecordBatch.from_arrays(as_columns(rows_of(block, got, None)), names=names)

        return blocks.mapInArrow(run, schema)

    def again(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for block, got in blocks_in(left.to_batches(), buckets):
            rows = rows_of(block, got, in_order(right, "class", np.uint8))
        return pa.table(as_columns(rows), names=names)

    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(again, schema)


def in_order(rows: pa.Table, column: str, kind) -> np.ndarray:
    """The packed column of a block's rows, by bucket."""
    parts = rows.select(["bucket", column]).sort_by("bucket")[column].to_pylist()
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(p, kind) for p in parts)])


def information(pairs: np.ndarray) -> float:
    """Mutual information of a class and the next, times the number of places."""
    rows, columns = pairs.sum(1, keepdims=True), pairs.sum(0, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.nansum(np.where(pairs > 0, pairs * np.log(pairs * pairs.sum() / (rows * columns)), 0)))


def assign(around: DataFrame, lexicon: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(block, bucket, class): the class of each of a block's words of a bucket, in order.

    A word goes to the class that is likeliest between the classes it stands between, over all of its places; of equally
    likely ones the first. A word without places that are not held out stays without one.
    """
    smooth = pairs + 0.1
    after = np.log(smooth / smooth.sum(0, keepdims=True))[:CLASSES]  # [class, next]: how the class is drawn to what follows
    before = np.log(smooth / smooth.sum(1, keepdims=True))[:, :CLASSES]  # [previous, class]
    weight = np.concatenate((before, after.T))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches):
            counts, blocks_of_rows, mine = None, [], []
            for row in rows:
                at = np.frombuffer(row["place"], "<i4")
                counts = np.zeros(row["size"] * 2 * ALL_CLASSES, np.int64) if counts is None else counts
                got = unpacked(row["around"], "<i4")
                steps, times = got[: len(got) // 2], got[len(got) // 2 :]
                word, rest = np.divmod(np.cumsum(steps, dtype=np.int64), 2 * ALL_CLASSES)
                counts[at[word] * np.int64(2 * ALL_CLASSES) + rest] += times
                blocks_of_rows.append(row["block"])
                mine.append(at)
            counts = counts.reshape(-1, 2 * ALL_CLASSES)
            best = np.full(len(counts), NEW_CLASS, np.uint8)
            for a in range(0, len(counts), 50_000):
                part = counts[a : a + 50_000]
                seen = part.any(1)
                best[a : a + 50_000][seen] = np.round(part[seen] @ weight, 6).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(blocks_of_rows, pa.int64()), pa.array([bucket] * len(mine), pa.int32()), pa.array([best[at].tobytes() for at in mine], pa.binary())], names=["block", "bucket", "class"])

    rows = around.where("bucket >= 0").join(lexicon.select("block", "bucket", "place", "size"), ["block", "bucket"]).select("bucket", "block", "place", "size", "around")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(choose, "block long, bucket int, class binary")


def class_pairs(around: DataFrame) -> np.ndarray:
    """The blocks' class bigrams, added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALL_CLASSES**2, np.int64)
        for batch in batches:
            for pairs in batch.column("pairs").to_pylist():
                total += unpacked(pairs, "<i8")
        yield pair_rows(total)

    return pair_counts(around.where("bucket = -1").select("pairs").mapInArrow(add, "pair long, n long"), ALL_CLASSES)


def classed(blocks: DataFrame, words: DataFrame, core: dict[bytes, int], buckets: int) -> DataFrame:
    """One row a text; words: (block, bucket, n, class). classes: a byte a token, packed; base and emission: sums of
    log10(n + 1) and log10(n) over its words; pairs: the block's class bigrams, on its first text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, held, columns = [], [], [[] for _ in range(5)]
        pairs = []
        for _, got in blocks_in(left.to_batches(), buckets):
            n = np.zeros(len(got.words) + 1, np.int64)
            n[got.order] = in_order(right, "n", np.int64)
            classes = got.classes(core, in_order(right, "class", np.uint8))
            classes[:-1][n[:-1] == 0] = NEW_CLASS
            seen = classes[got.ids]
            learned = np.concatenate(([END_CLASS], seen[got.learned])).astype(np.int64)
            starts = np.cumsum(got.sizes) - got.sizes
            sums = [np.add.reduceat(x[got.ids], starts) for x in ((n > 0).astype(np.int64), np.log10(n + 1.0), np.log10(np.maximum(n, 1)))]
            docs, held = got.info.column("doc_id").to_pylist(), got.info.column("held_out").to_pylist()
            columns = [[seen[a : a + k].tobytes() for a, k in zip(starts.tolist(), got.sizes.tolist(), strict=True)], got.sizes, *sums]
            pairs = [packed(np.bincount(learned[:-1] * ALL_CLASSES + learned[1:], minlength=ALL_CLASSES**2).astype("<i8")), *[None] * (len(docs) - 1)]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ("classes", "n_tokens", "n_known", "base", "emission")
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "held_out": pa.array(held, pa.bool_())} | {k: pa.array(c, t) for k, c, t in zip(names, columns, kinds, strict=True)} | {"pairs": pa.array(pairs, pa.binary())})

    schema = "doc_id long, held_out boolean, classes binary, n_tokens long, n_known long, base double, emission double, pairs binary"
    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, schema)


def smooth(pairs: np.ndarray, new_share: float) -> np.ndarray:
    """log10 chance of each next class. Half a count is taken off every pair seen, and goes with one count more to the
    classes by their shares of all places; words never seen have new_share of the whole."""
    share = pairs.sum(0) + 0.5
    share[NEW_CLASS] = 0
    chance = (np.maximum(pairs - 0.5, 0) + (np.minimum(pairs, 0.5).sum(1, keepdims=True) + 1.0) * share / share.sum()) / (pairs.sum(1, keepdims=True) + 1.0)
    chance = chance / chance.sum(1, keepdims=True) * (1 - new_share)
    chance[:, NEW_CLASS] = new_share
    return np.log10(chance)


def brown_scores(df: DataFrame, scratch: Scratch, modulus: int = 7, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of df.

    Learns from rows whose crc32(id as text) mod modulus is not remainder. A null or empty text is the end alone; a very
    long one is a block by itself. Rows with a null id are learned from and scored. Repeated rows count and are scored
    each time; equal texts have equal scores. Words of equal counts are taken in their order, a word of equally good
    classes goes to the first. Other columns are not read. Without rows the result is empty; without rows to learn from
    every word is new.
    """
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", remainder_is("doc_id", modulus, remainder))
    blocks = scratch.save(blocks_of(rows), "blocks")
    buckets = max(16, blocks.count() // 2)
    lexicon = scratch.save(lexicon_of(blocks, buckets, CORE), "lexicon")
    core = [*frequent_words(lexicon, CORE - 1), END]
    bigrams = core_bigrams(blocks, core)
    # the end keeps a class of its own: it is not exchanged
    inner = np.delete(np.delete(bigrams, len(core) - 1, 0), len(core) - 1, 1)
    of_core = dict(zip(core, exchange(inner, CLASSES).tolist(), strict=False))

    around = scratch.save(contexts(blocks, None, of_core, buckets), "around0")
    words = scratch.save(assign(around, lexicon, class_pairs(around)), "words0")
    scratch.drop("around0")
    best, kept = -1.0, words
    for k in range(1, ROUNDS + 1):
        around = scratch.save(contexts(blocks, words, of_core, buckets), f"around{k}")
        pairs = class_pairs(around)  # of the classes that the round starts from
        gained = information(pairs)
        if gained <= best * (1 + GAIN) or k == ROUNDS:
            kept = words if gained > best else kept
            break
        best, kept = gained, words
        words = scratch.save(assign(around, lexicon, pairs), f"words{k}")
        scratch.drop(f"around{k}")
    known = kept.join(lexicon.select("block", "bucket", "n"), ["block", "bucket"])
    sequences = scratch.save(classed(blocks, known, of_core, buckets), "sequences")

    bigram = sequences.where("pairs IS NOT NULL").select(F.lit(-1).alias("bucket"), "pairs")
    pairs = class_pairs(bigram)
    totals = pairs.sum(0)  # places of each class
    n_all, ends = int(totals.sum()), int(totals[END_CLASS])
    types, once = lexicon.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("once"), F.lit(0))).first()
    v_all = types + (ends > 0)
    new_share = max(once, 1) / max(n_all + 1, 2) if once < n_all else 0.5
    # a class's next, and the word's share of the class, but for the word's own count
    chance = (smooth(pairs, new_share) - np.log10(np.maximum(totals, 1))[None, :] * (np.arange(ALL_CLASSES) != NEW_CLASS)).ravel()
    end_base, end_emit, floor = float(np.log10(ends + 1)), float(np.log10(max(ends, 1))), float(np.log10(n_all + 1.0 * (v_all + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moves = []
            for classes in batch.column("classes").to_pylist():
                a = np.frombuffer(b"%c%s" % (END_CLASS, classes), np.uint8).astype(np.int64)
                moves.append(float(chance[a[:-1] * ALL_CLASSES + a[1:]].sum()))
            tokens = batch.column("n_tokens").to_numpy()
            known = batch.column("n_known").to_numpy() + (ends > 0)
            base = batch.column("base").to_numpy() + end_base - tokens * floor
            total = batch.column("emission").to_numpy() + end_emit + np.array(moves, float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"), pa.array(known, pa.int64()), pa.array(base), pa.array(total)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = sequences.drop("pairs").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brown_scores over table documents, held out where crc32(doc_id as text) mod 7 is 2."""
    return brown_scores(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))
