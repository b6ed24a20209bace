"""Best-fit packing with certified bounds.

Pieces have at most CAPACITY different lengths, so a partition is its histogram of lengths. Best-fit decreasing runs on
each partition's histogram, and dual-feasible functions give a lower bound on the sequences that its pieces need. A
partition that meets its bound is certified: no packing of it is smaller. The others have gaps; FAN_IN of them at a time
exchange their documents, best-fit decreasing runs again on what they have together, and so on, until all are certified
or one group is left. Only histograms move for that. A piece then finds its sequence by its rank among the pieces of its
length in its group.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, table

CAPACITY = 1024
END = 2
#: Groups that exchange their documents in a round, and ranks of a length in a bucket of the join with the plan.
FAN_IN = 16
RANKS = 256
#: Longest pieces tried first where a sequence can't be filled by two more pieces.
TRIES = 24
#: Texts on which the fast encoder must agree with the tokenizers library before it is used.
PROBES = ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "", "Hello  world!\n\n it's 12345 ", "Ünïcode ñandú 漢字 🙂\t\r\n x", "<|endoftext|> a b   c", "ABC***### |  ", "\x00\x01   z")


@cache
def encoder(path: str):
    """Encoder with the vocabulary of a byte-level BPE file of the tokenizers library; the file's added tokens have their own ids.

    tiktoken encodes, several times as fast; the ids are those of the tokenizers library as it comes, which is asked for
    PROBES.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves
    byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    slow = Tokenizer.from_file(path)
    for text in PROBES:
        if fast.encode(text, allowed_special="all") != slow.encode(text, add_special_tokens=False).ids:
            raise ValueError(f"{path}: the fast encoder disagrees on {text!r}")
    return fast


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one, or full ones after a first that may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and rank of each piece of each row, and ids if asked for.

    rank: how many pieces of the same length its task had before it. A long text is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_to_numpy
        tail = np.array([end], dtype="<u4")
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.concatenate((encode(text or "", allowed_special="all").astype("<u4"), tail))
                for k, (a, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[a : a + n]
                    rows.append((doc, k, a, n, zlib.crc32(part.tobytes()), seen[n], *([part] if with_ids else [])))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "rank")), *([("ids", pa.list_(pa.int64()))] if with_ids else [])])
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long" + ", ids array<long>" * with_ids)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Placements (length, first rank, pieces, first sequence, pieces a sequence, offset) and the number of sequences.

    Best-fit decreasing, a run of like sequences at a time: a piece goes where the least room is left that holds it, so
    a sequence with room r takes floor(r / length) pieces of a length before the next one gets any.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, sequences)
    out, bins = [], 0
    for size in sorted((s for s, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[size]
        for room in [r for r in sorted(rooms) if r >= size]:
            each = room // size
            while left and rooms.get(room):
                first, n = rooms[room].pop()
                if left >= each:
                    take = min(n, left // each)
                    out.append((size, rank, take * each, first, each, capacity - room))
                    rooms.setdefault(room - each * size, []).append((first, take))
                    rank, left = rank + take * each, left - take * each
                else:
                    take = 1
                    out.append((size, rank, left, first, left, capacity - room))
                    rooms.setdefault(room - left * size, []).append((first, 1))
                    rank, left = rank + left, 0
                if take < n:
                    rooms.setdefault(room, []).append((first + take, n - take))
            if room in rooms and not rooms[room]:
                del rooms[room]
            if not left:
                break
        if left:
            each = capacity // size
            for n, k in ((left // each, each), (1, left % each)):
                if n and k:
                    out.append((size, rank, n * k, bins, k, 0))
                    rooms.setdefault(capacity - k * size, []).append((bins, n))
                    rank, bins = rank + n * k, bins + n
    return out, bins


def fullest_pair(counts: np.ndarray, room: int) -> tuple[int, list[int]]:
    """The most that one or two pieces fill of the room, and their lengths; among equals the longest first piece."""
    sizes = np.flatnonzero(counts[: room + 1])
    if not len(sizes):
        return 0, []
    fits = np.zeros(room + 1, np.int64)  # longest piece that fits into a room
    fits[sizes] = sizes
    fits = np.maximum.accumulate(fits)
    first = sizes[::-1]
    second = fits[room - first]
    second = np.where((second == first) & (counts[first] < 2), fits[np.maximum(second - 1, 0)], second)
    k = int((first + second).argmax())
    return int(first[k] + second[k]), [int(x) for x in (first[k], second[k]) if x]


def fullest_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """As best_fit_decreasing, but a sequence is filled at once: its longest piece, and then the one or two, or three,
    pieces that leave the least room. Each choice is used for as many sequences as the counts allow, so that there are
    about as many choices as lengths."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    ranks, out, bins, top = [0] * (capacity + 1), [], 0, capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out, bins
        chosen, room = [top], capacity - top
        left[top] -= 1
        while room:
            filled, more = fullest_pair(left, room)
            if not filled:
                break
            if filled < room:
                for x in np.flatnonzero(left[: room + 1])[::-1][:TRIES].tolist():
                    left[x] -= 1
                    rest, two = fullest_pair(left, room - x)
                    left[x] += 1
                    if x + rest > filled:
                        filled, more = x + rest, [x, *two]
                    if filled == room:
                        break
            for x in more:
                left[x] -= 1
            chosen, room = chosen + more, room - filled
        sizes, each = np.unique(chosen, return_counts=True)
        left[sizes] += each
        times = int((left[sizes] // each).min())
        left[sizes] -= times * each
        at = 0
        for size, k in zip(sizes.tolist(), each.tolist(), strict=True):
            out.append((size, ranks[size], times * k, bins, k, at))
            ranks[size] += times * k
            at += k * size
        bins += times


def smallest(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The plan with the fewer sequences."""
    return min(best_fit_decreasing(counts, capacity), fullest_fit_decreasing(counts, capacity), key=lambda x: x[1])


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: the largest bound of two families of dual-feasible functions, in whole numbers."""
    size = np.array([s for s, c in counts.items() if c], dtype=np.int64)
    n = np.array([c for c in counts.values() if c], dtype=np.int64)
    if not len(size):
        return 0
    best = -(-int((size * n).sum()) // capacity)
    for cut_off in range(1, capacity // 2 + 1):  # large pieces count as whole sequences, small ones as nothing
        whole, middle = size > capacity - cut_off, (size >= cut_off) & (size <= capacity - cut_off)
        best = max(best, int(n[whole].sum()) - (-int((size * n)[middle].sum()) // capacity))
    for k in range(1, 20):  # sizes rounded down to k-ths, unless they are (k + 1)-ths exactly
        exact = (k + 1) * size % capacity == 0
        total = int(((k + 1) * size // capacity * n)[~exact].sum()) * capacity + int((size * n)[exact].sum()) * k
        best = max(best, -(-total // (k * capacity)))
    return best


PLAN = ("length", "first_rank", "n", "first_sequence", "each", "at", "bins", "bound")


def plans(hist: DataFrame, scratch: Scratch, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Plans of the groups, (gid, length, first_rank, n, ...), and (part, length, gid, before): the group that a part's
    pieces of a length are packed in, and how many pieces of that length the group has from other parts before them.

    hist: (part, length, n). A group of the first round is a part. Groups that miss their bound are put together,
    FAN_IN at a time in the order of their parts, until there is one. Nothing but histograms is read, in one task for
    each group, whose rows are CAPACITY times FAN_IN at most.
    """

    def solver(last: bool):
        def solve(key: tuple, rows: pa.Table) -> pa.Table:
            had = dict(zip(rows["length"].to_pylist(), rows["n"].to_pylist(), strict=True))
            bound = lower_bound(had, capacity)
            plan, bins = smallest(had, capacity)
            done = [(*p, bins, bound) for p in plan] if last or bins == bound else []
            columns = list(zip(*done, strict=True)) or [()] * len(PLAN)
            return pa.table({"gid": pa.array([key[0].as_py()] * len(done), pa.int64())} | {k: pa.array(c, pa.int64()) for k, c in zip(PLAN, columns, strict=True)})

        return solve

    todo = hist.withColumn("place", F.col("part").cast("long"))
    made, members, step = [], [], 0
    most = hist.agg(F.max("part")).first()[0]
    while most is not None:
        first_gid = F.lit(step << 22)  # ids of groups differ between rounds
        mine = todo.withColumn("gid", first_gid + F.col("place"))
        sums = mine.groupBy("gid", "length").agg(F.sum("n").alias("n"))
        plan = scratch.save(sums.groupBy("gid").applyInArrow(solver(most == 0), "gid long, " + ", ".join(f"{c} long" for c in PLAN)), f"plan{step}")
        done = plan.select("gid").distinct()
        among = Window.partitionBy("gid", "length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        placed = mine.join(done, "gid", "left_semi").withColumn("before", F.coalesce(F.sum("n").over(among), F.lit(0)))
        made.append(plan)
        members.append(scratch.save(placed.select("part", "length", "gid", "before"), f"members{step}"))
        if most == 0:
            break
        left = mine.join(done, "gid", "left_anti").withColumn("place", F.floor(F.col("place") / FAN_IN)).drop("gid")
        todo = scratch.save(left, f"left{step}")
        most, step = todo.agg(F.max("place")).first()[0], step + 1
    if not made:
        return hist.sparkSession.createDataFrame([], "gid long, " + ", ".join(f"{c} long" for c in PLAN)), hist.select("part", "length", F.lit(0).cast("long").alias("gid"), F.lit(0).cast("long").alias("before"))
    union = lambda tables: tables[0] if len(tables) == 1 else tables[0].unionByName(union(tables[1:]))
    return union(made), union(members)


def pack(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, group_bins, group_bound (and ids).

    A null or empty text is the end id alone. The id may be null or repeated: each row is a document by itself. A very
    long text is encoded whole and cut into as many pieces as it needs. Pieces of equal length are alike: which of them
    goes where follows their order in the table. Other columns of df are not read. group_bins and group_bound: sequences
    of the group that the piece was packed in and the proven lower bound of them, equal where the group is certified;
    full pieces are sequences of their own, for which both are null. Without rows the result is empty.
    """
    cut_up = pieces(df, id_col, text_col, tokenizer or default_tokenizer(), capacity, end, with_ids)
    cut_up = scratch.save(cut_up.withColumns({"part": F.spark_partition_id(), "own": F.monotonically_increasing_id()}), "pieces")
    full, rest = cut_up.where(F.col("length") == capacity), cut_up.where(F.col("length") < capacity)
    hist = scratch.save(rest.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    plan, members = plans(hist, scratch, capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    # a row of the plan for each RANKS of its ranks: a piece meets few rows beside its own
    buckets = F.sequence(F.floor(F.col("first_rank") / RANKS), F.floor((F.col("first_rank") + F.col("n") - 1) / RANKS))
    plan = plan.withColumn("bucket", F.explode(buckets))
    ranked = rest.join(members, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    hit = ranked.withColumn("bucket", F.floor(F.col("rank") / RANKS)).join(plan, ["gid", "length", "bucket"])
    hit = hit.where("rank >= first_rank AND rank < first_rank + n").withColumn("step", F.expr("rank - first_rank"))
    sequence = F.col("gid") * F.lit(2**38) + F.col("first_sequence") + F.floor(F.col("step") / F.col("each"))
    placed = hit.select(*columns, sequence.alias("sequence_id"), (F.col("at") + F.col("step") % F.col("each") * F.col("length")).alias("offset"), F.col("bins").alias("group_bins"), F.col("bound").alias("group_bound"))
    none = F.lit(None).cast("long")
    return placed.unionByName(full.select(*columns, (-1 - F.col("own")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), none.alias("group_bins"), none.alias("group_bound")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack over table documents: sequences of 1024 tokens, byte_bpe_50k.json, end id 2."""
    return pack(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))
