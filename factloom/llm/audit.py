"""Filter interaction audit: what each filter of a chain removes, in every order, from one pass over the texts.

A document's failures are a mask of bits, so all orders and steps are sums over counts of masks. Whether a text stood in
a row of a smaller id takes the whole table: its rows are split by length in code points, then again and again by the
hash of their next block (blocks grow fourfold, and the last ends with the text), and rows that are alone in their class
drop out. Only the rows of classes that are left have their whole texts compared.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, small, table

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
#: Code points of the first block; the next is four times as long.
BLOCK = 64


def failures(text: Column) -> list[Column]:
    """Whether a text fails filters A to D: few words, repeated words, capitals, odd characters."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text), text.rlike(r"[#$%&*|]")]


def block_hashes(text: Column, block: int) -> Column:
    """Hashes of a text's blocks, as many as it has: block k ends at code point block * (4^(k + 1) - 1) / 3."""
    start = lambda k: F.floor(block * (F.pow(F.lit(4), k) - 1) / 3).cast("int")
    last = F.ceil(F.log(3.0 * F.length(text) / block + 1) / F.log(F.lit(4.0))) - 1
    # one block more than rounding may lose; that of an exact length is empty
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int") + 1), lambda k: F.xxhash64(F.substring(text, start(k) + 1, start(k + 1) - start(k))))


def refined(rows: DataFrame, scratch: Scratch, depth: int) -> DataFrame:
    """(class, hashes) of rows (class, hashes, ...) after all blocks, classes of one row left out; class covers all blocks."""
    for k in range(depth + 1):
        many = scratch.save(rows.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"), f"classes{k}")
        rows = rows.join(small(many), "class", "left_semi")
        if k < depth:  # a text without a block k stays in its class: its length says so
            rows = scratch.save(rows.withColumn("class", F.when(F.size("hashes") > k, F.xxhash64("class", F.expr(f"get(hashes, {k})"))).otherwise(F.col("class"))), f"rows{k}")
            if k:
                scratch.drop(f"rows{k - 1}")
    return rows


def duplicates(texts: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(class, text_id, least): for each text that several rows of texts (doc_id, text) with an id have, the smallest id.

    class is text_class of the text; text_id is null where the class has one text alone, else the text itself, for the
    64 bits of a class may be shared by texts.
    """
    own = texts.where("doc_id IS NOT NULL").select(F.length("text").cast("long").alias("class"), block_hashes(F.col("text"), block).alias("hashes"))
    own = scratch.save(own, "blocks")
    depth = own.agg(F.max(F.size("hashes"))).first()[0] or 0
    left = scratch.save(refined(own, scratch, depth).select("class").distinct(), "left")
    again = texts.where("doc_id IS NOT NULL").withColumn("class", text_class(F.col("text"), block)).join(small(left), "class", "left_semi")
    # copies are put together before they move
    whole = scratch.save(again.groupBy("class", "text").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "whole")
    shared = scratch.save(whole.groupBy("class").agg(F.count("*").alias("texts")).where("texts > 1").select("class"), "shared")
    alone = whole.join(small(shared), "class", "left_anti").where("n > 1").select("class", F.lit(None).cast("string").alias("text_id"), "least")
    return alone.union(whole.join(small(shared), "class", "left_semi").where("n > 1").select("class", "text", "least"))


def text_class(text: Column, block: int = BLOCK) -> Column:
    """A text's class after all blocks."""
    return F.aggregate(block_hashes(text, block), F.length(text).cast("long"), lambda c, h: F.xxhash64(c, h))


def masks(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", block: int = BLOCK) -> DataFrame:
    """(part, mask, good, toxic, n): documents of a part by the filters that they fail, bit k for filter k, and labels.

    A null text is empty, a null part the empty string. A null id has no smaller one and isn't smaller than any; rows of
    one id aren't copies of each other, but all are of a smaller id's. An id labelled more than once has its largest
    labels, and labels without an id count for nothing. A very long text is read whole.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    found = scratch.save(duplicates(texts, scratch, block), "copies")
    narrow = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        sum(F.when(fails, F.lit(1 << k)).otherwise(0) for k, fails in enumerate(failures(text))).alias("mask"),
        text_class(text, block).alias("class"),
        text.alias("text"),
    )
    several = found.where("text_id IS NOT NULL")
    if several.limit(1).count():  # texts that share a class are told apart by themselves, in those classes alone
        odd = small(scratch.save(several.select("class").distinct(), "odd")).withColumn("odd", F.lit(True))
        narrow = narrow.join(odd, "class", "left").withColumn("text_id", F.when(F.col("odd"), F.col("text"))).drop("odd", "text")
        joined = narrow.join(small(found), narrow["class"].eqNullSafe(found["class"]) & narrow["text_id"].eqNullSafe(found["text_id"]), "left").drop(found["class"])
    else:
        joined = narrow.drop("text").join(small(found.drop("text_id")), "class", "left")
    copy = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
    joined = scratch.save(joined.select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask")), "masks")
    marked = labels.select(labels["doc_id"].cast("long").alias("of"), labels["quality"].cast("int").alias("q"), labels["toxic"].cast("int").alias("t")).where("of IS NOT NULL")
    marked = marked.groupBy("of").agg(F.max("q").alias("q"), F.max("t").alias("t"))
    seen = joined.join(marked, joined["doc_id"] == marked["of"], "left")
    is_one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return seen.groupBy("part", "mask", is_one("q").alias("good"), is_one("t").alias("toxic")).agg(F.count("*").alias("n"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A row for each part of counts (part, mask, good, toxic, n), order of the filters and step. Without counts there are
    no rows.
    """
    total = lambda of: F.sum(F.when(of, F.col("n")).otherwise(0))
    sums = [(name, F.array(*(total((F.col("mask") == m) & cond) for m in range(1 << len(filters))))) for name, cond in (("every", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))]
    parts = counts.groupBy("part").agg(*(c.alias(f"n_{name}") for name, c in sums))
    # what stands before a filter is a set of others: 80 pairs for five filters, each worked out once
    cases = sorted({(sum(1 << filters.index(f) for f in order[:k]), filters.index(order[k])) for order in permutations(filters) for k in range(len(filters))})
    case = F.explode(F.array(*(F.struct(F.lit(before).alias("before"), F.lit(at).alias("at"), F.lit(1 << at).alias("bit")) for before, at in cases)))
    rows = parts.select("*", case.alias("case"))

    def over(column: str, holds) -> Column:
        """Documents of the masks m that hold."""
        places = F.transform(F.col(column), lambda n, m: F.when(holds(m), n).otherwise(0))
        return F.aggregate(places, F.lit(0).cast("long"), lambda a, b: a + b)

    before, bit = F.col("case.before"), F.col("case.bit")
    hit = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(bit) != 0)
    orders = list(permutations(filters))
    share = F.aggregate(F.transform(F.col("n_every"), lambda n, m: F.when(m.bitwiseAND(bit) != 0, F.floor(n * len(orders) / F.bit_count(m)).cast("long")).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)
    rows = rows.select(
        "part",
        before.alias("before"),
        F.col("case.at").alias("at"),
        over("n_every", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        over("n_every", hit).alias("removed"),
        over("n_every", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(bit) != 0)).alias("redundant"),
        over("n_every", lambda m: m == bit).alias("unique_fails"),
        over("n_good", hit).alias("good_lost"),
        over("n_toxic", hit).alias("toxic_lost"),
        share.alias("shapley"),
    )
    steps: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in orders:
        for k in range(len(filters)):
            steps.setdefault((sum(1 << filters.index(f) for f in order[:k]), filters.index(order[k])), []).append(("".join(order), k + 1))
    spark = counts.sparkSession
    places = spark.createDataFrame([(before, at, filters[at], steps[before, at]) for before, at in cases], "before int, at int, filter string, places array<struct<filter_order:string,step:int>>")
    out = rows.join(F.broadcast(places), ["before", "at"]).select("*", F.explode("places").alias("place"))  # a row for each case
    return out.select("part", "place.filter_order", "place.step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """interactions of the five filters over table documents, by source, with table labels; odd rows are as in masks."""
    counts = masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), scratch := Scratch(spark, "op11"))
    return interactions(scratch.save(counts, "counts"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM w),
f AS (
  SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(least < doc_id, false)] AS fails
  FROM x),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
t AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS places
  FROM t a, t b, t c, t d, t e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, step, places[step] AS place, places[1:step - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
h AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, place, n, good, bad, fails[place] AS own,
    len(list_filter(before, lambda p: fails[p])) AS earlier, len(list_filter(fails, lambda x: x)) AS failed
  FROM d, s),
r AS (
  SELECT part, filter_order, step, place,
    sum(CASE WHEN NOT own AND earlier = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN own AND earlier > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN own AND earlier = 0 AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN own AND earlier = 0 AND bad THEN n ELSE 0 END) AS toxic_lost
  FROM h GROUP BY ALL)
SELECT part, filter_order, step, ['A', 'B', 'C', 'D', 'E'][place] AS filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, place) AS BIGINT) AS shapley
FROM r"""
