"""Claims from text: sentences as candidates, and the gate that lets through only what the source bears out.

A candidate quotes a span of its chunk. The span must stand there and overlap a span that selection kept; every word that
the claim adds must stand in the chunk, its neighbours of the same section, or the document's header. All of it is joins
by chunk and set operations on arrays, so that a model's candidates are judged where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words and signs that an addition may use though the source lacks them.
SCAFFOLD = (
    "said", "says", "saying", "asked", "asks", "told", "tells", "mentioned", "mentions", "wrote", "writes", "according", "that", "the", "a", "an", "of", "to", "in", "on", "at", "and", "or", "is", "was", "were", "be", "been", "she", "he", "they", "her", "his", "their",
    "it", "its", "this", "these", "those", "with", "for", "as", "by", "from", ",", ".", ":", ";", '"', "'", "“", "”", "‘", "’", "'s",
)
#: Precisions of a claim's window that need both ends.
BOUNDED = ("day", "month", "quarter", "year")

WORD = r"[\p{L}\p{N}_]+"
TOKEN = rf"{WORD}|['’][sS](?![\p{{L}}\p{{N}}_])|[^\p{{L}}\p{{N}}_\s\p{{Z}}]"


def sentences(text: Column) -> Column:
    """Sentences of a text, each up to the signs that end it, without blanks around."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def sentence_candidates(chunks: DataFrame, *more: str) -> DataFrame:
    """(candidate_id, chunk_id, k, span, claim_text): a claim for each sentence of chunks (chunk_id, text), as it stands,
    with more columns of its chunk. What a model would say better goes through the same gate."""
    rows = chunks.select("chunk_id", *more, F.posexplode(sentences(F.col("text"))).alias("k", "span"))
    return rows.select(F.concat_ws("-", "chunk_id", "k").alias("candidate_id"), "chunk_id", "k", "span", F.col("span").alias("claim_text"), *more)


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def tokens_of(text: Column) -> Column:
    """Lower-cased words and signs; a possessive stays whole."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.when(t == "’s", F.lit("'s")).otherwise(t))


def sources(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, text, char_start, words, union) of chunks (doc_id, chunk_id, ordinal, section, header, text,
    char_start): the words of all that a claim of the chunk may draw on, and its texts. They are made where the chunk is
    dealt by its id, as they are larger than the texts."""
    along = Window.partitionBy("doc_id").orderBy("ordinal")
    beside = lambda step: F.when(F.lag("section", step).over(along).eqNullSafe(F.col("section")), F.lag("text", step).over(along))
    rows = chunks.select("doc_id", "chunk_id", "text", "char_start", "header", beside(1).alias("before"), beside(-1).alias("after")).repartition("chunk_id")
    texts = F.array_compact(F.array("text", "header", "before", "after"))
    return rows.select("doc_id", "chunk_id", "text", "char_start", F.array_distinct(F.flatten(F.transform(texts, words_of))).alias("words"), F.lower(F.array_join(texts, "\n")).alias("union"))


def failed_tokens(added: Column, words: Column, union: Column) -> Column:
    """Tokens of additions that the sources lack, once each in order; numbers are never scaffold."""
    is_word = lambda t: t.rlike(rf"^{WORD}$")
    there = lambda t: F.when(is_word(t), F.array_contains(words, t)).otherwise(F.contains(union, t))
    scaffold = F.array(*map(F.lit, SCAFFOLD))
    tolerated = lambda t: F.array_contains(scaffold, t) & ~t.rlike(r"\p{N}")
    return F.array_distinct(F.filter(tokens_of(added), lambda t: ~there(t) & ~tolerated(t)))


def kept_ranges(kept: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, span, flagged, range_start, range_end): kept spans (chunk_id, span, flagged) where they first stand in
    their chunk; both ends are null where they don't. Dealt by chunk."""
    spans = kept.repartition("chunk_id").groupBy("chunk_id", "span").agg(F.max("flagged").alias("flagged"))
    at = F.expr("instr(text, span)")
    placed = spans.join(chunks.select("chunk_id", "text", "char_start"), "chunk_id", "left")
    start = F.when(at > 0, F.col("char_start") + at - 1)
    return placed.select("chunk_id", "span", "flagged", start.alias("range_start"), (start + F.length("span")).alias("range_end"))


def interval_index(ranges: DataFrame) -> DataFrame:
    """(chunk_id, index): the ranges of a chunk as an array of disjoint ones, in order; no more than its characters."""
    found = ranges.where("range_start IS NOT NULL").select("chunk_id", "range_start", "range_end").distinct()
    upto = Window.partitionBy("chunk_id").orderBy("range_start", "range_end").rowsBetween(Window.unboundedPreceding, -1)
    runs = found.withColumn("opens", F.coalesce(F.col("range_start") >= F.max("range_end").over(upto), F.lit(True)))
    runs = runs.withColumn("run", F.sum(F.col("opens").cast("int")).over(Window.partitionBy("chunk_id").orderBy("range_start", "range_end")))
    merged = runs.groupBy("chunk_id", "run").agg(F.min("range_start").alias("s"), F.max("range_end").alias("e"))
    return merged.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("index"))


def window_of(start_text: Column, end_text: Column, precision: Column) -> tuple[Column, Column, Column]:
    """(from, until, precision) of a claim's window in UTC, from ISO dates or instants with an offset; all unknown where a text is neither
    or the ends don't suit the precision: an instant is one point and no mere date, open has a start alone, unknown none."""
    date = r"^\d{4}-\d{2}-\d{2}$"
    zoned = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
    at = lambda t: F.when(F.trim(t).rlike(date) | F.trim(t).rlike(zoned), F.try_to_timestamp(F.trim(t)))
    wrong = lambda t: t.isNotNull() & at(t).isNull()
    a, z = at(start_text), at(end_text)
    dated = F.coalesce(F.trim(start_text).rlike(date), F.lit(False)) | F.coalesce(F.trim(end_text).rlike(date), F.lit(False))
    ordered = F.coalesce(a <= z, F.lit(True))
    fits = (
        F.when(precision == "unknown", a.isNull() & z.isNull())
        .when(precision == "open", a.isNotNull() & z.isNull())
        .when(precision == "instant", ~dated & F.coalesce(a == z, F.lit(False)))
        .otherwise(precision.isin(*BOUNDED) & a.isNotNull() & z.isNotNull())
    )
    good = ordered & F.coalesce(fits, F.lit(False)) & ~wrong(start_text) & ~wrong(end_text)
    return F.when(good, a), F.when(good, z), F.when(good, precision).otherwise("unknown")


def grounding_gate(candidates: DataFrame, kept: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each candidate: its places and window, and the gate that rejected it, null for an accepted one.

    candidates: (candidate_id, chunk_id, span, claim_text, added array<string>, valid_from, valid_until, precision);
    kept: (chunk_id, span, flagged); chunks as in sources. Gates in order: span_not_found, outside_kept_ranges,
    added_context_unverified with the first addition that fails and its tokens. A window that doesn't hold together is
    unknown and costs the claim nothing else. All is joined by chunk alone: once a candidate has its chunk's words it is
    too large to move.
    """
    ranges = kept_ranges(kept, chunks)
    flagged = ranges.where("flagged").groupBy("chunk_id").agg(F.collect_set("span").alias("flagged_spans"))  # no more than a chunk's sentences
    rows = candidates.join(sources(chunks), "chunk_id", "left").join(interval_index(ranges), "chunk_id", "left").join(flagged, "chunk_id", "left")
    at = F.expr("instr(text, span)")
    rows = rows.withColumn("start", F.when(at > 0, F.col("char_start") + at - 1)).withColumn("end", F.col("start") + F.length("span"))
    overlaps = F.exists("index", lambda r: (F.col("start") < r["e"]) & (r["s"] < F.col("end")))
    judged = F.filter(F.transform(F.coalesce("added", F.array().cast("array<string>")), lambda a: F.struct(a.alias("text"), failed_tokens(a, F.col("words"), F.col("union")).alias("tokens"))), lambda x: (F.trim(x["text"]) != "") & (F.size(x["tokens"]) > 0))
    rows = rows.withColumn("failed", F.get(judged, F.lit(0)))
    gate = F.when(F.col("start").isNull(), "span_not_found").when(~F.coalesce(overlaps, F.lit(False)), "outside_kept_ranges").when(F.col("failed").isNotNull(), "added_context_unverified")
    a, z, precision = window_of(F.col("valid_from"), F.col("valid_until"), F.col("precision"))
    rows = rows.withColumn("gate", gate)
    passed = F.col("gate").isNull()
    unverified = F.col("gate") == "added_context_unverified"
    return rows.select(
        "candidate_id", "chunk_id", "doc_id", "claim_text", "gate", F.when(passed, F.col("start")).alias("char_start"), F.when(passed, F.col("end")).alias("char_end"), F.when(passed, F.coalesce(F.array_contains("flagged_spans", F.col("span")), F.lit(False))).alias("kept_flagged"),
        F.when(unverified, F.col("failed.text")).alias("failed_text"), F.when(unverified, F.col("failed.tokens")).alias("failed_tokens"), F.when(passed, a).alias("valid_from"), F.when(passed, z).alias("valid_until"), F.when(passed, precision).alias("precision"),
    )


def omitted(candidates: DataFrame, kept: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, span): kept spans that no candidate's span overlaps, accepted or not; those that stand nowhere too."""
    ranges = kept_ranges(kept, chunks)
    told = interval_index(kept_ranges(candidates.select("chunk_id", "span", F.lit(False).alias("flagged")), chunks))
    rows = ranges.join(told, "chunk_id", "left")
    tried = F.exists("index", lambda r: (F.col("range_start") < r["e"]) & (r["s"] < F.col("range_end")))
    return rows.where(~F.coalesce(tried, F.lit(False))).select("chunk_id", "span")
