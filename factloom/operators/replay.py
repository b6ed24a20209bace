"""Observations as an ordered replay of testimony, whatever the order in which it came.

Within an entity's slot the statements follow each other by source time: a run of one statement is an observation, and
the next statement closes it. Rows are replayed in segments of time, so that a busy slot spreads over tasks; a row for
each segment then tells how segments go on. Late testimony is replayed with the runs around it alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.checkpoint import cut

KEY = ["entity_id", "slot"]
SEGMENT_DAYS = 30
#: The segment after all others.
UNDATED = 1 << 40

#: The total order of testimony: undated last, then by claim and statement.
ORDER = ["undated", "asserted_at", "claim_id", "statement"]


def ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("undated", F.col("asserted_at").isNull())


def place() -> Column:
    """The order of a row as one value that is never null, to compare and to join by."""
    return F.struct(F.col("undated"), F.coalesce(F.col("asserted_at"), F.lit("1970-01-01").cast("timestamp_ntz")).alias("asserted_at"), F.col("claim_id"), F.coalesce("statement", F.lit("")).alias("statement"))


def replay(assertions: DataFrame, now: Column, segment_days: int = SEGMENT_DAYS) -> DataFrame:
    """Evidence with its observation: (entity_id, slot, observation_id, statement, valid_from, valid_until, claim_id,
    asserted_at) of assertions (entity_id, slot, statement, asserted_at, claim_id).

    The first claim of a run names it. A run closes when the next begins, at now where that is undated; the last of a
    slot is open. A claim that is told again with the same statement and time counts once; rows without an entity or a slot
    take no part.
    """
    rows = ordered(assertions.where("entity_id IS NOT NULL AND slot IS NOT NULL").select(*KEY, "statement", "asserted_at", "claim_id").distinct())
    segment = F.floor(F.unix_seconds(F.col("asserted_at").cast("timestamp")) / (86_400 * segment_days))
    rows = cut(rows.withColumn("segment", F.coalesce(segment, F.lit(UNDATED))))
    inside = Window.partitionBy(*KEY, "segment").orderBy(*ORDER)
    # how a slot goes on from one segment to the next: a row for each segment
    edges = rows.groupBy(*KEY, "segment").agg(F.max_by("statement", place()).alias("last"))
    along = Window.partitionBy(*KEY).orderBy("segment")
    edges = edges.select(*KEY, "segment", F.lag("last").over(along).alias("carried"))
    joined = rows.join(edges, [*KEY, "segment"])
    before = F.when(F.row_number().over(inside) == 1, F.col("carried")).otherwise(F.lag("statement").over(inside))
    begun = cut(joined.withColumn("begins", ~F.coalesce(before == F.col("statement"), F.lit(False))).drop("carried"))
    # each run's first row, and when the next run begins, in this segment or a later one
    starts = begun.where("begins").select(*KEY, "segment", *ORDER)
    nexts = starts.groupBy(*KEY, "segment").agg(F.min(place()).alias("first"))
    nexts = nexts.select(*KEY, "segment", F.lead("first").over(along).alias("after"))
    runs = starts.withColumn("following", F.lead(place()).over(inside))
    linked = runs.join(nexts, [*KEY, "segment"])
    following = F.coalesce("following", "after")
    until = F.when(following.isNotNull(), F.when(following["undated"], now.cast("timestamp_ntz")).otherwise(following["asserted_at"]))
    observations = linked.select(*KEY, place().alias("start"), F.col("claim_id").alias("observation_id"), "statement", F.col("asserted_at").alias("valid_from"), until.alias("valid_until"))
    # a row belongs to the last run that began by then; before a segment's first start that is an earlier segment's
    own = F.last(F.when(F.col("begins"), place()), True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    held = begun.withColumn("own", own)
    lasts = begun.groupBy(*KEY, "segment").agg(F.max(F.when(F.col("begins"), place())).alias("opened"))
    lasts = lasts.select(*KEY, "segment", F.last("opened", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("opened"))
    placed = held.join(lasts, [*KEY, "segment"]).select(*KEY, F.coalesce("own", "opened").alias("start"), "claim_id", "asserted_at")
    return observations.join(placed, [*KEY, "start"]).drop("start")


def observations(evidence: DataFrame) -> DataFrame:
    """(entity_id, slot, observation_id, statement, valid_from, valid_until, evidence_count) of replayed evidence."""
    return evidence.groupBy(*KEY, "observation_id", "statement", "valid_from", "valid_until").agg(F.count("*").alias("evidence_count"))


def resplit(evidence: DataFrame, incoming: DataFrame, now: Column, segment_days: int = SEGMENT_DAYS) -> tuple[DataFrame, DataFrame]:
    """(ids, evidence): the observations that late testimony touches, by (entity_id, slot, observation_id), and what their
    evidence and the incoming rows become. All other evidence stays as it is.

    evidence: as of replay; incoming: assertions. Touched are the runs from the one before the earliest incoming row to
    the one after the latest: beyond them neither statements nor bounds change. An observation that is split gives its
    later evidence to the runs that follow; one that late testimony rejoins takes them up.
    """
    late = ordered(incoming.select(*KEY, "statement", "asserted_at", "claim_id"))
    spans = late.groupBy(*KEY).agg(F.min(place()).alias("earliest"), F.max(place()).alias("latest"))
    mine = evidence.join(spans.select(*KEY), KEY, "left_semi")
    heads = ordered(mine.where("claim_id = observation_id AND asserted_at <=> valid_from").select(*KEY, "observation_id", "statement", F.col("asserted_at"), "claim_id", "valid_until").distinct())
    along = Window.partitionBy(*KEY).orderBy(*ORDER)
    heads = heads.withColumn("run", F.row_number().over(along)).withColumn("start", place())
    marked = heads.join(spans, KEY)
    around = marked.groupBy(*KEY).agg(F.max(F.when(F.col("start") <= F.col("earliest"), F.col("run"))).alias("a"), F.max(F.when(F.col("start") <= F.col("latest"), F.col("run"))).alias("z"))
    touched = cut(heads.join(around, KEY).where((F.col("run") >= F.coalesce("a", F.lit(0)) - 1) & (F.col("run") <= F.coalesce("z", F.lit(0)) + 1)).select(*KEY, "observation_id", "valid_until", "run"))
    moved = mine.join(touched.select(*KEY, "observation_id"), [*KEY, "observation_id"], "left_semi").select(*KEY, "statement", "asserted_at", "claim_id")
    again = replay(moved.unionByName(late.drop("undated")), now, segment_days)
    # the last touched run goes on to where it did before
    ends = touched.groupBy(*KEY).agg(F.max_by("valid_until", "run").alias("held_until"))
    again = again.join(ends, KEY, "left").withColumn("valid_until", F.coalesce("valid_until", "held_until")).drop("held_until")
    return touched.select(*KEY, "observation_id"), again


def resplit_state(evidence: DataFrame, incoming: DataFrame, now: Column, segment_days: int = SEGMENT_DAYS) -> DataFrame:
    """All evidence after late testimony: what is not touched, and what became of the rest."""
    touched, again = resplit(evidence, incoming, now, segment_days)
    return evidence.join(touched, [*KEY, "observation_id"], "left_anti").unionByName(again)
