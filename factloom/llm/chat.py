"""Chat formatting: perspective rotation over the parties of a dialogue, with DataFrame functions only.

For each speaker the dialogue is rendered with that speaker's turns as the assistant and everyone else as a user of
that name; masks give the places of the assistant's words. A dialogue is rendered in segments of SEGMENT turn numbers,
so that one that holds a third of all turns spreads over tasks; segments joined in order are the whole rendering, and
char_start says where each begins in it. Where segments begin is worked out from lengths and counts alone, so that no
window ever moves text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import table

SEGMENT = 64
#: Roles that are not parties: their turns stay what they are in every rendering.
STATIC = ("system",)


def perspectives(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT, static: tuple[str, ...] = STATIC) -> DataFrame:
    """One row per conversation, speaker and segment: conv_id, perspective, segment, n_turns, rendered, mask, char_start.

    mask: `start:end` pairs in characters of rendered, comma-joined, of the speaker's words and their end mark; empty
    where the speaker is silent. Turns stand by turn, role and text; turns of one number and repeated rows all stay. A
    null role is the speaker `unknown`, a null text is empty, a null turn stands before the others, and rows with a
    null conv_id are a conversation by themselves. A conversation without speakers (static roles only) has one
    rendering for perspective null. A very long text is one turn, whole; a very long dialogue is many segments. Other columns are not read; without rows the result is empty.
    """
    rows = df.select(
        df[conv].cast("long").alias("conv_id"),
        F.coalesce(df[turn].cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(df[role].cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(df[text].cast("string"), F.lit("")).alias("text"),
    ).withColumn("segment", F.floor(F.greatest("turn", F.lit(0)) / segment))
    rows = rows.select(F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("lost"), "segment", "turn", "role", "text")
    is_static = F.col("role").isin(*static)
    speakers = rows.groupBy("c", "lost", F.when(~is_static, F.col("role")).alias("perspective")).agg(F.count("*").alias("n"))
    speakers = speakers.withColumn("any", F.max(F.col("perspective").isNotNull()).over(Window.partitionBy("c", "lost")))
    speakers = speakers.where(F.col("perspective").isNotNull() | ~F.col("any")).select("c", "lost", "perspective")

    # lengths: as if nobody were the assistant, and then what each of a speaker's own turns is shorter or longer
    frame = len("<|im_start|>") + 1 + len("<|im_end|>\n")
    as_other = F.length("text") + F.length("role") + frame + F.when(is_static, 0).otherwise(len("user name="))
    sizes = rows.groupBy("c", "lost", "segment").agg(F.sum(as_other.cast("long")).alias("size"))
    order = Window.partitionBy("c", "lost").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("size").over(order), F.lit(0)))
    own_turns = rows.where(~is_static).groupBy("c", "lost", "segment", F.col("role").alias("perspective")).agg(F.count("*").alias("own"))
    grid = sizes.select("c", "lost", "segment", "base").join(speakers, ["c", "lost"]).join(own_turns, ["c", "lost", "segment", "perspective"], "left")
    before = Window.partitionBy("c", "lost", "perspective").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    shorter = F.lit(len("assistant") - len("user name=")) - F.length("perspective")
    starts = grid.select("c", "lost", "segment", "perspective", (F.col("base") + F.coalesce(F.sum("own").over(before) * shorter, F.lit(0))).cast("long").alias("char_start"))

    segments = rows.groupBy("c", "lost", "segment").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))  # one segment's turns
    joined = segments.join(starts, ["c", "lost", "segment"]).withColumn("conv_id", F.when(~F.col("lost"), F.col("c")))

    def head(t: F.Column) -> F.Column:
        static_turn = t["role"].isin(*static)
        who = F.when(static_turn, t["role"]).when(t["role"].eqNullSafe(F.col("perspective")), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.concat(F.lit("<|im_start|>"), who, F.lit("\n"))

    end = F.lit("<|im_end|>\n")
    parts = joined.withColumn(
        "parts",
        F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], end).alias("body"), (t["role"].eqNullSafe(F.col("perspective")) & ~t["role"].isin(*static)).alias("own"))),
    )
    # (characters so far, spans so far): the lengths add up over a segment's turns
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(p["own"], F.concat(acc["spans"], F.array(F.concat((acc["at"] + F.length(p["head"])).cast("string"), F.lit(":"), (acc["at"] + F.length(p["head"]) + F.length(p["body"])).cast("string"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    rendered = parts.select(
        "conv_id",
        "perspective",
        "segment",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.array_join(spans["spans"], ",").alias("mask"),
        "char_start",
    )
    return rendered


def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """perspectives over table conversations: a rendering for each of its roles."""
    return perspectives(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    CAST(floor(greatest(coalesce(turn, -1), 0) / {SEGMENT}) AS BIGINT) AS segment
  FROM conversations),
who AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
speakers AS (
  SELECT * FROM who
  UNION ALL SELECT DISTINCT conv_id, NULL FROM t WHERE NOT EXISTS (SELECT 1 FROM who WHERE who.conv_id IS NOT DISTINCT FROM t.conv_id)),
parts AS (
  SELECT t.conv_id, s.perspective, t.segment, t.turn, t.role, t.text,
    row_number() OVER (PARTITION BY t.conv_id, s.perspective, t.segment ORDER BY t.turn, t.role, t.text) AS place,
    '<|im_start|>' || CASE WHEN t.role = 'system' THEN t.role WHEN t.role = s.perspective THEN 'assistant' ELSE 'user name=' || t.role END || chr(10) AS head,
    t.text || '<|im_end|>' || chr(10) AS body, coalesce(t.role = s.perspective, false) AS own
  FROM t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, segment ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM parts),
segments AS (
  SELECT conv_id, perspective, segment, count(*) AS n_turns, string_agg(head || body, '' ORDER BY place) AS rendered,
    coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || ':' || CAST(pos + length(head) + length(body) AS BIGINT), ',' ORDER BY place) FILTER (WHERE own), '') AS mask
  FROM placed GROUP BY ALL)
SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
FROM segments"""
