"""Sections on a grid of blocks: headings to a tree, proposals snapped or anchored to it, hashes, roles and statistics.

Trees are tables with a row for each section, and a level of all documents' trees is worked out at once by joins and
windows within a document. Blocks are (doc_id, ordinal, char_start, char_end), ordinals from 0 without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.checkpoint import cut
from factloom.functions.text import heading_title, leading_number, letter_ratio

LEVELS, DEPTH_MOST = 6, 16
#: Roles, and the titles that have one by themselves.
ROLES = ("body", "abstract", "introduction", "results", "methods", "discussion", "conclusion", "references", "appendix", "table", "figure_caption", "nav", "boilerplate", "legal")
ROLE_OF_TITLE = {
    "abstract": "abstract", "summary": "abstract", "introduction": "introduction", "background": "introduction", "methods": "methods", "methodology": "methods", "materials and methods": "methods",
    "results": "results", "findings": "results", "discussion": "discussion", "conclusion": "conclusion", "conclusions": "conclusion", "references": "references", "bibliography": "references", "works cited": "references",
    "table of contents": "nav", "contents": "nav", "navigation": "nav", "tables": "table", "figures": "figure_caption", "figure captions": "figure_caption", "legal": "legal", "legal notice": "legal",
    "terms and conditions": "legal", "boilerplate": "boilerplate", "transcript": "body", "audio transcript": "body", "video transcript": "body", "acoustic events": "body", "visible text (ocr)": "body", "shot notes": "body",
    "image description": "figure_caption", "visual description": "figure_caption",
}
#: Fixed values of the statistics: fewer sections have none but their number; sizes of a tiny body and a long title.
SECTIONS_LEAST, TINY, LONG = 3, 80, 120

SECTION = ["doc_id", "ordinal", "node_path", "parent_path", "title", "normalized_title", "heading_level", "role", "block_start", "block_end", "char_start", "char_end"]


def apart(lines: DataFrame) -> DataFrame:
    """The table, marked to be joined by sorting both sides: files of lines are far smaller than their rows, so that Spark,
    which goes by files, would gather millions of rows in the driver and send them to all tasks."""
    return lines.hint("merge")


def grid_of(blocks: DataFrame) -> DataFrame:
    """The blocks without their texts, stored: each level of a tree looks up its ends there."""
    return cut(blocks.select("doc_id", "ordinal", "char_start", "char_end", *(["level"] if "level" in blocks.columns else [])))


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of a plain text: its lines but for blank ones, with their text."""
    lines = docs.select(docs[id_col].alias("doc_id"), F.posexplode(F.split(F.coalesce(docs[text_col], F.lit("")), "\n")).alias("line", "text"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("char_start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")).where(F.trim("text") != "")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1
    return placed.select("doc_id", at.alias("ordinal"), "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), "text")


def roots(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The root of each document of docs (doc_id, title, n_chars): all blocks, -1 as the last where there is none."""
    last = blocks.groupBy("doc_id").agg(F.max("ordinal").alias("last"))
    title = F.coalesce(F.col("title"), F.lit(""))
    return docs.join(apart(last), "doc_id", "left").select(
        "doc_id", F.lit("0").alias("node_path"), F.lit(None).cast("string").alias("parent_path"), title.alias("title"), heading_title(title).alias("normalized_title"), F.lit(None).cast("int").alias("heading_level"), F.lit("body").alias("role"),
        F.lit(0).alias("block_start"), F.coalesce("last", F.lit(-1)).cast("int").alias("block_end"), F.lit(0).alias("char_start"), F.col("n_chars").cast("int").alias("char_end"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Sections in document order: a parent before its children, these by their index."""
    order = Window.partitionBy("doc_id").orderBy(F.transform(F.split("node_path", r"\."), lambda x: x.cast("int")))
    return rows.withColumn("ordinal", F.row_number().over(order) - 1).select(*SECTION)


def heading_sections(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """The tree of headings: blocks (..., level, title), level null for other blocks; docs (doc_id, title, n_chars).

    A heading's parent is the last one before it of a lower level, and it ends before the next of its level or a lower.
    """
    heads = blocks.where("level IS NOT NULL").select("doc_id", "ordinal", "level", "title", "char_start")
    before = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    at = lambda level, pick, over: pick(F.when(F.col("level") == level, F.col("ordinal"))).over(over)
    earlier = F.greatest(*(F.when(F.col("level") > k, at(k, F.max, before)) for k in range(1, LEVELS + 1)))
    later = F.least(*(F.when(F.col("level") >= k, at(k, F.min, after)) for k in range(1, LEVELS + 1)))
    placed = heads.select("*", earlier.alias("parent"), later.alias("next"))
    index = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("ordinal")) - 1
    placed = cut(placed.withColumn("index", index.cast("string")))
    level = placed.where("parent IS NULL").select("doc_id", F.col("ordinal").alias("of"), F.concat(F.lit("0."), "index").alias("node_path"), F.lit("0").alias("parent_path"))
    paths = level
    for _ in range(LEVELS - 1):
        above = level.select(F.col("doc_id").alias("d"), F.col("of").alias("o"), F.col("node_path").alias("parent_path"))
        level = placed.join(apart(above), (F.col("doc_id") == F.col("d")) & (F.col("parent") == F.col("o"))).select("doc_id", F.col("ordinal").alias("of"), F.concat_ws(".", "parent_path", "index").alias("node_path"), "parent_path")
        paths = paths.union(level)
    top = roots(docs, blocks)
    ends = top.select("doc_id", F.col("block_end").alias("last"))
    rows = placed.join(apart(paths.withColumnRenamed("of", "ordinal")), ["doc_id", "ordinal"]).join(apart(ends), "doc_id").withColumn("block_end", F.coalesce(F.col("next") - 1, F.col("last")))
    closed = blocks.select("doc_id", F.col("ordinal").alias("block_end"), "char_end")
    title = F.coalesce(F.col("title"), F.lit(""))
    rows = rows.join(apart(closed), ["doc_id", "block_end"]).select(
        "doc_id", "node_path", "parent_path", title.alias("title"), heading_title(title).alias("normalized_title"), F.col("level").cast("int").alias("heading_level"), F.lit("body").alias("role"),
        F.col("ordinal").cast("int").alias("block_start"), F.col("block_end").cast("int").alias("block_end"), F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"),
    )
    return numbered(top.unionByName(rows))


def clean_role(role: Column) -> Column:
    plain = F.lower(F.trim(role))
    return F.when(plain.isin(*ROLES), plain).otherwise("body")


def role_of_title(title: Column) -> Column:
    """The role that a normalised title has by itself, else null."""
    known = F.create_map(*(F.lit(x) for pair in ROLE_OF_TITLE.items() for x in pair))
    begins = lambda word: (title == word) | title.startswith(word + " ")
    return F.coalesce(F.element_at(known, title), F.when(begins("appendix"), "appendix").when(begins("table"), "table").when(begins("figure"), "figure_caption"))


def _tile(candidates: DataFrame) -> DataFrame:
    """Candidates (doc_id, owner, start, order, ..., owner_end) with their group's path and end.

    Those of one owner that start together are a group: the first by `order` wins, and the others' children become its
    own. A group ends where the next begins, the last where its owner does.
    """
    same = Window.partitionBy("doc_id", "owner", "start").orderBy("order")
    ranked = candidates.withColumn("among", F.row_number().over(same) - 1)
    groups = ranked.where("among = 0").select("doc_id", "owner", "start", "owner_end")
    along = Window.partitionBy("doc_id", "owner").orderBy("start")
    groups = groups.select("doc_id", "owner", "start", F.concat_ws(".", "owner", (F.row_number().over(along) - 1).cast("string")).alias("path"), F.coalesce(F.lead("start").over(along) - 1, F.col("owner_end")).alias("end"))
    return ranked.join(apart(groups), ["doc_id", "owner", "start"])


def _placed(winners: DataFrame, blocks: DataFrame) -> DataFrame:
    """Winners (..., start, end) with the characters of their blocks."""
    opens = blocks.select("doc_id", F.col("ordinal").alias("start"), F.col("char_start").alias("first_char"))
    closes = blocks.select("doc_id", F.col("ordinal").alias("end"), F.col("char_end").alias("last_char"))
    return winners.join(apart(opens), ["doc_id", "start"]).join(apart(closes), ["doc_id", "end"])


def snap_sections(proposed: DataFrame, blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Any proposed tree as sections that tile the blocks.

    proposed: (doc_id, node_id, parent_id, place, title, role, char_start, char_end), parent_id null at the top; place
    orders siblings. A start goes back to the block that holds it. Of siblings that start together the longer proposal
    wins and takes the others' children; siblings reach to the next one; what is empty or outside its parent goes with
    all below it, and so does what is DEPTH_MOST levels down. A role that isn't one is body.
    """
    blocks = grid_of(blocks)
    ends = blocks.select("doc_id", F.col("char_start").alias("at"), F.lit(0).alias("kind"), F.col("ordinal").alias("block"), F.lit(None).cast("string").alias("node"))
    starts = proposed.select("doc_id", F.col("char_start").alias("at"), F.lit(1), F.lit(None).cast("int"), F.col("node_id").cast("string"))
    upto = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    snapped = ends.union(starts).withColumn("block", F.coalesce(F.last("block", True).over(upto), F.lit(0))).where("kind = 1").select("doc_id", F.col("node").alias("node_id"), F.col("block").alias("snapped"))
    nodes = cut(proposed.select("doc_id", F.col("node_id").cast("string").alias("node_id"), F.col("parent_id").cast("string").alias("parent_id"), "place", "title", "role", "char_start", "char_end").join(apart(snapped), ["doc_id", "node_id"]))
    top = roots(docs, blocks)
    out = top
    first = blocks.groupBy("doc_id").agg(F.min("char_start").alias("owner_first"), F.max("char_end").alias("owner_last"), F.max("ordinal").alias("owner_end"))
    frontier = nodes.where("parent_id IS NULL").join(apart(first), "doc_id").select("*", F.lit("0").alias("owner"), F.lit(0).alias("owner_start"), F.lit(0).alias("turn"))
    for _ in range(1, DEPTH_MOST):
        kept = frontier.where("char_end > char_start AND char_end > owner_first AND char_start < owner_last")
        kept = kept.withColumn("start", F.greatest("snapped", "owner_start")).where("start <= owner_end")
        kept = kept.withColumn("order", F.struct((F.col("char_start") - F.col("char_end")).alias("length"), "turn", "place", "node_id"))
        tiled = cut(_placed(_tile(kept), blocks))
        if not tiled.limit(1).count():
            break
        title = F.coalesce(F.col("title"), F.lit(""))
        out = out.unionByName(
            tiled.where("among = 0").select(
                "doc_id", F.col("path").alias("node_path"), F.col("owner").alias("parent_path"), title.alias("title"), heading_title(title).alias("normalized_title"), F.lit(None).cast("int").alias("heading_level"), clean_role(F.coalesce("role", F.lit("body"))).alias("role"),
                F.col("start").cast("int").alias("block_start"), F.col("end").cast("int").alias("block_end"), F.col("first_char").cast("int").alias("char_start"), F.col("last_char").cast("int").alias("char_end"),
            )
        )
        owners = tiled.select("doc_id", F.col("node_id").alias("parent_id"), F.col("path").alias("owner"), F.col("start").alias("owner_start"), F.col("end").alias("owner_end"), F.col("first_char").alias("owner_first"), F.col("last_char").alias("owner_last"), F.col("among").alias("turn"))
        frontier = nodes.join(apart(owners), ["doc_id", "parent_id"])
    return numbered(out)


def fallback_sections(anchors: DataFrame, blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """A tree of exact quotes as sections: anchors (doc_id, node_id, parent_id, place, anchor, occurrence); blocks with
    their text, and level where they are headings.

    An anchor stands for the block in which its text comes for the occurrence-th time, from 0, within its parent's
    blocks. One that isn't there goes, and its children are looked for in its place; of siblings in one block the first
    takes the others' children. Siblings reach to the next one.
    """
    asked = anchors.select("doc_id", F.col("node_id").cast("string").alias("node_id"), F.col("parent_id").cast("string").alias("parent_id"), "place", "anchor", "occurrence")
    times = F.when(F.length("anchor") == 0, F.length("text") + 1).otherwise((F.length("text") - F.length(F.replace("text", "anchor", F.lit("")))) / F.length("anchor"))
    nodes = cut(asked)
    held = cut(nodes.select("doc_id", "node_id", "anchor").join(apart(blocks.select("doc_id", "ordinal", "text")), "doc_id").where("contains(text, anchor)").select("doc_id", "node_id", "ordinal", times.cast("int").alias("times")))
    blocks = grid_of(blocks)
    top = roots(docs, blocks)
    out = top
    last = blocks.groupBy("doc_id").agg(F.max("ordinal").alias("owner_end"))
    frontier = nodes.where("parent_id IS NULL").join(apart(last), "doc_id").select("*", F.lit("0").alias("owner"), F.lit(0).alias("owner_start"), F.array(F.col("place").cast("long")).alias("order"))
    for _ in range(1, DEPTH_MOST):
        found, waiting = None, cut(frontier)
        while waiting.limit(1).count():  # a round for each level of anchors that aren't there
            inside = waiting.join(apart(held), ["doc_id", "node_id"]).where("ordinal BETWEEN owner_start AND owner_end")
            upto = Window.partitionBy("doc_id", "node_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
            inside = inside.withColumn("upto", F.sum("times").over(upto)).where("upto > occurrence AND upto - times <= occurrence")
            there = cut(inside.withColumnRenamed("ordinal", "start").drop("times", "upto"))
            found = there if found is None else found.unionByName(there)
            lost = waiting.join(apart(there.select("doc_id", "node_id")), ["doc_id", "node_id"], "left_anti").select("doc_id", F.col("node_id").alias("parent_id"), "owner", "owner_start", "owner_end", F.col("order").alias("above"))
            waiting = cut(nodes.join(apart(lost), ["doc_id", "parent_id"]).withColumn("order", F.concat("above", F.array(F.col("place").cast("long")))).drop("above"))
        if found is None:
            break
        tiled = cut(_placed(_tile(found), blocks))
        if not tiled.limit(1).count():
            break
        levels = blocks.select("doc_id", F.col("ordinal").alias("start"), "level")
        title = F.col("anchor")
        out = out.unionByName(
            tiled.where("among = 0").join(apart(levels), ["doc_id", "start"]).select(
                "doc_id", F.col("path").alias("node_path"), F.col("owner").alias("parent_path"), title.alias("title"), heading_title(title).alias("normalized_title"), F.col("level").cast("int").alias("heading_level"), F.lit("body").alias("role"),
                F.col("start").cast("int").alias("block_start"), F.col("end").cast("int").alias("block_end"), F.col("first_char").cast("int").alias("char_start"), F.col("last_char").cast("int").alias("char_end"),
            )
        )
        owners = tiled.select("doc_id", F.col("node_id").alias("parent_id"), F.col("path").alias("owner"), F.col("start").alias("owner_start"), F.col("end").alias("owner_end"), F.col("among").cast("long").alias("turn"))
        frontier = nodes.join(apart(owners), ["doc_id", "parent_id"]).withColumn("order", F.array("turn", F.col("place").cast("long"))).drop("turn")
    return numbered(out)


def skeleton_hash(sections: DataFrame) -> DataFrame:
    """(doc_id, skeleton_hash): SHA-256 of places and titles of all sections in order, as canonical JSON; roles don't count."""
    names = sorted(["node_path", "parent_path", "title", "normalized_title", "heading_level", "block_start", "block_end", "char_start", "char_end"])
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.struct(*names).alias("s")))), lambda x: x["s"])
    return sections.groupBy("doc_id").agg(F.sha2(F.to_json(listed, {"ignoreNullFields": "false"}), 256).alias("skeleton_hash"))


def skeleton_statistics(sections: DataFrame, blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """A row of statistics for each document of docs (doc_id, n_chars) over its sections but the root."""
    rows = sections.where("node_path <> '0'")
    ahead = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    sums = blocks.select("doc_id", "ordinal", (F.col("char_end") - F.col("char_start")).alias("size"), F.sum(F.col("char_end") - F.col("char_start")).over(ahead).alias("upto"))
    opens = sums.select("doc_id", F.col("ordinal").alias("block_start"), F.col("size").alias("first"), (F.col("upto") - F.col("size")).alias("before"))
    closes = sums.select("doc_id", F.col("ordinal").alias("block_end"), F.col("upto").alias("after"))
    sized = rows.join(apart(opens), ["doc_id", "block_start"]).join(apart(closes), ["doc_id", "block_end"]).withColumn("held", F.col("after") - F.col("before"))
    below = sized.groupBy("doc_id", F.col("parent_path").alias("node_path")).agg(F.sum("held").alias("inner"), F.min("block_start").alias("inner_start"), F.count("*").alias("fanout"), F.countDistinct("normalized_title").alias("titles"))
    siblings = Window.partitionBy("doc_id", "parent_path").orderBy("block_start", "ordinal")
    along = Window.partitionBy("doc_id").orderBy("ordinal")
    number, earlier = leading_number(F.col("normalized_title")), F.lag("number").over(siblings)
    title = F.col("normalized_title")
    each = sized.withColumn("number", number).withColumn("earlier", earlier).withColumn("level_before", F.lag("heading_level").over(along)).join(apart(below), ["doc_id", "node_path"], "left")
    # the heading's own block is no body, nor are its children's
    direct = F.col("held") - F.coalesce("inner", F.lit(0)) - F.when(F.coalesce(F.col("inner_start") == F.col("block_start"), F.lit(False)), 0).otherwise(F.col("first"))
    same = F.col("number.scheme") == F.col("earlier.scheme")
    both = F.col("number").isNotNull() & F.col("earlier").isNotNull()
    each = each.select(
        "doc_id", "normalized_title", direct.alias("direct"), F.when(F.col("fanout").isNull(), F.col("char_end") - F.col("char_start")).alias("leaf"), "fanout", "heading_level",
        F.greatest(F.lit(0), F.col("heading_level") - F.col("level_before") - 1).alias("jump"), F.col("number").isNotNull().alias("has_number"),
        (both & same & (F.col("number.values") < F.col("earlier.values"))).alias("inversion"), (both & ~same).alias("switch"), F.length(title).alias("title_length"), (letter_ratio(title) < 0.5).alias("low_letters"),
    )
    total = F.count("*").over(Window.partitionBy("doc_id"))
    sorted_at = F.row_number().over(Window.partitionBy("doc_id").orderBy("title_length"))
    each = each.withColumn("n", total).withColumn("at", sorted_at)
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n")))
    share = lambda cond: F.count_if(cond) / F.count("*")
    summed = each.groupBy("doc_id").agg(
        F.count("*").alias("section_count"), (1 - F.countDistinct("normalized_title") / F.count("*")).alias("duplicate_title_ratio"), F.sum("jump").alias("jumps"), F.count("heading_level").alias("levels"), share(F.col("has_number")).alias("numbering_coverage"),
        F.count_if("inversion").alias("numbering_inversions"), F.count_if("switch").alias("numbering_scheme_switches"), share(F.col("direct") < TINY).alias("tiny_section_ratio"), share(F.col("direct") == 0).alias("zero_direct_body_ratio"), F.max("leaf").alias("leaf"),
        F.max(F.when(F.col("at") == rank(0.5), F.col("title_length"))).cast("double").alias("title_length_p50"), F.max(F.when(F.col("at") == rank(0.95), F.col("title_length"))).cast("double").alias("title_length_p95"),
        share(F.col("title_length") > LONG).alias("long_title_ratio"), share(F.col("low_letters")).alias("low_letter_ratio"), share(F.col("title_length") == 0).alias("empty_title_ratio"),
    )
    again = rows.groupBy("doc_id", "normalized_title").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max("n").alias("max_title_multiplicity"))
    fans = below.groupBy("doc_id").agg(F.max("fanout").alias("max_sibling_fanout"), F.sum(F.col("fanout") - F.col("titles")).alias("twice"))
    out = docs.select("doc_id", "n_chars").join(summed, "doc_id", "left").join(again, "doc_id", "left").join(fans, "doc_id", "left")
    count = F.coalesce("section_count", F.lit(0))
    per_char = lambda x: F.when(F.col("n_chars") > 0, x / F.col("n_chars")).otherwise(0.0)
    values = {
        "duplicate_title_ratio": F.col("duplicate_title_ratio"), "max_title_multiplicity": F.col("max_title_multiplicity"), "sibling_duplicate_ratio": F.col("twice") / F.col("section_count"), "level_jump_count": F.when(F.col("levels") > 0, F.coalesce("jumps", F.lit(0))),
        "numbering_coverage": F.col("numbering_coverage"), "numbering_inversions": F.col("numbering_inversions"), "numbering_scheme_switches": F.col("numbering_scheme_switches"), "tiny_section_ratio": F.col("tiny_section_ratio"), "zero_direct_body_ratio": F.col("zero_direct_body_ratio"),
        "oversized_leaf_ratio": per_char(F.col("leaf")), "heading_density": per_char(F.col("section_count") * 10_000), "title_length_p50": F.col("title_length_p50"), "title_length_p95": F.col("title_length_p95"), "long_title_ratio": F.col("long_title_ratio"),
        "low_letter_ratio": F.col("low_letter_ratio"), "empty_title_ratio": F.col("empty_title_ratio"), "max_sibling_fanout": F.col("max_sibling_fanout"),
    }
    return out.select("doc_id", count.cast("long").alias("section_count"), *(F.when(count >= SECTIONS_LEAST, v).alias(k) for k, v in values.items()))
