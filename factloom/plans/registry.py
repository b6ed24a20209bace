"""Named queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import temporal
from factloom.functions.checkpoint import cut, fresh_path
from factloom.operators import adjudication, ann, claims, documents, facts, forget, graph, identity, knowledge, ledger, merges, replay, retrieval, search, sections
from factloom.plans import examples, gate, view_sql
from factloom.plans.views import PUBLISHED, Views
from factloom.sources import corpusfs, sinks
from factloom.sources.spine import Spine

Query = Callable[[SparkSession, str], DataFrame]

_STORES: dict[tuple[str, str], Views] = {}


def views(spark: SparkSession, sf_dir: str) -> Views:
    """The views over a folder, with what they have stored so far in this application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        _STORES[key] = Views(Spine(spark, sf_dir))
    return _STORES[key]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).facts_current


#: Arguments of the named queries.
PERSON, OTHER_PERSON, ACCOUNT, AT, SINCE = "C7", "C11", "U1", "1998-06-01 00:00:00", "1999-01-01 00:00:00"
TEXT_QUERY = "public license that is under version"


def query_vector(v: Views) -> list[float]:
    row = v.spark_vectors.where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def _nation(v: Views) -> int:
    row = v.raw("customer").where("c_custkey = 7").select("c_nationkey").first()
    return row[0] if row else -1


def _nominations(v: Views) -> DataFrame:
    """Ranked chunk ids of which some are gone: every tenth is not a chunk."""
    top = retrieval.semantic_topk(v.spine["chunk_search"], query_vector(v), 50)
    return top.select(F.when(F.col("rank") % 10 == 0, F.concat(F.lit("gone-"), "chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), "rank", F.round("score", 6).alias("score"))


def _fused(v: Views) -> DataFrame:
    source = v.spine["chunk_search"]
    return retrieval.reciprocal_rank_fusion([retrieval.semantic_topk(source, query_vector(v), 40), retrieval.bm25_topk(v.chunk_postings, TEXT_QUERY, 40)], "chunk_id")


def _items(v: Views) -> DataFrame:
    """Relations of one person as ranked items with signals."""
    rows = v.spine["relations"].where(F.col("subject_entity_id") == PERSON)
    return rows.select("relation_id", F.col("confidence").alias("score"), F.when(F.col("valid_until").isNotNull(), F.length("object_entity_id").cast("double")).alias("graph_distance"), F.col("evidence_count").cast("double").alias("evidence_count"))


def _unzoned(rows: DataFrame) -> DataFrame:
    """Instants without a zone, which date_trunc gives one."""
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in rows.dtypes if t == "timestamp"})


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


def _pieces(v: Views) -> DataFrame:
    """Products of one name as pieces, with the mentions that are theirs."""
    own = merges.live_decisions(v.spine["resolution_decisions"]).groupBy("entity_id").agg(F.count("*").alias("mentions"))
    rows = v.spine["entities"].where("type = 'product'").join(own, "entity_id", "left")
    return rows.select(F.col("normalized_name").alias("piece"), "entity_id", F.col("created_at").alias("first_seen"), (F.coalesce("mentions", F.lit(0)) + F.col("graph_degree")).alias("weight"), F.col("merged_into").alias("current_root"))


def _merged(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    proposed = merges.proposals(_pieces(v), 2_000).where("route = 'merge'")
    return merges.merge(v.spine["entities"], v.spine["resolution_decisions"], proposed, F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))


def _unmerged(v: Views) -> DataFrame:
    """Live decisions after all merges of the store are taken back, where each had moved the absorbed one's mentions."""
    decisions, none = v.spine["resolution_decisions"], F.lit(None).cast("string")
    events = v.spine["merge_events"].select("merge_id", "survivor_id", "absorbed_id", F.lit(1).cast("long").alias("blast_radius"), "decided_by", "decided_at", "reversed_by", none.alias("unmerge_of"))
    live = cut(merges.live_decisions(decisions))
    snapshot = events.select("merge_id", F.explode(F.array("survivor_id", "absorbed_id")).alias("entity_id")).join(live.select("entity_id", "mention_id"), "entity_id")
    to = events.select(F.col("absorbed_id").alias("entity_id"), F.col("survivor_id").alias("to"))
    moved = live.join(to, "entity_id").select("decision_id", "to")
    now = decisions.join(moved, "decision_id", "left").withColumn("entity_id", F.coalesce("to", "entity_id")).select(*decisions.columns)
    after = merges.unmerge(v.spine["entities"], events, snapshot, cut(now), events.select("merge_id"), F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))[2]
    return merges.live_decisions(after).join(after.select("decision_id", "method"), "decision_id").select("mention_id", "entity_id", "method")


def _rules(v: Views) -> DataFrame:
    """Rules of the pages: a nation's entity and its customers' orders, a region's subtree and a kind of source."""
    nations, regions = v.raw("nation"), v.raw("region")
    text = lambda value=None: F.lit(value).cast("string")
    none = F.array().cast("array<string>")
    row = lambda page, kind, entity, predicates=none, source=text(), ids=none: [F.concat_ws(":", page, F.lit(kind)).alias("rule_id"), page.alias("artifact_id"), F.lit(kind).alias("kind"), entity.alias("entity_id"), text().alias("object_entity_id"), predicates.alias("predicates"), text().alias("community_id"), source.alias("source_kind"), ids.alias("evidence_ids")]
    nation, region = F.concat(F.lit("page-N"), "n_nationkey"), F.concat(F.lit("page-R"), "r_regionkey")
    parts = [
        nations.select(*row(nation, "entity", F.concat(F.lit("N"), "n_nationkey"), F.array(F.lit("located_in")))), nations.select(*row(nation, "predicate_beat", F.concat(F.lit("C"), "n_nationkey"), F.array(F.lit("ordered")))),
        regions.select(*row(region, "entity_subtree", F.concat(F.lit("R"), "r_regionkey"))), regions.select(*row(region, "doc_set", text(), source=F.element_at(F.array(*map(F.lit, ("text", "chat", "event_log", "1-URGENT", "none"))), F.col("r_regionkey") + 1))),
        nations.where("n_nationkey = 21").select(*row(nation, "manual", text(), ids=F.array(F.lit("E7"), F.lit("D3")))), nations.where("n_nationkey = 22").select(*row(nation, "scope_interests", text())),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _keys(v: Views) -> DataFrame:
    return knowledge.rule_keys(_rules(v), v.spine["relations"], v.spine.spark.createDataFrame([], "community_id string, entity_id string"))


def _change(v: Views) -> DataFrame:
    """What a day changed: one customer's orders, a user's observation, a claim, a text."""
    moved = v.spine["relations"].where("subject_entity_id = 'C7'").select(F.lit("relation").alias("kind"), F.col("relation_id").alias("id"))
    return moved.union(v.spine.spark.createDataFrame([("observation", "E7"), ("claim", "L1-1"), ("doc", "D3")], "kind string, id string"))


def _routes(v: Views) -> DataFrame:
    s = v.spine
    change, rules = cut(_change(v)), _rules(v)
    told = s["relation_evidence"].select(F.lit("relation").alias("kind"), F.col("relation_id").alias("id"), "doc_id").union(s["observation_evidence"].select(F.lit("observation"), "observation_id", "doc_id"))
    mentions = s["mentions"].where("claim_id IS NOT NULL").select("claim_id", F.col("true_entity").alias("entity_id"))
    carried = knowledge.change_keys(change, s["relations"], s["observations"], s["claims"], mentions, told, s["documents"])
    cited = s["knowledge_artifact_evidence"]
    citations = cited.where("relation_id IS NOT NULL").select("artifact_id", F.lit("relation").alias("kind"), F.col("relation_id").alias("id")).union(cited.where("doc_id IS NOT NULL").select("artifact_id", F.lit("doc"), "doc_id"))
    return knowledge.route(_keys(v), rules, citations, change, carried)


def _stale(v: Views) -> DataFrame:
    """Pages that are stale once the relations of a change have other counts, by the hashes before and after."""
    relations, rules, keys = v.spine["relations"], cut(_rules(v)), cut(_keys(v))
    selected = cut(knowledge.page_facts(rules, keys, relations))
    moved = _change(v).where("kind = 'relation'").select(F.col("id").alias("relation_id"), F.lit(1).alias("more"))
    later = relations.join(moved, "relation_id", "left").withColumn("evidence_count", F.col("evidence_count") + F.coalesce("more", F.lit(0))).select(*relations.columns)
    return knowledge.stale(knowledge.inputs_hash(selected, relations, rules), knowledge.inputs_hash(selected, later, rules))


FORGOTTEN = ("H1", "O3", "D3", "T0-1")


def _forgotten(v: Views) -> DataFrame:
    return cut(forget.manifest(v.spine, v.spine.spark.createDataFrame([(d,) for d in FORGOTTEN], "doc_id string")))


def _scrubbed(v: Views) -> DataFrame:
    owned = _forgotten(v)
    return forget.remains(forget.Scrubbed(v.spine, owned), owned)


def _gone(kind: str) -> str:
    return f"(SELECT id FROM gone WHERE kind = '{kind}')"


#: What the lineages of the forgotten documents own.
GONE = f"""
    alone AS MATERIALIZED (
      SELECT 'relation' AS kind, relation_id AS id FROM relation_evidence GROUP BY 2 HAVING bool_and(doc_id IN {FORGOTTEN}) UNION ALL SELECT 'observation', observation_id FROM observation_evidence GROUP BY 2 HAVING bool_and(doc_id IN {FORGOTTEN})),
    still AS (SELECT subject_entity_id AS e FROM relations WHERE relation_id NOT IN (SELECT id FROM alone WHERE kind = 'relation') UNION SELECT object_entity_id FROM relations WHERE relation_id NOT IN (SELECT id FROM alone WHERE kind = 'relation')
      UNION SELECT subject_entity_id FROM observations WHERE observation_id NOT IN (SELECT id FROM alone WHERE kind = 'observation')),
    gone AS MATERIALIZED (
      SELECT * FROM alone UNION ALL SELECT 'document', doc_id FROM documents WHERE doc_id IN {FORGOTTEN} UNION ALL SELECT 'version', version_id FROM document_versions WHERE doc_id IN {FORGOTTEN} UNION ALL SELECT 'chunk', chunk_id FROM chunks WHERE doc_id IN {FORGOTTEN}
      UNION ALL SELECT 'claim', claim_id FROM claims WHERE doc_id IN {FORGOTTEN} UNION ALL SELECT 'mention', mention_id FROM mentions WHERE doc_id IN {FORGOTTEN}
      UNION ALL SELECT 'entity', entity_id FROM (SELECT d.entity_id FROM resolution_decisions d JOIN mentions USING (mention_id) GROUP BY 1 HAVING bool_and(doc_id IN {FORGOTTEN})) WHERE entity_id NOT IN (SELECT e FROM still WHERE e IS NOT NULL))"""


def _index(v: Views) -> ann.Index | None:
    return ann.build(v.spark_vectors, fresh_path(v.spine.spark))


def _ann_topk(v: Views) -> DataFrame:
    """The ten nearest of each hundredth vector, by the index."""
    index = _index(v)
    units = ann.unit_rows(v.spark_vectors.where("vec_id % 100 = 0"), "vec_id", "embedding").select(F.col("vec_id").alias("query_id"), "v")
    return ann.search(index, units) if index else v.spine.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


#: Testimony that was there before the rest came.
_on_time = "pmod(xxhash64(claim_id), 7) <> 0"


def _told(v: Views) -> DataFrame:
    """Events as testimony about their users, in two slots; some are undated."""
    slot = F.when(F.col("value") > 5, "large").otherwise("small")
    return v.raw("events").select(F.concat(F.lit("U"), "user_id").alias("entity_id"), slot.alias("slot"), F.col("event_type").alias("statement"), F.when(F.col("event_id") % 50 != 0, F.col("ts").cast("timestamp_ntz")).alias("asserted_at"), F.concat(F.lit("Q"), "event_id").alias("claim_id"))


def _line_blocks(v: Views) -> tuple[DataFrame, DataFrame]:
    """Lines of all texts as blocks, short ones as headings of three levels, and the documents."""
    docs = v.raw("documents")
    lines = sections.text_lines(docs).withColumn("level", F.when(F.length("text") <= 30, 1 + F.length("text") % 3)).withColumn("title", F.trim("text"))
    return lines, docs.select("doc_id", F.col("source").alias("title"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))


def _statistics(v: Views) -> DataFrame:
    lines, docs = _line_blocks(v)
    return sections.skeleton_statistics(cut(sections.heading_sections(lines, docs)), lines, docs)


def _proposals(v: Views) -> DataFrame:
    """A tree of sections as a model might propose it: one for each sentence end's line, off the grid, some reversed."""
    lines, _ = _line_blocks(v)
    odd = F.col("ordinal") % 5
    at = F.col("char_start") + odd
    return lines.select(
        "doc_id", F.col("ordinal").alias("node_id"), F.when(odd != 0, F.col("ordinal") - odd).alias("parent_id"), F.col("ordinal").alias("place"), F.substring("text", 1, 40).alias("title"),
        F.when(odd == 1, "Methods ").when(odd == 2, "song").alias("role"), at.alias("char_start"), F.when(odd == 4, at - 9).otherwise(F.col("char_end") + 700 * (odd == 0).cast("int")).alias("char_end"),
    )


def _anchors(v: Views) -> DataFrame:
    """Quotes of lines as anchors: words of each third line, of which some are in no line or come again."""
    lines, _ = _line_blocks(v)
    odd = F.col("ordinal") % 3
    quote = F.when(odd == 1, F.concat(F.substring("text", 1, 12), F.lit("?!?"))).otherwise(F.substring("text", 1, 12))
    return lines.select("doc_id", F.col("ordinal").alias("node_id"), F.when(odd != 0, F.col("ordinal") - odd).alias("parent_id"), F.col("ordinal").alias("place"), quote.alias("anchor"), F.lit(0).alias("occurrence"))


def _claim_parts(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, kept spans and chunks: a claim for each sentence of all texts and turns, of which some quote or add
    what the source lacks, as a model might."""
    docs, turns = v.raw("documents"), v.raw("conversations")
    lines = sections.text_lines(docs).join(docs.select("doc_id", "source", "lang"), "doc_id")
    header = F.concat(F.lit("title "), F.coalesce("source", F.lit("untitled")), F.lit("; source text; date 1996-01-01; language "), F.coalesce("lang", F.lit("unknown")))
    chunks = lines.select(F.concat(F.lit("D"), "doc_id").alias("doc_id"), F.concat(F.lit("D"), "doc_id", F.lit("-"), "ordinal").alias("chunk_id"), "ordinal", F.floor(F.col("ordinal") / 4).cast("string").alias("section"), header.alias("header"), "text", "char_start")
    talk = turns.select(F.concat(F.lit("C"), "conv_id").alias("doc_id"), F.concat(F.lit("C"), "conv_id", F.lit("-"), "turn").alias("chunk_id"), F.col("turn").cast("int").alias("ordinal"), F.lit("0").alias("section"), F.lit("title untitled; source chat; date 1996-02-01; language unknown").alias("header"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("char_start"))
    chunks = cut(chunks.unionByName(talk))
    found = claims.sentence_candidates(chunks, "header")
    k = F.col("k")
    added = F.when(k % 4 == 1, F.concat(F.lit("according to "), F.element_at(F.split("header", "[ ;]"), 2), F.lit(","))).when(k % 4 == 2, F.concat(F.lit("in 1999 "), F.substring("span", 1, 6), F.lit("’s °"))).when(k % 4 == 3, F.lower("span"))
    day = lambda *at: F.when((k % 6).isin(*at), "2020-01-01")
    moment = F.when(k % 6 == 3, "2020-01-01T10:00:00+02:00")
    candidates = found.select(
        "candidate_id", "chunk_id", F.when(k % 7 == 5, F.concat("span", F.lit("#"))).otherwise(F.col("span")).alias("span"), "claim_text", F.when(added.isNotNull(), F.array(added)).alias("added"),
        F.coalesce(day(1, 2, 4), moment, F.when(k % 6 == 5, "2020-03-01")).alias("valid_from"), F.coalesce(F.when(k % 6 == 1, "2020-02-01"), day(2, 5), moment).alias("valid_until"), F.element_at(F.array(*map(F.lit, ("unknown", "day", "instant", "instant", "open", "day"))), k % 6 + 1).alias("precision"),
    )
    kept = found.where("k % 5 <> 3").select("chunk_id", F.substring("span", 3, 1 << 20).alias("span"), (k % 5 == 1).alias("flagged"))
    return cut(candidates), kept.union(chunks.select("chunk_id", F.lit("nowhere to be found"), F.lit(False))), chunks


WORDS = r"[\p{L}\p{N}_]"


def _tokens_sql(text: str) -> str:
    whole = rf"regexp_replace(lower({text}), '[’' || chr(39) || ']s([^\p{{L}}\p{{N}}_]|$)', chr(1) || '\1', 'g')"
    return rf"list_transform(regexp_extract_all({whole}, '{WORDS}+|[^\p{{L}}\p{{N}}_\s\p{{Z}}]'), lambda t: CASE WHEN t = chr(1) THEN chr(39) || 's' ELSE t END)"


CLAIM_PARTS = r"""
    cutup AS (SELECT doc_id, source, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM main.documents),
    placed AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS a FROM cutup),
    numbered AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS o FROM placed WHERE trim(t, ' ') <> ''),
    chunks_of AS MATERIALIZED (
      SELECT 'D' || doc_id AS doc_id, 'D' || doc_id || '-' || o AS chunk_id, o, CAST(o // 4 AS VARCHAR) AS section, 'title ' || coalesce(source, 'untitled') || '; source text; date 1996-01-01; language ' || coalesce(lang, 'unknown') AS header, t AS text, a FROM numbered
      UNION ALL SELECT 'C' || conv_id, 'C' || conv_id || '-' || turn, turn::INT, '0', 'title untitled; source chat; date 1996-02-01; language unknown', coalesce(text, ''), 0 FROM main.conversations),
    parts AS MATERIALIZED (SELECT chunk_id, header, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM chunks_of),
    said AS MATERIALIZED (SELECT chunk_id, header, unnest(s) AS s, unnest(range(len(s)))::INT AS k FROM parts),
    candidates AS MATERIALIZED (
      SELECT chunk_id || '-' || k AS candidate_id, chunk_id, k, CASE WHEN k % 7 = 5 THEN s || '#' ELSE s END AS span, s AS claim_text,
        CASE k % 4 WHEN 1 THEN 'according to ' || regexp_split_to_array(header, '[ ;]')[2] || ',' WHEN 2 THEN 'in 1999 ' || substr(s, 1, 6) || '’s °' WHEN 3 THEN lower(s) END AS added FROM said),
    retained AS (SELECT DISTINCT chunk_id, substr(s, 3) AS span, bool_or(k % 5 = 1) AS flagged FROM said WHERE k % 5 <> 3 GROUP BY ALL UNION ALL SELECT chunk_id, 'nowhere to be found', false FROM chunks_of)"""
SCAFFOLD = "[" + ", ".join("'" + t.replace(chr(39), chr(39) * 2) + "'" for t in claims.SCAFFOLD) + "]"
JUDGED = rf"""
    around AS (SELECT *, lag(section) OVER w AS s0, lag(text) OVER w AS t0, lead(section) OVER w AS s1, lead(text) OVER w AS t1 FROM chunks_of WINDOW w AS (PARTITION BY doc_id ORDER BY o)),
    drawn AS MATERIALIZED (SELECT doc_id, chunk_id, text, a, lower(text || chr(10) || header || chr(10) || CASE WHEN s0 = section THEN t0 ELSE '' END || chr(10) || CASE WHEN s1 = section THEN t1 ELSE '' END) AS u FROM around),
    found AS MATERIALIZED (SELECT c.*, d.doc_id, d.text, CASE WHEN strpos(text, span) > 0 THEN d.a + strpos(text, span) - 1 END AS a, d.a + strpos(text, span) - 1 + length(span) AS z, u, {_tokens_sql("added")} AS tokens FROM candidates c JOIN drawn d USING (chunk_id)),
    spot AS MATERIALIZED (SELECT r.chunk_id, d.a + strpos(text, r.span) - 1 AS a, d.a + strpos(text, r.span) - 1 + length(r.span) AS z FROM retained r JOIN drawn d USING (chunk_id) WHERE strpos(text, r.span) > 0),
    inside AS (SELECT DISTINCT f.candidate_id FROM found f JOIN spot s ON s.chunk_id = f.chunk_id AND f.a < s.z AND s.a < f.z),
    lacking AS (SELECT candidate_id, list_filter(tokens, lambda t: NOT CASE WHEN regexp_full_match(t, '{WORDS}+') THEN list_contains(words, t) ELSE contains(u, t) END AND NOT (list_contains({SCAFFOLD}, t) AND NOT regexp_matches(t, '\p{{N}}'))) AS l FROM (SELECT candidate_id, tokens, u, regexp_extract_all(u, '{WORDS}+') AS words FROM found)),
    once AS (SELECT candidate_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS failed FROM lacking),
    judged AS (SELECT f.*, failed, flagged, CASE WHEN f.a IS NULL THEN 'span_not_found' WHEN i.candidate_id IS NULL THEN 'outside_kept_ranges' WHEN trim(added) <> '' AND len(failed) > 0 THEN 'added_context_unverified' END AS gate
      FROM found f JOIN once USING (candidate_id) LEFT JOIN inside i USING (candidate_id) LEFT JOIN (SELECT chunk_id, span, flagged FROM retained WHERE flagged) g ON g.chunk_id = f.chunk_id AND g.span = f.span)"""

RATIOS = ("duplicate_title_ratio", "sibling_duplicate_ratio", "numbering_coverage", "tiny_section_ratio", "zero_direct_body_ratio", "oversized_leaf_ratio", "heading_density", "long_title_ratio", "low_letter_ratio", "empty_title_ratio")
#: blocks: lines of texts; tree: the sections of their short lines; each by other means than in Spark.
SKELETON = r"""
    cutup AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM main.documents),
    placed AS (SELECT doc_id, i, t, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS a FROM cutup),
    blocks AS MATERIALIZED (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS k, t, a, (a + length(t))::INT AS z, CASE WHEN length(t) <= 30 THEN (1 + length(t) % 3)::INT END AS level FROM placed WHERE trim(t, ' ') <> ''),
    heads AS MATERIALIZED (SELECT h.doc_id, h.k, h.level, trim(h.t, ' ') AS title, h.a, (SELECT max(p.k) FROM blocks p WHERE p.doc_id = h.doc_id AND p.k < h.k AND p.level < h.level) AS parent, (SELECT min(n.k) FROM blocks n WHERE n.doc_id = h.doc_id AND n.k > h.k AND n.level <= h.level) AS next FROM blocks h WHERE h.level IS NOT NULL),
    turned AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, parent ORDER BY k) - 1 AS turn FROM heads),
    p1 AS (SELECT doc_id, k, [turn] AS way FROM turned WHERE parent IS NULL),
    p2 AS (SELECT t.doc_id, t.k, list_append(p1.way, turn) AS way FROM turned t JOIN p1 ON p1.doc_id = t.doc_id AND p1.k = t.parent),
    p3 AS (SELECT t.doc_id, t.k, list_append(p2.way, turn) AS way FROM turned t JOIN p2 ON p2.doc_id = t.doc_id AND p2.k = t.parent),
    ways AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3),
    last AS (SELECT d.doc_id, coalesce(max(k), -1)::INT AS k FROM main.documents d LEFT JOIN blocks b USING (doc_id) GROUP BY 1),
    tree AS MATERIALIZED (
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY way) - 1)::INT AS ordinal, array_to_string(list_prepend(0, way), '.') AS node_path, CASE WHEN len(way) > 0 THEN array_to_string(list_prepend(0, way[:-2]), '.') END AS parent_path,
        title, trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '\s+', ' ', 'g')) AS normalized_title, level AS heading_level, 'body' AS role, s AS block_start, e AS block_end, a AS char_start, z AS char_end
      FROM (SELECT d.doc_id, CAST([] AS BIGINT[]) AS way, coalesce(d.source, '') AS title, NULL::INT AS level, 0 AS s, last.k AS e, 0 AS a, length(coalesce(d.text, ''))::INT AS z FROM main.documents d JOIN last USING (doc_id)
        UNION ALL SELECT t.doc_id, w.way, t.title, t.level, t.k, e.k, t.a, e.z FROM turned t JOIN ways w ON w.doc_id = t.doc_id AND w.k = t.k JOIN last l ON l.doc_id = t.doc_id JOIN blocks e ON e.doc_id = t.doc_id AND e.k = coalesce(t.next - 1, l.k)))"""
STATISTICS = r"""
    s AS MATERIALIZED (SELECT * FROM tree WHERE node_path <> '0'),
    own AS (SELECT b.doc_id, b.k, b.z - b.a AS size, arg_max(s.node_path, s.ordinal) AS node_path FROM blocks b JOIN s ON s.doc_id = b.doc_id AND b.k BETWEEN s.block_start AND s.block_end GROUP BY ALL),
    direct AS (SELECT s.doc_id, s.node_path, coalesce(sum(o.size) FILTER (WHERE o.k <> s.block_start), 0) AS body FROM s LEFT JOIN own o ON o.doc_id = s.doc_id AND o.node_path = s.node_path GROUP BY ALL),
    fans AS (SELECT doc_id, parent_path, count(*) AS n, count(*) - count(DISTINCT normalized_title) AS twice FROM s GROUP BY ALL),
    num AS (SELECT *, regexp_extract(ltrim(normalized_title), '^(\d+(?:\.\d+)*)($|[\s.)])', 1) AS ar, regexp_extract(ltrim(normalized_title), '^([a-z])\.($|\s)', 1) AS al, upper(regexp_extract(ltrim(normalized_title), '^([ivxlcdm]+)($|[\s.)])', 1)) AS ro FROM s),
    val AS (SELECT *, len(ro) - len(replace(ro, 'I', '')) + 5 * (len(ro) - len(replace(ro, 'V', ''))) + 10 * (len(ro) - len(replace(ro, 'X', ''))) + 50 * (len(ro) - len(replace(ro, 'L', ''))) + 100 * (len(ro) - len(replace(ro, 'C', ''))) + 500 * (len(ro) - len(replace(ro, 'D', ''))) + 1000 * (len(ro) - len(replace(ro, 'M', '')))
        - 2 * (contains(ro, 'IV')::INT + contains(ro, 'IX')::INT) - 20 * (contains(ro, 'XL')::INT + contains(ro, 'XC')::INT) - 200 * (contains(ro, 'CD')::INT + contains(ro, 'CM')::INT) AS rv, ro <> '' AND regexp_full_match(ro, 'M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})') AS rok FROM num),
    got AS (SELECT *, CASE WHEN ar <> '' THEN 'n' WHEN al <> '' AND al NOT IN ('i', 'v', 'x', 'l', 'c', 'd', 'm') THEN 'a' WHEN rok THEN 'r' WHEN al <> '' THEN 'a' END AS scheme FROM val),
    valued AS (SELECT *, CASE scheme WHEN 'n' THEN list_transform(string_split(ar, '.'), lambda x: CAST(x AS DECIMAL(38, 0))) WHEN 'a' THEN [CAST(ascii(al) - 96 AS DECIMAL(38, 0))] WHEN 'r' THEN [CAST(rv AS DECIMAL(38, 0))] END AS v FROM got),
    lagged AS (SELECT *, lag(scheme) OVER w AS scheme0, lag(v) OVER w AS v0, lag(heading_level) OVER (PARTITION BY doc_id ORDER BY ordinal) AS level0 FROM valued WINDOW w AS (PARTITION BY doc_id, parent_path ORDER BY block_start)),
    sums AS (
      SELECT l.doc_id, count(*) AS n, 1 - count(DISTINCT normalized_title) / count(*) AS dup, sum(greatest(0, heading_level - level0 - 1)) AS jumps, count(scheme) / count(*) AS cover, count(*) FILTER (WHERE scheme = scheme0 AND v < v0) AS inv, count(*) FILTER (WHERE scheme <> scheme0) AS sw,
        count(*) FILTER (WHERE body < 80) / count(*) AS tiny, count(*) FILTER (WHERE body = 0) / count(*) AS zero, max(char_end - char_start) FILTER (WHERE f.n IS NULL) AS leaf, list_sort(list(length(normalized_title))) AS ls,
        count(*) FILTER (WHERE length(normalized_title) > 120) / count(*) AS long, count(*) FILTER (WHERE CASE WHEN normalized_title = '' THEN true ELSE length(regexp_replace(normalized_title, '[^\p{L}]', '', 'g')) / length(normalized_title) < 0.5 END) / count(*) AS low, count(*) FILTER (WHERE normalized_title = '') / count(*) AS empty
      FROM lagged l JOIN direct d ON d.doc_id = l.doc_id AND d.node_path = l.node_path LEFT JOIN fans f ON f.doc_id = l.doc_id AND f.parent_path = l.node_path GROUP BY l.doc_id),
    most AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, normalized_title, count(*) AS n FROM s GROUP BY ALL) GROUP BY 1),
    fan AS (SELECT doc_id, max(n) AS n, sum(twice) AS twice FROM fans GROUP BY 1)
    SELECT d.doc_id, coalesce(c.sections, 0) AS section_count, round(dup, 6) AS duplicate_title_ratio, m.n AS max_title_multiplicity, round(twice / z.n, 6) AS sibling_duplicate_ratio, CAST(CASE WHEN z.n >= 3 THEN coalesce(jumps, 0) END AS BIGINT) AS level_jump_count, round(cover, 6) AS numbering_coverage, inv AS numbering_inversions, sw AS numbering_scheme_switches,
      round(tiny, 6) AS tiny_section_ratio, round(zero, 6) AS zero_direct_body_ratio, round(leaf / length(d.text), 6) AS oversized_leaf_ratio, round(z.n * 10000 / length(d.text), 6) AS heading_density, CAST(ls[greatest(1, ceil(0.5 * z.n))::INT] AS DOUBLE) AS title_length_p50, CAST(ls[greatest(1, ceil(0.95 * z.n))::INT] AS DOUBLE) AS title_length_p95,
      round(long, 6) AS long_title_ratio, round(low, 6) AS low_letter_ratio, round(empty, 6) AS empty_title_ratio, f.n AS max_sibling_fanout
    FROM main.documents d LEFT JOIN sums z ON z.doc_id = d.doc_id AND z.n >= 3 LEFT JOIN most m ON m.doc_id = z.doc_id LEFT JOIN fan f ON f.doc_id = z.doc_id LEFT JOIN (SELECT doc_id AS of, n AS sections FROM sums) c ON c.of = d.doc_id"""


#: Name: (query over the views, SQL over their oracle).
def catalog() -> dict[str, tuple[Callable[[Views], DataFrame], str | None]]:
    q: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {name: ((lambda v, n=name: getattr(v, n)), f"SELECT * FROM v_{name}") for name in PUBLISHED}
    q["survivor_map"] = (lambda v: v.survivors, "SELECT * FROM v_survivors")
    history = "SELECT * FROM v_facts_visible_history WHERE "
    at, until = f"TIMESTAMP '{AT}'", f"TIMESTAMP '{SINCE}'"
    mode = lambda name, **k: lambda v: v.facts_visible_history.where(temporal.fact_time(name, v.now, **{a: temporal.instant(b) for a, b in k.items()}))
    half = f"(valid_from IS NULL OR valid_from <= {at}) AND (valid_until IS NULL OR valid_until > {at})"
    q["facts_at"] = (mode("at", at=AT), f"{history} invalidated_at IS NULL AND {half}")
    q["facts_overlap"] = (mode("overlap", start=AT, end=SINCE), f"{history} invalidated_at IS NULL AND (valid_from IS NULL OR valid_from <= {until}) AND (valid_until IS NULL OR valid_until > {at})")
    q["facts_history"] = (mode("history"), f"{history} (valid_from IS NULL OR valid_from <= {view_sql.NOW})")
    q["facts_as_of"] = (
        lambda v: v.facts_as_of(AT, SINCE),
        f"SELECT *, {at} AS applied_valid_at, {until} AS applied_believed_at, 'current' AS identity_regime FROM v_facts_visible_history WHERE {half} AND ingested_at <= {until} AND (invalidated_at IS NULL OR invalidated_at > {until}) ORDER BY fact_kind, fact_id LIMIT 200",
    )
    open_at = f"invalidated_at IS NULL AND {half}"
    q["lookup_relations"] = (lambda v: facts.lookup_relations(v, AT, subject=PERSON, predicate="ordered"), f"SELECT relation_id, subject_entity_id, predicate, object_entity_id, fact_label, valid_from, valid_until, evidence_count FROM relations WHERE {open_at} AND subject_entity_id = '{PERSON}' AND predicate = 'ordered'")
    late = "2024-01-15 00:00:00"
    q["lookup_observations"] = (lambda v: facts.lookup_observations(v, ACCOUNT, late), f"SELECT observation_id, statement, valid_from, valid_until, confidence FROM observations WHERE subject_entity_id = '{ACCOUNT}' AND {open_at.replace(AT, late)}")
    believed = "invalidated_at IS NULL"
    q["agg_count"] = (lambda v: facts.aggregate(v, "count", predicate="ordered"), f"SELECT NULL::VARCHAR AS key, count(*) AS count, NULL::VARCHAR AS entity_id FROM relations WHERE {believed} AND predicate = 'ordered'")
    q["agg_group_by_predicate"] = (lambda v: facts.aggregate(v, "group_by_predicate", subject=PERSON), f"SELECT predicate AS key, count(*) AS count, NULL::VARCHAR AS entity_id FROM relations WHERE {believed} AND subject_entity_id = '{PERSON}' GROUP BY 1")
    q["agg_group_by_object"] = (
        lambda v: facts.aggregate(v, "group_by_object", subject=PERSON, limit=20),
        f"SELECT e.canonical_name AS key, count(*) AS count, e.entity_id FROM relations r JOIN entities e ON e.entity_id = r.object_entity_id WHERE {believed} AND subject_entity_id = '{PERSON}' GROUP BY 1, 3 ORDER BY 2 DESC, 1, 3 LIMIT 21",
    )
    q["agg_timeline"] = (
        lambda v: facts.aggregate(v, "timeline", subject=PERSON),
        f"SELECT strftime(t, '%Y') AS key, count(*) AS count, NULL::VARCHAR AS entity_id FROM (SELECT coalesce(valid_from, ingested_at) AS t FROM relations WHERE {believed} AND '{PERSON}' IN (subject_entity_id, object_entity_id) UNION ALL SELECT coalesce(valid_from, ingested_at) FROM observations WHERE {believed} AND subject_entity_id = '{PERSON}') GROUP BY 1",
    )
    q["agg_delta_top_entities"] = (
        lambda v: facts.aggregate(v, "delta_top_entities", since=SINCE, limit=20),
        f"SELECT e.canonical_name AS key, count(*) AS count, e.entity_id FROM (SELECT subject_entity_id AS s FROM relations WHERE ingested_at > {until} UNION ALL SELECT subject_entity_id FROM observations WHERE ingested_at > {until}) JOIN entities e ON e.entity_id = s GROUP BY 1, 3 ORDER BY 2 DESC, 1, 3 LIMIT 21",
    )
    q["agg_typed_absence"] = (
        lambda v: facts.aggregate(v, "typed_absence", entity_type="nation", predicate="part_of", limit=40),
        "SELECT canonical_name AS key, 1::BIGINT AS count, entity_id FROM entities e WHERE status = 'active' AND type = 'nation' AND NOT EXISTS (FROM relations r WHERE r.predicate = 'part_of' AND r.subject_entity_id = e.entity_id AND r.invalidated_at IS NULL) ORDER BY 1, 3 LIMIT 41",
    )
    feed = f"""
        feed AS (
          SELECT 'relation' AS kind, 'new' AS change, relation_id AS id, coalesce(fact_label, predicate) AS label, ingested_at AS at_ FROM relations UNION ALL SELECT 'relation', 'invalidated', relation_id, coalesce(fact_label, predicate), invalidated_at FROM relations
          UNION ALL SELECT 'relation', 'capped', r.relation_id, coalesce(fact_label, predicate), a.decided_at FROM relations r JOIN relation_adjudications a USING (relation_id) WHERE a.outcome = 'supersede'
          UNION ALL SELECT 'observation', 'new', observation_id, statement, ingested_at FROM observations UNION ALL SELECT 'observation', 'invalidated', observation_id, statement, invalidated_at FROM observations
          UNION ALL SELECT 'observation', 'capped', o.observation_id, statement, a.decided_at FROM observations o JOIN observation_adjudications a USING (observation_id) WHERE a.outcome = 'supersede'
          UNION ALL SELECT 'claim', 'new', claim_id, substr(claim_text, 1, 80), ingested_at FROM claims UNION ALL SELECT 'page', 'recompiled', artifact_id, NULL, compiled_at FROM knowledge_compilations)"""
    q["delta_feed"] = (lambda v: facts.delta_feed(v, SINCE, limit=300), f"WITH {feed} SELECT kind, change, id, label, at_ AS at FROM feed WHERE at_ > {until} ORDER BY at_ DESC, id DESC LIMIT 301")
    cursor_at, cursor_id = "2001-01-01 00:00:00", "ordered:C9"
    q["delta_page2"] = (
        lambda v: facts.delta_feed(v, SINCE, kinds=["relation", "page"], limit=300, cursor=facts.encode_cursor(cursor_at, cursor_id)),
        f"WITH {feed} SELECT kind, change, id, label, at_ AS at FROM feed WHERE at_ > {until} AND kind IN ('relation', 'page') AND (at_ < TIMESTAMP '{cursor_at}' OR at_ = TIMESTAMP '{cursor_at}' AND id < '{cursor_id}') ORDER BY at_ DESC, id DESC LIMIT 301",
    )
    q["scan_relations"] = (lambda v: facts.scan(v, "relation"), "SELECT relation_id AS id, coalesce(fact_label, predicate) AS label, ingested_at AS at FROM relations")
    q["scan_observations"] = (lambda v: facts.scan(v, "observation"), "SELECT observation_id AS id, statement AS label, ingested_at AS at FROM observations")
    q["scan_claims"] = (lambda v: facts.scan(v, "claim"), "SELECT claim_id AS id, substr(claim_text, 1, 120) AS label, ingested_at AS at FROM claims")
    q["documents_about"] = (
        lambda v: facts.documents_about(v, "S3"),
        "WITH g AS (SELECT d.doc_id, d.title, d.source_kind, count(DISTINCT m.mention_id) AS mention_count, min(m.created_at) AS first_mentioned_at, max(m.created_at) AS last_mentioned_at FROM resolution_decisions r JOIN mentions m USING (mention_id) JOIN documents d USING (doc_id) WHERE r.entity_id = 'S3' AND r.superseded_by IS NULL AND d.deleted_at IS NULL GROUP BY 1, 2, 3) SELECT *, count(*) OVER () AS total_count FROM g ORDER BY mention_count DESC, last_mentioned_at DESC, doc_id LIMIT 20",
    )
    q["claims_about"] = (
        lambda v: facts.claims_about(v, "S3"),
        "WITH g AS (SELECT DISTINCT c.claim_id, c.asserted_at, c.ingested_at FROM resolution_decisions r JOIN mentions m USING (mention_id) JOIN chunk_claims k ON k.chunk_id = m.chunk_id JOIN claims c ON c.claim_id = k.claim_id JOIN documents d ON d.doc_id = c.doc_id WHERE r.entity_id = 'S3' AND r.superseded_by IS NULL AND c.is_current_testimony AND d.deleted_at IS NULL) SELECT claim_id, count(*) OVER () AS total_count FROM g ORDER BY asserted_at DESC NULLS LAST, ingested_at DESC, claim_id LIMIT 20",
    )
    q["claims_as_of"] = (
        lambda v: facts.claims_as_of(v, AT, SINCE),
        f"SELECT c.claim_id, c.claim_valid_from, count(*) OVER () AS total_count, (SELECT count(*) FROM claims WHERE claim_valid_precision = 'unknown') AS unstamped_count FROM claims c JOIN documents d USING (doc_id) WHERE d.deleted_at IS NULL AND claim_valid_precision <> 'unknown' AND claim_valid_from <= {until} AND (claim_valid_until IS NULL OR claim_valid_until >= {at}) ORDER BY claim_valid_from DESC, claim_id LIMIT 20",
    )
    q["chunk_neighbors"] = (lambda v: facts.chunk_neighbors(v, "K2-2", 2), "WITH focal AS MATERIALIZED (SELECT c.version_id, c.ordinal AS focal FROM chunks c JOIN v_documents_live d ON d.has_current_ready_content AND d.doc_id = c.doc_id AND d.current_version_id = c.version_id WHERE c.chunk_id = 'K2-2') SELECT chunk_id, ordinal FROM chunks JOIN focal USING (version_id) WHERE abs(ordinal - focal) <= 2")
    for kind, stored in (("relation", "evidence_count, contradict_count"), ("observation", "1 AS evidence_count, 0 AS contradict_count")):
        q[f"recount_{kind}s"] = (
            lambda v, k=kind: facts.recount(v, k),
            f"WITH f AS (SELECT e.{kind}_id, count(DISTINCT e.doc_id) FILTER (WHERE stance = 'supports' AND is_current_testimony) AS s, count(DISTINCT e.doc_id) FILTER (WHERE stance = 'contradicts' AND is_current_testimony) AS c FROM {kind}_evidence e JOIN claims USING (claim_id) GROUP BY 1), b AS (SELECT {kind}_id, {stored} FROM {kind}s) SELECT b.{kind}_id, coalesce(s, 0) AS supports, coalesce(c, 0) AS contradicts FROM b LEFT JOIN f USING ({kind}_id) WHERE evidence_count <> coalesce(s, 0) OR contradict_count <> coalesce(c, 0)",
        )
    carried = "spot AS MATERIALIZED (SELECT chunk_id, c.doc_id, version_id, current_version_id FROM chunks c JOIN documents d ON d.doc_id = c.doc_id), carried AS MATERIALIZED (SELECT DISTINCT k.claim_id FROM chunk_claims k JOIN spot USING (chunk_id) WHERE version_id = current_version_id), origin AS MATERIALIZED (SELECT cl.claim_id, cl.doc_id, cl.is_current_testimony, s.version_id AS from_version_id, s.current_version_id FROM claims cl JOIN spot s USING (chunk_id))"
    q["currency_stale"] = (facts.stale_superseded, f"WITH {carried} SELECT claim_id, doc_id, from_version_id FROM origin ANTI JOIN carried USING (claim_id) WHERE is_current_testimony AND from_version_id <> current_version_id")
    q["currency_regained"] = (facts.regained, f"WITH {carried} SELECT claim_id, doc_id, from_version_id FROM origin LEFT JOIN (SELECT claim_id, true AS held FROM carried) USING (claim_id) WHERE NOT is_current_testimony AND (from_version_id = current_version_id OR held)")
    q["zero_support"] = (
        lambda v: facts.zero_support(v, SINCE),
        f"WITH backed AS MATERIALIZED (SELECT DISTINCT e.relation_id FROM relation_evidence e JOIN claims c USING (claim_id) WHERE stance = 'supports' AND is_current_testimony), waiting AS MATERIALIZED (SELECT candidate ->> '$.fact_id' AS relation_id FROM review_queue WHERE status IN ('pending', 'deferred')), open AS MATERIALIZED (SELECT relation_id FROM relations WHERE {believed} AND (valid_until IS NULL OR valid_until > {until})) SELECT relation_id, {until} AS valid_until FROM open ANTI JOIN backed USING (relation_id) ANTI JOIN waiting USING (relation_id)",
    )
    q["supersede_windows"] = (
        lambda v: facts.supersede_windows(v, "ordered"),
        f"""WITH a AS (SELECT relation_id, min(asserted_at) AS asserted_at FROM relation_evidence JOIN claims USING (claim_id) WHERE stance = 'supports' GROUP BY 1),
        n AS (SELECT r.relation_id, r.valid_until, s.survivor_entity_id AS s, o.survivor_entity_id AS o, a.asserted_at FROM relations r JOIN v_survivors s ON s.entity_id = r.subject_entity_id JOIN v_survivors o ON o.entity_id = r.object_entity_id LEFT JOIN a USING (relation_id) WHERE predicate = 'ordered' AND {believed}),
        w AS (SELECT *, lead(o) OVER l AS next_o, lead(asserted_at) OVER l AS b, lead(relation_id) OVER l AS next_id FROM n WINDOW l AS (PARTITION BY s ORDER BY asserted_at NULLS LAST, relation_id))
        SELECT relation_id, next_id AS superseded_by, b AS valid_until FROM w WHERE b IS NOT NULL AND next_o <> o AND (valid_until IS NULL OR b < valid_until)""",
    )
    fact_ids = [f"located_in:C{c}:N{n}" for c in range(1, 12) for n in range(25)]
    q["fact_evidence"] = (
        lambda v: facts.fact_evidence(v, fact_ids),
        f"""WITH f AS (SELECT unnest({fact_ids}) AS fact_id, unnest(range(1, {len(fact_ids) + 1})) AS place),
        r AS (SELECT l.fact_id, l.stance, l.doc_id, l.representative_claim_id, f.place, row_number() OVER (PARTITION BY l.fact_id, l.stance ORDER BY asserted_to DESC NULLS LAST, doc_id, representative_claim_id) AS rank, count(*) OVER (PARTITION BY l.fact_id, l.stance) AS stance_total FROM v_evidence_lineage l JOIN f USING (fact_id))
        SELECT fact_id, stance, doc_id, representative_claim_id, CAST(rank AS INTEGER) AS rank, stance_total FROM r WHERE rank <= 3 ORDER BY rank, place, stance DESC LIMIT 60""",
    )
    q["contradiction_members"] = (facts.contradiction_members, "SELECT contradiction_group, fact_kind, fact_id, CAST(row_number() OVER w AS INTEGER) AS place, count(*) OVER (PARTITION BY contradiction_group) AS members FROM v_contradiction_members_current WINDOW w AS (PARTITION BY contradiction_group ORDER BY fact_kind, fact_id) QUALIFY row_number() OVER w <= 25")
    window = "to_timestamp(floor(epoch_us(occurred_at) / 86400000000) * 86400)::TIMESTAMP AS window_start"
    q["budget_window"] = (lambda v: facts.budget_window(v, 86400), f"SELECT {window}, stage, lane, sum(cost_usd)::DOUBLE AS cost_usd, count(*) AS receipts FROM cost_ledger GROUP BY ALL")
    q["budget_by_tier"] = (lambda v: facts.budget_window(v, 86400, by_tier=True), f"SELECT {window}, stage, lane, tier, sum(cost_usd)::DOUBLE AS cost_usd, count(*) AS receipts FROM cost_ledger GROUP BY ALL")
    receipts = "SELECT occurred_at, 'worker' AS source, cost_id, cost_usd::DOUBLE AS cost_usd FROM cost_ledger UNION ALL SELECT occurred_at, 'surface', cost_id, cost_usd::DOUBLE FROM surface_cost_ledger"
    after = ("2024-01-10 00:00:00", "surface", "")
    q["cost_receipts"] = (lambda v: facts.cost_receipts(v, "2024-01-20 00:00:00", after), f"WITH r AS ({receipts}) SELECT * FROM r WHERE occurred_at <= TIMESTAMP '2024-01-20' AND (occurred_at, source, cost_id) > (TIMESTAMP '{after[0]}', 'surface', '') ORDER BY occurred_at, source, cost_id LIMIT 100")
    q["review_pending"] = (facts.review_pending, "SELECT review_id, status, expected_impact, created_at FROM review_queue WHERE status IN ('pending', 'deferred') ORDER BY expected_impact DESC, created_at, review_id LIMIT 20")
    q["dead_letters"] = (facts.dead_letters, "SELECT stage, regexp_extract(string_split(last_error, chr(10))[-1], '^([A-Za-z_.]+)', 1) AS error_class, count(*) AS units, max(enqueued_at) AS last_enqueued_at FROM processing_state WHERE status = 'dead' GROUP BY 1, 2")
    q["quarantine_report"] = (
        facts.quarantine,
        """SELECT 'claims_without_chunk' AS probe, count(*) AS rows FROM claims WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks) UNION ALL SELECT 'chunks_without_version', count(*) FROM chunks WHERE version_id NOT IN (SELECT version_id FROM document_versions)
        UNION ALL SELECT 'mentions_without_decision', count(*) FROM mentions WHERE mention_id NOT IN (SELECT mention_id FROM resolution_decisions) UNION ALL SELECT 'entities_without_survivor', count(*) FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM v_survivors)
        UNION ALL SELECT 'relations_without_evidence', count(*) FROM relations WHERE relation_id NOT IN (SELECT relation_id FROM relation_evidence)""",
    )
    q["transcript_entity"] = (
        lambda v: facts.transcript(v, "entity", "S3"),
        "WITH t AS (SELECT decision_id AS event_id, 'resolution' AS event, method AS outcome, decided_at FROM resolution_decisions WHERE entity_id = 'S3' UNION ALL SELECT merge_id, 'merge', CASE WHEN reversed_by IS NULL THEN 'merge' ELSE 'unmerge' END, decided_at FROM merge_events WHERE 'S3' IN (survivor_id, absorbed_id)) SELECT * FROM t ORDER BY decided_at DESC, event_id LIMIT 40",
    )
    # ranking
    cos = "list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
    semantic = lambda k: f"SELECT c.chunk_id, {cos} AS score, row_number() OVER (ORDER BY {cos} DESC, c.chunk_id) AS rank FROM chunk_search c, (SELECT embedding FROM main.embeddings WHERE vec_id = 0) q WHERE c.embedding IS NOT NULL QUALIFY rank <= {k}"
    asked = sorted(set(TEXT_QUERY.split()))
    bm25 = lambda k: f"""SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM (
          SELECT *, count(*) OVER (PARTITION BY t) AS df FROM (SELECT chunk_id, length, t, len(list_filter(w, lambda x: x = t)) AS tf FROM words, (SELECT unnest({asked}) AS t)) WHERE tf > 0), (SELECT count(*) AS n, avg(length) AS mean FROM words) GROUP BY 1) QUALIFY rank <= {k}"""  # noqa: E731
    words = "words AS (SELECT chunk_id, w, len(w) AS length FROM (SELECT chunk_id, list_filter(regexp_split_to_array(lower(search_text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM chunk_search))"
    q["semantic_topk"] = (lambda v: _rounded(retrieval.semantic_topk(v.spine["chunk_search"], query_vector(v), 20), "score"), f"SELECT chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({semantic(20)})")
    q["bm25_topk"] = (lambda v: _rounded(retrieval.bm25_topk(v.chunk_postings, TEXT_QUERY, 20), "score"), f"WITH {words} SELECT chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({bm25(20)})")
    fused = f"WITH {words}, fused AS (SELECT chunk_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT chunk_id, rank FROM ({semantic(40)}) UNION ALL SELECT chunk_id, rank FROM ({bm25(40)})) GROUP BY 1)"
    q["hybrid_rrf"] = (lambda v: _rounded(_fused(v).drop("signals"), "score"), f"{fused} SELECT chunk_id, round(score, 6) AS score FROM fused")
    q["testimony_chunks"] = (
        lambda v: _rounded(retrieval.testimony_chunks(v, query_vector(v), TEXT_QUERY, 15, 40), "score"),
        f"{fused} SELECT f.chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, k.doc_id, k.version_id FROM (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM fused) f JOIN v_chunks_live k USING (chunk_id) ORDER BY rank LIMIT 15",
    )
    q["confirm_nominations"] = (
        lambda v: retrieval.confirm(_nominations(v), v.chunks_live, "chunk_id", F.col("chunk_id") > "KD5"),
        f"SELECT n.chunk_id, CAST(n.rank AS INTEGER) AS rank, round(n.score, 6) AS score, CASE WHEN k.chunk_id IS NULL THEN 'dropped_stale' WHEN k.chunk_id > 'KD5' THEN 'kept' ELSE 'dropped_filtered' END AS outcome FROM (SELECT CASE WHEN rank % 10 = 0 THEN 'gone-' || chunk_id ELSE chunk_id END AS chunk_id, rank, score FROM ({semantic(50)})) n LEFT JOIN v_chunks_live k USING (chunk_id)",
    )
    items = f"items AS (SELECT relation_id, confidence AS score, CASE WHEN valid_until IS NOT NULL THEN length(object_entity_id)::DOUBLE END AS graph_distance, evidence_count::DOUBLE AS evidence_count FROM relations WHERE subject_entity_id = '{PERSON}')"
    q["rerank_evidence"] = (lambda v: retrieval.rerank_by_signal(_items(v), "evidence_count", "relation_id"), f"WITH {items} SELECT relation_id, coalesce(evidence_count, score) AS score, graph_distance, evidence_count FROM items")
    q["rerank_weighted"] = (
        lambda v: _rounded(retrieval.rerank_weighted(_items(v), "relation_id"), "score"),
        f"""WITH {items}, b AS (SELECT max(score) AS hs, min(graph_distance) AS lg, max(graph_distance) AS hg, min(evidence_count) AS le, max(evidence_count) AS he FROM items)
        SELECT relation_id, round(greatest(score, 0) / hs + 0.1 * CASE WHEN graph_distance IS NULL THEN 0 WHEN lg = hg THEN 1 ELSE (hg - graph_distance) / (hg - lg) END + 0.1 * CASE WHEN le = he THEN 1 ELSE (evidence_count - le) / (he - le) END, 6) AS score, graph_distance, evidence_count FROM items, b""",
    )
    q["resolve"] = (
        lambda v: retrieval.resolve(v, "Hot Gear", context=(PERSON, OTHER_PERSON)),
        f"""WITH e AS (SELECT subject_entity_id AS a, object_entity_id AS b FROM v_graph_edges_current UNION ALL SELECT object_entity_id, subject_entity_id FROM v_graph_edges_current)
        SELECT c.entity_id, c.canonical_name, c.entity_type, (SELECT count(DISTINCT b) FROM e WHERE a = c.entity_id AND b IN ('{PERSON}', '{OTHER_PERSON}')) AS context_hits FROM v_entities_current c WHERE entity_id IN (SELECT entity_id FROM v_entity_aliases_current WHERE normalized_lemma = 'hot gear')""",
    )
    # graph
    e = "e AS MATERIALIZED (SELECT relation_id AS id, subject_entity_id AS a, object_entity_id AS b FROM v_graph_edges_current UNION ALL SELECT relation_id, object_entity_id, subject_entity_id FROM v_graph_edges_current WHERE subject_entity_id <> object_entity_id)"
    walk = lambda start, depth: f"w AS (SELECT 0 AS hop, []::VARCHAR[] AS r, ['{start}'] AS n UNION ALL SELECT hop + 1, list_append(r, id), list_append(n, b) FROM w JOIN e ON e.a = n[-1] WHERE hop < {depth} AND NOT list_contains(r, id) AND NOT list_contains(n, b))"
    q["neighborhood_2hop"] = (lambda v: graph.neighborhood(graph.edges_of(v), PERSON, 2, None), f"WITH RECURSIVE {e}, {walk(PERSON, 2)} SELECT n[-1] AS node, CAST(min(hop) AS INTEGER) AS hops FROM w WHERE hop > 0 GROUP BY 1")
    q["graph_neighborhood"] = (
        lambda v: graph.graph_neighborhood(graph.edges_of(v), PERSON, 2, 100),
        f"WITH RECURSIVE {e}, {walk(PERSON, 2)} SELECT CAST(hop AS INTEGER) AS hop, n[-2] AS from_entity_id, n[-1] AS to_entity_id, r[-1] AS relation_id, CAST(row_number() OVER (ORDER BY hop, r[-1], n[-1], n[-2]) AS INTEGER) AS path_id FROM w WHERE hop > 0 QUALIFY path_id <= 100",
    )
    stop = walk(PERSON, 4).replace("WHERE hop", f"WHERE n[-1] <> '{OTHER_PERSON}' AND hop")
    q["graph_path"] = (
        lambda v: graph.graph_path(graph.edges_of(v), PERSON, OTHER_PERSON, 4, 3),
        f"WITH RECURSIVE {e}, {stop}, p AS (SELECT r, n, row_number() OVER (ORDER BY hop, r) AS path_id FROM w WHERE n[-1] = '{OTHER_PERSON}' QUALIFY path_id <= 3) SELECT CAST(path_id AS INTEGER) AS path_id, CAST(i AS INTEGER) AS path_position, n[i] AS from_entity_id, n[i + 1] AS to_entity_id, r[i] AS relation_id FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM p)",
    )
    q["shortest_path"] = (lambda v: graph.shortest_path(graph.edges_of(v), PERSON, OTHER_PERSON, 4), f"WITH RECURSIVE {e}, {stop} SELECT CAST(hop AS INTEGER) AS length, r AS relations, n AS nodes FROM w WHERE n[-1] = '{OTHER_PERSON}' ORDER BY hop, r LIMIT 1")
    q["citation_path"] = (
        lambda v: graph.citation_path(v.document_crossrefs_live, "T0-3", "T0-0"),
        "WITH RECURSIVE c AS (SELECT 0 AS hop, ['T0-3'] AS n UNION ALL SELECT hop + 1, list_append(n, to_doc_id) FROM c JOIN v_document_crossrefs_live r ON r.from_doc_id = n[-1] WHERE hop < 6 AND NOT list_contains(n, to_doc_id)) SELECT CAST(hop AS INTEGER) AS length, n AS nodes FROM c WHERE n[-1] = 'T0-0' ORDER BY hop, n LIMIT 1",
    )
    q["degrees"] = (lambda v: graph.degrees(graph.edges_of(v)), "SELECT x AS node, count(*) AS degree FROM (SELECT subject_entity_id AS x FROM v_graph_edges_current UNION ALL SELECT object_entity_id FROM v_graph_edges_current) GROUP BY 1")
    links = "l AS MATERIALIZED (SELECT DISTINCT subject_entity_id AS a, object_entity_id AS b FROM v_graph_edges_current), o AS (SELECT a, count(*) AS ways FROM l GROUP BY 1), nodes AS MATERIALIZED (SELECT x, ways FROM (SELECT a AS x FROM l UNION SELECT b FROM l) LEFT JOIN o ON o.a = x)"
    steps = "r0 AS (SELECT x, ways, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS r FROM nodes)"
    for i in range(10):
        steps += f", r{i + 1} AS MATERIALIZED (SELECT x, ways, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce((SELECT sum(r) FROM r{i} WHERE ways IS NULL), 0) / (SELECT count(*) FROM nodes) + 0.85 * coalesce(g, 0) AS r FROM nodes LEFT JOIN (SELECT l.b, sum(p.r / p.ways) AS g FROM l JOIN r{i} p ON p.x = l.a GROUP BY 1) ON b = x)"
    q["pagerank_10"] = (lambda v: _rounded(graph.pagerank(graph.edges_of(v)).withColumn("rank", F.col("rank") * 1e3), "rank"), f"WITH {links}, {steps} SELECT x AS node, round(r * 1e3, 6) AS rank FROM r10")
    # least labels and h-indexes of neighbours, in so many rounds that none changes any more on the test graph
    sides = "u AS MATERIALIZED (SELECT subject_entity_id AS a, object_entity_id AS b FROM v_graph_edges_current WHERE subject_entity_id <> object_entity_id UNION SELECT object_entity_id, subject_entity_id FROM v_graph_edges_current WHERE subject_entity_id <> object_entity_id)"
    walks = "w0 AS MATERIALIZED (SELECT subject_entity_id AS node, subject_entity_id AS c FROM v_graph_edges_current UNION SELECT object_entity_id, object_entity_id FROM v_graph_edges_current)"
    cores = "k0 AS MATERIALIZED (SELECT a AS node, count(*) AS c FROM u GROUP BY 1)"
    for i in range(12):
        walks += f", w{i + 1} AS MATERIALIZED (SELECT n.node, least(n.c, coalesce(min(m.c), n.c)) AS c FROM w{i} n LEFT JOIN u ON u.a = n.node LEFT JOIN w{i} m ON m.node = u.b GROUP BY n.node, n.c)"
    for i in range(30):
        cores += f", k{i + 1} AS MATERIALIZED (SELECT node, least(any_value(own), max(least(c, r))) AS c FROM (SELECT u.a AS node, o.c AS own, k.c, row_number() OVER (PARTITION BY u.a ORDER BY k.c DESC) AS r FROM u JOIN k{i} k ON k.node = u.b JOIN k{i} o ON o.node = u.a) GROUP BY node)"
    q["weak_components"] = (lambda v: graph.weak_components(graph.edges_of(v)), f"WITH {sides}, {walks} SELECT node, c AS component FROM w12")
    q["core_numbers"] = (lambda v: graph.core_numbers(graph.edges_of(v)), f"WITH {sides}, {cores} SELECT node, c AS core FROM k30")
    q["communities"] = (lambda v: graph.communities(graph.edges_of(v)), None)
    # shipped statements, through the gate
    own = {name: f"SELECT * FROM v_{name}" for name in PUBLISHED}
    for name, sql in examples.EXAMPLES.items():
        q[f"example_{name}"] = ((lambda v, sql=sql: _unzoned(gate.Sandbox(v, embed=lambda text: query_vector(v)).frame(sql))), view_sql.oracle(examples.OWN_SQL[name]) if name in examples.OWN_SQL else view_sql.oracle(sql, **own) if name in examples.PLAIN else None)
    # forgetting
    q["forget_manifest"] = (_forgotten, f"WITH {GONE} SELECT * FROM gone")
    q["forget_scrub"] = (
        _scrubbed,
        f"WITH {GONE} " + " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS kept, 0::BIGINT AS remaining FROM {name} WHERE " + " AND ".join(f"NOT coalesce({column} IN {_gone(kind)}, false)" for column, kind in columns) for name, columns in forget.OWNED.items()),
    )
    # pages and changes
    tree = "sub AS (SELECT DISTINCT 'R' || r_regionkey AS root, x FROM main.region r, LATERAL (SELECT 'R' || r.r_regionkey AS x UNION ALL SELECT subject_entity_id FROM relations p WHERE p.predicate = 'part_of' AND p.invalidated_at IS NULL AND p.valid_until IS NULL AND p.object_entity_id = 'R' || r.r_regionkey))"
    keyed = f"""{tree}, keys AS MATERIALIZED (
        SELECT 'page-N' || n_nationkey AS page, 'entity' AS kind, 'entity' AS key_kind, 'N' || n_nationkey AS key_value FROM main.nation UNION ALL SELECT 'page-N' || n_nationkey, 'entity', 'predicate', 'located_in' FROM main.nation
        UNION ALL SELECT 'page-N' || n_nationkey, 'predicate_beat', 'entity', 'C' || n_nationkey FROM main.nation UNION ALL SELECT 'page-N' || n_nationkey, 'predicate_beat', 'predicate', 'ordered' FROM main.nation
        UNION ALL SELECT 'page-' || root, 'entity_subtree', 'entity', x FROM sub UNION ALL SELECT 'page-R' || r_regionkey, 'doc_set', 'doc_source', ['text', 'chat', 'event_log', '1-URGENT', 'none'][r_regionkey + 1] FROM main.region)"""
    q["knowledge_rule_keys"] = (_keys, f"WITH {keyed} SELECT page || ':' || kind AS rule_id, page AS artifact_id, key_kind, key_value FROM keys")
    q["knowledge_routes"] = (
        _routes,
        f"""WITH {keyed}, moved AS MATERIALIZED (SELECT relation_id, subject_entity_id, object_entity_id, predicate FROM relations WHERE subject_entity_id = 'C7'),
        docs AS MATERIALIZED (SELECT doc_id FROM relation_evidence SEMI JOIN moved USING (relation_id) UNION SELECT doc_id FROM observation_evidence WHERE observation_id = 'E7' UNION SELECT doc_id FROM claims WHERE claim_id = 'L1-1' UNION SELECT 'D3'),
        has AS MATERIALIZED (SELECT 'entity' AS key_kind, subject_entity_id AS key_value FROM moved UNION SELECT 'entity', object_entity_id FROM moved UNION SELECT 'predicate', predicate FROM moved UNION SELECT 'entity', subject_entity_id FROM observations WHERE observation_id = 'E7'
          UNION SELECT 'entity', true_entity FROM mentions WHERE claim_id = 'L1-1' UNION SELECT 'doc_source', source_kind FROM documents SEMI JOIN docs USING (doc_id))
        SELECT DISTINCT page AS artifact_id, 'key' AS reason FROM keys SEMI JOIN has USING (key_kind, key_value) UNION SELECT artifact_id, 'citation' FROM knowledge_artifact_evidence WHERE doc_id = 'D3' OR relation_id IN (SELECT relation_id FROM moved) UNION SELECT 'page-N22', 'scope' UNION SELECT 'page-N21', 'manual'""",
    )
    q["knowledge_stale"] = (
        _stale,
        f"""WITH {tree}, moved AS MATERIALIZED (SELECT * FROM relations WHERE subject_entity_id = 'C7')
        SELECT DISTINCT 'page-' || root AS artifact_id FROM sub, moved WHERE x IN (subject_entity_id, object_entity_id) UNION SELECT 'page-' || object_entity_id FROM moved WHERE predicate = 'located_in' UNION SELECT 'page-N7' FROM moved WHERE predicate = 'ordered'""",
    )
    # merges
    live = "live AS MATERIALIZED (SELECT mention_id, arg_max({d: decision_id, e: entity_id, m: method}, {t: decided_at, d: decision_id}) AS x FROM resolution_decisions WHERE superseded_by IS NULL GROUP BY 1)"
    piece = f"""{live}, pieces AS MATERIALIZED (SELECT normalized_name AS piece, e.entity_id, e.created_at, count(l.mention_id) + any_value(e.graph_degree) AS weight FROM entities e LEFT JOIN live l ON l.x.e = e.entity_id WHERE type = 'product' GROUP BY 1, 2, 3),
        offered AS MATERIALIZED (SELECT first_value(entity_id) OVER w AS survivor_id, entity_id AS absorbed_id, CAST(sum(weight) OVER (PARTITION BY piece) AS BIGINT) AS blast_radius FROM pieces WINDOW w AS (PARTITION BY piece ORDER BY created_at, entity_id))"""
    q["merge_proposals"] = (lambda v: merges.proposals(_pieces(v)), f"WITH {piece} SELECT *, CASE WHEN blast_radius > 100 THEN 'review' ELSE 'merge' END AS route FROM offered WHERE survivor_id <> absorbed_id")
    q["merge_snapshot"] = (
        lambda v: (lambda made: made[2].join(made[1].select("merge_id", "survivor_id", "absorbed_id"), "merge_id").drop("merge_id"))(_merged(v)),
        f"WITH {piece}, made AS (SELECT o.* FROM offered o JOIN entities e ON e.entity_id = o.absorbed_id AND e.status = 'active' WHERE survivor_id <> absorbed_id AND blast_radius <= 2000) SELECT l.x.e AS entity_id, l.mention_id, survivor_id, absorbed_id FROM made JOIN live l ON l.x.e IN (survivor_id, absorbed_id)",
    )
    q["merges_disagreeing"] = (
        lambda v: merges.disagreeing(_pieces(v), v.spine["merge_events"].withColumn("unmerge_of", F.lit(None).cast("string"))),
        "SELECT merge_id, absorbed_id FROM merge_events m JOIN entities e ON e.entity_id = absorbed_id AND e.type = 'product' AND e.merged_into IS NOT NULL WHERE reversed_by IS NULL AND NOT EXISTS (SELECT 1 FROM entities s WHERE s.entity_id = e.merged_into AND s.type = 'product' AND s.normalized_name = e.normalized_name)",
    )
    q["unmerge_decisions"] = (
        _unmerged,
        f"WITH {live} SELECT mention_id, CASE WHEN m.reversed_by IS NOT NULL THEN m.survivor_id ELSE l.x.e END AS entity_id, CASE WHEN m.merge_id IS NOT NULL AND m.reversed_by IS NULL THEN 'human' ELSE l.x.m END AS method FROM live l LEFT JOIN merge_events m ON m.absorbed_id = l.x.e",
    )
    # vectors by index
    q["ann_topk"] = (_ann_topk, None)
    # claims from text
    q["grounding_gate"] = (
        lambda v: claims.grounding_gate(*_claim_parts(v)).withColumn("failed_tokens", F.array_join("failed_tokens", " ")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_until")}),
        f"WITH {CLAIM_PARTS}, {JUDGED} SELECT candidate_id, chunk_id, doc_id, claim_text, gate, CASE WHEN gate IS NULL THEN a END AS char_start, CASE WHEN gate IS NULL THEN z END AS char_end, CASE WHEN gate IS NULL THEN coalesce(flagged, false) END AS kept_flagged, CASE WHEN gate = 'added_context_unverified' THEN added END AS failed_text, "
        "CASE WHEN gate = 'added_context_unverified' THEN array_to_string(failed, ' ') END AS failed_tokens, CASE WHEN gate IS NULL THEN CASE k % 6 WHEN 1 THEN TIMESTAMP '2020-01-01' WHEN 3 THEN TIMESTAMP '2020-01-01 08:00:00' WHEN 4 THEN TIMESTAMP '2020-01-01' END END AS valid_from, "
        "CASE WHEN gate IS NULL THEN CASE k % 6 WHEN 1 THEN TIMESTAMP '2020-02-01' WHEN 3 THEN TIMESTAMP '2020-01-01 08:00:00' END END AS valid_until, CASE WHEN gate IS NULL THEN CASE k % 6 WHEN 1 THEN 'day' WHEN 3 THEN 'instant' WHEN 4 THEN 'open' ELSE 'unknown' END END AS precision FROM judged",
    )
    q["claims_omitted"] = (
        lambda v: claims.omitted(*_claim_parts(v)),
        f"WITH {CLAIM_PARTS}, said_at AS MATERIALIZED (SELECT c.chunk_id, strpos(text, c.span) AS a, strpos(text, c.span) + length(c.span) AS z FROM candidates c JOIN chunks_of x USING (chunk_id) WHERE strpos(text, c.span) > 0), spot AS (SELECT DISTINCT r.chunk_id, r.span, strpos(text, r.span) AS a, strpos(text, r.span) + length(r.span) AS z FROM retained r JOIN chunks_of x USING (chunk_id)) "
        "SELECT chunk_id, span FROM spot s WHERE s.a = 0 OR NOT EXISTS (SELECT 1 FROM said_at t WHERE t.chunk_id = s.chunk_id AND t.a < s.z AND s.a < t.z)",
    )
    # sections
    q["section_skeletons"] = (lambda v: sections.heading_sections(*_line_blocks(v)), f"WITH {SKELETON} SELECT * FROM tree")
    q["skeleton_hashes"] = (
        lambda v: sections.skeleton_hash(sections.heading_sections(*_line_blocks(v))),
        f"WITH {SKELETON} SELECT doc_id, sha256(to_json(list({{block_end: block_end, block_start: block_start, char_end: char_end, char_start: char_start, heading_level: heading_level, node_path: node_path, normalized_title: normalized_title, parent_path: parent_path, title: title}} ORDER BY ordinal))) AS skeleton_hash FROM tree GROUP BY 1",
    )
    q["skeleton_statistics"] = (lambda v: _rounded(_statistics(v), *RATIOS), f"WITH {SKELETON}, {STATISTICS}")
    q["sections_snapped"] = (lambda v: sections.snap_sections(_proposals(v), *_line_blocks(v)), None)
    q["sections_by_anchor"] = (lambda v: sections.fallback_sections(_anchors(v), *_line_blocks(v)), None)
    # documents
    q["document_blocks"] = (lambda v: documents.document_blocks(v.raw("documents")), None)
    q["document_chunks"] = (lambda v: documents.document_chunks(v.raw("documents")), None)
    q["pages_markdown"] = (lambda v: documents.pages_markdown(v.raw("pages")), None)
    body = "trim(regexp_replace(regexp_replace(text, chr(13) || chr(10), chr(10), 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
    q["embedding_input"] = (
        lambda v: v.raw("documents").select("doc_id", documents.embedding_input(F.col("text"), F.concat(F.lit("source: "), "source", F.lit("; language: "), "lang"), F.col("source"), F.lit(1), F.lit("")).alias("embedding_text")).withColumn("embedding_text_hash", F.sha2("embedding_text", 256)),
        f"SELECT doc_id, t AS embedding_text, sha256(t) AS embedding_text_hash FROM (SELECT doc_id, CASE WHEN b = '' THEN NULL WHEN length(b) > 48 THEN CASE WHEN length('source: ' || source || '; language: ' || lang) >= length(b) THEN source ELSE 'source: ' || source || '; language: ' || lang END || chr(10) || chr(10) || b ELSE b END AS t FROM (SELECT *, {body} AS b FROM main.documents))",
    )
    slug = lambda x: f"CASE WHEN trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'untitled' ELSE substr(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) END"
    tree = f"s0 AS (SELECT doc_id, 'documents/' || {slug('source_kind')} AS shard, {slug('coalesce(title, doc_id)')} AS name, true AS split FROM v_documents_live)"
    for i in range(1, 5):
        letter = f"CASE WHEN regexp_matches(substr(name, {i}, 1), '[a-z0-9]') THEN substr(name, {i}, 1) ELSE 'other' END"
        tree += f", l{i} AS (SELECT *, {letter} AS c FROM s{i - 1}), s{i} AS (SELECT doc_id, CASE WHEN split AND n > 150 AND k > 1 THEN shard || '/' || c ELSE shard END AS shard, name, split AND n > 150 AND k > 1 AS split FROM l{i} LEFT JOIN (SELECT shard, count(*) AS n, count(DISTINCT c) AS k FROM l{i} WHERE split GROUP BY 1) USING (shard))"
    q["corpus_paths"] = (lambda v: corpusfs.document_paths(v), f"WITH {tree} SELECT doc_id, shard || '/' || name || '-' || {slug('doc_id')} || '.md' AS path FROM s4")
    projections = {
        "entity": "SELECT entity_id AS id, type, canonical_name AS name, normalized_name, profile_summary AS summary, created_at FROM entities WHERE status = 'active'",
        "document": "SELECT doc_id AS id, title, source_uri, published_at FROM v_documents_live",
        "relates": "SELECT s.survivor_entity_id AS from, o.survivor_entity_id AS to, relation_id, predicate, fact_label AS fact, evidence_count, contradict_count, confidence, contradiction_group, valid_from, valid_until, ingested_at, invalidated_at FROM relations r JOIN v_survivors s ON s.entity_id = r.subject_entity_id JOIN v_survivors o ON o.entity_id = r.object_entity_id",
        "mentioned_in": "SELECT survivor_entity_id AS from, doc_id AS to, count(*) AS mention_count, min(created_at) AS first_seen FROM v_mention_current_content WHERE survivor_entity_id IS NOT NULL GROUP BY 1, 2",
        "doc_crossref": "SELECT from_doc_id AS from, to_doc_id AS to, kind, context FROM document_crossrefs WHERE resolved",
        "is_document": "SELECT s.survivor_entity_id AS from, d.doc_id AS to FROM documents d JOIN v_survivors s ON s.entity_id = d.document_entity_id",
    }
    for name, sql in projections.items():
        q[f"projection_{name}"] = ((lambda v, n=name: sinks.graph_table(v, n)), sql.replace(" AS from", ' AS "from"').replace(" AS to", ' AS "to"'))
    # identity
    surfaces = ["hot gear", "cold bolt", "customer#000000007"]
    grams = lambda x: f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    q["block_trigram"] = (
        lambda v: identity.blocked_candidates(v, surfaces),
        f"""WITH q AS (SELECT s AS surface, {grams('s')} AS g FROM (SELECT unnest({surfaces}) AS s)), a AS (SELECT a.entity_id, {grams('a.normalized_lemma')} AS g FROM aliases a JOIN entities e USING (entity_id) WHERE e.status = 'active'),
        m AS (SELECT surface, entity_id, max(len(list_intersect(q.g, a.g)) / (len(q.g) + len(a.g) - len(list_intersect(q.g, a.g)))) AS s FROM q, a GROUP BY 1, 2)
        SELECT surface, entity_id, round(s, 6) AS similarity, CAST(row_number() OVER w AS INTEGER) AS place FROM m WHERE s >= 0.3 WINDOW w AS (PARTITION BY surface ORDER BY s DESC, entity_id) QUALIFY row_number() OVER w <= 10""",
    )

    def banded(v: Views) -> DataFrame:
        rows = v.spark_vectors
        left = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("mention_id"), F.col("embedding").alias("a"), "label")
        right = rows.where("vec_id % 100 <> 0").select(F.col("vec_id").alias("entity_id"), F.col("embedding").alias("b"), "label")
        return _rounded(identity.decision_bands(left.join(right, "label")).drop("a", "b", "label"), "cosine")

    cosine = "list_cosine_similarity(CAST(m.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"
    q["resolve_bands"] = (
        banded,
        f"""WITH p AS (SELECT m.vec_id AS mention_id, e.vec_id AS entity_id, {cosine} AS c FROM main.embeddings m JOIN main.embeddings e ON m.label = e.label AND m.vec_id % 100 = 0 AND e.vec_id % 100 <> 0), b AS (SELECT *, CASE WHEN c >= 0.88 THEN 'accept' WHEN c <= 0.60 THEN 'reject' ELSE 'adjudicate' END AS band FROM p)
        SELECT mention_id, entity_id, round(c, 6) AS cosine, CASE WHEN band = 'adjudicate' AND sum((band = 'adjudicate')::INT) OVER (PARTITION BY mention_id ORDER BY c DESC, entity_id ROWS UNBOUNDED PRECEDING) > 3 THEN 'defer' ELSE band END AS band FROM b""",
    )
    # adjudication

    def incoming(v: Views) -> DataFrame:
        """Each order's lines as testimony that its customer ordered its part, a year after the last closing."""
        lines = v.spine["line_items"]
        orders = v.raw("orders").select("o_orderkey", "o_custkey")
        return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
            F.concat(F.lit("C"), "o_custkey").alias("subject_entity_id"), F.lit("ordered").alias("predicate"), F.concat(F.lit("P"), "l_partkey").alias("object_entity_id"), F.concat_ws("-", F.lit("new"), "l_orderkey", "l_linenumber").alias("claim_id"), F.concat(F.lit("O"), "l_orderkey").alias("doc_id")
        )

    into = f"""WITH i AS (SELECT 'C' || o_custkey AS s, 'P' || l_partkey AS o, 'new-' || l_orderkey || '-' || l_linenumber AS claim_id, 'O' || l_orderkey AS doc_id FROM line_items JOIN main.orders ON o_orderkey = l_orderkey),
        k AS (SELECT subject_entity_id AS s, object_entity_id AS o, min(relation_id) FILTER (WHERE valid_until IS NULL OR valid_until > {until}) AS open_id, max(valid_until) AS closed_at FROM relations WHERE predicate = 'ordered' AND {believed} GROUP BY 1, 2),
        p AS (SELECT i.*, k.open_id, k.closed_at FROM i LEFT JOIN k USING (s, o))"""
    q["spells_new"] = (lambda v: adjudication.upsert_relations(v, incoming(v), SINCE)[0].drop("relation_id"), f"{into} SELECT DISTINCT s AS subject_entity_id, 'ordered' AS predicate, o AS object_entity_id, closed_at AS valid_from FROM p WHERE open_id IS NULL")
    q["spells_evidence"] = (
        lambda v: adjudication.upsert_relations(v, incoming(v), SINCE)[1].select(F.when(F.col("relation_id").contains(":"), F.col("relation_id")).alias("open_relation_id"), "claim_id", "doc_id", "stance"),
        f"{into} SELECT open_id AS open_relation_id, claim_id, doc_id, 'supports' AS stance FROM p",
    )
    q["observation_fold"] = (
        lambda v: adjudication.fold_observations(v.spine["observations"].select(F.col("subject_entity_id").alias("entity_id"), "statement", F.col("ingested_at").alias("asserted_at"), F.col("observation_id").alias("claim_id"))),
        "SELECT subject_entity_id AS entity_id, first(observation_id ORDER BY ingested_at, observation_id) AS observation_id, statement, min(ingested_at) AS valid_from, NULL::TIMESTAMP AS valid_until, count(*) AS evidence_count FROM observations GROUP BY 1, 3",
    )
    told = """t AS (SELECT concat('U', user_id) AS entity_id, CASE WHEN value > 5 THEN 'large' ELSE 'small' END AS slot, event_type AS statement, CASE WHEN event_id % 50 <> 0 THEN ts END AS asserted_at, concat('Q', event_id) AS claim_id FROM main.events),
        l AS (SELECT *, lag(statement) OVER w IS DISTINCT FROM statement AS begins FROM t WINDOW w AS (PARTITION BY entity_id, slot ORDER BY asserted_at NULLS LAST, claim_id)),
        r AS (SELECT *, sum(begins::INT) OVER (PARTITION BY entity_id, slot ORDER BY asserted_at NULLS LAST, claim_id) AS run FROM l),
        h AS (SELECT entity_id, slot, run, claim_id AS observation_id, statement, asserted_at AS valid_from, lead(coalesce(asserted_at, TIMESTAMP '2024-01-15')) OVER (PARTITION BY entity_id, slot ORDER BY run) AS valid_until FROM r WHERE begins)"""
    moment = lambda: F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")  # noqa: E731, no session is needed to list queries
    q["observation_replay"] = (lambda v: replay.observations(replay.replay(_told(v), moment(), 7)), f"WITH {told} SELECT h.* EXCLUDE (run), count(*) AS evidence_count FROM h JOIN r USING (entity_id, slot, run) GROUP BY ALL")
    q["observation_resplit"] = (
        lambda v: replay.resplit_state(cut(replay.replay(_told(v).where(_on_time), moment(), 7)), _told(v).where(f"NOT {_on_time}"), moment(), 7),
        f"WITH {told} SELECT h.* EXCLUDE (run), r.claim_id, r.asserted_at FROM h JOIN r USING (entity_id, slot, run)",
    )
    # search

    near = "near AS MATERIALIZED (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM main.embeddings WHERE vec_id = 0)) AS score FROM main.embeddings WHERE embedding IS NOT NULL)"
    six = lambda rows: rows.withColumn("score", F.round("score", 6))
    scope = (PERSON, "P7", "S3")
    scoped = f"covered AS (SELECT claim_id, count(DISTINCT resolved_entity_id) AS coverage FROM v_mentions_live WHERE resolved_entity_id IN {scope} AND claim_id IS NOT NULL GROUP BY 1)"
    q["search_claims"] = (
        lambda v: six(search.search_claims(v, 30, query_vector(v))),
        f"WITH {near}, live AS MATERIALIZED (SELECT claim_id, claim_text, doc_id, source_handle FROM v_claims_live) SELECT claim_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, claim_id) AS rank, claim_text, doc_id, source_handle FROM claim_search JOIN near USING (vec_id) JOIN live USING (claim_id) QUALIFY rank <= 30",
    )
    q["search_facts"] = (
        lambda v: six(search.search_facts(v, query_vector(v), 30)),
        f"WITH {near}, live AS MATERIALIZED (SELECT fact_kind, fact_id FROM v_facts_current) SELECT fact_kind, fact_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, fact_kind, fact_id) AS rank FROM fact_search JOIN near USING (vec_id) JOIN live USING (fact_kind, fact_id) QUALIFY rank <= 30",
    )
    q["search_entities"] = (
        lambda v: six(search.search_entities(v, query_vector(v), 20, "person")),
        f"WITH {near}, live AS MATERIALIZED (SELECT entity_id FROM v_entities_current WHERE entity_type = 'person') SELECT entity_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, entity_id) AS rank FROM entity_search JOIN near USING (vec_id) JOIN live USING (entity_id) QUALIFY rank <= 20",
    )
    q["nominate_testimony"] = (
        lambda v: six(search.nominate(v, "claim", query_vector(v), 30, v.claims_live, scope)),
        f"WITH {near}, {scoped}, live AS MATERIALIZED (SELECT claim_id FROM v_claims_live) SELECT claim_id, coverage, round(score, 6) AS score, row_number() OVER (ORDER BY coverage DESC, score DESC, claim_id) AS rank FROM claim_search JOIN near USING (vec_id) JOIN covered USING (claim_id) JOIN live USING (claim_id) QUALIFY rank <= 30",
    )
    q["fact_context"] = (
        lambda v: search.fact_context(v, query_vector(v), temporal.fact_time("current", v.now), 15, scope).select("fact_kind", "fact_id", "rank", "coverage"),
        f"""WITH {near}, shown AS MATERIALIZED (SELECT * FROM v_facts_current), n AS (SELECT fact_kind, fact_id, row_number() OVER (ORDER BY score DESC, fact_kind, fact_id) AS rank FROM fact_search JOIN near USING (vec_id) SEMI JOIN shown USING (fact_kind, fact_id) QUALIFY rank <= 200)
        SELECT fact_kind, fact_id, rank, (subject_entity_id IN {scope})::INT + (object_entity_id IS NOT NULL AND object_entity_id <> subject_entity_id AND object_entity_id IN {scope})::INT AS coverage FROM n JOIN shown USING (fact_kind, fact_id) ORDER BY coverage DESC, rank, fact_kind, fact_id LIMIT 15""",
    )
    q["claim_vectors"] = (lambda v: search.vectors_of(v, "claim", ["L1-1", "B3", "gone"]).select("claim_id", F.size("embedding").cast("long").alias("width")), "SELECT claim_id, len(embedding) AS width FROM claim_search JOIN main.embeddings USING (vec_id) WHERE claim_id IN ('L1-1', 'B3', 'gone')")
    q["entity_vectors"] = (lambda v: search.vectors_of(v, "entity", ["C7", "N3", "gone"]).select("entity_id", F.size("embedding").cast("long").alias("width")), "SELECT entity_id, len(embedding) AS width FROM entity_search JOIN main.embeddings USING (vec_id) WHERE entity_id IN ('C7', 'N3', 'gone')")
    q["embedding_reuse"] = (
        lambda v: search.reusable_embeddings(v.spine["chunks"], v.spine["chunk_search"], "model-64", "policy-1").select("chunk_id", F.size("embedding").cast("long").alias("width")),
        "SELECT c.chunk_id, len(s.embedding) AS width FROM chunks c JOIN chunk_search s USING (embedding_text_hash) WHERE s.embedding IS NOT NULL AND s.embedding_model = 'model-64' AND s.embedding_input_policy_version = 'policy-1'",
    )
    q["rerank_bounded"] = (
        lambda v: six(search.rerank_bounded(v, ["L1-1", "L1-2", "B3", "B4", "B5"], query_vector(v), 4)),
        f"WITH {near} SELECT claim_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, claim_id) AS rank FROM claim_search JOIN near USING (vec_id) WHERE claim_id IN ('L1-1', 'L1-2', 'B3', 'B4', 'B5') QUALIFY rank <= 4",
    )
    q["hydrate_relation"] = (
        lambda v: search.hydrate_relation(v, "located_in:C7:N" + str(_nation(v))),
        "SELECT f.fact_id, f.predicate, f.valid_from, f.valid_until, e.claim_id, e.stance, e.doc_id, e.asserted_at, d.title, d.source_kind FROM v_facts_visible_history f LEFT JOIN v_fact_claim_evidence_live e ON e.fact_kind = 'relation' AND e.fact_id = f.fact_id LEFT JOIN v_documents_live d ON d.doc_id = e.doc_id WHERE f.fact_kind = 'relation' AND f.fact_id LIKE 'located_in:C7:%'",
    )
    q["currency_reextracted"] = (
        lambda v: search.reextracted(v, "x2"),
        "WITH live AS MATERIALIZED (SELECT chunk_id FROM v_chunks_live), c AS MATERIALIZED (SELECT claim_id, chunk_id, doc_id, extractor_version FROM claims WHERE is_current_testimony), carried AS MATERIALIZED (SELECT DISTINCT k.claim_id FROM chunk_claims k SEMI JOIN live USING (chunk_id) SEMI JOIN (SELECT claim_id FROM c WHERE extractor_version = 'x2') x USING (claim_id)) SELECT claim_id, doc_id, extractor_version FROM c SEMI JOIN live USING (chunk_id) ANTI JOIN carried USING (claim_id) WHERE extractor_version <> 'x2'",
    )
    q["removal_cascade"] = (
        lambda v: search.removal_cascade(v, "O3"),
        "WITH t AS MATERIALIZED (SELECT e.relation_id, e.doc_id FROM relation_evidence e SEMI JOIN (SELECT claim_id FROM claims WHERE is_current_testimony) c USING (claim_id) WHERE stance = 'supports') SELECT t.relation_id, count(DISTINCT t.doc_id) FILTER (WHERE t.doc_id <> 'O3') AS supports, count(DISTINCT t.doc_id) FILTER (WHERE t.doc_id <> 'O3') = 0 AND coalesce(bool_or(r.invalidated_at IS NULL AND r.valid_until IS NULL), false) AS closes FROM t JOIN relations r USING (relation_id) WHERE relation_id IN (SELECT relation_id FROM t WHERE doc_id = 'O3') GROUP BY 1",
    )
    q["resolution_scores"] = (
        lambda v: search.evaluate_resolution(v.spine["resolution_decisions"].where("superseded_by IS NULL AND method = 'T0'").select("mention_id", "entity_id"), v.spine["mentions"].select("mention_id", "true_entity", F.col("emitted_type").alias("entity_type"))),
        "WITH d AS (SELECT mention_id, entity_id FROM resolution_decisions WHERE superseded_by IS NULL AND method = 'T0') SELECT emitted_type AS entity_type, count(entity_id) AS decided, count(*) FILTER (WHERE entity_id = true_entity) AS right, round(count(*) FILTER (WHERE entity_id = true_entity) / nullif(count(entity_id), 0), 6) AS precision, round(count(*) FILTER (WHERE entity_id = true_entity) / count(*), 6) AS recall FROM mentions LEFT JOIN d USING (mention_id) GROUP BY 1",
    )
    # work ledger

    dead = lambda v: v.spine["processing_state"].where("status = 'dead'").select("processing_id")
    q["work_due"] = (lambda v: ledger.due(v.spine["processing_state"], moment(), lane="steady", k=25).select("processing_id", "stage", "not_before"), f"SELECT processing_id, stage, not_before FROM processing_state WHERE status = 'pending' AND not_before <= {view_sql.NOW} AND lane = 'steady' ORDER BY not_before, enqueued_at, processing_id LIMIT 25")
    q["work_enqueue"] = (
        lambda v: ledger.enqueue(v.spine["processing_state"].where("status = 'done'"), v.spine["processing_state"]).select("processing_id", "target_id", "stage", "component_version"),
        "SELECT processing_id, target_id, stage, component_version FROM processing_state w ANTI JOIN (SELECT target_id, stage, component_version FROM processing_state WHERE status = 'done') d USING (target_id, stage, component_version) QUALIFY row_number() OVER (PARTITION BY target_id, stage, component_version ORDER BY processing_id) = 1",
    )
    q["work_fail"] = (
        lambda v: ledger.fail(v.spine["processing_state"], v.spine["processing_state"].where("status = 'pending'").select("processing_id", F.lit("lost").alias("error"), (F.col("component_version") == "v0").alias("retryable")), moment()).select("processing_id", "status", "not_before", "attempts", "last_error"),
        f"SELECT processing_id, CASE WHEN status <> 'pending' THEN status WHEN component_version <> 'v0' OR attempts + 1 >= 4 THEN 'dead' ELSE 'pending' END AS status, CASE WHEN status = 'pending' AND component_version = 'v0' AND attempts + 1 < 4 THEN {view_sql.NOW} + to_seconds(CAST(60 * pow(2, attempts) AS BIGINT)) ELSE not_before END AS not_before, CASE WHEN status = 'pending' THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN status = 'pending' THEN 'lost' ELSE last_error END AS last_error FROM processing_state",
    )
    q["work_replay"] = (
        lambda v: ledger.replay(v.spine["processing_state"], dead(v), moment()).select("processing_id", "status", "not_before", "attempts"),
        f"SELECT processing_id, CASE WHEN status = 'dead' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'dead' THEN {view_sql.NOW} ELSE not_before END AS not_before, CASE WHEN status = 'dead' THEN 3 ELSE attempts END AS attempts FROM processing_state",
    )
    q["work_complete"] = (
        lambda v: ledger.complete(v.spine["processing_state"], dead(v)).groupBy("status").agg(F.count("*").alias("units")),
        "SELECT CASE WHEN status = 'dead' THEN 'done' ELSE status END AS status, count(*) AS units FROM processing_state GROUP BY 1",
    )
    q["work_backfill"] = (
        lambda v: ledger.backfill(v.spine["processing_state"], "click", "v2", moment()).select("processing_id", "target_id"),
        "SELECT 'fill:click:v2:' || target_id AS processing_id, target_id FROM (SELECT DISTINCT target_id FROM processing_state WHERE stage = 'click' EXCEPT SELECT target_id FROM processing_state WHERE stage = 'click' AND component_version = 'v2')",
    )
    q["work_readiness"] = (
        lambda v: ledger.readiness(v.spine["processing_state"], ("click", "view")),
        "SELECT *, click > 0 AND view > 0 AND open_units = 0 AND dead_units = 0 AS ready FROM (SELECT target_id, count(*) FILTER (WHERE stage = 'click' AND status = 'done') AS click, count(*) FILTER (WHERE stage = 'view' AND status = 'done') AS view, count(*) FILTER (WHERE status = 'pending') AS open_units, count(*) FILTER (WHERE status = 'dead') AS dead_units FROM processing_state GROUP BY 1)",
    )
    q["merge_pieces"] = (lambda v: identity.merge_blocks(v.spark_vectors, "label", "vec_id", "embedding", 0.8), None)
    return q


def queries() -> dict[str, Query]:
    return {name: (lambda spark, sf_dir, f=f: f(views(spark, sf_dir))) for name, (f, _) in catalog().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql if sql.startswith("WITH RECURSIVE raw_") else view_sql.oracle(sql) for name, (_, sql) in catalog().items() if sql}
