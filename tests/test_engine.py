"""The reference operators against their SQL in DuckDB, and what SQL cannot express against brute force."""

import json
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.engine import Engine
from factloom.functions import checkpoint
from factloom.operators import adjudication, documents, facts, graph, identity, retrieval
from factloom.plans import nominations
from factloom.plans import gate, registry
from factloom.plans.views import Views
from factloom.sources import sinks, spine
from factloom.sources.spine import Spine
from factloom.streaming import ingest

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def canonical(df):
    def text(x):
        if isinstance(x, (list, np.ndarray)):
            return str(list(x))
        return "null" if pd.isna(x) else f"{x:.8g}" if isinstance(x, (float, np.floating)) else str(x)

    df = df[sorted(df.columns)].map(text)
    return sorted(map(tuple, df.itertuples(index=False)))


CHOSEN = "facts_current survivor_map entities_current identity_events_visible evidence_lineage pages_live changes_visible facts_as_of facts_overlap lookup_relations agg_timeline agg_delta_top_entities agg_typed_absence delta_page2 recount_relations currency_regained zero_support supersede_windows bm25_topk chunk_neighbors currency_stale hybrid_rrf rerank_weighted confirm_nominations resolve graph_neighborhood graph_path neighborhood_2hop block_trigram resolve_bands embedding_input example_explain example_claims_as_of corpus_paths projection_relates search_claims search_facts search_entities nominate_testimony fact_context hydrate_relation currency_reextracted removal_cascade resolution_scores work_due work_enqueue work_fail work_replay work_complete work_backfill work_readiness spells_new spells_evidence observation_fold".split()


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SMALL).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# positive and negative rows of views


def test_visibility(spark):
    v = registry.views(spark, SMALL)
    live = {r["doc_id"] for r in v.documents_live.select("doc_id").collect()}
    assert "O1" in live and "O20" not in live  # deleted lineages are gone
    merged = v.spine["entities"].where("status = 'merged'").select("entity_id")
    assert v.entities_current.join(merged, "entity_id").isEmpty()
    assert v.facts_visible_history.where("invalidated_at IS NOT NULL").count() > 0 and v.facts_current.join(v.facts_visible_history.where("invalidated_at IS NOT NULL"), ["fact_kind", "fact_id"]).isEmpty()
    assert v.page_evidence_visible.join(v.pages_live, "artifact_id", "left_anti").isEmpty()
    circle = v.spine["entities"].where("entity_id IN ('P1', 'P2')").select("entity_id")
    assert v.survivors.join(circle, "entity_id").isEmpty()  # chains in circles have no survivor


def stored_tables(spark):
    found = os.path.join(checkpoint.shared_dir(spark), "factloom-tables")
    return set(os.listdir(found)) if os.path.isdir(found) else set()


def test_only_tables_that_move_rows_are_stored(spark):
    tables = Spine(spark, SMALL)
    for name in ("line_items", "documents"):
        tables[name].count()
    before = stored_tables(spark)
    for name in ("chunks", "document_versions", "document_representations"):
        assert tables[name].count() > 0
    assert stored_tables(spark) == before
    tables["claims"].count()
    assert len(stored_tables(spark) - before) == 1


@pytest.fixture(scope="module")
def odd_dir(tmp_path_factory):
    """The small tables with lines of no order or part, repeated parts, parts without a name or brand, and users unknown."""
    out = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE TABLE {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    c.execute("UPDATE lineitem SET l_partkey = NULL WHERE l_orderkey % 50 = 1; UPDATE lineitem SET l_orderkey = 9000000 + l_orderkey WHERE l_orderkey % 50 = 2; UPDATE lineitem SET l_returnflag = NULL, l_linestatus = NULL WHERE l_orderkey % 50 = 3")
    c.execute("INSERT INTO part SELECT * FROM part WHERE p_partkey % 40 = 1; UPDATE part SET p_name = NULL WHERE p_partkey % 40 = 2; UPDATE part SET p_brand = NULL WHERE p_partkey % 40 = 3")
    c.execute("UPDATE orders SET o_custkey = NULL WHERE o_orderkey % 60 = 1; UPDATE lineitem SET l_shipdate = NULL WHERE l_orderkey % 50 = 4; DELETE FROM supplier WHERE s_suppkey % 10 = 1; UPDATE events SET user_id = NULL WHERE event_id % 90 = 1")
    for t in TABLES:
        c.execute(f"COPY {t} TO '{out}/{t}.parquet'")
    return str(out)


@pytest.mark.parametrize("odd", [False, True])
def test_tables_from_parts_equal_their_sql(spark, odd_dir, odd, monkeypatch):
    folder = odd_dir if odd else SMALL
    tables, plain, names = Spine(spark, folder), Spine(spark, folder), list(spine.FROM_PARTS)
    got = {name: tables[name] for name in names}
    monkeypatch.setattr(spine, "FROM_PARTS", {})
    for name in names:
        want = plain[name]
        assert got[name].dtypes == want.dtypes
        assert not want.isEmpty() and canonical(got[name].toPandas()) == canonical(want.toPandas()), name


def test_rows_are_numbered_in_ranges(spark):
    keys = [(k,) for k in random.Random(5).choices(range(900), k=2_000)] + [(None,)]
    ranked = spine.numbered(spark.createDataFrame(keys, "k long"), "k")
    rows = sorted(ranked.select("rank", "k").collect())
    assert [r[0] for r in rows] == list(range(1, len(keys) + 1))
    assert [r[1] for r in rows] == sorted((k for (k,) in keys), key=lambda k: (k is not None, k))
    tables = Spine(spark, SMALL)
    want = duckdb.sql(f"WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM '{SMALL}/documents.parquet'), v AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) AS r FROM '{SMALL}/embeddings.parquet') SELECT 'KD' || doc_id AS chunk_id, embedding[1] AS e, len(embedding) AS n FROM d LEFT JOIN v USING (r)").df()
    assert canonical(tables["chunk_search"].selectExpr("chunk_id", "embedding[0] AS e", "size(embedding) AS n").toPandas()) == canonical(want)
    before = stored_tables(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        reversed_keys = spine.numbered(spark.range(40_000).selectExpr("40000 - id AS k"), "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert reversed_keys.where("rank <> k").isEmpty()
    (new,) = stored_tables(spark) - before
    assert len([f for f in os.listdir(os.path.join(checkpoint.shared_dir(spark), "factloom-tables", new)) if f.endswith(".parquet")]) > 1  # several tasks


def test_relations_need_no_numbered_lines(spark):
    tables = Spine(spark, SMALL)
    before = stored_tables(spark)
    assert tables["relations"].count() > 0
    assert "line_items" not in tables.made and len(stored_tables(spark) - before) == 3  # spans, orderings, customers


@pytest.mark.parametrize("odd", [False, True])
def test_documents_are_dealt_once(spark, odd_dir, odd):
    v = Views(Spine(spark, odd_dir if odd else SMALL))
    decided = v._decisions.select("deployment_id", "mention_id", "entity_id")
    want = v.spine["mentions"].join(decided, ["deployment_id", "mention_id"]).select("deployment_id", "chunk_id", "doc_id", "created_at", "entity_id")
    assert not want.isEmpty() and canonical(v._decided.toPandas()) == canonical(want.toPandas())
    known, before = v._visible_versions.count() > 0, spark.conf.get(checkpoint.CO_PARTITION)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with checkpoint.joined_where_dealt(spark):
            plan = v._seen_claims._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert known and plan.count("Exchange hashpartitioning") == 3  # claims, chunks, versions
    assert spark.conf.get(checkpoint.CO_PARTITION) == before
    seen = v.claims_seen
    assert "claims_visible_history" not in v.__dict__ and canonical(seen.toPandas()) == canonical(v.claims_visible_history.select(*seen.columns).toPandas())


def test_decisions_move_as_numbers(spark):
    v = Views(Spine(spark, SMALL))
    plan = v._decided._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning", 1)
    assert "Exchange" not in below and "AS mention_id" in above and "AS mention_id" not in below


def test_a_table_of_the_graph_makes_no_other(spark):
    v = Views(Spine(spark, SMALL))
    before = stored_tables(spark)
    assert sinks.graph_table(v, "doc_crossref").count() > 0 and not sinks.graph_table(v, "entity").isEmpty()
    assert not {"mention_current_content", "claims_visible_history", "survivors"} & set(v.__dict__)
    assert not {"line_items", "relations"} & set(v.spine.made) and len(stored_tables(spark) - before) == 1  # entities


def test_facts_do_without_whole_mentions(spark):
    v = Views(Spine(spark, SMALL))
    assert not v.facts_current.isEmpty()
    assert "mention_current_content" not in v.__dict__


def test_whole_facts_are_not_dealt_again_for_reviews(spark):
    v = Views(Spine(spark, SMALL))
    v.facts_visible_history  # stores what facts stand on
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with checkpoint.joined_where_dealt(spark):
            plan = v._facts_visible_history._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning(fact_kind" not in plan
    waiting = v.spine["review_queue"].where("status IN ('pending', 'deferred')")
    withdrawn = v.facts_visible_history.where("support_state_current = 'withdrawn'").select("fact_id")
    known = waiting.selectExpr("get_json_object(candidate, '$.fact_id') AS fact_id").join(v.facts_visible_history.where("fact_kind = 'relation'"), "fact_id", "left_semi").distinct()
    assert not withdrawn.isEmpty() and canonical(withdrawn.toPandas()) == canonical(known.toPandas())


def test_facts_are_stored_once_and_need_no_counts_of_entities(spark):
    v = Views(Spine(spark, SMALL))
    v.facts_visible_history.count()
    before = stored_tables(spark)
    for view in (v.facts_current, v.graph_edges_visible_history, v.contradiction_members_current, v.fact_visible):
        assert "Exchange" not in view._jdf.queryExecution().executedPlan().toString()
    assert stored_tables(spark) == before and "entities_current" not in v.__dict__


# graph brute force


def small_edges(spark):
    rng = random.Random(4)
    rows = [(f"e{i}", f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", "p") for i in range(45)] + [("x1", "z1", "z2", "p"), ("x2", "z2", "z3", "p"), ("x3", "z3", "z1", "p")]
    return spark.createDataFrame(rows, "id string, source string, target string, predicate string"), rows


def test_components_and_cores(spark):
    edges, rows = small_edges(spark)
    near = {}
    for _, a, b, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return min(seen)

    assert {r["node"]: r["component"] for r in graph.weak_components(edges).collect()} == {x: reach(x) for x in near}
    alive, core, k = {x: near[x] - {x} for x in near if near[x] - {x}}, {}, 0
    while alive:
        low = min(alive, key=lambda x: len(alive[x]))
        k = max(k, len(alive[low]))
        core[low] = k
        for y in alive.pop(low):
            alive[y].discard(low)
    assert {r["node"]: r["core"] for r in graph.core_numbers(edges).collect()} == core


def test_communities_of_a_ring_of_cliques(spark):
    """Twelve cliques of four in a ring: each is a community, and no merge of neighbours adds modularity at the end."""
    links = [(f"{c:02}{i}", f"{c:02}{j}") for c in range(12) for i in range(4) for j in range(i)] + [(f"{c:02}0", f"{(c + 1) % 12:02}3") for c in range(12)]
    edges = spark.createDataFrame([(str(k), a, b, "p") for k, (a, b) in enumerate(links)], "id string, source string, target string, predicate string")
    got = {}
    for r in graph.communities(edges).collect():
        got.setdefault(r["community"], set()).add(r["node"])
    assert all(min(v) == c for c, v in got.items()) and sum(map(len, got.values())) == 48
    cliques = [{f"{c:02}{i}" for i in range(4)} for c in range(12)]
    assert all(any(q <= v for v in got.values()) for q in cliques)  # no clique is cut
    degree, m2 = {}, 2 * len(links)
    for a, b in links:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    of = {n: c for c, v in got.items() for n in v}
    score = sum(2 * (of[a] == of[b]) for a, b in links) / m2 - sum((sum(degree[n] for n in v) / m2) ** 2 for v in got.values())
    assert score >= 12 * (12 / m2 - (14 / m2) ** 2) - 1e-9  # at least that of the cliques alone


def test_communities_of_two_cliques(spark):
    rows = [(f"{g}{i}{j}", f"{g}{i}", f"{g}{j}", "p") for g in "ab" for i in range(6) for j in range(i)] + [("bridge", "a0", "b0", "p")]
    got = {r["node"]: r["community"] for r in graph.communities(spark.createDataFrame(rows, "id string, source string, target string, predicate string")).collect()}
    assert len({got[f"a{i}"] for i in range(6)}) == 1 and len({got[f"b{i}"] for i in range(6)}) == 1 and got["a0"] != got["b0"]


def test_clocks_come_in_pairs(spark):
    with pytest.raises(ValueError):
        graph.edges_of(registry.views(spark, SMALL), valid_at="1998-01-01")


# documents and identity

MARKDOWN = "# Title\n\nA para\nof two lines.\n\n- one\n  nested\n- two\n\n> quote\n> more\n\n```py\ncode\n\nmore\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nSetext\n------\nlast\n"


def test_blocks():
    blocks = documents.blockize(MARKDOWN)
    assert [b.type for b in blocks] == ["heading", "paragraph", "list_item", "list_item", "quote", "code", "table", "heading", "paragraph"]
    assert MARKDOWN[blocks[1].char_start : blocks[1].char_end] == "A para\nof two lines."
    assert [(p, t) for p, t, *_ in documents.sections(blocks)] == [("0", ""), ("0.0", "Title"), ("0.0.0", "Setext")]
    assert documents.block_hash("a  b\n c") == documents.block_hash("a b c")


def test_chunks_tile_blocks_within_budget():
    rng = random.Random(1)
    text = "\n\n".join(("# head" if rng.random() < 0.1 else " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 160)))) for _ in range(120))
    blocks = documents.blockize(text)
    chunks = documents.pack_chunks(text, blocks, documents.sections(blocks))
    spans = sorted((c[2], c[3]) for c in chunks)
    assert [i for a, b in spans for i in range(a, b + 1)] == list(range(len(blocks)))
    assert all(c[6] <= documents.TOKEN_BUDGET or c[2] == c[3] for c in chunks)
    edited = text.replace(text.split("\n\n")[3], "changed paragraph", 1)
    again = documents.blockize(edited)
    old, new = {c[7] for c in chunks}, {c[7] for c in documents.pack_chunks(edited, again, documents.sections(again))}
    assert len(old & new) >= 0.5 * len(old)


def test_html():
    assert documents.html_to_markdown("<html><head><title>x</title></head><h2>Hi</h2><p>a <b>b</b></p><ul><li>one</li></ul><script>no()</script>") == "## Hi\n\na b\n\n- one"


def test_lemma_and_merge():
    assert identity.lemma("  Éva\tNOVÁK ") == "eva novak"
    got = identity.merge_pieces(["c", "a", "b", "d"], [[0, 1], [1, 0], [1, 0.01], None], 0.15)
    assert got == [["a", "b"], ["c"], ["d"]]


def test_merge_pieces_takes_every_vector(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(900)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.queries()["merge_pieces"](spark, str(tmp_path)).collect()
    assert sorted(int(r["id"]) for r in got) == list(range(900))
    blocks = {(r["block"], r["piece"]): r["size"] for r in got}
    assert sum(blocks.values()) == 900 and len(blocks) < 900


def test_fusion_and_rerank(spark):
    a, b = (spark.createDataFrame(list(zip(ids, range(1, 9), strict=False)), "id string, rank int") for ids in ("xyz", "zxw"))
    got = [(r["id"], round(r["score"], 9)) for r in retrieval.reciprocal_rank_fusion([a, b], "id").collect()]
    assert got == [("x", round(1 / 61 + 1 / 62, 9)), ("z", round(1 / 63 + 1 / 61, 9)), ("y", round(1 / 62, 9)), ("w", round(1 / 63, 9))]
    with pytest.raises(ValueError):
        retrieval.reciprocal_rank_fusion([a], "id", k=0)


def test_observation_fold(spark):
    rows = [("u", "likes red tea", "2020-01-02", "c2"), ("u", "likes red tea", "2020-01-01", "c1"), ("u", "likes green tea", "2020-01-03", "c3"), ("u", "plays chess", "2020-01-04", "c4"), ("u", "likes red tea", None, "c5")]
    table = spark.createDataFrame(rows, "entity_id string, statement string, asserted_at string, claim_id string").withColumn("asserted_at", F.col("asserted_at").cast("timestamp_ntz"))
    got = {r["observation_id"]: r for r in adjudication.fold_observations(table).collect()}
    assert {k: r["evidence_count"] for k, r in got.items()} == {"c1": 3, "c3": 1, "c4": 1}
    got = {r["observation_id"]: r for r in adjudication.fold_observations(table, verdict=lambda old, new: "supersede").collect()}
    assert str(got["c1"]["valid_until"]) == "2020-01-03 00:00:00" and got["c5"]["evidence_count"] == 1  # the late one opens anew


def test_pull_back(spark):
    schema = "observation_id string, subject_entity_id string, statement string, valid_from string, valid_until string"
    held = spark.createDataFrame([("a", "u", "x", "2020-01-05", None), ("b", "u", "y", "2020-01-05", None), ("old", "u", "y", "2019-01-01", "2020-01-04")], schema)
    evidence = spark.createDataFrame([("a", "2020-01-01"), ("b", "2020-01-01"), ("old", "2019-06-01")], "observation_id string, asserted_at string")
    assert [tuple(r) for r in adjudication.pull_back(held, evidence).collect()] == [("a", "2020-01-01")]


# gate


@pytest.mark.parametrize("sql", ["DROP TABLE facts_current", "SELECT * FROM range(3)", "SELECT current_user()", "SELECT * FROM hidden", "SELECT * FROM facts_current TABLESAMPLE (5 ROWS)", "INSERT INTO facts_current VALUES (1)", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT * FROM parquet.`/etc`", "SELECT CAST(1 AS BINARY)", "SET a = 1", "WITH RECURSIVE r AS (SELECT 0 AS depth UNION ALL SELECT depth + 1 FROM r) SELECT * FROM r"])
def test_gate_refuses(spark, sql):
    with pytest.raises(gate.Refused):
        gate.validate(spark, sql)


@pytest.mark.parametrize(
    "sql",
    [
        "WITH RECURSIVE r AS (SELECT 0 AS depth UNION ALL SELECT depth + 1 FROM r) SELECT * FROM r /* depth < 3 */",
        "WITH RECURSIVE r AS (SELECT 0 AS depth UNION ALL SELECT depth + 1 FROM r) SELECT * FROM r WHERE 'depth < 3' = 'x'",
        "WITH RECURSIVE r AS (SELECT 0 AS depth UNION ALL SELECT depth + 1 FROM r WHERE depth < 3 OR true) SELECT * FROM r",
        "WITH RECURSIVE r AS (SELECT 0 AS depth UNION ALL SELECT depth + 1 FROM r WHERE depth < 9) SELECT * FROM r",
        "WITH RECURSIVE a AS (SELECT 0 AS depth UNION ALL SELECT depth + 1 FROM a WHERE depth < 3), b AS (SELECT 1 AS depth UNION ALL SELECT depth + 1 FROM b) SELECT * FROM b",
        "WITH RECURSIVE a AS (SELECT 0 AS depth UNION ALL SELECT depth FROM a WHERE depth < 3) SELECT * FROM a",
        "WITH RECURSIVE a AS (SELECT 1 AS depth UNION ALL SELECT depth + 1 FROM a WHERE depth < 3) SELECT * FROM a",
        "WITH RECURSIVE a AS (SELECT 0 AS depth UNION ALL SELECT x.depth + 1 FROM a x, a y WHERE x.depth < 3) SELECT * FROM a",
        "WITH RECURSIVE a AS (SELECT 0 AS depth, 1 AS n UNION ALL SELECT n, depth + 1 FROM a WHERE depth < 3) SELECT * FROM a",
        "WITH r AS (SELECT * FROM r) SELECT * FROM r",
        "SELECT '\\'', * FROM facts_current TABLESAMPLE (1 ROWS) --'",
        "SELECT to_json(parse_json('{}'))",
        "SELECT typeof(1)",
    ],
)
def test_gate_refuses_hidden_bounds_and_inner_functions(spark, sql):
    with pytest.raises(gate.Refused):
        gate.validate(spark, sql)


DIALECT = {
    "jsonb_typeof('[1]')": "array", "jsonb_typeof('{\"a\": 1}')": "object", "jsonb_typeof('true')": "boolean", "jsonb_typeof('1.5')": "number", "jsonb_array_length('[1, 2, 3]')": 3, "array_length(ARRAY[4, 5], 1)": 2,
    "jsonb_build_object('a', 1, 'b', 'x')": '{"a":1,"b":"x"}', "'{\"a\": {\"b\": 7}}' -> 'a'": '{"b":7}', "'{\"a\": {\"b\": 7}}' -> 'a' ->> 'b'": "7", "'[10, 20]' ->> 1": "20", "'{\"a\": [1, 2]}' #> '{a,1}'": "2", "'{\"a\": {\"b\": \"z\"}}' #>> '{a,b}'": "z",
    "'{\"a\": 1, \"b\": 2}' @> '{\"b\": 2}'": True, "'{\"a\": 1}' @> '{\"a\": 2}'": False, "'{\"b\": \"q\"}' <@ '{\"a\": 1, \"b\": \"q\"}'": True, "ARRAY[1, 2, 3] @> ARRAY[2]": True, "ARRAY[9] <@ ARRAY[1, 9]": True, "ARRAY[1, 2] && ARRAY[2, 3]": True, "ARRAY[1] && ARRAY[3]": False,
    "'Abc' ~ '^A'": True, "'Abc' ~ '^a'": False, "'Abc' ~* '^a'": True, "'Abc' !~ '^a'": True, "'Abc' !~* '^a'": False, "'Abc' ~~ 'A%'": True, "'Abc' !~~ 'A%'": False, "'Abc' ~~* 'a%'": True, "'Abc' !~~* 'a%'": False,
    "2 = ANY(ARRAY[1, 2])": True, "5 = ANY(ARRAY[1, 2])": False, "7 / 2": 3, "-7 / 2": -3, "7.0 / 2": 3.5, "3 * 5 / 2": 7, "cardinality(ARRAY[1, 2])": 2, "'a' || 'b -> c'": "ab -> c", "3 BETWEEN 1 AND 4": True,
}


@pytest.fixture(scope="module")
def box(spark):
    return gate.Sandbox(registry.views(spark, SMALL))


@pytest.mark.parametrize("expression", DIALECT)
def test_dialect(box, expression):
    assert box.query(f"SELECT {expression} AS x").rows == [(DIALECT[expression],)]


def test_search_functions_publish_their_columns_and_take_filters(spark):
    v = registry.views(spark, SMALL)
    box = gate.Sandbox(v, embed=lambda text: registry.query_vector(v))
    every = box.query("SELECT * FROM semantic_facts('who', 10)")
    assert tuple(every.columns) == ("rank", "score", "channel", *nominations.COLUMNS["facts"]) and len(every.rows) == 10
    kinds = box.query("SELECT DISTINCT fact_kind, predicate FROM semantic_facts('who', 10, '{\"fact_kind\": \"relation\", \"predicate\": \"located_in\"}')").rows
    assert kinds == [("relation", "located_in")]
    one = v.mentions_live.where("claim_id IS NOT NULL").select("resolved_entity_id").first()[0]
    claims = box.query(f"SELECT claim_id FROM semantic_claims('x', 100, '{{\"entity_id\": \"{one}\"}}')").rows
    own = {r[0] for r in v.mentions_live.where(F.col("resolved_entity_id") == one).select("claim_id").collect()}
    assert claims and {c for (c,) in claims} <= own
    dated = box.query("SELECT min(asserted_at) AS a, max(asserted_at) AS z FROM semantic_claims('x', 100, '{\"asserted_from\": \"1997-01-01\", \"asserted_to\": \"1998-01-01\"}')").rows[0]
    assert str(dated[0]) >= "1997" and str(dated[1]) <= "1998-01-01 00:00:00"
    assert {r[0] for r in box.query("SELECT entity_type FROM semantic_entities('x', 5, '{\"entity_type\": \"person\"}')").rows} == {"person"}
    ids = [r[0] for r in box.query("SELECT chunk_id FROM lexical_chunks('license', 3, '{\"source_kind\": \"text\"}') ORDER BY rank").rows]
    got = box.query(f"SELECT chunk_id, source_text FROM fetch_chunk_bodies(ARRAY['{ids[1]}', 'gone', '{ids[0]}']) ORDER BY ordinal").rows
    assert [c for c, _ in got] == [ids[1], ids[0]] and all("license" in t.lower() for _, t in got)


@pytest.mark.parametrize("call", ["semantic_facts('x', 5, '{\"color\": \"red\"}')", "semantic_facts('x', 5, '{\"fact_kind\": \"opinion\"}')", "semantic_facts('x', 5, '[1]')", "semantic_claims('x', 5, '{\"doc_id\": [1]}')", "semantic_claims('x', 5, '{\"asserted_from\": \"soon\"}')", "lexical_claims('x', 0)", "fetch_chunk_bodies('x')", "fetch_chunk_bodies(ARRAY[upper('x')])"])
def test_search_functions_refuse(box, call):
    with pytest.raises(gate.Refused):
        box.frame(f"SELECT * FROM {call}")


def test_dialect_over_relations(box):
    rows = box.query("SELECT jsonb_agg(doc_id) AS ids, jsonb_object_agg(doc_id, source_kind) AS kinds FROM (SELECT doc_id, source_kind FROM memory_v1.documents_live WHERE doc_id ~ '^O[12]$' ORDER BY doc_id)").rows
    assert json.loads(rows[0][0]) == ["O1", "O2"] and set(json.loads(rows[0][1])) == {"O1", "O2"}
    assert box.query("SELECT count(*) AS n FROM claims_live WHERE added_context @> '{\"order\": 1}' AND added_context ->> 'order' = '1'").rows == [(1,)]
    first = "facts_as_of(CAST('1998-06-01 00:00:00' AS TIMESTAMP), CAST('1999-01-01 00:00:00' AS TIMESTAMP))"
    assert box.query(f"SELECT count(*) AS n, 'see facts_as_of(1, 2)' AS note FROM {first}").rows[0][1] == "see facts_as_of(1, 2)"
    assert len(box.query("WITH RECURSIVE r(n, depth) AS (SELECT 1, 0 UNION ALL SELECT n * 2, depth + 1 FROM r WHERE depth < 3) SELECT * FROM r").rows) == 4


def test_gate_caps_and_saved_queries(spark):
    box = gate.Sandbox(registry.views(spark, SMALL))
    got = box.query("SELECT fact_id FROM facts_current ORDER BY fact_id", rows=3)
    assert len(got.rows) == 3 and got.truncated
    saved = gate.SavedQueries(box)
    saved.draft("team", "one", "SELECT doc_id FROM documents_live WHERE doc_id = ?", ("doc",))
    with pytest.raises(gate.Refused):
        saved.activate("team", "one", 1, ((["O1"], 5),))
    saved.activate("team", "one", 1, ((["O1"], 1), (["O20"], 0)))
    assert saved.run("team", "one", ["O1"]).rows == [("O1",)]


# streams, sinks, engine


def test_ingest_takes_each_version_once(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    (folder / "a.md").write_text("one")
    (folder / "b.md").write_text("two")
    run = lambda: ingest.ingest(ingest.watch(spark, str(folder)), table, str(tmp_path / "state")).awaitTermination()
    run()
    run()
    assert spark.read.parquet(table).count() == 2
    (folder / "c.md").write_text("three")
    run()
    assert spark.read.parquet(table).count() == 3
    known = spark.read.parquet(table)
    assert ingest.vanished(known, known.where(~F.col("source_ref").endswith("b.md"))).count() == 1


def test_barrier(spark):
    done = spark.createDataFrame([("v", 1), ("v", 1), ("v", 2), ("w", 1)], "version string, unit_id int")
    expected = spark.createDataFrame([("v", 2), ("w", 2)], "version string, expected long")
    assert [r["version"] for r in ingest.barrier(done, expected, "version").collect()] == ["v"]


def test_snapshot_is_read_as_published(spark, tmp_path):
    v, root = registry.views(spark, SMALL), str(tmp_path / "graph")
    counts = sinks.publish(v, root, "v1")
    got = sinks.latest(spark, root)
    assert {n: t.count() for n, t in got.items()} == counts and counts["relates"] > 0
    sinks.point(spark, root, "v2")
    sinks.point(spark, root, "v1")  # an earlier version again
    assert sinks.pointers(spark, root) == [1, 2, 3] and set(sinks.latest(spark, root)) == set(counts)


def test_currency_transitions(spark):
    v = registry.views(spark, SMALL)
    moves = v.spine["testimony_currency_events"].limit(3).unionByName(v.spine["testimony_currency_events"].limit(1).withColumn("reason", F.lit("regained")).withColumn("became_current", F.lit(True)))
    events, _ = facts.apply_transitions(v, moves)
    assert events.count() == 1  # the ledger has the others


def test_engine(spark):
    engine = Engine(spark, SMALL, embed=lambda text: [0.1] * 64)
    answer = engine.answer_context("public license", ("C7",))
    assert answer.parts["facts"].count() > 0 and answer.parts["evidence"].count() > 0
    assert engine.query_sql("SELECT count(*) AS n FROM facts_current").rows[0][0] > 0
    assert engine.search_query_space("graph edges")[0][0].startswith("graph_edges")


# text rules


def test_text_rules(spark):
    from factloom.functions import text

    rows = spark.createDataFrame([("  Éx\u00a0 TITLE",), ("IV. Results",), ("2.10 Data",), ("B. Next",), ("12 %",), ("",), ("IIX. odd",)], "t string")
    got = {r["t"]: r for r in rows.select("t", text.heading_title("t").alias("h"), F.round(text.letter_ratio(F.col("t")), 3).alias("r"), text.leading_number(F.col("t")).alias("n")).collect()}
    assert got["  Éx\u00a0 TITLE"]["h"] == "éx title" and got[""]["r"] == 0 and got["12 %"]["r"] == 0
    numbers = {t: (r["n"]["scheme"], r["n"]["values"]) if r["n"] else None for t, r in got.items()}
    assert numbers["IV. Results"] == ("roman", [4]) and numbers["2.10 Data"] == ("arabic_dotted", [2, 10]) and numbers["B. Next"] == ("alpha", [2]) and numbers["12 %"] == ("arabic_dotted", [12]) and numbers["IIX. odd"] is None
    romans = spark.createDataFrame([(x,) for x in ("I", "XLII", "MCMXCIX", "IL", "")], "t string").select(text.roman_value(F.col("t"))).collect()
    assert [r[0] for r in romans] == [1, 42, 1999, None, None]
    one = spark.range(1).select(text.nearest_rank(F.array(*map(F.lit, (5, 1, 9, 7))), 0.5).alias("p"), text.instant_of(F.lit("2024-02-03")).alias("d"), text.instant_of(F.lit("2024-02-03T04:05:06Z")).alias("i"), text.instant_of(F.lit("soon")).alias("x"), (text.canonical_set_hash(F.array(F.lit("b"), F.lit("a"), F.lit("b"))) == text.canonical_set_hash(F.array(F.lit("a"), F.lit("b")))).alias("same")).first()
    assert one["p"] == 5 and one["d"]["date_only"] is True and one["i"]["date_only"] is False and one["x"]["at"] is None and one["same"]


def test_chunks_by_a_plain_scan(spark):
    """pack_chunks against the rule read block by block."""
    rng = random.Random(3)
    text = "\n\n".join(rng.choice(("# h", "## k", "### m", "w " * rng.randint(1, 160), "x " * 500)) + f" {i}" for i in range(300))
    blocks = documents.blockize(text)
    parts = documents.sections(blocks)
    got = documents.pack_chunks(text, blocks, parts)
    assert [(c[2], c[3]) for c in got] == sorted((c[2], c[3]) for c in got) and sum(c[3] - c[2] + 1 for c in got) == len(blocks)
    owner = {k: max((p for p in parts if p[2] <= k < p[3]), key=lambda p: p[0].count("."))[0] for k in range(len(blocks))}
    want, run, held, since, last = [], [], 0, documents.ANCHOR_GAP, None
    for b in blocks:
        if owner[b.ordinal] != last:
            want, run, held, since, last = want + [run] * bool(run), [], 0, documents.ANCHOR_GAP, owner[b.ordinal]
        n = len(text[b.char_start : b.char_end].split())
        anchor = int(b.block_hash[:16], 16) % documents.ANCHOR_MODULUS == 0 and since >= documents.ANCHOR_GAP
        if anchor or (run and held + n > documents.TOKEN_BUDGET):
            want, run, held, since = want + [run] * bool(run), [], 0, 0 if anchor else since
        run, held, since = [*run, b], held + n, since + n
        if held > documents.TOKEN_BUDGET:
            want, run, held = [*want, run], [], 0
    want += [run] * bool(run)
    assert [(c[2], c[3]) for c in got] == [(r[0].ordinal, r[-1].ordinal) for r in want]
    assert [c[1] for c in got] == [owner[r[0].ordinal] for r in want]
