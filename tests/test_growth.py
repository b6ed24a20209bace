"""What large tables need: no table of the store goes whole to all tasks, rows move no oftener than they have to."""

import duckdb
import pytest

from factloom.functions.checkpoint import cut, joined_where_dealt
from factloom.operators import claims, graph, identity, sections
from factloom.plans import registry
from factloom.plans.views import Views
from factloom.sources.spine import Spine

SMALL = "/root/testdata/sf0.001"


def broadcast_tables(df):
    """Scans of files below a broadcast in df's plan."""
    found, inside = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is not None and depth <= inside:
            inside = None
        if inside is None and "BroadcastExchange" in line:
            inside = depth
        elif inside is not None and "Scan parquet" in line:
            found.append(line.strip())
    return found


def test_aliases_are_not_sent_to_all_tasks(spark):
    found = identity.blocked_candidates(registry.views(spark, SMALL), ["hot gear", "cold bolt"])
    assert not broadcast_tables(found)
    assert found.count() > 2


def moves_along(df, name="Exchange"):
    """How often the rows of the first table of df's joins move."""
    plan, times = df._jdf.queryExecution().executedPlan().initialPlan(), 0
    while True:
        times += plan.nodeName() == name
        if plan.children().isEmpty():
            return times
        plan = plan.children().head()


def test_candidates_move_once_to_their_chunk(spark):
    texts = ["Ann said yes. Bob left.", "Nothing here"]
    chunks = spark.createDataFrame([("d", f"d-{i}", i, "0", "title x", t, 0) for i, t in enumerate(texts)], "doc_id string, chunk_id string, ordinal int, section string, header string, text string, char_start int")
    rows = [("a", "d-0", "Ann said yes.", "Ann said yes.", None, None, None, "unknown"), ("b", "d-0", "Bob left.", "Bob left.", ["Zoe"], None, None, "unknown"), ("c", "d-9", "x", "x", None, None, None, "unknown"), ("d", "d-0", None, "x", None, None, None, "unknown"), ("e", "d-1", "Nothing", "Nothing", None, None, None, "unknown")]
    candidates = spark.createDataFrame(rows, "candidate_id string, chunk_id string, span string, claim_text string, added array<string>, valid_from string, valid_until string, precision string")
    kept = spark.createDataFrame([("d-0", "Ann said yes.", True), ("d-0", "Ann said yes.", False), ("d-0", "Bob left.", False), ("d-1", "Nothing here", True)], "chunk_id string, span string, flagged boolean")
    found = claims.grounding_gate(candidates, kept, chunks)
    assert moves_along(found) == 1
    got = {r["candidate_id"]: (r["gate"], r["kept_flagged"]) for r in found.collect()}
    assert got == {"a": (None, True), "b": ("added_context_unverified", None), "c": ("span_not_found", None), "d": ("span_not_found", None), "e": (None, False)}


@pytest.mark.parametrize("name", ["sections_by_anchor", "sections_snapped", "section_skeletons"])
def test_lines_are_not_sent_to_all_tasks(spark, name, monkeypatch):
    sent = []
    monkeypatch.setattr(sections, "cut", lambda df: (sent.extend(broadcast_tables(df)), cut(df))[1])
    found = registry.queries()[name](spark, SMALL)
    assert not sent and not broadcast_tables(found)


def test_whole_mentions_move_once(spark):
    v, most = Views(Spine(spark, SMALL)), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with joined_where_dealt(spark):
            assert moves_along(v._mention_current_content) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = v.mentions_live
    columns = ", ".join(got.columns)
    want = duck.execute(f"SELECT {columns} FROM ({registry.oracle_sql()['mentions_live']})").fetchall()
    assert len(want) > 1000
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_core_numbers_take_the_rounds_they_need(spark):
    path = spark.createDataFrame([(str(i), f"n{i:03}", f"n{i + 1:03}", "next") for i in range(80)], "id string, source string, target string, predicate string")
    assert {r["core"] for r in graph.core_numbers(path).collect()} == {1}  # thirty rounds leave twos in the middle


def test_components_move_numbers(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(graph, "cut", lambda df: (stored.append(df.dtypes), cut(df))[1])
    ends = [("n9", "n10"), ("n10", "n8"), ("x", "x"), ("b", "a"), ("a", "c"), ("c", "b")] + [(f"p{i}", f"p{i + 1}") for i in range(20)]
    edges = spark.createDataFrame([(str(i), s, t, "p") for i, (s, t) in enumerate(ends)], "id string, source string, target string, predicate string")
    got = dict(map(tuple, graph.weak_components(edges).collect()))
    assert got == {"n9": "n10", "n10": "n10", "n8": "n10", "x": "x", "a": "a", "b": "a", "c": "a"} | {f"p{i}": "p0" for i in range(21)}
    assert [t for t in stored if any(kind == "string" for _, kind in t)] == [[("node", "string"), ("rank", "bigint")]]
    assert graph.weak_components(edges.limit(0)).collect() == []
