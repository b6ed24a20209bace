"""Claims from text: sentences, the grounding gate and claim windows."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.operators import claims
from factloom.plans import registry

CHUNK = "doc_id string, chunk_id string, ordinal int, section string, header string, text string, char_start int"


def chunks(spark):
    rows = [("d", "c0", 0, "s", "title Atlas; date 1996-01-01", "Rome fell. Nobody's fault, it said.", 0), ("d", "c1", 1, "s", None, "The harbour burned. The harbour burned.", 100), ("d", "c2", 2, "t", None, "Elsewhere 7 ships sank.", 200), ("d", "c3", 3, "t", None, None, 300)]
    return spark.createDataFrame(rows, CHUNK)


def judge(spark, *cases, kept=(("c0", "fell", False), ("c1", "burned", True), ("c2", "sank", False), ("c2", "gone", False))):
    rows = [(str(i), c, span, span, added, None, None, "unknown") for i, (c, span, added) in enumerate(cases)]
    candidates = spark.createDataFrame(rows, "candidate_id string, chunk_id string, span string, claim_text string, added array<string>, valid_from string, valid_until string, precision string")
    got = claims.grounding_gate(candidates, spark.createDataFrame(list(kept), "chunk_id string, span string, flagged boolean"), chunks(spark)).collect()
    return [r for r in sorted(got, key=lambda r: int(r["candidate_id"]))]


def test_gates(spark):
    cases = [
        ("c0", "Rome fell", None),  # accepted
        ("c0", "Rome rose", ["nonsense"]),  # nowhere, whatever it adds
        ("c0", "fault", None),  # nobody kept it
        ("c1", "burned. The", ["according to ATLAS,", "it's that"]),  # the header of its own chunk only
        ("c1", "The harbour burned", ["Rome's", "nobody's fault"]),  # the chunk before, same section
        ("c1", "burned", ["7 ships"]),  # the chunk after is of another section
        ("c2", "ships sank", ["in 7", "of 8 the said"]),  # numbers are never tolerated
        ("c2", "sank.", ["", "  "]),
        ("c2", "sank.", ["her—his"]),
        ("c3", "x", None),
        ("nowhere", "x", None),
        ("c1", "burned", ["Harb"]),  # part of a word is none
    ]
    got = judge(spark, *cases)
    gates = [r["gate"] for r in got]
    unverified = "added_context_unverified"
    assert gates == [None, "span_not_found", "outside_kept_ranges", unverified, None, unverified, unverified, None, unverified, "span_not_found", "span_not_found", unverified]
    assert (got[0]["char_start"], got[0]["char_end"], got[0]["kept_flagged"]) == (0, 9, False)
    assert got[3]["failed_tokens"] == ["atlas"] and got[5]["failed_tokens"] == ["7", "ships"] and got[8]["failed_tokens"] == ["—"] and got[11]["failed_tokens"] == ["harb"]
    assert (got[6]["failed_text"], got[6]["failed_tokens"]) == ("of 8 the said", ["8"])
    assert judge(spark, ("c1", "burned", None))[0]["kept_flagged"] is True


def test_kept_spans_without_a_claim(spark):
    candidates = spark.createDataFrame([("c0", "Rome fell", "x"), ("c2", "Elsewhere", "y"), ("c2", "not there", "z")], "chunk_id string, span string, claim_text string")
    kept = spark.createDataFrame([("c0", "fell. Nobody", False), ("c0", "fault", False), ("c1", "burned", False), ("c2", "gone", False), ("c2", "gone", True)], "chunk_id string, span string, flagged boolean")
    got = sorted(map(tuple, claims.omitted(candidates, kept, chunks(spark)).collect()))
    assert got == [("c0", "fault"), ("c1", "burned"), ("c2", "gone")]


def test_interval_index_is_disjoint(spark):
    rows = [("a", 0, 5), ("a", 3, 9), ("a", 9, 10), ("a", 20, 30), ("a", 22, 23), ("a", 20, 30), ("a", None, None), ("b", None, None)]
    got = {r["chunk_id"]: [tuple(x) for x in r["index"]] for r in claims.interval_index(spark.createDataFrame(rows, "chunk_id string, range_start int, range_end int")).collect()}
    assert got == {"a": [(0, 9), (9, 10), (20, 30)]}


@pytest.mark.parametrize(
    "case, want",
    [
        (("2020-01-01", "2020-02-01", "month"), ("2020-01-01 00:00:00", "2020-02-01 00:00:00", "month")),
        (("2020-02-01", "2020-01-01", "day"), (None, None, "unknown")),
        (("2020-01-01", None, "day"), (None, None, "unknown")),
        (("2020-01-01", None, "open"), ("2020-01-01 00:00:00", None, "open")),
        ((None, "2020-01-01", "open"), (None, None, "unknown")),
        (("2020-01-01", "2020-01-01", "instant"), (None, None, "unknown")),
        (("2020-01-01T10:00:00+02:00", "2020-01-01T08:00:00Z", "instant"), ("2020-01-01 08:00:00", "2020-01-01 08:00:00", "instant")),
        (("2020-01-01T10:00:00", None, "open"), (None, None, "unknown")),
        (("2020-01-01+02:00", None, "open"), (None, None, "unknown")),
        (("soon", "2020-01-01", "day"), (None, None, "unknown")),
        (("", None, "open"), (None, None, "unknown")),
        ((None, None, "unknown"), (None, None, "unknown")),
        (("2020-01-01", None, "unknown"), (None, None, "unknown")),
        (("2020-01-01", "2020-01-02", "fortnight"), (None, None, "unknown")),
    ],
)
def test_claim_windows(spark, case, want):
    row = spark.createDataFrame([case], "a string, z string, p string")
    a, z, p = claims.window_of(F.col("a"), F.col("z"), F.col("p"))
    got = row.select(a.cast("string").alias("a"), z.cast("string").alias("z"), p.alias("p")).first()
    assert tuple(got) == want


def test_gate_equals_its_sql_with_sharp_s(spark, tmp_path):
    text = "Eins. " * 7 + "Große Füße."
    spark.createDataFrame([(1, text, "de", "web", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    for path in glob.glob("/root/testdata/sf0.001/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name in ("documents", "conversations"):
        duck.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = duck.sql(f"SELECT candidate_id, gate FROM ({registry.oracle_sql()['grounding_gate']})").fetchall()
    got = registry.queries()["grounding_gate"](spark, str(tmp_path)).select("candidate_id", "gate").collect()
    assert ("D1-0-7", None) in want and sorted(map(tuple, got)) == sorted(want)
