"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, no rows, and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import brown, chat, forest, license, mixing, packing, quality, search, simhash, toxicity
from factloom.llm.common import Scratch

#: Names that operators use inside.
CLASH = ["fp", "score", "rank", "n_tokens", "p", "m0", "block", "bucket", "word", "part", "own", "rate", "copies", "label", "weight", "component_id", "held_out", "row", "copy"]
TEXTS = ["the cat sat on the mat all rights reserved", "the cat sat on the mat all rights reserved", "", None, "licensed under the mit license", "x " * 30_000, "ein satz mit der und die", "le chat et la souris", "a", "el perro y los gatos"]


def documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    out = spark.createDataFrame(rows, schema)
    return out.withColumns({c: F.lit(7) for c in CLASH})


def labels(spark, empty=False):
    rows = [] if empty else [(i, i % 2, int(i % 3 == 0)) for i in range(12)] + [(None, 1, 1), (3, None, None), (4, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(7) for c in ["rep", "v", "times", "n_links", "score", "rank", "shard", "leaf"]})


def rows_of_documents():
    rows = [(i, t, "en" if i % 2 else "de", "s", 3) for i, t in enumerate(TEXTS)]
    return rows + [(1, TEXTS[1], "en", "s", 3), (None, "no id", None, None, None), (None, None, None, None, None)]


DOCUMENT_OPERATORS = {
    "license": lambda s, d, e: license.license_scan(d),
    "mixing": lambda s, d, e: mixing.mix(d, mixing.labelled_languages(d, labels(s, e)), Scratch(s, "t"), mixing.EQUAL),
    "toxicity": lambda s, d, e: toxicity.toxicity(d, labels(s, e)),
    "brown": lambda s, d, e: brown.brown_scores(d, Scratch(s, "t")),
    "simhash": lambda s, d, e: simhash.simhash_groups(d, Scratch(s, "t")),
    "quality": lambda s, d, e: quality.quality(d, labels(s, e), Scratch(s, "t")),
}


@pytest.mark.parametrize("name", DOCUMENT_OPERATORS)
def test_document_operators_keep_every_row(spark, name):
    got = DOCUMENT_OPERATORS[name](spark, documents(spark, rows_of_documents()), False).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows_of_documents())


@pytest.mark.parametrize("name", DOCUMENT_OPERATORS)
def test_document_operators_on_no_rows(spark, name):
    assert DOCUMENT_OPERATORS[name](spark, documents(spark, []), True).collect() == []


def test_packing_edges(spark):
    got = packing.pack(documents(spark, rows_of_documents()), Scratch(spark, "t")).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for parts in by.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == [sum(x["length"] for x in parts[:i]) for i in range(len(parts))]
        assert sum(r["length"] for r in parts) <= packing.CAPACITY
    assert sum(r["piece"] == 0 for r in got) == len(rows_of_documents())
    assert packing.pack(documents(spark, []), Scratch(spark, "t")).collect() == []


def test_vector_edges(spark):
    rows = [(i, [1.0, float(i % 3), 0.0], 0) for i in range(0, 120)]
    rows += [(200, None, 0), (201, [0.0, 0.0, 0.0], 0), (202, [1.0, None, 0.0], 0), (203, [float("nan"), 1.0, 0.0], 0), (204, [float("inf"), 1.0, 0.0], 0), (None, [1.0, 1.0, 0.0], 0), (205, [], 0), (206, [1e-30, 0.0, 0.0], 0), (5, [1.0, 2.0, 0.0], 0)]
    got = forest.near_embeddings(vectors(spark, rows), Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    for alone in (200, 201, 202, 203, 204, 205):
        assert (by[alone]["n_links"], by[alone]["component_id"], by[alone]["kept"]) == (0, alone, True)
    assert by[206]["component_id"] == 0 and by[None]["component_id"] is None
    found = search.top_k(vectors(spark, rows), Scratch(spark, "t"), F.col("vec_id") % 50 == 0).collect()
    assert {r["query_id"] for r in found} == {0, 50, 100}
    assert not {r["vec_id"] for r in found} & {200, 202, 203, 204, None}
    best = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == 50)
    assert [b[1] for b in best] == [2, 5, 8, 11, 14] and len({b[2] for b in best}) == 1  # ties go to smaller ids
    assert forest.near_embeddings(vectors(spark, []), Scratch(spark, "t")).collect() == []
    assert search.top_k(vectors(spark, []), Scratch(spark, "t"), F.col("vec_id") % 50 == 0).collect() == []


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, perspective string, segment long"
    rows = [(1, 0, "system", "be kind", "x", 1), (1, 1, "ann", "hi", "x", 1), (1, 2, "bob", None, "x", 1), (1, 2, "bob", None, "x", 1), (1, 200, None, "who", "x", 1), (2, 0, "system", "alone", "x", 1), (None, None, "ann", "lost", "x", 1)]
    got = chat.perspectives(spark.createDataFrame(rows, schema)).collect()
    by = {(r["conv_id"], r["perspective"], r["segment"]): r for r in got}
    assert set(by) == {(1, p, s) for p in ("ann", "bob", "unknown") for s in (0, 3)} | {(2, None, 0), (None, "ann", 0)}
    ann = by[1, "ann", 0]
    assert ann["rendered"].count("<|im_start|>assistant\n") == 1 and ann["rendered"].count("<|im_start|>user name=bob\n") == 2
    a, b = map(int, ann["mask"].split(":"))
    assert ann["rendered"][a:b] == "hi<|im_end|>\n"
    assert by[1, "ann", 3]["char_start"] == len(ann["rendered"])
    assert chat.perspectives(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns(spark, stage, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark, rows_of_documents())
    for rows in (docs, docs.limit(0)):
        got = corpus_pipeline.STAGES[stage][1](spark, rows, str(tmp_path))
        assert got.columns == docs.columns
        assert got.count() <= 20 * rows.count()
