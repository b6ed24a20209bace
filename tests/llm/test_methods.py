"""The operators against brute force, round trips and held-out labels on small fixtures."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import brown, forest, license, mixing, packing, quality, search, simhash, toxicity
from factloom.llm.common import Scratch, components, labelled_sample, local_components, sampled_texts

SMALL = "/root/testdata/sf0.001"


def test_license_automaton():
    automaton = license.Automaton({"t": "one [[two | three four]] five <<2>> six"})
    accepts = lambda s: automaton.labels(s.encode().split()) == {"t"}
    for good in ("one five six", "x one two five six y", "one three four five a b six", "one one five a six"):
        assert accepts(good), good
    for bad in ("one three five six", "one five a b c six", "one two", "two five six", "one fivesix"):
        assert not accepts(bad), bad


def test_license_templates_of_a_caller(spark):
    docs = spark.createDataFrame([(1, "Free to use by anyone"), (2, "free for use"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license.license_scan(docs, templates={"own": "free to use"}).collect()}
    assert got == {1: ("own", 1.0), 2: ("", 0.0), 3: ("", 0.0)}
    got = {r["doc_id"]: r["labels"] for r in license.license_scan(docs, templates={"own": "[[nothing | <<2>>]]"}).collect()}
    assert got == {1: "own", 2: "own", 3: ""}


def test_license_whole_wording(spark):
    import re

    whole = {k: re.sub(r"\[\[.*?\]\]|<<\d+>>", "", re.sub(r"\[\[3\]\]", "", license.TEMPLATES[k])) for k in ("mit", "isc", "apache-2.0", "mpl-2.0")}
    rows = [(k, f"Preface. {t}. Afterword") for k, t in whole.items()] + [(k + "?", t.rsplit(" ", 3)[0]) for k, t in whole.items()]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {rows[r["doc_id"]][0]: (r["labels"].split(","), r["score"]) for r in license.license_scan(docs).collect()}
    for k in whole:
        assert k in got[k][0] and got[k][1] == 1.0
        assert k not in got[k + "?"][0] and got[k + "?"][1] == 0.75


def test_license_places():
    words = license.words_of("CC-BY, All rights\nreserved. cc by".encode())
    phrases = {b" " + k.encode() + b" ": v for k, v in license.BASE.items()}
    assert license.scan(words, license.Automaton(license.TEMPLATES), phrases)[:4] == (3, 0, 5, {"cc-by", "reserved"})


@given(st.dictionaries(st.integers(1, 63), st.integers(1, 30), max_size=12))
@settings(max_examples=80, deadline=None)
def test_best_fit_places_every_piece(counts):
    for method in (packing.best_fit_decreasing, packing.fullest_fit_decreasing):
        check_plan(counts, *method(counts, 64))


def check_plan(counts, plan, bins):
    used, ranks = {}, Counter()
    for size, rank, n, first, each, at in plan:
        assert rank == ranks[size]
        ranks[size] += n
        for i in range(n):
            span = (at + i % each * size, at + (i % each + 1) * size)
            used.setdefault(first + i // each, []).append(span)
    assert dict(ranks) == counts
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 64 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len(used) == bins >= packing.lower_bound(counts, 64) >= math.ceil(sum(s * c for s, c in counts.items()) / 64)


def test_lower_bound_is_met_where_no_pair_fits():
    assert packing.lower_bound({40: 10}, 64) == 10 == packing.best_fit_decreasing({40: 10}, 64)[1]


def test_encoder_gives_the_ids_of_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_tokenizer())
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext", "\u200d<|endoftext|>\n\n", "z" * 200_000]
    for text in texts:
        ids = slow.encode(text, add_special_tokens=False).ids
        assert packing.encoder(packing.default_tokenizer()).encode_to_numpy(text, allowed_special="all").tolist() == ids


def test_packing_covers_documents(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_tokenizer())
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(10**6, "a <|endoftext|> b"), (10**6 + 1, "w " * 700_000), (10**6 + 2, None), (10**6 + 3, ""), (10**6 + 4, "<|endoftext|>" * 1023)]
    docs = small.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).repartition(7)
    got = packing.pack(docs, Scratch(spark, "t"), with_ids=True).collect()
    by, sequences = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], {})[r["piece"]] = r
        sequences.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for d in docs.collect():
        parts = by[d["doc_id"]]
        assert [i for k in sorted(parts) for i in parts[k]["ids"]] == [*slow.encode(d["text"] or "", add_special_tokens=False).ids, packing.END]
        assert all(parts[k]["length"] == packing.CAPACITY for k in list(sorted(parts))[1:])
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == [sum(x["length"] for x in parts[:i]) for i in range(len(parts))]
        assert sum(r["length"] for r in parts) <= packing.CAPACITY
    assert len(sequences) <= 1.02 * sum(r["length"] for r in got) / packing.CAPACITY + 1


def test_packing_certifies_groups_and_exchanges(spark):
    # parts of matching lengths meet their bound; the others do in pairs, or not at all
    rows = [(0, 512, 10), (1, 1000, 5), (1, 24, 5), (2, 700, 3), (3, 324, 3), (4, 600, 7), (5, 300, 1), (40, 600, 1)]
    hist = spark.createDataFrame(rows, "part int, length long, n long")
    plan, members = packing.plans(hist, Scratch(spark, "t"), 1024)
    gids = {(r["part"], r["gid"]) for r in members.collect()}
    groups = {r["gid"]: (r["bins"], r["bound"]) for r in plan.collect()}
    assert {p for p, _ in gids} == {0, 1, 2, 3, 4, 5, 40}
    assert all(bins == bound for bins, bound in groups.values())
    assert {(0, 0), (1, 1)} <= gids and len({g for p, g in gids}) == len(groups)
    placed = {(r["gid"], r["length"]): 0 for r in plan.collect()}
    for r in plan.collect():
        placed[r["gid"], r["length"]] += r["n"]
    gid_of = dict(gids)
    for part, length, n in rows:
        placed[gid_of[part], length] -= n
    assert set(placed.values()) == {0}


def test_gray_index_finds_the_components_of_all_pairs():
    rng = np.random.default_rng(5)
    for n in (2, 40, 700):
        codes = rng.integers(0, 2**63, n, dtype=np.uint64)
        for i in range(n // 2):
            flips = np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, 3))))
            codes[n // 2 + i] = codes[rng.integers(0, n // 2)] ^ flips
        codes = np.unique(codes)
        i, j = simhash.GrayIndex(codes).links(4)
        a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4)
        assert (local_components(len(codes), i, j) == local_components(len(codes), a, b)).all()


def test_fingerprint():
    text = "A b c d e f é g".encode()
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    assert simhash.fingerprint(text) == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(b"Two words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash.fingerprint(b" ") == 0


@pytest.mark.parametrize("cell", [4096, 8])
def test_simhash_buckets_lose_no_link(spark, cell):
    rng = random.Random(3)
    codes = {rng.getrandbits(64) for _ in range(60)}
    for c in list(codes)[:20]:
        for _ in range(6):
            codes.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    codes = sorted(codes)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame(list(enumerate(signed)), "rep long, fp long")
    got = simhash.near_links(fps, Scratch(spark, "t"), cell=cell).collect()
    arr = np.array(codes, np.uint64)
    a, b = np.nonzero(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4)
    mine = local_components(len(arr), np.array([r["src"] for r in got]), np.array([r["dst"] for r in got]))
    assert (mine == local_components(len(arr), a, b)).all()


@pytest.mark.parametrize("local_links", [0, 1 << 20])
def test_components(spark, local_links):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t"), local_links).collect()}
    want = local_components(300, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert all(want[n] == c for n, c in got.items())
    assert {n for e in edges if e[0] != e[1] for n in e} == set(got)


def near_vectors(rng, n=400):
    base = rng.normal(size=(n, 16))
    base[n // 2 :] = base[rng.integers(0, n // 8, n // 2)] + rng.normal(size=(n // 2, 16)) * 0.1
    base[-5:] = base[0]
    return base


@pytest.mark.parametrize("cell", [4096, 32])
def test_forest_recall_and_counts(spark, cell, monkeypatch):
    monkeypatch.setattr(forest, "CELL", cell)
    monkeypatch.setattr(forest, "LEAF_ROWS", 100)
    x = near_vectors(np.random.default_rng(2))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(forest.near_embeddings(rows, Scratch(spark, "t")).collect())
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    degree = (y @ y.T >= 0.9).sum(1) - 1
    mine = np.array([r["n_links"] for r in got])
    assert (mine <= degree).all() and mine.sum() >= 0.9 * degree.sum()


def test_forest_leaves_do_not_grow_with_the_table(spark, monkeypatch):
    for name, value in (("CELL", 150), ("LEAF_ROWS", 60), ("SPLIT_ROWS", 16), ("DEEPER_ROWS", 200), ("SPREAD_ROWS", 100)):
        monkeypatch.setattr(forest, name, value)
    rng = np.random.default_rng(12)
    x = np.concatenate((near_vectors(rng, 3000), np.ones((1, 16)) + rng.normal(size=(300, 16)) * 1e-3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    scratch = Scratch(spark, "t")
    reps = rows.select(F.col("vec_id").alias("rep"), F.col("embedding").alias("v"), F.lit(1).cast("long").alias("times"))
    forest.forest_links(reps, scratch, fit_rows=100).count()  # trees of 100 rows leave leaves of hundreds
    placed, deep = (spark.read.parquet(scratch.paths[n]) for n in ("placed", "deeper"))
    size = lambda t: sorted(r["count"] for r in t.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect())
    assert sum(n > 150 for n in size(placed)) > 20
    assert sum(n > 150 for n in size(deep)) <= forest.TREES * 3  # only the 300 that are all alike
    monkeypatch.setattr(forest, "FIT_NUMBERS", 1600)
    got = sorted(forest.near_embeddings(rows, Scratch(spark, "t")).collect())
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    degree = (y @ y.T >= 0.9).sum(1) - 1
    mine = np.array([r["n_links"] for r in got])
    assert (mine <= degree).all() and mine.sum() >= 0.9 * degree.sum()


def test_maxscore_is_exact():
    rng = np.random.default_rng(4)
    rows = rng.integers(-200, 200, (900, 24))
    rows[600:] = rows[rng.integers(0, 600, 300)]  # ties
    ids = rng.permutation(900)
    shard = search.Shard(ids, rows)
    for q in range(0, 900, 45):
        got = search.Shard.search(shard, rows[q], int(ids[q]), 5)
        scores = rows @ rows[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:5]
        assert got[0].tolist() == ids[order].tolist() and got[1].tolist() == scores[order].tolist()


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    truth = np.repeat(np.arange(4), 10)
    chance = np.array([[0.05, 0.85, 0.05, 0.05], [0.05, 0.05, 0.85, 0.05], [0.05, 0.05, 0.05, 0.85], [0.85, 0.05, 0.05, 0.05]])
    bigrams = np.zeros((41, 41))
    word, state = 0, 0
    for _ in range(30_000):
        state = rng.choice(4, p=chance[state])
        nxt = rng.choice(10) + 10 * state
        bigrams[word, nxt] += 1
        word = nxt
    of = brown.exchange(bigrams, 4, sweeps=20)
    purity = sum(Counter(truth[of == c]).most_common(1)[0][1] for c in set(of)) / 40
    assert purity >= 0.9


def test_brown_base_and_total_probability(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in brown.brown_scores(docs, Scratch(spark, "t")).collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in brown.tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        tokens, r = brown.tokens_of(t), got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(w in counts for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_brown_scores_by_brute_force_and_in_any_partitions(spark, monkeypatch):
    """The whole model again in plain Python, given the classes; and the same scores however the table is cut."""
    monkeypatch.setattr(brown, "BLOCK_BYTES", 40_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark, "t")
    one = {r["doc_id"]: r for r in brown.brown_scores(docs.coalesce(1), scratch).collect()}
    many = {r["doc_id"]: r for r in brown.brown_scores(docs.repartition(16), Scratch(spark, "t")).collect()}
    assert all(math.isclose(one[i]["score"], many[i]["score"], rel_tol=1e-9) for i in one)
    sequences = spark.read.parquet(scratch.paths["sequences"]).collect()
    classes = {r["doc_id"]: list(r["classes"]) for r in sequences}
    texts = {r["doc_id"]: brown.tokens_of(r["text"].encode()) for r in docs.collect()}
    learned = [i for i in texts if not one[i]["held_out"]]
    of = {w: c for i in texts for w, c in zip(texts[i], classes[i], strict=True)}
    assert all(of[w] == c for i in texts for w, c in zip(texts[i], classes[i], strict=True))  # a word has one class
    counts = Counter(w for i in learned for w in texts[i])
    assert all((of[w] == brown.NEW_CLASS) == (w not in counts) for w in of)
    pairs = np.zeros((brown.ALL_CLASSES,) * 2)
    for i in learned:
        for a, b in zip([brown.END, *texts[i]], texts[i], strict=False):
            pairs[of[a], of[b]] += 1
    once, n = sum(c == 1 for w, c in counts.items() if w != brown.END), sum(counts.values())
    chance, total = brown.smooth(pairs, once / (n + 1)), pairs.sum(0)
    for i, words in texts.items():
        want = sum(chance[of[a], of[b]] + (math.log10(counts[b] / total[of[b]]) if b in counts else 0) for a, b in zip([brown.END, *words], words, strict=False))
        assert math.isclose(one[i]["score"], want, rel_tol=1e-9)


def test_next_class_chances_add_up():
    pairs = np.zeros((brown.ALL_CLASSES,) * 2)
    pairs[:5, :5] = np.arange(25).reshape(5, 5)
    assert np.allclose((10 ** brown.smooth(pairs, 0.1)).sum(1), 1)


def test_factorization_machine_learns_pairs():
    rng = random.Random(2)
    rows = []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(40)}" for _ in range(6)] + ["insultx"] * a + ["groupx"] * b
        bins = sorted({i for w in words for i in toxicity.bins_of(w.encode())})
        rows.append((int(a and b), 1.0, np.array(bins)))
    model = toxicity.train(rows[:1000])
    scorer = toxicity.Scorer(model)
    for text, want in (("insultx groupx", 1), ("insultx w1", 0), ("w2 groupx", 0), ("w3 w4", 0)):
        assert (scorer([text])[0] >= 0.5) == bool(want), text
    odds = lambda text: float(np.log(scorer([text])[0] / (1 - scorer([text])[0])))
    # together they say more than the sum of what each says
    assert odds("insultx groupx") - odds("") > odds("insultx") - odds("") + odds("groupx") - odds("")


def test_classifiers_on_held_out_rows(spark):
    clean = lambda i: " ".join(random.Random(i).choice("alder birch cedar dogwood elder fir gum hazel".split()) for _ in range(60))
    rows, marks = [], []
    for i in range(300):
        bad, toxic = i % 3 == 0, i % 5 == 0
        rows.append((i, ("JUNK!! " * 40 + clean(i)[:60] if bad else clean(i)) + (" moronic" if toxic else "")))
        marks.append((i, int(not bad), int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for got, column in ((quality.quality(docs, labels, Scratch(spark, "t")), "quality"), (toxicity.toxicity(docs, labels), "toxic")):
        held = [r for r in got.join(labels, "doc_id").collect() if r["held_out"]]
        assert len(held) > 20
        assert sum(r["predicted"] == r[column] for r in held) >= 0.95 * len(held)


def test_sample_is_bounded_by_rows_not_ids(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "concat('b', id) AS text").union(spark.range(5000).selectExpr("1L", "'a'"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, toxic int")
    sample = labelled_sample(labels, "toxic", F.lit(False), 100)
    assert sorted(sampled_texts(docs, sample).select("doc_id", "text").collect()) == [(0, "b0"), (1, "a"), (2, "b2")]
    assert len(toxicity.sample_rows(docs, sample, "doc_id", "text")) == 3


def test_long_texts_give_the_features_of_whole_texts(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(("tree", "BIRD", "häuser", "12", "!!")) for _ in range(n)).encode() for n in (0, 3, 900, 4000)]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    whole = quality.word_vectors(docs, Scratch(spark, "t"))
    features = quality.pooled(texts, whole, quality.Buckets())
    runs = [list(quality.runs_of(t, quality.Buckets())) for t in texts]
    monkeypatch.setattr(quality, "LONG", 100)
    monkeypatch.setattr(quality, "RUN", 77)
    cut = [list(quality.runs_of(t, quality.Buckets())) for t in texts]
    assert [[i for r in x for i in r] for x in cut] == [[i for r in x for i in r] for x in runs] and len(cut[3]) > 50
    assert np.allclose(quality.pooled(texts, whole, quality.Buckets()), features, atol=1e-5)


def test_terms_are_not_capped():
    rng = random.Random(4)
    rows = []
    for i in range(16000):  # 400 insults, none of them frequent
        words = [f"w{rng.randrange(60)}x" for _ in range(5)] + ([f"{rng.randrange(400):03d}".translate(str.maketrans("0123456789", "abcdefghij")) * 3] if i % 2 else [])
        rows.append((i % 2, 1.0, np.array(sorted({b for w in words for b in toxicity.bins_of(w.encode())}))))
    model = toxicity.train(rows)
    wanted = {b for i in range(400) for b in toxicity.bins_of((f"{i:03d}".translate(str.maketrans("0123456789", "abcdefghij")) * 3).encode())}
    assert len(wanted) > 800 and len(wanted & set(model.bins.tolist())) > 0.9 * len(wanted)


def test_mixing_meets_targets(spark):
    soft = spark.createDataFrame([(i, 10 + i % 7, [0.9, 0.1] if i % 4 else [0.2, 0.8]) for i in range(200)], "doc_id long, n_tokens long, p array<double>")
    steps = mixing.residuals(soft, [0.5, 0.5], 2, steps=60)
    totals = soft.agg(*(F.sum(mixing.rate_of(steps, 0.0) * F.col("n_tokens") * F.col("p")[d]) for d in (0, 1))).first()
    everything = soft.agg(F.sum("n_tokens")).first()[0]
    assert all(math.isclose(t, everything / 2, rel_tol=1e-3) for t in totals)


def test_mixing_membership_is_soft(spark):
    rng = random.Random(6)
    tongues = {"aa": [f"{x}o{y}" for x in "bdgk" for y in "lmnr"], "bb": [f"{x}ie{y}e" for x in "ptsz" for y in "fwh"], "cc": []}
    pure = lambda lang, n: [rng.choice(tongues[lang]) for _ in range(n)]
    rows = [(i, " ".join(pure(lang, 30)), lang) for i, lang in enumerate(["aa", "bb"] * 100)]
    rows += [(1000 + k, " ".join(pure("aa", 20 + k) + pure("bb", 20 - k)), "aa") for k in (-8, 0, 8)] + [(2000, "", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.where("doc_id < 200").select("doc_id")
    model, _, soft = mixing.solve(docs, mixing.labelled_languages(docs, labels), Scratch(spark, "t"), {"aa": 0.5, "bb": 0.5})
    p = {r["doc_id"]: r["p"][0] for r in soft.collect()}
    assert model.domains == ("aa", "bb")
    assert all((p[i] > 0.9) == (i % 2 == 0) for i in range(200))
    assert p[992] < p[1000] < p[1008] and 0.2 < p[1000] < 0.8 and p[2000] == 0.5


def test_resample_repeats_rows_alike(spark):
    rows = [(1, "bolo kom", "aa", 1), (1, "bolo kom", "aa", 2), (None, None, None, 3)] + [(i, "tiefe ziehe", "bb", i) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _copy long")
    got = Counter((r["doc_id"], r["_copy"]) for r in mixing.resample(docs, mixing.labelled_languages(docs, docs), Scratch(spark, "t")).collect())
    assert set(got) == {(r[0], r[3]) for r in rows} and got[1, 1] == got[1, 2] > 1


def test_pipeline_drops_and_keeps(spark, tmp_path):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    text = lambda: " ".join(rng.choice(words) for _ in range(80))
    rows, marks = [], []
    for i in range(240):
        kind = ("clean", "junk", "toxic", "clean")[i % 4]
        body = text() if kind != "junk" else "BUY!! " * 70
        rows.append((i, body + (" moronic scum" if kind == "toxic" else ""), ("en", "de")[i % 2], "s", 9))
        marks.append((i, int(kind != "junk"), int(kind == "toxic")))
    rows += [(1000 + i, rows[i][1], "en", "s", 9) for i in range(0, 40, 4)]  # copies of clean texts
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert ids == {i for i in range(240) if i % 4 in (0, 3)}


def test_near_copies_at_jaccard_08(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(500)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(60):  # a chain of edits each, some texts with a common passage, one large group
        text = [rng.choice(words) for _ in range(rng.choice((12, 90, 300)))] + passage * (i % 3 == 0)
        for k in range(40 if i == 7 else 4):
            rows.append((len(rows), " ".join(text)))
            for _ in range(max(1, len(text) // rng.choice((40, 60, 90)))):
                text[rng.randrange(len(text))] = rng.choice(words)
    rows += [(9000, ""), (9001, None), (9002, "a b"), (9003, "A  b"), (5, rows[200][1])]
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for i, t in rows for w in [(t or "").lower().split()]]
    label = list(range(len(sets)))
    near = 0
    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if 5 * len(x & y) >= 4 * len(x | y):
                near += x != y
                label = [label[b] if c == label[a] else c for c in label]
    assert near > 100
    least = {c: min(i for (i, _), d in zip(sets, label, strict=True) if d == c) for c in label}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.keep_one(docs.repartition(3), Scratch(spark, "t")).collect()}
    assert got == set(least.values())


def test_factorization_machine_learns_pairs_that_say_nothing_alone(spark):
    """Insult or group name, not both: neither word tells about the label by itself."""
    rng = random.Random(6)
    words = [f"word{i:03}" for i in range(400)]
    rows, marks = [], []
    for i in range(1200):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = rng.sample(words, 20) + ["schuft"] * insult + ["leute"] * group
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(insult != group)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    truth = {i: t for i, _, t in marks}
    got = [r for r in toxicity.toxicity(docs, labels).collect() if r["held_out"]]
    assert len(got) > 200 and sum((r["score"] >= 0.5) == truth[r["doc_id"]] for r in got) >= 0.98 * len(got)
