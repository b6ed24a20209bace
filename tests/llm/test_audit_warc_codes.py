"""Filter audit, archives and vector codes against brute force, round trips and odd rows."""

import gzip
import hashlib
import json
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import audit, lloyd, warc
from factloom.llm.common import Scratch

SMALL = "/root/testdata/sf0.001"
CLASH = ["part", "mask", "class", "hashes", "n", "least", "text_id", "good", "capture", "kind", "digest", "bytes", "original", "codes", "v", "x", "error", "of"]


def with_clashes(df):
    return df.withColumns({c: F.lit(7) for c in CLASH})


# --- filter audit


def audit_by_hand(docs, labels):
    """The five filters applied one after another, in each order."""
    marks = {}
    for i, q, t in labels:
        if i is not None:
            old = marks.get(i, (0, 0))
            marks[i] = (max(old[0], q or 0), max(old[1], t or 0))
    seen, rows = {}, []
    for i, text, part in docs:
        if i is not None:
            seen[text or ""] = min(seen.get(text or "", i), i)
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and seen[text] < i}
        rows.append((part or "", {f for f in fails if fails[f]}, *marks.get(i, (0, 0))))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left, gone = [r for r in rows if r[0] == part], []
            for k, f in enumerate(order):
                goes = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left = [r for r in left if f not in r[1]]
                gone += goes
                shapley[f] += len(goes)
                unique = sum(r[1] == {f} for r in rows if r[0] == part)
                out[part, "".join(order), k + 1] = [f, len(left), len(goes), redundant, unique, sum(r[2] == 1 for r in goes), sum(r[3] == 1 for r in goes)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[v[0]])
    return out


def audit_rows(spark, docs, labels, block=audit.BLOCK):
    docs = with_clashes(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3))
    labels = with_clashes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    counts = audit.masks(docs, labels, Scratch(spark, "t"), block=block)
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in audit.interactions(counts).collect()}


def audit_documents():
    rng = random.Random(4)
    texts = ["", "word " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), " ".join(f"é{i}" for i in range(250)) + " 5%", "A", "tab\tword\x0bx y", "z" * 100_000, "z" * 99_999 + "y", " ".join(f"w{i}" for i in range(249)) + " w2499"]
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", "", None])) for i in range(120)]
    docs += [(3, docs[3][1], "b"), (3, docs[3][1], "b"), (5, "own text", "a"), (5, "own text", "a"), (None, texts[1], "a"), (None, texts[2], None), (None, None, None), (400, None, "a"), (401, "only null id has it", "b"), (None, "only null id has it", "b")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 120, 2)] + [(2, None, None), (4, 1, 1), (None, 1, 1), (9999, 1, 0)]
    return docs, [(i, q, None if t is None else int(t)) for i, q, t in labels]


@pytest.mark.parametrize("block", [audit.BLOCK, 3])
def test_audit_equals_filters_one_by_one(spark, block):
    docs, labels = audit_documents()
    assert audit_rows(spark, docs, labels, block) == audit_by_hand(docs, labels)


def test_audit_texts_that_share_a_class(spark, monkeypatch):
    """Even if no hash told texts apart, whole texts would."""
    monkeypatch.setattr(audit, "text_class", lambda text, block=0: F.length(text).cast("long"))
    monkeypatch.setattr(audit, "block_hashes", lambda text, block: F.array(F.lit(1).cast("long")))
    monkeypatch.setattr(audit, "refined", lambda rows, scratch, depth: rows.groupBy("class").agg(F.count("*").alias("n")).where("n > 1"))
    docs, labels = audit_documents()
    assert audit_rows(spark, docs, labels) == audit_by_hand(docs, labels)


def test_audit_without_rows(spark):
    assert audit_rows(spark, [], []) == {}
    assert len(audit_rows(spark, [(1, None, None)], [])) == 600


def test_blocks_cover_texts(spark):
    lengths = [0, 1, 2, 3, 14, 15, 16, 62, 63, 64, 254, 255, 256, 1023]
    base = [(n, c, "é" * n + c) for n in lengths for c in "xy"]
    rows = spark.createDataFrame(base, "n long, c string, text string")
    got = {(r["n"], r["c"]): r["class"] for r in rows.select("n", "c", audit.text_class(F.col("text"), 3).alias("class")).collect()}
    assert len(set(got.values())) == len(got)  # the last code point counts at every length


# --- archives


def pages(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))


def read_back(spark, rows, path, **options):
    scratch = Scratch(spark, "t")
    warc.write_archives(pages(spark, rows), scratch, path, **options)
    return warc.transactions(warc.read_records(spark, path), scratch), scratch


def test_archives_round_trip(spark, tmp_path):
    nasty = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.1\r\n" * 9
    rows = [(i, f"http://h/{i}", f"<p>{i % 7} " + "é" * 60) for i in range(40)]
    rows += [(100, "http://h/\r\nWARC-Type: x", nasty), (99, None, nasty), (101, "", "x" * 99), (102, "u", "x" * 99), (103, "u", "é" * 50), (104, "u", "é" * 50), (105, None, None), (106, "a b", ""), (107, "u", "long " * 200_000), (108, "u", "long " * 200_000)]
    rows += [(None, None, "only here " * 20), (None, "u", nasty), (0, "http://h/0", rows[0][2]), (0, "http://h/0", rows[0][2])]
    nested, scratch = read_back(spark, rows, str(tmp_path / "a"), file_bytes=1 << 18)
    found = nested.collect()
    assert len(found) == len(rows) == len({r["capture"] for r in found}) and all(r["n"] == 0 for r in found)
    html = {(i, u): h or "" for i, u, h in rows}
    seen = Counter()
    for r in found:
        about = json.loads(r["metadata"]["payload"])
        key = (about.get("page_id"), about.get("url"))
        seen[key] += 1
        assert r["request"]["head"].startswith("GET ")
        if r["response"]["kind"] == "response":
            assert bytes(r["response"]["payload"]).decode() == html[key]
    assert seen == Counter((i, u) for i, u, _ in rows)
    least = {}
    for i, _, h in rows:
        least.setdefault(h or "", []).append(i)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in warc.resolved(nested, scratch).collect())
    want = []
    for h, ids in least.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        size = len(h.encode())
        for k, i in enumerate(ids):
            again = size >= 100 and k > 0
            want.append((str(i), size, hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", str(ids[0] if again else None)))
    assert got == sorted(want)


def test_archives_without_rows(spark, tmp_path):
    nested, scratch = read_back(spark, [], str(tmp_path / "a"))
    assert nested.collect() == [] and warc.resolved(nested, scratch).collect() == []


def as_record(kind, rid, to=(), block=b"", **more):
    head = [f"WARC-Type: {kind}", *([f"WARC-Record-ID: {rid}"] if rid else []), *(f"WARC-Concurrent-To: {t}" for t in to), *(f"{k.replace('_', '-')}: {v}" for k, v in more.items()), f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_transactions_of_other_writers(spark, tmp_path):
    """Links in either direction and over other records, in other files, members and orders."""
    one = as_record("warcinfo", "<i>") + as_record("request", "<q1>", ["<r1>"]) + as_record("metadata", "<m1>", ["<q1>"], b"over the request")
    two = as_record("response", "<r2>", ["<q2>", "<m2>"], b"HTTP/1.1 200 OK\r\n\r\n\r\n\r\nbody", Content_Type="application/http") + as_record("request", "<q2>") + as_record("metadata", "<m2>") + as_record("metadata", "<m3>", ["<r2>"])
    three = [as_record("response", "<r1>"), as_record("request", "<alone>", ["<nobody>"]), as_record("metadata", None), as_record("request", "<both>", ["<r2>", "<r1>"]), as_record("response", None), as_record("revisit", "<r1>"), as_record("metadata", "<chain>", ["<m1>"])]
    (tmp_path / "one.warc").write_bytes(one)
    (tmp_path / "two.warc").write_bytes(two)
    (tmp_path / "three.warc.gz").write_bytes(b"".join(map(gzip.compress, three)))
    (tmp_path / "none.warc").write_bytes(b"")
    records = warc.read_records(spark, str(tmp_path))
    rows = warc.transactions(records, Scratch(spark, "t")).collect()
    name = lambda x: x and (x["record_id"] or "?")
    got = sorted((str(r["capture"]), r["n"], *(str(name(r[c])) for c in ("response", "request", "metadata"))) for r in rows)
    assert got == sorted(
        [("<r1>", 0, "<r1>", "<both>", "<chain>"), ("<r1>", 1, "None", "<q1>", "<m1>"), ("<r1>", 0, "<r1>", "None", "None")]
        + [("<r2>", 0, "<r2>", "<q2>", "<m2>"), ("<r2>", 1, "None", "None", "<m3>"), ("None", 0, "None", "<alone>", "None"), ("None", 0, "None", "None", "?"), ("None", 0, "?", "None", "None")]
    )
    body = {r["record_id"]: (r["head"], bytes(r["payload"])) for r in records.collect()}
    assert body["<r2>"] == ("HTTP/1.1 200 OK", b"\r\n\r\nbody") and body["<m1>"] == (None, b"over the request")


@pytest.mark.parametrize("broken", [as_record("response", "<r>", block=b"abc")[:-6], b"no record\r\n\r\n", as_record("response", "<r>", block=b"abc").replace(b"Length: 3", b"Length: 2")])
def test_broken_archives_are_errors(spark, tmp_path, broken):
    with pytest.raises(ValueError):
        list(warc.frames(broken, "f"))


# --- vector codes


def lloyd_by_hand(rows, parts, entries, rounds):
    """Full scans in plain whole numbers: rows of (id, label, vector)."""
    kept = [(i, y, x) for i, y, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    width = max(1, -(-max([len(x) for _, _, x in kept], default=0) // parts))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [c for c in r[2]]))
    ints = [[int(np.floor(256 * np.float64(c))) for c in x] + [0] * (parts * width - len(x)) for _, _, x in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [[min(range(len(books[p])), key=lambda e: (dist(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        codes = nearest()
        for p in range(parts):
            books[p] = [[sum(c) // len(mine) for c in zip(*mine, strict=True)] if (mine := [v[p] for v, k in zip(cut, codes, strict=True) if k[p] == e]) else books[p][e] for e in range(len(books[p]))]
    codes = nearest()
    return sorted((str(i), str(y), "".join(f"{c:02x}" for c in k), sum(dist(v[p], books[p][k[p]]) for p in range(parts))) for (i, y, _), k, v in zip(kept, codes, cut, strict=True)), books


def vector_rows(n, width, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)) * 3) / 256 * rng.integers(1, 40)  # ties are common
    return [(int(i), int(i % 3) if i % 5 else None, [float(c) for c in v]) for i, v in zip(rng.permutation(n), x, strict=True)]


@pytest.mark.parametrize("n, width, entries, rounds", [(300, 32, 16, 2), (200, 64, 64, 4), (40, 16, 64, 2), (1, 20, 64, 2)])
def test_codes_equal_full_scans(spark, n, width, entries, rounds):
    rows = vector_rows(n, width, n)
    rows += [(None, 1, rows[0][2]), (rows[0][0], 0, rows[0][2]), (rows[0][0], 0, rows[0][2]), (7000, None, None), (7001, 1, [None, *rows[0][2][1:]]), (7002, 1, [float("nan")]), (7003, 1, [float("inf")]), (7004, 2, rows[0][2][:5]), (7005, 2, [])]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3))
    got, books = lloyd.product_codes(df, Scratch(spark, "t"), entries=entries, rounds=rounds)
    want, by_hand = lloyd_by_hand(rows, 16, entries, rounds)
    assert books.tolist() == by_hand
    assert sorted((str(r["vec_id"]), str(r["label"]), r["code"], r["error"]) for r in got.collect()) == want


def test_codes_without_rows_and_too_large(spark):
    empty = spark.createDataFrame([(1, 1, None)], "vec_id long, label int, embedding array<float>")
    got, books = lloyd.product_codes(empty, Scratch(spark, "t"))
    assert got.collect() == [] and books.shape == (16, 0, 1)
    large = spark.createDataFrame([(1, 1, [1e9] * 16)], "vec_id long, label int, embedding array<float>")
    with pytest.raises(Exception, match="not exact"):
        lloyd.product_codes(large, Scratch(spark, "t"))[0].count()


def test_bounds_spare_scans_and_keep_ties():
    """Bounds rule most rows out, never a nearer or an equally near entry of a lower index."""
    rng = np.random.default_rng(8)
    rows = rng.integers(-30, 30, (3000, 2)) + 400 * rng.integers(0, 8, (3000, 1))
    books = rows[:16].copy()
    state, drift, scans = None, None, []
    for _ in range(6):
        code, upper, lower, d, scanned = lloyd.assign(rows, books, state, drift)
        full = lloyd.squared(rows, books)
        assert (code == full.argmin(1)).all() and (d == full.min(1)).all()
        rest = full.astype(float)
        rest[np.arange(len(rows)), code] = np.inf
        assert (upper**2 >= d).all() and (lower**2 <= rest.min(1)).all()
        scans.append(scanned)
        new = np.array([rows[code == e].sum(0) // max(1, (code == e).sum()) if (code == e).any() else books[e] for e in range(16)])
        drift = lloyd.up(np.sqrt(((new - books) ** 2).sum(1).astype(float)))
        books, state = new, (code, upper, lower)
    assert scans[0] == 3000 and scans[-1] < 1500
    # an entry that comes to stand as near as a row's own, with the lower index, takes it
    rows, books = np.array([[0, 0]]), np.array([[9, 0], [4, 0]])
    code, upper, lower, *_ = lloyd.assign(rows, books, None, None)
    assert code[0] == 1
    moved = np.array([[-4, 0], [4, 0]])
    assert lloyd.assign(rows, moved, (code, upper, lower), np.array([13.0, 0.0]))[0][0] == 0


@pytest.mark.parametrize("module, query, tables", [(audit, "op11_filter_audit", ("documents", "labels")), (warc, "op12_warc", ("pages",)), (lloyd, "op13_lloyd_codes", ("embeddings",))])
def test_queries_equal_their_sql(spark, module, query, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = getattr(module, query)(spark, SMALL)
    want = con.sql(module.ORACLE)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(str(r[c]) for c in sorted(got.columns))
    assert sorted(map(key, got.collect())) == sorted(tuple(str(v) for _, v in sorted(zip(want.columns, row, strict=True))) for row in want.fetchall())
