"""Section trees against the rules read one document at a time."""

import random

from pyspark.sql import functions as F

from factloom.operators import sections


def grid(rng, n):
    """Blocks with gaps between them, and their text."""
    at, out = rng.randrange(4), []
    for k in range(n):
        text = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 9)))
        out.append((k, at, at + len(text), text))
        at += len(text) + rng.randrange(3)
    return out


def snap_by_hand(nodes, blocks, first, last, path, depth):
    """nodes: (start, end, title, children), in the order in which they come; rows (path, title, first, last block)."""
    if depth >= sections.DEPTH_MOST:
        return []
    held = []
    for turn, (a, z, title, children) in enumerate(nodes):
        if z > a and z > blocks[first][1] and a < blocks[last][2]:
            block = max([k for k, at, _, _ in blocks if at <= a], default=0)
            if max(block, first) <= last:
                held.append((max(block, first), a - z, turn, title, children))
    groups = {}
    for start, _, _, title, children in sorted(held, key=lambda h: h[:3]):
        groups.setdefault(start, [title, []])[1].extend(children)
    out, starts = [], sorted(groups)
    for i, start in enumerate(starts):
        end = starts[i + 1] - 1 if i + 1 < len(starts) else last
        out.append((f"{path}.{i}", groups[start][0], start, end))
        out += snap_by_hand(groups[start][1], blocks, start, end, f"{path}.{i}", depth + 1)
    return out


def test_snapped_sections_tile_the_blocks(spark):
    rng = random.Random(11)
    blocks, proposed, docs, want = [], [], [], {}
    for doc in range(120):
        own = grid(rng, rng.randrange(0, 12) if doc else 0)
        docs.append((doc, "t", own[-1][2] if own else 0))
        blocks += [(doc, *b) for b in own]
        parent, span = {}, {}
        for k in range(rng.randrange(0, 14)):
            parent[k], span[k] = rng.choice([None, *parent]), (rng.randrange(-5, 80), rng.randrange(-5, 80))
            proposed.append((doc, k, parent[k], k, f"s{k}", " Methods" if k % 2 else "odd", *span[k]))
        # children in the order in which they came
        tree = lambda of: [(*span[k], f"s{k}", tree(k)) for k in parent if parent[k] == of]  # noqa: B023, E731
        want[doc] = [("0", "t", 0, len(own) - 1)] + (snap_by_hand(tree(None), own, 0, len(own) - 1, "0", 1) if own else [])
    b = spark.createDataFrame(blocks, "doc_id int, ordinal int, char_start int, char_end int, text string")
    p = spark.createDataFrame(proposed, "doc_id int, node_id int, parent_id int, place int, title string, role string, char_start int, char_end int")
    d = spark.createDataFrame(docs, "doc_id int, title string, n_chars int")
    got = {}
    for r in sections.snap_sections(p, b, d).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r["doc_id"], []).append((r["node_path"], r["title"], r["block_start"], r["block_end"]))
        assert r["role"] in ("body", "methods")
    assert got == want
    for doc, rows in got.items():  # children lie in their parent, side by side, and reach to its end
        by = {path: (a, z) for path, _, a, z in rows}
        for path, (a, z) in by.items():
            inner = sorted(v for k, v in by.items() if k.rpartition(".")[0] == path)
            assert all(x[1] + 1 == y[0] for x, y in zip(inner, inner[1:], strict=False)), doc
            assert not inner or (a <= inner[0][0] and inner[-1][1] == z)


def anchor_by_hand(nodes, blocks, first, last, path):
    def find(quote, nth):
        places = []
        for k, _, _, text in blocks[first : last + 1]:
            at = text.find(quote)
            while at >= 0:
                places.append(k)
                at = text.find(quote, at + max(1, len(quote)))
        return places[nth] if nth < len(places) else None

    def here(items):
        for quote, nth, children in items:
            at = find(quote, nth)
            yield from here(children) if at is None else [(at, quote, children)]

    groups = {}
    for at, quote, children in here(nodes):
        groups.setdefault(at, [quote, []])[1].extend(children)
    out, starts = [], sorted(groups)
    for i, start in enumerate(starts):
        end = starts[i + 1] - 1 if i + 1 < len(starts) else last
        out.append((f"{path}.{i}", groups[start][0], start, end))
        out += anchor_by_hand(groups[start][1], blocks, start, end, f"{path}.{i}")
    return out


def test_anchored_sections(spark):
    rng = random.Random(5)
    blocks, anchors, docs, want = [], [], [], {}
    for doc in range(80):
        own = grid(rng, rng.randrange(0, 10) if doc else 0)
        docs.append((doc, "t", own[-1][2] if own else 0))
        blocks += [(doc, *b, 2 if b[0] % 2 else None) for b in own]
        parent, quotes = {}, {}
        for k in range(rng.randrange(0, 12)):
            parent[k] = rng.choice([None, *parent])
            quotes[k] = ("".join(rng.choice("ab ") for _ in range(rng.randrange(0, 4))), rng.randrange(3))
            anchors.append((doc, k, parent[k], k, *quotes[k]))
        tree = lambda of: [(*quotes[k], tree(k)) for k in parent if parent[k] == of]  # noqa: B023, E731
        want[doc] = [("0", "t", 0, len(own) - 1)] + (anchor_by_hand(tree(None), own, 0, len(own) - 1, "0") if own else [])
    b = spark.createDataFrame(blocks, "doc_id int, ordinal int, char_start int, char_end int, text string, level int")
    a = spark.createDataFrame(anchors, "doc_id int, node_id int, parent_id int, place int, anchor string, occurrence int")
    d = spark.createDataFrame(docs, "doc_id int, title string, n_chars int")
    got = {}
    for r in sections.fallback_sections(a, b, d).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r["doc_id"], []).append((r["node_path"], r["title"], r["block_start"], r["block_end"]))
    assert got == want


def test_roles_of_titles(spark):
    rows = spark.createDataFrame([("methods",), ("appendix b",), ("table",), ("figures",), ("tables of men",), ("appendixes",), ("works cited",)], "t string")
    got = {r["t"]: r["r"] for r in rows.select("t", sections.role_of_title(F.col("t")).alias("r")).collect()}
    assert got == {"methods": "methods", "appendix b": "appendix", "table": "table", "figures": "figure_caption", "tables of men": None, "appendixes": None, "works cited": "references"}


def test_heading_levels_that_skip(spark):
    levels = [3, 1, 4, 4, 2, 6, 1]
    blocks = [(1, k, 10 * k, 10 * k + 8, lv, f"h{k}") for k, lv in enumerate(levels)]
    rows = sections.heading_sections(spark.createDataFrame(blocks, "doc_id int, ordinal int, char_start int, char_end int, level int, title string"), spark.createDataFrame([(1, None, 70), (2, "x", 0)], "doc_id int, title string, n_chars int"))
    got = [(r["doc_id"], r["node_path"], r["block_start"], r["block_end"]) for r in rows.orderBy("doc_id", "ordinal").collect()]
    assert got == [(1, "0", 0, 6), (1, "0.0", 0, 0), (1, "0.1", 1, 5), (1, "0.1.0", 2, 2), (1, "0.1.1", 3, 3), (1, "0.1.2", 4, 5), (1, "0.1.2.0", 5, 5), (1, "0.2", 6, 6), (2, "0", 0, -1)]
