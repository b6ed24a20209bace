"""Graph operators over edges (source, target, id): neighbourhoods, paths and metrics.

Each hop is a join of the frontier with the edges, stored before the next, so that plans stay shallow and a hop that
is lost is made again from the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import temporal
from factloom.functions.checkpoint import cut
from factloom.plans.views import Views
from factloom.sources.spine import numbered


def edges_of(views: Views, valid_at: str | None = None, believed_at: str | None = None) -> DataFrame:
    """(id, source, target, predicate): edges that hold now, or at two instants; one instant alone is an error."""
    if (valid_at is None) != (believed_at is None):
        raise ValueError("give both clocks or neither")
    if valid_at is None:
        rows = views.graph_edges_current
    else:
        rows = views.graph_edges_visible_history.where(temporal.believed(temporal.instant(believed_at)) & temporal.holds(temporal.instant(valid_at)))
    return rows.select(F.col("relation_id").alias("id"), F.col("subject_entity_id").alias("source"), F.col("object_entity_id").alias("target"), "predicate")


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, a, b): each edge in both directions; a loop once."""
    forth = edges.select("id", F.col("source").alias("a"), F.col("target").alias("b"))
    return forth.unionByName(edges.where("source <> target").select("id", F.col("target").alias("a"), F.col("source").alias("b")))


def neighborhood(edges: DataFrame, start: str, hops: int = 2, limit: int | None = 500) -> DataFrame:
    """(node, hops): nodes within hops of start by undirected shortest paths, nearest first."""
    steps = both_ways(edges)
    frontier = edges.sparkSession.createDataFrame([(start,)], "node string")
    seen = cut(frontier.withColumn("hops", F.lit(0)))
    for hop in range(1, min(max(hops, 1), 30) + 1):
        nearest = steps.join(seen.where(F.col("hops") == hop - 1).select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        new = cut(nearest.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(new)
        if new.isEmpty():
            break
    out = seen.where("hops > 0").orderBy("hops", "node")
    return out if limit is None else out.limit(limit)


def walks(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(hop, relations, nodes): all simple walks from start up to depth; none takes an edge or a node twice."""
    steps = both_ways(edges)
    now = cut(edges.sparkSession.createDataFrame([(0, [], [start])], "hop int, relations array<string>, nodes array<string>"))
    out = None
    for hop in range(1, depth + 1):
        last = now.withColumn("a", F.element_at("nodes", -1))
        now = cut(last.join(steps, "a").where(~F.array_contains("relations", F.col("id")) & ~F.array_contains("nodes", F.col("b"))).select(F.lit(hop).alias("hop"), F.concat("relations", F.array("id")).alias("relations"), F.concat("nodes", F.array("b")).alias("nodes")))
        out = now if out is None else out.unionByName(now)
        if now.isEmpty():
            break
    return out


def graph_neighborhood(edges: DataFrame, start: str, depth: int = 2, cap: int = 100) -> DataFrame:
    """Last edges of all simple walks: (path_id, hop, from_entity_id, to_entity_id, relation_id), by (hop, relation, to)."""
    depth, cap = min(max(depth, 1), 4), min(max(cap, 1), 500)
    rows = walks(edges, start, depth).select("hop", F.element_at("nodes", -2).alias("from_entity_id"), F.element_at("nodes", -1).alias("to_entity_id"), F.element_at("relations", -1).alias("relation_id"))
    order = ["hop", "relation_id", "to_entity_id", "from_entity_id"]
    return rows.orderBy(*order).limit(cap).withColumn("path_id", F.row_number().over(Window.orderBy(*order)))


def simple_paths(edges: DataFrame, start: str, end: str, depth: int) -> DataFrame:
    """(relations, nodes) of all simple paths from start that end at end. Half of each is walked from either side."""
    first, second = (depth + 1) // 2, depth // 2
    zero = edges.sparkSession.createDataFrame([(0, [], [start])], "hop int, relations array<string>, nodes array<string>")
    there = zero.unionByName(walks(edges, start, first))
    direct = there.where((F.col("hop") > 0) & (F.element_at("nodes", -1) == end)).select("relations", "nodes")
    if not second:
        return direct
    back = walks(edges, end, second).select(F.col("hop").alias("hop2"), F.reverse("relations").alias("relations2"), F.reverse("nodes").alias("nodes2"))
    # a longer path has its first half at full length, so that it is met once
    half = there.where((F.col("hop") == first) & ~F.array_contains("nodes", F.lit(end))).withColumn("mid", F.element_at("nodes", -1))
    met = half.join(back.withColumn("mid", F.element_at("nodes2", 1)), "mid").where(F.size(F.array_intersect("nodes", "nodes2")) == 1)
    return direct.unionByName(met.select(F.concat("relations", "relations2").alias("relations"), F.concat("nodes", F.slice("nodes2", 2, 1000)).alias("nodes")))


def graph_path(edges: DataFrame, start: str, end: str, depth: int = 4, paths: int = 3, edge_cap: int = 500) -> DataFrame:
    """Steps of the shortest simple paths: (path_id, path_position, from_entity_id, to_entity_id, relation_id).

    Paths are ordered by length and relations; the first ones stay, as long as whole paths fit the cap on edges.
    """
    depth, paths, edge_cap = min(max(depth, 1), 6), min(max(paths, 1), 10), min(max(edge_cap, 1), 500)
    first = simple_paths(edges, start, end, depth).withColumn("length", F.size("relations")).orderBy("length", "relations").limit(paths)
    order = Window.orderBy("length", "relations")
    kept = first.withColumns({"path_id": F.row_number().over(order), "edges": F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))}).where(F.col("edges") <= edge_cap)
    steps = kept.select("path_id", "nodes", F.posexplode("relations").alias("at", "relation_id"))
    return steps.select("path_id", (F.col("at") + 1).alias("path_position"), F.col("nodes")[F.col("at")].alias("from_entity_id"), F.col("nodes")[F.col("at") + 1].alias("to_entity_id"), "relation_id")


def shortest_path(edges: DataFrame, start: str, end: str, max_hops: int = 4) -> DataFrame:
    """(length, relations, nodes) of the shortest undirected path, the least by relations among equals; no row if none."""
    found = simple_paths(edges, start, end, min(max(max_hops, 1), 30)).withColumn("length", F.size("relations"))
    return found.orderBy("length", "relations").limit(1).select("length", "relations", "nodes")


def citation_path(crossrefs: DataFrame, start: str, end: str, max_hops: int = 6) -> DataFrame:
    """(length, nodes) of the shortest directed path over document references, the least by nodes among equals."""
    links = crossrefs.select(F.col("from_doc_id").alias("a"), F.col("to_doc_id").alias("b")).distinct()
    now = crossrefs.sparkSession.createDataFrame([([start],)], "nodes array<string>")
    out = now.where(F.lit(start == end))
    for _ in range(max_hops):
        step = now.withColumn("a", F.element_at("nodes", -1)).join(links, "a").where(~F.array_contains("nodes", F.col("b"))).select(F.concat("nodes", F.array("b")).alias("nodes"))
        # one way to each node is enough: the least of the shortest
        now = cut(step.groupBy(F.element_at("nodes", -1).alias("b")).agg(F.min("nodes").alias("nodes")).select("nodes"))
        out = out.unionByName(now.where(F.element_at("nodes", -1) == end))
        if now.isEmpty():
            break
    return out.select((F.size("nodes") - 1).alias("length"), "nodes").orderBy("length", "nodes").limit(1)


def simple_graph(edges: DataFrame) -> DataFrame:
    """(a, b): distinct undirected neighbours, both ways, without loops."""
    return both_ways(edges).where("a <> b").select("a", "b").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): ends of edges at each node."""
    return edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) by power iteration along edge directions; what nodes without a way out hold is shared by all."""
    links = cut(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    out = links.groupBy("a").agg(F.count("*").alias("ways"))
    nodes = cut(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(out.withColumnRenamed("a", "node"), "node", "left"))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(iterations):
        loose = ranks.where("ways IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        gained = links.join(ranks.select(F.col("node").alias("a"), (F.col("rank") / F.col("ways")).alias("share")), "a").groupBy(F.col("b").alias("node")).agg(F.sum("share").alias("in"))
        base = (1 - damping) / n + damping * loose / n
        ranks = cut(nodes.join(gained, "node", "left").withColumn("rank", base + damping * F.coalesce("in", F.lit(0.0))).drop("in"))
    return ranks.select("node", "rank")


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each reaches, by large-star and small-star rounds on stored tables. Nodes go
    by their numbers in the order of ids, so that rounds move whole numbers and no ids."""
    pairs = edges.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct()
    nodes = cut(numbered(edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct(), "node"))
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("rank").alias(f"_{end}"))
    now = cut(pairs.join(of("u"), "u").join(of("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")))
    before = None
    while True:
        around = now.union(now.select("v", "u"))
        least = cut(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            placed = nodes.join(now, nodes["rank"] == F.col("u"), "left").select("node", F.coalesce("v", "rank").alias("rank"))
            return placed.join(nodes.select(F.col("node").alias("component"), "rank"), "rank").select("node", "component")
        before = mark


def core_numbers(edges: DataFrame) -> DataFrame:
    """(node, core): the largest k for which the node is in a subgraph of degrees k and more.

    Each node's number falls to the h-index of its neighbours' numbers until none falls; it starts at the degree.
    """
    links = cut(simple_graph(edges))
    now = cut(links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("core")))
    while True:
        seen = links.join(now.select(F.col("node").alias("b"), F.col("core").alias("c")), "b")
        counted = seen.groupBy("a", "c").agg(F.count("*").alias("n"))
        at_least = counted.withColumn("reach", F.sum("n").over(Window.partitionBy("a").orderBy(F.desc("c"))))
        h = at_least.groupBy(F.col("a").alias("node")).agg(F.max(F.least("c", "reach")).alias("h"))
        stepped = cut(now.join(h, "node").select("node", F.least("core", "h").alias("core"), (F.col("h") < F.col("core")).alias("fell")))
        now = stepped.drop("fell")
        if stepped.where("fell").isEmpty():
            return now


#: Modularity that a round or level of communities has to add; less is taken for none.
LEAST_GAIN = 1e-4


def modularity(links: DataFrame, placed: DataFrame, m2: float) -> float:
    """Of communities (node, community) over links (a, b, w), both ways, loops too, whose weights add up to m2."""
    both = links.join(placed.select(F.col("node").alias("a"), F.col("community").alias("c")), "a").join(placed.select(F.col("node").alias("b"), F.col("community").alias("d")), "b")
    each = both.groupBy("c").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("c") == F.col("d"), F.col("w")).otherwise(0.0)).alias("inside"))
    return each.agg(F.coalesce(F.sum(F.col("inside") / m2 - F.pow(F.col("total") / m2, 2)), F.lit(0.0))).first()[0]


def local_moves(links: DataFrame, m2: float, least_gain: float = LEAST_GAIN) -> tuple[DataFrame, float]:
    """(node, community), modularity: nodes move to the neighbouring community of the highest gain until a round of both
    halves of the nodes, by hashes, adds no modularity; the best state is kept."""
    weights = cut(links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")))
    best, now, r = cut(weights.select("node", F.col("node").alias("community"))), weights.withColumn("community", F.col("node")), 0
    score = modularity(links, best, m2)
    while True:
        for half in (0, 1):
            totals = now.groupBy("community").agg(F.sum("k").alias("total"))
            near = links.where("a <> b").join(now.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("inside"))
            own = now.select("node", "k", F.col("community").alias("own"))
            offers = near.unionByName(now.select("node", "community", F.lit(0.0).alias("inside"))).groupBy("node", "community").agg(F.sum("inside").alias("inside"))
            judged = offers.join(own, "node").join(totals, "community")
            rest = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0)
            gain = F.col("inside") - F.col("k") * rest / F.lit(float(m2))
            # ties stay with the own community, then go to the least
            chosen = judged.groupBy("node", "k", "own").agg(F.min_by("community", F.struct(-F.round(gain, 9), F.col("community") != F.col("own"), "community")).alias("best"))
            moves = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == half  # other halves in each round, so that no two keep changing places
            now = cut(chosen.select("node", "k", F.when(moves, F.col("best")).otherwise(F.col("own")).alias("community")))
        r += 1
        reached = modularity(links, now, m2)
        if reached <= score + least_gain:
            return best, score
        best, score = now.select("node", "community"), reached


def communities(edges: DataFrame) -> DataFrame:
    """(node, community) by Louvain's method: local moves, then the communities as nodes of a graph of their own, again and
    again until that adds no modularity. A community is named by its least node."""
    links = cut(simple_graph(edges).withColumn("w", F.lit(1.0)))
    m2 = links.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    members = links.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct()
    if not m2:
        return members
    score = None
    while True:
        placed, reached = local_moves(links, m2)
        if score is not None and reached <= score + LEAST_GAIN:
            break
        score = reached
        placed = cut(placed)
        members = cut(members.join(placed.select(F.col("node").alias("community"), F.col("community").alias("into")), "community").select("node", F.col("into").alias("community")))
        of = lambda end, name: placed.select(F.col("node").alias(end), F.col("community").alias(name))  # noqa: B023, E731
        links = cut(links.join(of("a", "x"), "a").join(of("b", "y"), "b").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")))
    named = members.groupBy("community").agg(F.min("node").alias("id"))
    return members.join(named, "community").select("node", F.col("id").alias("community"))
