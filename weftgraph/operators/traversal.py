"""Frontier traversals: bounded BFS and DFS, impact, shortest paths, cycles, components.

Each hop is a join of the frontier with the edges and an anti-join with what was visited. Hops are
bounded by a parameter; between hops the frontier is written to the shared folder.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.plans.graph import Graph, neighbours, pairs
from weftgraph.session import discard, small, written

# Relations along which a change has effects.
IMPACT = (
    "calls", "indirect_call", "references", "imports", "imports_from", "dynamic_import", "re_exports", "inherits", "extends", "implements", "uses",
    "mixes_in", "embeds", "requires",
)


#: Rows (an id of some 20 bytes and a number) up to which a frontier or a list of hubs is broadcast.
BROADCAST_ROWS = 200_000


def degrees_of(near: DataFrame) -> DataFrame:
    """(id, degree) from distinct unordered pairs (a, b), of nodes with an edge; a self-loop counts two."""
    return near.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hub_threshold(nodes: DataFrame, degree: DataFrame) -> int:
    """Degree from which nodes are not walked through: the 99th percentile by rank, 50 at least; nodes without edges rank first."""
    n = nodes.count()
    by_degree = degree.join(nodes.select("id"), "id", "left_semi").groupBy("degree").agg(F.count(F.lit(1)).alias("k"))
    above = F.sum("k").over(Window.orderBy(F.desc("degree")))  # a row for each distinct degree
    row = by_degree.withColumn("above", above).where(F.col("above") >= n - int(n * 0.99)).agg(F.max("degree")).first()
    return max(50, row[0] or 0)


def bfs(graph: Graph, seeds: list[str], depth: int = 2, directed: bool = False) -> DataFrame:
    """(id, hop) of nodes within ``depth``; hubs are reached but not walked through, seeds excepted.

    Pairs are written once, and degrees and hops read them; a frontier within bounds is broadcast, so
    a hop is a scan of the pairs without a shuffle of them.
    """
    return _walked(graph, seeds, depth, directed)[0]


def _walked(graph: Graph, seeds: list[str], depth: int, directed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """What ``bfs`` finds, and the pairs, degrees and threshold of hubs that it has written on its way."""
    spark = graph.nodes.sparkSession
    near = written(pairs(graph.edges))
    degree = written(degrees_of(near))
    limit = hub_threshold(graph.nodes, degree)
    steps = written(graph.edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()) if directed else near.where("a <> b")
    front = spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "id string")
    seen = written(graph.nodes.select("id").join(F.broadcast(front), "id", "left_semi").distinct().withColumn("hop", F.lit(0)))  # the seeds
    for hop in range(1, depth + 1):
        front = seen.where(F.col("hop") == hop - 1).select("id")
        if hop > 1:
            front = front.join(degree.where(F.col("degree") >= limit).select("id"), "id", "left_anti")
        front = small(written(front), BROADCAST_ROWS)
        out = steps.join(front, F.col("a") == F.col("id")).select(F.col("b").alias("id"))
        if not directed:
            out = out.union(steps.join(front, F.col("b") == F.col("id")).select(F.col("a").alias("id")))
        new = out.distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(hop))
        seen = written(seen.union(new))
    return seen, near, degree, limit


def induced_edges(graph: Graph, visited: DataFrame) -> DataFrame:
    """Edges with both ends among the visited, without self-loops."""
    ids = visited.select("id")
    e = graph.edges.where("src <> dst")
    return e.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")


def dfs(graph: Graph, seeds: list[str], depth: int = 2, most: int = 50_000) -> list[str]:
    """Visit order of a bounded DFS over sorted neighbours. The order is sequential, so it walks on the
    driver, over the bounded subgraph that BFS finds; more than ``most`` nodes are refused."""
    visited, every, degree, limit = _walked(graph, seeds, depth)
    if visited.count() > most:
        raise ValueError("subgraph too large for an ordered walk")
    of = {r["id"]: r["degree"] for r in degree.join(visited, "id", "left_semi").collect()}
    near: dict[str, list[str]] = {}
    ids = F.broadcast(visited.select("id"))  # at most ``most``
    inside = every.where("a <> b").join(ids.toDF("a"), "a", "left_semi").join(ids.toDF("b"), "b", "left_semi").select("a", "b")
    for r in inside.union(inside.select("b", "a")).orderBy("a", "b").collect():
        near.setdefault(r["a"], []).append(r["b"])
    seen: dict[str, None] = {}
    stack = [(s, 0) for s in reversed(seeds)]
    while stack:
        node, d = stack.pop()
        if node in seen or d > depth:
            continue
        seen[node] = None
        if node in seeds or of.get(node, 0) < limit:
            stack += [(x, d + 1) for x in reversed(near.get(node, [])) if x not in seen]
    return list(seen)


def affected(graph: Graph, seed: str, depth: int = 2, relations: tuple[str, ...] = IMPACT) -> DataFrame:
    """(id, hop, relation): what depends on a node, by reverse steps; its members start with it.

    Of several edges that reach a node in one hop the least relation, then source, is named.
    """
    spark = graph.nodes.sparkSession
    back = written(graph.edges.where(F.col("relation").isin(*relations)).select("src", "dst", "relation").distinct())
    members = graph.edges.where((F.col("src") == seed) & F.col("relation").isin("method", "contains")).select(F.col("dst").alias("id"))
    start = spark.createDataFrame([(seed,)], "id string").union(members).distinct()
    seen = written(start.select("id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("relation")))
    for hop in range(1, depth + 1):
        front = seen.where(F.col("hop") == hop - 1).select(F.col("id").alias("dst"))
        new = back.join(front, "dst").groupBy(F.col("src").alias("id")).agg(F.min("relation").alias("relation")).join(seen.select("id"), "id", "left_anti")
        seen = written(seen.union(new.select("id", F.lit(hop), "relation")))
    return seen.where("hop > 0")


def shortest_path(graph: Graph, source: str, target: str, directed: bool = True, max_hops: int = 8) -> list[str]:
    """The shortest path, of several the least by ids; empty if there is none within ``max_hops``.

    Levels grow from both ends, the smaller one first, until they meet; of the nodes between, the least
    id on a shortest path follows at each step. Edges are written once, and a level within bounds is broadcast.
    """
    spark = graph.nodes.sparkSession
    if graph.nodes.where(F.col("id") == source).isEmpty():
        return []
    steps = written(graph.edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    one = lambda x: spark.createDataFrame([(x,)], "id string")

    def near(front: DataFrame, back: bool = False) -> DataFrame:
        ways = [("b", "a") if back else ("a", "b")] if directed else [("a", "b"), ("b", "a")]
        found = [steps.join(front, F.col(x) == F.col("id")).select(F.col(y).alias("id")) for x, y in ways]
        return found[0] if directed else found[0].union(found[1])

    fore, aft, size = [F.broadcast(one(source))], [F.broadcast(one(target))], {False: 1, True: 1}
    while (middle := fore[-1].join(aft[-1], "id", "left_semi")).isEmpty():
        if len(fore) + len(aft) - 2 >= max_hops:
            return []
        back = size[True] < size[False]
        side = aft if back else fore
        new = near(side[-1], back).distinct()
        for level in side[-2:] if not directed else side:
            new = new.join(level, "id", "left_anti")
        new = written(new)
        size[back] = new.count()
        if not size[back]:
            return []
        side.append(small(new, BROADCAST_ROWS))
    between = [small(written(middle), BROADCAST_ROWS)]
    for level in fore[-2:0:-1]:
        between.insert(0, small(written(level.join(near(between[0], True).distinct(), "id", "left_semi")), BROADCAST_ROWS))
    path = [source]
    for level in (between if len(fore) > 1 else []) + aft[-2::-1]:
        path.append(near(F.broadcast(one(path[-1]))).join(level, "id", "left_semi").agg(F.min("id")).first()[0])
    discard(steps)
    return path


def import_cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """(length, cycle) of simple cycles among (src, dst), each from its least member; up to five long."""
    e = written(edges.where("src <> dst").select("src", "dst").distinct())
    walk = e.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    found = None
    for k in range(2, longest + 1):
        first = F.element_at("path", 1)
        closed = walk.join(e, (F.col("at") == F.col("src")) & (F.col("dst") == first)).select(F.lit(k).alias("length"), "path")
        found = closed if found is None else found.union(closed)
        if k < longest:
            step = walk.join(e, (F.col("at") == F.col("src")) & (F.col("dst") > first)).where(~F.array_contains("path", F.col("dst")))
            walk = written(step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))
    return found.select("length", F.array_join("path", " -> ").alias("cycle"))


#: Links (two numbers each) up to which the rest of a contraction is done on the driver.
DRIVER_LINKS = 200_000


def _united(links: DataFrame) -> DataFrame:
    """(id, to) from a few links (a, b): union-find on the driver."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for a, b in links.collect():
        x, y = root(a), root(b)
        above[max(x, y)] = min(x, y)
    return links.sparkSession.createDataFrame([(x, root(x)) for x in list(above)], "id bigint, to bigint")


def _contracted(links: DataFrame) -> DataFrame:
    """(id, to) of the ends of links (a, b), numbers: ``to`` is one end for each component.

    A round lets each end choose the least of itself and its neighbours, in another order each round,
    and goes on with the links between those chosen, so that ends get fewer by a factor.
    """
    steps, rounds, own = [], random.Random(7), False
    while links.count() > DRIVER_LINKS:
        order = lambda c, m=rounds.getrandbits(63): F.col(c).bitwiseXOR(F.lit(m))
        both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("b", "a"))
        least = F.least(F.min(order("other")), order("id"))
        step = written(both.groupBy("id").agg(least.alias("to")).select("id", order("to").alias("to")))
        ends = links.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y")
        left = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if own:
            discard(links)
        links, own = left, True
        steps.append(step)
    out = _united(links)
    for i, step in enumerate(reversed(steps)):
        up = out.toDF("to", "above")
        out = written(step.join(F.broadcast(up) if i == 0 else up, "to", "left").select("id", F.coalesce("above", "to").alias("to")))
        discard(step)
    return out


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component), the component's least id among the nodes, by contraction of links between numbers.

    Ids go by 64-bit hashes, with a seed that tells all nodes apart. Where nodes have many links, the
    first and last neighbour of each are contracted first; of the other links only those count that do
    not lie inside the largest part.
    """
    ids = written(nodes.select("id").where("id IS NOT NULL").distinct())
    n, seed = ids.count(), 0
    while ids.select(F.xxhash64("id", F.lit(seed)).alias("k")).distinct().count() < n:
        seed += 1
    key = lambda c, name: F.xxhash64(c, F.lit(seed)).alias(name)
    links = written(edges.where("src <> dst").select(key("src", "a"), key("dst", "b")))
    if links.count() <= max(DRIVER_LINKS, 3 * n):
        of = _contracted(links)
    else:
        both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("b", "a"))
        ends = both.groupBy("id").agg(F.min("other").alias("x"), F.max("other").alias("y"))
        part = written(ends.select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array("x", "y"))).alias("b")))
        of = _contracted(part)
        discard(part)
        top = of.groupBy("to").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "to").first()
        apart = of.where(F.col("to") != top["to"]).select("id")
        k = apart.count()
        if k:
            there = lambda c: links.join(F.broadcast(apart), F.col(c) == F.col("id"), "left_semi")
            rest = links if k > BROADCAST_ROWS else there("a").union(there("b"))
            between = rest.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            more = _contracted(written(between.distinct()))
            of = of.join(more.toDF("to", "above"), "to", "left").select("id", F.coalesce("above", "to").alias("to"))
    named = ids.select("id", key("id", "k")).join(of.toDF("k", "to"), "k", "left").select("id", F.coalesce("to", "k").alias("to"))
    least = small(written(named.groupBy("to").agg(F.min("id").alias("component"))), BROADCAST_ROWS)
    out = written(named.join(least, "to").select("id", "component"))
    discard(links)
    discard(ids)
    return out


def betweenness(graph: Graph, pivots: int = 100, exact_up_to: int = 1000) -> DataFrame:
    """(id, betweenness): Brandes from each pivot, all pivots at once; every node is one up to ``exact_up_to`` nodes.

    Pivots are those of least hash. A level forwards counts shortest paths to the nodes that it reaches
    first, a level backwards sums what depends on them: joins of (pivot, node) rows with the edges, a
    row for each node that a pivot reaches, whatever the size of the graph.
    """
    ids = graph.nodes.select("id").distinct()
    n = ids.count()
    k = n if n <= exact_up_to else min(pivots, n)
    near = written(neighbours(graph.edges).join(ids, "id", "left_semi").join(ids.toDF("other"), "other", "left_semi").select("id", "other"))
    start = ids.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(k)
    levels = [written(start.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths")))]
    seen = levels[0].select("s", "id")
    while True:
        ahead = levels[-1].join(near, "id").select("s", F.col("other").alias("id"), "paths")
        new = written(ahead.join(seen, ["s", "id"], "left_anti").groupBy("s", "id").agg(F.sum("paths").alias("paths")))
        if new.isEmpty():
            break
        levels.append(new)
        # a node's neighbours are at its own level, the one before or the one after
        seen = levels[-1].select("s", "id").union(levels[-2].select("s", "id"))
    sums, below = None, None
    for i in range(len(levels) - 1, 0, -1):
        level = levels[i].withColumn("dep", F.lit(0.0)) if below is None else levels[i].join(below, ["s", "id"], "left").fillna(0.0, ["dep"])
        level = written(level)
        one = level.groupBy("id").agg(F.sum("dep").alias("x"))
        sums = one if sums is None else sums.union(one)
        back = level.join(near, "id").select("s", F.col("other").alias("id"), ((1 + F.col("dep")) / F.col("paths")).alias("share"))
        below = written(back.join(levels[i - 1], ["s", "id"]).groupBy("s", "id").agg((F.sum("share") * F.first("paths")).alias("dep")))
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 and k else 0.0
    if sums is None:
        return ids.select("id", F.lit(0.0).alias("betweenness"))
    whole = sums.groupBy("id").agg(F.sum("x").alias("x"))
    return ids.join(whole, "id", "left").select("id", (F.coalesce("x", F.lit(0.0)) * scale).alias("betweenness"))
