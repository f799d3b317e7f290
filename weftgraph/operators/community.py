"""Community detection by modularity: local moving and aggregation, as joins, with size and cohesion splits.

One method at every size: no component is gathered in a task. Ties and the turns that nodes take are
decided by id and hash, so the same graph gives the same communities however it is partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.plans.graph import Graph
from weftgraph.session import discard, written

#: Levels of aggregation, and turns of a level at most: a node has its turn in every other one.
LEVELS, TURNS = 6, 16
#: Share of all nodes over which a community is split (ten nodes at least); nodes and cohesion from which a loose one is.
LARGE, LEAST, LOOSE_NODES, LOOSE = 0.25, 10, 50, 0.05


def weighted_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, w) of the unordered pairs with an edge, their weights summed."""
    return (
        edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.sum(F.coalesce("weight", F.lit(1.0)).cast("double")).alias("w"))
    )


def _moved(both: DataFrame, own: DataFrame, total: float) -> DataFrame:
    """(id, c) after local moving on (id, other, w), self-loops aside; ``own`` has (id, k), a node's weighted degree."""
    com = written(own.select("id", F.col("id").alias("c"), "k"))
    still = 0
    for turn in range(TURNS):
        sums = com.groupBy("c").agg(F.sum("k").alias("tot"))
        votes = both.join(com.select(F.col("id").alias("other"), "c"), "other").groupBy("id", "c").agg(F.sum("w").alias("w"))
        mine = com.select("id", F.col("c").alias("now"), "k").where(F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2)
        # a node may stay though no neighbour is with it
        stay = mine.select("id", F.col("now").alias("c"), F.lit(0.0).alias("w"))
        asked = votes.join(mine.select("id"), "id", "left_semi").union(stay).groupBy("id", "c").agg(F.sum("w").alias("w"))
        met = asked.join(mine, "id").join(sums, "c")
        gain = F.col("w") - (F.col("tot") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)) * F.col("k") / F.lit(total)
        best = met.groupBy("id").agg(F.min(F.struct(F.round(-gain, 9).alias("g"), (F.col("c") != F.col("now")).alias("away"), "c")).alias("m"))
        new = written(com.join(best, "id", "left").select("id", F.coalesce("m.c", "c").alias("c"), "k", F.coalesce("m.away", F.lit(False)).alias("away")))
        changed = new.where("away").count()
        discard(com)
        com = new
        still = 0 if changed else still + 1
        if still == 2:
            break
    return com.select("id", "c")


def moved(pairs: DataFrame) -> DataFrame:
    """(id, c) of the nodes of weighted pairs (a, b, w): communities named by a member."""
    links = written(pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "w").union(pairs.select("b", "a", "w")))
    total = links.agg(F.sum("w")).first()[0] or 0.0
    of = written(links.groupBy("id").agg(F.lit(None).cast("string").alias("c")).select("id", F.col("id").alias("c")))
    if not total:
        return of
    n = of.count()
    for _ in range(LEVELS):
        own = written(links.groupBy("id").agg(F.sum("w").alias("k")))
        step = written(_moved(links.where("id <> other"), own, total))
        up = step.toDF("c", "above")
        of = written(of.join(up, "c").select("id", F.col("above").alias("c")))
        left = step.select("c").distinct().count()
        if left == n:
            break
        n = left
        ends = links.join(step.toDF("id", "x"), "id").join(step.toDF("other", "y"), "other")
        links = written(ends.groupBy(F.col("x").alias("id"), F.col("y").alias("other")).agg(F.sum("w").alias("w")))
    return of


def hubs(graph: Graph, pairs: DataFrame, percentile: float) -> DataFrame:
    """(id) of nodes whose degree is over that of the given percentile of all nodes."""
    n = graph.nodes.count()
    degree = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree")))
    at = max(0, int(n * percentile / 100) - 1)
    over = F.sum("k").over(Window.orderBy(F.desc("degree")))  # a row for each distinct degree
    by = degree.groupBy("degree").agg(F.count(F.lit(1)).alias("k")).withColumn("over", over)
    limit = by.where(F.col("over") >= n - at).agg(F.max("degree")).first()[0] or 0
    return degree.where(F.col("degree") > limit).select("id")


def reattached(pairs: DataFrame, of: DataFrame, out: DataFrame) -> DataFrame:
    """(id, c) of the nodes ``out``: the community of most neighbours, ties by name."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    votes = both.join(out, "id").join(of.toDF("other", "c"), "other").groupBy("id", "c").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "c")).alias("m")).select("id", "m.c")


def detect(graph: Graph, large: float = LARGE, exclude_over: float | None = None) -> DataFrame:
    """(id, community): every node once; 0 is the largest, ties by least member; isolates are alone.

    Communities of over ``large`` of all nodes, and loose ones, are clustered anew on their own edges.
    With ``exclude_over``, a percentile, nodes of higher degree are left out and then join the community
    of most of their neighbours.
    """
    n_all = graph.nodes.count()
    pairs = written(weighted_pairs(graph.edges))
    if exclude_over is None:
        of = moved(pairs)
    else:
        out = written(hubs(graph, pairs, exclude_over))
        inner = pairs.join(out.toDF("a"), "a", "left_anti").join(out.toDF("b"), "b", "left_anti").select("a", "b", "w")
        kept = moved(inner)
        alone = graph.nodes.select("id").join(out, "id", "left_anti").join(kept.select("id"), "id", "left_anti").select("id", F.col("id").alias("c"))
        kept = written(kept.union(alone))
        of = written(kept.union(reattached(pairs, kept, out)))
    inside = written(pairs.join(of.toDF("a", "c"), "a").join(of.toDF("b", "d"), "b").where("c = d").select("a", "b", "w", "c"))
    sizes = of.groupBy("c").agg(F.count(F.lit(1)).alias("n")).join(inside.groupBy("c").agg(F.count(F.lit(1)).alias("k")), "c", "left")
    loose = (F.col("n") >= LOOSE_NODES) & (F.coalesce("k", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2) < LOOSE)
    again = written(sizes.where((F.col("n") > F.greatest(F.lit(LEAST), F.lit(n_all * large))) | loose).select("c"))
    parts = moved(inside.join(again, "c").select("a", "b", "w"))
    both = of.join(parts.toDF("id", "part"), "id", "left").select("id", F.coalesce("part", "c").alias("c"))
    every = graph.nodes.select("id").join(both, "id", "left").select("id", F.coalesce("c", "id").alias("c"))
    return numbered(written(every))


def numbered(assignment: DataFrame) -> DataFrame:
    """(id, community) of (id, c), numbered by size, then least member. One row for each community is ranked."""
    sizes = assignment.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    # communities of one size are ranked apart, and sizes by a row for each
    rank = F.row_number().over(Window.partitionBy("n").orderBy("least")) - 1
    before = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("k")).select("n", (F.sum("k").over(Window.orderBy(F.desc("n"))) - F.col("k")).alias("before"))
    sizes = sizes.withColumn("rank", rank).join(before, "n")
    number = (F.col("before") + F.col("rank")).cast("int")
    return assignment.join(sizes.select("c", number.alias("community")), "c").select("id", "community")


def modularity(graph: Graph, assignment: DataFrame) -> float:
    e = weighted_pairs(graph.edges)
    both = e.join(assignment.toDF("a", "ca"), "a").join(assignment.toDF("b", "cb"), "b")
    m = both.agg(F.sum("w")).first()[0] or 0.0
    if not m:
        return 0.0
    inside = both.where("ca = cb").agg(F.sum("w")).first()[0] or 0.0
    ends = both.select(F.col("ca").alias("c"), "w").union(both.select("cb", "w")).groupBy("c").agg(F.sum("w").alias("d"))
    return inside / m - (ends.agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0.0) / (4 * m * m)
