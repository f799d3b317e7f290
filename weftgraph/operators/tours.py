"""Walks for readers: call flows, guided tours of communities, class diagrams.

These are short reports over small summaries: a row for each community or caller, limited by their parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators import analytics as A
from weftgraph.plans.graph import Graph


def call_flow(graph: Graph, start: str, steps: int = 12) -> list[str]:
    """A walk along calls, each time to the callee of best score that was not seen; configuration and entry files count half."""
    score = A.learn_scores(graph).select("id", "score").join(graph.nodes.select("id", "source_file"), "id")
    weak = F.lower("source_file").rlike(r"(^|/)(config|settings|app|main|index|__init__)\.[^/]*$")
    rated = score.select(F.col("id").alias("dst"), F.when(weak, F.col("score") / 2).otherwise(F.col("score")).alias("s"))
    calls = graph.edges.where("relation IN ('calls', 'uses', 'method', 'indirect_call')").select("src", "dst").distinct().join(rated, "dst")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("s"), "dst"))
    best = calls.withColumn("r", rank).where(F.col("r") <= steps + 1)
    walk = [start]
    while len(walk) <= steps:
        nxt = best.where((F.col("src") == walk[-1]) & ~F.col("dst").isin(walk)).orderBy("r").select("dst").first()
        if not nxt:
            break
        walk.append(nxt[0])
    return walk


def flow_seeds(graph: Graph, n: int = 5) -> DataFrame:
    """Starts of flows: nodes that call more than they are called, by score."""
    return A.learn_scores(graph).where("fan_out > fan_in").orderBy(F.desc("score"), "id").limit(n).select("id", "score")


def tour(graph: Graph, most: int = 15) -> list[int]:
    """Communities in the order of their dependencies, what is depended on first; cycles go last, by score."""
    deps = {}
    for r in A.domain_tour(graph).collect():  # a row for each pair of communities
        deps.setdefault(r["from_community"], set()).add(r["to_community"])
    total = {r["community"]: r["s"] for r in A.learn_scores(graph).join(graph.nodes.select("id", "community"), "id").groupBy("community").agg(F.sum("score").alias("s")).collect()}
    left, out = {c: set(deps.get(c, ())) & set(total) for c in total}, []
    while ready := sorted(c for c, d in left.items() if not d):
        out.append(ready[0])
        del left[ready[0]]
        for d in left.values():
            d.discard(ready[0])
    out += sorted(left, key=lambda c: (total[c], c))
    keep = set(sorted(out, key=lambda c: (-total[c], c))[:most])
    return [c for c in out if c in keep]


def class_diagram(graph: Graph, most: int = 40) -> str:
    """Inheritance, implementation and containment between classes as Mermaid text."""
    arrow = F.when(F.col("relation").isin("inherits", "extends"), "<|--").when(F.col("relation") == "implements", "<|..").otherwise("o--")
    e = graph.edges.where("relation IN ('inherits', 'extends', 'implements', 'embeds', 'mixes_in')")
    names = graph.nodes.select("id", F.regexp_replace("label", r"[^\w]", "_").alias("n"))
    rows = e.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").select("a", "b", arrow.alias("arrow")).distinct().orderBy("b", "a").limit(most).collect()
    return "\n".join(["classDiagram", *(f"  {r['b']} {r['arrow']} {r['a']}" for r in rows)])


def suggested_questions(graph: Graph, n: int = 7) -> DataFrame:
    """(kind, subject, why): ambiguous edges, inferred hubs, isolated entities and loose communities worth a question."""
    amb = graph.edges.where("confidence = 'AMBIGUOUS'").orderBy("src", "dst", "relation").limit(n).select(F.lit("ambiguous").alias("kind"), F.concat_ws(" ", "src", "relation", "dst").alias("subject"), F.lit("the relation is uncertain").alias("why"))
    inferred = graph.edges.where("confidence = 'INFERRED'").select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    hubs = A.god_nodes(graph, 5).join(inferred, "id").where("k >= 2").select(F.lit("verify"), F.col("label"), F.concat(F.col("k").cast("string"), F.lit(" inferred relations")))
    alone = A.isolated(graph).orderBy("id").limit(3).select(F.lit("isolated"), F.col("label"), F.lit("nothing else connects to it"))
    loose = A.cohesion(graph).where("cohesion < 0.15 AND n_nodes >= 5").orderBy("cohesion", "community").limit(3).select(F.lit("split"), F.concat(F.lit("community "), F.col("community").cast("string")), F.lit("its parts are loosely connected"))
    return amb.union(hubs).union(alone).union(loose).limit(n)
