"""Sinks: node-link JSON, Cypher, GraphML, Obsidian notes, and text of reports and articles.

Scripts are rendered as rows of text in the plan and written by ``DataFrame.write.text``; single
documents are for graphs that fit one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.graph import Graph


def _quoted(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), "'", r"\\'"), r"[\x00-\x1f]", " ")


def _name(c: Column, default: str) -> Column:
    n = F.regexp_replace(c, r"[^A-Za-z0-9_]", "")
    return F.when(n.rlike("^[A-Za-z]"), n).otherwise(default)


def cypher(graph: Graph) -> DataFrame:
    """(kind, value): a MERGE statement for each node and edge."""
    kind = _name(F.initcap(F.coalesce("file_type", F.lit("unknown"))), "Entity")
    n = graph.nodes.select(F.lit("node").alias("kind"), F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: '"), _quoted(F.col("id")), F.lit("', label: '"), _quoted(F.coalesce("label", "id")), F.lit("'});")).alias("value"))
    rel = _name(F.upper(F.coalesce("relation", F.lit("RELATES_TO"))), "RELATES_TO")
    e = graph.edges.select(F.lit("edge"), F.concat(
        F.lit("MATCH (a {id: '"), _quoted(F.col("src")), F.lit("'}), (b {id: '"), _quoted(F.col("dst")), F.lit("'}) MERGE (a)-[:"), rel,
        F.lit(" {confidence: '"), _quoted(F.coalesce("confidence", F.lit("EXTRACTED"))), F.lit("'}]->(b);"),
    ))
    return n.union(e)


def _xml(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def graphml(graph: Graph) -> DataFrame:
    """(part, key, value): lines of a GraphML document, in the order of part and key."""
    spark = graph.nodes.sparkSession
    keys = [("node", k) for k in ("label", "file_type", "source_file", "community")] + [("edge", k) for k in ("relation", "confidence")]
    head = '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "\n".join(
        f'<key id="{of[0]}_{k}" for="{of}" attr.name="{k}" attr.type="string"/>' for of, k in keys
    )
    data = lambda of, k: F.concat(F.lit(f'<data key="{of[0]}_{k}">'), _xml(F.col(k)), F.lit("</data>"))
    n = graph.nodes.select(F.lit(1), F.col("id"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), *[data(o, k) for o, k in keys if o == "node"], F.lit("</node>")))
    e = graph.edges.select(F.lit(2), F.concat_ws("|", "src", "dst", "relation"), F.concat(
        F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('">'), *[data(o, k) for o, k in keys if o == "edge"], F.lit("</edge>"),
    ))
    frame = spark.createDataFrame([(0, "", head + '\n<graph edgedefault="directed">'), (3, "", "</graph>\n</graphml>")], "part int, key string, value string")
    return frame.union(n).union(e)


def notes(graph: Graph) -> DataFrame:
    """(name, body): a note with front matter and wiki links for each node."""
    name = F.regexp_replace(F.coalesce("label", "id"), r'[\\/:*?"<>|#^\[\]]', "_")
    names = graph.nodes.select("id", F.when(F.count(F.lit(1)).over(_by(name)) > 1, F.concat(name, F.lit("_"), F.substring(F.md5("id"), 1, 6))).otherwise(name).alias("name"))
    links = graph.edges.join(names.toDF("dst", "to"), "dst").groupBy("src").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), F.col("relation"), F.lit(" [["), F.col("to"), F.lit("]]")))), "\n").alias("links"))
    j = graph.nodes.join(names, "id").join(links.withColumnRenamed("src", "id"), "id", "left")
    return j.select("name", F.concat(F.lit("---\nsource_file: "), F.coalesce("source_file", F.lit("")), F.lit("\ncommunity: "), F.coalesce(F.col("community").cast("string"), F.lit("")), F.lit("\n---\n\n# "), F.coalesce("label", "id"), F.lit("\n\n"), F.coalesce("links", F.lit(""))).alias("body"))


def _by(c: Column):
    from pyspark.sql.window import Window

    return Window.partitionBy(c)


def node_link(graph: Graph) -> str:
    """One node-link JSON document, sorted, for graphs that fit the driver; larger ones are written as rows by ``write``."""
    n = [r.asDict() for r in graph.nodes.orderBy("id").collect()]
    e = [{"source": r["src"], "target": r["dst"], **{k: v for k, v in r.asDict().items() if k not in ("src", "dst")}} for r in graph.edges.orderBy("src", "dst", "relation").collect()]
    return json.dumps({"directed": True, "multigraph": False, "graph": {}, "nodes": n, "links": e}, sort_keys=True, default=str)


def write(graph: Graph, path: str) -> None:
    """Nodes and edges as Parquet."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def mermaid(edges: DataFrame, most: int = 60) -> str:
    """A flowchart of the best edges (src, dst, relation, rank_score, included)."""
    rows = edges.where("included").orderBy(F.desc("rank_score"), "src", "dst", "relation").limit(most).collect()
    ids = {n: f"n{i}" for i, n in enumerate(sorted({x for r in rows for x in (r["src"], r["dst"])}))}
    text = lambda s: s.replace('"', "'")
    return "\n".join(["flowchart LR", *(f'  {i}["{text(n)}"]' for n, i in ids.items()), *(f"  {ids[r['src']]} -->|{r['relation']}| {ids[r['dst']]}" for r in rows)])


def report(graph: Graph) -> str:
    """A short report: sizes, confidence, most connected entities, surprises."""
    from weftgraph.operators import analytics as A

    s, r = A.graph_stats(graph).first(), A.report_summary(graph).first()
    lines = ["# Graph report", "", f"{s['n_nodes']} nodes, {s['n_edges']} edges, {s['n_communities']} communities", "",
             f"{s['pct_extracted']} % extracted, {s['pct_inferred']} % inferred, {s['pct_ambiguous']} % ambiguous", "", "## Most connected", ""]
    lines += [f"- {x['label']} ({x['degree']})" for x in A.god_nodes(graph).collect()]
    lines += ["", "## Surprising connections", ""] + [f"- {x['src']} {x['relation']} {x['dst']} ({x['confidence']})" for x in A.surprises(graph).collect()]
    lines += ["", f"{r['n_ambiguous']} ambiguous edges, {r['n_thin']} thin communities, {r['n_isolated']} isolated entities"]
    return "\n".join(lines)


def article(graph: Graph, community: int) -> str:
    """An article on one community: its name, size, links and members of highest degree."""
    from weftgraph.operators import analytics as A

    name = A.hub_labels(graph).where(F.col("community") == community).first()
    top = A.with_degree(graph).where(F.col("community") == community).orderBy(F.desc("degree"), "id").limit(20).collect()
    links = A.cross_community_links(graph).where(F.col("community") == community).orderBy(F.desc("n"), "other_community").limit(10).collect()
    return "\n".join([f"# {name['hub_label'] if name else community}", "", *(f"- {r['label']} ({r['degree']})" for r in top), "", *(f"- community {r['other_community']}: {r['n']}" for r in links)])
