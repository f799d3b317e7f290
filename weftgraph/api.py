"""One object for a graph, with the calls that a query service offers."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import analytics as A
from weftgraph.operators import retrieval as R
from weftgraph.operators import traversal as T
from weftgraph.operators import work as W
from weftgraph.plans.graph import Graph, degrees
from weftgraph.session import written
from weftgraph.sources.sinks import article


class GraphService:
    def __init__(self, graph: Graph, prs: DataFrame | None = None, log: str | None = None) -> None:
        self.graph, self.prs, self.log = Graph(R.normed(graph.nodes), graph.edges), prs, log

    def _logged(self, kind: str, question: str, n: int) -> None:
        if self.log:
            row = [(kind, question, n, time.time())]
            self.graph.nodes.sparkSession.createDataFrame(row, "kind string, question string, n int, at double").write.mode("append").json(self.log)

    def query_graph(self, question: str, depth: int = 3, budget: int = 2000, contexts: list[str] | None = None, mode: str = "bfs", top_k: int = 3, top_n: int = 1) -> str:
        """Text of the part of the graph that a question is about, within a budget of tokens; seeds are never cut.

        With ``top_n`` over one, each of the best nodes gets a part of its own and its share of the budget.
        """
        g = R.context_filter(self.graph, R.resolve_contexts(question, contexts))
        query = R.prepare(self.graph.nodes, question)
        scored = written(R.score_nodes(self.graph.nodes, query))
        depth = min(depth, 6)
        if top_n > 1:
            best = R.ranked(scored, top_n).select("id", F.coalesce("label", "id").alias("label"), "score").collect()
            head = "=== Result {}/{} (seed: {}, score: {:.2f}) ==="
            parts = [head.format(i, top_n, r["label"], r["score"]) + "\n" + self._part(g, [r["id"]], depth, max(budget // top_n, 500), mode) for i, r in enumerate(best, 1)]
            text = "\n\n".join(parts) or "no match"
        else:
            seeds = R.pick_seeds(scored, self.graph, top_k, terms=query.terms)
            text = self._part(g, seeds, depth, budget, mode) if seeds else "no match"
        if text != "no match":
            self._logged("query", question, text.count("\n") + 1)
        return text

    def _part(self, g: Graph, seeds: list[str], depth: int, budget: int, mode: str) -> str:
        if mode == "dfs":
            order = T.dfs(g, seeds, depth)
            seen = self.graph.nodes.sparkSession.createDataFrame([(n, i) for i, n in enumerate(order)], "id string, hop int")
        else:
            seen = T.bfs(g, seeds, depth)
        seen = written(seen)
        first = F.when(F.col("id").isin(seeds), 0).otherwise(1)
        nodes = seen.join(self.graph.nodes, "id").join(degrees(self.graph), "id").select(
            F.lit("q").alias("doc"), F.struct(first, "hop", -F.col("degree"), "id").alias("ord"), F.concat(F.lit("NODE "), F.coalesce("label", "id"), F.lit(" ["), F.coalesce("source_file", F.lit("")), F.lit("]")).alias("line")
        )
        kept = [r["line"] for r in R.cut_to_budget(nodes, budget).orderBy("ord").collect()]
        names = [r["label"] or r["id"] for r in self.graph.nodes.where(F.col("id").isin(seeds)).collect()]
        kept = kept or [f"NODE {n}" for n in names]
        room = 3 * budget - sum(len(x) + 1 for x in kept)
        edges = T.induced_edges(g, seen).select(F.lit("e").alias("doc"), F.struct("src", "dst", "relation").alias("ord"), F.concat_ws(" ", F.lit("EDGE"), "src", "relation", "dst").alias("line"))
        kept += [r["line"] for r in R.cut_to_budget(edges, max(room, 0) // 3).orderBy("ord").collect()]
        return "\n".join(kept)

    def get_node(self, name: str) -> DataFrame:
        return R.best_tier(R.lookup(self.graph.nodes, name)).join(self.graph.nodes, "id").join(degrees(self.graph), "id")

    def resolve(self, name: str) -> str | None:
        """The one node that a name means: of its best tier, if that holds one."""
        found = R.best_tier(R.lookup(self.graph.nodes, name)).limit(2).collect()
        return found[0]["id"] if len(found) == 1 else None

    def endpoint(self, name: str) -> str | None:
        """The best scored node for one end of a path, one whose label has every token of the name if there is one."""
        return R.pick_endpoint(R.score_nodes(self.graph.nodes, R.prepare(self.graph.nodes, name)), name)

    def get_neighbors(self, node: str, relation: str = "") -> DataFrame:
        return R.neighbours_of(self.graph, node, relation)

    def get_community(self, community: int) -> DataFrame:
        return A.with_degree(self.graph).where(F.col("community") == community).orderBy(F.desc("degree"), "id")

    def community_article(self, community: int) -> str:
        return article(self.graph, community)

    def god_nodes(self, n: int = 10) -> DataFrame:
        return A.god_nodes(self.graph, n)

    def graph_stats(self) -> dict:
        return A.graph_stats(self.graph).first().asDict()

    def shortest_path(self, a: str, b: str, max_hops: int = 8, directed: bool = True) -> list[str]:
        x, y = self.resolve(a) or self.endpoint(a), self.resolve(b) or self.endpoint(b)
        return T.shortest_path(self.graph, x, y, directed, max_hops) if x and y else []

    def affected(self, name: str, depth: int = 2) -> DataFrame:
        node = self.resolve(name)
        return T.affected(self.graph, node, depth) if node else T.affected(self.graph, "", 0)

    def explain(self, name: str) -> DataFrame:
        return R.explain(self.graph, self.resolve(name) or "")

    def list_prs(self, base: str, now) -> DataFrame:
        return W.status(self.prs, base, now)

    def get_pr_impact(self, number: int) -> DataFrame:
        return W.impact(self.prs.where(F.col("number") == number), self.graph.nodes)

    def triage_prs(self, base: str, now) -> DataFrame:
        """Open pull requests with status and impact, the widest first."""
        return W.status(self.prs, base, now).join(W.impact(self.prs, self.graph.nodes), "number").orderBy(F.desc("n_nodes"), "number")

    def as_json(self, df: DataFrame, most: int = 100) -> str:
        return json.dumps([r.asDict(recursive=True) for r in df.limit(most).collect()], default=str)
