"""Unions, differences and incremental maintenance of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.graph import Graph, degrees


def edge_key(edges: DataFrame, directed: bool = False) -> DataFrame:
    if directed:
        return edges.select("src", "dst", "relation").distinct()
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "relation").distinct()


def graph_diff(old: Graph, new: Graph, directed: bool = False) -> DataFrame:
    """(change, kind, key) of nodes and edges added and removed.

    Keys of both graphs are counted together, each by the graphs that have it: one shuffle, summed before.
    """

    def keys(g: Graph, bit: int) -> DataFrame:
        ends = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
        nodes = g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key"), F.lit(bit).alias("bit"))
        return nodes.union(g.edges.select(F.lit("edge"), F.concat_ws("|", *ends, "relation"), F.lit(bit)))

    has = keys(old, 1).union(keys(new, 2)).groupBy("kind", "key").agg(F.bit_or("bit").alias("bits")).where("bits < 3")
    return has.select(F.when(F.col("bits") == 1, "removed").otherwise("added").alias("change"), "kind", "key")


def same_topology(a: Graph, b: Graph) -> bool:
    return graph_diff(a, b, directed=True).isEmpty()


def merge_by_source(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose source (and tier, if a key) was not extracted again."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def prune_sources(graph: Graph, sources: DataFrame) -> Graph:
    """Without the nodes and edges of some sources, and without source-less nodes that this isolates."""
    gone = sources.select("source_file").distinct()
    kept = graph.nodes.join(gone, "source_file", "left_anti")
    e = graph.edges.join(gone, "source_file", "left_anti") if "source_file" in graph.edges.columns else graph.edges
    ids = kept.select("id")
    e = e.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi").select(graph.edges.columns)
    before, after = degrees(graph).toDF("id", "before"), degrees(Graph(kept, e)).toDF("id", "after")
    orphan = kept.where("source_file IS NULL OR source_file = ''").select("id").join(before, "id").join(after, "id").where("before > 0 AND after = 0").select("id")
    return Graph(kept.join(orphan, "id", "left_anti"), e)


def lost_nodes(old: Graph, new: Graph, accounted: DataFrame) -> DataFrame:
    """Nodes that vanished although their source was neither extracted again nor pruned."""
    return old.nodes.join(new.nodes.select("id"), "id", "left_anti").join(accounted.select("source_file").distinct(), "source_file", "left_anti")


def prefixed(graph: Graph, repo: str, offset: int = 0) -> Graph:
    """The graph with ids under a repository and communities moved by an offset."""
    name = lambda c: F.concat(F.lit(f"{repo}::"), F.col(c))
    n = graph.nodes.withColumns({"local_id": F.col("id"), "id": name("id"), "repo": F.lit(repo), "community": F.col("community") + offset})
    return Graph(n, graph.edges.withColumns({"src": name("src"), "dst": name("dst")}))


def union_graphs(*graphs: Graph) -> Graph:
    """One graph of several: of nodes with one id, and of edges with ends and relation, one row, each attribute from
    the last graph that states it."""

    def merged(parts: list[DataFrame], keys: list[str]) -> DataFrame:
        rows = None
        for i, p in enumerate(parts):
            p = p.withColumn("order_", F.lit(i))
            rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
        others = [c for c in rows.columns if c not in (*keys, "order_")]
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("order_", F.col(c)))).alias(c) for c in others]
        return rows.groupBy(*keys).agg(*last).select(*[c for c in rows.columns if c != "order_"])

    return Graph(merged([g.nodes for g in graphs], ["id"]), merged([g.edges for g in graphs], ["src", "dst", "relation"]))


def prune_repo(graph: Graph, repo: str) -> Graph:
    n = graph.nodes.where(~F.col("repo").eqNullSafe(repo))
    ids = n.select("id")
    return Graph(n, graph.edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi"))


def merge_externals(nodes: DataFrame) -> DataFrame:
    """(id, survivor) of nodes without a source that share a label: the least id survives."""
    ext = nodes.where("source_file IS NULL OR source_file = ''")
    least = ext.groupBy("label").agg(F.min("id").alias("survivor"))
    return ext.select("id", "label").join(least, "label").where("id <> survivor").select("id", "survivor")


def cross_repo_types(nodes: DataFrame) -> DataFrame:
    """(namespace, label, src, dst): each pair of declarations of one type in two repositories, in the order of ids.

    A type is what shares namespace and label. Declarations in one repository are not paired, so the
    pairs of a type are bounded by the square of what the repositories declare of it; ``type_classes``
    says the same in a row for each declaration.
    """
    own = nodes.where("namespace <> ''").select("namespace", "label", "repo", "id")
    other = own.toDF("namespace", "label", "repo_b", "dst")
    return own.join(other, ["namespace", "label"]).where("repo <> repo_b AND id < dst").select("namespace", "label", F.col("id").alias("src"), "dst")


def type_classes(nodes: DataFrame) -> DataFrame:
    """(id, class, n_repos, n_links): the least id of a declaration's type, its repositories, and the pairs it is in."""
    own = nodes.where("namespace <> ''").select("namespace", "label", "repo", "id")
    by_repo = own.groupBy("namespace", "label", "repo").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("least"))
    whole = by_repo.groupBy("namespace", "label").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_repos"), F.min("least").alias("class")).where("n_repos > 1")
    counted = by_repo.join(whole, ["namespace", "label"]).select("namespace", "label", "repo", "class", "n_repos", (F.col("n") - F.col("k")).alias("n_links"))
    return own.join(counted, ["namespace", "label", "repo"]).select("id", "class", "n_repos", "n_links")


def manifest_changes(disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state) of files: new, changed, unchanged or deleted, by hash."""
    both = disk.select("path", F.col("hash").alias("now")).join(manifest.select("path", F.col("hash").alias("then")), "path", "full_outer")
    state = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("then"), "unchanged").otherwise("changed")
    return both.select("path", state.alias("state"))


def embedding_delta(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, action): embed what is new or whose text changed, drop what is gone, keep the rest."""
    now = nodes.select("id", F.sha2(F.col("text"), 256).alias("now"))
    both = now.join(stored.select("id", F.col("text_hash").alias("then")), "id", "full_outer")
    action = F.when(F.col("now").isNull(), "drop").when(F.col("now").eqNullSafe(F.col("then")), "keep").otherwise("embed")
    return both.select("id", action.alias("action"))


def needs_full_rebuild(delta: DataFrame) -> bool:
    """Whether over half of the stored vectors would change."""
    n, k = delta.where("action <> 'drop'").agg(F.count(F.lit(1)), F.count(F.when(F.col("action") == "embed", 1))).first()
    return bool(n) and 2 * k > n
