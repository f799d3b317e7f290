"""Aggregates over graphs: degrees, rankings, communities, surprises, reports and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions import predicates as P
from weftgraph.plans.graph import Graph, degrees, neighbours, pairs

STRUCTURAL = ("imports", "imports_from", "contains", "method")


def with_degree(graph: Graph) -> DataFrame:
    return graph.nodes.join(degrees(graph), "id")


def real_entities(graph: Graph) -> DataFrame:
    """Nodes with degree, without files, concepts, JSON keys and builtins."""
    label, source = F.col("label"), F.col("source_file")
    noise = P.is_file_node(label, source, F.col("degree")) | P.is_concept(source) | P.is_json_key(label, source) | P.is_builtin(label)
    return with_degree(graph).where(~noise)


def god_nodes(graph: Graph, n: int = 10) -> DataFrame:
    """The ``n`` entities of highest degree; ties by id."""
    return real_entities(graph).orderBy(F.desc("degree"), "id").limit(n).select("id", "label", "degree")


def relation_counts(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("relation", "confidence").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def graph_stats(graph: Graph) -> DataFrame:
    """One row: nodes, edges, communities and the percentages of each confidence, rounded half to even."""
    n = F.count(F.lit(1))
    share = lambda c: F.bround(F.count(F.when(F.col("confidence") == c, 1)) * 100.0 / n, 0).cast("int")
    edges = graph.edges.agg(n.alias("n_edges"), *[share(c).alias(f"pct_{c.lower()}") for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS")])
    nodes = graph.nodes.agg(n.alias("n_nodes"), F.countDistinct("community").alias("n_communities"))
    return edges.join(nodes)  # one row each


def isolated(graph: Graph) -> DataFrame:
    """Entities with at most one neighbour."""
    return real_entities(graph).where("degree <= 1").select("id", "label", "degree")


def cohesion(graph: Graph) -> DataFrame:
    """Share of possible pairs inside each community that are edges; 1 for a single node."""
    of = graph.nodes.select("id", "community").where("community IS NOT NULL")
    inside = (
        pairs(graph.edges).where("a <> b").join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").where("ca = cb")
        .groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("k"))
    )
    sizes = of.groupBy("community").agg(F.count(F.lit(1)).alias("n_nodes"))
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2.0
    score = F.when(F.col("n_nodes") <= 1, 1.0).otherwise(F.coalesce("k", F.lit(0)) / possible)
    return sizes.join(inside, "community", "left").select("community", "n_nodes", F.coalesce("k", F.lit(0)).alias("n_intra"), F.round(score, 9).alias("cohesion"))


def hub_labels(graph: Graph) -> DataFrame:
    """Name of each community: the label of its node of highest degree, ties by id, without call brackets."""
    best = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
    top = with_degree(graph).where("community IS NOT NULL").select("community", "id", "label", "degree", best.alias("r")).where("r = 1")
    return top.select("community", "id", F.regexp_replace("label", r"\(\)$", "").alias("hub_label"))


def fingerprints(graph: Graph) -> DataFrame:
    """First 16 digits of the SHA-256 over a community's sorted ids, each ended by a NUL.

    A fingerprint needs all ids of its community in one string; communities are what clustering
    has bounded in size.
    """
    ids = F.array_sort(F.collect_list("id"))
    joined = F.concat(F.array_join(ids, "\x00"), F.lit("\x00"))
    return graph.nodes.where("community IS NOT NULL").groupBy("community").agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


def cross_community_links(graph: Graph) -> DataFrame:
    """(community, other, n): ends of pairs that lead from one community to another."""
    of = graph.nodes.select("id", "community").where("community IS NOT NULL")
    near = neighbours(graph.edges)
    return (
        near.join(of, "id").join(of.toDF("other", "other_community"), "other").where("community <> other_community")
        .groupBy("community", "other_community").agg(F.count(F.lit(1)).alias("n"))
    )


def community_confidence(graph: Graph) -> DataFrame:
    """Edges by confidence for each community; an edge inside one counts once."""
    of = graph.nodes.select("id", "community").where("community IS NOT NULL")
    ends = graph.edges.select("src", "dst", "relation", "confidence", F.explode(F.array("src", "dst")).alias("id")).join(of, "id")
    once = ends.select("src", "dst", "relation", "confidence", "community").distinct()
    return once.groupBy("community", "confidence").agg(F.count(F.lit(1)).alias("n"))


def community_overlap(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new_id, old_id, overlap) of two assignments (id, community), the input of a greedy match."""
    return new.toDF("id", "new_id").join(old.toDF("id", "old_id"), "id").groupBy("new_id", "old_id").agg(F.count(F.lit(1)).alias("overlap"))


def remap_communities(new: DataFrame, old: DataFrame) -> dict[int, int]:
    """New ids to old ones, greedily by overlap; communities without a match get fresh ids by size.

    The pairs are a summary of two clusterings, a few for each community.
    """
    rows = community_overlap(new, old).orderBy(F.desc("overlap"), "old_id", "new_id").collect()
    out: dict[int, int] = {}
    taken: set[int] = set()
    for r in rows:
        if r["new_id"] not in out and r["old_id"] not in taken:
            out[r["new_id"]] = r["old_id"]
            taken.add(r["old_id"])
    fresh = 0
    sizes = new.toDF("id", "c").groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).orderBy(F.desc("n"), "least").collect()
    for r in sizes:
        if r["c"] not in out:
            while fresh in taken:
                fresh += 1
            out[r["c"]] = fresh
            taken.add(fresh)
    return out


def surprises(graph: Graph, n: int | None = 5) -> DataFrame:
    """Edges across files between entities, by how little the structure explains them; ties by ids and relation."""
    label, source = F.col("label"), F.col("source_file")
    real = with_degree(graph).where(~P.is_concept(source) & ~P.is_file_node(label, source, F.col("degree")))
    # what scoring asks of an end, without its label
    own = real.select("id", "source_file", "community", "degree")
    side = lambda s: own.select(*[F.col(c).alias(f"{s}_{c}") for c in own.columns])
    both = (
        graph.edges.where(~F.col("relation").isin(*STRUCTURAL)).select("src", "dst", "relation", "confidence")
        .join(side("u"), F.col("src") == F.col("u_id")).join(side("v"), F.col("dst") == F.col("v_id"))
    )
    a, b = F.col("u_source_file"), F.col("v_source_file")
    conf, rel = F.coalesce("confidence", F.lit("EXTRACTED")), F.col("relation")
    ka, kb = P.file_category(a), P.file_category(b)
    polluted = (conf == "INFERRED") & rel.isin("calls", "uses") & (P.cross_language(a, b) | ((ka == "code") & (kb == "doc")) | ((ka == "doc") & (kb == "code")))
    points = lambda cond, k: F.when(F.coalesce(cond, F.lit(False)) & ~polluted, k).otherwise(0)
    base = F.when(polluted, 0).when(conf == "AMBIGUOUS", 3).when(conf == "INFERRED", 2).otherwise(1)
    base = base + points(ka != kb, 2) + points(F.split(a, "/")[0] != F.split(b, "/")[0], 2) + points(F.col("u_community") != F.col("v_community"), 1)
    similar = F.when(rel == "semantically_similar_to", F.floor(base * 1.5).cast("int")).otherwise(base)
    low, high = F.least("u_degree", "v_degree"), F.greatest("u_degree", "v_degree")
    score = similar + F.when((low <= 2) & (high >= 5), 1).otherwise(0)
    ranked = both.where(a != b).select("src", "dst", "relation", "confidence", score.cast("int").alias("score"))
    return ranked.orderBy(F.desc("score"), "src", "dst", "relation").limit(n) if n else ranked


def bridges(graph: Graph, n: int | None = 5) -> DataFrame:
    """One edge for each pair of communities that edges join: the least certain, ties by ids and relation.

    For a corpus of one file, which has no edges across files to be surprised at.
    """
    own = with_degree(graph).where(~P.is_file_node(F.col("label"), F.col("source_file"), F.col("degree"))).select("id", "community")
    e = graph.edges.where(~F.col("relation").isin(*STRUCTURAL)).select("src", "dst", "relation", "confidence")
    both = e.join(own.toDF("src", "x"), "src").join(own.toDF("dst", "y"), "dst").where("x <> y")
    rank = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).when(F.col("confidence") == "EXTRACTED", 2).otherwise(3)
    best = F.min(F.struct(rank.alias("rank"), "src", "dst", "relation", "confidence"))
    pairs_ = both.groupBy(F.least("x", "y").alias("community"), F.greatest("x", "y").alias("other_community")).agg(best.alias("m"))
    out = pairs_.select("community", "other_community", "m.src", "m.dst", "m.relation", "m.confidence", "m.rank")
    return (out.orderBy("rank", "src", "dst", "relation").limit(n) if n else out).drop("rank")


def learn_scores(graph: Graph) -> DataFrame:
    """2 * fan-in + degree / 2 + 0.3 * fan-out of every node."""
    e = graph.edges.select("src", "dst").where("src <> dst").distinct()
    fan_out = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    fan_in = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    joined = degrees(graph).join(fan_in, "id", "left").join(fan_out, "id", "left").fillna(0)
    return joined.select("id", "fan_in", "fan_out", "degree", F.round(2 * F.col("fan_in") + 0.5 * F.col("degree") + 0.3 * F.col("fan_out"), 6).alias("score"))


def ranked_edges(graph: Graph) -> DataFrame:
    """Edges with their rank in diagrams and whether diagrams include them."""
    return graph.edges.select(
        "src", "dst", "relation", F.round(P.edge_rank(F.col("relation"), F.col("confidence"), F.col("confidence_score")), 6).alias("rank_score"),
        P.in_diagram(F.col("confidence"), F.col("confidence_score")).alias("included"),
    )


def section_summary(graph: Graph, section: str = "community") -> DataFrame:
    """Edges within, between and outside sections, by section of the source and relation."""
    of = graph.nodes.select("id", F.col(section).alias("s"))
    both = graph.edges.join(of.toDF("src", "s1"), "src", "left").join(of.toDF("dst", "s2"), "dst", "left")
    kind = F.when(F.col("s1").isNull() | F.col("s2").isNull(), "orphan").when(F.col("s1") == F.col("s2"), "intra").otherwise("inter")
    return both.groupBy(F.col("s1").alias("section"), kind.alias("kind"), "relation").agg(F.count(F.lit(1)).alias("n"))


def tree_rollup(graph: Graph) -> DataFrame:
    """Symbols under every directory and file: (prefix, depth, total_count)."""
    parts = F.split("source_file", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return (
        graph.nodes.where("source_file <> ''").groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
        .select("n", F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.sum("n").alias("total_count"))
        .select("prefix", F.size(F.split("prefix", "/")).alias("depth"), "total_count")
    )


def report_summary(graph: Graph) -> DataFrame:
    """One row: mean score of inferred edges, ambiguous edges, thin communities (under three entities), isolated entities."""
    e = graph.edges.agg(
        F.round(F.avg(F.when(F.col("confidence") == "INFERRED", F.col("confidence_score"))), 6).alias("inferred_avg"),
        F.count(F.when(F.col("confidence") == "AMBIGUOUS", 1)).alias("n_ambiguous"),
    )
    real = real_entities(graph)
    thin = graph.nodes.select("community").distinct().join(real.groupBy("community").agg(F.count(F.lit(1)).alias("k")), "community", "left")
    t = thin.agg(F.count(F.when(F.coalesce("k", F.lit(0)) < 3, 1)).alias("n_thin"))
    i = real.agg(F.count(F.when(F.col("degree") <= 1, 1)).alias("n_isolated"))
    return e.join(t).join(i)  # one row each


def domain_tour(graph: Graph) -> DataFrame:
    """Dependencies between communities (from, to, n) for a guided tour: directed, without loops."""
    of = graph.nodes.select("id", "community")
    return (
        graph.edges.join(of.toDF("src", "from_community"), "src").join(of.toDF("dst", "to_community"), "dst").where("from_community <> to_community")
        .groupBy("from_community", "to_community").agg(F.count(F.lit(1)).alias("n"))
    )
