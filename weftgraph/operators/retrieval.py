"""Lookup and ranked retrieval: tiers, IDF, lexical, fuzzy and vector scores, seeds, budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions.text import cosine, fold, jaro_winkler_column, label_tokens, norm_label, query_terms, score_terms, search_tokens, vector_weight
from weftgraph.plans.graph import Graph, degrees
from weftgraph.session import written

# Bonuses of the match tiers.
FULL_EXACT, FULL_PREFIX, EXACT, PREFIX, SUBSTRING, IN_SOURCE, FUZZY = 10_000.0, 1_000.0, 1_000.0, 100.0, 1.0, 0.5, 2.0
FUZZY_LEAST = 0.85
# Words of a question that hint at an edge context, and other names of contexts.
CONTEXT_HINTS = {
    "call": ("call", "calls", "called", "caller", "callers", "invoke", "invokes", "invoked"),
    "import": ("import", "imports", "imported", "module", "modules"),
    "field": ("field", "fields", "member", "members", "property", "properties"),
    "parameter_type": ("parameter", "parameters", "param", "params", "argument", "arguments"),
    "return_type": ("return", "returns", "returned"),
    "generic_arg": ("generic", "generics", "template", "templates"),
}
CONTEXT_NAMES = {
    "parameter_type": ("param", "params", "parameter", "parameters", "argument", "arguments", "arg", "args"),
    "return_type": ("return", "returns", "returned"),
    "generic_arg": ("generic", "generics", "template", "templates"),
    "attribute": ("annotation", "annotations", "decorator", "decorators"),
    "call": ("calls", "called", "invoke", "invocation"),
    "field": ("fields", "property", "properties", "member", "members"),
    "import": ("imports", "imported", "module", "modules"),
    "export": ("exports", "exported"),
}
# Verbs that ask for a relation; they get no seed of their own while other terms do.
INTENT = frozenset((
    "call", "calls", "called", "caller", "callers", "invoke", "invokes", "invoked", "use", "uses", "used", "using",
    "import", "imports", "imported", "export", "exports", "exported", "extend", "extends", "extended",
    "implement", "implements", "implemented", "depend", "depends", "reference", "references", "referenced",
))


def resolve_contexts(question: str, explicit: list[str] | None = None) -> list[str]:
    """Contexts that a query is limited to: those named, else those that words of the question hint at."""
    names = {alias: c for c, xs in CONTEXT_NAMES.items() for alias in xs}
    named = [x for x in (fold(v).strip().lower() for v in explicit or []) if x]
    if named:
        return list(dict.fromkeys(names.get(x, x) for x in named))
    said = {fold(w).lower() for w in question.replace("?", " ").replace(",", " ").split()}
    return [c for c, hints in CONTEXT_HINTS.items() if said & set(hints)]


def context_filter(graph: Graph, contexts: list[str]) -> Graph:
    return graph.where_edges(F.col("context").isin(contexts)) if contexts else graph


def normed(nodes: DataFrame) -> DataFrame:
    """Nodes with ``norm_label``, the label's normal form, as a stored column: scores compare it dozens of times."""
    if "norm_label" in nodes.columns:
        return nodes
    return written(nodes.withColumn("norm_label", norm_label(F.coalesce("label", F.lit("")))))


def _bare(norm: Column) -> Column:
    return F.regexp_replace(norm, r"[()]+$", "")


def lookup(nodes: DataFrame, query: str) -> DataFrame:
    """(id, tier) of nodes that match a name: source_exact, exact, prefix or substring."""
    term, norm_query = " ".join(search_tokens(query)), fold(query).lower().strip()
    nodes = normed(nodes)
    norm = F.col("norm_label")
    bare, tokens, source, nid = _bare(norm), label_tokens(norm), label_tokens(norm_label(F.col("source_file"))), F.lower("id")
    t, q = F.lit(term), F.lit(norm_query)
    exact = (norm == t) | (bare == t) | (tokens == t) | (nid == t) | (norm == q) | (bare == q) | (nid == q)
    prefix = norm.startswith(t) | bare.startswith(t) | tokens.startswith(t) | nid.startswith(t) | norm.startswith(q) | bare.startswith(q)
    inside = norm.contains(t) | tokens.contains(t) | norm.contains(q)
    tier = F.when(source == t, "source_exact").when(exact, "exact").when(prefix, "prefix").when(inside, "substring")
    found = nodes.select("id", tier.alias("tier")).where("tier IS NOT NULL")
    return found if term else found.limit(0)


def best_tier(found: DataFrame) -> DataFrame:
    """Matches of the first tier that has any."""
    rank = F.when(F.col("tier") == "source_exact", 0).when(F.col("tier") == "exact", 1).when(F.col("tier") == "prefix", 2).otherwise(3)
    top = found.select(F.min(rank)).first()[0]
    return found.where(rank == F.lit(top)) if top is not None else found


def neighbours_of(graph: Graph, node: str, relation: str = "") -> DataFrame:
    """(direction, other, relation, confidence): successors and predecessors, by part of the relation's name."""
    e = graph.edges.where(F.lower("relation").contains(relation.lower()))
    out = e.where(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "relation", "confidence")
    return out.union(e.where(F.col("dst") == node).select(F.lit("in"), "src", "relation", "confidence"))


def explain(graph: Graph, node: str, n: int = 20) -> DataFrame:
    """The node's connections to its ``n`` neighbours of highest degree; ties by id."""
    near = neighbours_of(graph, node).join(degrees(graph).toDF("other", "degree"), "other")
    return near.orderBy(F.desc("degree"), "other", "direction", "relation").limit(n)


def idf(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(term, df, idf): ln(1 + N / (1 + df)), df being the labels that contain the term. All terms in one pass."""
    nodes = normed(nodes)
    norm = F.col("norm_label")
    row = nodes.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(norm.contains(t), 1)).alias(f"t{i}") for i, t in enumerate(terms)])
    each = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df")) for i, t in enumerate(terms)])
    return row.select("n", F.inline(each)).select("term", "df", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))


@dataclass(frozen=True)
class Query:
    """Tokens of a question and their weights; ``terms`` as written, ``tokens`` as compared."""

    terms: list[str]
    tokens: list[str]
    idf: dict[str, float]


def prepare(nodes: DataFrame, question: str) -> Query:
    tokens = score_terms(question)
    weights = {r["term"]: r["idf"] for r in idf(nodes, tokens).collect()} if tokens else {}  # a row for each token
    return Query(query_terms(question), tokens, weights)


def score_nodes(nodes: DataFrame, query: Query, fuzzy: bool = True, vectors: DataFrame | None = None) -> DataFrame:
    """(id, label, score, matched, best): all tokens in one pass; ``best`` holds each token's score as if alone.

    The first tier that holds counts; full-query matches go on top; tiers are scaled by the square
    of the share of tokens matched. ``vectors`` is (id, sim). Without any score a node is left out.
    """
    base = normed(nodes).select("id", "label", F.col("norm_label").alias("norm"), F.lower(F.coalesce("source_file", F.lit(""))).alias("src"), F.lower(F.coalesce("label", "id")).alias("low"))
    base = base.withColumns({"bare": _bare(F.col("norm")), "tok": label_tokens(F.col("norm")), "nid": F.lower("id")})
    tokens, joined, top = query.tokens, " ".join(query.tokens), max(query.idf.values(), default=1.0)
    n, b, k = F.col("norm"), F.col("bare"), F.col("tok")
    is_, begins = (lambda q: (n == q) | (b == q) | (k == q) | (F.col("nid") == q)), (lambda q: n.startswith(q) | b.startswith(q) | k.startswith(q))
    whole = lambda q, w: F.when(is_(q), FULL_EXACT * w).when(begins(q), FULL_PREFIX * w).otherwise(0.0)
    full = whole(joined, top) if tokens else F.lit(0.0)
    tiered, flat, matched, best = F.lit(0.0), F.lit(0.0), F.lit(0), []
    for t in tokens:
        w = query.idf[t]
        exact, prefix, inside = (n == t) | (b == t), n.startswith(t) | b.startswith(t), n.contains(t)
        tier = F.when(exact, EXACT * w).when(prefix, PREFIX * w).otherwise(0.0)
        rest = F.when(exact | prefix, 0.0).when(inside, SUBSTRING * w).otherwise(0.0) + F.when(F.col("src").contains(t), IN_SOURCE * w).otherwise(0.0)
        alone = tier + rest
        if fuzzy:
            sim = F.coalesce(F.when(~(exact | prefix | inside), jaro_winkler_column(t, F.col("low"), FUZZY_LEAST)), F.lit(0.0))
            # one binding for its two uses
            near = F.get(F.transform(F.array(sim), lambda x: F.when(x >= FUZZY_LEAST, FUZZY * x).otherwise(0.0)), F.lit(0))
            base = base.withColumn(f"near_{len(best)}", near)
            near = F.col(f"near_{len(best)}")
            rest, alone = rest + near * w, alone + near
        tiered, flat, matched = tiered + tier, flat + rest, matched + F.when(exact | prefix | inside, 1).otherwise(0)
        best.append(F.struct(F.lit(t).alias("term"), (whole(t, w) + alone).alias("score")))
    out = base.select("id", "label", full.alias("full"), tiered.alias("tiered"), flat.alias("flat"), matched.alias("matched"), F.array(*best).alias("best"))
    share = F.col("matched") / F.lit(float(max(len(tokens), 1)))
    score = F.col("full") + F.col("flat") + F.col("tiered") * share * share
    if vectors is not None:
        out = out.join(vectors.select("id", "sim"), "id", "left")
        score = score + F.coalesce(F.when(F.col("sim") > 0, vector_weight(F.col("sim")) * F.col("sim")), F.lit(0.0))
    return out.select("id", "label", score.alias("score"), "matched", "best").where("score > 0")


def ranked(scored: DataFrame, n: int | None = None) -> DataFrame:
    out = scored.orderBy(F.desc("score"), F.length(F.coalesce("label", "id")), "id")
    return out.limit(n) if n else out


def similarity_to(vectors: DataFrame, target: list[float], key: str = "vec_id") -> DataFrame:
    """(id, sim, tier_weight) of stored vectors against one."""
    goal = F.array(*[F.lit(float(x)) for x in target])
    sim = cosine(F.col("embedding"), goal)
    return vectors.select(F.col(key).alias("id"), sim.alias("sim")).withColumn("tier_weight", vector_weight(F.col("sim")))


def pick_seeds(scored: DataFrame, graph: Graph, max_k: int = 3, gap: float = 0.2, terms: list[str] | None = None) -> list[str]:
    """Seeds of a traversal: the best labels within the gap, and one for each token that would have none.

    Of equal labels the best stays. Verbs that ask for a relation get no seed of their own, unless
    ``terms`` has nothing else. Both parts are top-k reports: at most ``max_k`` rows, and one for each token.
    """
    label = norm_label(F.coalesce("label", "id"))
    w = Window.partitionBy(label).orderBy(F.desc("score"), F.length(F.coalesce("label", "id")), "id")
    top = ranked(scored.withColumn("__r", F.row_number().over(w)).where("__r = 1"), max_k).select("id", "score", label.alias("key")).collect()
    keep = [r for r in top if r["score"] >= gap * top[0]["score"]] if top else []
    seeds, seen = [r["id"] for r in keep], {r["key"] for r in keep}
    each = scored.select("id", "label", label.alias("key"), F.explode("best").alias("b")).where("b.score > 0")
    if any(t not in INTENT for t in terms or []):
        each = each.where(~F.col("b.term").isin(*INTENT))
    # degrees decide only among a token's best scores
    most = each.groupBy("b.term").agg(F.max("b.score").alias("most"))
    tied = each.select("id", "label", "key", F.col("b.term").alias("term"), F.col("b.score").alias("own")).join(F.broadcast(most), "term").where("own = most")
    best = F.min(F.struct(-F.col("degree"), F.length(F.coalesce("label", "id")), F.col("id"), F.col("key")))
    for r in tied.join(degrees(graph), "id").groupBy("term").agg(best.alias("m")).orderBy("term").collect():
        if r["m"]["id"] not in seeds and r["m"]["key"] not in seen:
            seeds.append(r["m"]["id"])
            seen.add(r["m"]["key"])
    return seeds


def pick_endpoint(scored: DataFrame, query: str) -> str | None:
    """The end of a path that a query means: the best node whose label has all its tokens, else the best."""
    tokens = search_tokens(query)
    has = F.split(label_tokens(norm_label(F.coalesce("label", "id"))), " ")
    every = F.forall(F.array(*[F.lit(t) for t in dict.fromkeys(tokens)]), lambda t: F.array_contains(has, t)) if tokens else F.lit(False)
    first = scored.orderBy(F.desc(every), F.desc("score"), F.length(F.coalesce("label", "id")), "id").select("id").first()
    return first["id"] if first else None


def cut_to_budget(lines: DataFrame, tokens: int, group: str = "doc") -> DataFrame:
    """Lines (group, ord, line) that fit into a budget of 3 characters a token, in order, within each group."""
    used = F.sum(F.length("line") + 1).over(Window.partitionBy(group).orderBy("ord"))
    return lines.withColumn("used", used).where(F.col("used") <= 3 * tokens)


def hybrid_search(graph: Graph, question: str, n: int = 10, vectors: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    nodes = normed(graph.nodes)
    return ranked(score_nodes(nodes, prepare(nodes, question), fuzzy, vectors), n).select("id", "label", "score")
