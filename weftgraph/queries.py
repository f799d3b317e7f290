"""Named queries over the test tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions import predicates as P
from weftgraph.functions import text as X
from weftgraph.operators import analytics as A
from weftgraph.operators import build as B
from weftgraph.operators import community as C
from weftgraph.operators import dedup as E
from weftgraph.operators import docs as D
from weftgraph.operators import merge as M
from weftgraph.operators import retrieval as R
from weftgraph.operators import traversal as T
from weftgraph.operators import work as W
from weftgraph.plans.graph import GRAPH_SQL, Graph, degrees, derived_graph
from weftgraph.session import dealt, written
from weftgraph.sources import sinks as S
from weftgraph.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: What a real entity is, in SQL over ``nodes`` and ``degrees``.
REAL = """real AS (SELECT n.*, d.degree, regexp_extract(source_file, '[^/]*$') AS base FROM nodes n JOIN degrees d USING (id)
    WHERE NOT (label = regexp_extract(source_file, '[^/]*$') OR (contains(label, '/') AND (source_file = label OR ends_with(source_file, '/' || label)))
    OR (starts_with(label, '.') AND ends_with(label, '()')) OR (ends_with(label, '()') AND degree <= 1)) AND contains(regexp_extract(source_file, '[^/]*$'), '.'))"""


def query(name: str, sql: str | None = None, graph: bool = True, once: bool = False):
    """Register a query of (spark, sf_dir), or of a graph made from them, with its SQL.

    With ``once`` the graph is written first, for operators that read it several times.
    """

    def made(spark: SparkSession, sf_dir: str) -> Graph:
        g = derived_graph(spark, sf_dir)
        return Graph(written(g.nodes), written(g.edges)) if once else g

    def wrap(f):
        of = (lambda spark, sf_dir: f(made(spark, sf_dir))) if graph else f
        QUERIES[name] = lambda spark, sf_dir: of(dealt(spark, sf_dir), sf_dir)
        if sql:
            ORACLES[name] = (GRAPH_SQL if graph or sql.lstrip().startswith(",") else "") + sql
        return f

    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- degrees, rankings, reports

query("degree_undirected", "SELECT id, degree::BIGINT AS degree FROM degrees")(degrees)
query("god_nodes", f", {REAL} SELECT id, label, degree FROM real ORDER BY degree DESC, id LIMIT 10")(A.god_nodes)
query("relation_counts", "SELECT relation, confidence, count(*) AS n, round(sum(weight), 6) AS weight FROM edges GROUP BY 1, 2")(A.relation_counts)
query("graph_stats", """SELECT (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(DISTINCT community) FROM nodes) AS n_communities,
    round_even(100.0 * count(*) FILTER (confidence = 'EXTRACTED') / count(*), 0)::INT AS pct_extracted, round_even(100.0 * count(*) FILTER (confidence = 'INFERRED') / count(*), 0)::INT AS pct_inferred,
    round_even(100.0 * count(*) FILTER (confidence = 'AMBIGUOUS') / count(*), 0)::INT AS pct_ambiguous FROM edges""")(A.graph_stats)
query("isolated_nodes", f", {REAL} SELECT id, label, degree FROM real WHERE degree <= 1")(A.isolated)
query("cohesion", """, k AS (SELECT x.community, count(*) AS k FROM pairs JOIN nodes x ON a = x.id JOIN nodes y ON b = y.id WHERE a <> b AND x.community = y.community GROUP BY 1),
    s AS (SELECT community, count(*) AS n FROM nodes GROUP BY 1)
    SELECT community, n AS n_nodes, coalesce(k, 0) AS n_intra, round(CASE WHEN n <= 1 THEN 1.0 ELSE coalesce(k, 0) / (n * (n - 1) / 2.0) END, 9) AS cohesion FROM s LEFT JOIN k USING (community)""")(A.cohesion)
query("community_hub_label", """SELECT community, id, regexp_replace(label, '\\(\\)$', '') AS hub_label FROM
    (SELECT n.*, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) r FROM nodes n JOIN degrees USING (id)) WHERE r = 1""")(A.hub_labels)
query("community_fingerprint", "SELECT community, substr(sha256(string_agg(id || chr(0), '' ORDER BY id)), 1, 16) AS fingerprint FROM nodes GROUP BY 1")(A.fingerprints)
query("cross_community_links", """, e AS (SELECT a AS id, b AS other FROM pairs WHERE a <> b UNION ALL SELECT b, a FROM pairs WHERE a <> b)
    SELECT x.community, y.community AS other_community, count(*) AS n FROM e JOIN nodes x ON e.id = x.id JOIN nodes y ON e.other = y.id WHERE x.community <> y.community GROUP BY 1, 2""")(A.cross_community_links)
query("community_confidence", """, o AS (SELECT DISTINCT src, dst, relation, confidence, community FROM (SELECT e.*, unnest([src, dst]) AS id FROM edges e) JOIN nodes USING (id))
    SELECT community, confidence, count(*) AS n FROM o GROUP BY 1, 2""")(A.community_confidence)


@query("community_remap_overlap", "SELECT community AS new_id, community % 7 AS old_id, count(*) AS overlap FROM nodes GROUP BY 1, 2")
def _overlap(g: Graph) -> DataFrame:
    return A.community_overlap(g.nodes.select("id", "community"), g.nodes.select("id", F.col("community") % 7))


@query("community_remap", """, o AS (SELECT community AS c, community % 7 AS old, count(*) AS n, min(id) AS least FROM nodes GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY n DESC, c) AS r FROM o),
    free AS (SELECT x, row_number() OVER (ORDER BY x) AS k FROM range(0, 1000) t(x) WHERE x NOT IN (SELECT old FROM o)), late AS (SELECT c, row_number() OVER (ORDER BY n DESC, least) AS k FROM r WHERE r > 1)
    SELECT c::INT AS new_id, old::INT AS old_id FROM r WHERE r = 1 UNION ALL SELECT c, x::INT FROM late JOIN free USING (k)""")
def _remap(g: Graph) -> DataFrame:
    matched = A.remap_communities(g.nodes.select("id", "community"), g.nodes.select("id", F.col("community") % 7))
    return g.nodes.sparkSession.createDataFrame(sorted(matched.items()), "new_id int, old_id int")


_SURPRISE = """, d AS (SELECT n.*, degree FROM nodes n JOIN degrees USING (id)),
    ok AS (SELECT * FROM d WHERE label <> regexp_extract(source_file, '[^/]*$') AND NOT ends_with(label, '()')),
    s AS (SELECT e.src, e.dst, e.relation, e.confidence,
        CASE e.confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + 2 * (split_part(u.source_file, '/', 1) <> split_part(v.source_file, '/', 1))::INT
        + (u.community <> v.community)::INT + (least(u.degree, v.degree) <= 2 AND greatest(u.degree, v.degree) >= 5)::INT AS score
        FROM edges e JOIN ok u ON e.src = u.id JOIN ok v ON e.dst = v.id WHERE e.relation NOT IN ('imports', 'imports_from', 'contains', 'method') AND u.source_file <> v.source_file)
    SELECT * FROM s"""
query("surprise_score", _SURPRISE)(lambda g: A.surprises(g, None))
query("surprising_connections", _SURPRISE + " ORDER BY score DESC, src, dst, relation LIMIT 5")(A.surprises)
query("community_bridges", """, ok AS (SELECT n.* FROM nodes n JOIN degrees USING (id) WHERE label <> regexp_extract(source_file, '[^/]*$') AND NOT ends_with(label, '()')),
    p AS (SELECT e.*, least(x.community, y.community) AS a, greatest(x.community, y.community) AS b, CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END AS rank
        FROM edges e JOIN ok x ON src = x.id JOIN ok y ON dst = y.id WHERE x.community <> y.community AND relation NOT IN ('imports', 'imports_from', 'contains', 'method'))
    SELECT a AS community, b AS other_community, src, dst, relation, confidence FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY rank, src, dst, relation) AS r FROM p) WHERE r = 1""")(lambda g: A.bridges(g, None))
query("learn_scores", """, e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), o AS (SELECT src AS id, count(*) c FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) c FROM e GROUP BY 1)
    SELECT id, coalesce(i.c, 0) AS fan_in, coalesce(o.c, 0) AS fan_out, degree, round(2 * coalesce(i.c, 0) + 0.5 * degree + 0.3 * coalesce(o.c, 0), 6)::DOUBLE AS score FROM degrees LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")(A.learn_scores)
query("edge_rank_callflow", """SELECT src, dst, relation, round(confidence_score + CASE confidence WHEN 'EXTRACTED' THEN 2 ELSE 0 END
    + CASE WHEN relation IN ('calls', 'uses', 'method') THEN 1 WHEN relation IN ('imports', 'imports_from') THEN 0.6 WHEN relation = 'contains' THEN -0.2 ELSE 0 END, 6)::DOUBLE AS rank_score,
    confidence = 'EXTRACTED' OR (confidence = 'INFERRED' AND confidence_score >= 0.85) AS included FROM edges""")(A.ranked_edges)
query("section_summary", """SELECT x.community AS section, CASE WHEN x.community = y.community THEN 'intra' ELSE 'inter' END AS kind, relation, count(*) AS n
    FROM edges JOIN nodes x ON src = x.id JOIN nodes y ON dst = y.id GROUP BY 1, 2, 3""")(A.section_summary)
query("tree_rollup", """, p AS (SELECT array_to_string(list_slice(string_split(source_file, '/'), 1, k), '/') AS prefix, k AS depth FROM nodes, unnest(range(1, len(string_split(source_file, '/')) + 1)) t(k))
    SELECT prefix, depth::INT AS depth, count(*) AS total_count FROM p GROUP BY 1, 2""")(A.tree_rollup)
query("report_summary", f""", {REAL}, c AS (SELECT n.community, count(real.id) k FROM (SELECT DISTINCT community FROM nodes) n LEFT JOIN real USING (community) GROUP BY 1)
    SELECT (SELECT round(avg(confidence_score), 6) FROM edges WHERE confidence = 'INFERRED') AS inferred_avg, (SELECT count(*) FROM edges WHERE confidence = 'AMBIGUOUS') AS n_ambiguous,
    (SELECT count(*) FROM c WHERE k < 3) AS n_thin, (SELECT count(*) FROM real WHERE degree <= 1) AS n_isolated""")(A.report_summary)
query("domain_tour", """SELECT x.community AS from_community, y.community AS to_community, count(*) AS n FROM edges JOIN nodes x ON src = x.id JOIN nodes y ON dst = y.id
    WHERE x.community <> y.community GROUP BY 1, 2""")(A.domain_tour)

# -- validation, repair, collapse


def _flawed(g: Graph) -> Graph:
    """The derived graph with flaws by rule: some labels and types missing, unknown confidences, ends outside the graph."""
    n = g.nodes.withColumns({
        "label": F.when(F.col("id").like("%7"), F.lit(None)).otherwise(F.col("label")),
        "file_type": F.when(F.col("id").like("%33"), "tool").otherwise(F.col("file_type")),
    })
    e = g.edges.withColumns({
        "confidence": F.when(F.col("src").like("%21"), "GUESSED").otherwise(F.col("confidence")),
        "dst": F.when(F.col("src").like("%99"), F.concat(F.lit("gone:"), F.col("dst"))).when(F.col("src").like("%55"), F.upper("dst")).otherwise(F.col("dst")),
    })
    return Graph(n, e)


_FLAWED = """, fn AS (SELECT id, CASE WHEN id LIKE '%7' THEN NULL ELSE label END AS label, CASE WHEN id LIKE '%33' THEN 'tool' ELSE file_type END AS file_type, source_file FROM nodes),
    fe AS (SELECT src, CASE WHEN src LIKE '%99' THEN 'gone:' || dst WHEN src LIKE '%55' THEN upper(dst) ELSE dst END AS dst, relation, CASE WHEN src LIKE '%21' THEN 'GUESSED' ELSE confidence END AS confidence, weight FROM edges)"""

query("validate_errors", _FLAWED + """SELECT 'node' AS kind, id, 'missing label' AS problem FROM fn WHERE label IS NULL UNION ALL SELECT 'node', id, 'unknown file_type' FROM fn WHERE file_type = 'tool'
    UNION ALL SELECT 'edge', src || '->' || dst, 'unknown confidence' FROM fe WHERE confidence = 'GUESSED'
    UNION ALL SELECT 'edge', src || '->' || dst, 'dangling dst' FROM fe WHERE dst NOT IN (SELECT id FROM nodes)""")(lambda g: B.validation_errors(_flawed(g)))
query("dangling_edges", _FLAWED + "SELECT src, dst, relation, 'dst' AS side FROM fe WHERE dst NOT IN (SELECT id FROM nodes)")(lambda g: B.dangling(_flawed(g)).select("src", "dst", "relation", "side"))
query("prune_dangling", _FLAWED + "SELECT relation, count(*) AS n FROM fe WHERE dst IN (SELECT id FROM nodes) GROUP BY 1")(lambda g: B.prune_dangling(_flawed(g)).edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")))
query("endpoint_norm_resolve", _FLAWED + """SELECT src, lower(dst) AS dst, relation FROM fe WHERE lower(dst) IN (SELECT id FROM nodes)""")(lambda g: B.resolve_endpoints(_flawed(g)).edges.select("src", "dst", "relation"))
query("file_type_fold", _FLAWED + "SELECT CASE file_type WHEN 'tool' THEN 'code' ELSE file_type END AS file_type, count(*) AS n FROM fn GROUP BY 1")(lambda g: _flawed(g).nodes.groupBy(B.fold_file_type(F.col("file_type")).alias("file_type")).agg(F.count(F.lit(1)).alias("n")))


@query("numeric_repair", """SELECT event_id, CASE WHEN event_type = 'error' THEN 1.0 WHEN value < 20 THEN 1.0 ELSE value - 20 END AS weight FROM events""", graph=False)
def _repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "error", "none").otherwise((F.col("value") - 20).cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", P.repaired_number(raw).alias("weight"))


query("diagnose_pairs", _FLAWED + """, d AS (SELECT src, dst, count(*) k, count(DISTINCT relation) r FROM fe GROUP BY 1, 2), u AS (SELECT least(src, dst), greatest(src, dst), sum(k) k FROM d GROUP BY 1, 2),
    x AS (SELECT count(*) k FROM fe GROUP BY src, dst, relation, confidence)
    SELECT (SELECT sum(k - 1) FROM d)::BIGINT AS directed_extra, (SELECT count(*) FROM d WHERE r > 1) AS relation_variants, 0::BIGINT AS context_variants, 0::BIGINT AS self_loops,
    (SELECT sum(k - 1) FROM u)::BIGINT AS undirected_extra, (SELECT sum(k - 1) FROM x)::BIGINT AS exact_extra, (SELECT count(*) FROM fe WHERE dst NOT IN (SELECT id FROM nodes)) AS dangling_ends""")(lambda g: B.diagnose(_flawed(g)))

_EVENTS = """, raw AS (SELECT 'u' || (user_id % 40) AS src, 'u' || (event_id % 37) AS dst, CASE event_type WHEN 'view' THEN 'references' WHEN 'click' THEN 'calls' WHEN 'purchase' THEN 'uses' WHEN 'signup' THEN 'imports' ELSE 'mentions' END AS relation, event_id AS ord FROM events)"""


def _event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.when(F.col("event_type") == "view", "references").when(F.col("event_type") == "click", "calls").when(F.col("event_type") == "purchase", "uses").when(F.col("event_type") == "signup", "imports").otherwise("mentions")
    at = lambda c, m: F.concat(F.lit("u"), (F.col(c) % m).cast("string"))
    return _table(spark, sf_dir, "events").select(at("user_id", 40).alias("src"), at("event_id", 37).alias("dst"), rel.alias("relation"), F.col("event_id").alias("ord"))


@query("edge_collapse", _EVENTS + """, t AS (SELECT least(src, dst) a, greatest(src, dst) b, *, src = least(src, dst) AS fwd, relation IN ('references', 'uses', 'mentions') AS gen FROM raw),
    g AS (SELECT a, b, coalesce(max({'r': relation, 'o': ord, 's': src, 'd': dst}) FILTER (fwd AND NOT gen), max({'r': relation, 'o': ord, 's': src, 'd': dst}) FILTER (fwd)) x,
        max({'r': relation, 'o': ord, 's': src, 'd': dst}) FILTER (NOT fwd AND NOT gen) vs, max({'r': relation, 'o': ord, 's': src, 'd': dst}) FILTER (NOT fwd) v,
        bool_or(fwd AND NOT gen) xs, list(DISTINCT relation) FILTER (NOT fwd AND NOT gen) vsr, list(DISTINCT relation) FILTER (NOT fwd) vr FROM t GROUP BY a, b),
    w AS (SELECT CASE WHEN v IS NULL THEN x WHEN x IS NULL THEN coalesce(vs, v) WHEN vs IS NOT NULL THEN CASE WHEN vsr = [x.r] THEN x ELSE vs END WHEN xs THEN x WHEN vr = [x.r] THEN x ELSE v END AS w FROM g)
    SELECT w.s AS src, w.d AS dst, w.r AS relation, w.o AS ord FROM w""", graph=False)
def _collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.collapse_edges(_event_edges(spark, sf_dir))


@query("import_self_loops", _EVENTS + "SELECT src, relation, count(*) AS n FROM raw WHERE NOT (src = dst AND relation = 'imports') GROUP BY 1, 2", graph=False)
def _loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.drop_import_loops(_event_edges(spark, sf_dir)).groupBy("src", "relation").agg(F.count(F.lit(1)).alias("n"))


def _as_code(g: Graph) -> Graph:
    """Files of the derived graph under names of languages: customers Python, suppliers Go, parts C, orders JavaScript."""
    ext = F.when(F.col("id").startswith("customer"), ".py").when(F.col("id").startswith("supplier"), ".go").when(F.col("id").startswith("part"), ".c").when(F.col("id").startswith("order"), ".js").otherwise(".tbl")
    return Graph(g.nodes.withColumn("source_file", F.concat(F.regexp_replace("source_file", r"\.tbl$", ""), ext)), g.edges)


query("cross_language_drop", """SELECT relation, confidence, count(*) AS n FROM edges WHERE relation <> 'imports_from' AND NOT (relation = 'calls' AND confidence = 'INFERRED') GROUP BY 1, 2""")(
    lambda g: B.drop_cross_language(_as_code(g)).edges.groupBy("relation", "confidence").agg(F.count(F.lit(1)).alias("n"))
)


@query("file_label_suffixes", """, f AS (SELECT DISTINCT source_file, regexp_extract(source_file, '[^/]*$') AS base FROM nodes), d AS (SELECT base FROM f GROUP BY 1 HAVING count(*) > 1)
    SELECT source_file AS id, source_file AS new_label FROM f JOIN d USING (base)""")
def _suffixes(g: Graph) -> DataFrame:
    files = g.nodes.select(F.col("source_file").alias("id"), P.basename(F.col("source_file")).alias("label"), "source_file").distinct()
    return B.file_label_suffixes(files)


def _origins(g: Graph) -> DataFrame:
    """Two rows for each node: an extracted one, and a semantic one of the same label (parts share labels)."""
    base = g.nodes.select("id", "label", "source_file", "file_type")
    ast = base.withColumn("origin", F.lit("ast"))
    ghost = base.select(F.concat(F.lit("g/"), F.col("id")).alias("id"), "label", "source_file", "file_type", F.lit(None).cast("string").alias("origin"))
    return ast.union(ghost)


_ORIGINS = """, o AS (SELECT id, label, source_file, 'ast' AS origin FROM nodes UNION ALL SELECT 'g/' || id, label, source_file, NULL FROM nodes)"""
query("ghost_merge", _ORIGINS + """, a AS (SELECT source_file, label, min(id) AS survivor FROM o WHERE origin = 'ast' GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT id, survivor FROM o JOIN a USING (source_file, label) WHERE origin IS NULL""")(lambda g: B.ghost_merge(_origins(g)))
query("node_confidence_stamp", _ORIGINS + """SELECT CASE WHEN origin = 'ast' THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence, CASE WHEN origin = 'ast' THEN 1.0::DOUBLE WHEN id LIKE '%3' THEN 0.2::DOUBLE ELSE 0.55::DOUBLE END AS confidence_score, count(*) AS n
    FROM (SELECT *, CASE WHEN origin IS NULL AND id LIKE '%3' THEN 1 END v FROM o) GROUP BY 1, 2""")(
    lambda g: B.stamp_confidence(_origins(g).withColumn("verification", F.when(F.col("origin").isNull() & F.col("id").like("%3"), "unverified"))).groupBy("confidence", "confidence_score").agg(F.count(F.lit(1)).alias("n"))
)
@query("build_graph", _FLAWED + """, f AS (SELECT id, CASE WHEN id LIKE '%7' THEN NULL ELSE label END AS label, CASE WHEN id LIKE '%33' THEN 'code' ELSE file_type END AS file_type,
        regexp_replace(source_file, '\\.tbl$', '') || CASE split_part(id, ':', 1) WHEN 'customer' THEN '.py' WHEN 'supplier' THEN '.go' WHEN 'part' THEN '.c' WHEN 'order' THEN '.js' ELSE '.tbl' END AS source_file FROM nodes),
    one AS (SELECT source_file, label, min(id) AS id FROM f WHERE label IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1), g AS (SELECT 'g/' || f.id AS id, f.label, f.file_type, one.id AS survivor FROM f LEFT JOIN one USING (source_file, label) WHERE f.id LIKE 'part:%'),
    x AS (SELECT src, CASE WHEN src LIKE 'order:%4' AND dst LIKE 'part:%' THEN 'g/' || dst WHEN src LIKE '%99' THEN 'gone:' || dst WHEN src LIKE '%55' THEN upper(dst) ELSE dst END AS dst, relation, CASE WHEN src LIKE '%21' THEN 'GUESSED' ELSE confidence END AS confidence, weight FROM edges),
    r AS (SELECT src, coalesce(g.survivor, CASE WHEN starts_with(dst, 'g/') THEN dst ELSE lower(dst) END) AS dst, relation, confidence, weight FROM x LEFT JOIN g ON x.dst = g.id WHERE NOT starts_with(dst, 'gone:') AND relation <> 'imports_from' AND NOT (relation = 'calls' AND confidence = 'INFERRED')),
    b AS (SELECT *, src LIKE '%8' AND relation IN ('references', 'uses') AND src < dst AS turned FROM r)
    SELECT 'node' AS kind, id AS key, label, file_type AS value FROM f UNION ALL SELECT 'node', id, label, file_type FROM g WHERE survivor IS NULL
    UNION ALL SELECT 'edge', CASE WHEN turned THEN dst || '|' || src ELSE src || '|' || dst END, CASE WHEN turned THEN 'mentions' ELSE relation END, CASE WHEN turned THEN 'AMBIGUOUS' ELSE confidence END FROM b
    UNION ALL SELECT 'edge', dst || '|' || src, 'mentions', 'AMBIGUOUS' FROM edges WHERE relation = 'imports_from' AND src LIKE '%8'""")
def _build(g: Graph) -> DataFrame:
    """Files under names of languages, flaws in nodes and edges, a semantic twin of each part that some orders use, and reverse mentions."""
    flawed = _as_code(_flawed(g))
    ast = flawed.nodes.withColumn("origin", F.lit("ast"))
    twins = ast.where("id LIKE 'part:%'").withColumns({"id": F.concat(F.lit("g/"), F.col("id")), "origin": F.lit(None).cast("string")})
    dst = F.when(F.col("src").like("order:%4") & F.col("dst").like("part:%"), F.concat(F.lit("g/"), F.col("dst"))).otherwise(F.col("dst"))
    e = flawed.edges.withColumn("dst", dst)
    back = g.edges.where("src LIKE '%8'").withColumns({"src": F.col("dst"), "dst": F.col("src"), "relation": F.lit("mentions"), "confidence": F.lit("AMBIGUOUS")}).select(e.columns)
    built, _ = B.assemble(ast.union(twins.select(ast.columns)), e.union(back))
    nodes = built.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key"), "label", F.col("file_type").alias("value"))
    return nodes.union(built.edges.select(F.lit("edge"), F.concat_ws("|", "src", "dst"), "relation", "confidence"))


query("unique_stub_rewire", """, s AS (SELECT 'stub:' || label AS id, label FROM (SELECT DISTINCT label FROM nodes)), d AS (SELECT label, min(id) AS target FROM nodes GROUP BY 1 HAVING count(*) = 1)
    SELECT id, target FROM s JOIN d USING (label)""")(
    lambda g: B.rewire_stubs(g.nodes.select("id", "label", "source_file").union(g.nodes.select("label").distinct().select(F.concat(F.lit("stub:"), F.col("label")), "label", F.lit(None).cast("string"))))
)
query("id_collision_survivor", """, t AS (SELECT 'c' || community AS id, label, source_file FROM nodes)
    SELECT id, label, source_file FROM (SELECT DISTINCT *, row_number() OVER (PARTITION BY id ORDER BY length(label), label, source_file) r FROM t) WHERE r = 1""")(
    lambda g: B.id_survivors(g.nodes.select(F.concat(F.lit("c"), F.col("community").cast("string")).alias("id"), "label", "source_file"))
)
query("raw_call_resolution", """, defs AS (SELECT id AS target, label AS callee, source_file AS f FROM nodes WHERE id LIKE 'part:%' OR id LIKE 'customer:%'),
    calls AS (SELECT DISTINCT e.src AS caller, n.label AS callee, CASE WHEN ends_with(e.src, '3') THEN n.source_file WHEN ends_with(e.src, '7') THEN 'part/x.tbl' ELSE 'orders/x.tbl' END AS f
        FROM edges e JOIN nodes n ON e.dst = n.id WHERE relation IN ('uses', 'calls')),
    met AS (SELECT caller, callee, target, CASE WHEN calls.f = defs.f THEN 0 WHEN split_part(calls.f, '/', 1) = split_part(defs.f, '/', 1) THEN 1 ELSE 2 END AS rank FROM calls JOIN defs USING (callee)),
    per AS (SELECT caller, callee, rank, count(*) AS k, min(target) AS target FROM met GROUP BY 1, 2, 3),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY caller, callee ORDER BY rank) AS r FROM per) WHERE r = 1 AND k = 1)
    SELECT DISTINCT caller, target, CASE WHEN rank = 0 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence FROM best""")(lambda g: B.resolve_calls(_raw_calls(g), g.nodes.where("id LIKE 'part:%' OR id LIKE 'customer:%'")))


def _raw_calls(g: Graph) -> DataFrame:
    """Orders call what they use by its label, from a file that is that of a definition, in its folder, or elsewhere."""
    named = g.nodes.select(F.col("id").alias("dst"), F.col("label").alias("callee"), F.col("source_file").alias("f"))
    file = F.when(F.col("src").endswith("3"), F.col("f")).when(F.col("src").endswith("7"), "part/x.tbl").otherwise("orders/x.tbl")
    return g.edges.where("relation IN ('uses', 'calls')").join(named, "dst").select(F.col("src").alias("caller"), "callee", file.alias("source_file")).distinct()


@query("hyperedge_remap", """, h AS (SELECT source_file AS id, id AS member FROM nodes), m AS (SELECT DISTINCT id, regexp_replace(member, '[13579]$', '0') AS member FROM h)
    SELECT id, count(*) AS n_members, sha256(string_agg(member, ',' ORDER BY member)) AS members FROM m GROUP BY 1""")
def _hyper(g: Graph) -> DataFrame:
    n = g.nodes
    hyper = n.groupBy(F.col("source_file").alias("id")).agg(F.min("source_file").alias("label"), F.array_sort(F.collect_list("id")).alias("nodes"))
    mapping = n.where(F.col("id").rlike("[13579]$")).select("id", F.regexp_replace("id", "[13579]$", "0").alias("survivor"))
    out = B.remap_hyperedges(hyper, mapping)
    return out.select("id", F.size("nodes").cast("bigint").alias("n_members"), F.sha2(F.array_join(F.array_sort("nodes"), ","), 256).alias("members"))


# -- lookups and retrieval

QUESTION = "customer canada 12"
query("node_lookup_tiers", """, t AS (SELECT id, lower(label) AS l, lower(id) AS i, trim(regexp_replace(lower(source_file), '[^a-z0-9]+', ' ', 'g')) AS s, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS k FROM nodes),
    r AS (SELECT id, CASE WHEN s = 'order 12' THEN 'source_exact' WHEN l = 'order 12' OR k = 'order 12' OR i = 'order 12' THEN 'exact' WHEN starts_with(l, 'order 12') OR starts_with(k, 'order 12') OR starts_with(i, 'order 12') THEN 'prefix'
        WHEN contains(l, 'order 12') OR contains(k, 'order 12') THEN 'substring' END AS tier FROM t) SELECT * FROM r WHERE tier IS NOT NULL""")(lambda g: R.lookup(g.nodes, "Order 12"))
query("context_filter", "SELECT src, dst, relation FROM edges WHERE context IN ('call', 'import')")(lambda g: R.context_filter(g, R.resolve_contexts("who calls imported modules")).edges.select("src", "dst", "relation"))
query("neighbors", """SELECT 'out' AS direction, dst AS other, relation, confidence FROM edges WHERE src = 'part:5' UNION ALL SELECT 'in', src, relation, confidence FROM edges WHERE dst = 'part:5'""")(lambda g: R.neighbours_of(g, "part:5"))
query("explain_connections", """, c AS (SELECT 'out' AS direction, dst AS other, relation, confidence FROM edges WHERE src = 'part:5' UNION ALL SELECT 'in', src, relation, confidence FROM edges WHERE dst = 'part:5')
    SELECT c.*, degree FROM c JOIN degrees ON other = id ORDER BY degree DESC, other, direction, relation LIMIT 20""")(lambda g: R.explain(g, "part:5").select("direction", "other", "relation", "confidence", "degree"))
query("idf", """, t AS (SELECT unnest(['customer', 'canada', '12']) AS term) SELECT term, count(*) FILTER (contains(lower(label), term)) AS df, ln(1 + count(*) / (1 + count(*) FILTER (contains(lower(label), term)))) AS idf FROM t, nodes GROUP BY 1""")(
    lambda g: R.idf(g.nodes, X.query_terms(QUESTION))
)
_SCORE = """, t AS (SELECT term, ln(1 + count(*) / (1 + count(*) FILTER (contains(lower(label), term)))) AS w FROM (SELECT unnest(['customer', 'canada', '12']) AS term), nodes GROUP BY 1),
    top AS (SELECT max(w) AS w FROM t),
    m AS (SELECT id, label, source_file, t.w, lower(label) AS l, contains(lower(source_file), term) AS in_src, lower(label) = term AS ex, starts_with(lower(label), term) AS pre, contains(lower(label), term) AS sub, JW AS jw FROM nodes, t),
    g AS (SELECT id, label, sum(CASE WHEN ex THEN 1000 * w WHEN pre THEN 100 * w ELSE 0 END) AS tiered, sum(CASE WHEN NOT ex AND NOT pre AND sub THEN w ELSE 0 END + CASE WHEN in_src THEN 0.5 * w ELSE 0 END
        + CASE WHEN NOT (ex OR pre OR sub) AND jw >= 0.85 THEN 2 * w * jw ELSE 0 END) AS flat, count(*) FILTER (ex OR pre OR sub) AS matched FROM m GROUP BY 1, 2),
    s AS (SELECT id, label, round(flat + tiered * (matched / 3.0) * (matched / 3.0), 6) AS score FROM g)
    SELECT id, label, score FROM s WHERE score > 0"""


def _scored(g: Graph) -> DataFrame:
    nodes = R.normed(g.nodes)
    return R.score_nodes(nodes, R.prepare(nodes, QUESTION), fuzzy=False)


_rounded = lambda df: df.select("id", "label", F.round("score", 6).alias("score"))
query("lexical_score", _SCORE.replace("JW", "0.0"))(lambda g: _rounded(_scored(g)))
query("hybrid_rank", _SCORE.replace("JW", "jaro_winkler_similarity(term, lower(label))") + " ORDER BY score DESC, length(label), id LIMIT 10")(lambda g: _rounded(R.hybrid_search(g, QUESTION)))
query("fuzzy_tier", """SELECT id, round(jaro_winkler_similarity('suplier#1', lower(label)), 6) AS sim FROM nodes""")(
    lambda g: g.nodes.select("id", F.round(X.jaro_winkler_column("suplier#1", F.lower("label")), 6).alias("sim"))
)


_SEEDS = _SCORE.replace("JW", "0.0").replace("SELECT id, label, score FROM s WHERE score > 0", "") + """, kept AS (SELECT * FROM (SELECT id, label, score, row_number() OVER (PARTITION BY lower(label) ORDER BY score DESC, length(label), id) AS r FROM s WHERE score > 0) WHERE r = 1),
    top3 AS (SELECT *, row_number() OVER (ORDER BY score DESC, length(label), id) AS k FROM kept), first AS (SELECT id, lower(label) AS key, k FROM top3 WHERE k <= 3 AND score >= 0.2 * (SELECT max(score) FROM kept)),
    one AS (SELECT m.id, m.label, t.term, CASE WHEN ex OR tok = t.term OR lower(m.id) = t.term THEN 10000 * t.w WHEN pre OR starts_with(tok, t.term) THEN 1000 * t.w ELSE 0 END
        + CASE WHEN ex THEN 1000 * t.w WHEN pre THEN 100 * t.w WHEN sub THEN t.w ELSE 0 END + CASE WHEN in_src THEN 0.5 * t.w ELSE 0 END AS score
        FROM (SELECT *, trim(regexp_replace(l, '[^a-z0-9]+', ' ', 'g')) AS tok FROM m) m JOIN t ON m.term = t.term),
    best AS (SELECT * FROM (SELECT one.*, row_number() OVER (PARTITION BY term ORDER BY score DESC, degree DESC, length(label), id) AS r FROM one JOIN degrees USING (id) WHERE score > 0) WHERE r = 1),
    more AS (SELECT id, term, row_number() OVER (PARTITION BY lower(label) ORDER BY term) AS r FROM best WHERE id NOT IN (SELECT id FROM first) AND lower(label) NOT IN (SELECT key FROM first))
    SELECT (row_number() OVER (ORDER BY part, k, term) - 1)::INT AS ord, id FROM (SELECT 1 AS part, k, '' AS term, id FROM first UNION ALL SELECT 2, 0, term, id FROM more WHERE r = 1)"""


@query("pick_seeds", _SEEDS.replace("t.w, lower(label) AS l", "t.w, t.term, lower(label) AS l"))
def _seeds(g: Graph) -> DataFrame:
    seeds = R.pick_seeds(written(_scored(g)), g, terms=X.query_terms(QUESTION))
    return g.nodes.sparkSession.createDataFrame(list(enumerate(seeds)), "ord int, id string")


@query("query_terms", r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower('where is get_user_' || conv_id || ' in Café über ' || coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM conversations),
    t AS (SELECT conv_id, turn, list_filter(flatten(list_transform(ws, lambda x: regexp_extract_all(x, '[\p{L}\p{N}_]+'))), lambda x: length(x) > 2 OR NOT regexp_full_match(x, '[a-z]*')) AS ts FROM w),
    s AS (SELECT conv_id, turn, ts, list_filter(ts, lambda x: NOT list_contains([""" + ", ".join(f"'{w}'" for w in sorted(X.STOPWORDS)) + """], x)) AS content FROM t)
    SELECT conv_id, turn, array_to_string(CASE WHEN len(content) > 0 THEN content ELSE ts END, ' ') AS terms FROM s""", graph=False)
def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat(F.lit("where is get_user_"), F.col("conv_id").cast("string"), F.lit(" in Café über "), F.coalesce("text", F.lit("")))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.terms(asked), " ").alias("terms"))


@query("vector_tier", """, q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
    s AS (SELECT vec_id AS id, list_inner_product(embedding::DOUBLE[], e::DOUBLE[]) / (greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-8) * greatest(sqrt(list_inner_product(e::DOUBLE[], e::DOUBLE[])), 1e-8)) AS sim FROM embeddings, q)
    SELECT id, round(sim, 6) AS sim, CASE WHEN sim >= .85 THEN 80.0 WHEN sim >= .7 THEN 20.0 WHEN sim >= .55 THEN 5.0 WHEN sim >= .4 THEN 1.0 ELSE 0.0 END::DOUBLE AS tier_weight FROM s""", graph=False)
def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    goal = e.orderBy("vec_id").select("embedding").first()[0]
    return R.similarity_to(e, goal).select("id", F.round("sim", 6).alias("sim"), "tier_weight")


@query("token_budget_cut", "SELECT * FROM (SELECT conv_id AS doc, turn AS ord, (sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS used FROM conversations) WHERE used <= 600", graph=False)
def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.col("text").alias("line"))
    return R.cut_to_budget(lines, 200).select("doc", "ord", "used")


@query("query_tokens", "SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+'), ' ') AS tokens FROM conversations", graph=False)
def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", X.label_tokens(X.norm_label(F.col("text"))).alias("tokens"))


# -- traversals

_BFS = """, n AS (SELECT a AS id, b AS other FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b),
    h AS (SELECT greatest(50, (SELECT degree FROM (SELECT degree, row_number() OVER (ORDER BY degree) r FROM degrees) WHERE r = (SELECT floor(count(*) * 0.99)::BIGINT + 1 FROM degrees))) AS t),
    h1 AS (SELECT DISTINCT other AS id FROM n WHERE id = 'order:1'), h2 AS (SELECT DISTINCT n.other AS id FROM n JOIN h1 USING (id) JOIN degrees USING (id), h WHERE degree < t),
    seen AS (SELECT id, min(hop) AS hop FROM (SELECT 'order:1' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY 1)"""
query("bfs_depth2", _BFS + "SELECT id, hop FROM seen")(lambda g: T.bfs(g, ["order:1"]))
query("induced_subgraph", _BFS + "SELECT src, dst, relation FROM edges WHERE src <> dst AND src IN (SELECT id FROM seen) AND dst IN (SELECT id FROM seen)")(lambda g: T.induced_edges(g, T.bfs(g, ["order:1"])).select("src", "dst", "relation"))
query("affected_depth2", """, e AS (SELECT * FROM edges WHERE relation IN ('calls', 'references', 'imports_from', 'uses')), a AS (SELECT src AS id, min(relation) AS relation FROM e WHERE dst = 'supplier:3' GROUP BY 1),
    b AS (SELECT src AS id, min(e.relation) AS relation FROM e JOIN a ON e.dst = a.id WHERE src NOT IN (SELECT id FROM a) AND src <> 'supplier:3' GROUP BY 1)
    SELECT id, 1 AS hop, relation FROM a UNION ALL SELECT id, 2, relation FROM b""")(lambda g: T.affected(g, "supplier:3"))


@query("shortest_path", """, n AS (SELECT a AS id, b AS other FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b),
    p0 AS (SELECT 'supplier:3' AS id, ['supplier:3'] AS path), p1 AS (SELECT other AS id, min(list_append(path, other)) AS path FROM n JOIN p0 USING (id) GROUP BY 1),
    p2 AS (SELECT other AS id, min(list_append(path, other)) AS path FROM n JOIN p1 USING (id) WHERE other NOT IN (SELECT id FROM p0 UNION SELECT id FROM p1) GROUP BY 1),
    p3 AS (SELECT other AS id, min(list_append(path, other)) AS path FROM n JOIN p2 USING (id) WHERE other NOT IN (SELECT id FROM p0 UNION SELECT id FROM p1 UNION SELECT id FROM p2) GROUP BY 1),
    p4 AS (SELECT other AS id, min(list_append(path, other)) AS path FROM n JOIN p3 USING (id) WHERE other NOT IN (SELECT id FROM p0 UNION SELECT id FROM p1 UNION SELECT id FROM p2 UNION SELECT id FROM p3) GROUP BY 1),
    every AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)
    SELECT k::INT AS ord, path[k + 1] AS id FROM every, unnest(range(0, len(path))) t(k) WHERE id = 'region:2'""")
def _path(g: Graph) -> DataFrame:
    path = T.shortest_path(g, "supplier:3", "region:2", directed=False)
    return g.nodes.sparkSession.createDataFrame(list(enumerate(path)), "ord int, id string")


@query("import_cycles", """, k AS (SELECT count(*) // 3 AS n FROM events), e AS (SELECT DISTINCT 'f' || (event_id // 3) AS src, 'f' || ((event_id * 7919 + user_id) % n) AS dst FROM events, k WHERE event_id // 3 <> (event_id * 7919 + user_id) % n),
    w2 AS (SELECT [src, dst] AS p, dst AS z FROM e WHERE src < dst), w3 AS (SELECT list_append(p, dst) AS p, dst AS z FROM w2 JOIN e ON z = src WHERE dst > p[1] AND NOT list_contains(p, dst)),
    w4 AS (SELECT list_append(p, dst) AS p, dst AS z FROM w3 JOIN e ON z = src WHERE dst > p[1] AND NOT list_contains(p, dst)), w5 AS (SELECT list_append(p, dst) AS p, dst AS z FROM w4 JOIN e ON z = src WHERE dst > p[1] AND NOT list_contains(p, dst)),
    c AS (SELECT p FROM w2 JOIN e ON z = src AND dst = p[1] UNION ALL SELECT p FROM w3 JOIN e ON z = src AND dst = p[1] UNION ALL SELECT p FROM w4 JOIN e ON z = src AND dst = p[1] UNION ALL SELECT p FROM w5 JOIN e ON z = src AND dst = p[1])
    SELECT len(p)::INT AS length, array_to_string(p, ' -> ') AS cycle FROM c""", graph=False)
def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an import: a file holds three, and each leads to a file by rule."""
    events = _table(spark, sf_dir, "events")
    n = F.lit(events.count() // 3)
    file = lambda x: F.concat(F.lit("f"), x.cast("bigint").cast("string"))
    return T.import_cycles(events.select(file(F.floor(F.col("event_id") / 3)).alias("src"), file((F.col("event_id") * 7919 + F.col("user_id")) % n).alias("dst")))


@query("connected_components", """WITH b AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM b) SELECT 'e' || event_id AS id, min('e' || event_id) OVER (PARTITION BY user_id, s) AS component FROM s""", graph=False)
def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user that follow each other within a day form chains of many hops."""
    events = _table(spark, sf_dir, "events")
    name = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.col("ts") - F.lag("ts").over(order) <= F.expr("INTERVAL 1 DAY")
    steps = events.select(name.alias("src"), F.when(near, F.lag(name).over(order)).alias("dst")).where("dst IS NOT NULL")
    return T.connected_components(events.select(name.alias("id")), steps)


query("graph_components")(lambda g: T.connected_components(g.nodes.select("id"), g.edges))
query("betweenness_topk")(lambda g: T.betweenness(g).orderBy(F.desc("betweenness"), "id").limit(10))
query("community_detection", once=True)(lambda g: C.detect(g))


@query("dfs_order")
def _dfs(g: Graph) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame(list(enumerate(T.dfs(g, ["nation:3"], 1))), "ord int, id string")


# -- entity resolution


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents as entities: labels with exact and near repeats."""
    line = F.split("text", "\n")[0]
    return _table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), line.alias("label"), F.lit("concept").alias("file_type"), F.concat(F.col("source"), F.lit(".md")).alias("source_file"),
        F.lit(None).cast("int").alias("community"),
    )


_ENT = """WITH ent AS (SELECT 'd' || doc_id AS id, string_split(text, chr(10))[1] AS label, source || '.md' AS source_file FROM documents),
    nrm AS (SELECT *, trim(regexp_replace(replace(lower(label), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm FROM ent)"""


@query("label_entropy", _ENT + """, ch AS (SELECT id, unnest(string_split(norm, '')) AS c FROM nrm WHERE norm <> ''), f AS (SELECT id, c, count(*) k FROM ch WHERE c <> '' GROUP BY 1, 2), t AS (SELECT id, sum(k) n FROM f GROUP BY 1)
    SELECT id, norm, coalesce(round(h, 6), 0.0) AS bits FROM nrm LEFT JOIN (SELECT id, -sum(k / n * log2(k / n)) AS h FROM f JOIN t USING (id) GROUP BY 1) USING (id)""", graph=False)
def _entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir).withColumn("norm", X.merge_norm(F.col("label")))
    return e.select("id", "norm", F.round(X.entropy(F.col("norm")), 6).alias("bits"))


@query("dedup_norm_exact", _ENT + """SELECT norm, source_file, count(*) AS n, min(id) AS least FROM nrm WHERE norm <> '' GROUP BY 1, 2 HAVING count(*) > 1""", graph=False)
def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.mergeable(_entities(spark, sf_dir))
    return e.groupBy("norm", "source_file").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1")


@query("shingle_jaccard", _ENT + """, s AS (SELECT DISTINCT id, substr(replace(norm, ' ', ''), i, 3) AS g FROM nrm, unnest(range(1, length(replace(norm, ' ', '')) - 1)) t(i) WHERE length(replace(norm, ' ', '')) >= 3),
    q AS (SELECT g FROM s WHERE id = 'd0'), c AS (SELECT count(*) c FROM q)
    SELECT id, round(count(*) FILTER (g IN (SELECT g FROM q)) / (count(*) + max(c.c) - count(*) FILTER (g IN (SELECT g FROM q))), 6) AS jaccard FROM s, c GROUP BY 1""", graph=False)
def _jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.col("flat")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(flat) - 2), lambda i: F.substring(flat, i, F.lit(3))))
    flattened = _entities(spark, sf_dir).withColumn("flat", F.replace(X.merge_norm(F.col("label")), F.lit(" "), F.lit("")))
    s = flattened.where(F.length(flat) >= 3).select("id", grams.alias("g"))
    goal = F.array(*[F.lit(x) for x in (s.where("id = 'd0'").select("g").first() or [[]])[0]]).cast("array<string>")
    return s.select("id", F.round(F.size(F.array_intersect("g", goal)) / F.size(F.array_union("g", goal)), 6).alias("jaccard"))


@query("lsh_pairs", graph=False)
def _lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.lsh_pairs(_entities(spark, sf_dir)).select("id_a", "id_b", "norm_a", "norm_b")


@query("numeric_token_veto", """WITH p AS (SELECT a.c_custkey AS a, b.s_suppkey AS b, lower(c_name) AS x, lower(s_name) AS y FROM customer a JOIN supplier b ON a.c_nationkey = b.s_nationkey),
    n AS (SELECT *, list_sort(list_transform(regexp_extract_all(x, '\\d+'), lambda v: coalesce(nullif(ltrim(v, '0'), ''), '0'))) nx, list_sort(list_transform(regexp_extract_all(y, '\\d+'), lambda v: coalesce(nullif(ltrim(v, '0'), ''), '0'))) ny FROM p)
    SELECT a, b, x <> y AND nx <> ny AS veto FROM n""", graph=False)
def _veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    # equal labels hold equal numbers, so that numbers alone decide
    side = lambda name, x, key: _table(spark, sf_dir, name).select(F.col(f"{x}_nationkey").alias("nation"), F.col(f"{x}_{key}").alias(key), E.number_key(F.lower(f"{x}_name")).alias(f"{x}_numbers"))
    met = E.paired(side("customer", "c", "custkey"), side("supplier", "s", "suppkey"), "nation")
    return met.select(F.col("custkey").alias("a"), F.col("suppkey").alias("b"), (F.col("c_numbers") != F.col("s_numbers")).alias("veto"))


@query("dedup_remap", graph=False)
def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _entities(spark, sf_dir)
    return E.deduplicate(n, n.select(F.col("id").alias("src"), F.lit("d0").alias("dst")))[2]


@query("tag_vocab", """WITH t AS (SELECT trim(regexp_replace(regexp_replace(lower(trim(x)), '[\\s\\-]+', '_', 'g'), '_+', '_', 'g'), '_') AS tag FROM (SELECT unnest(string_split(p_type || '|' || p_brand, '|')) AS x FROM part)) SELECT tag, count(*) AS n FROM t WHERE tag <> '' GROUP BY 1""", graph=False)
def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tag_vocabulary(_table(spark, sf_dir, "part").select(F.array("p_type", "p_brand").alias("tags")))


@query("canonical_tags", """WITH v AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS tag FROM part), t AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) || CASE p_partkey % 4 WHEN 0 THEN 's' WHEN 1 THEN 'es' WHEN 2 THEN '' ELSE '_x' END AS tag FROM part),
    f AS (SELECT tag, 0 AS rank, tag AS v FROM t UNION ALL SELECT tag, 1, left(tag, -1) FROM t WHERE ends_with(tag, 's') AND NOT ends_with(tag, 'ss') UNION ALL SELECT tag, 2, left(tag, -2) FROM t WHERE ends_with(tag, 'es') UNION ALL SELECT tag, 3, tag || 's' FROM t),
    h AS (SELECT f.tag, min({'r': rank, 'v': v.tag}) AS m FROM f JOIN v ON f.v = v.tag GROUP BY 1) SELECT t.tag, coalesce(h.m.v, t.tag) AS canonical FROM t LEFT JOIN h USING (tag)""", graph=False)
def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    noun = F.split("p_name", " ")[1]
    ending = F.when(F.col("p_partkey") % 4 == 0, "s").when(F.col("p_partkey") % 4 == 1, "es").when(F.col("p_partkey") % 4 == 2, "").otherwise("_x")
    return E.canonical_tags(part.select(F.concat(noun, ending).alias("tag")), E.tag_vocabulary(part.select(F.array(noun).alias("tags"))))


# -- graph maintenance


def _next(g: Graph) -> Graph:
    """A later version of the graph: nodes whose id ends in 4 are gone, those in 5 are new under another id."""
    moved = lambda c: F.when(F.col(c).like("%5"), F.concat(F.lit("new/"), F.col(c))).otherwise(F.col(c))
    n = g.nodes.where("id NOT LIKE '%4'").withColumn("id", moved("id"))
    return Graph(n, g.edges.where("src NOT LIKE '%4' AND dst NOT LIKE '%4'").withColumns({"src": moved("src"), "dst": moved("dst")}))


query("graph_diff", """, n2 AS (SELECT CASE WHEN id LIKE '%5' THEN 'new/' || id ELSE id END AS id FROM nodes WHERE id NOT LIKE '%4'),
    e2 AS (SELECT CASE WHEN src LIKE '%5' THEN 'new/' || src ELSE src END AS src, CASE WHEN dst LIKE '%5' THEN 'new/' || dst ELSE dst END AS dst, relation FROM edges WHERE src NOT LIKE '%4' AND dst NOT LIKE '%4'),
    k1 AS (SELECT DISTINCT least(src, dst) || '|' || greatest(src, dst) || '|' || relation AS key FROM edges), k2 AS (SELECT DISTINCT least(src, dst) || '|' || greatest(src, dst) || '|' || relation AS key FROM e2),
    d AS (SELECT 'added' AS change, 'node' AS kind, id AS key FROM (SELECT id FROM n2 EXCEPT SELECT id FROM nodes) UNION ALL SELECT 'removed', 'node', id FROM (SELECT id FROM nodes EXCEPT SELECT id FROM n2)
        UNION ALL SELECT 'added', 'edge', key FROM (FROM k2 EXCEPT FROM k1) UNION ALL SELECT 'removed', 'edge', key FROM (FROM k1 EXCEPT FROM k2))
    SELECT change, kind, key FROM d""")(lambda g: M.graph_diff(g, _next(g)))
query("merge_by_source", """, fresh AS (SELECT DISTINCT source_file FROM nodes WHERE id LIKE 'part:1%') SELECT source_file, CASE WHEN source_file IN (SELECT source_file FROM fresh) THEN 'new' ELSE 'old' END AS version, count(*) FILTER (source_file NOT IN (SELECT source_file FROM fresh) OR id LIKE 'part:1%') AS n
    FROM nodes GROUP BY 1, 2""")(
    lambda g: M.merge_by_source(g.nodes.withColumn("version", F.lit("old")), g.nodes.where("id LIKE 'part:1%'").withColumn("version", F.lit("new"))).groupBy("source_file", "version").agg(F.count(F.lit(1)).alias("n"))
)
query("prune_sources", """, kept AS (SELECT * FROM nodes WHERE source_file NOT LIKE 'part/%') SELECT relation, count(*) AS n FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept) GROUP BY 1""")(
    lambda g: M.prune_sources(g, g.nodes.where("source_file LIKE 'part/%'")).edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
)
query("loss_guard", """SELECT id, source_file FROM nodes WHERE id LIKE '%4' AND id NOT LIKE 'order%'""")(
    lambda g: M.lost_nodes(g, Graph(g.nodes.where("id NOT LIKE '%4'"), g.edges), g.nodes.where("id LIKE 'order%'")).select("id", "source_file")
)
query("prefix_global", "SELECT 'shop::' || id AS id, id AS local_id, 'shop' AS repo, community + 1000 AS community FROM nodes")(
    lambda g: M.prefixed(g, "shop", 1000).nodes.select("id", "local_id", "repo", "community")
)
query("prune_repo", "SELECT relation, count(*) AS n FROM edges WHERE src NOT LIKE 'part%' AND dst NOT LIKE 'part%' GROUP BY 1")(
    lambda g: M.prune_repo(Graph(g.nodes.withColumn("repo", F.split("id", ":")[0]), g.edges), "part").edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
)
@query("graph_union", """, n2 AS (SELECT id, CASE WHEN id LIKE '%1' THEN NULL ELSE label END AS label, community + 5 AS community FROM nodes WHERE id NOT LIKE '%2'),
    e2 AS (SELECT src, dst, relation, 'AMBIGUOUS' AS confidence, weight + 1 AS weight FROM edges WHERE dst LIKE '%1')
    SELECT 'node' AS kind, id AS key, coalesce(n2.label, nodes.label) AS label, coalesce(n2.community, nodes.community)::DOUBLE AS value FROM nodes LEFT JOIN n2 USING (id)
    UNION ALL SELECT 'edge', src || '|' || dst || '|' || relation, coalesce(e2.confidence, edges.confidence), coalesce(e2.weight, edges.weight) FROM edges LEFT JOIN e2 USING (src, dst, relation)""")
def _union(g: Graph) -> DataFrame:
    """The graph and a later one that states other communities, fewer labels, and other weights of some edges."""
    n = g.nodes.where("id NOT LIKE '%2'").withColumns({"label": F.when(~F.col("id").like("%1"), F.col("label")), "community": F.col("community") + 5})
    e = g.edges.where("dst LIKE '%1'").withColumns({"confidence": F.lit("AMBIGUOUS"), "weight": F.col("weight") + 1})
    u = M.union_graphs(g, Graph(n, e))
    nodes = u.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key"), "label", F.col("community").cast("double").alias("value"))
    return nodes.union(u.edges.select(F.lit("edge"), F.concat_ws("|", "src", "dst", "relation"), "confidence", "weight"))


query("external_label_dedup", """, x AS (SELECT id, label, min(id) OVER (PARTITION BY label) AS survivor FROM nodes) SELECT id, survivor FROM x WHERE id <> survivor""")(
    lambda g: M.merge_externals(g.nodes.withColumn("source_file", F.lit("")))
)
query("cross_repo_types", """, t AS (SELECT id, label, split_part(id, ':', 1) AS ns, split_part(source_file, '/', 2) AS repo FROM nodes), k AS (SELECT ns, label, repo, count(*) AS k, min(id) AS least FROM t GROUP BY 1, 2, 3),
    w AS (SELECT ns, label, sum(k) AS n, count(*) AS n_repos, min(least) AS class FROM k GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT id, class, n_repos, (n - k)::BIGINT AS n_links FROM t JOIN k USING (ns, label, repo) JOIN w USING (ns, label)""")(
    lambda g: M.type_classes(g.nodes.select("id", "label", F.split("id", ":")[0].alias("namespace"), F.split("source_file", "/")[1].alias("repo")))
)


@query("incremental_detect", """WITH d AS (SELECT 'doc' || doc_id AS path, md5(text) AS h FROM documents WHERE doc_id % 11 <> 3), m AS (SELECT 'doc' || doc_id AS path, CASE WHEN doc_id % 7 = 1 THEN 'x' ELSE md5(text) END AS h FROM documents WHERE doc_id % 13 <> 5)
    SELECT coalesce(d.path, m.path) AS path, CASE WHEN m.h IS NULL THEN 'new' WHEN d.h IS NULL THEN 'deleted' WHEN d.h = m.h THEN 'unchanged' ELSE 'changed' END AS state FROM d FULL JOIN m USING (path)""", graph=False)
def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the manifest and the disk of the fixture differ by rule; all of both is compared
    docs = _table(spark, sf_dir, "documents")
    row = lambda h: (F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), h.alias("hash"))
    disk = docs.where("doc_id % 11 <> 3").select(*row(F.md5(F.col("text").cast("binary"))))
    manifest = docs.where("doc_id % 13 <> 5").select(*row(F.when(F.col("doc_id") % 7 == 1, "x").otherwise(F.md5(F.col("text").cast("binary")))))
    return M.manifest_changes(disk, manifest)


@query("embedding_delta", """WITH n AS (SELECT page_id AS id, sha256(html) AS h FROM pages WHERE page_id % 9 <> 4), s AS (SELECT page_id AS id, CASE WHEN page_id % 5 = 2 THEN '' ELSE sha256(html) END AS h FROM pages WHERE page_id % 8 <> 3)
    SELECT coalesce(n.id, s.id) AS id, CASE WHEN n.h IS NULL THEN 'drop' WHEN n.h = s.h THEN 'keep' ELSE 'embed' END AS action FROM n FULL JOIN s USING (id)""", graph=False)
def _embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    stored = pages.where("id % 8 <> 3").select("id", F.when(F.col("id") % 5 == 2, "").otherwise(F.sha2(F.col("text"), 256)).alias("text_hash"))
    return M.embedding_delta(pages.where("id % 9 <> 4"), stored)


# -- pull requests and lessons


def _prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pull request for each hour of events, by rule on its events."""
    e = _table(spark, sf_dir, "events").withColumn("number", F.floor(F.unix_timestamp("ts") / 3600).cast("int"))
    return e.groupBy("number").agg(
        F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("n"), F.min("event_type").alias("t"), F.collect_set(F.concat(F.lit("Brand#"), (F.col("user_id") % 55).cast("string"), F.lit(".tbl"))).alias("files"),
    )


@query("pr_impact", """, f AS (SELECT source_file, list_sort(list(DISTINCT community)) cs, count(*) n FROM nodes GROUP BY 1), p AS (SELECT DISTINCT floor(epoch(ts) / 3600)::INT AS number, 'Brand#' || (user_id % 55) || '.tbl' AS file FROM events),
    h AS (SELECT number, f.* FROM p JOIN f ON f.source_file = file OR ends_with(f.source_file, '/' || file) OR ends_with(file, '/' || f.source_file)),
    c AS (SELECT number, list_sort(list(DISTINCT c)) AS cs FROM (SELECT number, unnest(cs) AS c FROM h) GROUP BY 1), s AS (SELECT number, sum(n)::BIGINT AS n FROM h GROUP BY 1)
    SELECT number, coalesce(array_to_string(cs, ','), '') AS communities, coalesce(n, 0) AS n_nodes FROM (SELECT DISTINCT number FROM p) LEFT JOIN c USING (number) LEFT JOIN s USING (number)""", graph=False)
def _impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.impact(_prs(spark, sf_dir), derived_graph(spark, sf_dir).nodes).select("number", F.array_join("communities", ",").alias("communities"), "n_nodes")


@query("pr_status", """WITH p AS (SELECT floor(epoch(ts) / 3600)::INT AS number, max(ts) u, count(*) n, min(event_type) t FROM events GROUP BY 1)
    SELECT number, CASE WHEN n % 5 = 0 THEN 'WRONG-BASE' WHEN t = 'error' THEN 'CI-FAIL' WHEN n % 7 = 0 THEN 'CHANGES-REQ' WHEN n % 11 = 0 THEN 'DRAFT' WHEN date_diff('day', u::DATE, (SELECT max(ts)::DATE FROM events)) >= 14 THEN 'STALE'
    WHEN n % 2 = 0 THEN 'APPROVED' WHEN t = 'signup' THEN 'PENDING' ELSE 'READY' END AS status FROM p""", graph=False)
def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    prs = _prs(spark, sf_dir).select(
        "number", "updated_at", F.when(n % 5 == 0, "old").otherwise("main").alias("base"), F.when(F.col("t") == "error", "FAILURE").when(F.col("t") == "signup", "PENDING").otherwise("SUCCESS").alias("ci_status"),
        F.when(n % 7 == 0, "CHANGES_REQUESTED").when(n % 2 == 0, "APPROVED").alias("review"), (n % 11 == 0).alias("is_draft"),
    )
    now = _table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return W.status(prs, "main", F.lit(now))


@query("pr_conflicts", """, f AS (SELECT DISTINCT source_file, community FROM nodes), p AS (SELECT DISTINCT floor(epoch(ts) / 3600)::INT AS number, 'Brand#' || (user_id % 55) || '.tbl' AS file FROM events),
    h AS (SELECT DISTINCT number, community FROM p JOIN f ON ends_with(f.source_file, '/' || file)) SELECT community, count(*) AS n FROM h GROUP BY 1 HAVING count(*) > 1""", graph=False)
def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.conflicts(W.impact(_prs(spark, sf_dir), derived_graph(spark, sf_dir).nodes)).select("community", "n")


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as memory documents: purchases useful, errors dead ends, signups corrected."""
    kind = F.when(F.col("event_type") == "purchase", "useful").when(F.col("event_type") == "error", "dead_end").when(F.col("event_type") == "signup", "corrected")
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), F.col("ts").alias("date"), kind.alias("outcome"), F.concat(F.lit("q"), (F.col("event_id") % 97).cast("string")).alias("question"),
        F.array(F.concat(F.lit("customer:"), (F.col("user_id") % 300).cast("string")), F.concat(F.lit("part:"), (F.col("event_id") % 300).cast("string"))).alias("source_nodes"),
    )


_LESSONS = """WITH d AS (SELECT ts, CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END AS s, unnest(['customer:' || (user_id % 300), 'part:' || (event_id % 300)]) AS node FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
    l AS (SELECT node, count(*) FILTER (s > 0) AS pos, count(*) FILTER (s < 0) AS neg, round(sum(s * pow(0.5, greatest(epoch_us(TIMESTAMP '2025-01-01') - epoch_us(ts), 0) / 86400000000.0 / 30)), 6) AS score FROM d GROUP BY 1)"""


@query("lessons_decay", _LESSONS + """SELECT node, pos, neg, score, CASE WHEN pos > 0 AND neg > 0 THEN 'contested' WHEN pos >= 2 THEN 'preferred' WHEN pos > 0 THEN 'tentative' ELSE 'dead_end' END AS verdict FROM l""", graph=False)
def _lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.lessons(_memory(spark, sf_dir), F.lit("2025-01-01").cast("timestamp")).drop("last")


@query("latest_by_question", "SELECT 'q' || (event_id % 97) AS question, max(ts) AS date, arg_max(event_id, {'t': ts, 'e': event_id}) AS doc_id FROM events GROUP BY 1", graph=False)
def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.latest_by_question(_memory(spark, sf_dir))


# -- documents and pages

query("word_counts", "SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x0B]+'), lambda w: w <> ''))::INT AS n_words FROM documents", graph=False)(
    lambda spark, sf_dir: _table(spark, sf_dir, "documents").select("doc_id", D.word_count(F.coalesce("text", F.lit(""))).alias("n_words"))
)
query("paper_signals", "SELECT doc_id, " + " + ".join(f"regexp_matches(substr(text, 1, 3000), '{rx}')::INT" for rx in P.PAPER_SIGNALS) + " AS n_signals FROM documents", graph=False)(
    lambda spark, sf_dir: _table(spark, sf_dir, "documents").select("doc_id", P.paper_signals(F.col("text")).alias("n_signals"))
)
query("text_slices", "SELECT doc_id, k::INT AS i, md5(substr(text, k * 1000 + 1, 1000)) AS digest FROM documents, unnest(range(0, (greatest(length(text), 1) + 999) // 1000)) t(k) WHERE text IS NOT NULL", graph=False)(
    lambda spark, sf_dir: D.fixed_slices(_table(spark, sf_dir, "documents"), 1000).select("doc_id", "i", F.md5(F.col("slice").cast("binary")).alias("digest"))
)
query("best_slices", None, graph=False)(lambda spark, sf_dir: D.best_slices(_table(spark, sf_dir, "documents"), 1000).select("doc_id", "i", F.length("slice").alias("n")))
query("url_classify", """SELECT page_id, CASE WHEN contains(lower(url), 'twitter.com') OR contains(lower(url), 'x.com') THEN 'tweet' WHEN contains(lower(url), 'arxiv.org') THEN 'arxiv' WHEN contains(lower(url), 'github.com') THEN 'github'
    WHEN contains(lower(url), 'youtube.com') OR contains(lower(url), 'youtu.be') THEN 'youtube' WHEN regexp_matches(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*[^?#]*\\.pdf($|[?#])') THEN 'pdf'
    WHEN regexp_matches(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/[^?#]*\\.(png|jpg|jpeg|webp|gif)($|[?#])') THEN 'image' ELSE 'webpage' END AS kind FROM pages""", graph=False)(
    lambda spark, sf_dir: _table(spark, sf_dir, "pages").select("page_id", D.url_type(F.col("url")).alias("kind"))
)
query("html_to_text", """SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 8000) AS body FROM pages""", graph=False)(
    lambda spark, sf_dir: _table(spark, sf_dir, "pages").select("page_id", D.html_text(F.col("html")).alias("body"))
)
query("page_links", """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=["'']([^"''#]+)', 1)) AS href FROM pages) GROUP BY 1, 2""", graph=False)(
    lambda spark, sf_dir: D.html_links(_table(spark, sf_dir, "pages"))
)
_PATHS = (
    (".env", None, True), ("main.py", "code", False), ("notes.md", "document", False), ("paper.pdf", "paper", False), ("logo.PNG", "image", False), ("talk.mp4", "video", False), ("id_rsa", None, True),
    ("secrets/db.txt", "document", True), ("api_token.json", "code", True), ("noext", None, False), ("pyproject.toml", "code", False), ("view.blade.php", "code", False), ("server.pem", None, True), (".env.example", None, False),
    ("internal/secrets/store.go", "code", False), ("x.zzz", None, False), ("table.xlsx", "document", False), ("Icon.imageset/icon.pdf", None, False),
)


@query("path_classes", "WITH n AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}', {'NULL' if k is None else repr(k)}, {s})" for i, (p, k, s) in enumerate(_PATHS)) + f""") t(i, name, category, sensitive))
    SELECT source || '/' || doc_id || '/' || name AS path, category, sensitive FROM documents JOIN n ON doc_id % {len(_PATHS)} = i""", graph=False)
def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a path of one of several kinds."""
    names = F.array(*[F.lit(p) for p, *_ in _PATHS])
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"), F.get(names, (F.col("doc_id") % len(_PATHS)).cast("int")))
    return _table(spark, sf_dir, "documents").select(path.alias("path")).select("path", P.classify_path(F.col("path")).alias("category"), D.is_sensitive(F.col("path")).alias("sensitive"))


query("token_reduction", "SELECT floor(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x0B]+'), lambda w: w <> ''))) * 100 / 75)::BIGINT AS corpus_tokens, round(avg(length(text) // 4), 6) AS query_tokens, round(floor(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x0B]+'), lambda w: w <> ''))) * 100 / 75) / round(avg(length(text) // 4), 6), 6) AS reduction FROM documents", graph=False)(
    lambda spark, sf_dir: D.token_reduction(_table(spark, sf_dir, "documents"), D.token_estimate(F.col("text")))
)


@query("chunk_packing", graph=False)
def _pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return D.pack(docs.select(F.concat(F.lit("s"), (F.col("doc_id") % 50).cast("string"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), D.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens")), 4000)


# -- streams and sinks

query("session_debounce", """WITH e AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 3 SECOND THEN 0 ELSE 1 END AS brk FROM events), s AS (SELECT *, sum(brk) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT min(ts) AS "start", max(ts) + INTERVAL 3 SECOND AS "end", count(*) AS n FROM s GROUP BY s""", graph=False)(lambda spark, sf_dir: watch.debounce(_table(spark, sf_dir, "events")))
query("cypher_export", """SELECT 'node' AS kind, 'MERGE (n:' || upper(file_type[1]) || file_type[2:] || ' {id: ''' || id || ''', label: ''' || replace(replace(label, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)) || '''});' AS value FROM nodes
    UNION ALL SELECT 'edge', 'MATCH (a {id: ''' || src || '''}), (b {id: ''' || dst || '''}) MERGE (a)-[:' || upper(relation) || ' {confidence: ''' || confidence || '''}]->(b);' FROM edges""")(S.cypher)
query("graphml_export", None, once=True)(S.graphml)
query("note_export", None, once=True)(S.notes)
