"""Operators on micro-graphs against plain Python."""

import math
import random
import time
from itertools import permutations

import pytest
from pyspark.sql import functions as F

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
from weftgraph.plans.graph import Graph, degrees

NODE = "id string, label string, file_type string, source_file string, community int"
EDGE = "src string, dst string, relation string, context string, confidence string, confidence_score double, weight double"


def graph(spark, nodes, edges):
    rows = [(n, n.upper(), "code", "src/m.py", 0) if isinstance(n, str) else n for n in nodes]
    full = [(*e, *("calls", "call", "EXTRACTED", 1.0, 1.0)[len(e) - 2 :]) for e in edges]
    return Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame(full, EDGE))


@pytest.fixture(scope="module")
def micro(spark):
    return graph(
        spark, ["a", "b", "c", "d", "lone", "self"],
        [("a", "b"), ("b", "a", "uses"), ("b", "c"), ("c", "d", "imports"), ("self", "self"), ("a", "gone", "calls", "call", "GUESS"), ("c", "c", "imports")],
    )


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_degrees(micro):
    assert dict(values(degrees(micro), "id", "degree")) == {"a": 2, "b": 2, "c": 4, "d": 1, "lone": 0, "self": 2}


def test_empty_graph(spark):
    g = graph(spark, [], [])
    assert A.god_nodes(g).count() == 0 and A.cohesion(g).count() == 0 and B.validation_errors(g).count() == 0
    assert T.bfs(g, ["x"]).count() == 0 and A.surprises(g).count() == 0 and T.import_cycles(g.edges).count() == 0


def test_validation(micro):
    got = values(B.validation_errors(micro), "kind", "problem")
    assert got == [("edge", "dangling dst"), ("edge", "unknown confidence")]
    assert B.prune_dangling(micro).edges.count() == 6 and B.drop_import_loops(micro.edges).count() == 6


def collapse_in_order(edges):
    """What a pair keeps when its edges come in the order of source, target and relation."""
    kept = {}
    for s, t, r, o in sorted(edges):
        key = (min(s, t), max(s, t))
        old = kept.get(key)
        if old and old[2] == r and (old[0], old[1]) == (t, s) and s != t:
            continue
        if old and r in B.GENERIC and old[2] not in B.GENERIC:
            continue
        kept[key] = (s, t, r, o)
    return sorted(kept.values())


def test_collapse(spark):
    rng = random.Random(4)
    rels = ["calls", "imports", "uses", "references", "mentions", "inherits"]
    edges = [(f"n{rng.randrange(12)}", f"m{rng.randrange(3)}" if rng.random() < 0.5 else f"n{rng.randrange(12)}", rng.choice(rels), i) for i in range(500)]
    got = values(B.collapse_edges(spark.createDataFrame(edges, "src string, dst string, relation string, ord bigint")), "src", "dst", "relation", "ord")
    assert got == collapse_in_order(edges)


def test_resolution(spark):
    g = graph(spark, ["Foo_Bar", "x", "y.z", "y_z"], [("foo bar", "x"), ("Foo_Bar", "Y-Z"), ("x", "nope")])
    assert values(B.resolve_endpoints(g).edges, "src", "dst") == [("Foo_Bar", "x")]
    nodes = spark.createDataFrame(
        [("t1", "run()", "a/one.py"), ("t2", "run()", "b/two.py"), ("t3", ".stop()", "a/one.py"), ("t4", "go()", "x/w.go"), ("t5", "stop()", "tests/test_one.py")],
        "id string, label string, source_file string",
    )
    calls = spark.createDataFrame([("c1", "run", "a/main.py"), ("c2", "run", "z/main.py"), ("c3", "stop", "z/main.py"), ("c4", "go", "z/main.py"), ("t1", "run", "a/one.py")], "caller string, callee string, source_file string")
    assert values(B.resolve_calls(calls, nodes), "caller", "target") == [("c1", "t1"), ("c3", "t3"), ("t1", "t2")]


def test_survivors_and_labels(spark):
    n = spark.createDataFrame([("i", "long label", "f", None), ("i", "short", "f", None), ("i", "longest label", "f", "d1"), ("j", "x", "g", None)], "id string, label string, source_file string, desc string")
    assert values(B.id_survivors(n).na.fill("-"), "id", "label", "desc") == [("i", "short", "d1"), ("j", "x", "-")]
    files = spark.createDataFrame([("1", "i.ts", "a/b/i.ts"), ("2", "i.ts", "c/b/i.ts"), ("3", "i.ts", "x/i.ts"), ("4", "k.ts", "x/k.ts")], "id string, label string, source_file string")
    assert values(B.file_label_suffixes(files), "id", "new_label") == [("1", "a/b/i.ts"), ("2", "c/b/i.ts"), ("3", "x/i.ts")]


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("-2",), ("nan",), ("inf",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(P.repaired_number(F.col("v"))).collect()] == [1.5, 1, 1, 1, 1, 1]


def test_traversal(spark):
    hub = [("s", "hub")] + [("hub", f"h{i}") for i in range(60)] + [("s", "p"), ("p", "q"), ("q", "r")]
    g = graph(spark, ["s", "hub", "p", "q", "r"] + [f"h{i}" for i in range(60)], hub)
    assert values(T.bfs(g, ["s"]), "id", "hop") == [("hub", 1), ("p", 1), ("q", 2), ("s", 0)]
    assert T.bfs(g, ["hub"], 1).count() == 62
    assert T.shortest_path(g, "s", "r") == ["s", "p", "q", "r"] and T.shortest_path(g, "r", "s") == []
    assert T.shortest_path(g, "r", "s", directed=False) == ["r", "q", "p", "s"]
    assert values(T.affected(g, "q"), "id", "hop") == [("p", 1), ("s", 2)]
    assert T.dfs(g, ["s"], 2)[:2] == ["s", "hub"] and set(T.dfs(g, ["s"], 2)) == {"s", "hub", "p", "q"}


def test_cycles(spark):
    rng = random.Random(2)
    edges = {(rng.choice("abcdefg"), rng.choice("abcdefg")) for _ in range(22)}
    want = []
    for k in range(2, 6):
        for p in permutations("abcdefg", k):
            if p[0] == min(p) and all((p[i], p[(i + 1) % k]) in edges for i in range(k)):
                want.append((" -> ".join(p), k))
    assert values(T.import_cycles(spark.createDataFrame(sorted(edges), "src string, dst string")), "cycle", "length") == sorted(want)


def test_components_and_betweenness(spark):
    chain = graph(spark, list("abcde") + ["z"], [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])
    assert dict(values(T.connected_components(chain.nodes, chain.edges), "id", "component")) == {**dict.fromkeys("abcde", "a"), "z": "z"}
    got = dict(values(T.betweenness(chain), "id", "betweenness"))
    assert got["c"] == pytest.approx(2 * 4 / 20) and got["b"] == pytest.approx(2 * 3 / 20) and got["a"] == got["z"] == 0
    rng = random.Random(6)
    names = [f"v{i}" for i in range(25)]
    edges = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(45)})
    got = dict(values(T.betweenness(graph(spark, names, edges)), "id", "betweenness"))
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in names}
    want = dict.fromkeys(names, 0.0)
    for s in names:
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in sorted(near[v]):
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        dep = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                want[w] += dep[w] / (24 * 23)
    assert got == pytest.approx(want)


def test_communities(spark):
    left, right = [f"l{i}" for i in range(6)], [f"r{i}" for i in range(5)]
    clique = lambda ns: [(a, b) for i, a in enumerate(ns) for b in ns[i + 1 :]]
    g = graph(spark, left + right + ["lone"], clique(left) + clique(right) + [("l0", "r0")])
    of = dict(values(C.detect(g), "id", "community"))
    assert of == {**dict.fromkeys(left, 0), **dict.fromkeys(right, 1), "lone": 2}
    assert C.modularity(g, C.detect(g)) > 0.4
    old = spark.createDataFrame([(n, 7) for n in left] + [(n, 3) for n in right], "id string, c int")
    assert A.remap_communities(C.detect(g), old) == {0: 7, 1: 3, 2: 0}


def test_communities_do_not_depend_on_partitions_and_are_good(spark):
    """Eight planted groups: modularity near that of the planted communities, the same for every order of rows."""
    rng = random.Random(9)
    names = [f"n{i:02d}" for i in range(80)]
    edges = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < (0.6 if names.index(a) % 8 == names.index(b) % 8 else 0.02)]
    g = graph(spark, names, edges)
    planted = spark.createDataFrame([(n, i % 8) for i, n in enumerate(names)], "id string, community int")
    first = C.detect(g)
    assert C.modularity(g, first) >= 0.95 * C.modularity(g, planted)
    rng.shuffle(edges)
    again = C.detect(graph(spark, names[::-1], edges))
    assert values(first, "id", "community") == values(again, "id", "community")


def test_hubs_rejoin_by_majority(spark):
    left, right = [f"l{i}" for i in range(6)], [f"r{i}" for i in range(6)]
    clique = lambda ns: [(a, b) for i, a in enumerate(ns) for b in ns[i + 1 :]]
    edges = clique(left) + clique(right) + [("hub", n) for n in left + right[:4]]
    g = graph(spark, [*left, *right, "hub", "lone"], edges)
    of = dict(values(C.detect(g, exclude_over=95.0), "id", "community"))
    assert of["hub"] == of["l0"] and len({of[n] for n in left}) == len({of[n] for n in right}) == 1 and of["l0"] != of["r0"] and set(of) == {*left, *right, "hub", "lone"}


def test_bridges(spark):
    nodes = [("a", "A", "code", "one.py", 0), ("b", "B", "code", "one.py", 0), ("c", "C", "code", "one.py", 1), ("d", "D", "code", "one.py", 2)]
    e = [("a", "c", "calls", "call", "EXTRACTED"), ("c", "b", "uses", "call", "AMBIGUOUS"), ("a", "d", "imports", "call", "AMBIGUOUS"), ("d", "c", "calls", "call", "INFERRED"), ("a", "b", "calls", "call", "AMBIGUOUS")]
    assert [(r["community"], r["other_community"], r["src"], r["dst"]) for r in A.bridges(graph(spark, nodes, e)).collect()] == [(0, 1, "c", "b"), (1, 2, "d", "c")]


def test_calls_bind_along_the_longest_common_path(spark):
    nodes = spark.createDataFrame([("t1", "go()", "a/b/c/one.py"), ("t2", "go()", "a/b/two.py"), ("t3", "go()", "z/three.py"), ("t4", "go()", "a/b/c/test_x.py")], "id string, label string, source_file string")
    calls = spark.createDataFrame([("c1", "go", "a/b/c/main.py"), ("c2", "go", "a/b/d/main.py"), ("c3", "go", "y/main.py"), ("c4", "go", "a/b/c/test_x.py"), ("c5", "go", "a/b/two.py")], "caller string, callee string, source_file string")
    got = {(r["caller"], r["target"], r["confidence"]) for r in B.resolve_calls(calls, nodes).collect()}
    assert got == {("c1", "t1", "INFERRED"), ("c4", "t4", "EXTRACTED"), ("c5", "t2", "EXTRACTED")}


def test_assemble(spark):
    """The chain on a handful of rows: twins, ghosts, ends by normal form, numbers, phantoms, collapse, hyperedges, labels."""
    n = spark.createDataFrame(
        [
            ("m_run", "run()", "code", "src/m.py", "ast"), ("sem_run", "run()", "tool", ".\\src\\m.py", None), ("doc", "D", "document", "d.md", None), ("doc_doc", "D", "markdown", "d.md", None),
            ("g", "g()", "code", "x/g.go", "ast"), ("f1", "i.ts", "code", "a/i.ts", "ast"), ("f2", "i.ts", "code", "b/i.ts", "ast"),
        ],
        "id string, label string, file_type string, source_file string, origin string",
    )
    e = spark.createDataFrame(
        [
            ("sem_run", "doc", "references", "EXTRACTED", "nan", ""), ("M-Run", "g", "calls", "INFERRED", "1", ""), ("f1", "f2", "imports", "EXTRACTED", "2", "a/i.ts"), ("f2", "f1", "references", "EXTRACTED", "1", "b/i.ts"),
            ("f1", "F1", "imports", "EXTRACTED", "1", "a/i.ts"), ("f1", "gone", "calls", "EXTRACTED", "1", ""),
        ],
        "src string, dst string, relation string, confidence string, weight string, source_file string",
    )
    h = spark.createDataFrame([("h", "H", ["sem_run", "gone", "m_run", "g"])], "id string, label string, nodes array<string>")
    got, hyper = B.assemble(n, e, h)
    assert values(got.nodes, "id", "label") == [("doc_doc", "D"), ("f1", "a/i.ts"), ("f2", "b/i.ts"), ("g", "g()"), ("m_run", "run()")]
    assert values(got.edges, "src", "dst", "relation", "weight", "source_file") == [("f1", "f2", "imports", 2.0, "a/i.ts"), ("m_run", "doc_doc", "references", 1.0, "src/m.py")]
    assert [tuple(r) for r in hyper.collect()] == [("h", "H", ["m_run", "g"])]


def test_retrieval(spark):
    nodes = [("u1", "UserService", "code", "src/user.py", 0), ("u2", "user", "code", "src/user.py", 0), ("o", "OrderService", "code", "src/order.py", 1), ("c", "Café", "concept", "doc.md", 1), ("f", "run()", "code", "src/user.py", 1)]
    g = graph(spark, nodes, [("u1", "u2"), ("o", "u1")])
    assert R.prepare(g.nodes, "where is the user").terms == ["user"]
    top = [r["id"] for r in R.hybrid_search(g, "user service").collect()]
    assert top[0] == "u2" and set(top) >= {"u1", "u2", "o"}
    assert [r["id"] for r in R.hybrid_search(g, "UserServise", n=1).collect()] == ["u1"]
    assert values(R.lookup(g.nodes, "cafe"), "id", "tier") == [("c", "exact")]
    assert values(R.lookup(g.nodes, "src/user.py"), "id", "tier") == [(i, "source_exact") for i in ("f", "u1", "u2")]
    assert values(R.lookup(g.nodes, "run"), "id", "tier") == [("f", "exact")] and R.lookup(g.nodes, "?!").count() == 0
    q = R.prepare(g.nodes, "order café")
    assert set(R.pick_seeds(R.score_nodes(g.nodes, q), g)) == {"o", "c"}
    assert R.resolve_contexts("what calls it?") == ["call"] and R.resolve_contexts("", ["Params"]) == ["parameter_type"]


def test_dedup(spark):
    rows = [
        ("a1", "Asset Contribution Flow", "concept", "x.md", 0), ("a2", "asset contribution  flow", "concept", "x.md", 0), ("a3", "Asset Consumption Flow", "concept", "x.md", 0),
        ("b1", "Payment Gateway Manager", "concept", "x.md", 0), ("b2", "Payment Gateway Managr", "concept", "x.md", 0), ("c1", "Chapter 11 Overview", "concept", "x.md", 0), ("c2", "Chapter 12 Overview", "concept", "x.md", 0),
        ("k1", "Payment Gateway Manager", "code", "y.py", 0), ("r1", "Shared heading text", "document", "x.md", 0), ("r2", "Shared heading texts", "document", "z.md", 0),
    ]
    n = spark.createDataFrame(rows, NODE)
    e = spark.createDataFrame([("a1", "b2", "uses"), ("b1", "b2", "uses"), ("a2", "k1", "uses")], "src string, dst string, relation string")
    left, edges, mapping = E.deduplicate(n, e)
    assert values(mapping, "id", "survivor") == [("a2", "a1"), ("b2", "b1")]
    assert values(edges, "src", "dst") == [("a1", "b1"), ("a1", "k1")] and left.count() == 8


def test_label_pairs_are_all_that_share_a_band(spark):
    """Candidate pairs at any bound of a bucket against all pairs; a merge that differs in the first word is not lost."""
    rng = random.Random(3)
    words = "customer order history service request handler report export pipeline token cache session user".split()
    labels = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 6))) + rng.choice(["", " 12", " 7"]) for _ in range(150)]
    labels += ["customer order history of all sessions and users", "custemer order history of all sessions and users", "authentication service request handler pipeline", "authentocation service request handler pipeline"]
    n = spark.createDataFrame([(f"e{i}", x, "concept", "x.md", 0) for i, x in enumerate(labels)], NODE)
    first = {}
    for i, x in sorted(enumerate(labels), key=lambda p: f"e{p[0]}"):
        first.setdefault(x, f"e{i}")
    norms = {i: x for x, i in first.items()}
    bands = {i: [X.minhash(x)[j * X.ROWS : (j + 1) * X.ROWS].tobytes() for j in range(X.BANDS)] for i, x in norms.items()}
    numbers = lambda x: [y for y in x.split() if y.isdigit()]
    want = sorted(
        (a, b) for a in norms for b in norms
        if a < b and any(p == q for p, q in zip(bands[a], bands[b])) and numbers(norms[a]) == numbers(norms[b])
        and abs(len(norms[a]) - len(norms[b])) <= 0.3 * max(len(norms[a]), len(norms[b]))
    )
    for bucket in (200, 2, 1):
        assert values(E.lsh_pairs(n, bucket), "id_a", "id_b") == want and len(want) > 3
    links = {(r["a"], r["b"]) for r in E.scored_pairs(n).where("score >= 92").collect()}
    assert {(first[a], first[b]) for a, b in ((labels[-4], labels[-3]), (labels[-2], labels[-1]))} <= {tuple(sorted(x)) for x in links} | links


def test_query_terms():
    assert X.query_terms("how does the auth token work without being refreshed") == ["auth", "token", "refreshed"]
    assert X.query_terms("Where is get_user called in Café über?") == ["get_user", "called", "café"] and X.score_terms("get_user Café") == ["get", "user", "cafe"]
    assert X.query_terms("how does it work") == ["how", "does", "work"] and X.query_terms("认证流程 v2") == ["认证", "证流", "流程", "认证流程", "v2"]


def test_normal_forms_in_the_jvm(spark):
    rng = random.Random(1)
    texts = ["Café", "한국어 A", "ﬁne ½", "İstanbul", "ΑΣ Σας", "日本語", "", "plain", "🙂 𝒜bc", "ẛ̣"] + ["".join(chr(rng.choice([rng.randrange(32, 0x600), rng.randrange(0x1E00, 0x2FFF), rng.randrange(0xAC00, 0xD7A4)])) for _ in range(9)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.norm_label(F.col("t"))).collect()] == [X.fold(t).lower() for t in texts]
    words = ["".join(rng.choice("abcdeé_ ") for _ in range(rng.randrange(12))) for _ in range(150)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for a in ("abcdeab", "é_b", "a"):
        for r in df.select("w", X.jaro_winkler_column(a, F.col("w")).alias("x"), X.jaro_winkler_column(a, F.col("w"), 0.85).alias("y")).collect():
            assert r["x"] == pytest.approx(X.jaro_winkler(a, r["w"])) and (r["y"] == r["x"] or (r["y"] is None and r["x"] < 0.85))


def test_shared_types(spark):
    rows = [("a", "T", "n", "r1"), ("b", "T", "n", "r1"), ("c", "T", "n", "r2"), ("d", "T", "n", "r3"), ("e", "T", "m", "r2"), ("f", "T", "", "r9"), ("g", "U", "n", "r1")]
    n = spark.createDataFrame(rows, "id string, label string, namespace string, repo string")
    want = [("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    assert values(M.cross_repo_types(n), "src", "dst") == want
    assert values(M.type_classes(n), "id", "class", "n_repos", "n_links") == [("a", "a", 3, 2), ("b", "a", 3, 2), ("c", "a", 3, 3), ("d", "a", 3, 3)]


def test_union_keeps_what_any_graph_states(spark):
    one, two = graph(spark, [("a", "A", "code", "x.py", None), "b"], [("a", "b")]), graph(spark, [("a", None, "code", "x.py", 3)], [("a", "b"), ("a", "b", "uses")])
    both = M.union_graphs(one, two)
    assert values(both.nodes, "id", "label", "community") == [("a", "A", 3), ("b", "B", 0)] and values(both.edges, "src", "relation") == [("a", "calls"), ("a", "uses")]


def test_similarity():
    assert X.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6) and X.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert X.normalize_id_text("Foo.Bar-İx__") == X.normalize_id_text(X.normalize_id_text("Foo.Bar-İx__"))
    assert (X.minhash("graph extractor") == X.minhash("graphextractor")).all() and (X.minhash("ab") != X.minhash("ba")).any()
    assert X.osa_within_one("abcd", "acbd") and not X.osa_within_one("abcd", "acdb")


def test_maintenance(spark):
    g = graph(spark, ["a", "b", ("c", "C", "code", "src/n.py", 0), ("x", "X", "concept", "", None)], [("a", "b"), ("c", "x")])
    pruned = M.prune_sources(g, g.nodes.where("id = 'c'"))
    assert values(pruned.nodes, "id") == [("a",), ("b",)] and pruned.edges.count() == 1
    assert M.same_topology(g, g) and not M.same_topology(g, pruned)
    assert M.lost_nodes(g, pruned, g.nodes.where("id = 'c'")).where("id <> 'x'").count() == 0
    both = M.union_graphs(M.prefixed(g, "one"), M.prefixed(g, "two", 10))
    assert both.nodes.count() == 8 and M.prune_repo(both, "one").nodes.count() == 4
    delta = M.embedding_delta(spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string"), spark.createDataFrame([(1, "x"), (3, "y")], "id int, text_hash string"))
    assert values(delta, "id", "action") == [(1, "embed"), (2, "embed"), (3, "drop")] and M.needs_full_rebuild(delta)


def test_documents(spark):
    paths = {".env": True, ".env.example": False, "a/.ssh/x.py": True, "internal/secrets/store.go": False, "secrets/db.txt": True, "api_token.json": True, "token-economics-of-recall.md": False, "device_token.rb": False, "id_rsa": True, "grid_rsa": False, "src/main.py": False, "x.pem": True}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r[0]: r[1] for r in df.select("path", D.is_sensitive(F.col("path"))).collect()} == paths
    kinds = {"a.py": "code", "pyproject.toml": "code", "r.md": "document", "p.pdf": "paper", "i.PNG": "image", "v.mp4": "video", "x.blade.php": "code", "noext": None, "q.zzz": None}
    df = spark.createDataFrame([(p,) for p in kinds], "path string")
    assert {r[0]: r[1] for r in df.select("path", P.classify_path(F.col("path"))).collect()} == kinds
    ignore = ["*.log", "/build/", "docs/**/tmp", "!keep.log", "a?.txt"]
    cases = {"x.log": True, "d/y.log": True, "keep.log": False, "build/o.c": True, "src/build/o.c": False, "docs/a/b/tmp/f": True, "ab.txt": True, "abc.txt": False}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r[0]: r[1] for r in df.select("path", D.is_ignored(F.col("path"), ignore)).collect()} == cases
    text = "# A\nline\n\npara " + "x" * 30 + "\n# B\n" + "y" * 25
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    got = D.best_slices(docs, 20).orderBy("doc_id", "i").collect()
    assert "".join(r["slice"] for r in got if r["doc_id"] == 1) == text and max(len(r["slice"]) for r in got) <= 20
    files = spark.createDataFrame([("d/a", 5), ("d/b", 6), ("d/c", 20), ("d/e", 1), ("z/a", 1)], "path string, tokens int")
    assert values(D.pack(files, 10), "path", "chunk") == [("d/a", 0), ("d/b", 1), ("d/c", 2), ("d/e", 3), ("z/a", 0)]


def test_lessons(spark):
    docs = spark.createDataFrame(
        [(1, "2024-12-02", "useful", ["n", "n", "m"]), (2, "2025-01-01", "dead_end", ["n"]), (3, None, "useful", ["k"]), (4, "2025-02-01", "useful", ["k"]), (5, "2025-01-01", None, ["n"])],
        "doc_id int, date string, outcome string, source_nodes array<string>",
    ).withColumn("date", F.to_timestamp("date"))
    got = {r["node"]: (r["pos"], r["neg"], r["score"], r["verdict"]) for r in W.lessons(docs, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert got == {"n": (1, 1, -0.5, "contested"), "m": (1, 0, 0.5, "tentative"), "k": (2, 0, 2.0, "preferred")}


def test_entropy(spark):
    df = spark.createDataFrame([("aabb",), ("",), ("abcd",)], "s string")
    assert [r[0] for r in df.select(X.entropy(F.col("s"))).collect()] == [1.0, 0.0, 2.0]
    vec = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0], [0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 3) for r in vec.select(X.cosine(F.col("a"), F.col("b"))).collect()] == [round(math.sqrt(0.5), 3), 0, 0]


def test_components_by_contraction(spark, monkeypatch):
    """Rounds on executors, samples and parts outside the largest one, against plain union-find."""
    monkeypatch.setattr(T, "DRIVER_LINKS", 30)
    rng = random.Random(8)
    names = [f"v{i:03d}" for i in range(120)]
    dense = [(a, b) for i, a in enumerate(names[:40]) for b in names[i + 1 : 40] if rng.random() < 0.4]
    chain = list(zip(names[40:80], names[41:81]))
    for edges in (chain, dense + chain, dense * 3 + [(a, b) for i, a in enumerate(names[50:70], 50) for b in names[i + 1 : 70]] + chain[:5]):
        rng.shuffle(edges)
        root = {n: n for n in names}
        for _ in names:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        got = T.connected_components(spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(edges, "src string, dst string"))
        assert dict(values(got, "id", "component")) == root


def test_calls_against_all_pairs(spark):
    """Random calls and definitions, unknown files, tests, languages and callers that define the name, against every pair."""
    rng = random.Random(5)
    paths = [None, "a/x.py", "a/b/x.py", "a/b/y.py", "a/b/y.py/z.py", "tests/x.py", "a/tests/t.py", "a/b/w.go", "c/v.txt", "a", ""]
    nodes = [(f"d{i}", rng.choice(["run()", ".go", "stop"]), rng.choice(paths)) for i in range(26)]
    nodes += [("e1", "only", "a/x.py"), ("e2", "only", "a/x.py"), ("e3", "pair", None), ("e4", "pair", "a/x.py"), ("e4", "pair", "a/x.py")]
    calls = [(rng.choice([f"d{rng.randrange(26)}", "c1", "c2", "c3", "e1", "e4"]), rng.choice(["run", "go", "stop", "only", "pair", "none"]), rng.choice(paths)) for _ in range(400)]
    family = lambda f: {"py": "py", "go": "go"}.get(f.rsplit("/", 1)[-1].rpartition(".")[2]) if f and "." in f else None
    test = lambda f: bool(f) and "tests/" in f
    strip = lambda x: x.removeprefix(".").removesuffix("()")

    def near(f, g):
        x, y = f.split("/"), g.split("/")
        return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

    ranks = {}
    for caller, callee, f in calls:
        for target, label, g in nodes:
            if strip(label) == callee and target != caller and (family(f) is None or family(g) is None or family(f) == family(g)):
                rank = (test(f) != test(g), -99, False) if f is None or g is None else (test(f) != test(g), -near(f, g), f != g)
                ranks.setdefault((caller, callee), []).append((rank, target))
    want = set()
    for (caller, _), found in ranks.items():
        first = [t for r, t in found if r == min(found)[0]]
        if len(first) == 1:
            want.add((caller, first[0], "INFERRED" if min(found)[0][2] else "EXTRACTED"))
    made = spark.createDataFrame(nodes, "id string, label string, source_file string")
    got = {tuple(r) for r in B.resolve_calls(spark.createDataFrame(calls, "caller string, callee string, source_file string"), made).collect()}
    assert got == want and len(want) > 5


def test_pairs_by_cells(spark):
    """All pairs of a key at any size of a cell, more tasks than one for a large key, none for a key of one side or null."""
    a = spark.createDataFrame([(i, [0, 0, 0, 1, 2, None][i % 6]) for i in range(60)], "x int, k int")
    b = spark.createDataFrame([(i, [0, 0, 1, 3, None][i % 5]) for i in range(40)], "y int, k int")
    want = sorted((x, y) for x, k in values(a.na.fill(-1), "x", "k") for y, j in values(b.na.fill(-1), "y", "k") if k == j >= 0)
    for cell in (8_000_000, 50, 1):
        met = E.paired(a, b, "k", cell)
        assert values(met, "x", "y") == want
    assert E.paired(a, b, "k", 50).select(F.spark_partition_id()).distinct().count() > 2
    labels = ["A#007", "a#7", "b", None, "7,1", "71", "0"]
    both = spark.createDataFrame([(x, y) for x in labels for y in labels], "x string, y string")
    low, high = F.lower("x"), F.lower("y")
    assert both.where(~E.numeric_veto(low, high).eqNullSafe(E.number_key(low) != E.number_key(high))).count() == 0


def test_least_of_the_shortest_paths(spark):
    """Levels from both ends, at every bound of a broadcast, against every shortest path in plain Python."""
    rng = random.Random(12)
    names = [f"p{i:02d}" for i in range(40)]
    edges = sorted({tuple(rng.sample(names, 2)) for _ in range(58)})
    g = graph(spark, names, edges)
    for s, t, directed in [("p00", "p31", True), ("p00", "p31", False), ("p05", "p05", False), ("p17", "p02", False), ("p09", "p22", True), ("nope", "p01", False)]:
        near = {n: sorted({b for a, b in edges if a == n} | (set() if directed else {a for a, b in edges if b == n})) for n in names}
        best, seen = {s: [s]} if s in names else {}, {s}
        front = dict(best)
        while front and t not in best:
            new = {}
            for n, path in front.items():
                for x in near[n]:
                    if x not in seen:
                        new[x] = min(new.get(x, [*path, x]), [*path, x])
            seen |= set(new)
            best |= new
            front = new
        assert T.shortest_path(g, s, t, directed) == best.get(t, []), (s, t, directed)
        if best.get(t) and len(best[t]) > 2:
            assert T.shortest_path(g, s, t, directed, len(best[t]) - 2) == []


def test_collapsed_edges_keep_their_columns(spark):
    """The kept edge of a pair comes whole, through one exchange of the edges."""
    rows = [("a", "b", "uses", 0.5), ("b", "a", "calls", 0.7), ("a", "b", "uses", 0.9), ("c", "c", "calls", 1.0), ("a", "b", "uses", 0.5)]
    e = spark.createDataFrame(rows, "src string, dst string, relation string, weight double")
    kept = B.keep_collapsed(e)
    assert values(kept, "src", "dst", "relation", "weight") == [("b", "a", "calls", 0.7), ("c", "c", "calls", 1.0)]
    assert kept._jdf.queryExecution().sparkPlan().toString().count("RepartitionByExpression") + kept._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert "Join" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_jaro_of_long_labels():
    """Jaro as its definition says, and in a time that grows with the length of the labels and not with its square."""

    def plain(a, b):
        reach, free, hits = max(max(len(a), len(b)) // 2 - 1, 0), [True] * len(b), []
        for i, c in enumerate(a):
            for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
                if free[j] and b[j] == c:
                    free[j] = False
                    hits.append(c)
                    break
        other = [c for c, f in zip(b, free) if not f]
        m = len(hits)
        return (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(hits, other)) // 2) / m) / 3 if m else 0.0

    rng = random.Random(4)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 14))) for _ in "ab")
        assert a == b or X.jaro(a, b) == plain(a, b)
    words = [f"w{rng.randrange(10**6)}" for _ in range(12_000)]
    began = time.process_time()
    assert 0.9 < X.jaro(" ".join(words), " ".join(words[:6000] + ["more"] + words[6000:])) <= 1
    assert time.process_time() - began < 5
