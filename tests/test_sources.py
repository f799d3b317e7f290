"""Readers, extractors, sinks, streams and the driver's contract."""

import json

from pyspark.sql import functions as F

import __spark_entry__
from weftgraph.plans.graph import Graph
from weftgraph.sources import extractors, readers, sinks
from weftgraph.streaming import watch

FILES = [
    ("app/service.py", "import os\nfrom .models import User\n\nclass Service(Base):\n    def run(self):\n        helper()\n\ndef helper():\n    pass\n"),
    ("app/models.py", "class Base:\n    pass\n\nclass User:\n    pass\n"),
    ("app/broken.py", "def ("),
    ("web/a.ts", "import { b } from './b'\nexport class A extends B {}\nfunction go() { stop() }\nfunction stop() {}\n"),
    ("doc/guide.md", "---\n# note\n---\n# Guide\nsee [x](other.md) and [x](other.md#y) [web](http://a.b)\n```\n# code\n```\n## Part\n[[other]]\n"),
    ("db/schema.sql", "CREATE TABLE a (id int);\nCREATE TABLE b (a_id int REFERENCES a(id), c int REFERENCES gone(id));\nCREATE VIEW v AS WITH t AS (SELECT * FROM a) SELECT * FROM t JOIN b ON true;\nALTER TABLE b ADD CONSTRAINT k FOREIGN KEY (x) REFERENCES a(id);\n-- CREATE TABLE no (x int)\n"),
    ("conf/x.json", '{"one": {"two": 1}, "three": 2}'),
    ("bad.json", "{"), ("none.md", None),
]


def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


def test_extractors(spark):
    rows = extractors.extract(files(spark)).collect()
    edges = {(r["path"], r["src"], r["dst"], r["relation"]) for r in rows if r["kind"] == "edge"}
    md = {(s, d, r) for p, s, d, r in edges if p == "doc/guide.md"}
    assert md == {("doc_guide_md", "doc_other_md", "references"), ("doc_guide_md", "doc_guide_guide", "contains"), ("doc_guide_guide", "doc_guide_part", "contains")}
    sql = {(s, d, r) for p, s, d, r in edges if p == "db/schema.sql" and r != "contains"}
    assert sql == {("sql_b", "sql_a", "references"), ("sql_b", "sql_gone", "references"), ("sql_v", "sql_a", "reads_from"), ("sql_v", "sql_b", "reads_from")}
    assert ("app/service.py", "app_service_service", "app_service_service_run", "method") in edges and ("app/service.py", "app_service_py", "app_models_py", "imports_from") in edges
    assert ("conf/x.json", "conf_x_one", "conf_x_one_two", "contains") in edges and not any(r["path"] in ("app/broken.py", "bad.json", "none.md") for r in rows)


def test_extracted_graph(spark):
    g = extractors.to_graph(extractors.extract(files(spark)))
    got = {(r["src"], r["dst"], r["relation"]) for r in g.edges.collect()}
    assert {("app_service_service_run", "app_service_helper", "calls"), ("app_service_service", "app_models_base", "inherits"), ("web_a_go", "web_a_stop", "calls")} <= got


def test_registry(spark):
    @extractors.register("weft")
    def weft(path, text):
        yield ("node", path, None, None, text, 1)

    df = spark.createDataFrame([("a.weft", "hello")], "path string, content string")
    assert [r["label"] for r in extractors.extract(df).collect()] == ["hello"]
    del extractors._REGISTRY["weft"]


def test_readers(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "label": "A"}, {"id": "b"}], "links": [{"from": "a", "to": "b", "type": "calls"}, {"source": "b", "target": "a", "relation": "uses"}]}))
    g = readers.read_node_link(spark, str(tmp_path / "g.json"))
    assert sorted((r["src"], r["dst"], r["relation"]) for r in g.edges.collect()) == [("a", "b", "calls"), ("b", "a", "uses")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.py").write_text("x = 1")
    assert {r["path"] for r in readers.read_files(spark, str(tmp_path)).collect()} == {"g.json", "sub/x.py"}
    manifests = [
        ("p/pyproject.toml", '[project]\nname = "me"\ndependencies = ["numpy>=1", "pandas"]\n'), ("c/Cargo.toml", '[package]\nname = "crate"\n[dependencies]\nserde = "1"\n'),
        ("g/go.mod", "module ex.com/m\nrequire (\n  github.com/a/b v1.2.3\n)\n"), ("m/pom.xml", "<project><artifactId>app</artifactId><dependencies><dependency><artifactId>junit</artifactId></dependency></dependencies></project>"), ("bad/pyproject.toml", "["),
    ]
    got = {(r["package"], r["dependency"]) for r in readers.package_edges(spark.createDataFrame(manifests, "path string, content string")).collect()}
    assert got == {("me", "numpy"), ("me", "pandas"), ("crate", "serde"), ("ex.com/m", "github.com/a/b"), ("app", "junit")}
    conf = spark.createDataFrame([("t.json", '{"mcpServers": {"s": {"command": "npx", "args": ["x"], "env": {"KEY": "secret"}}}}')], "path string, content string")
    row = readers.tool_servers(conf).first()
    assert (row["server"], row["command"], row["env"]) == ("s", "npx", ["KEY"])


def test_symbol_index(spark):
    flags = "symbol string, is_implementation boolean, is_type_definition boolean, is_definition boolean, is_reference boolean"
    rows = [("d1", "A", [("B", True, False, False, True), ("C", None, None, None, True), ("Z", None, None, True, None)]), ("d1", "B", []), ("d2", "B", []), ("d2", "C", [("B", None, True, None, None)])]
    df = spark.createDataFrame(rows, f"document string, symbol string, relationships array<struct<{flags.replace(' string', ':string').replace(' boolean', ':boolean')}>>")
    got = {(r["src"], r["dst"], r["relation"]) for r in readers.scip_edges(df).collect()}
    assert got == {("d1#A", "d1#B", "scip_impl"), ("d1#A", "d2#C", "scip_ref"), ("d1#A", "stub#Z", "scip_def"), ("d2#C", "d2#B", "scip_typed")}


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a'", 'L"<&\x1b', "code", "f.py", 1), ("b", None, None, None, None)], "id string, label string, file_type string, source_file string, community int")
    edges = spark.createDataFrame([("a'", "b", "calls", "EXTRACTED"), ("b", "a'", None, None)], "src string, dst string, relation string, confidence string")
    g = Graph(nodes, edges)
    lines = [r["value"] for r in sinks.cypher(g).collect()]
    assert any("id: 'a\\''" in x for x in lines) and any("RELATES_TO" in x for x in lines)
    import xml.etree.ElementTree as ET

    doc = "\n".join(r["value"] for r in sinks.graphml(g).orderBy("part", "key").collect())
    assert len(list(ET.fromstring(doc).iter("{http://graphml.graphdrawing.org/xmlns}edge"))) == 2
    assert json.loads(sinks.node_link(g))["links"][0]["source"] == "a'"
    assert sinks.notes(g).count() == 2
    sinks.write(g, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, t, f"s{i % 2}.py", "modified") for i, t in enumerate((0, 1, 2, 10, 11, 30, 31, 33))], "id int, t int, path string, kind string")
    events = events.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))).drop("t")
    batch = {(r["start"], r["n"]) for r in watch.debounce(events).collect()}
    assert sorted(n for _, n in batch) == [2, 3, 3]
    end = events.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(1_700_009_999)))
    events.union(end).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = watch.relevant(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = watch.debounce(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["start"], r["n"]) for r in spark.table("sessions").collect()} == batch
    assert watch.routing(events) == {"rebuild": True, "review": False}


def test_maintained_table(spark, tmp_path):
    start = spark.createDataFrame([("a.py", "old1"), ("b.py", "old2")], "source_file string, v string")
    start.write.parquet(str(tmp_path / "v0"))
    now = ["v0"]

    def save(df):
        df.write.mode("overwrite").parquet(str(tmp_path / "v1"))
        now.append("v1")

    spark.createDataFrame([("a.py", "new1"), ("a.py", "new2")], "source_file string, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(start.schema).parquet(str(tmp_path / "in"))
    q = watch.maintain(stream, lambda: spark.read.parquet(str(tmp_path / now[-1])), save, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "v1")).collect()) == ["new1", "new2", "old2"]


def test_contract(spark):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 75
    got = __spark_entry__.entry(spark).collect()
    assert len(got) == 10 and got == sorted(got, key=lambda r: (-r["degree"], r["id"]))


def archive(members):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files(spark):
    from weftgraph.sources.office import office_texts

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda text, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"
    cell = lambda text: f"<w:tc>{p(text)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    docx = archive({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{p("Title", "Heading1")}{table}{p("plain")}{p("item", "ListParagraph")}</w:body></w:document>'})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    xlsx = archive({
        "xl/workbook.xml": f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si><si><r><t>si</t></r><r><t>ze</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c r="A3" t="inlineStr"><is><t>x</t></is></c><c r="C3"><v>4.5</v></c></row></sheetData></worksheet>',
    })
    bomb = archive({"word/document.xml": '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'})
    files = spark.createDataFrame([("a/x.docx", docx), ("b.XLSX", xlsx), ("bad.docx", b"nope"), ("none.docx", None), ("bomb.docx", bomb), ("t.txt", b"x")], "path string, content binary")
    got = {r["path"]: r["text"] for r in office_texts(files).collect()}
    assert got["a/x.docx"] == "# Title\nplain\n- item\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert got["b.XLSX"] == "## Sheet: One\n| name |  | size |\n| --- | --- | --- |\n| x |  | 4.5 |"
    assert got["bad.docx"] == got["none.docx"] == got["bomb.docx"] == "" and len(got) == 5


def test_cargo_workspace(spark):
    from weftgraph.sources.readers import cargo_workspace

    files = [
        ("Cargo.toml", '[workspace]\nmembers = ["a", "b"]'), ("a/Cargo.toml", '[package]\nname = "a"\n[dependencies]\nserde = "1"\ndb = { path = "../b", package = "b-core" }'),
        ("b/Cargo.toml", '[package]\nname = "b-core"\n[dependencies]\na = { path = "../a" }'), ("c/Cargo.toml", "not = [toml"), ("x/Other.toml", '[package]\nname = "z"'),
    ]
    g = cargo_workspace(spark.createDataFrame(files, "path string, text string"))
    assert sorted((r["id"], r["source_file"]) for r in g.nodes.collect()) == [("crate:a", "a/Cargo.toml"), ("crate:b-core", "b/Cargo.toml")]
    assert sorted((r["src"], r["dst"], r["source_file"]) for r in g.edges.collect()) == [("crate:a", "crate:b-core", "a/Cargo.toml"), ("crate:b-core", "crate:a", "b/Cargo.toml")]
