"""Readers: node-link JSON, files as rows, manifests, tool configs, symbol indexes, database catalogs."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import make_id
from weftgraph.plans.graph import Graph


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, size, modified) of all files below a folder; content as text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:(//)?", ""), "^" + re.escape(base) + "/", "")
    return raw.select(rel.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


_NODE = "id string, label string, file_type string, source_file string, source_location string, community int"
_EDGE = "source string, target string, `from` string, `to` string, relation string, type string, context string, confidence string, confidence_score double, weight double, source_file string"


def read_node_link(spark: SparkSession, path: str) -> Graph:
    """A graph from a node-link JSON document; edges under ``links`` or ``edges``, ends by either name."""
    schema = f"nodes array<struct<{_nested(_NODE)}>>, links array<struct<{_nested(_EDGE)}>>, edges array<struct<{_nested(_EDGE)}>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    nodes = doc.select(F.inline("nodes"))
    e = doc.select(F.inline(F.coalesce("links", "edges")))
    edges = e.select(
        F.coalesce("source", "from").alias("src"), F.coalesce("target", "to").alias("dst"), F.coalesce("relation", "type").alias("relation"), "context",
        "confidence", "confidence_score", "weight", "source_file",
    )
    return Graph(nodes, edges)


def _nested(ddl: str) -> str:
    return re.sub(r"(`?\w+`?) (\w+)", r"\1:\2", ddl)


def read_jdbc_catalog(spark: SparkSession, url: str, **options: str) -> Graph:
    """Tables and foreign keys of a database as nodes and ``references`` edges, from its information schema."""
    load = lambda q: spark.read.format("jdbc").options(url=url, query=q, **options).load()
    tables = load("SELECT table_schema, table_name, table_type FROM information_schema.tables WHERE table_schema NOT IN ('pg_catalog', 'information_schema')")
    keys = load(
        "SELECT a.table_schema s, a.table_name t, b.table_schema rs, b.table_name rt FROM information_schema.referential_constraints r "
        "JOIN information_schema.table_constraints a ON a.constraint_name = r.constraint_name JOIN information_schema.table_constraints b ON b.constraint_name = r.unique_constraint_name"
    )
    name = lambda s, t: F.concat_ws(".", s, t)
    nodes = tables.select(name("table_schema", "table_name").alias("id"), F.col("table_name").alias("label"), F.lit("code").alias("file_type"), F.lit("catalog.sql").alias("source_file"))
    edges = keys.select(name("s", "t").alias("src"), name("rs", "rt").alias("dst"), F.lit("references").alias("relation"), F.lit("EXTRACTED").alias("confidence"))
    return Graph(nodes, edges)


def _deps(name: str, text: str) -> tuple[str, list[str]]:
    """Package and dependencies of a manifest, by its file name."""
    pep = lambda s: re.match(r"[A-Za-z0-9._-]+", s.strip())
    if name == "pyproject.toml":
        p = tomllib.loads(text).get("project", {})
        every = [*p.get("dependencies", []), *(x for v in p.get("optional-dependencies", {}).values() for x in v)]
        return p.get("name", ""), [m[0] for m in map(pep, every) if m]
    if name == "cargo.toml":
        t = tomllib.loads(text)
        return t.get("package", {}).get("name", ""), [d for k in ("dependencies", "dev-dependencies", "build-dependencies") for d in t.get(k, {})]
    if name == "go.mod":
        module = re.search(r"(?m)^module\s+(\S+)", text)
        return module[1] if module else "", re.findall(r"(?m)^(?:require\s+)?\s*([\w./-]+\.[\w./-]+)\s+v[\w.+-]+", text)
    if name == "package.json":
        j = json.loads(text)
        return j.get("name", ""), [d for k in ("dependencies", "devDependencies", "peerDependencies") for d in j.get(k, {})]
    if name == "pom.xml" and "<!DOCTYPE" not in text and "<!ENTITY" not in text:
        root = ET.fromstring(text)
        tag = lambda e: e.tag.rsplit("}", 1)[-1]
        own = next((c.text or "" for c in root if tag(c) == "artifactId"), "")
        return own, [c.text or "" for d in root.iter() if tag(d) == "dependency" for c in d if tag(c) == "artifactId"]
    if name == "apm.yml":
        own = re.search(r"(?m)^name:\s*['\"]?([\w./@-]+)", text)
        block = re.search(r"(?ms)^dependencies:\s*\n((?:[ \t]+.*\n?)*)", text)
        return own[1] if own else "", re.findall(r"(?m)^\s*-\s*['\"]?([\w./@-]+)", block[1] if block else "")
    return "", []


def package_edges(files: DataFrame) -> DataFrame:
    """(path, package, dependency) of every package manifest among files (path, content); what cannot be read has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["content"], strict=True):
                try:
                    own, deps = _deps(path.rsplit("/", 1)[-1].lower(), text or "")
                except (ValueError, ET.ParseError, AttributeError, TypeError):
                    continue
                rows += [(path, own, d) for d in dict.fromkeys(deps)]
            yield pd.DataFrame(rows, columns=["path", "package", "dependency"])

    name = F.lower(F.element_at(F.split("path", "/"), -1))
    known = files.where(name.isin("pyproject.toml", "cargo.toml", "go.mod", "package.json", "pom.xml", "apm.yml")).select("path", "content")
    return known.mapInPandas(run, "path string, package string, dependency string")


def tool_servers(files: DataFrame) -> DataFrame:
    """(path, server, command, env): servers of tool configs, with the names of their variables and never the values."""
    spec = "struct<command:string,args:array<string>,env:map<string,string>>"
    doc = F.from_json("content", f"mcpServers map<string,{spec}>, mcp struct<servers:map<string,{spec}>>")
    servers = files.select("path", doc.alias("d")).select("path", F.explode(F.coalesce("d.mcpServers", "d.mcp.servers")).alias("server", "s"))
    return servers.select("path", "server", "s.command", F.array_sort(F.map_keys(F.coalesce("s.env", F.create_map().cast("map<string,string>")))).alias("env"))


def scip_edges(index: DataFrame) -> DataFrame:
    """(src, dst, relation) of a symbol index (document, symbol, relationships).

    A target is the symbol of the same document, else the only one of that name, else a stub. Of
    several flags the first of implementation, type, definition, reference counts, only if true.
    """
    rel = index.select("document", "symbol", F.explode("relationships").alias("r"))
    kind = F.when(F.col("r.is_implementation"), "scip_impl").when(F.col("r.is_type_definition"), "scip_typed").when(F.col("r.is_definition"), "scip_def").when(F.col("r.is_reference"), "scip_ref")
    e = rel.select("document", "symbol", F.col("r.symbol").alias("target"), kind.alias("relation")).where("relation IS NOT NULL")
    own = index.select(F.col("document").alias("d"), F.col("symbol").alias("target")).distinct()
    only = own.groupBy("target").agg(F.count(F.lit(1)).alias("k"), F.min("d").alias("only")).where("k = 1").select("target", "only")
    j = e.join(own, (e["target"] == own["target"]) & (e["document"] == own["d"]), "left").drop(own["target"]).join(only, "target", "left")
    home = F.coalesce("d", "only")
    return j.select(F.concat_ws("#", "document", "symbol").alias("src"), F.when(home.isNull(), F.concat(F.lit("stub#"), F.col("target"))).otherwise(F.concat_ws("#", home, F.col("target"))).alias("dst"), "relation").distinct()


def google_shortcut(files: DataFrame) -> DataFrame:
    """(path, doc_id, url) of shortcut files to online documents; fetching them is left to a caller."""
    d = F.from_json("content", "doc_id string, url string")
    return files.where(F.col("path").rlike(r"\.(gdoc|gsheet|gslides)$")).select("path", d.alias("d")).select("path", "d.doc_id", "d.url")


def node_id(*parts: str) -> str:
    return make_id(*parts)


def cargo_workspace(files: DataFrame) -> Graph:
    """Crates of ``Cargo.toml`` files (path, text) and the dependencies among them; renamed dependencies count by their crate."""

    def run(batches):
        import tomllib

        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                try:
                    data = tomllib.loads(text or "")
                except tomllib.TOMLDecodeError:
                    continue
                package = data.get("package")
                name = package.get("name") if isinstance(package, dict) else None
                if not isinstance(name, str):
                    continue
                deps = data.get("dependencies")
                for key, spec in (deps if isinstance(deps, dict) else {}).items():
                    other = spec.get("package") if isinstance(spec, dict) else None
                    rows.append((path, name, other if isinstance(other, str) and other else key))
                rows.append((path, name, None))
            yield pd.DataFrame(rows, columns=["path", "name", "dep"])

    own = files.where("path RLIKE '(^|/)Cargo\\\\.toml$'").select("path", "text")
    rows = own.mapInPandas(run, "path string, name string, dep string")
    first = rows.groupBy("name").agg(F.min("path").alias("source_file"))
    nodes = first.select(F.concat(F.lit("crate:"), F.col("name")).alias("id"), F.col("name").alias("label"), F.lit("code").alias("file_type"), "source_file", F.lit("L1").alias("source_location"))
    known = first.select(F.col("name").alias("dep"))
    linked = rows.join(known, "dep").select("name", "dep", F.col("path").alias("source_file")).distinct()
    edges = linked.select(
        F.concat(F.lit("crate:"), F.col("name")).alias("src"), F.concat(F.lit("crate:"), F.col("dep")).alias("dst"), F.lit("crate_depends_on").alias("relation"),
        F.lit("cargo_dependency").alias("context"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("weight"), "source_file",
    )
    return Graph(nodes, edges)
