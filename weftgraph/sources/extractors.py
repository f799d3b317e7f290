"""Table functions from files to graph rows, behind a registry by extension.

An extractor takes (path, text) and yields rows (kind, src, dst, relation, label, line): nodes
have src and label, edges src, dst and relation, and raw calls kind ``call``.
"""

from __future__ import annotations

import ast
import json
import posixpath
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import make_id

Row = tuple[str, str, str | None, str | None, str | None, int]
SCHEMA = "path string, kind string, src string, dst string, relation string, label string, line int"
_REGISTRY: dict[str, Callable[[str, str], Iterator[Row]]] = {}


def register(*extensions: str):
    """Make a function the extractor of some extensions; a later one takes the place of an earlier."""

    def wrap(f: Callable[[str, str], Iterator[Row]]):
        for e in extensions:
            _REGISTRY[e.lower().lstrip(".")] = f
        return f

    return wrap


def file_id(path: str) -> str:
    return make_id(path)


def _node(nid: str, label: str, line: int = 1) -> Row:
    return ("node", nid, None, None, label, line)


def _edge(a: str, b: str, relation: str, line: int = 1) -> Row:
    return ("edge", a, b, relation, None, line)


@register("md", "mdx", "qmd", "markdown", "skill")
def markdown(path: str, text: str) -> Iterator[Row]:
    """Page and heading nodes, nested by level, and one reference for each linked page; fenced code is skipped."""
    page, stem = file_id(path), posixpath.splitext(path)[0]
    yield _node(page, posixpath.basename(path))
    seen, linked, above = {page}, {page}, []
    lines, fence, body = text.split("\n"), False, 0
    if lines[0].strip() == "---":
        body = next((i + 1 for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), 0)
    for i, line in enumerate(lines):
        if line.strip().startswith("```"):
            fence = not fence
            continue
        if fence:
            continue
        targets = re.findall(r"\[[^\]]*\]\(([^)\s#]+)[^)]*\)", line) + re.findall(r"^\s*\[[^\]]+\]:\s*(\S+)", line)
        targets += [w if "." in posixpath.basename(w) else f"{w}.md" for w in re.findall(r"\[\[([^\]|#]+)[^\]]*\]\]", line)]
        for t in targets:
            if re.match(r"[a-zA-Z][\w+.-]*:", t) or t.startswith("#"):
                continue
            to = file_id(posixpath.normpath(posixpath.join(posixpath.dirname(path), t.strip())))
            if to not in linked:
                linked.add(to)
                yield _edge(page, to, "references", i + 1)
        m = re.match(r"(#{1,6})\s+(.+)", line)
        if m and i >= body:
            level, title = len(m[1]), m[2].strip()
            nid = make_id(stem, title)
            nid = make_id(stem, title, str(i + 1)) if nid in seen else nid
            seen.add(nid)
            while above and above[-1][0] >= level:
                above.pop()
            yield _node(nid, title, i + 1)
            yield _edge(above[-1][1] if above else page, nid, "contains", i + 1)
            above.append((level, nid))


@register("py", "pyw")
def python(path: str, text: str) -> Iterator[Row]:
    """Classes, functions, bases, imports and calls of a Python file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    page, stem = file_id(path), posixpath.splitext(path)[0]
    yield _node(page, posixpath.basename(path))

    def walk(body: list[ast.stmt], owner: str, inside: str | None) -> Iterator[Row]:
        for s in body:
            if isinstance(s, ast.ClassDef):
                nid = make_id(stem, s.name)
                yield _node(nid, s.name, s.lineno)
                yield _edge(owner, nid, "contains", s.lineno)
                for b in s.bases:
                    if isinstance(b, ast.Name | ast.Attribute):
                        yield ("ref", nid, ast.unparse(b).split(".")[-1], "inherits", None, s.lineno)
                yield from walk(s.body, nid, s.name)
            elif isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
                nid = make_id(stem, inside or "", s.name)
                yield _node(nid, f".{s.name}()" if inside else f"{s.name}()", s.lineno)
                yield _edge(owner, nid, "method" if inside else "contains", s.lineno)
                for c in ast.walk(s):
                    if isinstance(c, ast.Call) and isinstance(c.func, ast.Name):
                        yield ("call", nid, c.func.id, "calls", None, c.lineno)
                    elif isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute):
                        yield ("member_call", nid, c.func.attr, "calls", ast.unparse(c.func.value)[:80], c.lineno)
            elif isinstance(s, ast.Import):
                for a in s.names:
                    yield _edge(page, make_id(a.name.replace(".", "/") + ".py"), "imports", s.lineno)
            elif isinstance(s, ast.ImportFrom):
                base = posixpath.dirname(path) if s.level else ""
                for _ in range(max(0, s.level - 1)):
                    base = posixpath.dirname(base)
                yield _edge(page, make_id(posixpath.join(base, (s.module or "__init__").replace(".", "/")) + ".py"), "imports_from", s.lineno)

    yield from walk(tree.body, page, None)


_SQL_NAME = r"((?:[\w\"`]+\.)?[\w\"`]+)"


@register("sql")
def sql(path: str, text: str) -> Iterator[Row]:
    """Tables, views, routines and triggers, foreign keys, and what views and routines read."""
    page = file_id(path)
    yield _node(page, posixpath.basename(path))
    body = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    clean = lambda s: re.sub(r"[\"`]", "", s)
    heads = list(re.finditer(rf"(?is)\b(?:CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+|MATERIALIZED\s+)*(TABLE|VIEW|FUNCTION|PROCEDURE|TRIGGER)|(ALTER)\s+TABLE)\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+|ONLY\s+)*{_SQL_NAME}", body))
    known = {clean(h[3]).lower() for h in heads if h[1]}
    stubs: set[str] = set()
    for h, nxt in zip(heads, [*heads[1:], None], strict=True):
        name, part = clean(h[3]), body[h.end() : nxt.start() if nxt else len(body)]
        line, nid = body.count("\n", 0, h.start()) + 1, make_id("sql", clean(h[3]))
        if h[1]:
            yield _node(nid, name, line)
            yield _edge(page, nid, "contains", line)
        kind = (h[1] or h[2]).upper()
        found: list[tuple[str, str]] = []
        if kind in ("TABLE", "ALTER"):
            found = [("references", x) for x in re.findall(rf"(?i)\bREFERENCES\s+{_SQL_NAME}", part)]
        elif kind == "TRIGGER":
            found = [("triggers", x) for x in re.findall(rf"(?i)\bON\s+{_SQL_NAME}", part)[:1]]
        if kind in ("VIEW", "FUNCTION", "PROCEDURE") or (kind == "TABLE" and re.match(r"\s+AS\b", part, re.I)):
            scoped = {clean(x).lower() for x in re.findall(rf"(?i)(?:\bWITH\s+(?:RECURSIVE\s+)?|,\s*){_SQL_NAME}\s*(?:\([^)]*\))?\s+AS\s*\(", part)}
            found = [("reads_from", x) for x in re.findall(rf"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+{_SQL_NAME}", part) if clean(x).lower() not in scoped | {"set", "select"}]
        for relation, to in dict.fromkeys((r, clean(x)) for r, x in found):
            if to.lower() not in known and to not in stubs:
                stubs.add(to)
                yield ("stub", make_id("sql", to), None, None, to, line)
            yield _edge(nid, make_id("sql", to), relation, line)


@register("json")
def json_config(path: str, text: str) -> Iterator[Row]:
    """Top-level keys of a JSON object, two levels deep."""
    try:
        doc = json.loads(text)
    except ValueError:
        return
    page, stem = file_id(path), posixpath.splitext(path)[0]
    yield _node(page, posixpath.basename(path))
    for k, v in doc.items() if isinstance(doc, dict) else ():
        nid = make_id(stem, k)
        yield _node(nid, k)
        yield _edge(page, nid, "contains")
        for sub in v if isinstance(v, dict) else ():
            yield _node(make_id(stem, k, sub), sub)
            yield _edge(nid, make_id(stem, k, sub), "contains")


# Patterns of definitions and imports by language: (extensions, types, functions, imports).
_BRACED = {
    "js": ("js jsx mjs cjs ts tsx mts cts vue svelte astro", r"\b(?:class|interface|enum)\s+(\w+)(?:\s+extends\s+(\w+))?", r"\bfunction\s*\*?\s+(\w+)\s*\(|\b(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", r"(?:from|require\(|import\()\s*['\"]([^'\"]+)['\"]"),
    "java": ("java kt kts scala groovy cs", r"\b(?:class|interface|enum|object|trait|record|struct)\s+(\w+)(?:\s+extends\s+(\w+)|\s*:\s*(\w+))?", r"\b(?:fun|def)\s+(\w+)\s*\(|\b(?:public|private|protected|static|internal)\s[\w<>\[\], ?]*\b(\w+)\s*\([^;{]*\)\s*(?:throws [\w, ]+)?\{", r"^\s*(?:import|using)\s+(?:static\s+)?([\w.]+)"),
    "go": ("go", r"\btype\s+(\w+)\s+(?:struct|interface)", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$"),
    "rust": ("rs", r"\b(?:struct|enum|trait)\s+(\w+)", r"\bfn\s+(\w+)", r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
    "c": ("c h cc cpp cxx hpp hh hxx cu cuh metal m mm", r"\b(?:class|struct|enum|@interface|@protocol)\s+(\w+)\s*(?::\s*(?:public\s+)?(\w+))?\s*\{?", r"^[\w:*&<>\s]+?\b(\w+)\s*\([^;{]*\)\s*(?:const\s*)?\{", r"^\s*#\s*(?:include|import)\s*[<\"]([^>\"]+)[>\"]"),
    "ruby": ("rb rake", r"^\s*(?:class|module)\s+([A-Z]\w*)(?:\s*<\s*([A-Z]\w*))?", r"^\s*def\s+(?:self\.)?(\w+[?!]?)", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]"),
    "php": ("php", r"\b(?:class|interface|trait)\s+(\w+)(?:\s+extends\s+(\w+))?", r"\bfunction\s+(\w+)\s*\(", r"^\s*use\s+([\w\\]+)\s*;"),
    "swift": ("swift", r"\b(?:class|struct|enum|protocol|extension|actor)\s+(\w+)(?:\s*:\s*(\w+))?", r"\bfunc\s+(\w+)", r"^\s*import\s+(\w+)"),
    "shell": ("sh bash", r"(?!x)x()", r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{", r"^\s*(?:source|\.)\s+(\S+)"),
    "lua": ("lua luau", r"(?!x)x()", r"\bfunction\s+([\w.:]+)\s*\(", r"\brequire\s*\(?\s*['\"]([^'\"]+)['\"]"),
    "elixir": ("ex exs", r"\bdefmodule\s+([\w.]+)", r"^\s*defp?\s+(\w+[?!]?)", r"^\s*(?:import|alias|use)\s+([\w.]+)"),
    "terraform": ("tf hcl", r"^\s*(?:resource|data|module|variable|output)\s+\"([^\"]+)\"", r"(?!x)x()", r"\bsource\s*=\s*\"([^\"]+)\""),
    "julia": ("jl", r"\b(?:mutable\s+)?struct\s+(\w+)(?:\s*<:\s*(\w+))?", r"^\s*function\s+([\w.!]+)", r"^\s*(?:using|import)\s+([\w.]+)"),
    "dart": ("dart", r"\b(?:class|mixin|enum)\s+(\w+)(?:\s+extends\s+(\w+))?", r"^\s*[\w<>?\[\]]+\s+(\w+)\s*\([^;]*\)\s*(?:async\s*)?\{", r"^\s*import\s+['\"]([^'\"]+)['\"]"),
    "powershell": ("ps1 psm1 psd1", r"^\s*class\s+(\w+)", r"(?i)^\s*function\s+([\w-]+)", r"(?i)^\s*(?:Import-Module|using module)\s+(\S+)"),
    "fortran": ("f f90 f95 f03 f08", r"(?i)^\s*(?:module|type)\s+(\w+)", r"(?i)^\s*(?:[\w()]+\s+)*(?:subroutine|function)\s+(\w+)", r"(?i)^\s*use\s+(\w+)"),
    "pascal": ("pas pp dpr lpr", r"(?i)^\s*(\w+)\s*=\s*class\s*(?:\((\w+))?", r"(?i)^\s*(?:procedure|function)\s+([\w.]+)", r"(?i)\buses\s+([\w.]+)"),
    "verilog": ("v sv svh", r"^\s*(?:module|interface|class)\s+(\w+)", r"^\s*(?:function|task)\s+(?:automatic\s+)?(?:[\w\[\]:]+\s+)?(\w+)", r"`include\s+\"([^\"]+)\""),
    "zig": ("zig", r"\bconst\s+(\w+)\s*=\s*(?:struct|enum|union)", r"\bfn\s+(\w+)", r"@import\(\"([^\"]+)\"\)"),
    "lisp": ("lisp cl lsp asd", r"(?i)\(def(?:class|struct)\s+\(?([\w*+-]+)", r"(?i)\(def(?:un|macro|generic|method)\s+([\w*+-]+)", r"(?i)\((?:require|:use)\s+['\":]*([\w-]+)"),
    "ocaml": ("ml mli", r"^\s*(?:module|type)\s+(\w+)", r"^\s*let\s+(?:rec\s+)?(\w+)\s+\w", r"^\s*open\s+([\w.]+)"),
}


def _patterned(types: str, functions: str, imports: str) -> Callable[[str, str], Iterator[Row]]:
    """An extractor of definitions, bases, imports and calls by pattern."""
    rx = [re.compile(x, re.M) for x in (types, functions, imports)]

    def run(path: str, text: str) -> Iterator[Row]:
        page, stem = file_id(path), posixpath.splitext(path)[0]
        yield _node(page, posixpath.basename(path))
        line_of = lambda at: text.count("\n", 0, at) + 1
        seen: set[str] = set()
        starts: list[tuple[int, str, str]] = []
        for kind, found in (("type", rx[0].finditer(text)), ("function", rx[1].finditer(text))):
            for m in found:
                groups = [g for g in m.groups() if g]
                nid = make_id(stem, groups[0]) if groups else ""
                if not nid or nid in seen:
                    continue
                seen.add(nid)
                yield _node(nid, groups[0] if kind == "type" else f"{groups[0]}()", line_of(m.start()))
                yield _edge(page, nid, "contains", line_of(m.start()))
                if kind == "type" and len(groups) > 1:
                    yield ("ref", nid, groups[1], "inherits", None, line_of(m.start()))
                if kind == "function":
                    starts.append((m.end(), nid, groups[0]))
        for m in dict.fromkeys(rx[2].findall(text)):
            yield _edge(page, make_id(m), "imports")
        starts.sort()
        for (at, nid, name), nxt in zip(starts, [*starts[1:], (len(text), "", "")], strict=True):
            for callee in dict.fromkeys(re.findall(r"(?<![\w.])(\w+)\s*\(", text[at : nxt[0]])):
                if callee not in ("if", "for", "while", "switch", "return", "catch", "function", name):
                    yield ("call", nid, callee, "calls", None, line_of(at))

    return run


for _ext, _types, _functions, _imports in _BRACED.values():
    register(*_ext.split())(_patterned(_types, _functions, _imports))


def extract(files: DataFrame) -> DataFrame:
    """Graph rows of all files (path, content) with an extractor; one that fails gives no rows for its file."""
    registry = dict(_REGISTRY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["content"], strict=True):
                f = registry.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
                try:
                    rows += [(path, *r) for r in f(path, text)] if f and text else []
                except (RecursionError, ValueError, KeyError, IndexError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "kind", "src", "dst", "relation", "label", "line"])

    return files.select("path", F.col("content").cast("string").alias("content")).mapInPandas(run, SCHEMA)


def to_graph(rows: DataFrame):
    """Nodes and edges of extracted rows: calls and bases are bound to definitions by name."""
    from weftgraph.operators.build import resolve_calls
    from weftgraph.plans.graph import Graph

    ext = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    kind = F.when(ext.isin("md", "mdx", "qmd", "markdown", "skill"), "document").otherwise("code")
    nodes = rows.where("kind IN ('node', 'stub')").select(
        F.col("src").alias("id"), "label", kind.alias("file_type"), F.when(F.col("kind") == "node", F.col("path")).alias("source_file"),
        F.concat(F.lit("L"), F.col("line").cast("string")).alias("source_location"), F.lit("ast").alias("origin"), F.lit(None).cast("int").alias("community"),
    ).dropDuplicates(["id"])
    named = lambda k, rel: resolve_calls(rows.where(f"kind = '{k}'").select(F.col("src").alias("caller"), F.col("dst").alias("callee"), F.col("path").alias("source_file")), nodes).select(
        F.col("caller").alias("src"), F.col("target").alias("dst"), F.lit(rel).alias("relation"), "confidence"
    )
    plain = rows.where("kind = 'edge'").select("src", "dst", "relation", F.lit("EXTRACTED").alias("confidence"))
    return Graph(nodes, plain.union(named("call", "calls")).union(named("ref", "inherits")).distinct())
