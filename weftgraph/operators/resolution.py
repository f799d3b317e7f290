"""Language-level resolution: member calls, re-exports, interface dispatch, documentation anchors, resolver registry."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import written

_RESOLVERS: dict[str, tuple[tuple[str, ...], Callable[[DataFrame, DataFrame, DataFrame], DataFrame]]] = {}


def register(name: str, *extensions: str):
    """Make a function (rows, nodes, edges) -> edges a resolver that runs if files of its extensions are there."""

    def wrap(f):
        _RESOLVERS[name] = (tuple(e.lstrip(".") for e in extensions), f)
        return f

    return wrap


def run_resolvers(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """New edges of all registered resolvers whose languages occur; one that fails is named in a warning and left out."""
    there = {r[0] for r in nodes.select(F.lower(F.regexp_extract("source_file", r"\.([^.]+)$", 1)).alias("e")).distinct().collect()}  # a row for each extension
    out = edges.limit(0).select("src", "dst", "relation", "confidence")
    for name, (extensions, f) in _RESOLVERS.items():
        if there & set(extensions):
            try:
                found = written(f(rows, nodes, edges).select("src", "dst", "relation", "confidence"))
            except Exception as e:  # whatever a plug-in raises
                warnings.warn(f"resolver {name} failed: {type(e).__name__}: {str(e)[:200]}", stacklevel=2)
                continue
            out = out.union(found)
    return out.distinct()


def member_calls(calls: DataFrame, types: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls (caller, receiver, method, file) bound through the receiver's type.

    The type is what ``types`` (file, receiver, type) says, or the receiver itself if it names a
    class. A call binds only if one class of that name owns a method of that name: EXTRACTED if
    the receiver names the class, else INFERRED.
    """
    owners = (
        edges.where("relation = 'method'").join(nodes.select(F.col("id").alias("src"), F.col("label").alias("type")), "src")
        .join(nodes.select(F.col("id").alias("dst"), F.regexp_replace("label", r"^\.|\(\)$", "").alias("method")), "dst")
        .groupBy("type", "method").agg(F.count(F.lit(1)).alias("k"), F.min("dst").alias("target")).where("k = 1")
    )
    one = types.groupBy("file", "receiver").agg(F.count_distinct("type").alias("k"), F.min("type").alias("declared")).where("k = 1").drop("k")
    typed = calls.join(one, ["file", "receiver"], "left").withColumn("type", F.coalesce("declared", "receiver"))
    hit = typed.join(owners.select("type", "method", "target"), ["type", "method"]).where("caller <> target")
    return hit.groupBy(F.col("caller").alias("src"), F.col("target").alias("dst")).agg(F.lit("calls").alias("relation"), F.min(F.when(F.col("declared").isNull(), "EXTRACTED").otherwise("INFERRED")).alias("confidence"))


def interface_dispatch(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls to a method of an interface that one class implements, bound to that class's method too."""
    impl = edges.where("relation = 'implements'").groupBy(F.col("dst").alias("iface")).agg(F.count_distinct("src").alias("k"), F.min("src").alias("cls")).where("k = 1").drop("k")
    name = nodes.select(F.col("id"), F.col("label").alias("name"))
    methods = edges.where("relation = 'method'").select(F.col("src").alias("owner"), F.col("dst").alias("id")).join(name, "id")
    of_iface = methods.join(impl, methods["owner"] == impl["iface"]).select(F.col("id").alias("dst"), "cls", "name")
    of_class = methods.select(F.col("owner").alias("cls"), "name", F.col("id").alias("target"))
    bound = edges.where("relation = 'calls'").select("src", "dst").join(of_iface, "dst").join(of_class, ["cls", "name"])
    return bound.where("src <> target").select("src", F.col("target").alias("dst"), F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence")).distinct()


def resolve_exports(exports: DataFrame, max_rounds: int = 10) -> DataFrame:
    """(module, name, origin, origin_name): where each exported name is declared.

    ``exports``: module, name, source, source_name; a null source declares the name, and a name
    of ``*`` passes on all names of the source. Rounds go on until no name is added, up to a bound
    that chains of re-exports in practice stay under.
    """
    known = written(exports.where("source IS NULL").select("module", "name", F.col("module").alias("origin"), F.col("name").alias("origin_name")))
    passed = written(exports.where("source IS NOT NULL"))
    for _ in range(max_rounds):
        far = known.select(F.col("module").alias("source"), F.col("name").alias("far"), "origin", "origin_name")
        named = passed.where("name <> '*'").join(far, "source").where("far = coalesce(source_name, name)").select("module", "name", "origin", "origin_name")
        starred = passed.where("name = '*'").join(far, "source").where("far <> 'default'").select("module", F.col("far").alias("name"), "origin", "origin_name")
        new = written(named.union(starred).distinct().join(known, ["module", "name"], "left_anti"))
        if new.isEmpty():
            return known
        known = written(known.union(new))
    return known


def doc_anchors(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, confidence, score) from documentation anchors (doc, anchor) to code.

    Forms in order: file name, ``file.method``, ``Class.method``, simple name, qualified name; the
    first form with any match counts. One match is EXTRACTED, several are AMBIGUOUS, all of them.
    """
    label = F.regexp_replace("label", r"^\.|\(\)$", "")
    file = F.regexp_extract("source_file", r"([^/]+?)(?:\.[^./]+)?$", 1)
    owner = F.element_at(F.split(F.regexp_replace("source_file", r"\.[^./]+$", ""), "/"), -1)
    stem = F.regexp_replace("source_file", r"\.[^./]+$", "")
    is_file = F.col("label") == F.element_at(F.split("source_file", "/"), -1)
    each = (
        (0, F.when(is_file, F.col("label"))), (0, F.when(is_file, file)), (1, F.concat_ws(".", file, label)), (2, F.concat_ws(".", owner, label)), (3, label),
        (4, F.concat_ws(".", F.replace(stem, F.lit("/"), F.lit(".")), label)),
    )
    forms = nodes.where("file_type = 'code'").select("id", F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), f.alias("form")) for r, f in each])).alias("f"))
    forms = forms.select("id", "f.rank", F.lower("f.form").alias("form")).where("form IS NOT NULL")
    hits = anchors.select("doc", F.lower(F.regexp_replace("anchor", r"[`()]", "")).alias("form")).join(forms, "form")
    best = hits.groupBy("doc", "form").agg(F.min("rank").alias("rank"))
    found = hits.join(best, ["doc", "form", "rank"]).select("doc", "form", "id").distinct()
    k = found.groupBy("doc", "form").agg(F.count(F.lit(1)).alias("k"))
    sure = F.col("k") == 1
    return found.join(k, ["doc", "form"]).select(F.col("doc").alias("src"), F.col("id").alias("dst"), F.when(sure, "EXTRACTED").otherwise("AMBIGUOUS").alias("confidence"), F.when(sure, 1.0).otherwise(0.3).alias("score"))


@register("interfaces", "cs", "java", "kt", "ts")
def _dispatch(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return interface_dispatch(edges, nodes)
