"""Pull requests against the graph, and lessons from past questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_DAYS, HALF_LIFE_DAYS, CORROBORATION = 14, 30.0, 2


def file_index(nodes: DataFrame) -> DataFrame:
    """(source_file, communities, n): of each file."""
    return nodes.where("source_file <> ''").groupBy("source_file").agg(F.array_sort(F.collect_set("community")).alias("communities"), F.count(F.lit(1)).alias("n"))


def _suffixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def impact(prs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(number, communities, n_nodes): what the files of each pull request (number, files) touch.

    A file matches if one path is the other or its end at a folder; both are equi-joins on suffixes.
    """
    index = file_index(nodes)
    changed = prs.select("number", F.explode("files").alias("file")).distinct()
    by_end = index.select("source_file", F.explode(_suffixes(F.col("source_file"))).alias("file")).join(changed, "file")
    by_start = changed.select("number", F.explode(_suffixes(F.col("file"))).alias("source_file")).join(index.select("source_file"), "source_file")
    hit = by_end.select("number", "source_file").union(by_start.select("number", "source_file")).distinct()
    got = hit.join(index, "source_file").groupBy("number").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("communities")))).alias("communities"), F.sum("n").alias("n_nodes"))
    return prs.select("number").join(got, "number", "left").select("number", F.coalesce("communities", F.array().cast("array<int>")).alias("communities"), F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))


def status(prs: DataFrame, base: str, now: Column) -> DataFrame:
    """(number, status) by the first rung that holds."""
    age = F.datediff(now, F.col("updated_at"))
    ladder = (
        F.when(F.col("base") != base, "WRONG-BASE").when(F.col("ci_status") == "FAILURE", "CI-FAIL").when(F.col("review") == "CHANGES_REQUESTED", "CHANGES-REQ")
        .when(F.col("is_draft"), "DRAFT").when(age >= STALE_DAYS, "STALE").when(F.col("review") == "APPROVED", "APPROVED").when(F.col("ci_status") == "PENDING", "PENDING").otherwise("READY")
    )
    return prs.select("number", ladder.alias("status"))


def conflicts(impacts: DataFrame) -> DataFrame:
    """(community, n, numbers): communities that several pull requests touch."""
    each = impacts.select("number", F.explode("communities").alias("community"))
    return each.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("number")).alias("numbers")).where("n > 1")


def decay(age_days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)


def lessons(docs: DataFrame, now: Column, half_life: float = HALF_LIFE_DAYS, corroboration: int = CORROBORATION) -> DataFrame:
    """(node, pos, neg, score, last, verdict): signed and decayed evidence for each cited node.

    ``docs``: doc_id, date, outcome (useful, dead_end, corrected), source_nodes. A date that is
    missing keeps full weight. Nodes with negative evidence only have the verdict dead_end.
    """
    each = docs.where("outcome IN ('useful', 'dead_end', 'corrected')").select("date", "outcome", F.explode(F.array_distinct("source_nodes")).alias("node"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("date").cast("timestamp"))) / 86_400_000_000.0
    sign = F.when(F.col("outcome") == "useful", 1.0).otherwise(-1.0)
    agg = each.groupBy("node").agg(
        F.count(F.when(F.col("outcome") == "useful", 1)).alias("pos"), F.count(F.when(F.col("outcome") != "useful", 1)).alias("neg"),
        F.round(F.sum(sign * F.coalesce(decay(age, half_life), F.lit(1.0))), 6).alias("score"), F.max("date").alias("last"),
    )
    verdict = (
        F.when((F.col("pos") > 0) & (F.col("neg") > 0), "contested").when(F.col("pos") >= corroboration, "preferred").when(F.col("pos") > 0, "tentative").otherwise("dead_end")
    )
    return agg.withColumn("verdict", verdict)


def latest_by_question(docs: DataFrame) -> DataFrame:
    """The last document of each question, by date, then id."""
    return docs.groupBy("question").agg(F.max(F.struct("date", "doc_id")).alias("m")).select("question", F.col("m.date").alias("date"), F.col("m.doc_id").alias("doc_id"))


def overlay(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, verdict, score) of lessons on nodes: by id, or by a label that one node has; the best verdict of a node stays."""
    by_id = found.join(nodes.select("id"), found["node"] == nodes["id"]).select("id", "verdict", "score")
    unique = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id")).where("k = 1")
    by_label = found.join(nodes.select("id"), found["node"] == nodes["id"], "left_anti").join(unique, found["node"] == unique["label"]).select("id", "verdict", "score")
    rank = F.when(F.col("verdict") == "preferred", 0).when(F.col("verdict") == "tentative", 1).when(F.col("verdict") == "contested", 2).otherwise(3)
    return by_id.union(by_label).groupBy("id").agg(F.min(F.struct(rank.alias("r"), (-F.col("score")).alias("s"), "verdict")).alias("m")).select("id", "m.verdict", (-F.col("m.s")).alias("score"))
