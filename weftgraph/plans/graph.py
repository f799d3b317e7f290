"""The property graph as two DataFrames, and the graph that the test tables imply.

``nodes``: id, label, file_type, source_file, source_location, community.
``edges``: src, dst, relation, context, confidence, confidence_score, weight, source_file.
Edges are stored directed; the undirected view is a projection on (least, greatest).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scores of edges that state none, by confidence. Fixed values.
TIER_SCORE = {"EXTRACTED": 1.0, "INFERRED": 0.55, "AMBIGUOUS": 0.2}


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def where_edges(self, condition) -> Graph:
        """The graph with all nodes and some edges."""
        return Graph(self.nodes, self.edges.where(condition))


def pairs(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a, b), self-loops included."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, other) both ways for each distinct pair, without self-loops."""
    p = pairs(edges).where("a <> b")
    return p.select(F.col("a").alias("id"), F.col("b").alias("other")).union(p.select(F.col("b"), F.col("a")))


def degrees(graph: Graph) -> DataFrame:
    """(id, degree) of every node: distinct neighbours, a self-loop counting two."""
    p = pairs(graph.edges)
    ends = p.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return graph.nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def derived_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the test tables: regions, nations, customers, suppliers, parts and orders."""
    region, nation, customer, supplier, part, orders = tables(spark, sf_dir, "region", "nation", "customer", "supplier", "part", "orders")
    country = F.broadcast(nation.select("n_nationkey", "n_name"))  # 25 rows by the schema of the tables
    of = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id")
    file = lambda kind, name: F.concat(F.lit(f"{kind}/"), F.col(name), F.lit(".tbl")).alias("source_file")
    typed = lambda t: F.lit(t).alias("file_type")
    community = lambda e: F.expr(e).cast("int").alias("community")
    parts = [
        region.select(of("region", "r_regionkey"), F.col("r_name").alias("label"), typed("concept"), file("region", "r_name"), community("100 + r_regionkey")),
        nation.select(of("nation", "n_nationkey"), F.col("n_name").alias("label"), typed("concept"), file("nation", "n_name"), community("n_nationkey")),
        customer.join(country, F.col("c_nationkey") == F.col("n_nationkey")).select(
            of("customer", "c_custkey"), F.col("c_name").alias("label"), typed("code"), file("customer", "n_name"), community("c_nationkey")
        ),
        supplier.join(country, F.col("s_nationkey") == F.col("n_nationkey")).select(
            of("supplier", "s_suppkey"), F.col("s_name").alias("label"), typed("code"), file("supplier", "n_name"), community("s_nationkey")
        ),
        part.select(of("part", "p_partkey"), F.col("p_name").alias("label"), typed("code"), file("part", "p_brand"), community("30 + p_size")),
        orders.select(
            of("order", "o_orderkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("label"), typed("document"),
            file("orders", "o_orderpriority"), community("o_orderkey % 25"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("source_location", F.lit("L1"))


def derived_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the test tables; confidence of order lines by their return flag."""
    nation, customer, supplier, orders, lineitem = tables(spark, sf_dir, "nation", "customer", "supplier", "orders", "lineitem")
    at = lambda kind, key, name: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias(name)
    plain = lambda rel, ctx, conf: (F.lit(rel).alias("relation"), F.lit(ctx).cast("string").alias("context"), F.lit(conf).alias("confidence"), F.lit(1.0).alias("weight"))
    by_flag = F.when(F.col("flag") == "R", "AMBIGUOUS").when(F.col("flag") == "A", "INFERRED").otherwise("EXTRACTED").alias("confidence")
    line = lambda a, b: lineitem.groupBy(a, b).agg(F.max("l_returnflag").alias("flag"), F.count(F.lit(1)).cast("double").alias("weight"))
    parts = [
        nation.select(at("nation", "n_nationkey", "src"), at("region", "n_regionkey", "dst"), *plain("contains", None, "EXTRACTED")),
        customer.select(at("customer", "c_custkey", "src"), at("nation", "c_nationkey", "dst"), *plain("references", "parameter_type", "EXTRACTED")),
        supplier.select(at("supplier", "s_suppkey", "src"), at("nation", "s_nationkey", "dst"), *plain("references", "parameter_type", "INFERRED")),
        orders.select(at("order", "o_orderkey", "src"), at("customer", "o_custkey", "dst"), *plain("calls", "call", "EXTRACTED")),
        line("l_orderkey", "l_partkey").select(
            at("order", "l_orderkey", "src"), at("part", "l_partkey", "dst"), F.lit("uses").alias("relation"), F.lit("field").alias("context"), by_flag, "weight"
        ),
        line("l_partkey", "l_suppkey").select(
            at("part", "l_partkey", "src"), at("supplier", "l_suppkey", "dst"), F.lit("imports_from").alias("relation"), F.lit("import").alias("context"), by_flag, "weight"
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    score = F.when(F.col("confidence") == "EXTRACTED", 1.0).when(F.col("confidence") == "INFERRED", 0.55).otherwise(0.2)
    return out.withColumn("confidence_score", score)


def derived_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(derived_nodes(spark, sf_dir), derived_edges(spark, sf_dir))


#: The derived graph in DuckDB SQL: common table expressions ``nodes`` and ``edges``.
GRAPH_SQL = """
WITH nodes AS (
    SELECT 'region:' || r_regionkey AS id, r_name AS label, 'concept' AS file_type, 'region/' || r_name || '.tbl' AS source_file, (100 + r_regionkey)::INT AS community FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'concept', 'nation/' || n_name || '.tbl', n_nationkey::INT FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, c_name, 'code', 'customer/' || n_name || '.tbl', c_nationkey::INT FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'code', 'supplier/' || n_name || '.tbl', s_nationkey::INT FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT 'part:' || p_partkey, p_name, 'code', 'part/' || p_brand || '.tbl', (30 + p_size)::INT FROM part
    UNION ALL SELECT 'order:' || o_orderkey, 'order ' || o_orderkey, 'document', 'orders/' || o_orderpriority || '.tbl', (o_orderkey % 25)::INT FROM orders),
raw_edges AS (
    SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'contains' AS relation, NULL AS context, 'EXTRACTED' AS confidence, 1.0::DOUBLE AS weight FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'references', 'parameter_type', 'EXTRACTED', 1.0 FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'references', 'parameter_type', 'INFERRED', 1.0 FROM supplier
    UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'calls', 'call', 'EXTRACTED', 1.0 FROM orders
    UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'uses', 'field', CASE max(l_returnflag) WHEN 'R' THEN 'AMBIGUOUS' WHEN 'A' THEN 'INFERRED' ELSE 'EXTRACTED' END, count(*) FROM lineitem GROUP BY l_orderkey, l_partkey
    UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'imports_from', 'import', CASE max(l_returnflag) WHEN 'R' THEN 'AMBIGUOUS' WHEN 'A' THEN 'INFERRED' ELSE 'EXTRACTED' END, count(*) FROM lineitem GROUP BY l_partkey, l_suppkey),
edges AS (SELECT *, CASE confidence WHEN 'EXTRACTED' THEN 1.0::DOUBLE WHEN 'INFERRED' THEN 0.55::DOUBLE ELSE 0.2::DOUBLE END AS confidence_score FROM raw_edges),
pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges),
ends AS (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs),
degrees AS (SELECT nodes.id, count(ends.id) AS degree FROM nodes LEFT JOIN ends USING (id) GROUP BY nodes.id)
"""
