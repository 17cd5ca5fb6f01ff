"""Property graphs over DataFrames.

A graph holds one DataFrame per vertex label (an ``id`` column and typed
properties) and one per edge type (``src``, ``dst`` and properties). Nothing is
read before a plan is run, so a scan of one label reads one table and only the
columns that the plan uses.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PropertyGraph:
    vertices: dict[str, DataFrame]
    edges: dict[str, DataFrame]
    #: Column that assigns a row to a project, if the graph is shared.
    project_column: str = "project"
    name: str = "graph"
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)

    def label(self, name: str) -> DataFrame:
        """All vertices of a label."""
        if name not in self.vertices:
            raise KeyError(f"unknown label {name!r}")
        return self.vertices[name]

    def edge(self, *types: str) -> DataFrame:
        """(type, src, dst) of the given edge types, or of all."""
        chosen = types or tuple(self.edges)
        parts = []
        for t in chosen:
            if t not in self.edges:
                raise KeyError(f"unknown edge type {t!r}")
            parts.append(self.edges[t].select(F.lit(t).alias("type"), "src", "dst"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def all_vertices(self) -> DataFrame:
        """(id, label) of every vertex."""
        parts = [v.select("id", F.lit(k).alias("label")) for k, v in self.vertices.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def scoped(self, project: str) -> "PropertyGraph":
        """The graph restricted to one project on every scan, edges included."""
        cut = lambda df: df.where(F.col(self.project_column) == project) if self.project_column in df.columns else df
        return PropertyGraph({k: cut(v) for k, v in self.vertices.items()}, {k: cut(e) for k, e in self.edges.items()}, self.project_column, f"{self.name}/{project}", self.ends)


def trade_graph(spark: SparkSession, d: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts and orders as a graph."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    key = lambda label, c: F.concat(F.lit(f"{label}:"), F.col(c).cast("string"))
    region, nation, customer, supplier, part, orders, line = map(t, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
    vertices = {
        "Region": region.withColumn("id", key("Region", "r_regionkey")),
        "Nation": nation.withColumn("id", key("Nation", "n_nationkey")),
        "Customer": customer.withColumn("id", key("Customer", "c_custkey")),
        "Supplier": supplier.withColumn("id", key("Supplier", "s_suppkey")),
        "Part": part.withColumn("id", key("Part", "p_partkey")),
        "Order": orders.withColumn("id", key("Order", "o_orderkey")),
    }
    edges = {
        "IN_REGION": nation.select(key("Nation", "n_nationkey").alias("src"), key("Region", "n_regionkey").alias("dst")),
        "IN_NATION": customer.select(key("Customer", "c_custkey").alias("src"), key("Nation", "c_nationkey").alias("dst")).unionByName(
            supplier.select(key("Supplier", "s_suppkey").alias("src"), key("Nation", "s_nationkey").alias("dst"))
        ),
        "PLACED": orders.select(key("Customer", "o_custkey").alias("src"), key("Order", "o_orderkey").alias("dst")),
        "CONTAINS": line.select(key("Order", "l_orderkey").alias("src"), key("Part", "l_partkey").alias("dst"), "l_linenumber", "l_quantity", "l_extendedprice"),
        "SUPPLIED_BY": line.select(key("Order", "l_orderkey").alias("src"), key("Supplier", "l_suppkey").alias("dst"), "l_linenumber", "l_quantity"),
    }
    ends = {"IN_REGION": ("Nation", "Region"), "IN_NATION": ("Customer", "Nation"), "PLACED": ("Customer", "Order"), "CONTAINS": ("Order", "Part"), "SUPPLIED_BY": ("Order", "Supplier")}
    return PropertyGraph(vertices, edges, name="trade", ends=ends)


def knowledge_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(id, labels, props, created_at, deleted_at) and (edge_id, type, src, dst, properties) of the knowledge graph."""
    n = spark.read.parquet(f"{d}/graph_nodes.parquet").select(F.col("node_id").alias("id"), "labels", "props", "created_at", "deleted_at").distinct()
    e = spark.read.parquet(f"{d}/graph_edges.parquet").select("edge_id", F.col("edge_type").alias("type"), F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "properties")
    return n, e
