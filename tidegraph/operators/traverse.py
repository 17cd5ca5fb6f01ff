"""Traversals over (src, dst) edges: neighbourhoods, reachability, paths, anti and semi joins.

Frontier loops write each level to the shared folder, so a level's plan never
repeats the earlier ones, and stop when a level adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.scratch import materialise


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, loops once; other columns are dropped."""
    e = edges.select("src", "dst")
    return e.unionByName(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def directed(edges: DataFrame, direction: str) -> DataFrame:
    if direction == "outgoing":
        return edges.select("src", "dst")
    if direction == "incoming":
        return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction == "both":
        return both_ways(edges)
    raise ValueError(f"unknown direction {direction!r}")


def related(edges: DataFrame, start: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(src, dst): what the ids of ``start`` (id) are linked to."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    return directed(e, direction).join(start.select(F.col("id").alias("src")).distinct(), "src", "left_semi").distinct()


def orphans(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices (id, …) without any edge."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return vertices.join(ends, "id", "left_anti")


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): edge ends at each vertex, isolated vertices included."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return vertices.select("id").join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"))


def ego(edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vertices and edges (edge_id, type, src, dst) within one hop of ``start`` (id)."""
    ids = start.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), allowMissingColumns=True)
    out = out.select(*edges.columns).dropDuplicates(["edge_id"])
    nodes = ids.unionByName(out.select(F.col("src").alias("id"))).unionByName(out.select(F.col("dst").alias("id"))).where("id IS NOT NULL").distinct()
    return nodes, out


def reach(edges: DataFrame, start: DataFrame, direction: str = "outgoing", depth: int | None = None) -> DataFrame:
    """(root, id, depth): vertices within ``depth`` hops of each root at their least distance; the root itself is left out.

    Without a depth the loop runs until nothing new is reached; cycles end by the anti-join with what was seen.
    """
    steps = directed(edges, direction).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    seen = materialise(start.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct(), "reach-0")
    frontier, d = seen, 0
    while depth is None or d < depth:
        d += 1
        new = frontier.join(steps, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id")).distinct().join(seen.select("root", "id"), ["root", "id"], "left_anti")
        frontier = materialise(new.withColumn("depth", F.lit(d)), f"reach-{d}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def paths(edges: DataFrame, start: DataFrame, least: int = 1, most: int = 3, direction: str = "outgoing") -> DataFrame:
    """(root, id, length, path) of all paths of ``least`` to ``most`` edges that use no edge twice.

    ``edges`` needs an ``edge_id``; the number of paths is what the caller asks for with ``most``.
    """
    e = edges.select("edge_id", "src", "dst")
    if direction == "incoming":
        e = e.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    elif direction == "both":
        e = e.unionByName(e.where("src <> dst").select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    now = start.select(F.col("id").alias("root"), "id", F.array("id").alias("path"), F.array().cast("array<string>").alias("used"))
    found = None
    for n in range(1, most + 1):
        now = (
            now.join(e, (F.col("id") == F.col("src")) & ~F.array_contains("used", F.col("edge_id")))
            .select("root", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"), F.concat("used", F.array("edge_id")).alias("used"))
        )
        if n >= least:
            part = now.select("root", "id", F.lit(n).alias("length"), "path")
            found = part if found is None else found.unionByName(part)
    return found


def subgraph(edges: DataFrame, root: DataFrame, depth: int = 2, types: list[str] | None = None) -> DataFrame:
    """Edges between the vertices within ``depth`` undirected hops of the roots."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    near = reach(e, root, "both", depth).select("id").unionByName(root.select("id")).distinct()
    return e.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def attach_edges(new: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New edges (src, dst, …) whose two ends exist, and those rejected with the missing end."""
    ids = vertices.select("id").distinct()
    a = new.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    good = a.where("_s AND _d").select(*new.columns)
    bad = a.where("_s IS NULL OR _d IS NULL").select(*new.columns, F.when(F.col("_s").isNull(), "source").otherwise("target").alias("missing"))
    return good, bad


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
