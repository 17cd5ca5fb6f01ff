"""Consolidating pairwise matches into groups (problem 6).

Vertices are hashed into ``B`` blocks and every edge lies in the cell of its
two blocks. Each cell runs a union-find over its own edges and names, for each
of its vertices, a local representative. A vertex then exchanges the
representatives it got from the cells of its row and column and takes the
first in the round's hash order as its parent; wherever it heard of several
representatives, edges between them make the next, smaller round. When no edge
is left, parents are followed to the root and each root's group gets the
smallest id in text order.

Cells are read in chunks of at most ``cell_edges`` edges, so memory in a task
is bounded; a chunk is correct whatever edges it holds. Each round's hash is
salted, which makes long chains shrink by a constant factor whatever their ids.

Defined results: an edge with a null end is ignored; an edge from a record to
itself makes a group of its own unless other edges link it; repeated and
reversed edges change nothing; an empty table gives no rows; other columns of
the edge table are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.plans import skew
from tidegraph.plans.scratch import Scope, materialise

CELL_EDGES = 100_000


def union_find(pairs_a: list[int], pairs_b: list[int], n: int) -> list[int]:
    """Smallest member of each vertex's component; path halving, smaller root wins."""
    parent = list(range(n))
    for a, b in zip(pairs_a, pairs_b):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    for v in range(n):  # parents are smaller than children, so theirs are final
        parent[v] = parent[parent[v]]
    return parent


def _local(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches)
    names = pa.concat_arrays([*t.column("a").chunks, *t.column("b").chunks])
    ranks = np.concatenate([t.column("ha").to_numpy(), t.column("hb").to_numpy()])
    enc = pc.dictionary_encode(names)
    codes, words = enc.indices.to_numpy(), enc.dictionary
    rank = np.empty(len(words), dtype=np.int64)
    rank[codes] = ranks
    # Equal hashes of different names are put in the order of the names.
    by_name = np.empty(len(words), dtype=np.int64)
    by_name[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((by_name, rank))
    place = np.empty(len(words), dtype=np.int64)
    place[order] = np.arange(len(words))
    codes = place[codes]
    half = len(codes) // 2
    root = np.array(union_find(codes[:half].tolist(), codes[half:].tolist(), len(words)), dtype=np.int64)
    words = words.take(pa.array(order))
    return pa.RecordBatch.from_arrays([words, words.take(pa.array(root)), pa.array(rank[order][root])], names=["v", "rep", "h"])


def _cells(cell_edges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= cell_edges:
                yield _local(held)
                held, rows = [], 0
        if held:
            yield _local(held)

    return run


def _round(edges: DataFrame, n: int, salt: int, cell_edges: int) -> DataFrame:
    """Rows (v, rep, h, m): a representative of v in one cell and v's parent."""
    blocks = max(1, math.ceil(math.sqrt(2 * n / cell_edges)))
    cells = blocks * (blocks + 1) // 2
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    grid = (
        edges.withColumns({"ha": F.xxhash64("a", F.lit(salt)), "hb": F.xxhash64("b", F.lit(salt))})
        .withColumn("row", F.least(block("a"), block("b")))
        .withColumn("col", F.greatest(block("a"), block("b")))
        .repartition(cells, "row", "col")
        .select("a", "b", "ha", "hb")
    )
    heard = grid.mapInArrow(_cells(cell_edges), "v string, rep string, h bigint")
    best = F.min(F.struct("h", "rep")).over(Window.partitionBy("v"))
    return heard.withColumn("m", best["rep"]).select("v", "rep", "m")


def _follow(links: DataFrame, target: DataFrame, hot_rows: int) -> DataFrame:
    """links (v, p) joined with target (p, to) on p; p may be one value for most rows."""
    hot = skew.hot_keys(links.groupBy("p").agg(F.count("*").alias("n")), ["p"], "n", hot_rows)
    left = skew.spread(links, hot, ["p"], F.col("v"))
    return left.join(skew.repeat(target, hot, ["p"]), ["p", "_salt"]).select("v", F.col("to").alias("p"))


def linked_groups(edges: DataFrame, a: str, b: str, cell_edges: int = CELL_EDGES, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """(group_id, record_id) for every record at an end of an edge whose two ends aren't null."""
    ends = edges.select(edges[a].cast("string").alias("a"), edges[b].cast("string").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    alone = ends.where("a = b").select(F.col("a").alias("v"), F.col("a").alias("m"), F.lit(0).alias("r")).distinct()
    with Scope() as scope:
        left = materialise(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges-0")
        heard, r = alone, 0
        while n := left.count():
            r += 1
            table = materialise(_round(left, n, r, cell_edges), f"cells-{r}")
            heard = heard.unionByName(table.select("v", "m", F.lit(r).alias("r")).distinct())
            left = materialise(table.where("rep <> m").select(F.least("rep", "m").alias("a"), F.greatest("rep", "m").alias("b")).distinct(), f"edges-{r}")
        # A vertex's parent in the last round it took part in is its root or takes part in a later round.
        links = heard.groupBy("v").agg(F.max_by("m", "r").alias("p"))
        for step in range(math.ceil(math.log2(max(r, 1)))):
            links = materialise(links, f"parents-{step}")
            links = _follow(links, links.select(F.col("v").alias("p"), F.col("p").alias("to")), hot_rows)
        links = scope.keep(materialise(links, "parents"))
    smallest = links.groupBy("p").agg(F.min("v").alias("to"))
    return _follow(links, smallest, hot_rows).select(F.col("p").alias("group_id"), F.col("v").alias("record_id"))
