"""Graph algorithms over (src, dst[, weight]) edges.

Definitions are stated with each function; ties go to the smaller id. Iterations
write one table per round to the shared folder, so a plan never holds more than
one round and a lost executor costs one round at most.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.traverse import both_ways
from tidegraph.operators.unionfind import star_forest
from tidegraph.plans import skew
from tidegraph.plans.graph import PropertyGraph
from tidegraph.plans.scratch import drop_scratch, materialise


@dataclass
class Projections:
    """Named edge tables: labels and types chosen once, oriented, with the properties asked for."""

    made: dict[str, DataFrame] = field(default_factory=dict)

    def create(self, name: str, graph: PropertyGraph, types: list[str] | None = None, orientation: str = "natural", weight: str | None = None) -> DataFrame:
        if name in self.made:
            raise ValueError(f"projection {name!r} exists")
        parts = []
        for t in types or list(graph.edges):
            e = graph.edges[t]
            w = F.col(weight).cast("double") if weight and weight in e.columns else F.lit(1.0)
            parts.append(e.select("src", "dst", w.alias("weight")))
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        back = df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        if orientation == "reverse":
            df = back
        elif orientation == "undirected":
            df = df.unionByName(back.where("src <> dst"))
        elif orientation != "natural":
            raise ValueError(f"unknown orientation {orientation!r}")
        self.made[name] = df
        return df

    def drop(self, name: str) -> bool:
        return self.made.pop(name, None) is not None

    def exists(self, name: str) -> bool:
        return name in self.made

    def names(self) -> list[str]:
        return sorted(self.made)


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("src IS NOT NULL AND dst IS NOT NULL")


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """(id, score): ``r = (1 - d) + d * sum(r_src / outdegree)`` from 1.0, a fixed number of rounds.

    Scores aren't normalised and the rank of vertices without outgoing edges is not
    spread. Parallel edges are summed into a share first, so a round moves one row
    per distinct edge, and contributions are added before the shuffle.
    """
    pairs = _clean(edges).groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = pairs.groupBy("src").agg(F.sum("n").alias("deg"))
    share = pairs.join(out, "src").select("src", "dst", (F.col("n") / F.col("deg")).alias("share"))
    hot = skew.hot_keys(pairs.groupBy("src").agg(F.count("*").alias("n")), ["src"])
    share = materialise(skew.spread(share, hot, ["src"], F.col("dst")), "shares")  # a hub's rows are salted once for all rounds
    vertices = materialise(share.select(F.col("src").alias("id")).unionByName(share.select(F.col("dst").alias("id"))).distinct(), "vertices")
    ranks = vertices.withColumn("score", F.lit(1.0))
    for i in range(1, iterations + 1):
        given = share.join(skew.repeat(ranks.withColumnRenamed("id", "src"), hot, ["src"]), ["src", "_salt"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        ranks = vertices.join(given, "id", "left").select("id", (F.lit(1 - damping) + damping * F.coalesce("in", F.lit(0.0))).alias("score"))
        if i % every == 0 and i < iterations:
            ranks = materialise(ranks, f"ranks-{i}")
    return ranks


def label_propagation(edges: DataFrame, iterations: int = 10) -> DataFrame:
    """(id, community): every round all vertices take the commonest label among their neighbours, the smallest on a tie."""
    e = both_ways(_clean(edges))
    hot = skew.hot_keys(e.groupBy("dst").agg(F.count("*").alias("n")), ["dst"])
    e = materialise(skew.spread(e, hot, ["dst"], F.col("src")), "neighbours")
    labels = materialise(e.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")), "labels-0")
    for i in range(1, iterations + 1):
        votes = e.join(skew.repeat(labels.withColumnRenamed("id", "dst"), hot, ["dst"]), ["dst", "_salt"]).groupBy("src", "community").agg(F.count("*").alias("n"))
        new = votes.groupBy(F.col("src").alias("id")).agg(F.min(F.struct(-F.col("n"), "community")).alias("m")).select("id", F.col("m.community").alias("community"))
        new = materialise(new, f"labels-{i}")
        if new.join(labels, ["id", "community"], "left_anti").isEmpty():
            return new
        labels = new
    return labels


def connected_components(edges: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """(id, component): the smallest id reachable, by alternating large-star and small-star steps.

    Every task first replaces its own edges by stars (union-find), which leaves at
    most one row per vertex and task. A large star then links a vertex's larger
    neighbours to its smallest neighbour, a small star its smaller ones, until a
    round changes nothing; the number of rounds grows with the logarithm of the
    longest chain. A hub's rows are salted before they meet its minimum.
    """
    e = _clean(edges)
    alone = e.where("src = dst").select(F.col("src").cast("string").alias("id")).distinct()
    pairs = e.where("src <> dst").select(F.col("src").cast("string").alias("u"), F.col("dst").cast("string").alias("v"))
    now = materialise(pairs.mapInArrow(star_forest(), "u string, v string").distinct(), "stars-0")

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        return r["n"], r["s"]

    def with_least(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """(rows with their u's least v, that minimum per u)."""
        least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hot = skew.hot_keys(least, ["u"], "n", hot_rows) if 2 * n >= hot_rows else None
        return skew.spread(rows, hot, ["u"], F.col("v")).join(skew.repeat(least.drop("n"), hot, ["u"]), ["u", "_salt"]), least.select("u", "m")

    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near, _ = with_least(both, before[0])
        large = near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        near, least = with_least(large, before[0])
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = materialise(small, "stars")
        after = state(new)
        drop_scratch(now)
        now = new
        if after == before:
            break
        before = after
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id")).distinct().unionByName(alone).distinct().join(members.select("id"), "id", "left_anti")
    return members.unionByName(roots.withColumn("component", F.col("id")))


def bfs_tree(edges: DataFrame, source: str, target: str | None = None, direction: str = "outgoing", limit: int | None = None) -> DataFrame:
    """(id, parent, cost, path): fewest hops from the source, at most ``limit`` of them if given; of equally good parents the smallest.

    ``path`` leads from the source to the vertex; it is null without a target.
    """
    from tidegraph.operators.traverse import directed

    e = directed(_clean(edges), direction).distinct()
    spark = edges.sparkSession
    seen = materialise(spark.createDataFrame([(source, None, 0, [source] if target is not None else None)], "id string, parent string, cost int, path array<string>"), "tree-0")
    front, d = seen, 0
    while limit is None or d < limit:
        d += 1
        new = front.select(F.col("id").alias("src"), "path").join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("src", "path")).alias("p")).join(seen.select("id"), "id", "left_anti")
        front = materialise(new.select("id", F.col("p.src").alias("parent"), F.lit(d).alias("cost"), F.concat("p.path", F.array("id")).alias("path")), f"tree-{d}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if target is not None and not front.where(F.col("id") == target).isEmpty():
            break
    return seen


def _path_to(tree: DataFrame, source: str, target: str, costs) -> DataFrame:
    """(source, target, total_cost, node_ids, costs) of the target's row; no row if it isn't reached."""
    return tree.where(F.col("id") == target).select(F.lit(source).alias("source"), F.lit(target).alias("target"), F.col("cost").cast("double").alias("total_cost"), F.col("path").alias("node_ids"), costs.alias("costs"))


def shortest_path(edges: DataFrame, source: str, target: str, direction: str = "outgoing", most: int | None = None) -> DataFrame:
    steps = F.transform(F.sequence(F.lit(0), F.col("cost")), lambda x: x.cast("double"))
    return _path_to(bfs_tree(edges, source, target, direction, most), source, target, steps)


def dijkstra(edges: DataFrame, source: str, target: str, weight: str = "weight") -> DataFrame:
    """The cheapest path by relaxing all edges at the vertices that changed, until none does.

    Weights must not be negative; a null weight is no edge. Each row carries its
    path, so the path is read off at the end.
    """
    e = materialise(_clean(edges).select("src", "dst", F.col(weight).cast("double").alias("w")).where("w IS NOT NULL").groupBy("src", "dst").agg(F.min("w").alias("w")), "weighted")
    if not e.where("w < 0").isEmpty():
        raise ValueError("weights must not be negative")
    spark = edges.sparkSession
    best = materialise(spark.createDataFrame([(source, 0.0, [source], [0.0])], "id string, cost double, path array<string>, costs array<double>"), "best-0")
    changed = best
    while True:
        offers = changed.join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("cost") + F.col("w")).alias("cost"), "src", "path", "costs")).alias("o"))
        offers = offers.select("id", "o.cost", F.concat("o.path", F.array("id")).alias("path"), F.concat("o.costs", F.array("o.cost")).alias("costs"))
        old = best.select("id", F.col("cost").alias("old"))
        changed = materialise(offers.join(old, "id", "left").where("old IS NULL OR cost < old").drop("old"), "changed")
        if changed.isEmpty():
            break
        best = materialise(best.join(changed.select("id"), "id", "left_anti").unionByName(changed), "best")
    return _path_to(best, source, target, F.col("costs"))


def node_similarity(edges: DataFrame, cutoff: float = 0.5, top_k: int = 10) -> DataFrame:
    """(node1, node2, similarity): Jaccard of the distinct ``dst`` of two ``src``, the best ``top_k`` per node.

    Vertices with the same neighbours form one class, found by a fingerprint, and
    only classes are compared. A pair above the cutoff shares one of the rarest
    neighbours of each (prefix filter), so a neighbour of a third of all vertices
    is hardly ever joined on. A class takes part as a partner with its first
    ``top_k + 1`` members, which is all that ``top_k`` can show.
    """
    pairs = materialise(_clean(edges).select("src", "dst").distinct(), "links")
    prints = pairs.groupBy("src").agg(F.count("*").alias("n"), F.sum(F.xxhash64("dst").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("dst", F.lit(7))).alias("x"))
    by = ["n", "s", "x"]
    classes = prints.groupBy(*by).agg(F.min("src").alias("rep"))
    member = materialise(prints.join(classes, by).select("src", "rep", "n"), "classes")
    reps = pairs.join(member.where("src = rep").select("src", "n"), "src")
    freq = reps.groupBy("dst").agg(F.count("*").alias("f"))
    w = Window.partitionBy("src").orderBy("f", "dst")
    prefix = F.col("n") - F.ceil(F.col("n") * cutoff) + 1
    ranked = reps.join(freq, "dst").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= prefix).select("src", "dst", "n")
    a, b = ranked.alias("a"), ranked.alias("b")
    sized = (F.col("a.n") >= F.col("b.n") * cutoff) & (F.col("b.n") >= F.col("a.n") * cutoff)
    close = a.join(b, (F.col("a.dst") == F.col("b.dst")) & (F.col("a.src") < F.col("b.src")) & sized).select(F.col("a.src").alias("x"), F.col("b.src").alias("y"), F.col("a.n").alias("nx"), F.col("b.n").alias("ny")).distinct()
    shared = close.join(reps.select(F.col("src").alias("x"), "dst"), "x").join(reps.select(F.col("src").alias("y"), "dst"), ["y", "dst"]).groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("c"))
    sim = shared.withColumn("similarity", F.col("c") / (F.col("nx") + F.col("ny") - F.col("c"))).where(F.col("similarity") >= cutoff)
    both = sim.select(F.col("x").alias("rep"), F.col("y").alias("other"), "similarity").unionByName(sim.select(F.col("y").alias("rep"), F.col("x").alias("other"), "similarity"))
    both = both.unionByName(member.select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("similarity")).distinct())
    first = member.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("src"))).where(F.col("r") <= top_k + 1).select(F.col("rep").alias("other"), F.col("src").alias("node2"))
    out = member.select(F.col("src").alias("node1"), "rep").join(both, "rep").join(first, "other").where("node1 <> node2")
    order = Window.partitionBy("node1").orderBy(F.col("similarity").desc(), "node2")
    return out.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top_k).select("node1", "node2", "similarity")


#: Edges of a connected part up to which one task finds its communities.
LOCAL_EDGES = 100_000


def local_louvain(links: list[tuple[str, str, float]], total: float) -> dict[str, str]:
    """Communities of (a, b, weight) in a graph of that total weight: vertices move in the order of their ids until none gains, then communities become vertices."""
    ids = sorted({x for a, b, _ in links for x in (a, b)})
    place = {v: i for i, v in enumerate(ids)}
    member = list(range(len(ids)))  # vertex -> its vertex at this level
    near: list[dict[int, float]] = [{} for _ in ids]
    for a, b, w in links:
        i, j = place[a], place[b]
        near[i][j] = near[i].get(j, 0.0) + w
        if i != j:
            near[j][i] = near[j].get(i, 0.0) + w
    while True:
        n = len(near)
        degree = [sum(w * (1 + (v == u)) for v, w in near[u].items()) for u in range(n)]
        at, whole, any_move, moved = list(range(n)), degree[:], False, True
        while moved:
            moved = False
            for u in range(n):
                kin: dict[int, float] = {}
                for v, w in near[u].items():
                    if v != u:
                        kin[at[v]] = kin.get(at[v], 0.0) + w
                own = at[u]
                whole[own] -= degree[u]
                gain = lambda c: kin.get(c, 0.0) - degree[u] * whole[c] / (2 * total)  # noqa: B023, E731
                best = min(kin, key=lambda c: (-round(gain(c), 9), c), default=own)
                if round(gain(best), 9) > round(gain(own), 9):
                    at[u], moved, any_move = best, True, True
                whole[at[u]] += degree[u]
        if not any_move:
            break
        names = {c: i for i, c in enumerate(sorted(set(at)))}
        member = [names[at[m]] for m in member]
        next_: list[dict[int, float]] = [{} for _ in names]
        for u in range(n):
            for v, w in near[u].items():
                if u <= v:
                    x, y = names[at[u]], names[at[v]]
                    next_[x][y] = next_[x].get(y, 0.0) + w
                    if x != y:
                        next_[y][x] = next_[y].get(x, 0.0) + w
        near = next_
    first: dict[int, str] = {}
    for v, m in zip(ids, member):
        first.setdefault(m, v)
    return {v: first[m] for v, m in zip(ids, member)}


def _communities(total: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, str]] = []
        for _, part in pdf.groupby("part"):
            out += local_louvain(list(zip(part["a"], part["b"], part["w"])), total).items()
        return pd.DataFrame(out, columns=["id", "community"])

    return run


def louvain(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, community): modularity by local moves and contraction; a community is named by its smallest member.

    No community spans two connected parts, so a part of up to ``local_edges``
    edges is done by one task, several small parts to a task; larger ones go round
    by round over all tasks (:func:`distributed_louvain`).
    """
    e = _clean(edges)
    w = F.col("weight").cast("double") if "weight" in e.columns else F.lit(1.0)
    links = materialise(e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w")), "links")
    sums = links.agg(F.sum("w").alias("w"), F.count("*").alias("n")).first()
    if not sums["w"]:
        return links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct().withColumn("community", F.col("id"))
    parts = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    of = parts.select(F.col("id").alias("a"), F.col("component").alias("part"))
    placed = materialise(links.join(of, "a"), "parts")
    sizes = placed.groupBy("part").agg(F.count("*").alias("edges"))
    large = materialise(sizes.where(F.col("edges") > local_edges).select("part"), "large-parts")
    some_large = not large.isEmpty()
    small = placed.join(large, "part", "left_anti") if some_large else placed
    tasks = max(1, -(-sums["n"] // local_edges))
    found = small.groupBy(F.pmod(F.xxhash64("part"), F.lit(tasks)).alias("task")).applyInPandas(_communities(sums["w"]), "id string, community string")
    if not some_large:
        return found
    rest = placed.join(large, "part", "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight"))
    return found.unionByName(distributed_louvain(rest, total=sums["w"]))


def distributed_louvain(edges: DataFrame, levels: int = 10, rounds: int | None = None, total: float | None = None) -> DataFrame:
    """(id, community): Louvain over all tasks; ``total`` is the weight of the whole graph if these are only some of its edges.

    In a round the vertices of one hash class may move to the neighbouring community
    with the greatest gain, if it beats staying; classes take turns, so neighbours
    seldom swap. A level ends when a turn of all classes moves nothing, or after
    ``rounds``, if given. Classes are drawn anew each turn and their number doubles
    every fifth turn: in the end vertices move alone, each move raises modularity,
    and the level must end.
    """
    e = _clean(edges)
    w = F.col("weight").cast("double") if "weight" in e.columns else F.lit(1.0)
    sym = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    links = materialise(sym, "louvain-0")
    member = materialise(links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct().withColumn("community", F.col("id")), "members-0")
    total = total or links.agg(F.sum("w")).first()[0]
    if not total:
        return member
    for level in range(1, levels + 1):
        both = links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(links.where("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))
        hot = skew.hot_keys(both.groupBy("v").agg(F.count("*").alias("n")), ["v"])
        both = materialise(skew.spread(both, hot, ["v"], F.col("u")), f"both-{level}")
        loops = links.where("a = b").select(F.col("a").alias("u"), (2 * F.col("w")).alias("k"))
        degree = materialise(both.select("u", F.col("w").alias("k")).unionByName(loops).groupBy("u").agg(F.sum("k").alias("k")), f"degree-{level}")
        at = materialise(degree.select("u", F.col("u").alias("c")), f"at-{level}")
        any_move, quiet, turn_no, step, classes = False, True, 0, 0, 3
        for r in itertools.count() if rounds is None else range(rounds):
            tot = at.join(degree, "u").groupBy("c").agg(F.sum("k").alias("tot"))
            near = both.join(skew.repeat(at.select(F.col("u").alias("v"), "c"), hot, ["v"]), ["v", "_salt"]).groupBy("u", "c").agg(F.sum("w").alias("kin"))
            near = near.unionByName(at.select("u", "c", F.lit(0.0).alias("kin"))).groupBy("u", "c").agg(F.sum("kin").alias("kin"))
            cand = near.join(tot, "c").join(degree, "u").join(at.select("u", F.col("c").alias("own")), "u")
            others = F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("kin") - F.col("k") * others / (2 * total), 9)
            turn = F.pmod(F.xxhash64("u", F.lit(level), F.lit(turn_no)), F.lit(classes)) == step
            best = cand.withColumn("g", gain).groupBy("u", "own").agg(F.max(F.struct("g", (F.col("c") == F.col("own")).alias("stay"))).alias("m"), F.min(F.struct(-F.col("g"), "c")).alias("b"))
            new = best.select("u", F.when(turn & ~F.col("m.stay"), F.col("b.c")).otherwise(F.col("own")).alias("c"), "own")
            new = materialise(new, f"moves-{level}-{r}")
            moved = not new.where("c <> own").isEmpty()
            at = new.select("u", "c")
            any_move |= moved
            quiet &= not moved
            step += 1
            if step == classes:
                if quiet:
                    break
                quiet, turn_no, step = True, turn_no + 1, 0
                classes = 3 * 2 ** (turn_no // 5)
        if not any_move:
            break
        names = at.groupBy("c").agg(F.min("u").alias("name"))
        at = materialise(at.join(names, "c").select("u", F.col("name").alias("c")), f"named-{level}")
        member = materialise(member.join(at.select(F.col("u").alias("community"), "c"), "community").select("id", F.col("c").alias("community")), f"members-{level}")
        moved_links = links.join(at.select(F.col("u").alias("a"), F.col("c").alias("x")), "a").join(at.select(F.col("u").alias("b"), F.col("c").alias("y")), "b")
        links = materialise(moved_links.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")), f"louvain-{level}")
    names = member.groupBy("community").agg(F.min("id").alias("name"))
    return member.join(names, "community").select("id", F.col("name").alias("community"))


MAX_BROADCAST_EDGES = 2_000_000


def betweenness(edges: DataFrame, sources: DataFrame | None = None, max_edges: int = MAX_BROADCAST_EDGES) -> DataFrame:
    """(id, score): shortest paths through a vertex (Brandes), from all sources or from those given (id).

    Each task walks from its sources over the whole adjacency, which is sent to the
    tasks only while it has at most ``max_edges`` edges; a larger graph is refused.
    """
    pairs = materialise(_clean(edges).select("src", "dst").where("src <> dst").distinct(), "adjacency")
    n = pairs.count()
    if n > max_edges:
        raise ValueError(f"{n} edges are more than the {max_edges} that may be sent to every task")
    rows = pairs.toPandas()
    ids = sorted(set(rows["src"]) | set(rows["dst"]))
    place = {v: i for i, v in enumerate(ids)}
    adjacent: list[list[int]] = [[] for _ in ids]
    for a, b in zip(rows["src"], rows["dst"]):
        adjacent[place[a]].append(place[b])
    shared = pairs.sparkSession.sparkContext.broadcast((ids, place, adjacent))
    start = sources.select("id") if sources is not None else pairs.select(F.col("src").alias("id")).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, place, adjacent = shared.value
        score = [0.0] * len(ids)
        for frame in frames:
            for s in frame["id"]:
                if s in place:
                    _accumulate(place[s], adjacent, score)
        yield pd.DataFrame({"id": ids, "score": score})

    parts = start.repartition(max(1, min(64, n // 1000 + 1))).mapInPandas(run, "id string, score double")
    return parts.groupBy("id").agg(F.sum("score").alias("score"))


def _accumulate(s: int, adjacent: list[list[int]], score: list[float]) -> None:
    order, before, ways, dist = [s], {s: []}, {s: 1}, {s: 0}
    for v in order:
        for x in adjacent[v]:
            if x not in dist:
                dist[x], ways[x], before[x] = dist[v] + 1, 0, []
                order.append(x)
            if dist[x] == dist[v] + 1:
                ways[x] += ways[v]
                before[x].append(v)
    share = dict.fromkeys(order, 0.0)
    for v in reversed(order):
        for p in before[v]:
            share[p] += ways[p] / ways[v] * (1 + share[v])
        if v != s:
            score[v] += share[v]


ALGORITHMS = {"pagerank": pagerank, "betweenness": betweenness, "louvain": louvain, "label_propagation": label_propagation, "shortest_path": shortest_path, "dijkstra": dijkstra, "node_similarity": node_similarity, "connected_components": connected_components}


def top(result: DataFrame, column: str, k: int = 10) -> DataFrame:
    return result.orderBy(F.col(column).desc(), "id").limit(k)
