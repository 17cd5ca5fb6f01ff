"""Filling fixed-capacity containers with items (problem 8).

A grouping genetic algorithm on islands. Items are hashed into shards of about
``SHARD`` items. Each shard is first packed by best-fit decreasing; where that
needs no more bins than the sum of sizes demands, it is optimal and stays. The
other shards go to several islands, whose populations start from differently
disturbed packings. A crossover copies whole well-filled bins of one parent into
the other, drops the bins that hold the same items twice and best-fits the
displaced ones, largest first; a mutation empties the worst bins and best-fits
their items. After each epoch every island's best packing migrates to the next
island of its shard.

A shard's bins that are nearly full are final. The items of the others go on to
the next level, where they are hashed anew into as many shards as they need, so
that what one shard lacks another one has. The levels end with one shard, or
when a level lowers the number of open bins by less than ``GAIN``; shards never
grow, so no task ever holds much more than ``SHARD`` items.

Defined results: an item larger than the capacity fills bins of its own with
its leading full parts, and the remainder is packed like any other item; no
other item is split; items of size zero lie in some bin; repeated rows are
items of their own; an empty table gives no rows. The packing depends on the
data only, not on the number of tasks.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm import tokens
from tidegraph.plans.scratch import Scope, materialise

CAPACITY = 2048
SHARD = 4096
ISLANDS = 4
EPOCHS = 3
GENERATIONS = 6
POPULATION = 6
#: Bins with at most this share of room are final at once.
SPARE = 0.01
#: Share of the open bins that a level must save for another one to follow.
GAIN = 0.01


class Rooms:
    """Open bins by room; the smallest room that fits is found by one shift."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.at: dict[int, list[int]] = {}

    def add(self, bin_: int, room: int) -> None:
        self.at.setdefault(room, []).append(bin_)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        rest = self.mask >> size
        if not rest:
            return None
        room = size + (rest & -rest).bit_length() - 1
        stack = self.at[room]
        bin_ = stack.pop()
        if not stack:
            self.mask ^= 1 << room
        return bin_, room


def best_fit(bins: list[list[int]], order: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """``bins`` (changed in place) with the items of ``order`` put where the least room stays."""
    rooms = Rooms(capacity)
    for b, items in enumerate(bins):
        rooms.add(b, capacity - sum(sizes[i] for i in items))
    for i in order:
        found = rooms.take(sizes[i])
        if found is None:
            bins.append([i])
            rooms.add(len(bins) - 1, capacity - sizes[i])
        else:
            bins[found[0]].append(i)
            rooms.add(found[0], found[1] - sizes[i])
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> float:
    """Mean squared fill: fewer bins first, then fuller ones."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / len(bins)


def _fill(b: list[int], sizes: list[int]) -> int:
    return sum(sizes[i] for i in b)


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """``a`` with some of the fullest bins of ``b``."""
    ranked = sorted(b, key=lambda x: -_fill(x, sizes))
    given = [x for x in ranked[: max(1, len(ranked) // 2)] if rng.random() < 0.5] or ranked[:1]
    doubled = {i for x in given for i in x}
    kept, displaced = [], []
    for x in a:
        if doubled.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in doubled]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit([*kept, *map(list, given)], displaced, sizes, capacity)


def mutate(a: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    ranked = sorted(a, key=lambda x: _fill(x, sizes))
    n = max(2, len(a) // 20)
    emptied = [*range(min(n, len(a))), *(rng.randrange(len(a)) for _ in range(2))]
    loose = {i for b in set(emptied) for i in ranked[b]}
    kept = [list(x) for b, x in enumerate(ranked) if b not in set(emptied)]
    return best_fit(kept, sorted(loose, key=lambda i: -sizes[i]), sizes, capacity)


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins than this."""
    return max(1, math.ceil(sum(sizes) / capacity))


def evolve(sizes: list[int], capacity: int, elites: list[list[list[int]]], seed: str) -> tuple[list[list[int]], int]:
    """The best packing after some generations, and the crossovers made; ``elites`` come from other islands."""
    rng = random.Random(seed)
    least = least_bins(sizes, capacity)
    falling = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    pool, made, spread = [*elites], 0, 0.0 if not elites else 0.05
    while len(pool) < POPULATION:
        order = falling if not spread else sorted(falling, key=lambda i: -sizes[i] * (1 + rng.uniform(-spread, spread)))
        pool.append(best_fit([], order, sizes, capacity))
        spread += 0.05
    value = lambda p: (-len(p), fitness(p, sizes, capacity))
    pool.sort(key=value, reverse=True)
    for _ in range(GENERATIONS):
        if len(pool[0]) == least:
            break
        children = []
        for _ in range(POPULATION // 2):
            a, b = (pool[min(rng.randrange(len(pool)), rng.randrange(len(pool)))] for _ in range(2))
            children.append(mutate(crossover(a, b, sizes, capacity, rng), sizes, capacity, rng))
            made += 1
        pool = sorted([*pool, *children], key=value, reverse=True)[:POPULATION]
    return pool[0], made


def _as_bins(assigned: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(assigned):
        bins.setdefault(b, []).append(i)
    return list(bins.values())


def _as_list(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(bins):
        for i in items:
            out[i] = b
    return out


def _sorted(items: pd.DataFrame) -> pd.DataFrame:
    return items.sort_values(["size", "key", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)


_PACKING = "shard int, island int, assigned array<int>, bins int, fitness double, crossovers int"


def _packing(shard: int, island: int, best: list[list[int]], sizes: list[int], capacity: int, crossovers: int) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "island": [island], "assigned": [_as_list(best, len(sizes))], "bins": [len(best)], "fitness": [fitness(best, sizes, capacity)], "crossovers": [crossovers]})


def _first(capacity: int):
    """Best-fit decreasing; island -1 says that it can't be bettered, island -2 that it may be."""

    def run(items: pd.DataFrame) -> pd.DataFrame:
        sizes = _sorted(items)["size"].tolist()
        best = best_fit([], list(range(len(sizes))), sizes, capacity)
        return _packing(int(items["shard"].iat[0]), -1 if len(best) == least_bins(sizes, capacity) else -2, best, sizes, capacity, 0)

    return run


def _epoch(capacity: int, epoch: int, level: int):
    def run(items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        if items.empty:
            return pd.DataFrame({c.split()[0]: [] for c in _PACKING.split(", ")})
        items = _sorted(items)
        sizes = items["size"].tolist()
        shard, island = int(items["shard"].iat[0]), int(items["island"].iat[0])
        best, made = evolve(sizes, capacity, [_as_bins(list(a)) for a in elites["assigned"]], f"{level}.{shard}.{island}.{epoch}")
        return _packing(shard, (island + 1) % ISLANDS, best, sizes, capacity, made + int(elites["crossovers"].max() if len(elites) else 0))

    return run


def _settle(capacity: int, level: int):
    def run(items: pd.DataFrame, packings: pd.DataFrame) -> pd.DataFrame:
        items = _sorted(items)
        best = packings.sort_values(["bins", "fitness", "island"], ascending=[True, False, True]).iloc[0]
        items["bin"] = list(best["assigned"])
        items["container_id"] = f"{level}-{int(items['shard'].iat[0])}-" + items["bin"].astype(str)
        items["room"] = (capacity - items.groupby("bin")["size"].transform("sum")).astype("int32")
        return items[["key", "piece_no", "start", "size", "container_id", "room"]]

    return run


def best_packings(placed: DataFrame, capacity: int, level: int) -> DataFrame:
    """Candidate packings of the shards of ``placed`` (key, piece_no, start, size, shard); the islands work where the first one may be bettered."""
    first = materialise(placed.groupBy("shard").applyInPandas(_first(capacity), _PACKING), f"first-{level}")
    hard = first.where("island = -2").select("shard")
    if hard.isEmpty():
        return first
    on_islands = materialise(placed.join(hard, "shard").withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))), f"islands-{level}")
    elites = first.where("island = -2").withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    for epoch in range(EPOCHS):
        elites = on_islands.groupBy("shard", "island").cogroup(elites.groupBy("shard", "island")).applyInPandas(_epoch(capacity, epoch, level), _PACKING)
    return first.unionByName(materialise(elites, f"elites-{level}"))


def pack(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD) -> DataFrame:
    """(key, piece_no, start, size, container_id) of items (key, size)."""
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    kind = items.schema["key"].dataType.simpleString()
    size = F.greatest(F.col("size"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / capacity).cast("int")), lambda i: F.struct(i.alias("no"), (i * capacity).alias("at")))
    cut = items.select("key", F.col("size").cast("int").alias("size"), F.explode(parts).alias("p")).select(
        "key", F.col("p.no").alias("piece_no"), F.col("p.at").alias("start"), F.least(F.col("size") - F.col("p.at"), F.lit(capacity)).alias("size")
    )
    cut = materialise(cut, "items")
    result = cut.where(F.col("size") == capacity).select("*", F.concat_ws("-", F.lit("f"), F.coalesce(F.col("key").cast("string"), F.lit("")), "piece_no").alias("container_id"))
    left, n = cut.where(F.col("size") < capacity), cut.where(F.col("size") < capacity).count()
    out = f"key {kind}, piece_no int, start int, size int, container_id string, room int"
    level, open_bins = 0, None
    while n:
        shards = -(-n // shard_items)
        with Scope() as scope:
            placed = materialise(left.withColumn("shard", F.pmod(F.xxhash64("key", "piece_no", F.lit(level)), F.lit(shards)).cast("int")), f"shards-{level}")
            packings = best_packings(placed, capacity, level)
            settled = scope.keep(materialise(placed.groupBy("shard").cogroup(packings.groupBy("shard")).applyInPandas(_settle(capacity, level), out), f"packed-{level}"))
        roomy = F.col("room") > SPARE * capacity
        sums = settled.agg(F.count_distinct(F.when(roomy, F.col("container_id"))).alias("open"), F.count_distinct("container_id").alias("used"), F.count_if(roomy).alias("n")).first()
        if shards == 1 or (open_bins is not None and sums["used"] > open_bins * (1 - GAIN)):
            result = result.unionByName(settled.drop("room"))
            break
        result = result.unionByName(settled.where(~roomy).drop("room"))
        left, n, open_bins, level = settled.where(roomy).drop("room", "container_id"), sums["n"], sums["open"], level + 1
    return result


def pack_documents(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Containers of documents sized in tokens: (key, piece_no, start_token, n_tokens, container_id)."""
    ids = tokens.encode_corpus(docs.select(docs[key].alias("key"), docs[text].alias("text")), "key", "text", vocabulary)
    packed = pack(ids.select("key", F.size("ids").alias("size")), capacity)
    return packed.select(F.col("key").alias(key), "piece_no", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"), "container_id")


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, tokens held, fewest containers possible, share of room filled."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    n, t = F.count("*"), F.coalesce(F.sum("t"), F.lit(0))
    return per.agg(n.alias("containers"), t.alias("tokens"), F.ceil(t / capacity).alias("least"), F.max("t").alias("fullest"), (t / (n * capacity)).alias("filled"))
