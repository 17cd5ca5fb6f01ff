"""Entity resolution by string similarity: candidates, decisions, groups with a canonical name.

*Candidates.* Jaro-Winkler allows so much that no prefix or segment is sure to
be shared, so pairs of distinct names are compared block by block within the
tasks, as bits (``operators/alike.py``), and none at or above the threshold is
left out. For groups, only pairs of names that aren't linked yet need that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tidegraph.functions.text import entity_name, fuzzy_similarity, levenshtein_similarity
from tidegraph.operators import alike
from tidegraph.operators.algorithms import connected_components
from tidegraph.operators.unionfind import star_forest
from tidegraph.plans.scratch import materialise

#: Names in a block.
NAMES = 8192
#: Names that are compared with those beside them, and with a sample, before they are compared with all.
NEIGHBOURS, SAMPLES = 512, (2048, 8192)
#: Names asked whose best are searched in one task at a time, and known names that they are compared with at a time.
ASKED, KNOWN = 40_000, 32_768
#: Links whose groups are found within one task; more go over all tasks.
EDGES = 1_000_000


def candidates(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs (a, b), a < b, of distinct normalised names (id, name): all that :func:`decide` accepts."""
    return _pairs(names.select(entity_name(F.col("name")).alias("norm")).distinct(), _matching(threshold, 1e-9)).select("a", "b")


def _matching(threshold: float, slack: float = 0.0) -> alike.Rule:
    """What :func:`decide` accepts."""
    return alike.Rule(cosine=threshold, hybrid=threshold, fuzzy=threshold, slack=slack)


def _wanting(rule: alike.Rule, alone: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                p, q, xs, ys = (batch.column(c)[r].as_py() for c in ("x", "y", "xs", "ys"))
                x = alike.Block(xs)
                same = alone and p == q
                y = x if same else alike.Block(ys)
                for i, j, score in alike.wanted(x, y, same, rule):
                    pairs = [(x.names[a], y.names[b]) for a, b in zip(i.tolist(), j.tolist())]
                    pairs = [(min(v), max(v)) for v in pairs] if alone else pairs
                    yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in pairs], pa.string()), pa.array([v[1] for v in pairs], pa.string()), pa.array(score)], names=["a", "b", "score"])

    return run


def _pairs(names: DataFrame, rule: alike.Rule) -> DataFrame:
    """(a, b, score), a < b: all pairs of distinct names (norm) that the rule wants, found block by block within the tasks.

    Only blocks are shuffled, each as often as there are blocks; no pair is, before it
    is known to be wanted.
    """
    blocks, n = _named_blocks(names.where("norm <> ''"))
    x = blocks.select(F.col("block").alias("x"), F.col("names").alias("xs"), F.explode(F.sequence("block", F.lit(n - 1).cast("bigint"))).alias("y"))
    both = x.join(blocks.select(F.col("block").alias("y"), F.col("names").alias("ys")), "y")
    return both.repartition(min(n * (n + 1) // 2, 4096)).mapInArrow(_wanting(rule, True), "a string, b string, score double")


def _across(left: DataFrame, right: DataFrame, rule: alike.Rule) -> DataFrame:
    """(a, b, score): all pairs of distinct names (norm) of two tables that the rule wants."""
    (xs, m), (ys, n) = _named_blocks(left), _named_blocks(right)
    x = xs.select(F.col("block").alias("x"), F.col("names").alias("xs"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("y"))
    both = x.join(ys.select(F.col("block").alias("y"), F.col("names").alias("ys")), "y")
    return both.repartition(min(m * n, 4096)).mapInArrow(_wanting(rule, False), "a string, b string, score double")


_LINK = "src string, dst string"


def _linked_batches(xs: list[dict], ys: list[dict] | None, rule: alike.Rule) -> Iterator[pa.RecordBatch]:
    """(src, dst) that link the groups of names (norm, group) of two lists, or of one, which a match links."""
    x = alike.Block([v["norm"] for v in xs])
    y = x if ys is None else alike.Block([v["norm"] for v in ys])
    group = {v["norm"]: v["group"] for v in xs + (ys or [])}
    number: dict[str, int] = {}
    label = np.array([number.setdefault(group[s], len(number)) for s in x.names + ([] if ys is None else y.names)], np.int64)
    for i, j in alike.linking(x, y, ys is None, rule, label):
        yield pa.RecordBatch.from_arrays([pa.array([v.names[k] for k in at.tolist()], pa.string()) for v, at in ((x, i), (y, j))], names=["src", "dst"])


def _linking(rule: alike.Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                p, q, xs, ys = (batch.column(c)[r].as_py() for c in ("x", "y", "xs", "ys"))
                yield from _linked_batches(xs, None if p == q else ys, rule)

    return run


def _linking_neighbours(rule: alike.Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, NEIGHBOURS):
                yield from _linked_batches(batch.slice(at, NEIGHBOURS).to_pylist(), None, rule)

    return run


def _placed(names: DataFrame, n: int, first: int = 0) -> tuple[DataFrame, int]:
    """(block, names) of n names (norm, group), blocks counted from ``first`` on, and the number behind the last."""
    many = max(-(-n // NAMES), min(12, -(-n // 2000)), 1)
    block = F.pmod(F.xxhash64("norm"), F.lit(many)) + first
    return names.groupBy(block.alias("block")).agg(F.collect_list(F.struct("norm", "group")).alias("names")), first + many


def _crossed(xs: DataFrame, ys: DataFrame, first: Column, last: int, tasks: int, rule: alike.Rule) -> DataFrame:
    """(src, dst) that link groups, of blocks (block, names) with those numbered from ``first`` to ``last``."""
    x = xs.select(F.col("block").alias("x"), F.col("names").alias("xs"), F.explode(F.sequence(first.cast("bigint"), F.lit(last).cast("bigint"))).alias("y"))
    pairs = x.join(ys.select(F.col("block").alias("y"), F.col("names").alias("ys")), "y")
    return pairs.repartition(min(tasks, 4096)).mapInArrow(_linking(rule), _LINK)


def linked(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(norm, group): distinct names (norm) in groups linked by what :func:`decide` accepts, directly or through others; an empty name links nothing.

    Within a group nothing is left to compare. So names that stand together in
    alphabetical order are linked first, which Jaro-Winkler likes best, then all names
    with a sample, so that most come into one group. Names outside the largest group
    are then compared with each other, and those left with all that were in it: every
    pair of two groups has been looked at.
    """
    rule = _matching(threshold)
    groups = materialise(names.where("norm IS NOT NULL").select("norm", F.col("norm").alias("group")), "groups")
    n = groups.count()

    def joined(links: DataFrame) -> DataFrame:
        edges = materialise(links, "links").unionByName(groups.where("norm <> `group`").select(F.col("norm").alias("src"), F.col("group").alias("dst")))
        if edges.count() <= EDGES:
            stars = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).coalesce(1).mapInArrow(star_forest(EDGES), "u string, v string")
        else:
            stars = connected_components(edges).select(F.col("id").alias("u"), F.col("component").alias("v"))
        return materialise(groups.select("norm").join(stars.withColumnRenamed("u", "norm"), "norm", "left").select("norm", F.coalesce("v", "norm").alias("group")), "groups")

    def outside(most: str) -> tuple[DataFrame, int]:
        out = groups.where((F.col("group") != most) & (F.col("norm") != ""))
        return out, out.count()

    def compared(xs: DataFrame, m: int, ys: DataFrame, k: int) -> DataFrame:
        xs, r = _placed(xs, m)
        ys, last = _placed(ys, k, r)  # numbers of their own: equal ones stand for the same block
        return joined(_crossed(xs, ys, F.lit(r), last - 1, r * (last - r), rule))

    if n > NEIGHBOURS:
        neighbours = groups.where("norm <> ''").repartitionByRange(max(12, -(-n // NAMES)), "norm").sortWithinPartitions("norm")
        groups = joined(neighbours.mapInArrow(_linking_neighbours(rule), _LINK))
    rest, m, known, most = groups.where("norm <> ''"), n, groups, None
    for size in SAMPLES:
        if 4 * size < m:
            sample = known.where("norm <> ''").orderBy(F.xxhash64("norm", F.lit(1))).limit(size)
            groups = compared(sample, size, rest, m)
            (most,) = groups.groupBy("group").count().orderBy(F.col("count").desc(), "group").select("group").first()
            known = groups.where((F.col("group") == most) & (F.col("norm") != ""))
            rest, m = outside(most)
    xs, r = _placed(rest, m)
    groups = joined(_crossed(xs, xs, F.col("block"), r - 1, r * (r + 1) // 2, rule))
    if most is None:
        return groups
    k, part = known.count(), F.pmod(F.xxhash64("norm", F.lit(2)), F.lit(8))
    for some, share in ((part == 0, 1), (part > 0, 7)):
        (most,) = groups.where(F.col("norm") == most).select("group").first()  # a group's name is one of its members
        rest, m = outside(most)
        groups = compared(rest, m, known.where(some).select("norm", F.lit(most).alias("group")), k * share // 8)
    return groups


def _named_blocks(names: DataFrame) -> tuple[DataFrame, int]:
    """(block, names) of distinct names (norm), and the number of blocks: at least eight where there are names for them."""
    names = materialise(names, "names")
    n = names.count()
    many = max(-(-n // NAMES), min(8, -(-n // 250)), 1)
    return names.groupBy(F.pmod(F.xxhash64("norm"), F.lit(many)).alias("block")).agg(F.collect_list("norm").alias("names")), many


def _grams(s: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for j in range(len(s) - 2):
        out[s[j : j + 3]] = out.get(s[j : j + 3], 0) + 1
    return out


def _cosine(a: str, b: str) -> float:
    x, y = _grams(a), _grams(b)
    if a == b or not x or not y:
        return float(a == b)
    norm = lambda v: sum(n * n for n in v.values()) ** 0.5
    return sum(n * y.get(g, 0) for g, n in x.items()) / (norm(x) * norm(y))


@pandas_udf(DoubleType())
def trigram_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """As ``functions.text.ngram_cosine``, which takes milliseconds a pair."""
    return pd.Series([_cosine(x, y) for x, y in zip(a, b)], dtype="float64")


def hybrid(a: str, b: str, grams: str, weight: float = 0.6):
    """The weighted similarity of two columns whose trigram cosine is in a third."""
    return weight * levenshtein_similarity(F.col(a), F.col(b)) + (1 - weight) * F.col(grams)


def decide(pairs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs (a, b) of normalised names that match, with score and method."""
    h = pairs.withColumn("grams", trigram_cosine("a", "b")).withColumn("hybrid", hybrid("a", "b", "grams"))
    s = h.withColumn("fuzzy", F.when(F.col("hybrid") >= threshold, F.lit(0.0)).otherwise(fuzzy_similarity("a", "b")))
    method = F.when(F.col("a") == F.col("b"), "exact").when(F.col("hybrid") >= threshold, "hybrid").when(F.col("fuzzy") >= F.col("grams"), "fuzzy").otherwise("embedding")
    score = F.when(F.col("hybrid") >= threshold, F.col("hybrid")).otherwise(F.greatest("fuzzy", "grams"))
    return s.select("a", "b", score.alias("score"), method.alias("method")).where(F.col("score") >= threshold)


def close_by_edits(names: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b, score): all pairs of distinct names (norm) whose Levenshtein similarity is ``least`` or more; thresholds below 0.84 are refused."""
    if not least <= 1 or any(size // 3 <= int(size * (1 - least) / least + 1e-9) for size in range(3, 300)):
        raise ValueError("names can't be cut into enough trigrams for this similarity")
    return _pairs(names, alike.Rule(edits=least))


def close_by_trigrams(names: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, score): all pairs of distinct names (norm) whose trigram cosine is ``least`` or more."""
    return _pairs(names, alike.Rule(cosine=least))


def close_by_either(names: DataFrame, edits: float = 0.85, cosine: float = 0.8) -> DataFrame:
    """(a, b): all pairs of distinct names (norm) that are close by Levenshtein or by trigrams."""
    return _pairs(names, alike.Rule(edits=edits, cosine=cosine)).select("a", "b")


def hybrid_pairs(names: DataFrame, least: float = 0.85, weight: float = 0.6) -> DataFrame:
    """(a, b, score): all pairs of distinct names (norm) whose weighted Levenshtein and trigram similarity is ``least`` or more."""
    return _pairs(names, alike.Rule(hybrid=least, weight=weight))


def resolve(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, name, group, canonical): names linked directly or through others; the canonical one is the longest, the first on a tie."""
    n = names.select("id", "name", entity_name(F.col("name")).alias("norm")).where("norm IS NOT NULL")
    g = n.join(linked(n.select("norm").distinct(), threshold), "norm")
    best = g.groupBy("group").agg(F.min(F.struct(-F.length("name"), "id", "name")).alias("m"))
    return g.join(best, "group").select("id", "name", "group", F.col("m.name").alias("canonical"))


def _best_of(known: str, most: int, threshold: float, many_asked: int, many_known: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        for asked in _gathered((b.column("norm").to_pylist() for b in batches), many_asked):
            best = alike.Best(asked, most, threshold)
            for block in _gathered((list(zip(b.column("norm").to_pylist(), b.column("mark").to_pylist())) for b in ds.dataset(known, format="parquet").to_batches()), many_known):
                best.meet(*map(list, zip(*block)))
            qn, vn, score = best.result()
            yield pa.RecordBatch.from_arrays([pa.array(qn, pa.string()), pa.array(vn, pa.string()), pa.array(score, pa.float64())], names=["qn", "vn", "score"])

    return run


def _gathered(lists: Iterator[list], size: int) -> Iterator[list]:
    held: list = []
    for x in lists:
        held += x
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


def _best_pairs(qn: DataFrame, v: DataFrame, threshold: float, most: int) -> DataFrame:
    """(qn, vn, score) of the ``most`` best names (norm) for each name asked: by score, then by the first name that stands for it."""
    known = materialise(v.groupBy("norm").agg(F.min("name").alias("mark")), "known")
    asked = materialise(qn, "asked")
    tasks = -(-max(asked.count(), 1) // ASKED // 12) * 12
    return asked.repartition(min(tasks, 4096)).mapInArrow(_best_of(known._scratch_path, most, threshold, ASKED, KNOWN), "qn string, vn string, score double")


def best_matches(asked: DataFrame, vocabulary: DataFrame, threshold: float = 0.7, most: int | None = None) -> DataFrame:
    """(query, name, score, method, rank) of vocabulary (name) entries that reach the threshold for a query (name), best first; with ``most`` only so many."""
    q = asked.select(F.col("name").alias("query"), entity_name(F.col("name")).alias("norm")).where("norm <> ''").distinct()
    v = vocabulary.select("name", entity_name(F.col("name")).alias("norm")).where("norm <> ''").distinct()
    qn, vn = q.select("norm").distinct(), v.select("norm").distinct()
    method = F.when(F.col("qn") == F.col("vn"), "exact").otherwise("hybrid").alias("method")
    if most is not None and threshold > 0.6:
        close = _best_pairs(qn, v, threshold, most).select("qn", "vn", "score", method)
        v = v.withColumn("nth", F.row_number().over(Window.partitionBy("norm").orderBy("name"))).where(F.col("nth") <= most).drop("nth")
    else:
        pairs = _across(qn, vn, alike.Rule(hybrid=threshold - 1e-6)).select(F.col("a").alias("qn"), F.col("b").alias("vn"))  # scores are rounded below
        equal = qn.join(vn, "norm").select(F.col("norm").alias("qn"), F.col("norm").alias("vn"))  # equal names too short for trigrams
        pairs = materialise(pairs.unionByName(equal).distinct(), "candidates")
        score = F.when(F.col("qn") == F.col("vn"), F.lit(1.0)).otherwise(hybrid("qn", "vn", "grams"))
        close = pairs.withColumn("grams", trigram_cosine("qn", "vn")).select("qn", "vn", F.round(score, 6).alias("score"), method).where(F.col("score") >= threshold)
    out = close.join(q.withColumnRenamed("norm", "qn"), "qn").join(v.withColumnRenamed("norm", "vn"), "vn").select("query", "name", "score", "method")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "name")))
    return out if most is None else out.where(F.col("rank") <= most)
