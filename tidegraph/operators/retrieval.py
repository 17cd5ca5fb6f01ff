"""Retrieval: BM25, fusion of rankings, re-ranking, measures, and the entity graph of chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidegraph.functions.text import words
from tidegraph.plans.scratch import materialise

K1, B = 1.5, 0.75


def _ranked(df: DataFrame, k: int | None, score: str = "score") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "id")
    out = df.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


#: Query words that may be written into a plan; more are joined.
MAX_TERMS = 10_000


@dataclass(frozen=True)
class Occurrences:
    """What one scan of the documents keeps for the queries: (id, dl, term, tf) of their query words, and two sums."""

    rows: DataFrame
    terms: DataFrame  #: (query_id, term, qn)
    documents: int
    mean: float


def occurrences(docs: DataFrame, queries: DataFrame) -> Occurrences:
    """Query words in docs (id, text) for queries (query_id, text), read in one scan; lengths are observed on the way."""
    spark = docs.sparkSession
    q = queries.select("query_id", F.explode(words("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    asked = q.limit(MAX_TERMS + 1).collect()
    seen = Observation()
    split = docs.select("id", words("text").alias("w")).where("w IS NOT NULL").observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.size("w")).alias("total"))
    if len(asked) <= MAX_TERMS:
        q, few = spark.createDataFrame(asked, q.schema), sorted({r["term"] for r in asked})
        held = split.select("id", F.size("w").alias("dl"), F.filter("w", lambda w: w.isin(few) if few else F.lit(False)).alias("hits")).where(F.size("hits") > 0)
        each = F.transform(F.array_distinct("hits"), lambda t: F.struct(t.alias("term"), F.size(F.filter("hits", lambda x: x == t)).alias("tf")))
        hits = held.select("id", "dl", F.inline(each))
    else:
        q = materialise(q, "query-terms")
        each = split.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
        hits = each.groupBy("id", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
    rows = materialise(hits, "occurrences")
    n = seen.get["n"]
    return Occurrences(rows, q, n, max((seen.get["total"] or 0) / n if n else 0.0, 1.0))


def bm25(docs: DataFrame | None, queries: DataFrame | None, top_k: int | None = 10, found: Occurrences | None = None) -> DataFrame:
    """(query_id, id, score, rank) of docs (id, text) for queries (query_id, text), or of what a scan ``found``.

    Scores are divided by the query's best; documents without a query word have no
    row. A word that stands twice in the query counts twice.
    """
    o = found or occurrences(docs, queries)
    df = o.rows.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(o.documents) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / o.mean))
    raw = o.rows.join(df.join(o.terms, "term"), "term").groupBy("query_id", "id").agg(F.sum(F.col("qn") * weight).alias("raw")).where("raw > 0")
    best = raw.groupBy("query_id").agg(F.max("raw").alias("best"))
    return _ranked(raw.join(best, "query_id").select("query_id", "id", (F.col("raw") / F.col("best")).alias("score")), top_k)


def density(found: Occurrences, top_k: int | None = 10) -> DataFrame:
    """(query_id, id, score, rank): share of a document's words that are words of the query."""
    hit = found.rows.join(found.terms.select("query_id", "term"), "term")
    return _ranked(hit.groupBy("query_id", "id").agg((F.sum("tf") / F.max("dl")).alias("score")), top_k)


def fuse(*lists: DataFrame, k: int = 60, top_k: int | None = 10) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, id, score, rank) lists; ``raw`` is the better of an item's scores."""
    parts = [x.select("query_id", "id", "score", (1 / (k + F.col("rank"))).alias("share")) for x in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    fused = out.groupBy("query_id", "id").agg(F.round(F.sum("share"), 6).alias("score"), F.max("score").alias("raw"))
    return _ranked(fused, top_k)


def hybrid(semantic: Callable[[int], DataFrame] | None, keyword: Callable[[int], DataFrame] | None, top_k: int = 10, default_k: int = 10, rerank: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Both retrievers at three times the size, fused to twice it, re-ranked to ``top_k``."""
    k = top_k or default_k
    if semantic and keyword:
        found = fuse(semantic(3 * k), keyword(3 * k), top_k=2 * k)
    elif semantic or keyword:
        found = (semantic or keyword)(2 * k)
    else:
        raise ValueError("no retriever")
    return rerank(found, k) if rerank else found.where(F.col("rank") <= k)


def boost(found: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k``, their scores raised by a tenth and lowered by half their place among all candidates."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    placed = found.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", n).where(F.col("_i") < k)
    new = F.least(F.lit(1.0), F.col("score") * 1.1 * (1 - 0.5 * F.col("_i") / F.col("_n")))
    return _ranked(placed.withColumn("score", new).drop("_i", "_n", "rank"), k)


def rescore(found: DataFrame, scorer: Callable, text: str, query: str, k: int = 10, fallback: Callable[[DataFrame, int], DataFrame] = boost) -> DataFrame:
    """Scores of a model (a vectorised function of query and text columns), spread to 0..1 per query; without one, ``fallback``."""
    if scorer is None:
        return fallback(found, k)
    w = Window.partitionBy("query_id")
    s = found.withColumn("_s", scorer(F.col(query), F.col(text)))
    low, high = F.min("_s").over(w), F.max("_s").over(w)
    return _ranked(s.withColumn("score", F.when(high == low, F.lit(1.0)).otherwise((F.col("_s") - low) / (high - low))).drop("_s", "rank"), k)


def measures(found: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, precision, recall, f1, mrr) of found (query_id, id, rank) against relevant (query_id, id)."""
    hit = found.join(relevant.select("query_id", "id", F.lit(1).alias("rel")).distinct(), ["query_id", "id"], "left")
    got = hit.groupBy("query_id").agg(F.countDistinct("id").alias("n"), F.count("rel").alias("h"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    want = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("r"))
    j = want.join(got, "query_id", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    p = F.when(zero("n") > 0, zero("h") / F.col("n")).otherwise(0.0)
    r = F.when(zero("r") > 0, zero("h") / F.col("r")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return j.select("query_id", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr"))


def mean_measures(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    cols = ["precision", "recall", "f1", "mrr"]
    return scored.groupBy(*(by or [])).agg(*[F.round(F.avg(c), 4).alias(c) for c in cols], F.count("*").alias("queries"))


def field_index(df: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """(index, id, text): one searchable text per row."""
    return df.select(F.lit(name).alias("index"), df[key].cast("string").alias("id"), F.concat_ws(" ", *fields).alias("text"))


def multi_index(indexes: list[DataFrame], queries: DataFrame, per_index: int = 10, limit: int = 30) -> DataFrame:
    """BM25 in every index, the best of each kept, then the best of all by score."""
    parts = [bm25(i.select("id", "text"), queries, per_index).withColumn("index", F.lit(n)) for n, i in enumerate(indexes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _ranked(out.drop("rank"), limit)


# Kinds of maritime entities and their patterns, in the order in which they claim text.
ENTITY_PATTERNS = {
    "Vessel": [r"([가-힣]{2,}함)", r"([가-힣]{2,}호)", r"(VLCC|LNG선|컨테이너선|유조선|벌크선)"],
    "Port": [r"(?<!입)(?<!출)(?<!기)(?<!반)([가-힣]{2,}항)", r"([가-힣]{2,}포구)"],
    "Organization": [r"(KRISO|한국해양과학기술원|IMO|해양수산부|선급)", r"([가-힣]{2,}연구[소원])"],
    "Regulation": [r"(IMO\s*규정\s*[A-Z]?\.\d+)", r"(SOLAS|MARPOL|COLREG)", r"([가-힣]*안전법[가-힣]*)"],
    "SeaArea": [r"([가-힣]{2,}해협)", r"([가-힣]{2,}해)", r"([가-힣]{2,}만)"],
}
_COMPILED = [(kind, re.compile(p)) for kind, ps in ENTITY_PATTERNS.items() for p in ps]
CONTEXT = 20


def entities_of(text: str) -> list[dict]:
    """Entities of a text: the first pattern claims its span, names count once."""
    taken: list[tuple[int, int]] = []
    seen: set[str] = set()
    out = []
    for kind, rx in _COMPILED:
        for m in rx.finditer(text):
            name, span = m[1], m.span(1)
            if len(name) < 2 or any(span[0] < e and s < span[1] for s, e in taken):
                continue
            taken.append(span)
            if name not in seen:
                seen.add(name)
                out.append({"name": name, "kind": kind, "context": text[max(0, span[0] - CONTEXT) : span[1] + CONTEXT]})
    return out


def extract_entities(chunks: DataFrame) -> DataFrame:
    """(id, name, kind, context) of chunks (id, text)."""
    schema = f"id {chunks.schema['id'].dataType.simpleString()}, name string, kind string, context string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, e["name"], e["kind"], e["context"]) for i, t in zip(f["id"], f["text"]) if t for e in entities_of(t)]
            yield pd.DataFrame(rows, columns=["id", "name", "kind", "context"])

    return chunks.select("id", "text").mapInPandas(run, schema)


def co_occurrences(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(id, a, b): entities of a chunk that stand in one sentence, each pair once per sentence."""
    sentences = chunks.select("id", F.posexplode(F.split("text", "[.!?\n]")).alias("no", "sentence"))
    within = sentences.join(found.select("id", "name"), "id").where(F.col("sentence").contains(F.col("name"))).select("id", "no", "name").distinct()
    a, b = within.alias("a"), within.alias("b")
    return a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.no") == F.col("b.no")) & (F.col("a.name") < F.col("b.name"))).select(F.col("a.id").alias("id"), F.col("a.name").alias("a"), F.col("b.name").alias("b"))


def by_entities(asked: DataFrame, found: DataFrame, links: DataFrame, top_k: int = 10) -> DataFrame:
    """Chunks for queries' entities (query_id, name): 1 per entity in the chunk, 0.5 per link that touches one, over the best."""
    direct = found.select("id", "name").distinct().join(asked, "name").select("query_id", "id", F.lit(1.0).alias("s"))
    ends = links.select("id", F.col("a").alias("name"), F.struct("a", "b").alias("l")).unionByName(links.select("id", F.col("b").alias("name"), F.struct("a", "b").alias("l")))
    linked = ends.join(asked, "name").select("query_id", "id", "l").distinct().select("query_id", "id", F.lit(0.5).alias("s"))
    return _scaled(direct.unionByName(linked), top_k)


def by_kinds(asked: DataFrame, found: DataFrame, top_k: int = 10) -> DataFrame:
    """Chunks for queries' kinds (query_id, kind): 0.3 per entity of such a kind, over the best."""
    return _scaled(found.join(asked, "kind").select("query_id", "id", F.lit(0.3).alias("s")), top_k)


def _scaled(parts: DataFrame, top_k: int) -> DataFrame:
    total = parts.groupBy("query_id", "id").agg(F.sum("s").alias("s"))
    best = total.groupBy("query_id").agg(F.max("s").alias("best"))
    return _ranked(total.join(best, "query_id").select("query_id", "id", F.round(F.col("s") / F.col("best"), 9).alias("score")), top_k)


def dual(asked_names: DataFrame, asked_kinds: DataFrame, found: DataFrame, links: DataFrame, top_k: int = 10) -> DataFrame:
    """Both ways of asking the entity graph, fused and scaled to the best."""
    f = fuse(by_entities(asked_names, found, links, 2 * top_k), by_kinds(asked_kinds, found, 2 * top_k), top_k=top_k)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return f.withColumn("score", F.col("score") / best)


def entity_graph(found: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, kind, chunks) and edges (a, b, weight)."""
    return found.groupBy("name", "kind").agg(F.countDistinct("id").alias("chunks")), links.groupBy("a", "b").agg(F.count("*").alias("weight"))
