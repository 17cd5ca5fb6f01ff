"""Graph algorithms over the knowledge graph's edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import algorithms as A
from tidegraph.operators import traverse
from tidegraph.plans.graph import knowledge_graph

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


MATCH = "edge_type IN ('SAME_AS', 'ALIAS_OF')"


def _links(spark: SparkSession, d: str) -> DataFrame:
    _, e = knowledge_graph(spark, d)
    return e


def _match(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).where(F.col("type").isin("SAME_AS", "ALIAS_OF"))


def _pagerank_sql(rounds: int) -> str:
    parts = [
        "p AS (SELECT source_id AS a, target_id AS b, count(*) AS n FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1, 2)",
        "s AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS share FROM p)",
        "v AS (SELECT a AS id FROM p UNION SELECT b FROM p)",
        "r0 AS (SELECT id, 1.0::DOUBLE AS score FROM v)",
    ]
    for i in range(1, rounds + 1):
        parts.append(f"r{i} AS (SELECT v.id, 0.15 + 0.85 * coalesce(sum(score * share), 0) AS score FROM v LEFT JOIN s ON s.b = v.id LEFT JOIN r{i - 1} q ON q.id = s.a GROUP BY 1)")
    return f"WITH {', '.join(parts)} SELECT id, round(score + 1e-9, 6) AS score FROM r{rounds}"


@query(_pagerank_sql(5))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return A.pagerank(_links(spark, d), iterations=5).select("id", F.round(F.col("score") + 1e-9, 6).alias("score"))


@query()
def pagerank_top(spark: SparkSession, d: str) -> DataFrame:
    return A.top(A.pagerank(_links(spark, d)), "score").select("id", F.round("score", 6).alias("score"))


def _lpa_sql(rounds: int) -> str:
    parts = [
        f"e AS (SELECT source_id AS a, target_id AS b FROM graph_edges WHERE {MATCH} AND source_id IS NOT NULL AND target_id IS NOT NULL)",
        "w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e WHERE a <> b)",
        "l0 AS (SELECT DISTINCT a AS id, a AS community FROM w)",
    ]
    for i in range(1, rounds + 1):
        parts.append(f"l{i} AS (SELECT a AS id, community FROM (SELECT a, community, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, community) AS r FROM w JOIN l{i - 1} q ON q.id = w.b GROUP BY a, community) WHERE r = 1)")
    return f"WITH {', '.join(parts)} SELECT id, community FROM l{rounds}"


@query(_lpa_sql(4))
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return A.label_propagation(_match(spark, d), iterations=4)


@query()
def label_propagation_full(spark: SparkSession, d: str) -> DataFrame:
    return A.label_propagation(_match(spark, d))


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM graph_edges WHERE {MATCH} AND source_id IS NOT NULL AND target_id IS NOT NULL),
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, b FROM w UNION SELECT r.a, w.b FROM r JOIN w ON r.b = w.a)
SELECT a AS id, least(a, min(b)) AS component FROM r GROUP BY a"""
)
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return A.connected_components(_match(spark, d))


@query(
    "WITH e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL), n AS (SELECT a, count(*) AS n FROM e GROUP BY 1), c AS (SELECT x.a AS node1, y.a AS node2, count(*) AS c FROM e x JOIN e y ON x.b = y.b AND x.a <> y.a GROUP BY 1, 2) "
    "SELECT node1, node2, round(similarity, 6) AS similarity FROM (SELECT node1, node2, c / (p.n + q.n - c) AS similarity, row_number() OVER (PARTITION BY node1 ORDER BY c / (p.n + q.n - c) DESC, node2) AS r FROM c JOIN n p ON p.a = node1 JOIN n q ON q.a = node2 WHERE c / (p.n + q.n - c) >= 0.5) WHERE r <= 10"
)
def node_similarity(spark: SparkSession, d: str) -> DataFrame:
    return A.node_similarity(_links(spark, d)).select("node1", "node2", F.round("similarity", 6).alias("similarity"))


def _far(e: DataFrame) -> tuple[str, str]:
    """The busiest source and one of the vertices farthest from it within four hops."""
    src = e.where("src IS NOT NULL").groupBy("src").count().orderBy(F.col("count").desc(), "src").first()[0]
    start = e.sparkSession.createDataFrame([(src,)], "id string")
    far = traverse.reach(e, start, "both", 4).orderBy(F.col("depth").desc(), "id").first()
    return src, far["id"]


@query()
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    e = _match(spark, d)
    return A.shortest_path(e, *_far(e), direction="both")


@query()
def dijkstra_path(spark: SparkSession, d: str) -> DataFrame:
    e = _match(spark, d).withColumn("weight", 1 + F.pmod(F.xxhash64("edge_id"), F.lit(9)).cast("double"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return A.dijkstra(e.select("src", "dst", "weight").unionByName(back), *_far(e))


@query()
def louvain_communities(spark: SparkSession, d: str) -> DataFrame:
    return A.louvain(_match(spark, d))


@query()
def betweenness_centrality(spark: SparkSession, d: str) -> DataFrame:
    return A.top(A.betweenness(_match(spark, d)), "score").select("id", F.round("score", 6).alias("score"))


HUB = "(SELECT id FROM (SELECT source_id AS id, count(*) AS n FROM graph_edges WHERE source_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, id LIMIT 1))"


@query(
    f"WITH RECURSIVE e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL), r(id) AS (SELECT b FROM e WHERE a IN (SELECT id FROM {HUB}) UNION SELECT b FROM r JOIN e ON r.id = e.a) SELECT id FROM r WHERE id NOT IN (SELECT id FROM {HUB})"
)
def descendants(spark: SparkSession, d: str) -> DataFrame:
    e = _links(spark, d)
    hub = e.where("src IS NOT NULL").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "id").limit(1).select("id")
    return traverse.reach(e, hub).select("id")
