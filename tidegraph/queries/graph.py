"""Structured queries, joins, traversals, time, space and access over the trade and knowledge graphs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.operators import access, spatial, temporal, traverse
from tidegraph.plans.compile import compile_query, order
from tidegraph.plans.graph import knowledge_graph, trade_graph
from tidegraph.plans.ir import Filter, Query, Sort, after, decode_cursor, encode_cursor

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def ask(name: str, q: Query, sql: str) -> None:
    """Register a structured query over the trade graph."""
    built = q.build()
    QUERIES[name] = lambda spark, d: compile_query(trade_graph(spark, d), built)
    ORACLES[name] = sql


# Scans, projections, predicates ---------------------------------------------------------------------

CUSTOMER = "'Customer:' || c_custkey AS n_id, c_custkey AS n_c_custkey, c_name AS n_c_name, c_nationkey AS n_c_nationkey, c_acctbal AS n_c_acctbal, c_mktsegment AS n_c_mktsegment"
ask("scan_label", Query("Region"), "SELECT 'Region:' || r_regionkey AS n_id, r_regionkey AS n_r_regionkey, r_name AS n_r_name FROM region")
ask("project_properties", Query("Part").select("p_name", "p_size"), "SELECT p_name AS n_p_name, p_size AS n_p_size FROM part")
ask("filter_equal", Query("Customer").where("c_mktsegment", "=", "BUILDING"), f"SELECT {CUSTOMER} FROM customer WHERE c_mktsegment = 'BUILDING'")
ask("filter_not_equal", Query("Customer").where("c_mktsegment", "neq", "BUILDING"), f"SELECT {CUSTOMER} FROM customer WHERE c_mktsegment <> 'BUILDING'")
ask("filter_contains", Query("Part").where("p_name", "contains", "red").select("id", "p_name"), "SELECT 'Part:' || p_partkey AS n_id, p_name AS n_p_name FROM part WHERE contains(p_name, 'red')")
ask("filter_starts_with", Query("Part").where("p_name", "starts_with", "small").select("id"), "SELECT 'Part:' || p_partkey AS n_id FROM part WHERE starts_with(p_name, 'small')")
ask("filter_ends_with", Query("Part").where("p_name", "ends_with", "ring").select("id"), "SELECT 'Part:' || p_partkey AS n_id FROM part WHERE ends_with(p_name, 'ring')")
ask("filter_range", Query("Customer").where("c_acctbal", "gte", 100.0).where("c_acctbal", "<", 2000.0).select("id", "c_acctbal"), "SELECT 'Customer:' || c_custkey AS n_id, c_acctbal AS n_c_acctbal FROM customer WHERE c_acctbal >= 100 AND c_acctbal < 2000")
ask("filter_in", Query("Order").where("o_orderstatus", "in_list", ["F", "P"]).count(), "SELECT count(*) AS count FROM orders WHERE o_orderstatus IN ('F', 'P')")
ask("filter_not_in", Query("Order").where("o_orderstatus", "not_in", ["F", "P"]).count(), "SELECT count(*) AS count FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
ask("filter_null", Query("Order").where("o_totalprice", "is_null").count(), "SELECT count(*) AS count FROM orders WHERE o_totalprice IS NULL")
ask("filter_not_null", Query("Order").where("o_totalprice", "is_not_null").count(), "SELECT count(*) AS count FROM orders WHERE o_totalprice IS NOT NULL")
ask("filter_regex_whole", Query("Part").where("p_brand", "matches_regex", "Brand#1[0-9]").select("id", "p_brand"), "SELECT 'Part:' || p_partkey AS n_id, p_brand AS n_p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#1[0-9]')")
ask("filter_null_safe", Query("Order").where("o_orderstatus", "same", None).count(), "SELECT count(*) AS count FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM NULL")


@query("SELECT id, label FROM (SELECT 'Region:' || r_regionkey AS id, 'Region' AS label FROM region UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation' FROM nation UNION ALL SELECT 'Customer:' || c_custkey, 'Customer' FROM customer UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier' FROM supplier UNION ALL SELECT 'Part:' || p_partkey, 'Part' FROM part UNION ALL SELECT 'Order:' || o_orderkey, 'Order' FROM orders)")
def scan_all_vertices(spark: SparkSession, d: str) -> DataFrame:
    return trade_graph(spark, d).all_vertices()


@query("SELECT label, count(*) AS vertices FROM (SELECT labels[1] AS label FROM (SELECT DISTINCT node_id, labels, props, created_at, deleted_at FROM graph_nodes)) GROUP BY 1")
def count_by_first_label(spark: SparkSession, d: str) -> DataFrame:
    n, _ = knowledge_graph(spark, d)
    return n.groupBy(F.get("labels", F.lit(0)).alias("label")).agg(F.count("*").alias("vertices"))


@query("SELECT edge_type AS type, count(*) AS edges, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets FROM graph_edges GROUP BY 1")
def edge_type_profile(spark: SparkSession, d: str) -> DataFrame:
    _, e = knowledge_graph(spark, d)
    return e.groupBy("type").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("SELECT node_id, deleted_at FROM (SELECT DISTINCT node_id, labels, props, created_at, deleted_at FROM graph_nodes) WHERE list_contains(labels, 'Vessel') AND NOT list_contains(labels, 'Tanker')")
def label_negation(spark: SparkSession, d: str) -> DataFrame:
    n, _ = knowledge_graph(spark, d)
    return n.where(F.array_contains("labels", "Vessel") & ~F.array_contains("labels", "Tanker")).select(F.col("id").alias("node_id"), "deleted_at")


@query("SELECT node_id, json_extract_string(props, '$.name') AS name FROM (SELECT DISTINCT node_id, labels, props, created_at, deleted_at FROM graph_nodes)")
def nested_property(spark: SparkSession, d: str) -> DataFrame:
    n, _ = knowledge_graph(spark, d)
    return n.select(F.col("id").alias("node_id"), F.get_json_object("props", "$.name").alias("name"))


@query("SELECT node_id FROM (SELECT DISTINCT node_id, labels, props, created_at, deleted_at FROM graph_nodes) WHERE contains(json_extract_string(props, '$.name'), 'MV') OR contains(json_extract_string(props, '$.title'), 'MV')")
def search_fields(spark: SparkSession, d: str) -> DataFrame:
    n, _ = knowledge_graph(spark, d)
    hit = F.lit(False)
    for f in ("name", "title", "nameEn", "description"):
        hit = hit | F.coalesce(F.get_json_object("props", f"$.{f}").contains("MV"), F.lit(False))
    return n.where(hit).select(F.col("id").alias("node_id"))


@query("SELECT c_custkey, 'Dear ' || c_name || ', segment ' || coalesce(c_mktsegment, 'None') AS text FROM customer")
def template_text(spark: SparkSession, d: str) -> DataFrame:
    from tidegraph.operators.workflow import template

    return template(spark.read.parquet(f"{d}/customer.parquet"), "Dear {{c_name}}, segment {{c_mktsegment}}", "text").select("c_custkey", "text")


# Hops and joins -------------------------------------------------------------------------------------

ask(
    "hop_outgoing",
    Query("Customer").where("c_acctbal", ">", 9000.0).hop("IN_NATION", "Nation").select("n.c_name", "h1.n_name"),
    "SELECT c_name AS n_c_name, n_name AS h1_n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000",
)
ask(
    "hop_incoming",
    Query("Nation").hop("IN_NATION", "Supplier", "incoming").select("n.n_name", "h1.s_name"),
    "SELECT n_name AS n_n_name, s_name AS h1_s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey",
)
ask(
    "chain_three_hops",
    Query("Customer").hop("PLACED", "Order").hop("SUPPLIED_BY", "Supplier").hop("IN_NATION", "Nation").group_by("h3.n_name").agg("count", "*", "links"),
    "SELECT n_name AS h3_n_name, count(*) AS links FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1",
)
ask(
    "star_from_base",
    Query("Order").star().hop("CONTAINS", "Part", filters=(Filter("p_size", "<", 5),)).hop("SUPPLIED_BY", "Supplier").group_by("h2.s_name").agg("count", "*", "rows"),
    "SELECT s_name AS h2_s_name, count(*) AS rows FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN part ON p_partkey = a.l_partkey AND p_size < 5 JOIN lineitem b ON b.l_orderkey = o_orderkey JOIN supplier ON s_suppkey = b.l_suppkey GROUP BY 1",
)
ask(
    "optional_hop",
    Query("Customer").hop("PLACED", "Order", optional=True, filters=(Filter("o_totalprice", ">", 400000.0),)).group_by("n.c_custkey").agg("count", "h1.id", "large_orders"),
    "SELECT c_custkey AS n_c_custkey, count(o_orderkey) AS large_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY 1",
)
ask(
    "top_nations",
    Query("Nation").hop("IN_NATION", "Customer", "incoming").group_by("n.n_name").agg("count", "*", "customers").order_by("customers", True).limit(5),
    "SELECT n_name AS n_n_name, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY customers DESC, n_name LIMIT 5",
)


@query("SELECT a.n_name AS nation, count(*) AS links FROM nation a JOIN region r ON a.n_regionkey = r.r_regionkey JOIN nation b ON b.n_regionkey = r.r_regionkey WHERE a.n_nationkey <> b.n_nationkey GROUP BY 1")
def hop_both_ways(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    e = traverse.both_ways(g.edges["IN_REGION"])
    two = e.alias("a").join(e.alias("b"), F.col("a.dst") == F.col("b.src")).where("a.src <> b.dst").select(F.col("a.src").alias("id"), F.col("b.dst").alias("other"))
    return two.join(g.label("Nation"), "id").groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("links"))


@query("SELECT DISTINCT p_name FROM part JOIN lineitem a ON a.l_partkey = p_partkey JOIN orders o1 ON o1.o_orderkey = a.l_orderkey AND o1.o_orderstatus = 'F' WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O')")
def intersection_pattern(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    of = lambda s: g.edges["CONTAINS"].join(g.label("Order").where(F.col("o_orderstatus") == s).select(F.col("id").alias("src")), "src", "left_semi").select("dst").distinct()
    both = of("F").join(of("O"), "dst", "left_semi")
    return g.label("Part").join(both.withColumnRenamed("dst", "id"), "id", "left_semi").select("p_name").distinct()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    return g.label("Customer").join(g.edges["PLACED"].select(F.col("src").alias("id")), "id", "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
def semi_suppliers_of_bulk(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    return g.label("Supplier").join(g.edges["SUPPLIED_BY"].where("l_quantity >= 50").select(F.col("dst").alias("id")), "id", "left_semi").select("s_suppkey")


NODES = "(SELECT DISTINCT node_id AS id FROM graph_nodes)"
ENDS = "(SELECT source_id AS id FROM graph_edges UNION ALL SELECT target_id FROM graph_edges)"


@query(f"SELECT id FROM {NODES} WHERE id NOT IN (SELECT id FROM {ENDS} WHERE id IS NOT NULL)")
def orphan_vertices(spark: SparkSession, d: str) -> DataFrame:
    n, e = knowledge_graph(spark, d)
    return traverse.orphans(n.select("id").distinct(), e)


@query(f"SELECT n.id, count(e.id) AS degree FROM {NODES} n LEFT JOIN {ENDS} e ON n.id = e.id GROUP BY 1")
def vertex_degrees(spark: SparkSession, d: str) -> DataFrame:
    n, e = knowledge_graph(spark, d)
    return traverse.degrees(n.select("id").distinct(), e)


HUB = "(SELECT id FROM (SELECT source_id AS id, count(*) AS n FROM graph_edges WHERE source_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, id LIMIT 1))"


def _hub(e: DataFrame) -> DataFrame:
    """The vertex with most outgoing edges."""
    return e.where("src IS NOT NULL").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "id").limit(1).select("id")


@query(f"WITH h AS {HUB}, e AS (SELECT * FROM graph_edges WHERE source_id IN (SELECT id FROM h) OR target_id IN (SELECT id FROM h)) SELECT DISTINCT id FROM (SELECT id FROM h UNION ALL SELECT source_id FROM e UNION ALL SELECT target_id FROM e) WHERE id IS NOT NULL")
def ego_vertices(spark: SparkSession, d: str) -> DataFrame:
    _, e = knowledge_graph(spark, d)
    return traverse.ego(e, _hub(e))[0]


@query(f"WITH h AS {HUB} SELECT edge_id, edge_type AS type FROM graph_edges WHERE source_id IN (SELECT id FROM h) OR target_id IN (SELECT id FROM h)")
def ego_edges(spark: SparkSession, d: str) -> DataFrame:
    _, e = knowledge_graph(spark, d)
    return traverse.ego(e, _hub(e))[1].select("edge_id", "type")


@query("SELECT DISTINCT source_id AS src, target_id AS dst FROM graph_edges WHERE edge_type IN ('OWNED_BY', 'DOCKED_AT') AND source_id IN (SELECT node_id FROM graph_nodes WHERE list_contains(labels, 'Tanker'))")
def related_by_types(spark: SparkSession, d: str) -> DataFrame:
    n, e = knowledge_graph(spark, d)
    return traverse.related(e, n.where(F.array_contains("labels", "Tanker")), "outgoing", ["OWNED_BY", "DOCKED_AT"])


REACH = """
WITH RECURSIVE h AS {hub}, e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, depth) AS (SELECT id, 0 FROM h UNION SELECT w.b, depth + 1 FROM r JOIN w ON r.id = w.a WHERE depth < {depth})
SELECT id, min(depth) AS depth FROM r GROUP BY 1 HAVING min(depth) > 0"""


@query(REACH.format(hub=HUB, depth=2))
def khop_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    _, e = knowledge_graph(spark, d)
    return traverse.reach(e, _hub(e), "both", 2).select("id", "depth")


@query(f"WITH h AS {HUB}, e AS (SELECT edge_id, source_id AS a, target_id AS b FROM graph_edges) SELECT b AS id, 1 AS length FROM e WHERE a IN (SELECT id FROM h) UNION ALL SELECT y.b, 2 FROM e x JOIN e y ON x.b = y.a AND x.edge_id <> y.edge_id WHERE x.a IN (SELECT id FROM h)")
def variable_length_paths(spark: SparkSession, d: str) -> DataFrame:
    _, e = knowledge_graph(spark, d)
    return traverse.paths(e, _hub(e), 1, 2).select("id", "length")


@query(f"WITH h AS {HUB}, near AS (SELECT id FROM h UNION SELECT target_id FROM graph_edges WHERE source_id IN (SELECT id FROM h) UNION SELECT source_id FROM graph_edges WHERE target_id IN (SELECT id FROM h)) SELECT edge_id FROM graph_edges WHERE source_id IN (SELECT id FROM near WHERE id IS NOT NULL) AND target_id IN (SELECT id FROM near WHERE id IS NOT NULL)")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    _, e = knowledge_graph(spark, d)
    return traverse.subgraph(e, _hub(e), 1).select("edge_id")


@query("SELECT request_id, source_id AS src, target_id AS dst, CASE WHEN source_id IS NULL OR source_id NOT IN (SELECT node_id FROM graph_nodes UNION SELECT port_id FROM port_nodes) THEN 'source' ELSE 'target' END AS missing FROM relationship_requests WHERE source_id IS NULL OR target_id IS NULL OR source_id NOT IN (SELECT node_id FROM graph_nodes UNION SELECT port_id FROM port_nodes) OR target_id NOT IN (SELECT node_id FROM graph_nodes UNION SELECT port_id FROM port_nodes)")
def edges_rejected(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/graph_nodes.parquet").select(F.col("node_id").alias("id")).unionByName(spark.read.parquet(f"{d}/port_nodes.parquet").select(F.col("port_id").alias("id")))
    new = spark.read.parquet(f"{d}/relationship_requests.parquet").select("request_id", F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return traverse.attach_edges(new, n)[1]


@query("SELECT source_id, target_type, target_name, relation_type, min(relation_id) AS relation_id FROM extracted_relations GROUP BY ALL")
def dedupe_relations(spark: SparkSession, d: str) -> DataFrame:
    key = ["source_id", "target_type", "target_name", "relation_type"]
    return traverse.first_per_key(spark.read.parquet(f"{d}/extracted_relations.parquet"), key, ["relation_id"]).select(*key, "relation_id")


# Aggregates, windows, order, pages, sets -------------------------------------------------------------

ask("agg_count", Query("Order").count(), "SELECT count(*) AS count FROM orders")
ask(
    "agg_functions",
    Query("Order").group_by("o_orderpriority").agg("sum", "o_totalprice", "total").agg("avg", "o_totalprice", "mean").agg("min", "o_totalprice", "low").agg("max", "o_totalprice", "high").agg("count", "o_totalprice", "n"),
    "SELECT o_orderpriority AS n_o_orderpriority, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, count(o_totalprice) AS n FROM orders GROUP BY 1",
)
ask("agg_global", Query("Customer").agg("avg", "c_acctbal"), "SELECT avg(c_acctbal) AS avg FROM customer")
ask("agg_distinct", Query("Part").group_by("p_brand").agg("distinct", "p_type", "types"), "SELECT p_brand AS n_p_brand, list_sort(list(DISTINCT p_type)) AS types FROM part GROUP BY 1")
ask("agg_collect", Query("Nation").hop("IN_REGION", "Region").group_by("h1.r_name").agg("collect", "n.n_name", "nations"), "SELECT r_name AS h1_r_name, list_sort(list(n_name)) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
ask("agg_count_distinct", Query("Order").group_by("o_orderstatus").agg("count_distinct", "o_custkey", "customers"), "SELECT o_orderstatus AS n_o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")


@query("SELECT count_if(o_orderstatus = 'F') AS finished, count_if(o_orderstatus = 'O') AS open, count_if(o_orderstatus = 'F') > count_if(o_orderstatus = 'O') AS more_finished FROM orders")
def compare_two_aggregates(spark: SparkSession, d: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return trade_graph(spark, d).label("Order").agg(n("F").alias("finished"), n("O").alias("open"), (n("F") > n("O")).alias("more_finished"))


@query("SELECT n_name, max_by(c_name, c_custkey) AS c_name, max_by(c_mktsegment, c_custkey) AS c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def merge_last_value(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    last = lambda x: F.max_by(F.struct(x), F.col("c_custkey"))[x].alias(x)
    return c.groupBy("n_name").agg(last("c_name"), last("c_mktsegment"))


@query("SELECT c_custkey, c_name, count(*) OVER () AS total FROM customer WHERE c_acctbal > 5000 ORDER BY c_custkey LIMIT 20 OFFSET 40")
def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    """The total comes from a partial aggregate, not from a window over all rows in one task."""
    rows = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 5000").select("c_custkey", "c_name")
    total = rows.agg(F.count("*").alias("total")).first()[0]
    return rows.orderBy("c_custkey").offset(40).limit(20).withColumn("total", F.lit(total).cast("bigint"))


@query("SELECT n_name, c_custkey, rank FROM (SELECT n_name, c_custkey, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE rank <= 3")
def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_name").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey")
    return c.select("n_name", "c_custkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("SELECT source_id, relation_id FROM extracted_relations ORDER BY source_id DESC NULLS FIRST, relation_id LIMIT 25")
def order_nulls_first_descending(spark: SparkSession, d: str) -> DataFrame:
    r = spark.read.parquet(f"{d}/extracted_relations.parquet").select("source_id", "relation_id")
    return order(r, (Sort("source_id", True),), ["relation_id"]).limit(25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 10 OFFSET 5")
def skip_limit(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice")
    return order(o, (Sort("o_totalprice", True),), ["o_orderkey"]).offset(5).limit(10)


@query("SELECT o_orderdate, o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1997-01-01', 100) ORDER BY 1, 2 LIMIT 30")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    at = decode_cursor(encode_cursor({"o_orderdate": "1997-01-01 00:00:00", "o_orderkey": 100}))
    at["o_orderdate"] = dt.datetime.fromisoformat(at["o_orderdate"])
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderdate", "o_orderkey")
    return o.where(after(at, ["o_orderdate", "o_orderkey"])).orderBy("o_orderdate", "o_orderkey").limit(30)


@query("SELECT wf_id, name FROM workflows WHERE contains(lower(name), 'report') ORDER BY lower(name), wf_id")
def catalog_search_by_name(spark: SparkSession, d: str) -> DataFrame:
    from tidegraph.operators import catalog

    return catalog.search(spark.read.parquet(f"{d}/workflows.parquet"), "report", ["name"], "wf_id").select("wf_id", "name")


@query("SELECT 'Customer' AS kind, c_name AS name FROM customer WHERE contains(c_name, '99') UNION ALL SELECT 'Supplier', s_name FROM supplier WHERE contains(s_name, '99')")
def union_of_searches(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    one = lambda k, c: g.label(k).where(F.col(c).contains("99")).select(F.lit(k).alias("kind"), F.col(c).alias("name"))
    return one("Customer", "c_name").unionByName(one("Supplier", "s_name"))


@query("SELECT node_id, list_sort([x for x in labels if x NOT IN ('Vessel', 'Port')]) AS other, list_sort([x for x in labels if x IN ('Vessel', 'Port')]) AS common FROM (SELECT DISTINCT node_id, labels, props, created_at, deleted_at FROM graph_nodes)")
def label_set_difference(spark: SparkSession, d: str) -> DataFrame:
    n, _ = knowledge_graph(spark, d)
    known = F.array(F.lit("Vessel"), F.lit("Port"))
    return n.select(F.col("id").alias("node_id"), F.array_sort(F.array_except("labels", known)).alias("other"), F.array_sort(F.array_intersect("labels", known)).alias("common"))


@query("SELECT request_id, arg_max(properties, ingested_at) AS properties FROM (SELECT DISTINCT * FROM relationship_requests) GROUP BY 1")
def dedupe_last_wins(spark: SparkSession, d: str) -> DataFrame:
    r = spark.read.parquet(f"{d}/relationship_requests.parquet")
    return r.where("properties IS NOT NULL").groupBy("request_id").agg(F.max_by("properties", "ingested_at").alias("properties")).join(r.select("request_id").distinct(), "request_id", "right")


# Time and space -------------------------------------------------------------------------------------

T, T2 = dt.datetime(2024, 6, 1), dt.datetime(2024, 9, 1)
LIVES = "(SELECT DISTINCT node_id, created_at, deleted_at FROM graph_nodes)"


def _lives(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/graph_nodes.parquet").select("node_id", "created_at", "deleted_at").distinct()


@query(f"SELECT * FROM {LIVES} WHERE created_at <= TIMESTAMP '2024-06-01' AND (deleted_at IS NULL OR deleted_at >= TIMESTAMP '2024-06-01')")
def valid_at_time(spark: SparkSession, d: str) -> DataFrame:
    return _lives(spark, d).where(temporal.at_time(T, "created_at", "deleted_at"))


@query(f"SELECT * FROM {LIVES} WHERE created_at <= TIMESTAMP '2024-09-01' AND (deleted_at IS NULL OR deleted_at >= TIMESTAMP '2024-06-01')")
def valid_between(spark: SparkSession, d: str) -> DataFrame:
    return _lives(spark, d).where(temporal.between(T, T2, "created_at", "deleted_at"))


@query(f"SELECT * FROM {LIVES} WHERE deleted_at IS NULL OR deleted_at >= TIMESTAMP '2024-09-01'")
def valid_currently(spark: SparkSession, d: str) -> DataFrame:
    return _lives(spark, d).where(temporal.current(T2, "deleted_at"))


@query(f"SELECT * FROM {LIVES}")
def valid_history(spark: SparkSession, d: str) -> DataFrame:
    return temporal.with_history(_lives(spark, d))


@query("SELECT wf_id, name FROM workflows WHERE created_at <= TIMESTAMP '2024-06-01' AND (deleted_at IS NULL OR deleted_at >= TIMESTAMP '2024-06-01')")
def valid_as_of(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/workflows.parquet").where(temporal.as_of(T, "created_at", "deleted_at")).select("wf_id", "name")


@query("SELECT count(*) AS events FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15'")
def date_literal(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").where(F.to_date("ts") >= F.lit(dt.date(2024, 1, 15))).agg(F.count("*").alias("events"))


@query("SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate + INTERVAL 9250 DAY AS since, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.since")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts")
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("user_id"), (F.col("o_orderdate") + F.expr("INTERVAL 9250 DAYS")).alias("since")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return temporal.as_of_join(e, o, "user_id", "ts", "since", ["o_orderkey"]).select("event_id", "o_orderkey")


#: The tables have no coordinates; both sides derive them from the key.
PLACES = "(SELECT c_custkey AS id, (c_custkey * 37 % 16000) / 100.0 - 80 AS lat, (c_custkey * 101 % 36000) / 100.0 - 180 AS lon FROM customer)"
HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"


def _places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), (k * 37 % 16000 / 100.0 - 80).alias("lat"), (k * 101 % 36000 / 100.0 - 180).alias("lon"))


@query(f"SELECT id FROM {PLACES} WHERE {HAV.format(a='lat', b='lon', c='35.1', d='129.0')} < 2500000")
def within_distance(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).where(spatial.within_distance("lat", "lon", 35.1, 129.0, 2_500_000)).select("id")


@query(f"SELECT id FROM {PLACES} WHERE lat BETWEEN 10 AND 30 AND lon BETWEEN 100 AND 140")
def within_box(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).where(spatial.within_box("lat", "lon", 10, 100, 30, 140)).select("id")


@query(f"SELECT id, round({HAV.format(a='lat', b='lon', c='35.1', d='129.0')} / 1000, 2) AS distance_km FROM {PLACES} WHERE {HAV.format(a='lat', b='lon', c='35.1', d='129.0')} < 4000000 ORDER BY 2, 1 LIMIT 20")
def nearby_top_k(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearby(_places(spark, d), "lat", "lon", 35.1, 129.0, 4000).select("id", "distance_km")


@query(f"SELECT id, round({HAV.format(a='lat', b='lon', c='1.29', d='103.85').replace('6371008.8', '3440.065')}, 3) AS nautical_miles FROM {PLACES}")
def distance_nautical(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select("id", F.round(spatial.haversine(F.col("lat"), F.col("lon"), 1.29, 103.85, spatial.EARTH_NM), 3).alias("nautical_miles"))


@query(f"SELECT a.s_suppkey AS a, b.id AS b FROM (SELECT s_suppkey, (s_suppkey * 53 % 16000) / 100.0 - 80 AS lat, (s_suppkey * 211 % 36000) / 100.0 - 180 AS lon FROM supplier) a JOIN {PLACES} b ON {HAV.format(a='a.lat', b='a.lon', c='b.lat', d='b.lon')} < 300000")
def distance_join(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("id"), (k * 53 % 16000 / 100.0 - 80).alias("lat"), (k * 211 % 36000 / 100.0 - 180).alias("lon"))
    return spatial.distance_join(s, _places(spark, d), 300_000).select("a", "b")


# Access ---------------------------------------------------------------------------------------------

#: Users are customers, roles their segments, data classes the regions; the tables hold no grants, so both sides derive them.
ROLE_CLASS = "(SELECT DISTINCT c_mktsegment AS role_id, r_regionkey AS class_id FROM customer, region WHERE (length(c_mktsegment) + r_regionkey) % 3 <> 0)"


def _access(spark: SparkSession, d: str):
    c = spark.read.parquet(f"{d}/customer.parquet")
    users = c.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") >= 0, "ACTIVE").otherwise("SUSPENDED").alias("status"))
    has_role = c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role_id"))
    classes = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").alias("class_id"), (F.col("r_regionkey") + 1).alias("level"))
    roles = has_role.select("role_id").distinct()
    can = roles.withColumn("class_id", F.explode(F.sequence(F.lit(0), F.lit(4)))).where((F.length("role_id") + F.col("class_id")) % 3 != 0)
    return users, has_role, can, classes


@query(f"SELECT c_custkey AS user_id, max(class_id + 1) AS max_level, count(DISTINCT class_id) AS classes FROM customer JOIN {ROLE_CLASS} ON role_id = c_mktsegment GROUP BY 1")
def accessible_classes(spark: SparkSession, d: str) -> DataFrame:
    users, has_role, can, classes = _access(spark, d)
    g = access.grants(has_role, can, classes)
    return g.groupBy("user_id").agg(F.max("level").alias("max_level"), F.countDistinct("class_id").alias("classes"))


@query(f"SELECT user_id, class_id, reason = 'granted' AS allowed, reason FROM (SELECT c_custkey AS user_id, k AS class_id, CASE WHEN c_acctbal IS NULL OR c_acctbal < 0 THEN 'user not active' WHEN k > 4 THEN 'class not found' WHEN NOT EXISTS (SELECT 1 FROM {ROLE_CLASS} g WHERE g.role_id = c_mktsegment AND g.class_id = k) THEN 'not granted' ELSE 'granted' END AS reason FROM customer, range(0, 6) t(k))")
def access_decisions(spark: SparkSession, d: str) -> DataFrame:
    users, has_role, can, classes = _access(spark, d)
    asked = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("class_id"))
    return access.decide(asked, users, classes, access.grants(has_role, can, classes))


@query(f"SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT role_id, max(class_id + 1) AS m FROM {ROLE_CLASS} GROUP BY 1) ON role_id = c_mktsegment WHERE m >= 5 OR CAST(left(o_orderpriority, 1) AS INT) <= m")
def rows_visible_to_reader(spark: SparkSession, d: str) -> DataFrame:
    users, has_role, can, classes = _access(spark, d)
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"))
    return access.visible_to(rows, "level", "c_custkey", access.highest(access.grants(has_role, can, classes))).select("o_orderkey", "c_custkey")


@query("SELECT count(*) AS rows FROM orders WHERE CAST(left(o_orderpriority, 1) AS INT) <= 3 OR o_orderpriority IS NULL")
def rows_visible_at_level(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").withColumn("level", F.substring("o_orderpriority", 1, 1).cast("int"))
    return rows.where(access.visible("level", 3)).agg(F.count("*").alias("rows"))


@query(f"SELECT role_id, list_sort(list(class_id)) AS classes, max(class_id + 1) AS max_level FROM {ROLE_CLASS} GROUP BY 1")
def role_class_matrix(spark: SparkSession, d: str) -> DataFrame:
    users, has_role, can, classes = _access(spark, d)
    return access.role_matrix(has_role, can.join(classes, "class_id"))


@query("SELECT count(*) AS orders FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def project_scope(spark: SparkSession, d: str) -> DataFrame:
    """Every vertex and edge scan of the pattern is cut to one project (here the customers' segment)."""
    g = trade_graph(spark, d)
    segment = g.label("Customer").select(F.col("id").alias("src"), F.col("c_mktsegment").alias("project"))
    v = g.vertices | {"Customer": g.label("Customer").withColumn("project", F.col("c_mktsegment"))}
    e = g.edges | {"PLACED": g.edges["PLACED"].join(segment, "src")}
    shared = type(g)(v, e, name="shared")
    return compile_query(shared, Query("Customer").for_project("BUILDING").hop("PLACED", "Order").where("h1.o_orderstatus", "=", "F").count().build()).withColumnRenamed("count", "orders")


# Lists of vertices and edges, schema ------------------------------------------------------------------


@query("SELECT node_id, total FROM (SELECT node_id, count(*) OVER () AS total FROM (SELECT DISTINCT node_id FROM graph_nodes WHERE list_contains(labels, 'Vessel') AND contains(coalesce(json_extract_string(props, '$.name'), ''), 'n'))) ORDER BY node_id LIMIT 20 OFFSET 10")
def list_vertices(spark: SparkSession, d: str) -> DataFrame:
    n, _ = knowledge_graph(spark, d)
    rows = n.where(F.array_contains("labels", "Vessel") & F.coalesce(F.get_json_object("props", "$.name"), F.lit("")).contains("n")).select(F.col("id").alias("node_id")).distinct()
    return rows.orderBy("node_id").offset(10).limit(20).withColumn("total", F.lit(rows.count()).cast("bigint"))


@query("SELECT edge_id, edge_type AS type FROM graph_edges WHERE edge_type = 'OWNED_BY' AND source_id IN (SELECT node_id FROM graph_nodes) AND target_id IN (SELECT node_id FROM graph_nodes) ORDER BY edge_id LIMIT 50")
def list_edges(spark: SparkSession, d: str) -> DataFrame:
    n, e = knowledge_graph(spark, d)
    ids = n.select("id").distinct()
    both = e.where(F.col("type") == "OWNED_BY").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return both.select("edge_id", "type").orderBy("edge_id").limit(50)


@query("SELECT 'label' AS kind, label AS name, count(*) AS rows FROM (SELECT unnest(labels) AS label FROM (SELECT DISTINCT node_id, labels, props, created_at, deleted_at FROM graph_nodes)) GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM graph_edges GROUP BY 2")
def schema_overview(spark: SparkSession, d: str) -> DataFrame:
    """All label counts in one pass and all edge counts in another, however many there are."""
    n, e = knowledge_graph(spark, d)
    one = n.select(F.lit("label").alias("kind"), F.explode("labels").alias("name")).unionByName(e.select(F.lit("edge").alias("kind"), F.col("type").alias("name")))
    return one.groupBy("kind", "name").agg(F.count("*").alias("rows"))


@query("SELECT id, round(sum(w), 2) AS weight FROM (SELECT 'Order:' || l_orderkey AS id, l_quantity AS w FROM lineitem UNION ALL SELECT 'Part:' || l_partkey, l_quantity FROM lineitem) GROUP BY 1")
def projection_weighted_degree(spark: SparkSession, d: str) -> DataFrame:
    from tidegraph.operators.algorithms import Projections

    p = Projections()
    e = p.create("bought", trade_graph(spark, d), ["CONTAINS"], "undirected", "l_quantity")
    return e.groupBy(F.col("src").alias("id")).agg(F.round(F.sum("weight"), 2).alias("weight"))


@query(REACH.format(hub=HUB, depth=3).replace("SELECT id, min(depth) AS depth FROM r GROUP BY 1 HAVING min(depth) > 0", "SELECT depth, count(*) AS vertices FROM (SELECT id, min(depth) AS depth FROM r GROUP BY 1) WHERE depth > 0 GROUP BY 1"))
def shortest_distances(spark: SparkSession, d: str) -> DataFrame:
    """Vertices at each least distance from the busiest vertex, up to three undirected hops."""
    _, e = knowledge_graph(spark, d)
    return traverse.reach(e, _hub(e), "both", 3).groupBy("depth").agg(F.count("*").alias("vertices"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders WHERE o_totalprice > 300000")
def edges_created(spark: SparkSession, d: str) -> DataFrame:
    """New edges whose ends exist: every large order's customer edge, looked up at both ends."""
    g = trade_graph(spark, d)
    new = g.label("Order").where("o_totalprice > 300000").select(F.concat(F.lit("Customer:"), "o_custkey").alias("src"), F.col("id").alias("dst"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("status"))
    both = g.label("Customer").select("id").unionByName(g.label("Order").select("id"))
    return traverse.attach_edges(new, both)[0].select("id", "status")
