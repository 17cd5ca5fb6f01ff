"""Loading, lineage, consistency, catalog, workflow steps, exchange formats, streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import catalog, consistency, etl, lineage, workflow
from tidegraph.operators.consistency import Property
from tidegraph.plans.graph import knowledge_graph, trade_graph
from tidegraph.plans.scratch import scratch_path
from tidegraph.sources import interchange, stores
from tidegraph.streaming import micro_batch

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Loading --------------------------------------------------------------------------------------------

ORG_RULES = (etl.required("name_en", "org_type", "country"), etl.typed(founded_year="int"), etl.known_label("country", ["KR", "JP", "NO", "ES", "PT", "NL"]))
ERRORS_SQL = """list_filter([CASE WHEN name_en IS NULL THEN 'missing field: name_en' WHEN trim(name_en, ' ') = '' THEN 'blank field: name_en' END,
 CASE WHEN org_type IS NULL THEN 'missing field: org_type' WHEN trim(org_type, ' ') = '' THEN 'blank field: org_type' END,
 CASE WHEN country IS NULL THEN 'missing field: country' WHEN trim(country, ' ') = '' THEN 'blank field: country' END,
 CASE WHEN country IS NULL THEN 'missing label' WHEN country NOT IN ('KR', 'JP', 'NO', 'ES', 'PT', 'NL') THEN 'unknown label: ' || country END], lambda x: x IS NOT NULL)"""
PIPE = etl.Pipeline("organizations", ORG_RULES, (etl.text_normal("name_en"), etl.id_normal("home_port", "port")), "updated_at")


@query(f"SELECT org_id, {ERRORS_SQL} AS errors FROM organizations WHERE len({ERRORS_SQL}) > 0")
def etl_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return PIPE.plan(_t(spark, d, "organizations"))[1].select("org_id", F.col(etl.ERRORS).alias("errors"))


SP = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query(f"SELECT org_id, trim(regexp_replace(name_en, '{SP}', ' ', 'g'), ' ') AS name_en, CASE WHEN starts_with(trim(home_port, ' '), 'port') THEN trim(home_port, ' ') ELSE 'port-' || trim(home_port, ' ') END AS home_port FROM organizations WHERE len({ERRORS_SQL}) = 0")
def etl_loaded(spark: SparkSession, d: str) -> DataFrame:
    return PIPE.plan(_t(spark, d, "organizations"))[0].select("org_id", "name_en", "home_port")


@query(f"SELECT count(*) AS read, count_if(NOT k) AS filtered, count_if(k AND len(e) > 0) AS failed, count_if(k AND len(e) = 0) AS loaded FROM (SELECT {ERRORS_SQL} AS e, coalesce(CAST(updated_at AS VARCHAR) >= '2024-09-01', true) AS k FROM organizations)")
def etl_counters(spark: SparkSession, d: str) -> DataFrame:
    return PIPE.counts(_t(spark, d, "organizations"), "2024-09-01")


@query("SELECT execution_id, status FROM workflow_executions WHERE created_at IS NULL OR CAST(created_at AS VARCHAR) >= '2024-10-01'")
def etl_incremental(spark: SparkSession, d: str) -> DataFrame:
    return etl.incremental(_t(spark, d, "workflow_executions"), "created_at", "2024-10-01").select("execution_id", "status")


TIMES = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(o_orderdate, '%Y년 %-m월 %-d일 9시 5분') WHEN 2 THEN 'due ' || strftime(o_orderdate, '%Y/%m/%d') || ' noon' ELSE 'unknown' END"


@query(f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN strftime(o_orderdate + INTERVAL 545 MINUTE, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS at FROM orders")
def etl_times_normalised(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    forms = F.when(k == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(day, "yyyy'년 'M'월 'd'일 9시 5분'")).when(k == 2, F.concat(F.lit("due "), F.date_format(day, "yyyy/MM/dd"), F.lit(" noon"))).otherwise("unknown")
    return etl.time_normal("at")(_t(spark, d, "orders").select("o_orderkey", forms.alias("at")))


@query(
    "WITH e AS (SELECT source_id AS k, request_id, ingested_at, 'last' AS p, target_id AS v FROM relationship_requests WHERE source_id IS NOT NULL UNION ALL SELECT source_id, request_id, ingested_at, rel_type, properties FROM relationship_requests WHERE source_id IS NOT NULL AND rel_type IS NOT NULL), "
    "l AS (SELECT k, p, v FROM (SELECT DISTINCT k, p, v, row_number() OVER (PARTITION BY k, p ORDER BY ingested_at DESC, request_id DESC) AS r FROM e) WHERE r = 1) SELECT k, count(*) AS properties, list_sort(list(p)) AS names FROM l WHERE v IS NOT NULL GROUP BY 1"
)
def etl_upsert(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "relationship_requests").where("source_id IS NOT NULL").select("source_id", "target_id", "rel_type", "properties", F.struct("ingested_at", "request_id").alias("at"))
    made = F.when(F.col("rel_type").isNotNull(), F.create_map(F.lit("last"), F.col("target_id"), F.col("rel_type"), F.col("properties"))).otherwise(F.create_map(F.lit("last"), F.col("target_id")))
    new = r.select(F.col("source_id").alias("k"), "at", made.alias("properties"))
    old = spark.createDataFrame([], "k string, properties map<string,string>")
    up = etl.upsert(old, new, "k", "at").where(F.size("properties") > 0)
    return up.select("k", F.size("properties").cast("bigint").alias("properties"), F.array_sort(F.map_keys("properties")).alias("names"))


@query("SELECT node_id, max(created_at) AS created_at FROM graph_nodes GROUP BY 1")
def etl_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return etl.latest(_t(spark, d, "graph_nodes"), ["node_id"], ["created_at", "ingested_at"]).select("node_id", "created_at")


@query(f"SELECT 'organizations' AS source, {ERRORS_SQL} AS errors, 1 AS retries FROM organizations WHERE len({ERRORS_SQL}) > 0")
def etl_dead_letter_table(spark: SparkSession, d: str) -> DataFrame:
    bad = PIPE.plan(_t(spark, d, "organizations"))[1]
    return etl.retryable(etl.retried(etl.dead_letters(bad, F.lit(dt.datetime(2025, 1, 1)), "organizations"))).select("source", "errors", "retries")


@query("SELECT status, count(*) AS runs FROM (SELECT DISTINCT execution_id, status FROM workflow_executions) WHERE status IN ('running', 'pending') GROUP BY 1")
def runs_active(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "workflow_executions").where(F.col("status").isin("running", "pending")).select("execution_id", "status").distinct().groupBy("status").agg(F.count("*").alias("runs"))


@query("SELECT workflow_id AS run_id, max(created_at) AS at FROM workflow_executions WHERE workflow_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1")
def runs_current_state(spark: SparkSession, d: str) -> DataFrame:
    log = _t(spark, d, "workflow_executions").where("workflow_id IS NOT NULL AND created_at IS NOT NULL").select(F.col("workflow_id").alias("run_id"), F.col("created_at").alias("at"), "status")
    return stores.current_runs(log).select("run_id", "at")


@query("SELECT workflow_id, execution_id, created_at FROM (SELECT DISTINCT workflow_id, execution_id, created_at, row_number() OVER (PARTITION BY workflow_id ORDER BY created_at DESC NULLS LAST, execution_id) AS r FROM (SELECT DISTINCT workflow_id, execution_id, created_at FROM workflow_executions)) WHERE r <= 3")
def runs_history(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = _t(spark, d, "workflow_executions").select("workflow_id", "execution_id", "created_at").distinct()
    w = Window.partitionBy("workflow_id").orderBy(F.col("created_at").desc_nulls_last(), "execution_id")
    return e.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query(
    "SELECT doc_id, title, total FROM (SELECT doc_id, title, count(*) OVER () AS total, row_number() OVER (ORDER BY created_at DESC NULLS LAST, doc_id) AS r FROM kg_documents WHERE doc_type = 'pdf' AND contains(lower(coalesce(title, '')), 'a')) WHERE r > 20 AND r <= 40"
)
def documents_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the documents of a type that match a search, with their total."""
    found = _t(spark, d, "kg_documents").where((F.col("doc_type") == "pdf") & F.lower(F.coalesce("title", F.lit(""))).contains("a"))
    return stores.page(found, [F.col("created_at").desc_nulls_last(), F.col("doc_id")], 20, 20).select("doc_id", "title", "total")


@query("SELECT doc_type, count(*) AS documents, count_if(title IS NULL) AS untitled, max(created_at) AS last FROM kg_documents GROUP BY 1")
def documents_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "kg_documents").groupBy("doc_type").agg(F.count("*").alias("documents"), F.count_if(F.col("title").isNull()).alias("untitled"), F.max("created_at").alias("last"))


# Lineage --------------------------------------------------------------------------------------------

#: Findings derive from documents, requests from nodes; the tables keep no event log, so both sides derive one.
EVENTS = "(SELECT 'derivation' AS event_type, 'doc:' || source_id AS src, 'finding:' || relation_id AS dst, extracted_at AS at FROM extracted_relations WHERE source_id IS NOT NULL UNION ALL SELECT 'creation', 'finding:' || relation_id, 'finding:' || relation_id, extracted_at FROM extracted_relations UNION ALL SELECT 'merge', 'finding:' || relation_id, 'name:' || target_name, extracted_at FROM extracted_relations WHERE target_name IS NOT NULL)"
CLASS = "(relation_class)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "extracted_relations")
    f = F.concat(F.lit("finding:"), "relation_id")
    a = r.where("source_id IS NOT NULL").select(F.lit("derivation").alias("event_type"), F.concat(F.lit("doc:"), "source_id").alias("src"), f.alias("dst"), F.col("extracted_at").alias("at"))
    b = r.select(F.lit("creation").alias("event_type"), f.alias("src"), f.alias("dst"), F.col("extracted_at").alias("at"))
    c = r.where("target_name IS NOT NULL").select(F.lit("merge").alias("event_type"), f.alias("src"), F.concat(F.lit("name:"), "target_name").alias("dst"), F.col("extracted_at").alias("at"))
    return a.unionByName(b).unionByName(c)


@query(f"SELECT event_type, count(*) AS events FROM {EVENTS} WHERE event_type IN ('creation', 'transformation', 'deletion', 'merge') GROUP BY 1")
def lineage_recorded(spark: SparkSession, d: str) -> DataFrame:
    return lineage.record(_events(spark, d), lineage.level_of(F.lit(3))).groupBy("event_type").agg(F.count("*").alias("events"))


@query(f"SELECT level, count_if(event_type IN ('creation', 'deletion') OR (level <> 'minimal' AND event_type = 'merge') OR (level IN ('detailed', 'full'))) AS events FROM {EVENTS}, (VALUES ('minimal'), ('standard'), ('detailed'), ('full')) l(level) GROUP BY 1")
def lineage_by_level(spark: SparkSession, d: str) -> DataFrame:
    per = _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    each = per.withColumn("level", F.explode(F.array(*[F.lit(x) for x in ("minimal", "standard", "detailed", "full")])))
    return each.groupBy("level").agg(F.sum(F.when(lineage.is_recorded(F.col("level"), F.col("event_type")), F.col("n")).otherwise(0)).alias("events"))


TOP_NAME = "(SELECT 'name:' || target_name AS id FROM extracted_relations WHERE target_type = 'Topic' GROUP BY target_name ORDER BY count(*) DESC, target_name LIMIT 1)"


def _top_name(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "extracted_relations").where("target_type = 'Topic'").groupBy("target_name").agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), "target_name").limit(1).select(F.concat(F.lit("name:"), "target_name").alias("id"))


UP = f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {EVENTS} WHERE src <> dst), r(id, depth) AS (SELECT id, 0 FROM {TOP_NAME} UNION SELECT e.src, depth + 1 FROM r JOIN e ON e.dst = r.id WHERE depth < 5)"


@query(f"{UP} SELECT id, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY 1")
def lineage_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return lineage.ancestors(_events(spark, d), _top_name(spark, d)).select("id", "depth")


@query(f"SELECT DISTINCT 'doc:' || source_id AS root, dst AS id, CASE WHEN event_type = 'derivation' THEN 1 ELSE 2 END AS depth FROM (SELECT source_id FROM extracted_relations WHERE source_id IS NOT NULL ORDER BY source_id LIMIT 1) s JOIN {EVENTS} e ON (e.event_type = 'derivation' AND e.src = 'doc:' || source_id) OR (e.event_type = 'merge' AND e.src IN (SELECT 'finding:' || relation_id FROM extracted_relations x WHERE x.source_id = s.source_id))")
def lineage_descendants_at_depths(spark: SparkSession, d: str) -> DataFrame:
    start = _t(spark, d, "extracted_relations").where("source_id IS NOT NULL").orderBy("source_id").limit(1).select(F.concat(F.lit("doc:"), "source_id").alias("id"))
    e = _events(spark, d).withColumn("edge_id", F.concat_ws("|", "event_type", "src", "dst"))
    return lineage.at_depths(e, start, 2)


@query(f"SELECT event_type, src, x.at FROM {EVENTS} x WHERE dst IN (SELECT id FROM {TOP_NAME})")
def lineage_timeline(spark: SparkSession, d: str) -> DataFrame:
    return lineage.timeline(_events(spark, d), _top_name(spark, d)).select("event_type", F.col("other").alias("src"), "at")


@query(f"{UP} SELECT event_type, count(*) AS events FROM {EVENTS} x WHERE src IN (SELECT id FROM r) AND dst IN (SELECT id FROM r) GROUP BY 1")
def lineage_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return lineage.subgraph(_events(spark, d), _top_name(spark, d)).groupBy("event_type").agg(F.count("*").alias("events"))


@query("SELECT wf_id, to_json({'wf_id': wf_id, 'name': name, 'description': description}) AS snapshot FROM workflows WHERE description IS NOT NULL AND name IS NOT NULL")
def lineage_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return lineage.snapshots(_t(spark, d, "workflows").where("description IS NOT NULL AND name IS NOT NULL").select("wf_id", "name", "description"), F.lit("full"), "wf_id")


# Consistency and catalog ----------------------------------------------------------------------------

ORG = {"org_id": Property("bigint", True), "name": Property("string", True), "name_en": Property("string", True), "country": Property("string", True, ("KR", "JP", "NO", "ES", "PT", "NL")), "org_type": Property("string", False, ("Shipyard", "TugOperator"))}


@query("SELECT p AS property, n AS missing, t AS total FROM (SELECT count(*) AS t, count_if(org_id IS NULL) AS org_id, count_if(name IS NULL) AS name, count_if(name_en IS NULL) AS name_en, count_if(country IS NULL) AS country FROM organizations) UNPIVOT (n FOR p IN (org_id, name, name_en, country))")
def required_nulls(spark: SparkSession, d: str) -> DataFrame:
    return consistency.required_nulls(_t(spark, d, "organizations"), ORG)


@query("SELECT p AS property, count(*) AS violations, list_sort(list(DISTINCT v))[1:5] AS samples FROM (SELECT 'country' AS p, country AS v FROM organizations WHERE country NOT IN ('KR', 'JP', 'NO', 'ES', 'PT', 'NL') UNION ALL SELECT 'org_type', org_type FROM organizations WHERE org_type NOT IN ('Shipyard', 'TugOperator')) GROUP BY 1")
def enum_violations(spark: SparkSession, d: str) -> DataFrame:
    return consistency.enum_violations(_t(spark, d, "organizations"), ORG)


@query("SELECT 'name' AS property, 'int' AS type, count_if(name IS NOT NULL AND try_cast(name AS INT) IS NULL) AS wrong FROM organizations UNION ALL SELECT 'founded_year', 'int', 0 FROM (SELECT 1)")
def wrong_types(spark: SparkSession, d: str) -> DataFrame:
    return consistency.wrong_types(_t(spark, d, "organizations"), {"name": Property("int"), "founded_year": Property("int")})


NODES = "(SELECT DISTINCT node_id AS id FROM graph_nodes)"
ENDS = "(SELECT source_id AS id FROM graph_edges UNION ALL SELECT target_id FROM graph_edges)"


@query(f"SELECT id, degree, CASE WHEN degree < 1 THEN 'too few' ELSE 'too many' END AS problem FROM (SELECT n.id, count(e.id) AS degree FROM {NODES} n LEFT JOIN {ENDS} e ON n.id = e.id GROUP BY 1) WHERE degree < 1 OR degree > 10")
def cardinality(spark: SparkSession, d: str) -> DataFrame:
    n, e = knowledge_graph(spark, d)
    return consistency.cardinality(n.select("id").distinct(), e, 1, 10)


@query(f"SELECT n AS vertices, o AS orphans, round(o / n, 6) AS rate, o / n <= 0.1 AS passed FROM (SELECT count(*) AS n, count_if(id NOT IN (SELECT id FROM {ENDS} WHERE id IS NOT NULL)) AS o FROM {NODES})")
def orphan_rate(spark: SparkSession, d: str) -> DataFrame:
    n, e = knowledge_graph(spark, d)
    return consistency.orphan_rate(n.select("id").distinct(), e)


FIRST = "(SELECT node_id AS id, min(labels[1]) AS label FROM graph_nodes GROUP BY 1)"
PROFILE = f"(SELECT edge_type AS type, a.label AS source_label, b.label AS target_label, count(*) AS edges FROM graph_edges e LEFT JOIN {FIRST} a ON a.id = e.source_id LEFT JOIN {FIRST} b ON b.id = e.target_id GROUP BY 1, 2, 3)"


def _profile(spark: SparkSession, d: str) -> DataFrame:
    n, e = knowledge_graph(spark, d)
    return consistency.edge_profile(e, n.groupBy("id").agg(F.min(F.get("labels", F.lit(0))).alias("label")))


@query(f"SELECT * FROM {PROFILE}")
def edge_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d)


@query(f"SELECT * FROM {PROFILE} WHERE source_label IS NULL OR target_label IS NULL OR source_label NOT IN ('Vessel', 'Port', 'Organization') OR target_label NOT IN ('Vessel', 'Port', 'Organization')")
def dangling_links(spark: SparkSession, d: str) -> DataFrame:
    return consistency.dangling(_profile(spark, d), ["Vessel", "Port", "Organization"])


def _verdict(bad: str, severity: str, message: str) -> str:
    return f"CASE WHEN {bad} = 0 THEN 'PASSED' WHEN '{severity}' = 'WARNING' THEN 'WARNING' ELSE 'FAILED' END AS status, '{severity}' AS severity, {bad} || ' {message}' AS message"


KNOWN = "('Vessel', 'Port', 'Organization')"


@query(
    f"SELECT 'cardinality' AS name, {_verdict('n', 'WARNING', 'vertices have too few or too many edges')} FROM (SELECT count(*) AS n FROM (SELECT n.id, count(e.id) AS degree FROM {NODES} n LEFT JOIN {ENDS} e ON n.id = e.id GROUP BY 1) WHERE degree < 1 OR degree > 10) "
    f"UNION ALL SELECT 'dangling', {_verdict('n', 'ERROR', 'kinds of links end outside the schema')} FROM (SELECT count(*) AS n FROM {PROFILE} WHERE source_label IS NULL OR target_label IS NULL OR source_label NOT IN {KNOWN} OR target_label NOT IN {KNOWN}) "
    f"UNION ALL SELECT 'enums', {_verdict('n', 'ERROR', 'values are not among the listed ones')} FROM (SELECT (SELECT count(*) FROM organizations WHERE country NOT IN ('KR', 'JP', 'NO', 'ES', 'PT', 'NL')) + (SELECT count(*) FROM organizations WHERE org_type NOT IN ('Shipyard', 'TugOperator')) AS n) "
    f"UNION ALL SELECT 'labels', {_verdict('n', 'WARNING', 'labels differ between schema and graph')} FROM (SELECT count(*) AS n FROM (SELECT label FROM (VALUES ('Vessel'), ('Port'), ('Organization')) v(label) EXCEPT SELECT unnest(labels) FROM graph_nodes)) "
    f"UNION ALL SELECT 'orphans', {_verdict('n', 'WARNING', 'vertices have no edge')} FROM (SELECT count_if(id NOT IN (SELECT id FROM {ENDS} WHERE id IS NOT NULL)) AS n FROM {NODES}) "
    f"UNION ALL SELECT 'required', {_verdict('n', 'ERROR', 'required values are missing')} FROM (SELECT count_if(org_id IS NULL) + count_if(name IS NULL) + count_if(name_en IS NULL) + count_if(country IS NULL) AS n FROM organizations) "
    f"UNION ALL SELECT 'types', {_verdict('n', 'ERROR', 'values are of another type')} FROM (SELECT count_if(name IS NOT NULL AND try_cast(name AS INT) IS NULL) AS n FROM organizations)"
)
def consistency_report(spark: SparkSession, d: str) -> DataFrame:
    """All checks in one report."""
    n, e = knowledge_graph(spark, d)
    ids, orgs, known = n.select("id").distinct(), _t(spark, d, "organizations"), ["Vessel", "Port", "Organization"]

    def check(severity: str, message: str, count) -> consistency.Check:
        def run() -> tuple[str, str, str]:
            bad = int(count() or 0)
            return ("PASSED" if not bad else "WARNING" if severity == "WARNING" else "FAILED", severity, f"{bad} {message}")

        return run

    def missing_labels() -> int:
        present = [r["label"] for r in n.select(F.explode("labels").alias("label")).distinct().collect()]
        return len(consistency.schema_alignment(consistency.Schema({k: {} for k in known}), present)[0])

    total = lambda df, c: df.agg(F.sum(c)).first()[0]
    return consistency.run(
        spark,
        {
            "cardinality": check("WARNING", "vertices have too few or too many edges", lambda: consistency.cardinality(ids, e, 1, 10).count()),
            "dangling": check("ERROR", "kinds of links end outside the schema", lambda: consistency.dangling(_profile(spark, d), known).count()),
            "enums": check("ERROR", "values are not among the listed ones", lambda: total(consistency.enum_violations(orgs, ORG), "violations")),
            "labels": check("WARNING", "labels differ between schema and graph", missing_labels),
            "orphans": check("WARNING", "vertices have no edge", lambda: consistency.orphan_rate(ids, e).first()["orphans"]),
            "required": check("ERROR", "required values are missing", lambda: total(consistency.required_nulls(orgs, ORG), "missing")),
            "types": check("ERROR", "values are of another type", lambda: total(consistency.wrong_types(orgs, {"name": Property("int")}), "wrong")),
        },
    )


NOW = dt.date(2025, 6, 1)
AGE = "date_diff('day', CAST(updated_at AS DATE), DATE '2025-06-01')"


@query(
    f"SELECT org_id, completeness, 1.0::DOUBLE AS accuracy, freshness, consistency, round((completeness + 1.0::DOUBLE + freshness + consistency) / 4 + 1e-9, 4) AS overall FROM (SELECT org_id, "
    f"round(((coalesce(trim(name, ' '), '') <> '')::INT + (coalesce(trim(name_en, ' '), '') <> '')::INT + (coalesce(trim(country, ' '), '') <> '')::INT) / 3.0::DOUBLE, 4) AS completeness, "
    f"CASE WHEN updated_at IS NULL OR {AGE} >= 365 THEN 0.0::DOUBLE WHEN {AGE} <= 30 THEN 1.0::DOUBLE ELSE round(1 - ({AGE} - 30) / 335.0::DOUBLE, 4) END AS freshness, CASE WHEN org_type IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS consistency FROM organizations)"
)
def catalog_quality(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "organizations")
    return catalog.quality(o, "org_id", ["name", "name_en", "country"], "updated_at", F.col("org_type").isNotNull(), NOW)


@query("SELECT node_id, created_at, row_number() OVER (PARTITION BY node_id ORDER BY created_at) AS version, lead(created_at) OVER (PARTITION BY node_id ORDER BY created_at) IS NULL AS latest FROM (SELECT DISTINCT node_id, created_at FROM graph_nodes)")
def catalog_history(spark: SparkSession, d: str) -> DataFrame:
    return catalog.history(_t(spark, d, "graph_nodes").select("node_id", "created_at").distinct(), "node_id", "created_at")


# Workflow steps -------------------------------------------------------------------------------------


@query("SELECT doc_id, text, index FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS index FROM documents WHERE text IS NOT NULL) WHERE trim(text, ' ') <> ''")
def workflow_split_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    return workflow.split_text(rows, "body", "\n").select("doc_id", "text", "index")


@query("SELECT execution_id, error_message FROM workflow_executions WHERE error_message IS NOT DISTINCT FROM NULL")
def workflow_keep_null(spark: SparkSession, d: str) -> DataFrame:
    return workflow.keep(_t(spark, d, "workflow_executions"), "error_message", "eq", None).select("execution_id", "error_message")


@query("SELECT c_custkey AS id, upper(c_mktsegment) AS segment FROM customer WHERE c_acctbal > 1000 UNION ALL SELECT s_suppkey, NULL FROM supplier WHERE s_acctbal > 1000")
def workflow_run(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    w = (
        workflow.Workflow()
        .add("customers", lambda: g.label("Customer").drop("id"))
        .add("suppliers", lambda: g.label("Supplier").drop("id"))
        .add("rich", lambda df: workflow.rename(workflow.keep(df, "c_acctbal", "gt", 1000), {"c_custkey": "id", "c_mktsegment": "segment"}), "customers")
        .add("rich_too", lambda df: workflow.rename(workflow.keep(df, "s_acctbal", "gt", 1000), {"s_suppkey": "id"}), "suppliers")
        .add("all", lambda df: workflow.select(df, ["id", "segment"]).withColumn("segment", F.upper("segment")), "rich", "rich_too")
    )
    return w.run()[0]["all"]


# Exchange -------------------------------------------------------------------------------------------


def _exchange(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, e = knowledge_graph(spark, d)
    props = lambda c: F.from_json(c, "map<string,string>")
    nodes = n.groupBy("id").agg(F.max_by(F.struct("labels", "props"), F.col("created_at")).alias("s")).select("id", "s.labels", F.coalesce(props("s.props"), F.create_map().cast("map<string,string>")).alias("properties"))
    edges = e.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("edge_id").alias("id"), "type", F.col("src").alias("sourceId"), F.col("dst").alias("targetId"), F.coalesce(props("properties"), F.create_map().cast("map<string,string>")).alias("properties"))
    return nodes, edges


LAST = "(SELECT node_id AS id, arg_max(labels, created_at) AS labels, arg_max(props, created_at) AS props FROM graph_nodes GROUP BY 1)"


@query(f"SELECT id, array_to_string(labels, ';') AS labels, json_extract_string(props, '$.name') AS name FROM {LAST} WHERE list_contains(labels, 'Tanker') OR list_contains(labels, 'Port')")
def export_csv_nodes(spark: SparkSession, d: str) -> DataFrame:
    return interchange.csv_nodes(_exchange(spark, d)[0], ["name"], ["Tanker", "Port"])


@query("SELECT edge_id AS id, edge_type AS type, source_id AS sourceId, target_id AS targetId, json_extract_string(properties, '$.score') AS score FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL")
def export_csv_edges(spark: SparkSession, d: str) -> DataFrame:
    return interchange.csv_edges(_exchange(spark, d)[1], ["score"])


ESCAPED = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
DATA = "array_to_string(list_transform(list_sort(json_keys({0})), lambda k: '<data key=\"' || k || '\">' || " + ESCAPED.format("json_extract_string({0}, '$.\"' || k || '\"')").replace("{{", "{") + " || '</data>'), '')"


@query(
    f"SELECT '<node id=\"' || id || '\"><data key=\"labels\">' || array_to_string(labels, ';') || '</data>' || coalesce({DATA.format('props')}, '') || '</node>' AS value FROM {LAST} UNION ALL "
    f"SELECT '<edge id=\"' || edge_id || '\" source=\"' || source_id || '\" target=\"' || target_id || '\"><data key=\"type\">' || edge_type || '</data>' || coalesce({DATA.format('properties')}, '') || '</edge>' FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL"
)
def export_graphml(spark: SparkSession, d: str) -> DataFrame:
    """Every node and edge as its element, with all properties."""
    return interchange.graphml(*_exchange(spark, d))[1]


@query("SELECT edge_id AS id, '{\"@id\":\"urn:kg:edge:' || edge_id || '\",\"@type\":\"' || edge_type || '\",\"source\":{\"@id\":\"urn:kg:node:' || source_id || '\"},\"target\":{\"@id\":\"urn:kg:node:' || target_id || '\"}}' AS value FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL")
def export_jsonld_edges(spark: SparkSession, d: str) -> DataFrame:
    return interchange.jsonld_edges(_exchange(spark, d)[1])


@query(f"SELECT id, array_to_string(labels, ';') AS labels, json_extract_string(props, '$.name') AS name FROM {LAST}")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nodes written as CSV and read again."""
    path = scratch_path(spark, "csv")
    interchange.write_csv(interchange.csv_nodes(_exchange(spark, d)[0], ["name"]), path)
    back = interchange.read_csv_nodes(spark, path)
    return back.select("id", F.array_join("labels", ";").alias("labels"), F.col("properties")["name"].alias("name"))


PLAIN = "array_to_string(list_transform(json_keys(props), lambda k: to_json(k)::VARCHAR || ':' || coalesce(to_json(json_extract_string(props, '$.\"' || k || '\"'))::VARCHAR, 'null')), ',')"


@query(f"SELECT id, '{{\"@id\":\"urn:kg:node:' || id || '\",\"@type\":' || to_json(labels)::VARCHAR || CASE WHEN props IS NULL OR len(json_keys(props)) = 0 THEN '' ELSE ',' || {PLAIN} END || '}}' AS value FROM {LAST}")
def export_jsonld_nodes(spark: SparkSession, d: str) -> DataFrame:
    return interchange.jsonld_nodes(_exchange(spark, d)[0])


@query("SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'Buoy' ELSE 'Depth' END AS label, CASE event_type WHEN 'click' THEN 'level' ELSE 'sounding' END AS property, CAST(CAST(json_extract(props, '$.k') AS INT) AS VARCHAR) AS value FROM events WHERE event_type IN ('click', 'view')")
def map_features(spark: SparkSession, d: str) -> DataFrame:
    """Events stand in for features of a product; attributes that aren't mapped are left out."""
    e = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("S-101").alias("product"), F.col("event_type").alias("feature"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("value"), F.col("value").cast("string")).alias("attributes"))
    mapping = spark.createDataFrame([("S-101", "click", "Buoy", {"k": "level"}), ("S-101", "view", "Depth", {"k": "sounding"})], "product string, feature string, label string, names map<string,string>")
    return interchange.map_features(e, mapping).select("id", "label", F.explode("properties").alias("property", "value"))


# Streams --------------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return micro_batch.tumbling(_t(spark, d, "events"), "ts", "1 day", ["event_type"], "value").withColumn("total", F.round("total", 2))


@query("WITH g AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS events FROM g GROUP BY user_id, s")
def window_sessions(spark: SparkSession, d: str) -> DataFrame:
    return micro_batch.sessions(_t(spark, d, "events"), "ts", "6 hours", "user_id")


@query("SELECT event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_micro_batches(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files, each micro-batch pre-aggregated and appended, then summed."""
    base = scratch_path(spark, "stream")
    src = _t(spark, d, "events").select("event_id", "event_type", "value")
    src.repartition(4, "event_id").write.parquet(f"{base}/in")
    stream = micro_batch.subscribe(spark, f"{base}/in", src.schema, files_per_batch=2)

    def handle(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = micro_batch.process(stream, handle, lambda b, e, i: b.write.mode("overwrite").parquet(f"{base}/dead/batch={i}"), f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.sum("n").alias("events"), F.round(F.sum("v"), 2).alias("total"))


@query("SELECT event_id AS record_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def stream_records(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("topic"), F.col("props").alias("payload"), F.col("ts").alias("timestamp"))
    return micro_batch.to_records(m, "k int").where(F.size("errors") == 0).select("record_id", "data.k")


@query("SELECT org_id, name_en FROM organizations WHERE name_en IS NOT NULL AND trim(name_en, ' ') <> '' AND country IS NOT NULL AND trim(country, ' ') <> ''")
def raw_replay(spark: SparkSession, d: str) -> DataFrame:
    """Records put into the raw store as they came, read again by source and run through a pipeline."""
    path = scratch_path(spark, "raw")
    o = _t(spark, d, "organizations")
    stores.put_raw(o.select(F.col("org_id").cast("string").alias("id"), F.to_json(F.struct("org_id", "name_en", "country")).alias("payload")), path, "registry", F.lit("2025-01-01"))
    again = stores.raw(spark, path, "registry", dt.date(2024, 12, 31)).select(F.from_json("payload", "org_id bigint, name_en string, country string").alias("r")).select("r.*")
    return etl.Pipeline("replay", (etl.required("name_en", "country"),)).plan(again)[0].select("org_id", "name_en")


@query("SELECT relation_type, target_type, round(avg(confidence), 4) AS mean, count(*) AS findings FROM extracted_relations WHERE confidence IS NOT NULL GROUP BY 1, 2")
def mean_by_group(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "extracted_relations").where("confidence IS NOT NULL")
    return r.groupBy("relation_type", "target_type").agg(F.round(F.avg("confidence"), 4).alias("mean"), F.count("*").alias("findings"))


@query("SELECT workflow_id, started_at, finished_at, trigger_type FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY started_at DESC, execution_id) AS r FROM (SELECT DISTINCT workflow_id, execution_id, started_at, finished_at, trigger_type FROM workflow_executions WHERE status = 'completed')) WHERE r = 1")
def last_completed_run(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "workflow_executions").where("status = 'completed'").select("workflow_id", "execution_id", "started_at", "finished_at", "trigger_type").distinct()
    from pyspark.sql import Window

    w = Window.partitionBy("workflow_id").orderBy(F.col("started_at").desc_nulls_last(), "execution_id")
    return e.withColumn("r", F.row_number().over(w)).where("r = 1").select("workflow_id", "started_at", "finished_at", "trigger_type")
