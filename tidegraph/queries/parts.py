"""Queries of the parts that other queries use: readers, stores, registries, checks and decisions.

Where a part decides something about metadata (a schema, a list of statements),
its SQL states the expected rows.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

from tidegraph.functions import terms
from tidegraph.functions import text as T
from tidegraph.operators import access, algorithms, consistency, etl, language, lineage, retrieval, temporal, vectors, workflow
from tidegraph.operators.consistency import Link, Property, Schema
from tidegraph.plans.graph import knowledge_graph
from tidegraph.plans.ir import Query
from tidegraph.plans.scratch import scratch_path
from tidegraph.sources import documents, interchange, stores
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


def _values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


# Readers --------------------------------------------------------------------------------------------

STATIC = "first\n\n  second \nthird"


@query("SELECT CAST(i - 1 AS INT) AS index, trim(x, ' ') AS text FROM (SELECT unnest(string_split('first' || chr(10) || chr(10) || '  second ' || chr(10) || 'third', chr(10))) AS x, unnest(range(1, 5)) AS i) WHERE trim(x, ' ') <> ''")
def static_lines(spark: SparkSession, d: str) -> DataFrame:
    return workflow.static_input(spark, "list", STATIC).select("index", "text")


@query("SELECT 1::BIGINT AS a, 'x' AS b UNION ALL SELECT 2, NULL")
def static_json(spark: SparkSession, d: str) -> DataFrame:
    return workflow.static_input(spark, "json", '[{"a": 1, "b": "x"}, {"a": 2}]').select("a", "b")


PAGE = "'<html><head><title>' || name_en || '</title><meta name=\"citation_title\" content=\"' || name_en || ' port\"><meta name=\"citation_author\" content=\"' || country || '; Harbour Office\"><style>p {}</style></head><body><p>' || name_en || '</p><p>has ' || CAST(berth_count AS INT) || ' berths &amp; cranes</p><a href=\"/' || port_id || '\">more</a></body></html>'"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "port_nodes").where("name_en IS NOT NULL AND country IS NOT NULL AND berth_count IS NOT NULL")
    head = F.concat(F.lit("<html><head><title>"), "name_en", F.lit('</title><meta name="citation_title" content="'), "name_en", F.lit(' port"><meta name="citation_author" content="'), "country", F.lit('; Harbour Office"><style>p {}</style></head><body><p>'))
    html = F.concat(head, "name_en", F.lit("</p><p>has "), F.col("berth_count").cast("int").cast("string"), F.lit(' berths &amp; cranes</p><a href="/'), "port_id", F.lit('">more</a></body></html>'))
    return p.select("port_id", html.alias("html"))


KNOWN_PORTS = "FROM port_nodes WHERE name_en IS NOT NULL AND country IS NOT NULL AND berth_count IS NOT NULL"


@query(f"SELECT port_id, name_en || name_en || ' has ' || CAST(berth_count AS INT) || ' berths & cranes more' AS text, ['/' || port_id] AS links, {PAGE} AS source {KNOWN_PORTS}")
def page_parts(spark: SparkSession, d: str) -> DataFrame:
    return documents.page_parts(_pages(spark, d), "html").select("port_id", "text", "links", "source")


@query(f"SELECT port_id, name_en || ' port' AS title, [country, 'Harbour Office'] AS authors, NULL::VARCHAR AS doi {KNOWN_PORTS}")
def paper_records(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("port_id", documents.paper(F.col("html")).alias("p")).select("port_id", "p.title", "p.authors", "p.doi")


@query(
    "SELECT doc_id, kind, CASE kind WHEN 'markdown' THEN 'Title' || chr(10) || chr(10) || 'bold ' || doc_id || ' code' WHEN 'html' THEN doc_id WHEN 'text' THEN '**' || doc_id || '**' END AS text FROM (SELECT doc_id, CASE regexp_extract(lower(source), '\\.([a-z0-9]+)$', 1) WHEN 'html' THEN 'html' WHEN 'pdf' THEN 'markdown' WHEN 'txt' THEN 'text' ELSE 'none' END AS kind FROM kg_documents)"
)
def documents_read(spark: SparkSession, d: str) -> DataFrame:
    """Texts made for each kind, read by its reader; a kind without a reader gives null."""
    ending = F.regexp_extract(F.lower("source"), "\\.([a-z0-9]+)$", 1)
    k = _t(spark, d, "kg_documents").select("doc_id", F.when(ending == "html", "html").when(ending == "pdf", "markdown").when(ending == "txt", "text").otherwise("none").alias("kind"))
    made = F.when(F.col("kind") == "markdown", F.concat(F.lit("# Title\n\n**bold** "), "doc_id", F.lit(" `code`\n\n---\n"))).when(F.col("kind") == "html", F.concat(F.lit("<p>"), "doc_id", F.lit("</p>"))).otherwise(F.concat(F.lit("**"), "doc_id", F.lit("**")))
    return k.select("doc_id", "kind", documents.Readers().read(made, F.col("kind")).alias("text"))


@query("SELECT CAST(count(*) + 1 AS INT) AS rows, 3 AS columns, sum(length(port_id) + coalesce(length(name), 0) + coalesce(length(country), 0) + 3) + length('port_id') + length('name') + length('country') + 2 AS characters FROM port_nodes")
def csv_as_document(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "csv-document")
    _t(spark, d, "port_nodes").select("port_id", "name", "country").coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    return documents.csv_document(spark, path).select("rows", "columns", F.length("text").cast("bigint").alias("characters"))


@pandas_udf(BinaryType())
def _docx(texts: pd.Series) -> pd.Series:
    from html import escape

    def one(text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", "<w:document>" + "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n")) + "</w:document>")
        return out.getvalue()

    return texts.map(one)


@query("SELECT wf_id, name || CASE WHEN description <> '' THEN chr(10) || description ELSE '' END AS text FROM workflows WHERE name IS NOT NULL")
def office_documents(spark: SparkSession, d: str) -> DataFrame:
    """Word files made of workflows, read from their XML."""
    made = _t(spark, d, "workflows").where("name IS NOT NULL").select("wf_id", _docx(F.concat_ws("\n", "name", F.nullif("description", F.lit("")))).alias("data"))
    read = pandas_udf(lambda s: s.map(lambda b: documents.office_text(bytes(b))), StringType())
    return made.select("wf_id", read("data").alias("text"))


@query(
    "SELECT * FROM (SELECT '<urn:port:' || port_id || '>' AS subject, unnest(['a', ':name', ':country']) AS predicate, unnest([':Port', '\"' || name_en || '\"@en', '\"' || country || '\"']) AS object FROM port_nodes WHERE name_en IS NOT NULL AND country IS NOT NULL)"
)
def turtle_read(spark: SparkSession, d: str) -> DataFrame:
    """Ports written as Turtle, several statements to a line and to a group, and read again."""
    path = scratch_path(spark, "turtle")
    p = _t(spark, d, "port_nodes").where("name_en IS NOT NULL AND country IS NOT NULL")
    p.select(F.concat(F.lit("<urn:port:"), "port_id", F.lit("> a :Port ; # a port\n  :name \""), "name_en", F.lit("\"@en ; :country \""), "country", F.lit("\" .")).alias("value")).coalesce(2).write.text(path)
    return interchange.read_turtle(spark, path)


SCHEMA = Schema(
    labels={"Vessel": {"name": Property("string", True), "tonnage": Property("double")}, "Tanker": {"cargo": Property("string")}, "LNGCarrier": {"cargo": Property("string")}, "Port": {"name": Property("string", True)}},
    links={"DOCKED_AT": Link("Vessel", "Port", 0, 1)},
    parents={"Tanker": "Vessel", "LNGCarrier": "Tanker"},
)


@query(
    _values(
        [(":LNGCarrier", "a", "owl:Class"), (":LNGCarrier", "rdfs:subClassOf", ":Tanker"), (":Tanker", "a", "owl:Class"), (":Tanker", "rdfs:subClassOf", ":Vessel"), (":Vessel", "a", "owl:Class"), (":Port", "a", "owl:Class")]
        + [(":DOCKED_AT", "a", "owl:ObjectProperty"), (":DOCKED_AT", "rdfs:domain", ":Vessel"), (":DOCKED_AT", "rdfs:range", ":Port")]
        + [x for s, c, t in ((":LNGCarrier_cargo", ":LNGCarrier", "string"), (":Port_name", ":Port", "string"), (":Tanker_cargo", ":Tanker", "string"), (":Vessel_name", ":Vessel", "string"), (":Vessel_tonnage", ":Vessel", "double")) for x in ((s, "a", "owl:DatatypeProperty"), (s, "rdfs:domain", c), (s, "rdfs:range", f"xsd:{t}"))],
        "subject, predicate, object",
    )
)
def turtle_written(spark: SparkSession, d: str) -> DataFrame:
    """The schema as OWL in Turtle."""
    path = scratch_path(spark, "ontology")
    spark.createDataFrame([(interchange.turtle(SCHEMA),)], "value string").coalesce(1).write.text(path)
    return interchange.read_turtle(spark, path)


@query("SELECT 'runs' AS source, execution_id AS payload, ['not finished'] AS errors, 1 AS retries FROM (SELECT DISTINCT execution_id FROM workflow_executions WHERE finished_at IS NULL)")
def dead_letters_stored(spark: SparkSession, d: str) -> DataFrame:
    """Dead letters appended to a file that also holds broken lines, read again."""
    path = scratch_path(spark, "letters")
    bad = _t(spark, d, "workflow_executions").where("finished_at IS NULL").select("execution_id").distinct()
    letters = bad.select(F.lit("runs").alias("source"), F.col("execution_id").alias("payload"), F.array(F.lit("not finished")).alias("errors"), F.lit(None).cast("timestamp").alias("failed_at"), F.lit(1).alias("retries"))
    stores.append_letters(letters, path)
    spark.createDataFrame([('{"source": "runs", "payl',)], "value string").write.mode("append").text(path)
    return stores.letters(spark, path).where("source IS NOT NULL").select("source", "payload", "errors", "retries")


@query("SELECT request_id, request_id % 5 AS retries FROM (SELECT DISTINCT request_id FROM relationship_requests WHERE source_id IS NULL) WHERE request_id % 5 < 3")
def letters_to_retry(spark: SparkSession, d: str) -> DataFrame:
    bad = _t(spark, d, "relationship_requests").where("source_id IS NULL").select("request_id").distinct()
    return etl.retryable(bad.withColumn("retries", F.col("request_id") % 5))


# Ids, scores and searches ---------------------------------------------------------------------------


@query(
    "SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[('0x' || h[17:17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id)) AS h FROM kg_documents)"
)
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "kg_documents").select("doc_id", T.point_id(F.col("doc_id")).alias("point_id"))


@query("SELECT event_id, round((greatest(-1.0, least(1.0, value / 100)) + 1) / 2 + 1e-9, 5) AS cosine, round(1 / (1 + abs(value)) + 1e-9, 5) AS euclid, round(greatest(0.0, least(1.0, value / 100)) + 1e-9, 5) AS dot FROM events WHERE value IS NOT NULL")
def scores_normalised(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return _t(spark, d, "events").where("value IS NOT NULL").select("event_id", *[F.round(T.similarity_score(raw, kind) + 1e-9, 5).alias(kind) for raw, kind in ((v / 100, "cosine"), (v, "euclid"), (v / 100, "dot"))])


@query(_values([("docs", 768, "cosine", "ready", 7), ("ports", 8, "dot", "created", 0)], "name, dimensions, similarity, status, rows"))
def vector_indexes(spark: SparkSession, d: str) -> DataFrame:
    r = vectors.Indexes()
    for name, size, kind in (("ports", 8, "dot"), ("docs", 768, "cosine"), ("old", 3, "euclid")):
        r.create(vectors.Index(name, "Document", "embedding", size, kind))
    r.update("docs", "ready", 7)
    r.drop("old")
    return spark.createDataFrame([(i.name, i.dimensions, i.similarity, i.status, i.rows) for i in r.all()], "name string, dimensions int, similarity string, status string, rows int")


FOUND_SQL = "(SELECT l_orderkey AS query_id, l_linenumber AS id, l_extendedprice AS raw FROM lineitem)"


@query(
    f"WITH s AS (SELECT query_id, id, CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 1.0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS score FROM {FOUND_SQL} WINDOW w AS (PARTITION BY query_id)) SELECT query_id, id, round(score + 1e-9, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 3"
)
def scores_of_a_model(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders re-ranked by a scorer, their scores spread to 0..1 per order."""
    found = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"), "l_extendedprice", F.lit("").alias("q"))
    return retrieval.rescore(found, lambda q, t: t, "l_extendedprice", "q", 3).select("query_id", "id", F.round(F.col("score") + 1e-9, 5).alias("score"))


# The entity graph over the findings of documents: what a document mentions, and names found by one relation type.
MENTION = "(SELECT DISTINCT source_id AS id, target_name AS name, target_type AS kind FROM extracted_relations WHERE source_id IS NOT NULL AND target_name IS NOT NULL AND target_type <> 'Organization')"
PAIR = f"(SELECT x.id, x.name AS a, y.name AS b FROM {MENTION} x JOIN {MENTION} y ON x.id = y.id AND x.name < y.name)"
ASKED_NAMES = f"(SELECT 1 AS query_id, name FROM {MENTION} GROUP BY name ORDER BY count(*) DESC, name LIMIT 3)"


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "extracted_relations").where("source_id IS NOT NULL AND target_name IS NOT NULL AND target_type <> 'Organization'")
    return r.select(F.col("source_id").alias("id"), F.col("target_name").alias("name"), F.col("target_type").alias("kind")).distinct()


def _linked(found: DataFrame) -> DataFrame:
    """Names of one document, each pair once."""
    a, b = found.alias("x"), found.alias("y")
    return a.join(b, (F.col("x.id") == F.col("y.id")) & (F.col("x.name") < F.col("y.name"))).select(F.col("x.id").alias("id"), F.col("x.name").alias("a"), F.col("y.name").alias("b"))


def _asked_names(found: DataFrame) -> DataFrame:
    return found.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(3).select(F.lit(1).alias("query_id"), "name")


BY_NAMES = f"""n AS (SELECT id, sum(s) AS s FROM (SELECT id, 1.0::DOUBLE AS s FROM {MENTION} JOIN {ASKED_NAMES} USING (name) UNION ALL
SELECT id, 0.5::DOUBLE FROM (SELECT DISTINCT id, a, b FROM {PAIR} WHERE a IN (SELECT name FROM {ASKED_NAMES}) OR b IN (SELECT name FROM {ASKED_NAMES}))) GROUP BY 1),
by_names AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(s / (SELECT max(s) FROM n), 9) AS score FROM n))"""
BY_KINDS = f"""k AS (SELECT id, sum(0.3::DOUBLE) AS s FROM {MENTION} WHERE kind = 'Port' GROUP BY 1), by_kinds AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(s / (SELECT max(s) FROM k), 9) AS score FROM k))"""


@query(f"WITH {BY_NAMES} SELECT 1 AS query_id, id, round(score, 5) AS score, rank FROM by_names WHERE rank <= 20")
def graph_search_by_names(spark: SparkSession, d: str) -> DataFrame:
    found = _mentions(spark, d)
    return retrieval.by_entities(_asked_names(found), found, _linked(found), 20).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


@query(f"WITH {BY_KINDS} SELECT 1 AS query_id, id, round(score, 5) AS score, rank FROM by_kinds WHERE rank <= 20")
def graph_search_by_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = spark.createDataFrame([(1, "Port")], "query_id int, kind string")
    return retrieval.by_kinds(kinds, _mentions(spark, d), 20).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


@query(
    f"WITH {BY_NAMES}, {BY_KINDS}, f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS s FROM (SELECT id, rank FROM by_names WHERE rank <= 20 UNION ALL SELECT id, rank FROM by_kinds WHERE rank <= 20) GROUP BY 1), "
    "r AS (SELECT id, s, row_number() OVER (ORDER BY s DESC, id) AS rank FROM f) SELECT 1 AS query_id, id, round(s / (SELECT max(s) FROM f), 5) AS score, rank FROM r WHERE rank <= 10"
)
def graph_search_both_ways(spark: SparkSession, d: str) -> DataFrame:
    found = _mentions(spark, d)
    kinds = spark.createDataFrame([(1, "Port")], "query_id int, kind string")
    return retrieval.dual(_asked_names(found), kinds, found, _linked(found), 10).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


@query(f"SELECT name, kind, count(DISTINCT id) AS chunks FROM {MENTION} GROUP BY 1, 2")
def graph_of_mentions(spark: SparkSession, d: str) -> DataFrame:
    found = _mentions(spark, d)
    return retrieval.entity_graph(found, _linked(found))[0]


@query(f"SELECT a, b, count(*) AS weight FROM {PAIR} GROUP BY 1, 2")
def graph_of_mentions_edges(spark: SparkSession, d: str) -> DataFrame:
    found = _mentions(spark, d)
    return retrieval.entity_graph(found, _linked(found))[1]


@query("SELECT doc_id AS id, x[1] AS name, x[2] AS kind FROM (SELECT doc_id, unnest([['IMO', 'Organization'], ['SOLAS', 'Regulation'], ['대한해협', 'SeaArea'], ['유조선', 'Vessel']]) AS x FROM kg_documents)")
def entities_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Entities of sentences put together of known names, one per document."""
    made = _t(spark, d, "kg_documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("IMO, SOLAS 2024: 유조선 1 in 대한해협. IMO "), F.col("doc_id")).alias("text"))
    return retrieval.extract_entities(made).select("id", "name", "kind")


# Statements, questions, schemas ---------------------------------------------------------------------

STATEMENTS = [("SELECT 'drop table x' AS a", True), ("WITH a AS (SELECT 1) SELECT * FROM a", True), ("DROP TABLE x", False), ("SELECT 1; DELETE FROM x", False), ("delete from x", False), ("/* drop */ select 1", True), ("explain select 1", True), ("INSERT INTO x VALUES (1)", False)]


def _passes(f, *args) -> bool:
    try:
        f(*args)
    except ValueError:
        return False
    return True


@query(_values([(s, str(ok).lower()) for s, ok in STATEMENTS], "statement, reads").replace("SELECT *", "SELECT statement, reads = 'true' AS reads", 1))
def statements_guarded(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(s, _passes(language.read_only, s)) for s, _ in STATEMENTS], "statement string, reads boolean")


@query(_values([("at null", 0), ("range without end", 0), ("range backwards", 0), ("range", 1), ("at", 1), ("overlap too large", 0), ("size zero", 0), ("weights", 0), ("unknown mode", 0), ("unknown operator", 0), ("no retriever", 0)], "what, passes").replace("SELECT *", "SELECT what, passes = 1 AS passes"))
def settings_checked(spark: SparkSession, d: str) -> DataFrame:
    """Which settings the operators refuse."""
    tries = [
        ("at null", temporal.at_time, None), ("range without end", temporal.between, "2024-01-01", None), ("range backwards", temporal.between, "2024-02-01", "2024-01-01"), ("range", temporal.between, "2024-01-01", "2024-02-01"), ("at", temporal.at_time, "2024-01-01"),
        ("overlap too large", T.chunk_overlap, F.array(F.lit("x")), 10, 10), ("size zero", T.chunk_merge, F.lit("x"), "\n", 0), ("weights", T.hybrid_similarity, F.lit("a"), F.lit("b"), 1.5), ("unknown mode", micro_batch.trigger_of, "often"),
        ("unknown operator", Query("Port").where("name", "near", 1).build), ("no retriever", retrieval.hybrid, None, None),
    ]
    return spark.createDataFrame([(name, _passes(f, *args)) for name, f, *args in tries], "what string, passes boolean")


@query("WITH RECURSIVE p(child, parent) AS (VALUES ('Tanker', 'Vessel'), ('LNGCarrier', 'Tanker')), r(label, below) AS (SELECT parent, child FROM p UNION SELECT r.label, p.child FROM r JOIN p ON p.parent = r.below) SELECT label, below FROM r")
def labels_below(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, c) for k in SCHEMA.labels for c in SCHEMA.descendants(k)], "label string, below string")


@query("SELECT id FROM (SELECT DISTINCT node_id AS id, labels FROM graph_nodes) WHERE list_has_any(labels, ['Vessel', 'Tanker', 'LNGCarrier']) GROUP BY 1")
def vertices_of_label_or_below(spark: SparkSession, d: str) -> DataFrame:
    n, _ = knowledge_graph(spark, d)
    wanted = ["Vessel", *SCHEMA.descendants("Vessel")]
    return n.where(F.arrays_overlap("labels", F.array(*map(F.lit, wanted)))).select("id").distinct()


STEPS = {"load": ["clean", "check"], "clean": ["read"], "check": ["read"], "read": [], "report": ["load"]}


@query(_values([(0, "read"), (1, "check"), (2, "clean"), (3, "load"), (4, "report")], "position, step"))
def steps_in_order(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(workflow.order_of(STEPS))), "position int, step string")


@query("SELECT step, state, rows FROM (SELECT 'ports' AS step, 'completed' AS state, count(*) AS rows FROM port_nodes UNION ALL SELECT 'large', 'completed', count(*) FROM port_nodes WHERE berth_count > 20 UNION ALL SELECT 'broken', 'failed', NULL UNION ALL SELECT 'last', 'skipped', NULL)")
def workflow_states(spark: SparkSession, d: str) -> DataFrame:
    """A workflow of which one step fails: what it depends on is done, what depends on it is skipped."""

    def broken(df: DataFrame) -> DataFrame:
        raise ValueError("no such step")

    w = workflow.Workflow().add("ports", lambda: _t(spark, d, "port_nodes")).add("large", lambda df: workflow.keep(df, "berth_count", "gt", 20), "ports").add("broken", broken, "large").add("last", lambda df: df, "broken")
    results, states = w.run()
    rows = [(k, s.split(":")[0]) for k, s in states.items()]
    counts = [results[k].agg(F.lit(k).alias("step"), F.count("*").alias("rows")) for k in results]
    return spark.createDataFrame(rows, "step string, state string").join(counts[0].unionByName(counts[1]), "step", "left")


@query(_values([("Organizations", "organizations", "0 2 * * *"), ("Runs", "runs", "")], "owner, name, schedule").replace("SELECT *", "SELECT name, schedule"))
def pipelines_registered(spark: SparkSession, d: str) -> DataFrame:
    r = etl.Pipelines()
    r.register(etl.Pipeline("runs"))
    r.register(etl.Pipeline("organizations"), "0 2 * * *")
    return spark.createDataFrame(r.names(), "name string, schedule string")


@query(_values([("batch", "availableNow", "true"), ("micro_batch", "processingTime", "5 seconds"), ("realtime", "processingTime", "0 seconds")], "mode, option, value"))
def stream_modes(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(m, k, str(v).lower()) for m in ("realtime", "micro_batch", "batch") for k, v in micro_batch.trigger_of(m).items()], "mode string, option string, value string")


ASKED = [("right", Query("Vessel").hop("DOCKED_AT", "Port").limit(5)), ("case", Query("vessel").hop("docked_at", "PORT").limit(5)), ("label", Query("Boat").limit(5)), ("direction", Query("Port").hop("DOCKED_AT", "Vessel").limit(5)), ("property", Query("Port").where("depth", ">", 3)), ("link", Query("Vessel").hop("FLIES", "Port").limit(5))]


@query(_values([("right", 0, 0, 1.0, 0), ("case", 3, 0, 0.1, 0), ("label", 1, 0, 0.7, 1), ("direction", 1, 0, 0.7, 1), ("property", 0, 2, 0.8, 0), ("link", 1, 0, 0.7, 1)], "name, errors, warnings, s, left_over").replace("SELECT *", "SELECT name, errors, warnings, s::DOUBLE AS score, left_over"))
def queries_checked(spark: SparkSession, d: str) -> DataFrame:
    """Structured queries held against the schema, and the errors that spelling can't mend."""
    rows = []
    for name, q in ASKED:
        found = language.check_query(q._q, SCHEMA)
        rows.append((name, len(found.errors), len(found.warnings), found.score, len(language.check_query(language.correct_query(q._q, SCHEMA), SCHEMA).errors)))
    return spark.createDataFrame(rows, "name string, errors int, warnings int, score double, left_over int")


QUESTIONS = ["컨테이너선 5000톤 이상", "선박 길이 3 km 미만 12.5노트", "여객선 몇 척", "상위 3 개 항구"]


@query(
    _values(
        [(QUESTIONS[0], "CargoShip", "tonnage", ">=", 5000.0), (QUESTIONS[1], "Vessel", "distance", "<", 3000.0), (QUESTIONS[1], "Vessel", "speed", "=", 12.5), (QUESTIONS[2], "PassengerShip", None, None, None), (QUESTIONS[3], "Port", None, None, None)],
        "question, label, property, op, v",
    ).replace("SELECT *", "SELECT question, label, property, op, v::DOUBLE AS value")
)
def questions_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Labels and comparisons with units of questions in plain Korean."""
    rows = []
    for text in QUESTIONS:
        q = language.parse_question(text, language.maritime_terms()).query
        rows += [(text, q.label, f.field, str(f.op), float(f.value)) for f in q.filters] or [(text, q.label, None, None, None)]
    return spark.createDataFrame(rows, "question string, label string, property string, op string, value double")


@query("SELECT port_id, name, CASE name WHEN '부산항' THEN 'KRPUS' WHEN '인천항' THEN 'KRICN' END AS code FROM (SELECT port_id, CASE WHEN country = 'KR' THEN '부산항' WHEN country = 'JP' THEN '인천항' ELSE 'none' END AS name FROM port_nodes)")
def well_known_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("country") == "KR", "부산항").when(F.col("country") == "JP", "인천항").otherwise("none")
    known = F.create_map(*[F.lit(x) for pair in terms.PORTS.items() for x in pair])
    return _t(spark, d, "port_nodes").select("port_id", name.alias("name")).withColumn("code", known[F.col("name")])


LABELS_SQL = "(SELECT DISTINCT unnest(labels) AS label FROM graph_nodes)"


@query(f"SELECT label, 'graph lacks' AS problem FROM (VALUES ('Vessel'), ('Tanker'), ('LNGCarrier'), ('Port')) s(label) WHERE label NOT IN (SELECT label FROM {LABELS_SQL}) UNION ALL SELECT label, 'schema lacks' FROM {LABELS_SQL} WHERE label NOT IN ('Vessel', 'Tanker', 'LNGCarrier', 'Port')")
def labels_aligned(spark: SparkSession, d: str) -> DataFrame:
    n, _ = knowledge_graph(spark, d)
    present = [r["label"] for r in n.select(F.explode("labels").alias("label")).distinct().collect()]  # a schema's worth
    lacks, extra = consistency.schema_alignment(SCHEMA, present)
    return spark.createDataFrame([(x, "graph lacks") for x in lacks] + [(x, "schema lacks") for x in extra], "label string, problem string")


@query(_values([("label Berth is missing",), ("link AT ends at unknown label Quay",), ("label Port has no properties",), ("label Tug has unknown parent Boat",)], "problem"))
def schema_problems(spark: SparkSession, d: str) -> DataFrame:
    s = Schema({"Port": {}, "Tug": {"name": Property()}}, {"AT": Link("Tug", "Quay")}, {"Tug": "Boat"})
    return spark.createDataFrame([(p,) for p in s.problems(("Port", "Berth"))], "problem string")


# Access and lineage ---------------------------------------------------------------------------------

ROLES_SQL = "(SELECT c_custkey AS user_id, c_nationkey AS role_id FROM customer)"


@query(f"SELECT user_id, role_id FROM (SELECT * FROM {ROLES_SQL} UNION SELECT user_id, 99 FROM {ROLES_SQL} WHERE user_id % 3 = 0) WHERE NOT (role_id = 5 AND user_id % 2 = 0)")
def roles_assigned(spark: SparkSession, d: str) -> DataFrame:
    """Roles after some were assigned, some of them twice, and others revoked."""
    has = _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("role_id"))
    new = has.where("user_id % 3 = 0").select("user_id", F.lit(99).cast(has.schema["role_id"].dataType).alias("role_id"))
    return access.revoke(access.assign(has, new.unionByName(new)), has.where("role_id = 5 AND user_id % 2 = 0"))


@query(
    "WITH s AS (SELECT 'finding:' || min(relation_id) AS id FROM extracted_relations WHERE source_id IS NOT NULL AND target_name IS NOT NULL) SELECT s.id AS root, ['doc:' || source_id] AS ancestors, ['name:' || target_name] AS descendants FROM extracted_relations JOIN s ON s.id = 'finding:' || relation_id"
)
def lineage_full(spark: SparkSession, d: str) -> DataFrame:
    from tidegraph.queries.pipelines import _events

    start = _t(spark, d, "extracted_relations").where("source_id IS NOT NULL AND target_name IS NOT NULL").agg(F.concat(F.lit("finding:"), F.min("relation_id")).alias("id"))
    return lineage.full(_events(spark, d), start)


# Paths ----------------------------------------------------------------------------------------------

MATCHES = "(SELECT DISTINCT source_id AS a, target_id AS b, ascii(right(edge_id, 1)) % 9 + 1 AS w FROM graph_edges WHERE edge_type IN ('SAME_AS', 'ALIAS_OF') AND source_id IS NOT NULL AND target_id IS NOT NULL)"
ROUNDS = 24


def _cheapest_sql(weight: str, rounds: int = ROUNDS) -> str:
    """Costs from the busiest source, by relaxing every edge as often as a path may have steps."""
    parts = [f"m AS {MATCHES}", f"e AS (SELECT a, b, min({weight}) AS w FROM (SELECT a, b, w FROM m UNION ALL SELECT b, a, w FROM m) GROUP BY 1, 2)"]
    parts.append("hub AS (SELECT source_id AS id FROM graph_edges WHERE edge_type IN ('SAME_AS', 'ALIAS_OF') AND source_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
    parts.append("r0 AS (SELECT id, 0 AS c FROM hub)")
    for i in range(1, rounds + 1):
        parts.append(f"r{i} AS (SELECT id, min(c) AS c FROM (SELECT id, c FROM r{i - 1} UNION ALL SELECT e.b, r.c + e.w FROM r{i - 1} r JOIN e ON e.a = r.id) GROUP BY 1)")
    return f"WITH {', '.join(parts)}, far AS (SELECT id FROM r4 WHERE id NOT IN (SELECT id FROM hub) ORDER BY id DESC LIMIT 1)"


def _ends(e: DataFrame) -> tuple[str, str]:
    """The busiest source, and of the vertices within four hops of it the last by id."""
    from tidegraph.operators import traverse

    src = e.where("src IS NOT NULL").groupBy("src").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "src").first()["src"]
    far = traverse.reach(e, e.sparkSession.createDataFrame([(src,)], "id string"), "both", 4).where(F.col("id") != src).orderBy(F.col("id").desc()).first()
    return src, far["id"]


def _matches(spark: SparkSession, d: str) -> DataFrame:
    e = knowledge_graph(spark, d)[1].where(F.col("type").isin("SAME_AS", "ALIAS_OF"))
    return e.select("edge_id", "src", "dst", (F.ascii(F.right("edge_id", F.lit(1))) % 9 + 1).cast("double").alias("weight"))


@query(_cheapest_sql("1") + f" SELECT hub.id AS source, far.id AS target, r.c::DOUBLE AS total_cost, r.c + 1 AS vertices FROM hub, far JOIN r{ROUNDS} r ON r.id = far.id")
def shortest_path_length(spark: SparkSession, d: str) -> DataFrame:
    e = _matches(spark, d)
    return algorithms.shortest_path(e, *_ends(e), direction="both").select("source", "target", "total_cost", F.size("node_ids").alias("vertices"))


@query(_cheapest_sql("w") + f" SELECT hub.id AS source, far.id AS target, r.c::DOUBLE AS total_cost FROM hub, far JOIN r{ROUNDS} r ON r.id = far.id")
def cheapest_path_cost(spark: SparkSession, d: str) -> DataFrame:
    e = _matches(spark, d)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return algorithms.dijkstra(e.select("src", "dst", "weight").unionByName(back), *_ends(e)).select("source", "target", "total_cost")
