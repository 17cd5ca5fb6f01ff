"""p2 and p5: rows that fail to parse, references without a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import badrows, orphans


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return badrows.parse_records(_t(spark, d, "raw_import_lines"), "record_kind", "raw_line", ["line_id"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.rejected(_parsed(spark, d)).select(F.col("_key_line_id").alias("line_id")).distinct()


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    return badrows.rejected(_parsed(spark, d)).groupBy("reason").agg(F.count("*").alias("rows_rejected"))


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return badrows.loaded(_parsed(spark, d)).select(F.col("_key_line_id").alias("line_id"), "id", F.array_join("labels", ";").alias("labels"), "type", "source_id", "target_id")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = orphans.references(_t(spark, d, "relationship_requests"), "relationship_requests", "request_id", "requested_at", {"source_id": "graph_nodes", "target_id": "graph_nodes"}).unionByName(
        orphans.references(_t(spark, d, "workflow_executions"), "workflow_executions", "execution_id", "started_at", {"workflow_id": "workflows"})
    )
    parents = (
        orphans.lives(_t(spark, d, "graph_nodes"), "graph_nodes", "node_id", "created_at", "deleted_at")
        .unionByName(orphans.lives(_t(spark, d, "port_nodes"), "graph_nodes", "port_id"))
        .unionByName(orphans.lives(_t(spark, d, "workflows"), "workflows", "wf_id", "created_at", "deleted_at"))
    )
    return orphans.orphan_references(refs, parents)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("child_table", "field_name", "record_id").distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, d))


_B = "[ \\t]*"
_D = "[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2}:[0-9]{2}:[0-9]{2}Z)?"


def _field(pattern: str, wrap: bool = False) -> str:
    p = f"({pattern})" if wrap else f"(?:{pattern})"
    return f'(?:{_B}{p}{_B}|"{p}")'


_NAME = '(?:[^",\\r\\n]*|"(?:[^"]|"")*")'
_LABEL = "[A-Z][A-Za-z0-9]*"
_END = _field("n[0-9]{12}|port-[A-Z]{5}")
_NODE = ",".join([_field("n[0-9]{12}"), _field(f"{_LABEL}(?:;{_LABEL})*"), _NAME, _field(f"(?:{_D})?", True)])
_EDGE = ",".join([_field("e[0-9]{12}"), _field("[A-Z][A-Z_0-9]*"), _END, _END, _field(f"(?:{_D})?", True), _NAME])


def _valid_sql() -> str:
    """Rows with the text of their moment, null where the whole layout doesn't match."""
    pick = lambda kind, rx: f"CASE WHEN record_kind = '{kind}' AND regexp_full_match(raw_line, '{rx}') THEN coalesce(nullif(regexp_extract(raw_line, '^{rx}$', 1), ''), regexp_extract(raw_line, '^{rx}$', 2)) END"
    return f"SELECT *, coalesce({pick('node', _NODE)}, {pick('edge', _EDGE)}) AS moment FROM raw_import_lines"


_REAL = "(moment IS NOT NULL AND (moment = '' OR (length(moment) = 10 AND try_strptime(moment, '%Y-%m-%d') IS NOT NULL) OR (length(moment) = 20 AND try_strptime(moment, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL)))"

#: The first fields of a valid row hold no comma and no quote mark of their own.
_AT = lambda i: f"trim(string_split(raw_line, ',')[{i}], ' \"' || chr(9))"
_OF = lambda kind, i: f"CASE WHEN record_kind = '{kind}' THEN {_AT(i)} END"

_REFS = """
refs AS (
  SELECT 'relationship_requests' AS child_table, 'source_id' AS field_name, CAST(request_id AS VARCHAR) AS record_id, source_id AS k, requested_at AS used_at FROM relationship_requests WHERE source_id IS NOT NULL
  UNION ALL SELECT 'relationship_requests', 'target_id', CAST(request_id AS VARCHAR), target_id, requested_at FROM relationship_requests WHERE target_id IS NOT NULL
  UNION ALL SELECT 'workflow_executions', 'workflow_id', execution_id, workflow_id, started_at FROM workflow_executions WHERE workflow_id IS NOT NULL
), lives AS (
  SELECT 'relationship_requests' AS child_table, node_id AS k, created_at AS born, deleted_at AS died FROM graph_nodes
  UNION ALL SELECT 'relationship_requests', port_id, NULL, NULL FROM port_nodes
  UNION ALL SELECT 'workflow_executions', wf_id, created_at, deleted_at FROM workflows
), dead AS (
  SELECT DISTINCT r.*, NOT EXISTS (SELECT 1 FROM lives l WHERE l.child_table = r.child_table AND l.k = r.k) AS missing
  FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM lives l WHERE l.child_table = r.child_table AND l.k = r.k
      AND (l.born IS NULL OR l.born <= r.used_at) AND (l.died IS NULL OR l.died > r.used_at))
)"""

QUERIES = {"p2_found": p2_found, "p2_reasons": p2_reasons, "p2_loaded": p2_loaded, "p5_found": p5_found, "p5_counts": p5_counts}

ORACLES = {
    "p2_found": f"SELECT DISTINCT line_id FROM ({_valid_sql()}) WHERE NOT {_REAL}",
    "p2_loaded": f"SELECT line_id, {_AT(1)} AS id, {_OF('node', 2)} AS labels, {_OF('edge', 2)} AS type, {_OF('edge', 3)} AS source_id, {_OF('edge', 4)} AS target_id FROM ({_valid_sql()}) WHERE {_REAL}",
    "p5_found": f"WITH {_REFS} SELECT DISTINCT child_table, field_name, record_id FROM dead",
    "p5_counts": f"WITH {_REFS} SELECT child_table, field_name, strftime(used_at, '%Y-%m') AS month, CASE WHEN missing THEN 'missing' ELSE 'not_alive' END AS reason, count(*) AS orphans FROM dead GROUP BY ALL",
}
