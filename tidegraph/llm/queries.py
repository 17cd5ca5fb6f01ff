"""Queries of the problems whose operators live in this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import encodings, entities, groups, packing, pieces, spam, tokens
from tidegraph.plans.scratch import scratch_path


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return entities.organisation_pairs(entities.records(_t(spark, d, "organizations"), _t(spark, d, "extracted_relations")))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return entities.organisation_groups(entities.records(_t(spark, d, "organizations"), _t(spark, d, "extracted_relations")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_restored(spark, d).select("doc_id", "field_name").distinct()


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.garbled_fields(_t(spark, d, "kg_documents"), "doc_id", ["title", "content"])


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_texts(_t(spark, d, "kg_documents"), "doc_id", "content")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 1").select("doc_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """The contents of each document type as one file, split by byte ranges; files are named by their type."""
    docs = _t(spark, d, "kg_documents").where("content IS NOT NULL")
    folder = scratch_path(spark, "texts")
    typed = docs.select(F.coalesce("doc_type", F.lit("none")).alias("type"), "doc_id", F.concat("content", F.lit("\n")).alias("value"))
    typed.repartition("type").sortWithinPartitions("type", "doc_id").select("type", "value").write.partitionBy("type").text(folder)
    got = pieces.split_files(spark, f"{folder}/type=*/*.txt", range_bytes=1 << 16)
    return got.withColumn("path", F.regexp_extract("path", "type=([^/]*)/", 1))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    matches = _t(spark, d, "graph_edges").where(F.col("edge_type").isin("SAME_AS", "ALIAS_OF"))
    return groups.linked_groups(matches, "source_id", "target_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(_t(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_t(spark, d, "documents"), "doc_id", "text")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p8_containers(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(_t(spark, d, "documents"), "doc_id", "text", "lang").select("doc_id").distinct()


def p9_figures(spark: SparkSession, d: str) -> DataFrame:
    return spam.page_figures(_t(spark, d, "documents"), "doc_id", "text", "lang")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p3_found": p3_found, "p3_restored": p3_restored, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_files": p4_files, "p6_found": p6_found, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_report": p8_report, "p9_found": p9_found, "p9_figures": p9_figures}

ORACLES = {
    "p4_found": "SELECT doc_id FROM kg_documents WHERE length(content) > 512",
    "p6_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT source_id AS a, target_id AS b FROM graph_edges WHERE edge_type IN ('SAME_AS', 'ALIAS_OF') AND source_id IS NOT NULL AND target_id IS NOT NULL
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
SELECT least(a, min(b)) AS group_id, a AS record_id FROM reach GROUP BY a""",
}
