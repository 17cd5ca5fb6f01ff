"""Lineage of records: what is recorded at which level, and what came from what.

Events are rows (event_type, src, dst, at, …); a node is ``type:id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.traverse import paths, reach

# Event types recorded at each level; levels of data classes 1 to 5; levels with snapshots.
LEVEL_EVENTS = {
    "none": [],
    "minimal": ["creation", "deletion"],
    "standard": ["creation", "transformation", "deletion", "merge"],
    "detailed": ["creation", "transformation", "derivation", "ingestion", "deletion", "merge", "split"],
    "full": None,
}
CLASS_LEVELS = {1: "minimal", 2: "standard", 3: "standard", 4: "detailed", 5: "full"}
SNAPSHOT_LEVELS = ("detailed", "full")


def node(kind: Column, id_: Column) -> Column:
    return F.concat_ws(":", kind, id_.cast("string"))


def level_of(data_class: Column) -> Column:
    out = F.lit("standard")
    for k, v in CLASS_LEVELS.items():
        out = F.when(data_class == k, v).otherwise(out)
    return out


def is_recorded(level: Column, event: Column) -> Column:
    out = F.lit(False)
    for name, events in LEVEL_EVENTS.items():
        hit = F.lit(True) if events is None else event.isin(events) if events else F.lit(False)
        out = F.when(level == name, hit).otherwise(out)
    return out


def record(events: DataFrame, level: Column) -> DataFrame:
    """The events that their level records; an event of one record is a loop."""
    return events.where(is_recorded(level, F.col("event_type"))).withColumn("dst", F.coalesce("dst", "src"))


def snapshots(rows: DataFrame, level: Column, key: str) -> DataFrame:
    """(key, snapshot): the row as JSON, where the level keeps snapshots."""
    return rows.where(level.isin(*SNAPSHOT_LEVELS)).select(key, F.to_json(F.struct(*rows.columns)).alias("snapshot"))


def ancestors(events: DataFrame, start: DataFrame) -> DataFrame:
    """(root, id, depth): everything the roots were derived from, nearest distance; the root itself never counts."""
    return reach(events.where("src <> dst"), start, "incoming").where("root <> id")


def descendants(events: DataFrame, start: DataFrame) -> DataFrame:
    return reach(events.where("src <> dst"), start, "outgoing").where("root <> id")


def at_depths(events: DataFrame, start: DataFrame, most: int = 3, direction: str = "outgoing") -> DataFrame:
    """(root, id, depth) with every depth up to ``most`` at which a node is reached."""
    return paths(events.where("src <> dst"), start, 1, most, direction).select("root", "id", F.col("length").alias("depth")).distinct()


def subgraph(events: DataFrame, start: DataFrame) -> DataFrame:
    """Events between the roots, their ancestors and their descendants."""
    ids = ancestors(events, start).select("id").unionByName(descendants(events, start).select("id")).unionByName(start.select("id")).distinct()
    return events.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def full(events: DataFrame, start: DataFrame) -> DataFrame:
    """One row per root: its ancestors and descendants, and the events between them all."""
    up = ancestors(events, start).groupBy("root").agg(F.array_sort(F.collect_set("id")).alias("ancestors"))
    down = descendants(events, start).groupBy("root").agg(F.array_sort(F.collect_set("id")).alias("descendants"))
    return start.select(F.col("id").alias("root")).distinct().join(up, "root", "left").join(down, "root", "left")


def timeline(events: DataFrame, start: DataFrame) -> DataFrame:
    """(root, event_type, other, at): events at a node in either direction, by time."""
    s = start.select(F.col("id").alias("root")).distinct()
    out = events.join(s, F.col("src") == F.col("root")).select("root", "event_type", F.col("dst").alias("other"), "at")
    into = events.where("src <> dst").join(s, F.col("dst") == F.col("root")).select("root", "event_type", F.col("src").alias("other"), "at")
    return out.unionByName(into).orderBy("root", "at", "event_type", "other")
