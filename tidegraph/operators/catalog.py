"""Catalog entries: search, history, quality scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRESH_DAYS, STALE_DAYS = 30, 365


def search(entries: DataFrame, text: str, fields: list[str], key: str) -> DataFrame:
    """Entries with the text in a field, whatever the case, ordered by the first field."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.lower(f).contains(text.lower()), F.lit(False))
    return entries.where(hit).orderBy(F.lower(fields[0]), key)


def freshness(updated: Column, now) -> Column:
    """1 up to ``FRESH_DAYS`` of age, falling to 0 at ``STALE_DAYS``; 0 without a date."""
    age = F.datediff(F.lit(now), updated)
    part = 1 - (age - FRESH_DAYS) / F.lit(float(STALE_DAYS - FRESH_DAYS))
    return F.when(age.isNull() | (age >= STALE_DAYS), F.lit(0.0)).when(age <= FRESH_DAYS, F.lit(1.0)).otherwise(F.round(part, 4))


def quality(entries: DataFrame, key: str, required: list[str], updated: str, consistent: Column, now) -> DataFrame:
    """(key, completeness, accuracy, freshness, consistency, overall)."""
    filled = sum((F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", 1).otherwise(0) for c in required), F.lit(0))
    out = entries.select(
        key,
        F.round(filled / F.lit(float(len(required))), 4).alias("completeness"),
        F.lit(1.0).alias("accuracy"),
        freshness(F.col(updated), now).alias("freshness"),
        F.when(consistent, 1.0).otherwise(0.0).alias("consistency"),
    )
    mean = (F.col("completeness") + F.col("accuracy") + F.col("freshness") + F.col("consistency")) / 4
    return out.withColumn("overall", F.round(mean + 1e-9, 4))  # halves go up whatever their binary form


def history(versions: DataFrame, key: str, at: str) -> DataFrame:
    """Versions numbered per entry, and whether each is the latest."""
    w = Window.partitionBy(key).orderBy(at)
    return versions.withColumn("version", F.row_number().over(w)).withColumn("latest", F.lead(at).over(w).isNull())


def upsert(entries: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Entries with those of ``new`` in place of, or beside, the old ones."""
    return entries.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
