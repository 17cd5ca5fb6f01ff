"""Joins in which one key may hold a large share of the rows.

Every key with ``hot_rows`` rows or more is spread over as many salts as it has
multiples of ``hot_rows``: the rows of the large side get a salt from a hash of a
row-unique column, the rows of the small side are repeated once per salt. Only
hot keys pay for the repetition, and no key is left out: there are at most
``rows / hot_rows`` of them. Their table is written first, so the planner knows
its size and broadcasts it by its own threshold; beyond that it is joined by a
shuffle, whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.scratch import drop_scratch, materialise

HOT_ROWS = 200_000


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """(keys, _salts) of the keys with ``hot_rows`` rows or more; None if there is none."""
    hot = materialise(counts.where(F.col(n) >= hot_rows).select(*keys, F.ceil(F.col(n) / hot_rows + 1).cast("int").alias("_salts")), "hot-keys")
    if hot.isEmpty():
        drop_scratch(hot)
        return None
    return hot


def spread(df: DataFrame, hot: DataFrame | None, keys: list[str], by: Column) -> DataFrame:
    """The large side: ``_salt`` is a hash of ``by`` for hot keys and 0 otherwise."""
    if hot is None:
        return df.withColumn("_salt", F.lit(0))
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(by), F.col("_salts")).cast("int")).otherwise(F.lit(0))
    return df.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")


def repeat(df: DataFrame, hot: DataFrame | None, keys: list[str]) -> DataFrame:
    """The small side: one row per salt for hot keys, one row otherwise."""
    if hot is None:
        return df.withColumn("_salt", F.lit(0))
    every = F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
    return df.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_salts")
