"""Validity in time. Bounds are closed; an open end is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def at_time(t, born: str = "valid_from", died: str = "valid_to") -> Column:
    if t is None:
        raise ValueError("a point in time is needed")
    return (F.col(born) <= F.lit(t)) & (F.col(died).isNull() | (F.col(died) >= F.lit(t)))


def between(start, end, born: str = "valid_from", died: str = "valid_to") -> Column:
    """Valid at some time from ``start`` to ``end``."""
    if start is None or end is None:
        raise ValueError("a range needs both ends")
    if start > end:
        raise ValueError("the range ends before it starts")
    return (F.col(born) <= F.lit(end)) & (F.col(died).isNull() | (F.col(died) >= F.lit(start)))


def current(now, died: str = "valid_to") -> Column:
    """Not ended at ``now``; the time is fixed when the plan is made."""
    return F.col(died).isNull() | (F.col(died) >= F.lit(now))


as_of = at_time


def with_history(df: DataFrame) -> DataFrame:
    return df


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, since: str, values: list[str], bucket: str = "MONTH") -> DataFrame:
    """Each left row with the values of the last right row of its key not after it (null if there is none).

    Rows of a key are sorted within buckets of time, so a key with a large share of
    all rows is spread over its buckets. What a bucket inherits from the ones before
    it comes from one row per key and bucket. Keys and times that are null match nothing.
    """
    t = lambda c: F.date_trunc(bucket, F.col(c)) if dict(left.dtypes)[at] in ("timestamp", "timestamp_ntz", "date") else F.lit(None).cast("timestamp")
    l = left.withColumns({"_t": F.col(at), "_b": t(at), "_side": F.lit(1)})  # noqa: E741
    r = right.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key), F.col(since).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    r = r.withColumn("_b", t("_t"))
    per = l.select(key, "_b", F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.lit(None).cast(r.schema["_t"].dataType).alias("_t")).unionByName(r.select(key, "_b", "_v", "_t")).groupBy(key, "_b").agg(F.max_by("_v", "_t").alias("_v"))
    carried = per.withColumn("_c", F.last("_v", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), "_c")
    w = Window.partitionBy(key, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1 ")
    out = both.join(carried, (F.col(key) == F.col("_k")) & F.col("_b").eqNullSafe(F.col("_kb")), "left").withColumn("_v", F.coalesce("_v", "_c"))
    out = out.withColumn("_v", F.when(F.col("_t").isNotNull(), F.col("_v")))
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"_v.{v}").alias(v) for v in values])
