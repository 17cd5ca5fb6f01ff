"""Tables that pipelines keep: raw records, run states, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def put_raw(records: DataFrame, path: str, source: str, day: Column) -> None:
    """Records (id, payload) as JSON, partitioned by source and day of arrival."""
    records.select("id", "payload", F.lit(source).alias("source"), day.cast("date").alias("ingest_date")).write.mode("append").partitionBy("source", "ingest_date").json(path)


def raw(spark: SparkSession, path: str, source: str | None = None, since=None) -> DataFrame:
    """(key, id, payload, source, ingest_date); filters prune partitions."""
    df = spark.read.schema("id string, payload string, source string, ingest_date date").json(path)
    if source:
        df = df.where(F.col("source") == source)
    if since is not None:
        df = df.where(F.col("ingest_date") >= F.lit(since))
    return df.withColumn("key", F.concat_ws("/", "source", F.date_format("ingest_date", "yyyy-MM-dd"), F.concat("id", F.lit(".json"))))


def delete_raw(spark: SparkSession, path: str, source: str) -> bool:
    """Drop a source's partition."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/source={source}")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def current_runs(log: DataFrame) -> DataFrame:
    """The latest state of each run from an append-only log (run_id, at, …)."""
    rest = [c for c in log.columns if c != "run_id"]
    return log.groupBy("run_id").agg(F.max_by(F.struct(*rest), F.col("at")).alias("s")).select("run_id", "s.*")


def history(log: DataFrame, pipeline: str, limit: int = 20) -> DataFrame:
    return current_runs(log.where(F.col("pipeline") == pipeline)).orderBy(F.col("at").desc(), "run_id").limit(limit)


def append_letters(letters: DataFrame, path: str) -> None:
    letters.write.mode("append").json(path)


def letters(spark: SparkSession, path: str) -> DataFrame:
    """Stored dead letters; lines that can't be read are left out."""
    return spark.read.schema("source string, payload string, errors array<string>, failed_at timestamp, retries int").option("mode", "DROPMALFORMED").json(path)


def page(rows: DataFrame, order: list[Column], skip: int, size: int) -> DataFrame:
    """``size`` rows behind the first ``skip`` in order, each with the ``total`` of all; only that many rows are sorted out."""
    return rows.orderBy(*order).offset(skip).limit(size).withColumn("total", F.lit(rows.count()))
