"""Intermediate tables that survive the loss of an executor.

Iterative operators cut their lineage by writing a table to the folder all
executors share. A Parquet table is preferred to an RDD checkpoint because the
planner then knows its size, which lets it choose a broadcast join where that
is safe and a shuffle join where it is not.

Operators drop the tables they no longer need; the rest, which a result still
reads, is deleted when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_BASES: dict[str, str] = {}


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only in local mode, where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _BASES:
        _BASES[app] = tempfile.mkdtemp(prefix="tidegraph-")
    return _BASES[app]


def _base(spark: SparkSession) -> str:
    """This application's folder, deleted when the driver ends."""
    base = f"{scratch_dir(spark)}/tidegraph/{spark.sparkContext.applicationId}"
    if base not in _BASES:
        fs, p = _file_system(spark, base)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _BASES[base] = base
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's folder."""
    return f"{_base(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of that table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    for scope in _OPEN:
        scope.made.append(out)
    return out


class Scope:
    """Drops at its end the tables made inside it, but for those it keeps.

    What an operator returns may read kept tables only.
    """

    def __init__(self) -> None:
        self.made: list[DataFrame] = []
        self.kept: set[str] = set()

    def __enter__(self) -> "Scope":
        _OPEN.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._scratch_path)
        return df

    def __exit__(self, kind, error, trace) -> None:
        _OPEN.remove(self)
        drop_scratch(*[t for t in self.made if t._scratch_path not in self.kept])


_OPEN: list[Scope] = []


def drop_scratch(*tables: DataFrame) -> None:
    """Delete the files behind tables that :func:`materialise` returned and no result reads any more."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            fs, p = _file_system(df.sparkSession, path)
            fs.delete(p, True)
