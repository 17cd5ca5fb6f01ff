"""The queries of parts, held against their SQL on the smallest tables, and the scratch tables."""

import glob
import os

import pytest

from tidegraph.plans import scratch, skew
from tidegraph.queries import parts

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(parts.ORACLES))
def test_part(spark, engine, name):
    df = parts.QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = engine.execute(parts.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(at) == columns
    assert got == sorted(repr([plain(r[at[c]]) for c in columns]) for r in found.fetchall())


def test_scope_drops_what_it_does_not_keep(spark):
    with scratch.Scope() as outer:
        with scratch.Scope() as inner:
            a, b = scratch.materialise(spark.range(3), "a"), inner.keep(scratch.materialise(spark.range(4), "b"))
        assert not os.path.exists(a._scratch_path) and b.count() == 4
    assert not os.path.exists(b._scratch_path) and not scratch._OPEN and outer.made


def test_no_shared_folder_on_a_cluster():
    class Unset:
        master, applicationId = "spark://host:7077", "x"
        get = staticmethod(lambda *a: None)
        getConf = lambda self: self

    class Session:
        conf = sparkContext = Unset()

    with pytest.raises(RuntimeError):
        scratch.scratch_dir(Session())


def test_salts_follow_the_rows(spark):
    counts = spark.createDataFrame([("a", 1000), ("b", 99), ("c", 250)], "k string, n int")
    hot = skew.hot_keys(counts, ["k"], hot_rows=100)
    assert {(r.k, r._salts) for r in hot.collect()} == {("a", 11), ("c", 4)}
    big = spark.createDataFrame([(k, i) for k, n in (("a", 50), ("b", 5), ("c", 9), (None, 2)) for i in range(n)], "k string, i int")
    small = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    from pyspark.sql import functions as F

    joined = skew.spread(big, hot, ["k"], F.col("i")).join(skew.repeat(small, hot, ["k"]), ["k", "_salt"])
    assert sorted((r.k, r.i, r.v) for r in joined.collect()) == sorted((k, i, v) for k, n, v in (("a", 50, 1), ("b", 5, 2), ("c", 9, 3)) for i in range(n))
    assert skew.hot_keys(counts, ["k"], hot_rows=5000) is None
