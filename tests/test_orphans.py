import datetime as dt
import random

from tidegraph.operators import orphans

DAY = dt.datetime(2024, 1, 1)


def d(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def run(spark, refs, lives, **kw):
    r = spark.createDataFrame([("c", "f", i, "p", k, d(t)) for i, k, t in refs], "child_table string, field_name string, record_id string, parent_table string, ref_key string, at timestamp_ntz")
    p = spark.createDataFrame([("p", k, d(b), d(e)) for k, b, e in lives], "parent_table string, ref_key string, born timestamp_ntz, died timestamp_ntz")
    return {(x["record_id"], x["reason"]) for x in orphans.orphan_references(r, p, **kw).collect()}


def test_lives(spark):
    lives = [("a", 1, 5), ("a", 8, None), ("a", 8, None), ("always", None, None)]
    refs = [("1", "a", 0), ("2", "a", 1), ("3", "a", 5), ("4", "a", 6), ("5", "a", 8), ("6", "z", 3), ("6", "z", 3), ("7", "always", None), ("8", "a", None), ("9", "", 3)]
    assert run(spark, refs, lives) == {("1", "not_alive"), ("3", "not_alive"), ("4", "not_alive"), ("6", "missing"), ("8", "not_alive"), ("9", "missing")}


def test_empty_tables(spark):
    assert run(spark, [], [("a", 1, None)]) == set()
    assert run(spark, [("1", "a", 2)], []) == {("1", "missing")}


def test_hot_keys_against_brute_force(spark):
    rng = random.Random(5)
    lives = [(str(k), b := rng.randrange(20), rng.choice([None, b + rng.randrange(1, 20)])) for k in range(12) for _ in range(rng.randrange(3))]
    refs = [(str(i), str(rng.choice([0, 0, 0, 1, *range(15)])), rng.randrange(40)) for i in range(600)]
    alive = lambda k, t: any(k == q and b <= t and (e is None or e > t) for q, b, e in lives)
    want = {(i, "not_alive" if any(k == q for q, _, _ in lives) else "missing") for i, k, t in refs if not alive(k, t)}
    assert run(spark, refs, lives) == want
    assert run(spark, refs, lives, hot_rows=20) == want


def test_references_drop_nulls_only(spark):
    df = spark.createDataFrame([(1, None, "", DAY)], "id long, a string, b string, at timestamp_ntz")
    got = orphans.references(df, "t", "id", "at", {"a": "p", "b": "q"}).collect()
    assert [(r.field_name, r.parent_table, r.ref_key, r.record_id) for r in got] == [("b", "q", "", "1")]
