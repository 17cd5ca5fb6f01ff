"""References to records that do not exist (problem 5).

``orphan_references`` reduces the references to their distinct non-null keys
first (count, earliest and latest use; combined before the shuffle), anti-joins
those with the parents' lives and keeps the *suspect* keys: the ones no single
life covers from first to last use. Only references with a suspect key are
joined back and tested row by row, each against the lives of its own key.

Defined results: a null reference is no reference; an empty-string key is a
reference like any other; a null time is covered only by a parent that always
exists; repeated reference rows give one case; empty tables give no cases (an
empty parent table makes every reference a case).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.plans import skew
from tidegraph.plans.scratch import materialise

REF_COLUMNS = ("child_table", "field_name", "record_id", "parent_table", "ref_key", "at")
LIFE_COLUMNS = ("parent_table", "ref_key", "born", "died")
KEY = ["parent_table", "ref_key"]


def references(child: DataFrame, table: str, record: str, at: str, fields: dict[str, str]) -> DataFrame:
    """One row per non-null reference; ``fields`` maps a column to its parent table."""
    each = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(p).alias("p"), child[f].cast("string").alias("k")) for f, p in fields.items()])
    return (
        child.select(child[record].cast("string").alias("record_id"), child[at].alias("at"), F.explode(each).alias("r"))
        .where("r.k IS NOT NULL")
        .select(F.lit(table).alias("child_table"), F.col("r.f").alias("field_name"), "record_id", F.col("r.p").alias("parent_table"), F.col("r.k").alias("ref_key"), "at")
    )


def lives(parent: DataFrame, table: str, key: str, born: str | None = None, died: str | None = None) -> DataFrame:
    """Distinct lives of a parent; no ``born`` column means that it always existed."""
    ts = F.lit(None).cast("timestamp_ntz")
    return parent.where(parent[key].isNotNull()).select(
        F.lit(table).alias("parent_table"),
        parent[key].cast("string").alias("ref_key"),
        (parent[born] if born else ts).alias("born"),
        (parent[died] if died else ts).alias("died"),
    )


def orphan_references(refs: DataFrame, parents: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Distinct (child_table, field_name, record_id, ref_key, at, reason) without a live target.

    ``reason`` is ``missing`` where no parent row has the key, else ``not_alive``.
    """
    parents = parents.select(*LIFE_COLUMNS).distinct()
    used = refs.groupBy(*KEY).agg(F.count("*").alias("n"), F.count("at").alias("n_at"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    u, p = used.alias("u"), parents.alias("p")
    same = (F.col("u.parent_table") == F.col("p.parent_table")) & (F.col("u.ref_key") == F.col("p.ref_key"))
    timed = F.col("u.n") == F.col("u.n_at")
    covers = (F.col("p.born").isNull() | (timed & (F.col("p.born") <= F.col("u.first_at")))) & (F.col("p.died").isNull() | (timed & (F.col("p.died") > F.col("u.last_at"))))
    suspects = materialise(u.join(p, same & covers, "left_anti").select("u.parent_table", "u.ref_key", "u.n"), "suspect-keys")

    hot = skew.hot_keys(suspects, KEY, "n", hot_rows)
    rows = skew.spread(refs, hot, KEY, F.col("record_id")).join(skew.repeat(suspects.drop("n"), hot, KEY), [*KEY, "_salt"])
    known = skew.repeat(parents.withColumn("known", F.lit(True)), hot, KEY)
    # One more exchange is not needed: both joins are on (key, salt).
    r, k = rows.alias("r"), known.alias("k")
    on = (F.col("r.parent_table") == F.col("k.parent_table")) & (F.col("r.ref_key") == F.col("k.ref_key")) & (F.col("r._salt") == F.col("k._salt"))
    alive = (F.col("k.born").isNull() | (F.col("k.born") <= F.col("r.at"))) & (F.col("k.died").isNull() | (F.col("k.died") > F.col("r.at")))
    dead = r.join(k, on & alive, "left_anti")
    keys = known.select("parent_table", "ref_key", "_salt", "known").distinct()
    return (
        dead.join(keys, [*KEY, "_salt"], "left")
        .select("child_table", "field_name", "record_id", "ref_key", "at", F.when(F.col("known"), "not_alive").otherwise("missing").alias("reason"))
        .distinct()
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per child table, field, month of the reference and reason."""
    return orphans.groupBy("child_table", "field_name", F.date_format("at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("orphans"))
