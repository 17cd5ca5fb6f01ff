"""Loading pipelines: validation, normalisation, incremental filters, upserts, dead letters, runs.

A pipeline is one lazy plan. Each row carries an array of errors; the rows without
errors and those with them are two filters of the same plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidegraph.functions.text import SPACES, normal_space

ERRORS = "_errors"
Rule = Callable[[DataFrame], Column]


def required(*fields: str) -> Rule:
    """Missing or blank fields; one error each, in the order given."""

    def rule(df: DataFrame) -> Column:
        each = []
        for f in fields:
            c = F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string")
            each.append(F.when(c.isNull(), F.lit(f"missing field: {f}")).when(F.trim(c) == "", F.lit(f"blank field: {f}")))
        return F.array_compact(F.array(*each))

    return rule


def typed(**kinds: str) -> Rule:
    """Values that can't be read as their type; null passes."""

    def rule(df: DataFrame) -> Column:
        each = [F.when(F.col(f).isNotNull() & F.expr(f"try_cast(`{f}` AS {k})").isNull(), F.lit(f"wrong type: {f} is no {k}")) for f, k in kinds.items() if f in df.columns]
        return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")

    return rule


def known_label(field_: str, labels: list[str]) -> Rule:
    def rule(df: DataFrame) -> Column:
        c = F.col(field_)
        return F.array_compact(F.array(F.when(c.isNull(), F.lit("missing label")).when(~c.isin(labels), F.concat(F.lit("unknown label: "), c))))

    return rule


def validate(df: DataFrame, *rules: Rule) -> DataFrame:
    """``_errors``: the errors of all rules, in their order."""
    parts = [r(df) for r in rules]
    return df.withColumn(ERRORS, F.flatten(F.array(*parts)) if parts else F.array().cast("array<string>"))


def text_normal(*fields: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({f: normal_space(F.col(f)) for f in fields if f in df.columns})


def moment(c: Column) -> Column:
    """A time from ISO forms, a Korean date and time, or a date found anywhere (midnight); null if none is real."""
    iso = F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])
    korean = "(\\d{4})년\\s*(\\d{1,2})월\\s*(\\d{1,2})일(?:\\s*(\\d{1,2})시(?:\\s*(\\d{1,2})분)?)?"
    found = "(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})"
    part = lambda rx, i: F.coalesce(F.nullif(F.regexp_extract(c, rx, i), F.lit("")), F.lit("0")).cast("int")
    of = lambda rx, h, m: F.when(c.rlike(rx), F.try_make_timestamp(part(rx, 1), part(rx, 2), part(rx, 3), h, m, F.lit(0)))
    return F.coalesce(iso, of(korean, part(korean, 4), part(korean, 5)), of(found, F.lit(0), F.lit(0)))


def time_normal(*fields: str) -> Callable[[DataFrame], DataFrame]:
    """ISO text of the times; what can't be read stays as it is."""

    def step(df: DataFrame) -> DataFrame:
        return df.withColumns({f: F.coalesce(F.date_format(moment(F.col(f)), "yyyy-MM-dd'T'HH:mm:ss"), F.col(f)) for f in fields if f in df.columns})

    return step


def id_normal(field_: str, prefix: str) -> Callable[[DataFrame], DataFrame]:
    """Trimmed, behind ``prefix-`` unless it begins with the prefix."""

    def step(df: DataFrame) -> DataFrame:
        c = F.trim(F.col(field_))
        return df.withColumn(field_, F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(f"{prefix}-"), c)))

    return step


def incremental(df: DataFrame, change: str | None, since: str | None) -> DataFrame:
    """Rows at or behind the last change, compared as text; rows without one stay."""
    if not change or since is None:
        return df
    return df.where(F.col(change).isNull() | (F.col(change).cast("string") >= since))


def upsert(target: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``target`` with the rows of ``new`` merged by key, as rows that follow each other.

    ``new`` has (key, order, properties map<string,string>); ``target`` (key, properties).
    A later row's entries replace earlier ones, an entry that is null removes the
    property, one that is absent leaves it.
    """
    entries = new.where(F.col(key).isNotNull()).select(key, order, F.explode("properties").alias("p", "v"))
    last = entries.groupBy(key, "p").agg(F.max_by(F.struct("v"), F.col(order)).alias("s")).select(key, "p", F.col("s.v").alias("v"), F.lit(1).alias("n"))
    old = target.select(key, F.explode("properties").alias("p", "v"), F.lit(0).alias("n"))
    now = old.unionByName(last).groupBy(key, "p").agg(F.max_by(F.struct("v"), F.col("n")).alias("s")).where("s.v IS NOT NULL")
    made = now.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "s.v")))).alias("properties"))
    keys = target.select(key).unionByName(new.where(F.col(key).isNotNull()).select(key)).distinct()
    return keys.join(made, key, "left").select(key, F.coalesce("properties", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("properties"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


@dataclass
class Pipeline:
    """Incremental filter, validation, transforms, load."""

    name: str
    rules: tuple[Rule, ...] = ()
    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    change_field: str | None = None
    counters: dict = field(default_factory=dict)

    def plan(self, rows: DataFrame, since: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows to load, dead letters)."""
        checked = validate(incremental(rows, self.change_field, since), *self.rules)
        good = checked.where(F.size(ERRORS) == 0).drop(ERRORS)
        for s in self.steps:
            good = s(good)
        bad = checked.where(F.size(ERRORS) > 0)
        return good, bad

    def counts(self, rows: DataFrame, since: str | None = None) -> DataFrame:
        """One row: read, filtered out, failed, loaded, in one pass."""
        kept = F.lit(True) if not self.change_field or since is None else F.col(self.change_field).isNull() | (F.col(self.change_field).cast("string") >= since)
        c = validate(rows, *self.rules).withColumn("_kept", kept)
        bad = F.size(ERRORS) > 0
        return c.agg(F.count("*").alias("read"), F.count_if(~F.col("_kept")).alias("filtered"), F.count_if(F.col("_kept") & bad).alias("failed"), F.count_if(F.col("_kept") & ~bad).alias("loaded"))

    def run(self, rows: DataFrame, load: Callable[[DataFrame], None], dead: Callable[[DataFrame], None] | None = None, since: str | None = None) -> dict:
        """Load the good rows, store the dead letters; counters are observed on the way. A failing loader fails the run."""
        good, bad = self.plan(rows, since)
        seen = Observation(f"{self.name}-loaded")
        load(good.observe(seen, F.count(F.lit(1)).alias("loaded")))
        self.counters = {"loaded": seen.get["loaded"]}
        if dead:
            lost = Observation(f"{self.name}-failed")
            dead(bad.observe(lost, F.count(F.lit(1)).alias("failed")))
            self.counters["failed"] = lost.get["failed"]
        return self.counters


class Pipelines:
    """Registered pipelines by name."""

    def __init__(self) -> None:
        self._by_name: dict[str, tuple[Pipeline, str]] = {}

    def register(self, p: Pipeline, schedule: str = "") -> None:
        self._by_name[p.name] = (p, schedule)

    def get(self, name: str) -> Pipeline:
        if name not in self._by_name:
            raise KeyError(f"unknown pipeline {name!r}; known: {', '.join(sorted(self._by_name))}")
        return self._by_name[name][0]

    def names(self) -> list[tuple[str, str]]:
        return [(n, s) for n, (_, s) in sorted(self._by_name.items())]


def dead_letters(bad: DataFrame, at: Column, source: str) -> DataFrame:
    """(source, payload, errors, failed_at, retries) of rows with errors."""
    plain = [c for c in bad.columns if c != ERRORS]
    return bad.select(F.lit(source).alias("source"), F.to_json(F.struct(*plain)).alias("payload"), F.col(ERRORS).alias("errors"), at.alias("failed_at"), F.lit(0).alias("retries"))


def retryable(letters: DataFrame, most: int = 3) -> DataFrame:
    return letters.where(F.col("retries") < most)


def retried(letters: DataFrame) -> DataFrame:
    return letters.withColumn("retries", F.col("retries") + 1)


BLANK = SPACES
