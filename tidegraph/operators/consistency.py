"""Checks of a graph against its schema; each is one aggregate or anti-join, reported as rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.traverse import degrees


@dataclass(frozen=True)
class Property:
    type: str = "string"
    required: bool = False
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Link:
    source: str
    target: str
    least: int = 0
    most: int | None = None


@dataclass(frozen=True)
class Schema:
    """Labels with their properties, edge types with their ends, and a hierarchy of labels."""

    labels: dict[str, dict[str, Property]] = field(default_factory=dict)
    links: dict[str, Link] = field(default_factory=dict)
    parents: dict[str, str] = field(default_factory=dict)

    def problems(self, needed: tuple[str, ...] = ()) -> list[str]:
        """What is wrong with the schema itself."""
        out = [] if self.labels else ["the schema has no labels"]
        out += [f"label {n} is missing" for n in needed if n not in self.labels]
        out += [f"link {k} ends at unknown label {e}" for k, v in self.links.items() for e in (v.source, v.target) if e not in self.labels]
        out += [f"label {k} has no properties" for k, v in self.labels.items() if not v]
        out += [f"label {k} has unknown parent {p}" for k, p in self.parents.items() if p not in self.labels]
        return out

    def ancestors(self, label: str) -> list[str]:
        out: list[str] = []
        while (label := self.parents.get(label, "")) and label not in out:
            out.append(label)
        return out

    def descendants(self, label: str) -> list[str]:
        return sorted(k for k in self.labels if label in self.ancestors(k))

    def resolve(self, name: str) -> str | None:
        """The label or link of that name, whatever its case."""
        known = {k.lower(): k for k in (*self.labels, *self.links)}
        return name if name in self.labels or name in self.links else known.get(name.lower())


def required_nulls(rows: DataFrame, properties: dict[str, Property]) -> DataFrame:
    """(property, missing, total) of all required properties, in one pass."""
    needed = [p for p, s in properties.items() if s.required]
    missing = [F.count_if(F.col(p).isNull()).alias(p) if p in rows.columns else F.count("*").alias(p) for p in needed]
    one = rows.agg(F.count("*").alias("_n"), *missing)
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).alias("missing"), F.col("_n").alias("total")) for p in needed])).alias("r")).select("r.*")


def wrong_types(rows: DataFrame, properties: dict[str, Property]) -> DataFrame:
    """(property, type, wrong): values that can't be read as their type."""
    typed = [(p, s.type) for p, s in properties.items() if p in rows.columns]
    one = rows.agg(*[F.count_if(F.col(p).isNotNull() & F.expr(f"try_cast(`{p}` AS {k})").isNull()).alias(p) for p, k in typed])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.lit(k).alias("type"), F.col(p).alias("wrong")) for p, k in typed])).alias("r")).select("r.*")


def enum_violations(rows: DataFrame, properties: dict[str, Property], samples: int = 5) -> DataFrame:
    """(property, violations, samples): values outside the listed ones, with the first few of them."""
    listed = [(p, s.values) for p, s in properties.items() if s.values and p in rows.columns]
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.when(~F.col(p).isin(list(v)), F.col(p).cast("string")).alias("value")) for p, v in listed])).alias("r")).select("r.*")
    per = long.where("value IS NOT NULL").groupBy("property", "value").agg(F.count("*").alias("n"))  # pre-aggregated, so a task holds distinct values only
    return per.groupBy("property").agg(F.sum("n").alias("violations"), F.slice(F.array_sort(F.collect_set("value")), 1, samples).alias("samples"))


def cardinality(vertices: DataFrame, edges: DataFrame, least: int, most: int | None) -> DataFrame:
    """(id, degree, problem) of vertices with too few or too many edges."""
    d = degrees(vertices, edges)
    problem = F.when(F.col("degree") < least, "too few")
    if most is not None:
        problem = problem.when(F.col("degree") > most, "too many")
    return d.withColumn("problem", problem).where("problem IS NOT NULL")


def orphan_rate(vertices: DataFrame, edges: DataFrame, most: float = 0.1) -> DataFrame:
    """(vertices, orphans, rate, passed)."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct().withColumn("_linked", F.lit(True))
    one = vertices.join(ends, "id", "left").agg(F.count("*").alias("vertices"), F.count_if(F.col("_linked").isNull()).alias("orphans"))
    rate = F.when(F.col("vertices") > 0, F.col("orphans") / F.col("vertices")).otherwise(0.0)
    return one.withColumn("rate", F.round(rate, 6)).withColumn("passed", rate <= most)


def edge_profile(edges: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """(type, source_label, target_label, edges): kinds of links, all or the ``limit`` commonest; labels is (id, label)."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("source_label"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("target_label"))
    p = edges.join(a, "src", "left").join(b, "dst", "left").groupBy("type", "source_label", "target_label").agg(F.count("*").alias("edges"))
    return p.orderBy(F.col("edges").desc(), "type", "source_label", "target_label").limit(limit) if limit is not None else p


def dangling(profile: DataFrame, known: list[str]) -> DataFrame:
    """Kinds of links with an end that is missing or of an unknown label."""
    bad = lambda c: F.col(c).isNull() | ~F.col(c).isin(known)
    return profile.where(bad("source_label") | bad("target_label"))


Check = Callable[[], tuple[str, str, str]]


def run(spark: SparkSession, checks: dict[str, Check], only: list[str] | None = None) -> DataFrame:
    """(name, status, severity, message) of the checks; one that breaks is reported as failed."""
    rows = []
    for name, check in checks.items():
        if only and name not in only:
            continue
        try:
            rows.append((name, *check()))
        except Exception as e:
            rows.append((name, "FAILED", "ERROR", str(e)[:500]))
    return spark.createDataFrame(rows, "name string, status string, severity string, message string")


def passed(report: DataFrame) -> bool:
    return report.where("status = 'FAILED'").isEmpty()


def schema_alignment(schema: Schema, present: list[str]) -> tuple[list[str], list[str]]:
    """(labels of the schema that the graph lacks, labels of the graph that the schema lacks)."""
    return sorted(set(schema.labels) - set(present)), sorted(set(present) - set(schema.labels))
