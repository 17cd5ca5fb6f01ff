"""Row transforms that a workflow is made of, and the graph of steps that runs them."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SLOT = re.compile(r"\{\{\s*([\w.]+)\s*\}\}")


class WorkflowError(RuntimeError):
    """The steps can't be run in any order, or one of them failed."""


def path(df: DataFrame, dotted: str) -> Column:
    """A nested value by a dotted path over structs, maps and list positions; null where it is missing."""
    from pyspark.sql import types as T

    first, *rest = dotted.split(".")
    if first not in df.columns:
        return F.lit(None).cast("string")
    col, kind = F.col(f"`{first}`"), df.schema[first].dataType
    for step in rest:
        if isinstance(kind, T.ArrayType) and step.isdigit():
            col, kind = F.get(col, F.lit(int(step))), kind.elementType
        elif isinstance(kind, T.MapType):
            col, kind = col[step], kind.valueType
        elif isinstance(kind, T.StructType) and step in kind.names:
            col, kind = col[step], kind[step].dataType
        else:
            return F.lit(None).cast("string")
    return col


def template(df: DataFrame, text: str, output: str) -> DataFrame:
    """``output`` becomes the text with its ``{{names}}`` filled; a column of that name in the rows wins."""
    if output in df.columns:
        return df
    parts, at = [], 0
    for m in _SLOT.finditer(text):
        parts += [F.lit(text[at : m.start()]), F.coalesce(path(df, m[1]).cast("string"), F.lit("None"))]
        at = m.end()
    return df.withColumn(output, F.concat(*parts, F.lit(text[at:])))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def select(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[n for n in names if n in df.columns])


def extract(df: DataFrame, dotted: str, output: str) -> DataFrame:
    return df.withColumn(output, path(df, dotted))


def keep(df: DataFrame, field: str, op: str, value) -> DataFrame:
    """Rows that pass eq, neq, contains, gt or lt; ``eq`` and ``neq`` treat null as a value."""
    c = path(df, field)
    tests: dict[str, Callable[[], Column]] = {
        "eq": lambda: c.eqNullSafe(F.lit(value)),
        "neq": lambda: ~c.eqNullSafe(F.lit(value)),
        "contains": lambda: c.cast("string").contains(str(value)),
        "gt": lambda: c > value,
        "lt": lambda: c < value,
    }
    if op not in tests:
        raise WorkflowError(f"unknown test {op!r}")
    return df.where(tests[op]())


def split_text(df: DataFrame, field: str, separator: str) -> DataFrame:
    """One row per part that isn't blank, with its position; the rows' own ``text`` and ``index`` win."""
    parts = F.split(F.col(field), re.escape(separator))
    rest = [c for c in df.columns if c != field]
    out = df.select(*rest, F.posexplode(parts).alias("_i", "_t")).where(F.trim("_t") != "")
    made = [x for x in (("text", "_t"), ("index", "_i")) if x[0] not in rest]
    return out.select(*rest, *[F.col(b).alias(a) for a, b in made])


def merge_rows(df: DataFrame, order: str) -> DataFrame:
    """One row: of every column the value of the last row."""
    return df.agg(*[F.max_by(F.struct(c), F.col(order))[c].alias(c) for c in df.columns])


def fan_in(*inputs: DataFrame) -> DataFrame:
    """All rows of the inputs; columns that one lacks are null there."""
    out = inputs[0]
    for df in inputs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def static_input(spark: SparkSession, mode: str, text: str) -> DataFrame:
    """Rows of a text: ``text`` one row, ``list`` a row per line that isn't blank, ``json`` the parsed value."""
    base = spark.range(1).select(F.lit(text).alias("text"))
    if mode == "text":
        return base
    if mode == "list":
        return split_text(base.withColumnRenamed("text", "_all"), "_all", "\n").select("index", F.trim("text").alias("text"))
    if mode == "json":
        kind = spark.range(1).select(F.schema_of_json(F.lit(text)).alias("s")).first()["s"]
        many = kind.upper().startswith("ARRAY")
        value = F.from_json("text", kind)
        out = base.select(F.explode(value).alias("v") if many else value.alias("v"))
        return out.select("v.*") if dict(out.dtypes)["v"].startswith("struct") else out.withColumnRenamed("v", "value")
    raise WorkflowError(f"unknown mode {mode!r}")


def order_of(needs: Mapping[str, list[str]]) -> list[str]:
    """Steps after what they need, ties by name; a circle is an error that names its steps."""
    left = {k: {n for n in v if n in needs} for k, v in needs.items()}
    out: list[str] = []
    while left:
        ready = sorted(k for k, v in left.items() if not v)
        if not ready:
            raise WorkflowError(f"steps in a circle: {', '.join(sorted(left))}")
        out += ready
        left = {k: v - set(ready) for k, v in left.items() if k not in ready}
    return out


class Workflow:
    """Named steps over DataFrames. Plans are built lazily; only a sink runs them."""

    def __init__(self) -> None:
        self.steps: dict[str, tuple[Callable[..., DataFrame], list[str]]] = {}

    def add(self, name: str, step: Callable[..., DataFrame], *needs: str) -> "Workflow":
        if name in self.steps:
            raise WorkflowError(f"step {name!r} exists")
        self.steps[name] = (step, list(needs))
        return self

    def run(self, cancelled: Callable[[], bool] = lambda: False) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """Results and states; after the first failure or a cancellation the other steps are skipped."""
        results: dict[str, DataFrame] = {}
        states = dict.fromkeys(self.steps, "skipped")
        for name in order_of({k: v[1] for k, v in self.steps.items()}):
            if cancelled():
                states[name] = "cancelled"
                break
            step, needs = self.steps[name]
            inputs = [results[n] for n in needs]
            try:
                results[name] = step(*([fan_in(*inputs)] if len(inputs) > 1 else inputs))
                states[name] = "completed"
            except Exception as e:
                states[name] = f"failed: {e}"
                break
        return results, states
