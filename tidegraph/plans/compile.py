"""From a structured query to one lazy DataFrame plan.

The base label is alias ``n``; hops are ``h1``, ``h2`` and so on, or what they are
named. Columns are named ``alias_property``. Filters on a vertex are applied to
its scan before any join, so they reach the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.graph import PropertyGraph
from tidegraph.plans.ir import AGGREGATES, Filter, Hop, Intent, Sort, StructuredQuery, predicate


def _split(name: str) -> tuple[str, str]:
    alias, dot, prop = name.partition(".")
    return (alias, prop) if dot else ("n", name)


def column_name(name: str) -> str:
    alias, prop = _split(name)
    return f"{alias}_{prop}"


def _vertex(graph: PropertyGraph, label: str, alias: str, filters: list[Filter]) -> DataFrame:
    df = graph.label(label)
    for f in filters:
        df = df.where(predicate(F.col(_split(f.field)[1]), f.op, f.value))
    return df.select(*[F.col(c).alias(f"{alias}_{c}") for c in df.columns])


def steps(graph: PropertyGraph, hop: Hop) -> DataFrame:
    """(_from, _to) pairs of a hop; in ``both`` directions a loop counts once."""
    e = graph.edges[hop.type]
    out = e.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    back = e.select(F.col("dst").alias("_from"), F.col("src").alias("_to"))
    if hop.direction == "outgoing":
        return out
    if hop.direction == "incoming":
        return back
    return out.unionByName(back.where("_from <> _to"))


def bind(graph: PropertyGraph, q: StructuredQuery) -> DataFrame:
    """All bindings of the pattern, one row each."""
    if q.project:
        graph = graph.scoped(q.project)
    own = lambda alias: [f for f in q.filters if _split(f.field)[0] == alias]
    rows, at = _vertex(graph, q.label, "n", own("n")), "n"
    for i, hop in enumerate(q.hops, 1):
        alias = hop.alias or f"h{i}"
        target = _vertex(graph, hop.label, alias, [*hop.filters, *([] if hop.optional else own(alias))])
        reached = steps(graph, hop).join(target, F.col("_to") == F.col(f"{alias}_id")).drop("_to")
        start = "n" if q.shape == "star" else at
        rows = rows.join(reached, F.col(f"{start}_id") == F.col("_from"), "left" if hop.optional else "inner").drop("_from")
        if hop.optional:
            for f in own(alias):
                rows = rows.where(predicate(F.col(column_name(f.field)), f.op, f.value))
        at = alias
    return rows


def order(df: DataFrame, sorts: tuple[Sort, ...], last: list[str]) -> DataFrame:
    """Sorted with nulls as the largest value, and by ``last`` where the keys tie."""
    keys = []
    for s in sorts:
        name = s.field if s.field in df.columns else column_name(s.field)
        keys.append(F.col(name).desc_nulls_first() if s.descending else F.col(name).asc_nulls_last())
    return df.orderBy(*keys, *[F.col(c) for c in last])


def compile_query(graph: PropertyGraph, q: StructuredQuery) -> DataFrame:
    if problems := q.problems():
        raise ValueError("; ".join(problems))
    rows = bind(graph, q)
    if q.intent is Intent.COUNT:
        return rows.agg(F.count("*").alias("count"))
    if q.aggregates:
        made = [AGGREGATES[a.function.lower()](F.lit(1) if a.field == "*" else F.col(column_name(a.field))).alias(a.name) for a in q.aggregates]
        keys = [column_name(g) for g in q.group_by]
        rows = rows.groupBy(*keys).agg(*made)
        last = keys
    else:
        wanted = [column_name(f) for f in q.fields] or [c for c in rows.columns if c.startswith("n_")]
        hidden = [c for c in ("n_id", *(f"{h.alias or f'h{i}'}_id" for i, h in enumerate(q.hops, 1)))]
        extra = [c for c in (*hidden, *(column_name(s.field) for s in q.sorts)) if c not in wanted]
        rows, last = rows.select(*wanted, *dict.fromkeys(extra)), hidden
    if q.sorts or q.limit is not None or q.offset:
        rows = order(rows, q.sorts, last)
    if q.offset:
        rows = rows.offset(q.offset)
    if q.limit is not None:
        rows = rows.limit(q.limit)
    return rows if q.aggregates else rows.select(*wanted)
