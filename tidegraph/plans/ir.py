"""The structured query: what is asked, apart from how it runs."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Intent(str, Enum):
    FIND = "find"
    COUNT = "count"
    AGGREGATE = "aggregate"
    PATH = "path"


class Op(str, Enum):
    EQ = "="
    NE = "<>"
    CONTAINS = "contains"
    STARTS = "starts_with"
    ENDS = "ends_with"
    GT = ">"
    GE = ">="
    LT = "<"
    LE = "<="
    IN = "in"
    NOT_IN = "not_in"
    NULL = "is_null"
    NOT_NULL = "is_not_null"
    REGEX = "matches_regex"
    SAME = "same"
    ICONTAINS = "icontains"


ALIASES = {"eq": Op.EQ, "==": Op.EQ, "neq": Op.NE, "!=": Op.NE, "gt": Op.GT, "gte": Op.GE, "lt": Op.LT, "lte": Op.LE, "in_list": Op.IN, "not_in_list": Op.NOT_IN, "regex": Op.REGEX, "=~": Op.REGEX}


def operator(name: str | Op) -> Op:
    """The operator of a name or alias; an unknown name is an error, never an equality."""
    if isinstance(name, Op):
        return name
    if name in ALIASES:
        return ALIASES[name]
    try:
        return Op(name)
    except ValueError:
        raise ValueError(f"unknown operator {name!r}") from None


def predicate(column: Column, op: str | Op, value: Any = None) -> Column:
    """A filter with three-valued logic: a null never passes, but for the null tests and ``same``."""
    match operator(op):
        case Op.EQ:
            return column == value
        case Op.NE:
            return column != value
        case Op.CONTAINS:
            return column.contains(value)
        case Op.ICONTAINS:
            return F.lower(column).contains(str(value).lower())
        case Op.STARTS:
            return column.startswith(value)
        case Op.ENDS:
            return column.endswith(value)
        case Op.GT:
            return column > value
        case Op.GE:
            return column >= value
        case Op.LT:
            return column < value
        case Op.LE:
            return column <= value
        case Op.IN:
            return column.isin(list(value))
        case Op.NOT_IN:
            return ~column.isin(list(value))
        case Op.NULL:
            return column.isNull()
        case Op.NOT_NULL:
            return column.isNotNull()
        case Op.REGEX:  # the whole string must match
            return column.rlike(f"^(?:{value})$")
        case Op.SAME:  # null equals null
            return column.eqNullSafe(F.lit(value))
    raise AssertionError(op)


@dataclass(frozen=True)
class Filter:
    field: str
    op: str | Op = Op.EQ
    value: Any = None


@dataclass(frozen=True)
class Hop:
    """A step along an edge type; ``filters`` of an optional hop restrict the hop, not the row."""

    type: str
    label: str
    direction: str = "outgoing"
    alias: str = ""
    optional: bool = False
    filters: tuple[Filter, ...] = ()


AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.countDistinct, "collect": lambda c: F.array_sort(F.collect_list(c)), "distinct": lambda c: F.array_sort(F.collect_set(c))}


@dataclass(frozen=True)
class Aggregate:
    function: str
    field: str = "*"
    alias: str = ""

    @property
    def name(self) -> str:
        return self.alias or self.function


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class StructuredQuery:
    label: str
    intent: Intent = Intent.FIND
    filters: tuple[Filter, ...] = ()
    hops: tuple[Hop, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    group_by: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    sorts: tuple[Sort, ...] = ()
    limit: int | None = None
    offset: int = 0
    #: ``chain``: every hop starts where the last one ended; ``star``: at the base.
    shape: str = "chain"
    project: str | None = None
    notes: dict = field(default_factory=dict)

    def problems(self) -> list[str]:
        """What is wrong with the query, whatever graph it is for."""
        out = []
        if self.limit is not None and self.limit < 0:
            out.append("limit is negative")
        if self.offset < 0:
            out.append("offset is negative")
        if self.shape not in ("chain", "star"):
            out.append(f"unknown shape {self.shape}")
        for h in self.hops:
            if h.direction not in ("outgoing", "incoming", "both"):
                out.append(f"unknown direction {h.direction}")
        for a in self.aggregates:
            if a.function.lower() not in AGGREGATES:
                out.append(f"unknown aggregate {a.function}")
        for f in (*self.filters, *(g for h in self.hops for g in h.filters)):
            try:
                operator(f.op)
            except ValueError as e:
                out.append(str(e))
        if self.intent is Intent.AGGREGATE and not self.aggregates:
            out.append("an aggregate query needs an aggregate")
        return out

    def complexity(self) -> str:
        """How heavy the query is: hops and grouping weigh more than filters."""
        weight = 2 * len(self.hops) + len(self.aggregates) + bool(self.group_by) + (len(self.filters) > 2)
        return "simple" if weight <= 1 else "moderate" if weight <= 4 else "complex"


class Query:
    """Fluent construction of a :class:`StructuredQuery`; each call returns a new builder."""

    def __init__(self, label: str, _q: StructuredQuery | None = None):
        self._q = _q or StructuredQuery(label)

    def _with(self, **kw) -> "Query":
        return Query(self._q.label, replace(self._q, **kw))

    def where(self, field: str, op: str | Op = Op.EQ, value: Any = None) -> "Query":
        return self._with(filters=(*self._q.filters, Filter(field, op, value)))

    def hop(self, type_: str, label: str, direction: str = "outgoing", alias: str = "", optional: bool = False, filters: tuple[Filter, ...] = ()) -> "Query":
        return self._with(hops=(*self._q.hops, Hop(type_, label, direction, alias, optional, tuple(filters))))

    def star(self) -> "Query":
        return self._with(shape="star")

    def select(self, *fields: str) -> "Query":
        return self._with(fields=fields)

    def count(self) -> "Query":
        return self._with(intent=Intent.COUNT)

    def group_by(self, *fields: str) -> "Query":
        return self._with(group_by=fields, intent=Intent.AGGREGATE)

    def agg(self, function: str, field: str = "*", alias: str = "") -> "Query":
        return self._with(aggregates=(*self._q.aggregates, Aggregate(function, field, alias)), intent=Intent.AGGREGATE)

    def order_by(self, field: str, descending: bool = False) -> "Query":
        return self._with(sorts=(*self._q.sorts, Sort(field, descending)))

    def limit(self, n: int) -> "Query":
        return self._with(limit=n)

    def skip(self, n: int) -> "Query":
        return self._with(offset=n)

    def for_project(self, name: str) -> "Query":
        return self._with(project=name)

    def build(self) -> StructuredQuery:
        if problems := self._q.problems():
            raise ValueError("; ".join(problems))
        return self._q


def encode_cursor(position: dict[str, Any]) -> str:
    return base64.urlsafe_b64encode(json.dumps(position, sort_keys=True).encode()).decode()


def decode_cursor(cursor: str) -> dict[str, Any]:
    try:
        out = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except Exception as e:
        raise ValueError("not a cursor") from e
    if not isinstance(out, dict):
        raise ValueError("not a cursor")
    return out


def after(position: dict[str, Any], columns: list[str]) -> Column:
    """Keyset page: rows behind ``position`` in ascending order of ``columns``."""
    out = F.lit(False)
    for c in reversed(columns):
        v = F.lit(position[c])
        out = (F.col(c) > v) | ((F.col(c) == v) & out)
    return out
