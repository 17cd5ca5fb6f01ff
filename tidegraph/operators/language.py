"""Names and relations in text, and questions in plain language turned into structured queries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import terms
from tidegraph.operators.consistency import Schema
from tidegraph.plans.ir import Aggregate, Filter, Hop, Intent, Sort, StructuredQuery

#: Entries that a dictionary sent to every task may have.
MAX_DICTIONARY = 1_000_000
#: Keywords that are tested beside each other in one expression.
MAX_KEYWORDS = 500


def tag(texts: DataFrame, entries: DataFrame, longest: bool = True) -> DataFrame:
    """(id, term, kind, start, stop): every occurrence of dictionary entries (term, kind) in texts (id, text).

    ASCII letters match in either case and occurrences may overlap; with
    ``longest`` only those stay that no longer one (or an earlier one of the same
    length) overlaps. The dictionary becomes one automaton per task; a larger one
    than ``MAX_DICTIONARY`` is refused.
    """
    n = entries.count()
    if n > MAX_DICTIONARY:
        raise ValueError(f"a dictionary of {n} entries is more than the {MAX_DICTIONARY} that may be sent to every task")
    known = entries.select("term", "kind").where("term <> ''").distinct().orderBy("term", "kind").toPandas()
    shared = texts.sparkSession.sparkContext.broadcast(list(zip(known["term"], known["kind"])))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, term string, kind string, start int, stop int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        by_form: dict[str, list[tuple[str, str]]] = {}
        for term, kind in shared.value:
            by_form.setdefault(_fold(term), []).append((term, kind))
        auto = ahocorasick.Automaton()
        for form, meant in by_form.items():
            auto.add_word(form, (len(form), meant))
        if by_form:
            auto.make_automaton()
        for f in frames:
            rows = []
            for i, t in zip(f["id"], f["text"]):
                if not t or not by_form:
                    continue
                found = [(term, kind, end + 1 - n, end + 1) for end, (n, meant) in auto.iter(_fold(t)) for term, kind in meant]
                rows += [(i, *x) for x in (keep_longest(found) if longest else sorted(found, key=lambda x: (x[2], x[3], x[0])))]
            yield pd.DataFrame(rows, columns=["id", "term", "kind", "start", "stop"])

    return texts.select("id", "text").mapInPandas(run, schema)


def _fold(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def keep_longest(found: list[tuple[str, str, int, int]]) -> list[tuple[str, str, int, int]]:
    """Occurrences without those that a longer, or an equally long earlier one, overlaps."""
    kept: list[tuple[str, str, int, int]] = []
    for x in sorted(found, key=lambda x: (x[2] - x[3], x[2], x[0], x[1])):
        if all(x[3] <= k[2] or k[3] <= x[2] for k in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[2])


def keyword_relations(texts: DataFrame, keywords: DataFrame, width: int = 30) -> DataFrame:
    """(id, target, relation, confidence, context) of keywords (keyword, target, relation, confidence) found in texts (id, text).

    A target and relation count once per text, with the keyword of the highest
    confidence. Keywords are a short list, so they are tested beside each other in
    one pass over the texts.
    """
    rows = [r.asDict() for r in keywords.select("keyword", "target", "relation", "confidence").orderBy("keyword", "target").limit(MAX_KEYWORDS + 1).collect()]
    if len(rows) > MAX_KEYWORDS:
        raise ValueError(f"more than {MAX_KEYWORDS} keywords; use tag() for dictionaries")
    place = lambda k: F.locate(k, F.lower("text")) if k.isascii() else F.locate(k, F.col("text"))
    each = [
        F.when(
            place(r["keyword"].lower() if r["keyword"].isascii() else r["keyword"]) > 0,
            F.struct(F.lit(r["target"]).alias("target"), F.lit(r["relation"]).alias("relation"), F.lit(float(r["confidence"])).alias("confidence"), F.lit(r["keyword"]).alias("keyword"), place(r["keyword"].lower() if r["keyword"].isascii() else r["keyword"]).alias("at")),
        )
        for r in rows
    ]
    hits = texts.select("id", "text", F.explode(F.array_compact(F.array(*each))).alias("h"))
    start = F.greatest(F.lit(1), F.col("h.at") - width)
    context = F.substr("text", start, F.col("h.at") - start + F.length("h.keyword") + width)
    flat = hits.select("id", "h.target", "h.relation", "h.confidence", "h.keyword", context.alias("context"))
    best = flat.groupBy("id", "target", "relation").agg(F.max_by(F.struct("confidence", "context"), F.struct("confidence", "keyword")).alias("b"))
    return best.select("id", "target", "relation", "b.confidence", "b.context")


def verify_mentions(mentions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, mentioned, known, unknown, confidence): which names (id, name) of an answer the vocabulary (name) has."""
    v = vocabulary.select(F.lower("name").alias("k"), F.lit(True).alias("ok")).distinct()
    j = mentions.select("id", "name", F.lower("name").alias("k")).distinct().join(v, "k", "left")
    per = j.groupBy("id").agg(F.count("*").alias("mentioned"), F.count("ok").alias("known"), F.array_sort(F.collect_set(F.when(F.col("ok").isNull(), F.col("name")))).alias("unknown"))
    return per.withColumn("confidence", F.round(F.col("known") / F.col("mentioned"), 4))


def component_recall(expected: DataFrame, got: DataFrame) -> DataFrame:
    """(question, recall): share of expected (question, part) that got (question, part) has; 1 where nothing is expected."""
    hit = expected.distinct().join(got.distinct().withColumn("hit", F.lit(1)), ["question", "part"], "left")
    return hit.groupBy("question").agg(F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


# Validation and correction of structured queries ------------------------------------------------------


@dataclass(frozen=True)
class Finding:
    errors: tuple[str, ...]
    warnings: tuple[str, ...]

    @property
    def score(self) -> float:
        return max(0.0, round(1 - 0.3 * len(self.errors) - 0.1 * len(self.warnings), 4))


def check_query(q: StructuredQuery, schema: Schema) -> Finding:
    """Labels, link types, directions and properties of a query against a schema."""
    errors, warnings = list(q.problems()), []
    labels = {"n": q.label} | {h.alias or f"h{i}": h.label for i, h in enumerate(q.hops, 1)}
    errors += [f"unknown label {v}" for v in dict.fromkeys(labels.values()) if v not in schema.labels]
    at = q.label
    for h in q.hops:
        link = schema.links.get(h.type)
        if link is None:
            errors.append(f"unknown link {h.type}")
        else:
            ends = (link.source, link.target) if h.direction == "outgoing" else (link.target, link.source)
            if h.direction != "both" and (at, h.label) != ends:
                errors.append(f"{h.type} doesn't lead from {at} to {h.label} in direction {h.direction}")
        at = h.label if q.shape == "chain" else q.label
    for name in [f.field for f in q.filters] + [a.field for a in q.aggregates if a.field != "*"] + list(q.group_by) + list(q.fields):
        alias, dot, prop = name.partition(".")
        alias, prop = (alias, prop) if dot else ("n", name)
        if alias not in labels:
            errors.append(f"unknown alias {alias}")
        elif prop != "id" and labels[alias] in schema.labels and prop not in schema.labels[labels[alias]]:
            warnings.append(f"{labels[alias]} has no property {prop}")
    if q.limit is None and q.intent is Intent.FIND:
        warnings.append("no limit")
    return Finding(tuple(dict.fromkeys(errors)), tuple(dict.fromkeys(warnings)))


def correct_query(q: StructuredQuery, schema: Schema) -> StructuredQuery:
    """Labels and link types in the schema's spelling."""
    from dataclasses import replace

    fix = lambda n: schema.resolve(n) or n
    return replace(q, label=fix(q.label), hops=tuple(replace(h, type=fix(h.type), label=fix(h.label)) for h in q.hops))


_WRITES = re.compile(r"\b(?:insert|update|delete|drop|truncate|alter|create|merge|replace|grant|revoke|set|reset|add|refresh|cache|uncache|load|copy)\b", re.I)


def read_only(sql: str) -> str:
    """The statement, if it only reads; an error otherwise."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", re.sub(r"'(?:[^']|'')*'", "''", sql), flags=re.S).strip()
    if not re.match(r"(?:select|with|values|table|describe|show|explain)\b", bare, re.I) or ";" in bare.rstrip(";") or _WRITES.search(bare):
        raise ValueError("only reading statements are allowed")
    return sql


# Questions ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Terms:
    """What words of a language mean in a graph."""

    labels: dict[str, str] = field(default_factory=dict)
    links: dict[str, tuple[str, str, str]] = field(default_factory=dict)  #: word -> (link type, target label, direction)
    properties: dict[str, str] = field(default_factory=dict)
    values: dict[str, tuple[str, str]] = field(default_factory=dict)  #: word -> (property, value)
    units: dict[str, tuple[str, float]] = field(default_factory=dict)  #: unit -> (property, factor)


def maritime_terms(links: dict[str, tuple[str, str, str]] | None = None) -> Terms:
    """The words of :mod:`tidegraph.functions.terms`; ``links`` adds what link words lead to."""
    values = {w: (p, v) for p, words in terms.VALUES.items() for w, v in words.items() if w not in terms.LABELS}
    return Terms(terms.LABELS, links or {}, {w: p for w, p in (("톤수", "tonnage"), ("길이", "length"), ("속력", "speed"), ("속도", "speed"))}, values, terms.UNITS)


_COUNT = re.compile(r"how many|number of|count|몇|개수|수는", re.I)
_FUNCTIONS = {"average": "avg", "mean": "avg", "평균": "avg", "total": "sum", "sum of": "sum", "합계": "sum", "highest": "max", "maximum": "max", "최대": "max", "lowest": "min", "minimum": "min", "최소": "min"}
_COMPARE = [(r"at least|or more|이상", ">="), (r"at most|or less|up to|이하", "<="), (r"more than|over|above|greater than|초과", ">"), (r"less than|under|below|미만", "<")]
_LIMIT = re.compile(r"\b(?:top|first)\s+(\d+)|상위\s*(\d+)|(\d+)\s*개만", re.I)


@dataclass(frozen=True)
class Parsed:
    query: StructuredQuery | None
    confidence: float
    unread: tuple[str, ...]
    reasoning: str


def _found(text: str, words) -> list[tuple[int, str]]:
    """Words of the text by place, the longest first where they overlap."""
    hits, out = [], []
    for w in words:
        for m in re.finditer(re.escape(w.lower()) + (r"(?:s|es)?\b" if w.isascii() else ""), text):
            hits.append((m.start(), m.end(), w))
    for s, e, w in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        if all(e <= a or b <= s for a, b, _ in out):
            out.append((s, e, w))
    return [(s, w) for s, e, w in sorted(out)]


def parse_question(text: str, known: Terms) -> Parsed:
    """A structured query for a question: labels and links by their words, comparisons by number and comparator."""
    low = text.lower()
    labels = _found(low, known.labels)
    links = _found(low, known.links)
    props = _found(low, known.properties)
    if not labels:
        return Parsed(None, 0.0, (text,), "none")
    base = known.labels[labels[0][1]]
    hops = tuple(Hop(*known.links[w][:2], direction=known.links[w][2]) for _, w in links)
    filters = [Filter(p, "=", v) for _, w in _found(low, known.values) for p, v in [known.values[w]]]
    unread = []
    for m in re.finditer(r"\d+(?:[.,]\d+)*", low):
        if any(a <= m.start() < b for x in _LIMIT.finditer(low) for a, b in [x.span()]):
            continue
        near = low[max(0, m.start() - 25) : m.start()] + " " + low[m.end() : m.end() + 12]
        unit = next((u for u in sorted(known.units, key=len, reverse=True) if re.match(rf"\s*{re.escape(u)}(?![a-z])", low[m.end() :])), None)
        if unit:
            after = low[m.end() : m.end() + len(unit) + 12]
            name, factor = known.units[unit]
            filters.append(Filter(name, next((o for rx, o in _COMPARE if re.search(rx, after)), "="), float(m[0].replace(",", "")) * factor))
            continue
        op = next((o for rx, o in _COMPARE if re.search(rx, near)), None)
        prop = min(props, key=lambda p: abs(p[0] - m.start()), default=None)
        if op and prop:
            filters.append(Filter(known.properties[prop[1]], op, float(m[0].replace(",", ""))))
        else:
            unread.append(m[0])
    function = next((f for w, f in _FUNCTIONS.items() if w in low), None)
    limit = next((int(next(g for g in m.groups() if g)) for m in [_LIMIT.search(low)] if m), None)
    kw: dict = {"filters": tuple(filters), "hops": hops, "limit": limit}
    if _COUNT.search(low):
        kw |= {"intent": Intent.COUNT, "limit": None}
    elif function and props and limit is None:
        kw |= {"intent": Intent.AGGREGATE, "aggregates": (Aggregate(function, known.properties[props[-1][1]], "value"),)}
    elif limit is not None and props:
        kw["sorts"] = (Sort(known.properties[props[-1][1]], "lowest" not in low and "최소" not in low),)
    kinds = len({known.labels[w] for _, w in labels})
    reasoning = "composition" if len(hops) > 1 else "bridge" if hops else "comparison" if re.search(r"\bthan\b.*\b(?:or|and)\b|비교", low) else "intersection" if kinds > 1 else "direct"
    known = 0.5 + 0.15 * bool(hops or kinds == 1) + 0.15 * bool(filters) + 0.2 * (not unread)
    return Parsed(StructuredQuery(base, **kw), round(min(1.0, known), 2), tuple(unread), reasoning)

