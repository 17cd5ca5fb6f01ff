"""Exchange of graphs: CSV, GraphML, JSON-LD, OWL in Turtle, S-100 features.

Rows are written in parallel as text; only metadata of bounded size (property
names, the schema) is made on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.consistency import Schema


def csv_nodes(nodes: DataFrame, properties: list[str], labels: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(id, labels, properties…): labels joined by ``;``; only nodes with one of ``labels``, at most ``most`` by id."""
    n = nodes.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels)))) if labels else nodes
    n = n.orderBy("id").limit(most) if most is not None else n
    return n.select("id", F.array_join("labels", ";").alias("labels"), *[F.col("properties")[p].alias(p) for p in properties])


def csv_edges(edges: DataFrame, properties: list[str]) -> DataFrame:
    return edges.select("id", "type", "sourceId", "targetId", *[F.col("properties")[p].alias(p) for p in properties])


def property_names(df: DataFrame) -> list[str]:
    """All property names, sorted; a schema's worth, not a table's."""
    return [r["k"] for r in df.select(F.explode(F.map_keys("properties")).alias("k")).distinct().orderBy("k").collect()]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _rest(df: DataFrame, fixed: list[str]) -> Column:
    rest = [c for c in df.columns if c not in fixed]
    if not rest:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").alias("v")) for c in rest])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def read_csv_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, labels, properties) of exported nodes; all properties are text."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return df.select("id", F.split("labels", ";").alias("labels"), _rest(df, ["id", "labels"]).alias("properties"))


def read_csv_edges(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    fixed = ["id", "type", "sourceId", "targetId"]
    return df.select(*fixed, _rest(df, fixed).alias("properties"))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _data(names: list[str]) -> Column:
    each = [F.when(F.col("properties")[p].isNotNull(), F.concat(F.lit(f'<data key="{escape(p)}">'), _xml(F.col("properties")[p]), F.lit("</data>"))).otherwise("") for p in names]
    return F.concat(*each) if each else F.lit("")


def graphml(nodes: DataFrame, edges: DataFrame) -> tuple[str, DataFrame, str]:
    """(head, one element per row, tail); keys sorted by name, all values text."""
    names = sorted({*property_names(nodes), *property_names(edges)})
    keys = "".join(f'<key id="{escape(n)}" for="all" attr.name="{escape(n)}" attr.type="string"/>' for n in ("labels", "type", *names))
    head = f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph id="G" edgedefault="directed">'
    n = nodes.select(F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="labels">'), _xml(F.array_join("labels", ";")), F.lit("</data>"), _data(names), F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(F.lit('<edge id="'), _xml(F.col("id")), F.lit('" source="'), _xml(F.col("sourceId")), F.lit('" target="'), _xml(F.col("targetId")), F.lit('"><data key="type">'), _xml(F.col("type")), F.lit("</data>"), _data(names), F.lit("</edge>")).alias("value"))
    return head, n.unionByName(e), "</graph></graphml>"


def jsonld_nodes(nodes: DataFrame) -> DataFrame:
    """One JSON-LD object per row: ``@id``, ``@type`` and the properties beside them."""
    base = F.to_json(F.struct(F.concat(F.lit("urn:kg:node:"), "id").alias("@id"), F.col("labels").alias("@type")))
    rest = F.to_json("properties")
    both = F.when(rest == "{}", base).otherwise(F.concat(F.substr(base, F.lit(1), F.length(base) - 1), F.lit(","), F.substr(rest, F.lit(2))))
    return nodes.select("id", both.alias("value"))


def jsonld_edges(edges: DataFrame) -> DataFrame:
    node = lambda c: F.struct(F.concat(F.lit("urn:kg:node:"), c).alias("@id"))
    return edges.select("id", F.to_json(F.struct(F.concat(F.lit("urn:kg:edge:"), "id").alias("@id"), F.col("type").alias("@type"), node("sourceId").alias("source"), node("targetId").alias("target"))).alias("value"))


XSD = {"string": "string", "int": "integer", "bigint": "integer", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "dateTime"}


def turtle(schema: Schema, base: str = "urn:kg:ontology#") -> str:
    """OWL classes, object and datatype properties of a schema."""
    out = [f"@prefix : <{base}> .", "@prefix owl: <http://www.w3.org/2002/07/owl#> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .", "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .", ""]
    for label in sorted(schema.labels):
        parent = schema.parents.get(label)
        out.append(f":{label} a owl:Class" + (f" ; rdfs:subClassOf :{parent}" if parent else "") + " .")
    for name in sorted(schema.links):
        link = schema.links[name]
        out.append(f":{name} a owl:ObjectProperty ; rdfs:domain :{link.source} ; rdfs:range :{link.target} .")
    for label in sorted(schema.labels):
        for p, s in sorted(schema.labels[label].items()):
            out.append(f":{label}_{p} a owl:DatatypeProperty ; rdfs:domain :{label} ; rdfs:range xsd:{XSD.get(s.type, 'string')} .")
    return "\n".join(out) + "\n"


_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<mark>[;,.\[\]()])|(?P<name>(?:_:)?[^\s<>"'\[\](){};,^@]*[^\s<>"'\[\](){};,^@.])"""
)


def turtle_triples(text: str, expand: bool = False) -> list[tuple[str, str, str]]:
    """(subject, predicate, object) of a Turtle document, names as written or, with ``expand``, as IRIs.

    Prefixes, bases, lists of predicates and objects, literals with language or
    type, blank nodes in brackets and collections are read; a broken document
    raises ValueError.
    """
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"no Turtle at character {at}")
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    prefixes: dict[str, str] = {}
    out: list[tuple[str, str, str]] = []
    state = {"base": "", "blank": 0, "i": 0}

    def peek() -> tuple[str, str]:
        return tokens[state["i"]] if state["i"] < len(tokens) else ("end", "")

    def take(want: str | None = None) -> tuple[str, str]:
        t = peek()
        if t[0] == "end" or (want and t[1] != want):
            raise ValueError(f"{want or 'more'} expected at token {state['i']}")
        state["i"] += 1
        return t

    def blank() -> str:
        state["blank"] += 1
        return f"_:b{state['blank']}"

    def iri(kind: str, word: str) -> str:
        if not expand:
            return word
        if kind == "iri":
            return word if ":" in word else f"<{state['base']}{word[1:-1]}>"
        head, colon, rest = word.partition(":")
        return f"<{prefixes[head]}{rest}>" if colon and head in prefixes else word

    def node() -> str:
        kind, word = take()
        if word == "[":
            name = blank()
            if peek()[1] != "]":
                predicates(name)
            take("]")
            return name
        if word == "(":
            items = []
            while peek()[1] != ")":
                items.append(node())
            take(")")
            names = [blank() for _ in items]
            for i, (name, item) in enumerate(zip(names, items)):
                out.append((name, iri("name", "rdf:first"), item))
                out.append((name, iri("name", "rdf:rest"), names[i + 1] if i + 1 < len(names) else iri("name", "rdf:nil")))
            return names[0] if names else iri("name", "rdf:nil")
        if kind == "text":
            if peek()[0] == "lang":
                return word + take()[1]
            if peek()[0] == "type":
                take()
                return f"{word}^^{iri(*take())}"
            return word
        if kind in ("mark", "type", "lang"):
            raise ValueError(f"unexpected {word} at token {state['i']}")
        return word if kind == "number" or word in ("true", "false") else iri(kind, word)

    def predicates(subject: str) -> None:
        while True:
            kind, word = take()
            if kind not in ("name", "iri"):
                raise ValueError(f"unexpected {word} at token {state['i']}")
            verb = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>" if expand and word == "a" else iri(kind, word)
            while True:
                out.append((subject, verb, node()))
                if peek()[1] != ",":
                    break
                take()
            while peek()[1] == ";":
                take()
            if peek()[1] in (".", "]") or peek()[0] == "end":
                return

    while peek()[0] != "end":
        word = peek()[1]
        if word.lower() in ("@prefix", "prefix"):
            take()
            name, target = take()[1], take()[1]
            prefixes[name.rstrip(":")] = target[1:-1]
        elif word.lower() in ("@base", "base"):
            take()
            state["base"] = take()[1][1:-1]
        else:
            subject = node()
            if peek()[1] != ".":
                predicates(subject)
            take(".")
            continue
        if word.startswith("@"):
            take(".")
    return out


def read_turtle(spark: SparkSession, path: str, expand: bool = False) -> DataFrame:
    """(subject, predicate, object) of Turtle files, each read whole by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for text in f["value"]:
                yield pd.DataFrame(turtle_triples(text, expand), columns=["subject", "predicate", "object"], dtype=object)

    return spark.read.text(path, wholetext=True).mapInPandas(run, "subject string, predicate string, object string")


def map_features(features: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, label, properties) of features (id, product, feature, attributes map) by mapping (product, feature, label, names map).

    ``names`` maps attribute names to property names; other attributes are left out, unmapped features too.
    """
    m = features.join(mapping, ["product", "feature"])
    known = F.map_filter("attributes", lambda k, _: F.map_contains_key("names", k))
    return m.select("id", "label", F.transform_keys(known, lambda k, _: F.col("names")[k]).alias("properties"))
