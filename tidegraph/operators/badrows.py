"""Rows that fail to parse (problem 2).

Each raw line is assembled into logical records with regard to quotes, read by
Python's strict ``csv`` reader inside ``mapInArrow``, and only then handed to
the typed field constructors. Structural faults are caught before any field is
typed, so a row carries exactly one reason: the first in the order null line,
quoting, record count, column count, field.

Defined results: a null or empty line is invalid; an unknown or null record
kind is invalid; a line ending at the end of the text only closes the record; a
line break inside quotes belongs to the field; repeated rows are judged alike.
"""

from __future__ import annotations

import csv
import datetime as dt
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t"
#: A line with its end; other separators of Unicode are text.
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+")
NODE_ID = re.compile(r"n[0-9]{12}")
EDGE_ID = re.compile(r"e[0-9]{12}")
END_ID = re.compile(r"n[0-9]{12}|port-[A-Z]{5}")
LABELS = re.compile(r"[A-Z][A-Za-z0-9]*(?:;[A-Z][A-Za-z0-9]*)*")
REL_TYPE = re.compile(r"[A-Z][A-Z_0-9]*")
MOMENT = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2})(?:T([0-9]{2}:[0-9]{2}:[0-9]{2})Z)?")
LAYOUTS = {"node": ("id", "labels", "name", "lastUpdated"), "edge": ("id", "type", "sourceId", "targetId", "since", "name")}
OUTPUT = "valid boolean, reason string, id string, labels array<string>, type string, source_id string, target_id string, moment timestamp, name string"


class BadRow(ValueError):
    """The row is not valid; the message is the reason."""


def assemble(text: str) -> list[str]:
    """Logical records of a text: a line break inside an open quote continues the record."""
    records, held = [], ""
    for line in _LINE.findall(text):
        held += line
        if held.count('"') % 2 == 0:
            records.append(held)
            held = ""
    return [*records, held] if held else records


def split_fields(record: str) -> list[str]:
    """Fields of one record after RFC 4180; blanks around an unquoted field don't count."""
    try:
        rows = list(csv.reader([record], strict=True))
    except csv.Error as e:
        kind = "unterminated_quote" if "unexpected end" in str(e) else "unquoted_line_break" if "new-line" in str(e) else "broken_quoting"
        raise BadRow(kind) from e
    if len(rows) != 1:
        raise BadRow("empty_row")
    if '"' not in record:
        return [f.strip(BLANKS) for f in rows[0]]
    fields, at = [], 0
    for value in rows[0]:
        if record.startswith('"', at):
            at += len(value) + value.count('"') + 3
            fields.append(value)
        else:  # the reader takes a quote mark inside an unquoted field for text; the layout doesn't
            if '"' in value:
                raise BadRow("stray_quote")
            at += len(value) + 1
            fields.append(value.strip(BLANKS))
    return fields


def moment(text: str) -> dt.datetime | None:
    if not text:
        return None
    m = MOMENT.fullmatch(text)
    if not m:
        raise BadRow("bad_date")
    try:
        return dt.datetime.fromisoformat(f"{m[1]}T{m[2] or '00:00:00'}")
    except ValueError as e:
        raise BadRow("bad_date") from e


def _need(pattern: re.Pattern, value: str, reason: str) -> str:
    if not pattern.fullmatch(value):
        raise BadRow(reason)
    return value


def parse(kind: str | None, raw: str | None) -> dict:
    """Typed fields of one raw record, or BadRow."""
    if raw is None:
        raise BadRow("null_line")
    if kind not in LAYOUTS:
        raise BadRow("unknown_kind")
    if not raw.strip(BLANKS + "\r\n"):
        raise BadRow("empty_row")
    records = assemble(raw)
    if len(records) > 1:
        raise BadRow("unquoted_line_break")
    f = split_fields(records[0])
    if len(f) != len(LAYOUTS[kind]):
        raise BadRow("column_count")
    if kind == "node":
        return {
            "id": _need(NODE_ID, f[0], "bad_id"),
            "labels": _need(LABELS, f[1], "bad_labels").split(";"),
            "name": f[2],
            "moment": moment(f[3]),
        }
    return {
        "id": _need(EDGE_ID, f[0], "bad_id"),
        "type": _need(REL_TYPE, f[1], "bad_type"),
        "source_id": _need(END_ID, f[2], "bad_source"),
        "target_id": _need(END_ID, f[3], "bad_target"),
        "moment": moment(f[4]),
        "name": f[5],
    }


_ARROW = pa.schema(
    [("valid", pa.bool_()), ("reason", pa.string()), ("id", pa.string()), ("labels", pa.list_(pa.string())), ("type", pa.string()), ("source_id", pa.string()), ("target_id", pa.string()), ("moment", pa.timestamp("us", tz="UTC")), ("name", pa.string())]
)


def _batches(kind: str, raw: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = csv.field_size_limit(1 << 30)
        try:
            for batch in batches:
                out = []
                for k, text in zip(batch.column(kind).to_pylist(), batch.column(raw).to_pylist()):
                    try:
                        out.append(parse(k, text) | {"valid": True})
                    except BadRow as e:
                        out.append({"valid": False, "reason": str(e)})
                parsed = pa.RecordBatch.from_pylist(out, schema=_ARROW)
                kept = [batch.column(f"_key_{c}") for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *parsed.columns], names=[*[f"_key_{c}" for c in keep], *_ARROW.names])
        finally:
            csv.field_size_limit(limit)

    return run


def parse_records(lines: DataFrame, kind: str, raw: str, keep: list[str]) -> DataFrame:
    """``keep`` columns (as ``_key_<name>``, so they can't clash) and the parsed fields of every row."""
    src = lines.select(*[lines[c].alias(f"_key_{c}") for c in keep], lines[kind].alias("_kind"), lines[raw].alias("_raw"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name.startswith("_key_"))
    return src.mapInArrow(_batches("_kind", "_raw", keep), f"{keys}, {OUTPUT}" if keys else OUTPUT)


def loaded(parsed: DataFrame) -> DataFrame:
    return parsed.where("valid").drop("valid", "reason")


def rejected(parsed: DataFrame) -> DataFrame:
    """The rows set apart, each with its reason."""
    keys = [c for c in parsed.columns if c.startswith("_key_")]
    return parsed.where(~F.col("valid")).select(*keys, "reason")
