import datetime as dt

import pytest

from tidegraph.operators import badrows

NODE = "n000000000001,Vessel;Tanker,Blue,2024-02-29"
EDGE = "e000000000001,SAME_AS,n000000000001,port-KRPUS,,x"


@pytest.mark.parametrize(
    ("kind", "raw"),
    [
        ("node", NODE),
        ("node", NODE + "\n"),
        ("node", '"n000000000001",Vessel,"a ""b"", c\nd",'),
        ("node", " n000000000001 ,\tVessel ,, 2024-01-01T23:59:59Z "),
        ("node", 'n000000000001,Vessel,"",""'),
        ("edge", EDGE),
    ],
)
def test_valid(kind, raw):
    assert badrows.parse(kind, raw)["id"]


@pytest.mark.parametrize(
    ("kind", "raw", "reason"),
    [
        ("node", None, "null_line"),
        ("node", "", "empty_row"),
        ("node", "   ", "empty_row"),
        (None, NODE, "unknown_kind"),
        ("port", NODE, "unknown_kind"),
        ("node", EDGE, "column_count"),
        ("node", NODE.replace("Blue", 'size 5" hose'), "stray_quote"),
        ("node", NODE.replace("Blue", '"Blue'), "unterminated_quote"),
        ("node", NODE.replace("Blue", '"Blue" (x)'), "broken_quoting"),
        ("node", NODE.replace("Blue", "Blue\nx"), "unquoted_line_break"),
        ("node", NODE.replace("n0", "N0"), "bad_id"),
        ("node", NODE.replace("Vessel;", "Vessel;;"), "bad_labels"),
        ("node", NODE.replace("02-29", "02-30"), "bad_date"),
        ("node", NODE.replace("2024-02-29", "2024-01-01T24:00:00Z"), "bad_date"),
        ("node", NODE.replace("2024-02-29", "20240229"), "bad_date"),
        ("node", NODE.replace("n000000000001", "n00000000000１"), "bad_id"),
        ("edge", EDGE.replace("SAME_AS", "same_as"), "bad_type"),
        ("edge", EDGE.replace("port-KRPUS", "port-kr1"), "bad_target"),
        ("edge", EDGE.replace("n000000000001", ""), "bad_source"),
        ("node", '"n000000000001 ",Vessel,x,', "bad_id"),
    ],
)
def test_reasons(kind, raw, reason):
    with pytest.raises(badrows.BadRow, match=f"^{reason}$"):
        badrows.parse(kind, raw)


def test_assemble_keeps_quoted_breaks():
    assert badrows.assemble('a,"b\nc"\nd') == ['a,"b\nc"\n', "d"]


def test_frame(spark):
    df = spark.createDataFrame([(1, "node", NODE, "r"), (1, "node", NODE, "r"), (2, "edge", EDGE, "r"), (3, "node", "x" * 300_000, "r"), (4, None, None, None)], "line_id long, record_kind string, raw_line string, reason string")
    out = badrows.parse_records(df, "record_kind", "raw_line", ["line_id", "reason"])
    rows = {(r["_key_line_id"], r["reason"]) for r in badrows.rejected(out).collect()}
    assert rows == {(3, "column_count"), (4, "null_line")}
    good = badrows.loaded(out).collect()
    assert len(good) == 3
    node = next(r for r in good if r["labels"])
    assert node["labels"] == ["Vessel", "Tanker"] and node["moment"] == dt.datetime(2024, 2, 29)
    assert badrows.parse_records(df.limit(0), "record_kind", "raw_line", ["line_id"]).count() == 0


@pytest.mark.parametrize("mark", ["\u2028", "\u2029", "\u0085", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e"])
@pytest.mark.parametrize("end", ["", "\n", "\r\n", "\r"])
def test_only_line_feeds_and_returns_end_lines(mark, end):
    name = f"foo{mark}bar"
    assert badrows.parse("node", NODE.replace("Blue", name) + end)["name"] == name
    assert badrows.parse("node", NODE.replace("Blue", f'"{name}\nx"') + end)["name"] == f"{name}\nx"
    assert badrows.assemble(f"a{mark}b\r\nc\rd\n") == [f"a{mark}b\r\n", "c\r", "d\n"]
