import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegraph.llm import encodings, groups, pieces, spam, tokens


def brute_groups(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(find(v), v) for v in parent}


@pytest.mark.parametrize("cell", [3, 50, 10_000])
def test_groups(spark, cell):
    rng = random.Random(cell)
    edges = [(f"v{rng.randrange(90)}", f"v{rng.randrange(90)}") for _ in range(60)]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [("hub", f"s{i}") for i in range(80)]
    edges += [("x", "x"), (None, "y"), ("z", None), ("c001", "c000"), ("c000", "c001")]
    df = spark.createDataFrame([(*e, "SAME") for e in edges], "source_id string, target_id string, v string")
    got = groups.linked_groups(df, "source_id", "target_id", cell_edges=cell, hot_rows=20)
    rows = [(r.group_id, r.record_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_groups(edges)


def test_groups_empty(spark):
    assert groups.linked_groups(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def tree(c, text, leaf):
    parts = [c.encode(text[i : i + leaf]) for i in range(0, len(text), leaf)]
    while len(parts) > 1:
        parts = [c.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def test_joins_are_exact():
    c = tokens.codec(tokens.VOCABULARY)
    rng = random.Random(7)
    kinds = ["abcdefgh", "aaaab", "the ship ", "   \n\t", "가나다라마", "日本語。、は", "0123456789", "'s 're 'll", "...!!--", "é̂üñ", "🚢⚓", "==  <|endoftext|>"]
    for k in range(600):
        s = "".join(rng.choice(rng.choice(kinds[: rng.randint(1, len(kinds))])) for _ in range(rng.randint(2, 700)))
        if k % 3 == 0:
            s = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(100, 2000)))
        assert tree(c, s, rng.choice([17, 50, 111, 300])) == c.encode(s)


def test_encode_corpus(spark):
    c = tokens.codec(tokens.VOCABULARY)
    long = "Vessels with a draught of more than 7 m wait. " * 60 + "x" * 900
    rows = [(1, "a ship <|endoftext|>", "k"), (2, None, "k"), (3, "", "k"), (4, long, "k"), (5, long, "k"), (5, long, "k"), (6, "가" * 700, "k")]
    got = tokens.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, key string"), "doc_id", "text", leaf=64)
    want = sorted((i, c.encode(t) if t else []) for i, t, _ in rows)
    assert sorted((r.doc_id, list(r.ids)) for r in got.collect()) == want
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


PROSE = "당직 항해사는 등을 확인하였다. The master slept? Yes!\nA line.\r\n\r\nNext paragraph, with words; " * 40


@pytest.mark.parametrize("text", ["", "short", "x" * 512, "x" * 513, "y" * 3000, PROSE, " \n" * 700, "字" * 900 + "。" + "字" * 900])
@pytest.mark.parametrize("overlap", [0, 50])
def test_pieces(spark, text, overlap):
    df = spark.createDataFrame([("k", text, 1), ("n", None, 1)], "doc_id string, content string, start int")
    for span in (None, 1024, 65_536):
        got = sorted((r.piece_no, r.start, r.stop, r.piece) for r in pieces.split_texts(df, "doc_id", "content", overlap=overlap, range_chars=span).collect())
        assert [g[0] for g in got] == list(range(len(got)))
        assert all(p == text[s:e] and e - s <= 512 for _, s, e, p in got)
        assert got[0][1] == 0 and got[-1][2] == len(text)
        assert all(0 <= a[2] - b[1] <= overlap and b[2] > a[2] for a, b in zip(got, got[1:]))
        assert (len(got) > 1) == (len(text) > 512)


def test_pieces_end_at_words():
    text = ("word " * 300).strip()
    cuts = list(pieces.cut(pieces.ends_of(text), 0, len(text), 512, 50))
    assert all(text[e - 1] == " " for _, e in cuts[:-1])
    assert all(text[s] == "w" for s, _ in cuts)
    para = "a" * 300 + "\n\n" + "b c " * 200
    assert next(pieces.cut(pieces.ends_of(para), 0, len(para), 512, 50)) == (0, 302)


@pytest.mark.parametrize("size", [4096, 5001, 1 << 20])
def test_pieces_of_files(spark, tmp_path, size):
    text = PROSE * 8 + "字" * 5000 + "\n" + "é. " * 3000
    (tmp_path / "a.txt").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "b.txt").write_text("tiny")
    (tmp_path / "c.txt").write_bytes(b"\xff\x80" * 4000 + b" end \xe2\x82")
    (tmp_path / "d.txt").write_bytes(b"")
    table = {(r.item[-5:], r.range_no): r for r in pieces.file_boundaries(spark, f"file://{tmp_path}/*.txt", range_bytes=size).collect()}
    a = [table[k] for k in sorted(table) if k[0] == "a.txt"]
    assert a[0].start_chars == a[0].start_bytes == 0 and (a[-1].stop_chars, a[-1].stop_bytes) == (len(text), len(text.encode()))
    assert all((x.stop_chars, x.stop_bytes) == (y.start_chars, y.start_bytes) and len(text[: x.stop_chars].encode()) == x.stop_bytes for x, y in zip(a, a[1:]))
    rows = pieces.split_files(spark, f"file://{tmp_path}/*.txt", range_bytes=size).collect()
    for name, whole in (("a.txt", text), ("b.txt", "tiny"), ("c.txt", "\ufffd" * 8000 + " end \ufffd\ufffd")):
        got = sorted((r.piece_no, r.start, r.stop, r.piece) for r in rows if r.path.endswith(name))
        assert [x[0] for x in got] == list(range(len(got)))
        assert all(p == whole[s:e] and e - s <= 512 for _, s, e, p in got) and got[0][1] == 0 and got[-1][2] == len(whole)
        assert all(0 <= x[2] - y[1] <= 50 and y[1] > x[1] for x, y in zip(got, got[1:]))


def test_stitching_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 3)
    rng = random.Random(1)
    rows = [(item, i, n := rng.randrange(5, 50), n - rng.randrange(5)) for item in "ab" for i in range(10)]
    got = sorted((r["item"], r.range_no, r.start_x, r.stop_x) for r in pieces.stitch(spark.createDataFrame(rows, "item string, range_no long, x long, seam_x long"), ["x"]).collect())
    want, base, stop = [], {}, {}
    for item, i, n, s in rows:
        want.append((item, i, stop.get(item, 0), base.get(item, 0) + s))
        stop[item], base[item] = base.get(item, 0) + s, base.get(item, 0) + n
    assert got == want


def test_ranges_give_what_one_cut_between_the_seams_gives():
    text = PROSE * 3
    for size in (1024, 2048, 5000):
        b = next(pieces._bounds(size, 512)(iter([pieces._batch([["t"], [text]], ["item", "text"], [pieces.pa.string()] * 2)]))).to_pylist()
        seams = [x["range_no"] * size + x["seam_chars"] for x in b]
        assert seams[-1] == len(text) and all(s in {e for k in pieces.ends_of(text) for e in k} for s in seams)


SOUND = ["Værmelding for ytre strøk", "AVISO À NAVEGAÇÃO N.º 33", "MANUTENÇÃO NO CAIS", "The name «Ладвирь» was painted", "Here ∂η/∂t ≈ 9.8 m²/s and µ ≥ ½", "선장은 38±5.6미터(海圖)", "船長は霧のため。", "LA CÔTÂRE", "“Gone” – ‘x’ …", "", "plain"]


@pytest.mark.parametrize("text", SOUND)
def test_sound_text_stays(text):
    assert encodings.judge(text) == (False, text)


@pytest.mark.parametrize("read_as", ["latin-1", "cp1252", "mac_roman", "cp437", "cp1251"])
@pytest.mark.parametrize("text", ["Situación en la región", "Værmelding for ytre strøk", "선장은 사고 직전 화면이 흐렸다", "pris – “høy”"])
def test_round_trip(text, read_as):
    wrong = "".join(encodings._char(b, read_as) for b in text.encode())
    assert encodings.judge(wrong) == (True, text)
    assert encodings.judge("Sound – text. " + wrong) == (True, "Sound – text. " + text)


def test_nested_and_two_byte():
    text = "선장은 사고 직전 화면이 흐렸다"
    twice = text
    for _ in range(2):
        twice = "".join(encodings._char(b, "cp1252") for b in twice.encode())
    assert encodings.judge(twice) == (True, text)
    assert encodings.judge(text.encode("cp949").decode("latin-1")) == (True, text)
    assert encodings.judge("船長は霧のため".encode("euc_jp").decode("latin-1")) == (True, "船長は霧のため")
    assert encodings.judge("inspecci�n")[0]


def test_rare_syllables_are_strange():
    assert encodings.cost("추진 실험") == 0 < encodings.cost("異붿쭊")
    assert encodings.judge("추진".encode().decode("cp949")) == (True, "추진")


@pytest.mark.parametrize("layers", [1, 3, 5, 7])
def test_any_number_of_layers(layers):
    text = wrong = "Situación en la región: 사고 조사"
    for _ in range(layers):
        wrong = "".join(encodings._char(b, "cp1252") for b in wrong.encode())
    assert encodings.judge(wrong) == (True, text)


def test_lost_bytes():
    wide = "추진 효율에 관한 연구".encode().decode("cp949", "replace")
    assert "\ufffd" in wide and encodings.judge(wide) == (True, "추진 \ufffd\ufffd\ufffd \ufffd\ufffd \ufffd\ufffd")
    assert encodings.judge("푸난호".encode("cp949").decode("utf-8", "replace")) == (True, "푸\ufffd호")
    assert encodings.judge("inspecci\ufffdn") == (True, "inspecci\ufffdn")
    assert encodings.explained("l\ufffd-bas") and not encodings.explained("plain")


@pytest.mark.parametrize("text", ["선박 사고", "해양"])
def test_short_two_byte_text(text):
    assert encodings.judge(text.encode("cp949").decode("latin-1")) == (True, text)


def test_quick_look_misses_no_cost():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(32, 0x100), rng.randrange(0x100, 0x500), rng.randrange(0x2000, 0x2600), rng.randrange(0x3000, 0x3200), rng.randrange(0xAC00, 0xD7A4), 0xFFFD])) for _ in range(3))
        assert encodings._quick().search(text) or encodings.cost(text) == 0


def test_garbled_fields(spark):
    df = spark.createDataFrame([("a", "Ã©t", None, "x"), ("a", "Ã©t", None, "x"), ("b", None, "é" * 50_000, "x")], "doc_id string, title string, content string, field_name string")
    got = encodings.garbled_fields(df, "doc_id", ["title", "content"]).collect()
    assert [(r.doc_id, r.field_name, r.restored) for r in got] == [("a", "title", "ét")] * 2


def prose(rng, n):
    subject, verb, thing = "the a pilot master crew cook diver agent".split(), "checked moved signed asked sketched repaired cleaned".split(), "lamp rope keel bow deck hatch boom mast".split()
    return [". ".join(f"{rng.choice(subject)} of the ship {rng.choice(verb)} the {rng.choice(thing)} in the {rng.choice(thing)} after a {rng.choice(verb)} day" for _ in range(rng.randint(4, 9))) for _ in range(n)]


def test_spam(spark):
    rng = random.Random(3)
    pages = prose(rng, 300)
    junk = ["hull wax cheap hull wax HULL WAX " * rng.randint(8, 20) for _ in range(8)] + [" ".join(f"https://shop{rng.randrange(99)}.test/hull/wax{i}" for i in range(40)) for _ in range(8)]
    mixed = pages[0] + ". see https://ok.example/a and hull wax"
    rows = [(i, t, rng.choice(["en", "EN", "eng", None])) for i, t in enumerate([*pages, *junk, mixed, "", "  ", None, "hi", "12 34"])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id int, text string, lang string, found double")
    figures = spam.page_figures(df, "doc_id", "text", "lang").collect()
    assert {r.doc_id for r in figures if r.found} == set(range(300, 316))
    assert all(any(r[f"z_{c}"] > limit for c, limit in spam.EXTREME.items()) == r.found for r in figures)
    assert {r.doc_id for r in figures} == set(range(317)) | {320}
    assert spam.spam_pages(df.limit(0), "doc_id", "text", "lang").count() == 0
    nowhere = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in spam.spam_pages(nowhere, "doc_id", "text", "lang").collect()} == set(range(300, 316))


def test_one_spam_page_is_enough(spark):
    rows = [(i, t, "en") for i, t in enumerate([*prose(random.Random(4), 60), "cheap hull wax near me best anchor chain buy deck shoes sale " * 6])]
    df = spark.createDataFrame([*rows, rows[-1]], "doc_id int, text string, lang string")
    assert [r.doc_id for r in spam.spam_pages(df, "doc_id", "text", "lang").collect()] == [60, 60]


def test_divergence_against_a_plain_computation(spark):
    rng = random.Random(5)
    texts = [*prose(rng, 40), "cheap wax " * 30, "a ship"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id int, text string, lang string")
    got = {r.doc_id: r for r in spam.page_figures(df, "doc_id", "text", "lang").collect()}
    shares = [{w: n / sum(c.values()) for w, n in c.items()} for c in (Counter(spam.words(t)) for t in texts)]
    steep = {i for i, r in got.items() if any(r[f"z_{c}"] > spam.EXTREME[c] for c in ("slope", "residual"))}
    model = Counter()
    for i, s in enumerate(shares):
        if i not in steep:
            model.update({w: p / (len(texts) - len(steep)) for w, p in s.items()})

    def js(p):
        total = 0.0
        for w in {*p, *model}:
            a, b = p.get(w, 0), model.get(w, 0)
            total += sum(x / 2 * math.log(2 * x / (a + b)) for x in (a, b) if x)
        return total

    assert all(r.divergence == pytest.approx(js(shares[i]), abs=1e-9) for i, r in got.items())
