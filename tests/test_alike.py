import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from tidegraph.functions import text as T
from tidegraph.functions.text import jaro_winkler
from tidegraph.operators import alike
from tidegraph.operators import resolution as R
from tidegraph.queries import text as Q


def spellings(n):
    rng = random.Random(3)
    out = set()
    while len(out) < n:
        s = "".join(rng.choice(["kan", "do", "mi", "hen", "aa", "n", "é", "해운"]) for _ in range(rng.randrange(1, 8)))
        s += rng.choice([" shipping", " kega logistics", "", " " + "kan" * rng.randrange(18, 26)])  # some are longer than a word
        i = rng.randrange(len(s))
        out |= {s, s[:i] + rng.choice("wx") + s[i + rng.randrange(2) :]}
    return sorted(out)


def test_bits_against_plain_computations():
    names = spellings(160)
    x, y = alike.Block(names[::2]), alike.Block(names[1::2])
    exact = alike._Pairs(x, y)
    i, j = (v.ravel() for v in np.mgrid[0 : len(x.names), 0 : len(y.names)])
    pairs = [(x.names[a], y.names[b]) for a, b in zip(i, j)]
    edits = np.array([alike.edits_of(*p) for p in pairs])
    winkler = np.array([jaro_winkler(*p) for p in pairs])
    cosine = np.array([R._cosine(*p) for p in pairs])
    ratio = np.array([SequenceMatcher(None, *sorted(p)).ratio() for p in pairs])
    assert (exact.edits(i, j) == edits).all() and (exact.jaro_winkler(i, j) == winkler).all()
    assert (exact.subsequence(i, j) == [alike.subsequence_of(*p) for p in pairs]).all()
    assert np.allclose(exact.cosine(i, j), cosine, rtol=0, atol=1e-12)
    near = 1 - edits / np.maximum(x.size[i], y.size[j])
    both = 0.6 * near + 0.4 * cosine
    for rule, want in [
        (alike.Rule(cosine=0.8), cosine >= 0.8 - 1e-9),
        (alike.Rule(edits=0.85), near >= 0.85 - 1e-9),
        (alike.Rule(hybrid=0.7), both >= 0.7 - 1e-9),
        (alike.Rule(edits=0.85, cosine=0.8), (near >= 0.85 - 1e-9) | (cosine >= 0.8 - 1e-9)),
        (alike.Rule(cosine=0.85, hybrid=0.85, fuzzy=0.85), np.maximum.reduce([near * 0, both + 1e-9, ratio, winkler, cosine + 1e-9]) >= 0.85),
    ]:
        got = {(a, b) for p, q, _ in alike.wanted(x, y, False, rule) for a, b in zip(p.tolist(), q.tolist())}
        assert got == set(zip(i[want].tolist(), j[want].tolist())) and len(got) > 20


@pytest.fixture
def written(monkeypatch):
    """Rows of the tables that an operator writes."""
    rows = []

    def counting(df, label):
        out = materialise(df, label)
        rows.append(out.count())
        return out

    materialise = R.materialise
    monkeypatch.setattr(R, "materialise", counting)
    return rows


def endings(spark):
    rng = random.Random(1)
    names = {"".join(rng.choice("bdghjkmnprst") + rng.choice("aeiou") for _ in range(5)) + " ocean research institute" for _ in range(150)}
    return spark.createDataFrame([(n,) for n in sorted(names)], "norm string"), len(names)


def test_trigram_pairs_write_names_only(spark, written):
    df, n = endings(spark)
    R.close_by_trigrams(df, 0.8).collect()
    assert written == [n]


def test_edit_pairs_write_names_only(spark, written):
    df, n = endings(spark)
    R.close_by_edits(df, 0.85).collect()
    assert written == [n]


def test_hybrid_pairs_write_names_only(spark, written):
    df, n = endings(spark)
    R.hybrid_pairs(df, 0.85).collect()
    assert written == [n]


def test_jaro_pairs_write_names_only(spark, written, tmp_path):
    df, n = endings(spark)
    df.selectExpr("norm AS name_en").write.parquet(f"{tmp_path}/organizations.parquet")
    Q.jaro_pairs(spark, str(tmp_path)).collect()
    assert written == [n]


def test_fuzzy_pairs_take_the_cosine_of_counted_trigrams(spark, written, tmp_path, monkeypatch):
    """The column function takes milliseconds a pair."""
    monkeypatch.setattr(T, "ngram_cosine", None)
    spark.createDataFrame([("hanbit shipping",), ("hanbit shiping",)], "name_en string").write.parquet(f"{tmp_path}/organizations.parquet")
    (row,) = Q.fuzzy_pairs(spark, str(tmp_path)).collect()
    want = 0.6 * (1 - 1 / 15) + 0.4 * R._cosine("hanbit shiping", "hanbit shipping")
    assert row.hybrid == pytest.approx(want, abs=1e-5)


def test_retrievers_are_compared_over_one_reading(spark, tmp_path, monkeypatch):
    rows = [(1, "Harbour tug tug"), (2, "fire drill"), (3, "tug"), (4, "fire fire"), (5, None), (6, "radar mast")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    read, relevant = [], []
    docs, measures = Q._docs, Q.retrieval.measures
    monkeypatch.setattr(Q, "_docs", lambda s, d: read.append(d) or docs(s, d))
    monkeypatch.setattr(Q.retrieval, "measures", lambda found, rel: relevant.append(rel) or measures(found, rel))
    assert {r.retriever for r in Q.compare_retrievers(spark, str(tmp_path)).collect()} == {"bm25", "density"}
    assert len(read) == 1
    # "fire" is asked twice, so it makes a document relevant by itself
    assert {tuple(r) for r in relevant[0].select("query_id", "id").collect()} == {(1, 1), (2, 2), (2, 4), (3, 6)}


def test_best_matches_write_only_pairs_that_match(spark, written):
    names = [n for n in spellings(60) if len(n) > 2]
    asked, known = names[::2], names[1::2]
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    got = R.best_matches(frame(asked), frame(known)).count()
    assert written[-1] == got > 20  # before, pairs that may match were written


@pytest.mark.parametrize("looked", [200_000, 50])
def test_best_few_are_those_of_all_pairs(monkeypatch, looked):
    monkeypatch.setattr(alike, "LOOKED", looked)
    monkeypatch.setattr(alike, "HOT", 64)  # most trigrams are looked up, some are bits
    names = spellings(300)
    asked, known = names[::2] + ["ab", "x" * 300, "x" * 270 + "y" * 30], names[1::2] + names[::8] + ["ab", "cd", "x" * 300]
    known = sorted(set(known))
    mark = {s: str(sum(map(ord, s)) % 7) + s for s in known}
    best = alike.Best(asked, 3, 0.7)
    for at in range(0, len(known), 60):
        best.meet(known[at : at + 60], [mark[s] for s in known[at : at + 60]])
    got = {}
    for a, b, score in zip(*best.result()):
        got.setdefault(a, []).append((-score, mark[b], b))
    tied = 0
    for a in asked:
        scores = {b: 1.0 if a == b else round(0.6 * (1 - alike.edits_of(a, b) / max(len(a), len(b))) + 0.4 * R._cosine(a, b), 6) for b in known}
        want = sorted((-s, mark[b], b) for b, s in scores.items() if s >= 0.7)
        tied += len(want) > 3 and want[2][0] == want[3][0]
        assert sorted(got.get(a, [])) == want[:3], a
    assert tied > 0 and sum(map(len, got.values())) > 200
    with pytest.raises(ValueError):
        alike.Best(asked, 3, 0.6)  # edits alone may reach it


def test_best_names_are_found_without_all_pairs_that_match(spark, written, tmp_path, monkeypatch):
    names = [n for n in spellings(80) if len(n) > 2]
    asked = [*names[::2], "ab", "Ltd."]
    known = [*names[1::2], *(n.upper() + " Ltd." for n in names[1::4]), *(n + " Inc." for n in names[1::4]), "AB", "cd", "", None]
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    want = {tuple(r) for r in R.best_matches(frame(asked), frame([n for n in known if n])).where("rank <= 3").collect()}
    spark.createDataFrame([(n, "Organization") for n in asked], "target_name string, target_type string").write.parquet(f"{tmp_path}/extracted_relations.parquet")
    frame(known).withColumnRenamed("name", "name_en").write.parquet(f"{tmp_path}/organizations.parquet")
    monkeypatch.setattr(R, "_across", None)  # before, all pairs that match were written
    monkeypatch.setattr(R, "ASKED", 16)
    monkeypatch.setattr(R, "KNOWN", 16)  # several blocks of each kind
    written.clear()
    got = [tuple(r) for r in Q.best_name_matches(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) > 60 and set(got) == want
    assert len(written) == 2 and max(written) <= len(known)
