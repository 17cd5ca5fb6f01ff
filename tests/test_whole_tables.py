import itertools
import random
import re

import pytest

from tidegraph.functions import text as T
from tidegraph.operators import resolution as R
from tidegraph.queries import text as Q
from tests.test_resolution import edit

DOCS = [
    (1, "Radar 레이더 radar, Fire Pump", "ko"), (2, "harbour master 항만 HARBOUR 전화 010-1234-5678", None), (3, "연락처 ab@c.kr 주민 900101-1234567 번호010-1111-2222", "EN"), (4, None, "ko"), (5, "radarradar é", "en"),
]
ORGS = [(1, "한빛해운", "Hanbit Shipping", "p", 2000), (2, None, "Größe Lines", "p", 2000), (3, "바다", "바다 Lines", "p", 2000)]
FOUND = [("s1", "Organization", "한빛해운"), ("s1", "Organization", "HANBIT shipping"), ("s1", "Organization", "없는회사"), ("s2", "Organization", "größe lines"), ("s2", "Port", "바다"), (None, "Organization", "바다")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ORGS, "org_id long, name string, name_en string, home_port string, founded_year int").write.parquet(f"{d}/organizations.parquet")
    spark.createDataFrame(FOUND, "source_id string, target_type string, target_name string").write.parquet(f"{d}/extracted_relations.parquet")
    return d


def test_tags_of_all_documents(spark, folder):
    want = {(i, w, t.lower().count(w)) for i, t, _ in DOCS if t for w, _ in Q.WORDS if w in t.lower()}
    assert {tuple(r) for r in Q.dictionary_tags(spark, folder).select("id", "term", "n").collect()} == want


def test_personal_data_of_all_documents(spark, folder):
    texts = {r.doc_id: r.text for r in Q._personal(spark, folder).collect()}
    want = {(i, *(len(re.findall(rx, t)) for rx in T.PERSONAL.values())) for i, t in texts.items()}
    assert {tuple(r) for r in Q.personal_data_counts(spark, folder).collect()} == want and len(want) == 5


def test_all_mentions(spark, folder):
    assert {tuple(r) for r in Q.mentions_verified(spark, folder).collect()} == {("s1", 3, 2), ("s2", 1, 1)}


def test_joins_of_names_against_all_pairs(spark):
    rng = random.Random(5)
    stems = ["gantan shipping", "gantan towage", "bidokasu marine engineering", "größe lines", "바다해운 lines", "ab", "abc", "abcdef"]
    names = set(stems)
    for s in stems:
        for _ in range(25):
            x = list(s)
            for _ in range(rng.randint(1, 4)):
                i = rng.randrange(len(x)) if x else 0
                x[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "n", "ü", " "])
            names.add("".join(x))
    names = sorted(n for n in names if n)
    df = spark.createDataFrame([(n,) for n in names], "norm string")
    pairs = list(itertools.combinations(names, 2))
    near = lambda a, b: 1 - edit(a, b) / max(len(a), len(b))
    pick = lambda found: {(r.a, r.b): round(r.score, 9) for r in found.collect()}
    with pytest.raises(ValueError):
        R.close_by_edits(df, 0.8)
    for t in (0.85, 0.9):
        assert pick(R.close_by_edits(df, t)) == {p: round(near(*p), 9) for p in pairs if near(*p) >= t - 1e-12}
        assert pick(R.close_by_trigrams(df, t)) == {p: round(R._cosine(*p), 9) for p in pairs if min(map(len, p)) > 2 and R._cosine(*p) >= t - 1e-9}
    both = {p: round(0.6 * near(*p) + 0.4 * R._cosine(*p), 9) for p in pairs}
    assert pick(R.hybrid_pairs(df)) == {p: s for p, s in both.items() if s >= 0.85 - 1e-9}


def test_jaro_of_found_pairs(spark, tmp_path):
    orgs = [(1, "Hanbit Shipping"), (2, "Hanbit Shiping Ltd."), (3, "Größe Lines"), (4, "Grösse Lines"), (5, None)]
    spark.createDataFrame(orgs, "org_id long, name_en string").write.parquet(f"{tmp_path}/organizations.parquet")
    got = {(r.a, r.b): r.score for r in Q.jaro_pairs(spark, str(tmp_path)).collect()}
    assert got == {("hanbit shiping", "hanbit shipping"): pytest.approx(T.jaro("hanbit shiping", "hanbit shipping"), abs=1e-4)}
