import itertools
import random
from difflib import SequenceMatcher

from tidegraph.functions.text import jaro_winkler
from tidegraph.operators import resolution


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def cosine(a, b):
    count = lambda s: {g: [s[i : i + 3] for i in range(len(s) - 2)].count(g) for g in {s[i : i + 3] for i in range(len(s) - 2)}}
    x, y = count(a), count(b)
    norm = lambda v: sum(n * n for n in v.values()) ** 0.5
    return sum(n * y.get(g, 0) for g, n in x.items()) / (norm(x) * norm(y)) if x and y else 0.0


def hybrid(a, b):
    return 0.6 * (1 - edit(a, b) / max(len(a), len(b))) + 0.4 * cosine(a, b)


def names(n):
    rng = random.Random(7)
    out = {"ab", "가나다 해운", "가나라 해운", "aaaa", "aaaaaaaaaaaa"}
    for _ in range(n):
        s = "".join(rng.choice(["kan", "do", "mi", "ra", "hen", "po"]) for _ in range(rng.randrange(2, 6))) + rng.choice([" shipping", " kega logistics", ""])
        out.add(s)
        for _ in range(2):
            i = rng.randrange(len(s))
            out.add((s[:i] + rng.choice("wxqz") + s[i + rng.randrange(2) :]).strip())
    return sorted(out)


def test_all_pairs_at_the_threshold_are_linked(spark):
    ns = ["cherodinman kega logistics", "cherodinman kwga logistics", *names(110)]
    df = spark.createDataFrame(list(enumerate(ns)), "id long, name string")
    got = {(r.a, r.b) for r in resolution.decide(resolution.candidates(df)).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(ns), 2) if max(hybrid(a, b), SequenceMatcher(None, a, b).ratio(), jaro_winkler(a, b), cosine(a, b)) >= 0.85}
    assert got == want and len(want) > 100
    assert ("cherodinman kega logistics", "cherodinman kwga logistics") in got
    assert resolution.resolve(df.limit(0)).count() == 0


def test_groups_are_those_of_all_pairs_that_match(spark, monkeypatch):
    """No pair within a group is decided: neighbours, a sample and what is outside the largest group link all that all pairs link."""
    ns = [*names(110), "x" * 70 + "y", "x" * 70]
    df = spark.createDataFrame([*enumerate(ns), (-1, "Ltd."), (-2, None)], "id long, name string")
    root = {n: n for n in [*ns, ""]}
    for r in resolution.decide(resolution.candidates(df)).collect():
        a, b = sorted((root[r.a], root[r.b]))
        root = {k: a if v == b else v for k, v in root.items()}
    monkeypatch.setattr(resolution, "decide", None)  # before, every pair that may match was written and decided
    for sizes, edges in [((64, (16, 32)), 1000), ((64, (8,)), 0)]:
        monkeypatch.setattr(resolution, "NEIGHBOURS", sizes[0])
        monkeypatch.setattr(resolution, "SAMPLES", sizes[1])
        monkeypatch.setattr(resolution, "NAMES", 64)  # several blocks of each kind
        monkeypatch.setattr(resolution, "EDGES", edges)
        got = {r.id: r.group for r in resolution.resolve(df).collect()}
        assert got == {-1: "", **{i: root[n] for i, n in enumerate(ns)}}


def test_best_matches_are_complete(spark):
    ns = names(60)
    asked, known = ns[::2], ns[1::3] + ["ab"]
    got = {(r["query"], r["name"]) for r in resolution.best_matches(*[spark.createDataFrame([(n,) for n in x], "name string") for x in (asked + ["ab"], known)]).collect()}
    assert got == {(a, b) for a in {*asked, "ab"} for b in known if a == b or round(hybrid(a, b), 6) >= 0.7}
