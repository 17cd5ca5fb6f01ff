import itertools
import random

import pytest

from tidegraph.llm import entities


@pytest.mark.parametrize("hot", [1, 5, 1000])
def test_transpositions_across_borders_are_looked_up(spark, hot):
    rng = random.Random(hot)
    words = {"jcehotichoknenandu", "jechotichokennandu", "nonmcihanrihissin", "nonmichanrihisin", "kanod", "kaond"}
    for stem in ("mukandorin", "kirapo", "hensopadumika", "todamine"):
        for _ in range(25):
            x = list(stem)
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(len(x) - 1)
                if rng.random() < 0.7:
                    x[i], x[i + 1] = x[i + 1], x[i]
                else:
                    x[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "n"])
            words.add("".join(x))
    words = sorted(words)
    df = spark.createDataFrame([("t", w, w) for w in words], "block string, key string, s string")
    close = {(a, b) for a, b in itertools.combinations(words, 2) if entities.distance(a, b, k := entities.edits(min(len(a), len(b)))) <= k}
    for both in (False, True):
        got = {tuple(sorted((r.a, r.b))) for r in entities.segment_join(df, df, both=both, hot_size=hot).collect()}
        assert close <= got <= {(a, b) for a, b in itertools.combinations(words, 2) if entities.same_spelling(a, b)}


def test_every_close_pair_shares_a_row():
    rng = random.Random(3)
    for _ in range(20000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(5, 20)))
        b = list(a)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(b) - 1)
            if rng.random() < 0.7:
                b[i], b[i + 1] = b[i + 1], b[i]
            else:
                b[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "c"])
        short, long = sorted((a, "".join(b)), key=len)
        k = entities.edits(len(short))
        if len(short) >= 5 and entities.distance(short, long, k) <= k:
            assert {r[0] for r in entities.index_rows(short)} & {r[0] for r in entities.lookup_rows(long, False)}, (short, long)
